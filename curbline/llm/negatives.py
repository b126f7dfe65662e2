"""Hard-negative mining with exact integer scores from a residue-number-system matrix product.

Vectors become whole numbers, floor(scale * x). A block of anchors meets a block of rows as matrices: their
residues modulo several primes, centred around zero, are multiplied in float32 in strips of ``STRIP`` components. With
primes below 2 * 256 every partial sum stays below 2^24, so float32 holds it exactly whatever the order of
summation. As many primes are taken as the largest norms of the two blocks ask for (Cauchy-Schwarz), and the
signed score is put together by Chinese remaindering in a balanced mixed-radix form.

Two passes meet every anchor with every row. The first finds an anchor's positives, the first ``positives``
other rows of its label; the second, given their scores, the first ``negatives`` rows of other labels within each positive's
window of scores. Rows travel as packed matrices of about a thousand, anchors in groups of ``ANCHORS``; each cell of (group of anchors, group
of rows) is one task's work of bounded size, and gives its own first few, which a window ranks with those of the other
cells. Nothing is broadcast, and the work is the stated one: anchors times rows.

Rows with a null label, a null vector, or a null, NaN or infinite component take no part; nor do rows longer than
2^28 steps of 1/scale, whose scores might not fit a long. Vectors score only against those of their own
length. Rows without a key can be positives and negatives and come last among equal scores; they are no anchors. Rows with the
anchor's own key are not its positives. Other repeated rows count one by one; anchors equal in key, label and vector count once, those
of one key that differ are mined one by one. Tables without rows or anchors give none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, settle, table

STRIP = 256
ROWS, ANCHORS, BLOCK = 8192, 2048, 1024
LONGEST = 1 << 28
#: The primes below 510 from the largest: 256 products of centred residues (254 * 254 at most) stay below 2^24.
PRIMES = [p for p in range(509, 2, -2) if all(p % q for q in range(3, 23, 2) if q < p)]
NONE = np.iinfo(np.int64).min


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt(np.square(m, dtype=np.float64).sum(axis=1)).max(initial=0.0))


def rns_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers; they must stay below 2^57."""
    bound = int(_norm(a) * _norm(b) * (1 + 1e-9)) + 2
    if bound >= 1 << 57:
        raise OverflowError("scores may not fit a long")
    out, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in PRIMES:
        h = p // 2
        left, right = (((m + h) % p - h).astype(np.float32) for m in (a, b))
        residue = np.zeros(out.shape, np.int32)
        for at in range(0, a.shape[1], STRIP):
            part = left[:, at : at + STRIP] @ right[:, at : at + STRIP].T
            residue = (residue + part.astype(np.int32)) % p
        # the next digit of a balanced mixed-radix number
        digit = ((residue - (out % p).astype(np.int32)) % p * pow(product, -1, p) + h) % p - h
        out += digit.astype(np.int64) * product
        product *= p
        if product > 2 * bound:
            return out
    raise AssertionError("the primes cover any allowed bound")


def _packed(scale: int, extra: tuple[str, ...], blocks_of: int | None):
    """Packs rows of a batch, a block for each vector length; blocks of rows are dealt to ``blocks_of`` groups by content."""

    def run(batches):
        for batch in batches:
            lists = batch["vector"]
            lengths = np.diff(lists.offsets.to_numpy())
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dim)
                m = np.floor(values[starts[mine][:, None] + np.arange(dim)] * scale)
                fits = np.sqrt(np.square(m).sum(axis=1)) < LONGEST
                mine, m = mine[fits], m[fits].astype(np.int32)
                for at in range(0, len(mine), BLOCK):
                    pick = pa.array(mine[at : at + BLOCK])
                    comps = m[at : at + BLOCK].tobytes()
                    group = zlib.crc32(comps + str(at).encode()) % blocks_of if blocks_of else batch["a"][int(mine[0])].as_py()
                    if blocks_of:
                        yield _one_block(batch, pick, extra, group, dim, comps)
                    else:
                        a = batch["a"].take(pick).to_numpy(zero_copy_only=False)
                        for g in np.unique(a).tolist():
                            own = np.flatnonzero(a == g)
                            yield _one_block(batch, pa.array(mine[at : at + BLOCK][own]), extra, g, dim, m[at : at + BLOCK][own].tobytes())

    return run


def _one_block(batch, pick, extra, group, dim, comps) -> pa.RecordBatch:
    def whole(name: str) -> pa.Array:
        values = batch[name].take(pick)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    return pa.RecordBatch.from_pydict({"g": pa.array([group], pa.int32()), "dim": pa.array([dim], pa.int32()), "comps": pa.array([comps], pa.binary()), **{n: whole(n) for n in ("id", "label", *extra)}})


def _matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["comps"], np.int32).reshape(len(row["id"]), row["dim"]).astype(np.int64)


def _cell(anchors: pa.Table, rows: pa.Table, strip: int = 256):
    """Strips of anchors with the cell's rows of their length, rows in order of key: (anchor block, places, keys, labels, scores)."""
    blocks = rows.to_pylist()
    for own in anchors.to_pylist():
        there = [b for b in blocks if b["dim"] == own["dim"]]
        if not there:
            continue
        m = np.concatenate([_matrix(b) for b in there])
        keys = [k for b in there for k in b["id"]]
        none = np.array([k is None for k in keys])
        ids = np.array([0 if k is None else k for k in keys], np.int64)
        order = np.lexsort((ids, none))
        m, ids, none, labels = m[order], ids[order], none[order], np.array([x for b in there for x in b["label"]], np.int64)[order]
        a = _matrix(own)
        for at in range(0, len(a), strip):
            place = np.arange(at, min(at + strip, len(a)))
            yield own, place, ids, none, labels, rns_scores(a[place], m)


def _first_positives(count: int):
    def run(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for own, place, ids, none, labels, scores in _cell(anchors, rows):
            mine, keys = np.array(own["label"])[place], np.array(own["id"], np.int64)[place]
            scores[(labels != mine[:, None]) | ((ids == keys[:, None]) & ~none)] = NONE
            k = np.arange(len(place))
            for _ in range(count):
                best = scores.argmax(axis=1)  # the first of equal scores: the smallest key
                got = scores[k, best]
                some = np.flatnonzero(got != NONE)
                found.append((place[some], keys[some], best[some], got[some], ids, none, own))
                scores[k, best] = NONE
        out = {"anchor_id": [], "anchor_hash": [], "positive_id": [], "positive_score": []}
        for place, keys, best, got, ids, none, own in found:
            out["anchor_id"].append(pa.array(keys, pa.int64()))
            out["anchor_hash"].append(pa.array(np.array(own["hash"], np.int64)[place]))
            out["positive_id"].append(pa.array(ids[best], pa.int64(), mask=none[best]))
            out["positive_score"].append(pa.array(got, pa.int64()))
        return pa.table({k: pa.chunked_array(v, pa.int64()) for k, v in out.items()})

    return run


def _window_negatives(count: int, low: int, high: int):
    def run(key, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        names = ("anchor_id", "anchor_hash", "place", "negative_id", "negative_score")
        out: dict[str, list] = {n: [] for n in names}
        for own, place, ids, none, labels, scores in _cell(anchors, rows):
            keys, hashes = (np.array(own[n], np.int64)[place] for n in ("id", "hash"))
            scores[labels == np.array(own["label"])[place][:, None]] = NONE
            order = np.argsort(np.where(scores == NONE, -(NONE + 1), -scores), axis=1, kind="stable")  # others first, in order of key
            ranked = np.take_along_axis(scores, order, axis=1)
            real = (ranked != NONE).sum(axis=1)
            have = [own["scores"][i] for i in place.tolist()]
            for j in range(max(map(len, have), default=0)):
                some = np.array([i for i, p in enumerate(have) if len(p) > j])
                target = np.array([have[i][j] for i in some.tolist()], np.int64)
                s = ranked[some]
                above = ((s != NONE) & (100 * np.where(s == NONE, 0, s) > high * target[:, None])).sum(axis=1)
                pick = above[:, None] + np.arange(count)
                inside = pick < real[some][:, None]
                pick = np.minimum(pick, s.shape[1] - 1)
                got = np.take_along_axis(s, pick, axis=1)
                inside &= 100 * np.where(inside, got, 0) >= low * target[:, None]
                who, c = np.nonzero(inside)
                chosen = order[some[who], pick[who, c]]
                out["anchor_id"].append(pa.array(keys[some[who]], pa.int64()))
                out["anchor_hash"].append(pa.array(hashes[some[who]], pa.int64()))
                out["place"].append(pa.array(np.full(len(who), j + 1), pa.int64()))
                out["negative_id"].append(pa.array(ids[chosen], pa.int64(), mask=none[chosen]))
                out["negative_score"].append(pa.array(got[who, c], pa.int64()))
        return pa.table({k: pa.chunked_array(v, pa.int64()) for k, v in out.items()})

    return run


def mine_hard_negatives(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and positive the first ``negatives`` rows of other labels whose score is within ``low`` to ``high`` percent of
    the positive's: anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``is_anchor`` speaks of the columns of ``df``."""
    whole = F.forall(column(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    part = df.where(column(label).isNotNull() & column(vector).isNotNull() & whole)
    rows = part.select(column(key).cast("long").alias("id"), column(label).cast("long").alias("label"), column(vector).cast("array<double>").alias("vector"), (F.coalesce(is_anchor, F.lit(False)) & column(key).isNotNull()).alias("asks"))
    n, n_anchors = df.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    row_groups, anchor_groups = max(1, -(-n // ROWS)), max(1, -(-n_anchors // ANCHORS))
    fields = "g int, dim int, comps binary, id array<long>, label array<long>"
    blocks = rows.select("id", "label", "vector").mapInArrow(_packed(scale, (), row_groups), fields)
    blocks = blocks.withColumnRenamed("g", "r").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(anchor_groups - 1))))
    asking = rows.where("asks").select("id", "label", "vector", F.xxhash64("label", "vector").alias("hash")).dropDuplicates(["id", "hash"])

    def packed(of: DataFrame, extra: tuple[str, ...], kinds: str) -> DataFrame:
        dealt = of.withColumn("a", F.pmod(F.xxhash64("id", "hash"), F.lit(anchor_groups)).cast("int")).repartition("a")
        made = dealt.mapInArrow(_packed(scale, extra, None), fields + kinds)
        return made.withColumnRenamed("g", "a").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1))))

    def met(asked: DataFrame, run, fields: str) -> DataFrame:
        return blocks.groupBy("a", "r").cogroup(asked.groupBy("a", "r")).applyInArrow(run, fields)

    near = met(packed(asking, ("hash",), ", hash array<long>"), _first_positives(positives), "anchor_id long, anchor_hash long, positive_id long, positive_score long")
    ranked = near.withColumn("place", F.row_number().over(W.partitionBy("anchor_id", "anchor_hash").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id")))).where(F.col("place") <= positives)
    ranked = settle(ranked, "positives")  # both what follows and the result read it: the first pass runs once
    chosen = ranked.groupBy("anchor_id", "anchor_hash").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    known = asking.join(chosen, (F.col("id") == F.col("anchor_id")) & (F.col("hash") == F.col("anchor_hash"))).select("id", "label", "vector", "hash", F.col("p.positive_score").alias("scores"), F.col("p.positive_id").alias("pos"))
    far = met(packed(known, ("hash", "scores"), ", hash array<long>, scores array<array<long>>"), _window_negatives(negatives, low, high), "anchor_id long, anchor_hash long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "anchor_hash", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return far.join(ranked, ["anchor_id", "anchor_hash", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.rid AS arid, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0 AND b.vec_id IS DISTINCT FROM a.vec_id),
p AS (SELECT arid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY arid ORDER BY score DESC, id NULLS LAST) AS place FROM s WHERE alike QUALIFY place <= 5),
n AS (SELECT p.arid, p.anchor_id, p.place, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.arid, p.place ORDER BY s.score DESC, s.id NULLS LAST) AS rank
  FROM p JOIN s ON s.arid = p.arid WHERE NOT s.alike AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""
