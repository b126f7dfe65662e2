"""Near-duplicate detection with BagMinHash over multisets of five-word shingles.

Signatures: every shingle runs a Poisson process of points over its weight, in a hierarchy of nodes that
double in size ((0,1], (1,2], (2,4], ...); nodes wholly below the weight count every point, the node that
holds the weight keeps the points at levels below it. A point picks one register, which keeps the smallest.
Two signatures agree in a register with a chance equal to the weighted Jaccard similarity. Only points
below a threshold fitted to the text's total weight are made, and texts with empty registers go on to a
higher one, so the work hardly depends on the text's length and the signature is exact.

Bands of the signature give buckets. Members of a bucket are linked to its smallest member (a star, not
all pairs), and connected stars form families. Inside a family all pairs are verified by exact multiset
overlap; large families are dealt as blocks of hash chunks against chunks, so that no task gets an unbounded
group, and only a forest of verified links leaves a task. Classes are the components of verified links.

Equal word sequences are one text from the start. Texts of one to four words have one shingle, the whole
text; texts without words (null, empty) have none and are alone. The nodes are rows, numbered in a table
written once, so rows without a key and rows that share one are told apart. A class is led by its row of
the smallest key (null last; then by hash of the text), and its id is that key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import WordHasher, column, mix64, n_parts, settle, slices, table, texts_of, window_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4  # at similarity 0.8 a pair shares no band with a chance of 3e-6
CHUNK = 512
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ROW = "_row"


def shingles(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts given by word hashes: text, distinct shingle and its count, sorted by text and shingle."""
    doc, out = [], []
    ends = np.cumsum(words)
    for d, (b, n) in enumerate(zip(ends - words, words, strict=True)):
        if n:
            s = window_hashes(h[b : b + n], min(n, SHINGLE), 11 + (n < SHINGLE))
            out.append(s)
            doc.append(np.full(len(s), d, np.int64))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    doc, s = np.concatenate(doc), np.concatenate(out)
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], s[at], np.diff(np.append(at, len(s)))


def uniform(state: np.ndarray) -> np.ndarray:
    return ((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures [n_docs, m] as bits of the registers' points; rows of texts without elements stay empty."""
    total = np.bincount(doc, weight, n_docs)
    registers = np.full(n_docs * m, np.inf)
    todo = total > 0
    reach = np.log(m) + 3.0
    while todo.any():
        mine = todo[doc]
        d, e, w = doc[mine], element[mine], weight[mine].astype(float)
        level, low = 0, 0.0
        while len(d):
            size = max(low, 1.0)  # the node (low, low + size]
            state = mix64(e + np.uint64(int(GOLDEN) * (level + 1) % (1 << 64)))
            at, x, left = np.arange(len(d)), np.zeros(len(d)), reach / total[d]
            step = 0
            while len(at):
                step += 1
                state = mix64(state + GOLDEN)
                x = x - np.log(uniform(state)) / (m * size)
                go = x <= left[at]
                at, x, state = at[go], x[go], state[go]
                pick = mix64(state ^ np.uint64(0xD1B54A32D192ED03))
                inside = low + size * uniform(mix64(pick)) <= w[at] if level else np.ones(len(at), bool)
                slot = d[at] * m + (pick % np.uint64(m)).astype(np.int64)
                np.minimum.at(registers, slot[inside], x[inside])
            low = low + size
            on = w > low
            d, e, w, level = d[on], e[on], w[on], level + 1
        todo = (total > 0) & np.isinf(registers.reshape(n_docs, m)).any(axis=1)
        reach *= 2
    return registers.view(np.uint64).reshape(n_docs, m)


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, -1)
    key = np.full(parts.shape[:2], 7, np.uint64) + np.arange(bands, dtype=np.uint64) * GOLDEN
    for k in range(parts.shape[2]):
        key = mix64(key * GOLDEN ^ parts[:, :, k])
    return key.astype(np.int64)


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, content (hash of the words, null without any) and bands."""

    def run(batches):
        hasher = WordHasher(21)
        for batch in batches:
            for pdf in slices(batch, "text"):
                h, words = hasher.texts(list(pdf["text"]))
                doc, element, weight = shingles(h, words)
                keys = band_keys(bag_minhash(doc, element, weight, len(words)))
                ends = np.cumsum(words)
                content = [h[b:e].tobytes() for b, e in zip(ends - words, ends, strict=True)]
                full = words > 0
                yield pd.DataFrame({"id": pdf["id"], "content": [hasher_digest(c) if f else None for c, f in zip(content, full, strict=True)], "bands": [k if f else None for k, f in zip(keys, full, strict=True)]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, content binary, bands array<long>")


def hasher_digest(data: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(data, digest_size=12).digest()


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, side: np.ndarray | None, threshold: float) -> list[tuple[int, int]]:
    """A forest of the pairs of n texts whose multisets are similar enough; with sides, pairs across sides only.

    A pair's similarity is exact; pairs that are connected already are not looked at again."""
    _, element = np.unique(element, return_inverse=True)
    counts = np.zeros(element.max() + 1 if len(element) else 1, np.int64)
    cut = np.searchsorted(doc, np.arange(n + 1))
    size = np.bincount(doc, weight, n)
    forest, out, rest = Forest(n), [], n
    for i in range(n - 1):
        if side is not None and side[i]:
            break  # sorted by side: the others have met them
        a, b = cut[i], cut[i + 1]
        first = max(i + 1, 0) if side is None else int(np.searchsorted(side, 1))
        if a == b or cut[n] == cut[first]:
            continue
        counts[element[a:b]] = weight[a:b]
        low = cut[first]
        common = np.minimum(counts[element[low:]], weight[low:])
        sums = np.concatenate(([0], np.cumsum(common)))
        shared = sums[cut[first + 1 : n + 1] - low] - sums[cut[first:n] - low]
        union = size[i] + size[first:n] - shared
        for j in np.flatnonzero((shared >= threshold * union - 1e-9) & (union > 0)) + first:
            if forest.join(i, int(j)):
                out.append((i, int(j)))
                rest -= 1
        counts[element[a:b]] = 0
        if rest == 1:
            break
    return out


def verify(families: DataFrame, groups: int, threshold: float, kind: str) -> DataFrame:
    """Links inside families (id, family, text): a, b."""
    counts = families.groupBy("family").agg(F.ceil(F.countDistinct("id") / CHUNK).cast("int").alias("chunks"))
    rows = families.join(counts, "family").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")})
    rows = rows.withColumn("g", F.pmod(F.xxhash64("family", "one", "two"), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hasher, out = WordHasher(21), []
        for (_, one, two), block in pdf.groupby(["family", "one", "two"], sort=False):
            side = None
            if one != two:
                block = block.sort_values("chunk", kind="stable")
                side = (block["chunk"].to_numpy() != one).astype(int)
            ids = block["id"].to_numpy()
            doc, element, weight = shingles(*hasher.texts(list(block["text"])))
            out += [(ids[a], ids[b]) for a, b in linked(doc, element, weight, len(ids), side, threshold)]
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.select("g", "family", "one", "two", "chunk", "id", "text").groupBy("g").applyInPandas(run, f"a {kind}, b {kind}")


def numbered(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row`` beside a number, written once, so that the numbers stay; no name of a caller's column can clash with ours."""
    return settle(docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias(ROW)), "rows")


def row_classes(rows: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """_row, lead (the class's first row), class_id (that row's key) and class_size of the numbered rows that have copies."""
    signed = settle(sign(rows, ROW, text), "signatures")
    texts = signed.where("content is not null").groupBy("content").agg(F.min("id").alias("rep"))
    texts = settle(texts, "contents")
    # a content's bands are those of its first row
    members = signed.join(texts, F.col("id") == F.col("rep")).select("rep", F.posexplode("bands").alias("band", "bucket"))
    stars = members.groupBy("band", "bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where(F.col("lead") != F.col("last")).drop("last")
    edges = settle(members.join(stars, ["band", "bucket"]).where(F.col("rep") != F.col("lead")).select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), "stars")
    families = connected_components(edges).withColumnRenamed("comp_id", "family")
    # merged at every size: a small input's broadcast would only hide what a large one shuffles
    found = rows.select(F.col(ROW).alias("id"), F.col(text).alias("text")).join(families.hint("merge"), "id")
    links = verify(found, n_parts(rows, text, 16 << 20), threshold, "bigint")
    same = signed.where("content is not null").join(texts, "content").where(F.col("id") != F.col("rep")).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    classes = connected_components(links.union(same)).withColumnRenamed("id", ROW)
    linked = settle(rows.select(ROW, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(ROW).alias("row")).alias("at")).join(classes.hint("merge"), ROW), "linked")
    leads = linked.groupBy("comp_id").agg(F.min("at").alias("lead"), F.count("*").alias("class_size"))
    return linked.join(leads, "comp_id").select(ROW, F.col("lead.row").alias("lead"), F.col("lead.key").alias("class_id"), "class_size")


def every_row(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id and class_size of every row; a row without copies is its own class."""
    rows = numbered(docs.select(column(key).alias("id"), column(text).alias("text"))).select(ROW, "row.*")
    found = rows.select(ROW, "id").join(row_classes(rows, "id", "text", threshold).hint("merge"), ROW, "left")
    return found.select("id", F.when(F.col("lead").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id and class_id of every row with a key (a key's equal rows come once)."""
    return every_row(docs, key, text, threshold).where("id is not null").select("id", "class_id").distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each class, its lead. Rows of texts without words stay."""
    rows = numbered(docs)
    named = rows.select(ROW, F.col("row").getField(key).alias("id"), F.col("row").getField(text).alias("text"))
    others = row_classes(named, "id", "text", THRESHOLD).where(F.col(ROW) != F.col("lead")).select(ROW)
    return rows.join(others.hint("merge"), ROW, "left_anti").select("row.*")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_row(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
