"""Source divergence audit: how each source's choice of terms differs from every other source of its language, exactly.

Each language keeps the terms found in ``min_docs`` of its documents. A group (language, source) gives term t the number
p = 1 + floor(10^9 * (count + 1) / (N + V)); the divergence of two groups is the sum over all kept terms of
floor((p - q)^2 / q). Most counts are zero, so a sum over terms and pairs of sources would mostly add up one constant.

Instead each term is a row of its nonzero counts in order of source, and rows go into a frequent-pattern tree with
their multiplicity: terms whose rows begin alike share nodes. With z for "count zero" the sum of a pair (s, r) is::

    V * f(z, z) + sum over counts c of s:      [f(c, z) - f(z, z)]
                + sum over counts d of r:      [f(z, d) - f(z, z)]
                + sum over counts c and d:     [f(c, d) - f(c, z) - f(z, d) + f(z, z)]

The first two corrections belong to a node and the root, the third to a node and an ancestor; each such combination is
worked out once and counts as often as rows pass through the node. Equal rows are counted before they are dealt. Rows that begin alike
go to one task, which builds the tree level by level and walks from all nodes of a level to their ancestors together. Trees hold some
tens of thousands of rows; what several trees say of a pair is added up. All of it is whole-number arithmetic in 64
bits, exact while a language keeps fewer than 5 * 10^8 terms (sums then stay below 2^63); larger counts than 9 * 10^9 go through Python's integers.

Terms are counted in the tasks that read the texts and in the shuffle once more; a hot source or term is a few rows from each task.
No table of sources is broadcast: trees meet the totals of their language's sources in a cogroup. The result of part ``pair`` has a row for
each two sources of a language, as it must.

Null texts, languages and sources count as empty. Every group that occurs has its pairs, also where it has no terms; a language without kept
terms has pairs of value 0. Texts are read whole. Repeated rows count as documents of their own. Ties are ordered by the item's bytes. A table
without rows gives none. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_slices, column, settle, table

SCALE = 1_000_000_000
HELD, TREE, DEALT_BY = 300_000, 20_000, 4
LARGE = 9_000_000_000
#: Terms are runs of ASCII letters and of bytes beyond ASCII (all parts of code points beyond it); A to Z become a to z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it): a row a term, group and some thousand documents."""

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def rows():
            for (a, b), (n, docs) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    part = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({"lang": [a] * len(part), "source": [b] * len(part), "term": pa.array(part, pa.binary()).cast(pa.string()), "n": [n[t] for t in part], "docs": [docs[t] for t in part]})
            held.clear()

        for batch in batches:
            for part in arrow_slices(batch, "text"):
                texts = part["text"].cast(pa.binary()).to_pylist()
                for a, b, raw in zip(part["lang"].to_pylist(), part["source"].to_pylist(), texts, strict=True):
                    terms = (raw or b"").translate(LETTERS).split()
                    n, docs = held[a, b]
                    n.update(terms)
                    docs.update(set(terms))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from rows()
        yield from rows()

    named = docs.select(F.coalesce(column(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(column(source).cast("string"), F.lit("")).alias("source"), column(text).alias("text"))
    return named.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exactly."""
    if len(n) and n.max() >= LARGE:
        return (1 + SCALE * (n.astype(object) + 1) // total.astype(object)).astype(np.int64)
    return 1 + SCALE * (n + 1) // total


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Groups:
    """The sources of one language: names in order, totals, and the share of a term they don't have."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.sort_by("source")
        self.names = rows["source"].combine_chunks()
        self.total = rows["total"].to_numpy()
        self.zero = _shares(np.zeros(len(self.total), np.int64), self.total)

    def places(self, names: pa.Array) -> np.ndarray:
        return pc.index_in(names, value_set=self.names).to_numpy(zero_copy_only=False).astype(np.int64)


def tree_levels(starts: np.ndarray, source: np.ndarray, n: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels of the tree of rows (source and count of their items from each start on): parent, source, count, multiplicity of each node."""
    lengths, levels = np.diff(starts), []
    row, node = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    while True:
        deep = lengths[row] > len(levels)
        row, node = row[deep], node[deep]
        if not len(row):
            return levels
        at = starts[row] + len(levels)
        order = np.lexsort((n[at], source[at], node))
        key = np.stack((node, source[at], n[at]))[:, order]
        new = np.ones(len(row), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        first = np.flatnonzero(new)
        levels.append((*key[:, first], np.add.reduceat(times[row[order]], first)))
        node = np.empty(len(row), np.int64)
        node[order] = np.cumsum(new) - 1


class PairSums:
    """Sums by pair of places, compacted as they come."""

    def __init__(self, size: int) -> None:
        self.size, self.keys, self.values, self.held = size, [], [], 0

    def add(self, s: np.ndarray, r: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(s * self.size + r)
        self.values.append(value)
        self.held += len(value)
        if self.held > 1 << 20:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        keys, values = np.concatenate([np.empty(0, np.int64), *self.keys]), np.concatenate([np.empty(0, np.int64), *self.values])
        if len(keys):
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            keys, values = keys[first], np.add.reduceat(values, first)
        self.keys, self.values, self.held = [keys], [values], len(keys)
        return keys, values


def pair_corrections(levels: list[tuple[np.ndarray, ...]], groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Keys (place of group * number of sources + place of item) and summed corrections of one tree."""
    zero, every = groups.zero, np.arange(len(groups.zero))
    sums, known = PairSums(len(every)), []
    for depth, (parent, s, n, times) in enumerate(levels):
        p = _shares(n, groups.total[s])
        known.append((parent, s, p))
        # a node and the root: nodes of one source and count speak together
        order = np.lexsort((p, s))
        first = np.flatnonzero(np.concatenate(([True], (s[order][1:] != s[order][:-1]) | (p[order][1:] != p[order][:-1]))))
        s1, p1, times1 = s[order][first], p[order][first], np.add.reduceat(times[order], first)
        for at in range(0, len(s1), max(1, 200_000 // len(every))):
            a, pa_, t = (x[at : at + max(1, 200_000 // len(every)), None] for x in (s1, p1, times1))
            r = np.broadcast_to(every, (len(a), len(every)))
            other = r != a
            both = np.broadcast_to(a, r.shape)[other], r[other]
            sums.add(*both, (t * (_apart(pa_, zero) - _apart(zero[a], zero)))[other])
            sums.add(*both[::-1], (t * (_apart(zero, pa_) - _apart(zero, zero[a])))[other])
        # a node and each of its ancestors
        up = parent
        for ancestor in range(depth - 1, -1, -1):
            above, r_all, q_all = known[ancestor]
            r, q = r_all[up], q_all[up]
            for a, b, x, y in ((s, r, p, q), (r, s, q, p)):
                sums.add(a, b, times * (_apart(x, y) - _apart(x, zero[b]) - _apart(zero[a], y) + _apart(zero[a], zero[b])))
            up = above[up]
    return sums.compact()


def _tree(key, paths: pa.Table, groups: pa.Table) -> pa.Table:
    if not paths.num_rows or not groups.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "part": pa.array([], pa.int64())})
    known = Groups(groups)
    path = paths["path"].combine_chunks()
    items = path.flatten()
    starts = path.offsets.to_numpy().astype(np.int64) - path.offsets[0].as_py()
    levels = tree_levels(starts, known.places(items.field("source")), items.field("n").to_numpy(zero_copy_only=False), paths["times"].to_numpy())
    keys, values = pair_corrections(levels, known)
    of = lambda places: known.names.take(pa.array(places))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(keys), pa.string()), "source": of(keys // len(known.zero)), "item": of(keys % len(known.zero)), "part": values})


def _first_terms(top: int):
    """A task's first ``top`` terms of each source, of those it uses more than its language does."""

    def run(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        if not terms.num_rows or not groups.num_rows:
            return pa.table({n: pa.array([], pa.int64() if n == "value" else pa.string()) for n in ("lang", "source", "item", "value")})
        known = Groups(groups)
        terms = terms.sort_by("term")
        path = terms["path"].combine_chunks()
        items, lengths = path.flatten(), np.diff(path.offsets.to_numpy())
        s, n = known.places(items.field("source")), items.field("n").to_numpy(zero_copy_only=False)
        term = np.repeat(np.arange(len(lengths)), lengths)
        whole = np.add.reduceat(n, np.cumsum(lengths) - lengths)
        lang_total = groups["lang_total"].to_numpy()[:1]
        p, q = _shares(n, known.total[s]), _shares(whole, np.broadcast_to(lang_total, whole.shape))[term]
        more = np.flatnonzero(p > q)
        value = _apart(p[more], q[more])
        order = np.lexsort((term[more], -value, s[more]))
        s, term, value = s[more][order], term[more][order], value[order]
        begins = np.searchsorted(s, s, side="left")
        keep = np.arange(len(s)) - begins < top
        return pa.table({"lang": pa.array([key[0].as_py()] * int(keep.sum()), pa.string()), "source": known.names.take(pa.array(s[keep])), "item": terms["term"].combine_chunks().take(pa.array(term[keep])), "value": value[keep]})

    return run


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: every other source of the language; part ``term``: the first ``top`` terms that
    the source uses more than its language."""
    spread = count_terms(docs, text, lang, source).repartition("lang", "term")  # so that both groupings below stay in place
    each = spread.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("path"))
    terms = settle(rows.where(F.col("docs") >= min_docs).select("lang", "term", "path"), "divergence-terms")

    sizes = terms.select("lang", F.explode("path").alias("i")).groupBy("lang", F.col("i.source").alias("source")).agg(F.sum("i.n").alias("size"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"))
    found = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    groups = found.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["size", "v"])
    groups = settle(groups.select("lang", "source", "v", (F.col("size") + F.col("v")).alias("total"), (F.sum("size").over(W.partitionBy("lang")) + F.col("v")).alias("lang_total")), "divergence-groups")

    cells = max(1, -(-terms.count() // TREE))
    cell = F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
    asked = groups.where("v > 0").select("lang", "source", "total", "lang_total", cell).groupBy("lang", "cell")
    paths = terms.groupBy("lang", "path").agg(F.count("*").alias("times"))
    paths = paths.withColumn("cell", F.pmod(F.xxhash64(F.slice("path", 1, DEALT_BY)), F.lit(cells)).cast("int"))
    corrections = paths.groupBy("lang", "cell").cogroup(asked).applyInArrow(_tree, "lang string, source string, item string, part long")
    summed = corrections.groupBy("lang", "source", "item").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("more"))
    zero = F.when(F.col("v") > 0, F.expr(f"1 + {SCALE} div total")).otherwise(F.lit(1).cast("long"))
    mine = groups.select("lang", "source", "v", zero.alias("p"))
    others = groups.select("lang", F.col("source").alias("item"), zero.alias("q"))
    pairs = mine.join(others, "lang").where("source <> item").join(summed, ["lang", "source", "item"], "left")
    base = F.expr("cast(v as decimal(20, 0)) * (((p - q) * (p - q)) div q)")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("more", F.lit(0))).cast("long").alias("value"))

    dealt = terms.withColumn("cell", F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int"))
    best = dealt.groupBy("lang", "cell").cogroup(asked).applyInArrow(_first_terms(top), "lang string, source string, item string, value long")
    best = best.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(best.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(t) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, CAST(coalesce(x.n, 0) AS HUGEINT) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p FROM c WINDOW s AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS q FROM l WINDOW s AS (PARTITION BY lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 200
"""
