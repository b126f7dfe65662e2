"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) get weights 1, 2, 3 and again; they share all words by weight,
but none takes more than ``most`` times its own size, and what that frees is shared among the others by
weight. Within a source every document's expected copies (target over size of the source) are summed
along an order by size, one random offset is added, and a document comes once for each whole number
that its stretch of the sum crosses. So a source's words miss its target by one document at most, and
no document comes more than ``most`` times.

The prefix sums are taken in three levels (sizes of a source, salts of a size, documents of a salt), so
no task holds a hot source or a hot group of copies; a window holds one source's distinct sizes at most.
Offsets come from a hash of the source's name, so reruns agree. Null or empty texts have size 0 and come
at the source's rate as well. Repeated rows count one by one; rows that tie in every column share their
group's copies in any order, which no result shows. Long texts are counted whole. A table without rows gives
none. Other columns pass untouched, also where their names are those used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, column, table

SALTS = 1024
WEIGHTS = (1, 2, 3)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, most: int = 3) -> DataFrame:
    """One row per source: _s, source_size, target. Sorting is over one row per source."""
    per = sized.groupBy("_s").agg(F.sum("size").alias("source_size"))
    order = W.orderBy("_s")
    weights = F.array(*map(F.lit, WEIGHTS))
    per = per.withColumn("weight", F.get(weights, (F.row_number().over(order) - 1) % len(WEIGHTS)))
    whole = W.partitionBy(F.lit(0))
    full = (most * F.col("source_size") / F.col("weight")).cast("double")
    upto = W.orderBy(full, "_s").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("*", F.sum("source_size").over(whole).alias("_all"), (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))).alias("_left"), F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0)).alias("_taken"))
    over = (F.col("_all") - F.col("_taken")).cast("double") * F.col("weight") > (most * F.col("source_size")).cast("double") * F.col("_left")
    per = per.withColumn("_full", over)
    free = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
    used = F.coalesce(F.sum(F.when(F.col("_full"), most * F.col("source_size"))).over(whole), F.lit(0))
    target = F.when(F.col("_full"), (most * F.col("source_size")).cast("double")).otherwise((F.col("_all") - used).cast("double") * F.col("weight") / free)
    return per.select("_s", "source_size", target.alias("target"))


def copies_at(rank: Column, rate: Column, offset: Column, most: int = 3) -> Column:
    """Whole numbers that the stretch of the sum at ``rank`` crosses."""
    rank = rank.cast("double")
    return F.least(F.floor(offset + rate * (rank + 1)) - F.floor(offset + rate * rank), F.lit(most)).cast("long")


def place_groups(groups: DataFrame, order: list[str], most: int = 3) -> DataFrame:
    """``groups`` has _s, size, _salt and n (rows it stands for); adds source_size, target, rank (of its first row), rate and offset."""
    targets = source_targets(groups.withColumn("size", F.col("size") * F.col("n")), most)
    cells = groups.groupBy("_s", "size", "_salt").agg(F.sum("n").alias("n"))
    sizes = cells.groupBy("_s", "size").agg(F.sum("n").alias("n"))
    before = sizes.select("_s", "size", F.coalesce(F.sum("n").over(W.partitionBy("_s").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    before = before.join(targets, "_s")
    inner = F.coalesce(F.sum("n").over(W.partitionBy("_s", "size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("_s", "size", "_salt", inner.alias("_c")).join(before, ["_s", "size"]).select("_s", "size", "_salt", (F.col("_b") + F.col("_c")).alias("_before"), "source_size", "target")
    first = F.coalesce(F.sum("n").over(W.partitionBy("_s", "size", "_salt").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    both = groups.withColumn("_r", first).join(cells, ["_s", "size", "_salt"])
    return both.withColumns({
        "rank": F.col("_before") + F.col("_r"),
        "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
        "offset": F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("_s.name"))), 1, 6), 16, 10).cast("double") / 16777216.0,
    })


def choose_copies(sized: DataFrame, salt: Column, key: str = "doc_id", source: str = "source", most: int = 3) -> DataFrame:
    """``sized`` has key, source and size (long); adds source_size, target and copies."""
    rows = sized.withColumns({"_s": F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name")), "_salt": salt, "n": F.lit(1).cast("long")})
    placed = place_groups(rows, [key], most)
    return placed.withColumn("copies", copies_at(F.col("rank"), F.col("rate"), F.col("offset"), most)).drop("_s", "_salt", "_r", "_before", "n", "rank", "rate", "offset")


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is chosen. Text is shuffled once.

    Rows of one key, source, size and text hash are alike to the mix: they are counted before they are shuffled,
    and each group gets one stretch of its source's sum, which its rows share out in order."""
    names = docs.columns
    alike = {
        "__m_k": F.coalesce(column(key).cast("string"), F.concat(F.lit("null:"), F.xxhash64(column(text)).cast("string"))),
        "__m_s": F.struct(column(source).isNull().alias("none"), F.coalesce(column(source).cast("string"), F.lit("")).alias("name")),
        "size": word_count(text), "__m_h": F.xxhash64(column(text)),
    }
    groups = docs.select(*[c.alias(k) for k, c in alike.items()]).groupBy(*alike).agg(F.count("*").alias("n"))
    placed = place_groups(groups.withColumn("_salt", F.pmod(F.xxhash64("__m_k", "__m_h"), F.lit(SALTS))).withColumnRenamed("__m_s", "_s"), ["__m_k", "__m_h"])
    placed = placed.select(F.struct("__m_k", "_s", "size", "__m_h").alias("__m_pick"), F.col("rank").alias("__m_rank"), F.col("rate").alias("__m_rate"), F.col("offset").alias("__m_offset"))
    # a row travels as one struct, so that no name of a caller's column can clash with ours
    rows = docs.select(F.struct(*[column(n) for n in names]).alias("__m_row"), F.struct(*[c.alias("_s" if k == "__m_s" else k) for k, c in alike.items()]).alias("__m_key"))
    rows = rows.withColumn("__m_no", F.row_number().over(W.partitionBy("__m_key").orderBy(F.xxhash64("__m_row"))) - 1)
    both = rows.join(placed, F.col("__m_key") == F.col("__m_pick"))
    both = both.withColumn("__m_copies", copies_at(F.col("__m_rank") + F.col("__m_no"), F.col("__m_rate"), F.col("__m_offset"))).where("__m_copies > 0")
    return both.withColumn("__m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__m_copies")))).select("__m_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    salt = F.coalesce(F.pmod("doc_id", F.lit(SALTS)), F.char_length("text") % SALTS, F.lit(0)).cast("long")  # rows without an id spread by their text's length
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"), salt.alias("salt"))
    chosen = choose_copies(docs, F.col("salt"))
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, length(text) AS n_chars, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM p),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS a,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER u, 0) AS BIGINT) AS l, CAST(coalesce(sum(3 * source_size) OVER u, 0) AS BIGINT) AS t
  FROM w WINDOW u AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(a - t AS DOUBLE) * weight > CAST(3 * source_size AS DOUBLE) * l AS capped FROM f),
h AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
  CAST(a - CAST(coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS BIGINT) AS DOUBLE) * weight / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS BIGINT) END AS target FROM g),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size, coalesce(((doc_id % 1024) + 1024) % 1024, n_chars % 1024, 0), doc_id NULLS FIRST) - 1 AS DOUBLE) AS k FROM d),
j AS (SELECT r.doc_id, r.size, h.source_size, h.target, r.k, CASE WHEN h.source_size > 0 THEN h.target / h.source_size ELSE 0.0 END AS rate,
  CAST(('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 6)) AS BIGINT) / 16777216.0 AS o
  FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source),
c AS (SELECT *, CAST(least(floor(o + rate * (k + 1)) - floor(o + rate * k), 3) AS BIGINT) AS copies FROM j)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
