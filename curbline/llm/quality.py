"""Quality rules, in DataFrame functions only: counts of junk, repetition, and distance to the language.

The method's verdict compares two histograms of a text with its language's, by Jensen-Shannon distance
(base 2, from 0 to 1): of character classes, and of the language's common words. Texts shorter than a
guard are not judged by that histogram. References are sums over all rows of the language (null counts as
a language of its own).

Null and empty texts have no words and fail the base rule. Lines count as repeats by exact equality.
Repeated rows are judged alike. Of words that are equally common the one of the smaller hash is listed.
Texts are judged whole, however long (3 million equal words take about 30 s). Empty tables give no rows.
Other columns are not read. Work per text stays in the row: nothing is shuffled but the reference counts. A row
of classes and ``COMMON`` words a language is broadcast if there are at most ``FEW_LANGUAGES``; beyond, documents
are joined with their language's row by a shuffle, which Spark splits where a language is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, settle, table

WINDOW = 5
COMMON = 32
FEW_LANGUAGES = 1000
MIN_CHARS, MIN_WORDS = 200, 80
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.72
CLASSES = ("lower", "upper", "digit", "space", "accented", "symbol", "other")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more, from an array of word hashes."""
    starts = F.sequence(F.lit(0), F.size(hashes) - width)
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))

    def covered(w: Column) -> Column:
        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        order = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(order, places)
        count = let(found, lambda p: total(F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))).cast("long"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), count).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(hashes) >= width, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance between two distributions given as arrays of equal length."""
    def side(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: side(a, (a + b) / 2) + side(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def class_counts(text: Column, word_chars: Column, symbols: Column) -> list[Column]:
    n = F.char_length(text)
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    digit = F.char_length(F.regexp_replace(text, "[^0-9]+", ""))
    lower = n - F.char_length(F.regexp_replace(text, "[a-z]+", ""))
    accented = F.char_length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    parts = [lower, upper, digit, n - word_chars, accented, symbols]
    return [c.cast("long") for c in parts]


def shares(counts: Column) -> Column:
    sums = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(sums, lambda s: F.transform(counts, lambda x: F.when(s > 0, x / s).otherwise(0.0)))


def common_words(docs: DataFrame, text: str, lang: str, n: int = COMMON) -> DataFrame:
    """The n most frequent words (lower-cased) of each language, with their counts: lang, h, n."""
    words = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))).alias("w"))
    counts = words.groupBy("_lang", F.xxhash64("w").alias("h")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("_lang").orderBy(F.desc("n"), "h"))  # the limit is pushed below the shuffle
    return counts.withColumn("r", rank).where(F.col("r") <= n).drop("r")


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), t.alias("_t"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"))
    rows = rows.withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select(
        key, "_lang", "_t",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        F.transform("_words", lambda w: F.xxhash64(F.lower(w))).alias("_lowered"),
    )

    # references: one row a language
    base = docs.select(F.col(text).alias("_x"), F.coalesce(F.col(lang), F.lit("")).alias("_lang")).where(F.col("_x").isNotNull())
    base = base.withColumns({"_wc": F.char_length(F.regexp_replace("_x", r"[\x20\x09-\x0D]+", "")), "_sy": F.char_length("_x") - F.char_length(F.translate("_x", "#*$%&|<>", ""))})
    counts = class_counts(F.col("_x"), F.col("_wc"), F.col("_sy"))
    sums = base.select("_lang", F.char_length("_x").alias("_n"), *[c.alias(f"_c{i}") for i, c in enumerate(counts)]).groupBy("_lang").agg(F.array(*[F.sum(f"_c{i}") for i in range(len(counts))]).alias("c"), F.sum("_n").alias("n"))
    classes = sums.select("_lang", F.concat("c", F.array(F.greatest(F.lit(0), F.col("n") - F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)))).alias("_c"))
    listed = common_words(docs, text, lang)
    words = listed.groupBy("_lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("h", "n")))).alias("_w"))  # COMMON entries at most
    every = F.aggregate(F.map_values("_w"), F.lit(0).cast("long"), lambda a, x: a + x)
    ref = settle(classes.join(words, "_lang", "left").select("_lang", shares(F.col("_c")).alias("_class_ref"), F.transform_values("_w", lambda _, n: n / every).alias("_word_ref")), "quality-references")
    few = ref.limit(FEW_LANGUAGES + 1).count() <= FEW_LANGUAGES
    rows = rows.join(F.broadcast(ref) if few else ref.hint("merge"), "_lang", "left")
    names = [r[0] for r in ref.select(F.explode(F.map_keys("_word_ref"))).distinct().collect()] if few else []

    def common(h: Column) -> Column:
        return h.isin(names) if few else F.coalesce(F.map_contains_key("_word_ref", h), F.lit(False))

    hits = F.filter("_lowered", common) if names or not few else F.array().cast("array<bigint>")

    def word_distance(s: Column) -> Column:  # s: sorted hashes of common words
        ends = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(F.get(s, i) != F.get(s, i + 1), F.lit(True)))

        def terms(e: Column) -> Column:
            def one(j: Column, k: Column) -> Column:
                q = F.coalesce(F.element_at("_word_ref", F.get(s, j)), F.lit(0.0))
                return F.struct(((j - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("double")).alias("n"), q.alias("q"))

            return F.filter(F.transform(e, one), lambda x: x["q"] > 0)  # other languages' common words don't count

        def distance(x: Column) -> Column:
            n = F.aggregate(x, F.lit(0.0), lambda a, y: a + y["n"])
            seen = F.aggregate(x, F.lit(0.0), lambda a, y: a + y["q"])

            def js(n: Column) -> Column:
                part = F.aggregate(x, F.lit(0.0), lambda a, y: a + y["n"] / n * F.log2(2 * (y["n"] / n) / (y["n"] / n + y["q"])) + y["q"] * F.log2(2 * y["q"] / (y["n"] / n + y["q"])))
                return F.sqrt(F.greatest((part + 1 - seen) / 2, F.lit(0.0)))

            return F.when(F.size(x) > 0, let(n, js)).otherwise(1.0)

        return F.when(F.size(s) > 0, let(let(ends, terms), distance)).otherwise(1.0)

    parts = class_counts(F.col("_t"), F.col("word_chars"), F.col("n_symbols"))
    n = F.char_length("_t").cast("long")
    rest = F.greatest(n - sum(parts[1:], parts[0]), F.lit(0)).cast("long")
    own = F.array(*parts, rest)
    rows = rows.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("_hashes")).alias("n_repeat_words"),
        F.when((n >= MIN_CHARS) & F.col("_class_ref").isNotNull(), let(own, lambda c: jensen_shannon(shares(c), F.col("_class_ref")))).alias("class_distance"),
        F.when((F.col("n_words") >= MIN_WORDS) & F.col("_class_ref").isNotNull(), let(F.sort_array(hits), word_distance)).alias("word_distance"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = F.coalesce(F.col("class_distance") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE, F.lit(True))
    return rows.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fine).alias("kept"), "class_distance", "word_distance")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))
