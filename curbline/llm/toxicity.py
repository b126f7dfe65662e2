"""Toxicity by weak supervision.

Voters are words and word beginnings (lexicon), found by how they part toxic from clean labelled rows,
and patterns of spelling (share of capitals, exclamation marks, symbols). Voters that agree beyond the
class (correlated ones) become one voter, which says toxic if any of them does. A generative model of the
votes estimates each voter's rate in both classes by expectation-maximisation over labelled and unlabelled
rows: labels find voters and their correlations, start the estimates and vote as one more voter that is right
97 times in 100. Voters of too little lift are dropped and the model is fitted again. The four settings above
the code were chosen by three folds inside the training rows alone. A logistic regression on voters and patterns is then
trained on the posterior labels of all these rows and scores every text.

Fitting uses about ``max_rows`` labelled rows and ``max_unlabelled`` without a label, chosen by hash (documented
bounds: 20,000 and 10,000; equal rows fall together), and the ``max_voters`` lexicon entries of the highest
gain (ties by name), which is the model's size; scoring covers all rows and whole texts, however long. Null texts count as empty. A
document labelled twice counts as toxic if any label says so; null labels are left out. Without labelled
rows of both kinds, as with empty tables, every score is 0; without a voter, texts score about the share of
toxic labels. Only the key and label columns of ``labels`` and the key and text of ``docs`` are read, so extra columns of any name do no harm in either. Scores take text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, crc_mod, table, texts_of

MAX_ROWS = 20_000
MAX_UNLABELLED = 10_000
MAX_VOTERS = 384
SAME_VOTER = 0.9  # correlation in toxic rows from which voters are one
TRUST = 0.97  # how far labels vote (a half: not at all)
LEAST_LIFT = 25.0  # how much oftener a voter must say toxic of toxic texts than of clean ones
STEMS = (4, 5, 6)
PATTERNS = 4
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def parts_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings (marked by a star), as lexicon entries."""
    w = EDGE.sub("", word)
    if len(w) < 3:
        return ()
    return (w, *(w[:k] + "*" for k in STEMS if len(w) > k))


def pattern_values(text: str, n_words: int) -> tuple[float, ...]:
    """Shares of capitals, exclamation marks, and symbols used to mask letters; text's size."""
    n = max(1, len(text))
    caps = sum(map(str.isupper, text)) / n if not text.islower() else 0.0
    return caps, text.count("!") / n, sum(map(text.count, "*#@$%&")) / n, np.log1p(n_words) / 10


@dataclass
class ToxicityModel:
    lexicon: dict[str, int]  # voter of each entry
    voters: int
    weights: np.ndarray  # of voters, number of voters, patterns, constant

    def rows(self, texts: list[str], hits: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Votes and patterns."""
        votes, patterns = np.zeros((len(texts), self.voters), np.uint8), np.zeros((len(texts), PATTERNS))
        for r, text in enumerate(texts):
            words = text.lower().split()
            votes[r, [v for h in map(hits.__getitem__, words) if h for v in h]] = 1
            patterns[r] = pattern_values(text, len(words))
        return votes, patterns

    def memo(self) -> Memo:
        get = self.lexicon.get
        return Memo(lambda w: tuple(i for p in parts_of(w) if (i := get(p)) is not None), 150_000)


def features(votes: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    return np.column_stack((votes, np.minimum(3, votes.sum(axis=1, dtype=int)), patterns))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 40, count: np.ndarray | None = None) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression; the last weight is the constant."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1).astype(float)
    share = np.full(len(y), 1 / len(y)) if count is None else count / count.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def voter_groups(votes: np.ndarray, count: np.ndarray, least: float = SAME_VOTER) -> np.ndarray:
    """A group for each voter: that of the most correlated earlier first of a group, or a new one."""
    z = (votes - np.average(votes, axis=0, weights=count)) * np.sqrt(count)[:, None]
    size = np.sqrt((z * z).sum(axis=0))
    z /= np.where(size > 0, size, 1)
    group, first = np.zeros(votes.shape[1], int), []
    for v, like in enumerate(z.T @ z):
        if first and like[first].max() >= least:
            group[v] = int(np.argmax(like[first]))
        else:
            group[v] = len(first)
            first.append(v)
    return group


def merge_voters(votes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """One column a group: whether any of its voters says toxic."""
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(group.max(initial=-1) + 1))
    return np.maximum.reduceat(votes[:, order], starts, axis=1) if len(starts) else votes[:, :0]


def vote_rates(votes: np.ndarray, p: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each voter says toxic in either class, given the rows' chances of being toxic."""
    return tuple((votes.T @ (count * q) + 0.5) / ((count * q).sum() + 1) for q in (p, 1 - p))


def label_model(votes: np.ndarray, labels: np.ndarray, trust: float = 0.97, count: np.ndarray | None = None, rounds: int = 100) -> np.ndarray:
    """EM for voters that say toxic (1) or abstain (0), started from labels (NaN: none). With ``trust`` above
    a half, labels vote as well; ``count`` says how often a row occurs.

    Returns posteriors of the rows."""
    count = np.ones(len(votes)) if count is None else count
    given, toxic = ~np.isnan(labels), labels == 1
    group = voter_groups(votes[toxic], count[toxic])
    merged = merge_voters(votes, group).astype(float)
    own = np.where(given, np.where(toxic, 1, -1) * np.log(trust / (1 - trust)), 0.0)
    p, seen = toxic.astype(float), count * given
    for _ in range(rounds):
        prior = np.clip(np.average(p, weights=seen), 1e-3, 1 - 1e-3)
        hit1, hit0 = vote_rates(merged, p, seen)
        on, off = np.log(hit1 / hit0), np.log((1 - hit1) / (1 - hit0))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + off.sum() + merged @ (on - off) + own, -30, 30)))
        done = np.abs(new - p).max() < 1e-5
        p, seen = new, count
        if done:
            break
    return p


def some(rows: DataFrame, columns: tuple[str, ...], most: int) -> DataFrame:
    """About ``most`` rows by hash, or all if there are no more; equal rows fall together."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 62)) < F.lit((most << 62) // n))


def train_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_unlabelled: int = MAX_UNLABELLED, max_voters: int = MAX_VOTERS, unlabelled: DataFrame | None = None) -> ToxicityModel | None:
    """Fit on about ``max_rows`` labelled rows and ``max_unlabelled`` of ``unlabelled`` (``docs`` by default)."""
    spark = docs.sparkSession
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    sample = one.orderBy(F.xxhash64(key), key).limit(max_rows)  # its size is bound by max_rows
    both = some(docs.select(key, text).join(F.broadcast(sample), key), (key, text), max_rows)
    free = docs if unlabelled is None else unlabelled
    bare = some(free.select(key, text).join(F.broadcast(sample), key, "left_anti"), (key, text), max_unlabelled)

    def count(batches):
        toxic, clean = Counter(), Counter()
        for pdf in batches:
            for t, y in zip(texts_of(pdf[text]), pdf["_label"], strict=True):
                (toxic if y else clean).update({p for w in set(t.lower().split()) for p in parts_of(w)})
        names = [*toxic, *clean]
        if names:
            yield pd.DataFrame({"part": names, "toxic": [*toxic.values(), *[0] * len(clean)], "clean": [*[0] * len(toxic), *clean.values()]})

    totals = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return None
    counts = both.mapInPandas(count, "part string, toxic long, clean long").groupBy("part").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    rate1, rate0 = (F.col("t") + 0.5) / (n1 + 1), (F.col("c") + 0.5) / (n0 + 1)
    gain = F.col("t") * F.log(rate1 / rate0)
    least = max(2, n1 // 400)
    kept = counts.where((F.col("t") >= least) & (rate1 / rate0 >= 6)).orderBy(gain.desc(), "part").limit(max_voters)
    lexicon = {r[0]: i for i, r in enumerate(kept.select("part").collect())}
    model = ToxicityModel(lexicon, len(lexicon), np.zeros(0))
    shared = spark.sparkContext.broadcast(model)

    def evidence(batches):
        hits = shared.value.memo()
        for pdf in batches:
            votes, patterns = shared.value.rows(texts_of(pdf[text]), hits)
            yield pd.DataFrame({"y": pdf["_label"].astype(float), "votes": [r.tobytes() for r in votes], "patterns": [r.tobytes() for r in patterns]})

    rows = both.select(text, "_label").unionByName(bare.select(text, F.lit(None).cast("int").alias("_label")))
    got = rows.mapInPandas(evidence, "y double, votes binary, patterns binary").groupBy("y", "votes", "patterns").count().toPandas()  # about max_rows + max_unlabelled rows
    got = got.sort_values(["y", "votes", "patterns"])  # whatever order rows came in, sums run in one order
    y, count = got["y"].to_numpy(float), got["count"].to_numpy(float)
    if len(np.unique(y[~np.isnan(y)])) < 2:  # labels without their documents
        return None
    words = np.frombuffer(b"".join(got["votes"]), np.uint8).reshape(len(got), -1)
    patterns = np.frombuffer(b"".join(got["patterns"])).reshape(len(got), -1)
    return fit_model(list(lexicon), words, patterns, y, count)


def fit_model(entries: list[str], words: np.ndarray, patterns: np.ndarray, y: np.ndarray, count: np.ndarray) -> ToxicityModel:
    """The label model and the classifier from the votes of lexicon entries, patterns and labels (NaN: none) of rows that occur ``count`` times."""
    odd = (patterns[:, :3] > np.quantile(patterns[:, :3], 0.98, axis=0)).astype(np.uint8)
    votes = np.column_stack((words, odd[:, odd.any(axis=0)]))
    group = voter_groups(votes[y == 1], count[y == 1])
    p = label_model(votes, y, TRUST, count)
    hit1, hit0 = vote_rates(merge_voters(votes, group), p, count)
    good = (hit1 / hit0 >= LEAST_LIFT)[group]
    p = label_model(votes[:, good], y, TRUST, count)
    words_good = good[: len(entries)]
    of = np.unique(group[: len(entries)][words_good], return_inverse=True)[1]
    kept = [e for e, g in zip(entries, words_good, strict=True) if g]
    merged = merge_voters(words[:, words_good], of)
    weights = logistic(features(merged, patterns), p, count=count)
    return ToxicityModel(dict(zip(kept, of.tolist(), strict=True)), merged.shape[1], weights)


def toxicity_score(spark: SparkSession, model: ToxicityModel | None, text: Column) -> Column:
    """The score, from 0 to 1, as a column: other columns stay where they are."""
    if model is None:
        return F.when(text.isNull(), 0.0).otherwise(0.0)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        hits = m.memo()
        for texts in batches:
            parts = [1 / (1 + np.exp(-np.clip(features(*m.rows(texts_of(texts.iloc[at : at + 512]), hits)) @ m.weights[:-1] + m.weights[-1], -30, 30))) for at in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return F.pandas_udf(run, "double")(text)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = crc_mod("doc_id", 3) != 1
    model = train_toxicity(docs, labels.where(learn), unlabelled=docs.where(learn))  # held-out texts teach nothing
    scored = docs.select("doc_id", toxicity_score(spark, model, F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
