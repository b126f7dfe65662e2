"""Language identification of mixed texts.

Each language has a model of hashed byte n-grams. A text is a mixture of languages: expectation-
maximisation over its words estimates the proportions, and the set of languages is the one whose
likelihood, less a penalty for each language in it, is highest (languages leave one at a time, the
smallest share first).

Null texts and texts without a letter are ``und`` with score 0. Rows without a language, or held out,
teach nothing; if nothing can be learned every text is ``und``. Repeated rows count as often as they
occur. Equal shares: the first language in code-point order. A text is scored whole; its words' scores take
about 4 bytes a language and byte of text while it is scored, and texts go by slices of 2 MB (or one text).
Empty tables give no rows; columns that are not kept are not read. The model has a fixed number of buckets
for each language (0.5 MB), so what is broadcast is bounded by the number of languages, of which there are
hundreds in the world; counts come from all training texts. A text's set holds ``most`` languages at most: the search starts
from those with the largest shares among all, so that its cost grows with the languages, not with their square.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_slices, column, crc_mod, ddl, slices, table, texts_of

BUCKETS = 1 << 16


def gram_buckets(texts: list[str], orders: tuple[int, ...] = (2, 4)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams that end at each byte, as [orders, bytes]; where words start; words of each text.

    Texts are lower-cased and every word is led by a space, so n-grams see where words begin.
    """
    joined = [" ".join(["", *t.lower().split()]) for t in texts]
    data = [t.encode("utf-8", "replace") for t in joined]
    buf = np.frombuffer(b"".join(data), np.uint8)
    starts = np.flatnonzero(buf == 32)
    begin = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    words = np.diff(np.searchsorted(starts, begin))
    out = np.empty((len(orders), len(buf)), np.int32)
    for k, n in enumerate(orders):
        key = np.full(len(buf), n, np.uint32)
        for back in range(n):
            key *= np.uint32(0x01000193)
            key[back:] ^= buf[: len(buf) - back]
        key *= np.uint32(0x9E3779B1)
        out[k] = key >> np.uint32(16)
    return out, starts, words


class LanguageModel:
    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5) -> None:
        """counts: [orders, buckets, languages]."""
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1]
        self.logp = np.log((counts + smooth) / total).astype(np.float32)

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each word under each language (orders averaged); words of each text."""
        buckets, starts, words = gram_buckets(texts)
        if not len(starts):
            return np.empty((0, len(self.langs)), np.float32), words
        score = self.logp[0][buckets[0]]
        for k in range(1, len(buckets)):
            score += self.logp[k][buckets[k]]
        return np.add.reduceat(score, starts, axis=0) / len(buckets), words

    def proportions(self, score: np.ndarray, words: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the allowed languages in each text, and the log likelihood."""
        text = np.repeat(np.arange(len(words)), words)
        full = words > 0
        starts = np.concatenate(([0], np.cumsum(words)[:-1]))[full]
        top = score.max(axis=1, keepdims=True)
        like = np.exp(np.maximum(score - top, -30))
        share = allowed / allowed.sum(axis=1, keepdims=True)
        total = np.zeros(len(words))
        for last in range(rounds + 1):
            part = like * share[text]
            mass = part.sum(axis=1, keepdims=True)
            if last == rounds:
                total[full] = np.add.reduceat(np.log(np.maximum(mass[:, 0], 1e-30)) + top[:, 0], starts)
                return share, total
            new = np.zeros(share.shape)
            new[full] = np.add.reduceat(part / np.maximum(mass, 1e-30), starts, axis=0)
            share = np.where(full[:, None], new / np.maximum(words, 1)[:, None], share)

    def predict(self, texts: list[str], rounds: int = 5, penalty: float = 3.0, most: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Shares of languages in each text (rows without words: even), by the best penalised set."""
        score, words = self.word_scores(texts)
        n, k = len(texts), len(self.langs)
        allowed = np.ones((n, k))
        share, like = self.proportions(score, words, allowed, rounds)
        if k > most:
            allowed = np.zeros((n, k))
            np.put_along_axis(allowed, np.argsort(-share, axis=1, kind="stable")[:, :most], 1, axis=1)
            k = most
            share, like = self.proportions(score, words, allowed, rounds)
        best, best_share = like - penalty * k * np.log(words + 2), share
        for size in range(k - 1, 0, -1):
            weight = np.where(allowed > 0, share, np.inf)
            allowed = allowed.copy()
            allowed[np.arange(n), weight.argmin(axis=1)] = 0
            share, like = self.proportions(score, words, allowed, rounds)
            value = like - penalty * size * np.log(words + 2)
            better = value > best
            best, best_share = np.where(better, value, best), np.where(better[:, None], share, best_share)
        return best_share, words


def train_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel | None:
    """Count n-grams of all rows of ``docs`` by language."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for pdf in slices(batch.dropna(), text):
                for name, part in pdf.groupby(lang, sort=False):
                    got = gram_buckets(list(part[text]))[0]
                    counts = np.stack([np.bincount(b, minlength=BUCKETS) for b in got])
                    held[name] = held[name] + counts if name in held else counts
        for name, counts in held.items():
            order, bucket = counts.nonzero()
            yield pd.DataFrame({"lang": name, "slot": order * BUCKETS + bucket, "n": counts[order, bucket]})

    parts = docs.select(column(text), column(lang)).mapInPandas(count, "lang string, slot long, n long")
    # at most two times BUCKETS rows for each language come back
    got = parts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    counts = np.zeros((2, BUCKETS, len(langs)))
    slot = got["slot"].to_numpy()
    counts[slot // BUCKETS, slot % BUCKETS, np.searchsorted(langs, got["lang"])] = got["n"]
    return LanguageModel(langs, counts)


def predict_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score (its share) and shares (``lang=share`` of the set found, largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in arrow_slices(batch, text):
                texts = texts_of(part[text])
                letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
                if m is None:
                    letters[:], share = False, np.zeros((len(texts), 1))
                else:
                    share, _ = m.predict(texts)
                top = share.argmax(axis=1)
                yield arrow_batch({k: part[k] for k in keep}, {
                    "lang_pred": ([m.langs[t] if ok else "und" for t, ok in zip(top, letters, strict=True)], pa.string()),
                    "score": (np.where(letters, share[np.arange(len(top)), top], 0.0).clip(0, 1), pa.float64()),
                    "shares": ([";".join(f"{m.langs[i]}={row[i]:.3f}" for i in np.argsort(-row, kind="stable") if row[i] > 0.0005) if ok else "" for row, ok in zip(share, letters, strict=True)], pa.string()),
                })

    return docs.select(*[column(c) for c in dict.fromkeys((*keep, text))]).mapInArrow(run, ", ".join([ddl(docs, keep)] * bool(keep) + ["lang_pred string, score double, shares string"]))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs.where(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(True)) & F.col("lang").isNotNull()))
    found = predict_languages(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "shares")
