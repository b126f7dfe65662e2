"""Substring dedup with difference-cover anchors.

Words are hashed only at positions whose residue modulo 21 lies in a difference cover. For any two starts
there is a shift below 21 that brings both to covered positions, so two equal runs of 35 words share an
aligned anchor of 15 words inside them. Anchors are dealt by hash to find those that occur twice; then
windows of 35 words are extended around the repeated anchors, and only those are hashed, dealt and counted
again.

A word goes if a window that covers it has a word sequence that also starts anywhere else, in the same
document too; all windows are judged on the input. Texts below 35 words keep all words; null counts as
empty. Repeated rows are other places, so a repeated text of 35 words or more loses all words. Windows are
compared by 64-bit hashes on top of a repeated anchor. Documents are told apart by a hash of key and
text. A hash that a task meets twice among ``FLUSH`` of them is known to repeat there and then: its places go
straight to their documents, and one entry of it goes on to its group. So a hot passage costs its group an
entry for every ``FLUSH`` hashes of the input at most, and groups are sized by the input's bytes; rows are packed
arrays, not a row a word. A text is held whole by its task, however long. Empty tables give no rows. Other
columns pass by untouched, also where their names are those used here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, arrow_batch, column, ddl, mix64, n_parts, settle, slices, table, texts_of, window_hashes

#: Every difference modulo 21 is a difference of two of these.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
WINDOW = 35
GROUP_BYTES = 8 << 20
FLUSH = 1 << 20  # hashes held in a task before rows are sent


def doc_hash(key: str, text: str) -> Column:
    return F.xxhash64(column(key).cast("string"), column(text))


def covered(n: int) -> np.ndarray:
    """Positions below n whose residue is in the cover."""
    at = np.add.outer(np.arange(0, max(0, n), PERIOD), COVER).ravel()
    return at[at < n]


class Dealer:
    """Collects (document, position, hash) and sends packed rows, one per group."""

    def __init__(self, groups: int) -> None:
        self.groups, self.keys, self.parts, self.size = groups, [], [], 0

    def add(self, key: int, at: np.ndarray, h: np.ndarray):
        self.parts.append((len(self.keys), at, h))
        self.keys.append(key)
        self.size += len(h)
        if self.size >= FLUSH:
            yield self.flush()

    def flush(self) -> pd.DataFrame:
        keys = np.array(self.keys, np.int64)
        doc = np.repeat(np.array([p[0] for p in self.parts], np.int32), [len(p[2]) for p in self.parts])
        at = np.concatenate([p[1] for p in self.parts]).astype(np.int32) if self.parts else np.empty(0, np.int32)
        h = np.concatenate([p[2] for p in self.parts]) if self.parts else np.empty(0, np.uint64)
        self.keys, self.parts, self.size = [], [], 0
        group = (h % np.uint64(self.groups)).astype(np.int64)
        order = np.lexsort((h, group))
        group, h, doc, at = group[order], h[order], doc[order], at[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        many = ~new | np.append(~new[1:], False)[: len(h)]  # hashes met more than once
        rows = [(int(b), *x, b"", b"", True) for b, *x in packed(keys[doc[many]], at[many], self.groups)]
        group, h, doc, at, many = group[new], h[new], doc[new], at[new], many[new]
        cut = np.searchsorted(group, np.arange(self.groups + 1))
        for g in np.flatnonzero(np.diff(cut)):
            i = slice(cut[g], cut[g + 1])
            used, local = np.unique(doc[i], return_inverse=True)
            rows.append((int(g), keys[used].tobytes(), local.astype(np.int32).tobytes(), at[i].tobytes(), h[i].tobytes(), many[i].tobytes(), False))
        return pd.DataFrame(rows, columns=["g", "keys", "doc", "at", "h", "many", "found"])


DEALT = "g int, keys binary, doc binary, at binary, h binary, many binary, found boolean"
PACKED = "b int, keys binary, sizes binary, at binary"
FOUND = "k long, at binary"


def packed(key: np.ndarray, at: np.ndarray, buckets: int) -> list[tuple]:
    """Places as one row for each bucket of documents: bucket, keys, places of each, places."""
    bucket = (mix64(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((at, key, bucket))
    key, at, bucket = key[order], at[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cut)):
        keys, sizes = np.unique(key[cut[b] : cut[b + 1]], return_counts=True)
        rows.append((int(b), keys.tobytes(), sizes.astype(np.int32).tobytes(), at[cut[b] : cut[b + 1]].tobytes()))
    return rows


def repeated(groups: int):
    """Places of the hashes that occur twice or more, packed into one row for each bucket of documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known, pdf = pdf[pdf["found"]], pdf[~pdf["found"]]
        rows = list(zip(known["g"], known["keys"], known["doc"], known["at"], strict=True))
        if len(pdf):
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]])
            key = np.concatenate([np.frombuffer(k, np.int64)[np.frombuffer(d, np.int32)] for k, d in zip(pdf["keys"], pdf["doc"], strict=True)])
            at = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["at"]])
            twice = np.concatenate([np.frombuffer(x, bool) for x in pdf["many"]])
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            rows += packed(key[twice], at[twice], groups)
        return pd.DataFrame(rows, columns=["b", "keys", "sizes", "at"])

    return run


def by_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row a document from a bucket's packed rows."""
    key = np.concatenate([np.repeat(np.frombuffer(k, np.int64), np.frombuffer(n, np.int32)) for k, n in zip(pdf["keys"], pdf["sizes"], strict=True)])
    at = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["at"]])
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    keys, first = np.unique(key, return_index=True)
    cut = np.append(first, len(key))
    return pd.DataFrame([(k, at[i:j].tobytes()) for k, i, j in zip(keys, cut[:-1], cut[1:], strict=True)], columns=["k", "at"])


def found_in(dealt: DataFrame, groups: int) -> DataFrame:
    return dealt.groupBy("g").applyInPandas(repeated(groups), PACKED).groupBy("b").applyInPandas(by_document, FOUND)


def places(at, n: int) -> np.ndarray:
    out = np.zeros(n, bool)  # a place may come more than once
    if at is not None:
        out[np.frombuffer(at, np.int32)] = True
    return out


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """k (hash of key and text) and at (packed starts of the repeated windows), for documents that have any."""
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"windows need {PERIOD} words or more")
    rows = docs.select(doc_hash(key, text).alias("k"), column(text).alias("text"))
    groups = n_parts(docs, text, GROUP_BYTES)

    def anchors(batches):
        hasher, dealer = WordHasher(5), Dealer(groups)
        for batch in batches:
            for pdf in slices(batch):
                h, words = hasher.texts(list(pdf["text"]))
                ends = np.cumsum(words)
                for k, b, n in zip(pdf["k"], ends - words, words, strict=True):
                    if n >= window:
                        at = covered(n - anchor + 1)
                        yield from dealer.add(k, at, window_hashes(h[b : b + n], anchor)[at])
        yield dealer.flush()

    found = settle(found_in(rows.mapInPandas(anchors, DEALT), groups), "anchors")

    def extend(batches):
        hasher, dealer = WordHasher(5), Dealer(groups)
        for batch in batches:
            for pdf in slices(batch):
                h, words = hasher.texts(list(pdf["text"]))
                ends = np.cumsum(words)
                for k, b, n, parts in zip(pdf["k"], ends - words, words, pdf["at"], strict=True):
                    hits = np.concatenate(([0], np.cumsum(places(parts, n))))
                    starts = np.arange(n - window + 1)
                    starts = starts[hits[starts + PERIOD] > hits[starts]]
                    if len(starts):
                        yield from dealer.add(k, starts, window_hashes(h[b : b + n], window, 7)[starts])
        yield dealer.flush()

    # equal rows share k: their anchors are one entry, and each row extends it
    both = rows.join(found.hint("merge"), "k")
    return settle(found_in(both.mapInPandas(extend, DEALT), groups), "windows")


def keep_words(text: str, parts, window: int = WINDOW) -> tuple[int, int, bytes]:
    """Words, how many go, and the kept ones joined by a space."""
    words = text.encode().split()
    n = len(words)
    if parts is None:
        return n, 0, b" ".join(words)
    starts = places(parts, n + 1).astype(np.int64)
    edge = starts.copy()
    edge[window:] -= starts[: n + 1 - window]
    gone = np.cumsum(edge)[:n] > 0
    return n, int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def with_windows(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """``row`` (each row of ``docs`` as a struct, so that no name clashes with ours) and ``at`` (its repeated windows, null if none)."""
    rows = docs.select(doc_hash(key, text).alias("k"), F.struct(*[column(c) for c in docs.columns]).alias("row"))
    return rows.join(found.hint("merge"), "k", "left").select("row", "at")


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages removed from the text; texts that lose nothing stay as they are."""
    found = repeated_windows(docs, key, text)

    def run(parts: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else keep_words(t, p)[2].decode() for p, t in zip(parts, texts, strict=True)], dtype=object)

    rewrite = F.pandas_udf(run, "string")
    old = F.col("row").getField(text)
    new = F.when(F.col("at").isNull(), old).otherwise(rewrite("at", old))
    return with_windows(docs, found, key, text).select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_windows(docs)

    def digest(batches):
        for batch in batches:
            got = [keep_words(t, p) for t, p in zip(texts_of(batch["text"]), batch["at"].to_pylist(), strict=True)]
            made = {"n_words": ([g[0] for g in got], pa.int64()), "n_removed": ([g[1] for g in got], pa.int64()), "kept_sha256": ([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())}
            yield arrow_batch({"doc_id": batch["doc_id"]}, made)

    kind = ddl(docs, ("doc_id",))
    return with_windows(docs, found, "doc_id", "text").select("row.doc_id", "row.text", "at").mapInArrow(digest, f"{kind}, n_words long, n_removed long, kept_sha256 string")
