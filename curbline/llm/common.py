"""Shared helpers of the training-data operators: folders, tables and fast word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import CLEAN_UP, delete, drop_settled, fresh_path, settle, shared_dir  # noqa: F401

#: Words are maximal runs of anything but these ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle_by(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """Like settle, in buckets by ``key``: later joins on it leave this side where it is. Also gives what drops the table and its entry in
    the catalog. No more buckets are asked for than Spark allows; a bucket then holds several groups, which joins read one after the other."""
    spark = df.sparkSession
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    path = fresh_path(spark, name)
    table_name = path.rsplit("/", 1)[1].replace("-", "_")
    before = spark.conf.get(CLEAN_UP, None)
    try:
        spark.conf.set(CLEAN_UP, "true")
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        delete(spark, path)

    return spark.table(table_name), drop


def n_parts(df: DataFrame, column: str, bytes_each: int) -> int:
    """How many groups to deal ``df`` to so that each holds about ``bytes_each`` bytes of ``column``."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-int(total) // bytes_each))


def crc_mod(column: str, m: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of the words of many texts at once, without a Python object per word.

    A word's hash is the sum of random byte values times powers of an odd base (mod 2^64), mixed.
    Equal words have equal hashes; different words collide with a chance of about 2^-64.
    """

    PIECE = 1 << 20

    def __init__(self, seed: int = 1, lower: bool = False) -> None:
        rng = np.random.default_rng(seed)
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.seps = np.zeros(256, bool)
        self.seps[[32, 9, 10, 11, 12, 13]] = True
        values[self.seps] = 0
        if lower:
            values[65:91] = values[97:123]
        base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1
        self.values, self.base, self.inverse = values, base, pow(base, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.full(n, b, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.up, self.down = powers(self.base), powers(self.inverse)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start offsets of the words in ``data``."""
        buf = np.frombuffer(data, np.uint8)
        hashes, starts, at = [], [], 0
        while at < len(buf):
            end = min(at + self.PIECE, len(buf))
            if end < len(buf):  # cut at a separator, at or after the piece's end
                while end < len(buf) and not self.seps[buf[end]]:
                    end += 1
            part = buf[at:end]
            if len(part) > len(self.up):
                self._grow(len(part))
            sep = self.seps[part]
            first = ~sep
            first[1:] &= sep[:-1]
            s = np.flatnonzero(first)
            if len(s):
                x = self.values[part] * self.up[: len(part)]
                h = np.add.reduceat(x, s) * self.down[s]
                hashes.append(mix64(h))
                starts.append(s + at)
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return np.concatenate(hashes), np.concatenate(starts)

    def texts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts one after the other, and how many each text has; null counts as empty."""
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(d) for d in data], np.int64)
        h, s = self.words(b" ".join(data))
        begin = np.concatenate(([0], np.cumsum(size + 1)))
        return h, np.diff(np.searchsorted(s, begin)).astype(np.int64)


def window_hashes(h: np.ndarray, width: int, seed: int = 3) -> np.ndarray:
    """Hash of each run of ``width`` consecutive entries; entry i covers h[i : i + width]."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62, 1 << 63)) * 2 + 1
    n = len(h)
    acc = np.zeros(n - width + 1, np.uint64)
    b = np.uint64(base)
    # binary doubling: power-of-two windows are joined as the width's bits ask for them
    cur, size, done = h.astype(np.uint64), 1, 0
    with np.errstate(over="ignore"):
        left = width
        while left:
            if left & 1:
                acc = acc * np.uint64(pow(int(b), size, 1 << 64)) + cur[done : done + n - width + 1]
                done += size
            left >>= 1
            if left:
                m = len(cur) - size
                cur = cur[:m] * np.uint64(pow(int(b), size, 1 << 64)) + cur[size : size + m]
                size *= 2
    return mix64(acc)


def slices(pdf, column: str = "text", most: int = 2 << 20):
    """Parts of a pandas batch of at most about ``most`` characters each (one row at least)."""
    start = total = 0
    lengths = [len(t) if isinstance(t, str) else 0 for t in pdf[column]]
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield pdf.iloc[start:i]
            start, total = i, 0
        total += n
    if start < len(pdf):
        yield pdf.iloc[start:]


def arrow_slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch of at most about ``most`` bytes of text each (one row at least).

    Keys stay Arrow columns from end to end, so that longs beside nulls keep all their digits."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def arrow_batch(keys: dict[str, pa.Array], columns: dict[str, tuple]) -> pa.RecordBatch:
    """Key columns as they came, and new ones given as (values, type)."""
    made = {name: pa.array(values, kind, from_pandas=True) for name, (values, kind) in columns.items()}
    return pa.RecordBatch.from_pydict(keys | made)


def ddl(df: DataFrame, names: tuple[str, ...]) -> str:
    """The columns' schema, with any name quoted."""
    return ", ".join(f"`{n.replace('`', '``')}` {df.schema[n].dataType.simpleString()}" for n in names)


def column(name: str):
    return F.col(f"`{name.replace('`', '``')}`")


def texts_of(column) -> list[str]:
    return [t if isinstance(t, str) else "" for t in (column.to_pylist() if isinstance(column, pa.Array) else column)]


class Memo(dict):
    """A dictionary that computes what it lacks. When it reaches ``most`` entries they become the old
    generation, from which entries still in use come back; so at most 2 * most are held."""

    def __init__(self, make, most: int = 200_000) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
