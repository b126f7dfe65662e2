"""Token ids in Arrow files of fixed-size lists: equal-length sequences and masks, read without copying.

Documents are dealt to shards by range of their key, encoded in order, and each shard's id stream is
cut into rows of ``length`` ids (the last one padded, its mask false there) that are written as record
batches of an Arrow IPC file (the stream format plus a footer that gives each batch's place). A second
Arrow file by its side says where each document starts. Any batch, row or document is reached by
its place through a memory map.

Null texts count as empty and have the end id alone. Null keys come first. Rows with the same key are
ordered by a hash of their text, and may be dealt to several shards (equal rows stay in one). A text is
encoded whole, however long. Empty tables give no files. Columns other than key and text are not read.
Every attempt of a task writes files of its own name, and the manifest names those of the attempt that
counted, so a task that is run again neither reads nor replaces another's. Any tokenizer file will do;
one whose white space parts tokens (seen from its settings) is encoded word by word, others by whole texts.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_slices, column, fresh_path, n_parts, settle, table, texts_of

END_ID = 2


class WordEncoder:
    """Ids of whole texts. Where white space separates tokens, a word is encoded once while the memo holds it."""

    MEMO = 450_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and not t.lstrip and not t.rstrip and not t.single_word and t.content.startswith("<|")]
        self.mark = special[0] if special else None
        self.by_word = parts_words(json.loads(self.tokenizer.to_str()))
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def words(text: str) -> list[bytes]:
        """Lower-cased ahead where that can't matter: not if marks could compose with a letter, nor near special tokens."""
        data = text.encode()
        return (data if b"<|" in data or b"\xcc" in data or b"\xcd" in data else data.lower()).split()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word; many go in one call, parted by a special token, which no other text can yield."""
        plain = [w for w in words if b"<|" not in w] if self.mark else []
        out: dict[bytes, bytes] = {}
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            joined = self.tokenizer.encode_batch_fast([self.mark[0].join(w.decode() for w in part)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, self.dtype)
            cut = np.flatnonzero(ids == self.mark[1])
            raw, size = ids.tobytes(), self.dtype.itemsize
            edges = [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)]
            out.update((w, raw[a * size : b * size]) for w, a, b in zip(part, *edges, strict=True))
        rest = [w for w in words if w not in out]
        found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        out.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(rest, found, strict=True))
        return [out[w] for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        words = [self.words(t) for t in texts]
        if len(self.memo) > self.MEMO:
            self.old, self.memo = self.memo, {}
        memo, old, new = self.memo, self.old, []
        for w in set().union(*words):
            if w not in memo:
                if (v := old.get(w)) is None:
                    new.append(w)
                else:
                    memo[w] = v
        memo.update(zip(new, self.encode_words(new), strict=True))
        return [b"".join(map(memo.__getitem__, ws)) for ws in words]


def parts_words(settings: dict) -> bool:
    """Whether a tokenizer lower-cases, turns white space to spaces and drops it before it looks for tokens, so that words
    are encoded alike alone and in a text."""
    steps = (settings.get("normalizer") or {}).get("normalizers", [])
    splits = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    kinds = [x["type"] for x in steps]
    first = splits[0] if splits else {}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern", {}).get("Regex", "").endswith("|[^\\s\\p{L}\\p{N}]+")
    return kinds == ["NFC", "Replace", "Lowercase"] and spaces in steps and drops and not settings.get("truncation") and not settings.get("padding")


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Cuts a stream of ids into fixed-size lists and masks and writes them in batches."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int = 128) -> None:
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids) // self.dtype.itemsize
        self.total += len(ids) // self.dtype.itemsize
        if self.size >= self.rows * self.length:
            self.flush(self.rows * self.length)

    def flush(self, step: int, last: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.held), self.dtype)
        end = len(ids) if last else len(ids) // step * step
        for at in range(0, end, step):
            part = ids[at : min(at + step, end)]
            n = -(-len(part) // self.length) * self.length
            row, mask = np.zeros(n, self.dtype), np.zeros(n, bool)
            row[: len(part)], mask[: len(part)] = part, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (row, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.size = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self.flush(self.rows * self.length, last=True)
        self.writer.close()


class SequenceReader:
    """Random access to a file of sequences; ``source`` may be a memory map, then nothing is copied."""

    def __init__(self, source) -> None:
        self.reader = pa.ipc.open_file(source)
        field = self.reader.schema.field("ids").type
        self.length, self.dtype = field.list_size, np.dtype(field.value_type.to_pandas_dtype())
        self.per_batch = self.reader.get_batch(0).num_rows * self.length if self.reader.num_record_batches else 0

    def batch(self, k: int) -> np.ndarray:
        return self.reader.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        k, r = divmod(row * self.length, self.per_batch)
        mask = self.reader.get_batch(k).column("mask").flatten().slice(r, self.length)
        return self.batch(k)[r : r + self.length], mask.to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the stream."""
        out = []
        while n:
            k, at = divmod(start, self.per_batch)
            part = self.batch(k)[at : at + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, self.dtype)


def write_token_files(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, length: int = 2048, end_id: int = END_ID, shard_bytes: int = 32 << 20) -> DataFrame:
    """Write ``df`` as shards in ``path`` and return the manifest: shard, file, docs, tokens, start (ids in earlier shards)."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        context = TaskContext.get()
        name, keys, sizes, writer, sink = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}", [], [], None, None
        fs, root = _filesystem(path)
        fs.create_dir(root, recursive=True)
        encoder = word_encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            if writer is None and batch.num_rows:
                sink = fs.open_output_stream(f"{root}/{name}.arrow")
                writer = SequenceWriter(sink, encoder.dtype, length)
            for part in arrow_slices(batch, text):
                keys.append(part[key])
                for ids in encoder.encode(texts_of(part[text])):
                    sizes.append(len(ids) // encoder.dtype.itemsize + 1)
                    writer.add(ids + end)
        if writer is None:
            return
        writer.close()
        sink.close()
        n = np.array(sizes, np.int64)
        index = pa.table({"key": pa.chunked_array(keys), "offset": np.cumsum(n) - n, "n_tokens": n})
        with fs.open_output_stream(f"{root}/{name}.index.arrow") as out, pa.ipc.new_file(out, index.schema) as w:
            w.write_table(index)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "file": [name], "docs": [len(n)], "tokens": [writer.total]})

    shards = n_parts(df, text, shard_bytes)
    order = (column(key), F.xxhash64(column(text)))
    dealt = df.select(column(key), column(text)).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    manifest = settle(dealt.mapInArrow(run, "shard int, file string, docs long, tokens long"), "token-manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame, path: str, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Per document, from the files: key, start in the whole stream, n_tokens, ids_crc32 (as 32-bit little-endian ids)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = _filesystem(path)
                name = f"{root}/{row['file']}"
                opened = (lambda p: pa.memory_map(p)) if fs.type_name == "local" else fs.open_input_file
                with opened(f"{name}.index.arrow") as f, opened(f"{name}.arrow") as g:
                    index, reader = pa.ipc.open_file(f).read_all().combine_chunks(), SequenceReader(g)
                    for part in index.to_batches(max_chunksize=10_000):
                        offset, n = part["offset"].to_numpy(), part["n_tokens"].to_numpy()
                        crc = [zlib.crc32(reader.span(int(o), int(k)).astype("<u4").tobytes()) for o, k in zip(offset, n, strict=True)]
                        yield arrow_batch({key: part["key"]}, {"start": (row["start"] + offset, pa.int64()), "n_tokens": (n, pa.int64()), "ids_crc32": (crc, pa.int64())})

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    quoted = key.replace("`", "``")
    return manifest.select("file", "start").repartition(n).mapInArrow(run, f"`{quoted}` {kind}, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), path), path)
