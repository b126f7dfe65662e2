"""BPE encoding and decoding with forced boundaries.

A merged token spans the bytes on both sides of each place it was merged at. So two neighbouring bytes that
stand side by side inside no token of the vocabulary are never joined, whatever surrounds them: between them a
cut is certain. A table over all byte pairs, made from the vocabulary alone, cuts each piece of text into
fragments; fragments are merged independently and their ids put one after the other. Where the model marks
the ends of words, a last byte is a symbol of its own, and pairs with it have their own half of the table.

What comes before (normal form, lower case, splitting into pieces, special tokens in the text) is the
tokenizer file's own setting; pieces come from the library that reads the file, except for words of plain
ASCII under the settings that :func:`parts_words` knows, where one regular expression says the same. Where
white space parts pieces, words are memoised; fragments always are. Fragments of more than ``LONG`` symbols
are merged with a heap, so that a text without any cut costs n log n.

Null texts count as empty and have no ids; they decode to the empty text. Texts are encoded whole, in slices of
a few megabytes per task; repeated rows are encoded like any other, and rows of an empty table give none. Nothing is
shuffled. The columns named in ``keep`` stay in Arrow from end to end, so that longs beside nulls keep their digits; others
are not read, so that any further names are allowed. Ids outside the vocabulary are left out when decoding, as the library does.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_slices, column, ddl, table, texts_of
from .token_files import default_tokenizer, parts_words

LONG = 400
SLICE = 1 << 20
NEVER = 1 << 30
#: The pieces of a lower-cased ASCII word under the settings that parts_words() knows.
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\n")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class BatchMemo(dict):
    """Values of many keys at a time; those it lacks are made together. About 2 * ``most`` entries and one batch's are held."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def of(self, keys: set) -> BatchMemo:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        new = []
        for k in keys:
            if k not in self:
                if (v := self.old.get(k)) is None:
                    new.append(k)
                else:
                    self[k] = v
        if new:
            self.update(zip(new, self.make(new), strict=True))
        return self


class ForcedBpe:
    """Encoder and decoder of one tokenizer file."""

    WORDS, PIECES, FRAGMENTS = 200_000, 80_000, 60_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        model = settings["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or (settings.get("truncation") or settings.get("padding")):
            raise ValueError("a byte-level BPE model without dropout, unknown token, prefixes, truncation and padding is needed")
        added = settings.get("added_tokens", [])
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added if t["content"] not in model["vocab"]):
            raise ValueError("special tokens that are normalised, stripped or single words are not known here")
        self.special = {t["content"]: t["id"] for t in added}
        self.mark = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.by_word = parts_words(settings)
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.dtype = np.dtype("<u2" if max(chain(vocab.values(), self.special.values()), default=0) < 1 << 16 else "<u4")
        #: Symbols: bytes within a piece, and from 256 on those at its end.
        self.first = [vocab[c] for c in self.letters] + [vocab[c + self.suffix] for c in self.letters]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank_of = {c: r for r, c in enumerate(codes.tolist())}
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], order
        self.first_ids = np.array(self.first, np.int64)
        self.to_latin = {ord(c): b for c, b in self.byte_of.items()}
        self.joined = self._joined(vocab)
        self.text_of = {i: t for t, i in chain(vocab.items(), self.special.items())}
        decoder = settings.get("decoder") or {}
        if decoder.get("type") not in (None, "ByteLevel"):
            raise ValueError(f"decoder {decoder['type']} is not known here")
        self.bytes_out = decoder.get("type") == "ByteLevel"
        size = max(self.text_of, default=-1) + 1
        self.out: list[bytes] = [self._token_bytes(self.text_of[i]) if i in self.text_of else b"" for i in range(size)]
        self.words = BatchMemo(self._encode_words, self.WORDS)
        self.piece_ids = BatchMemo(self._encode_pieces, self.PIECES)
        self.fragments = BatchMemo(self._merge_all, self.FRAGMENTS)

    def _token_bytes(self, token: str) -> bytes:
        if self.bytes_out and all(c in self.byte_of for c in token):
            return bytes(self.byte_of[c] for c in token)
        return token.encode()

    def _joined(self, vocab: dict[str, int]) -> np.ndarray:
        """[a, b]: whether byte a stands before symbol b inside any token; elsewhere a cut is certain."""
        seen = np.zeros((256, 512), bool)
        for token in vocab:
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            if any(c not in self.byte_of for c in body):
                continue  # not made of bytes: no merge yields it
            raw = [self.byte_of[c] for c in body]
            if ends and raw:
                raw[-1] += 256
            for a, b in zip(raw, raw[1:], strict=False):
                seen[a, b] = True
        return seen

    # pieces of text

    def pieces(self, text: str) -> list[bytes]:
        """Bytes of each piece that the file's own settings make of ``text``."""
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [self._raw(piece) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _raw(self, piece: str) -> bytes:
        return piece.translate(self.to_latin).encode("latin-1")

    def _pieces_of_words(self, words: list[bytes]) -> list[list[bytes]]:
        """Pieces of each word; plain ones go through one expression together, where a line break parts them."""
        out: list[list[bytes]] = [[]] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii()]
        found = ASCII_PIECES.findall(b"\n".join([words[i] for i in plain]).lower())
        at = 0
        for i in plain:
            stop = found.index(b"\n", at) if i != plain[-1] else len(found)
            out[i], at = found[at:stop], stop + 1
        for i, w in enumerate(words):
            if not w.isascii():
                out[i] = self.pieces(w.decode())
        return out

    # fragments

    def cuts(self, pieces: list[bytes]) -> list[list[tuple[bytes, bool]]]:
        """Fragments of each piece, each with whether it ends the piece (where that makes a difference)."""
        data = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        a = np.frombuffer(data, np.uint8)
        b = a.astype(np.int16)
        last = np.zeros(len(a), bool)
        last[ends - 1] = True
        if self.suffix:
            b[last] += 256
        cut = last.copy()
        cut[:-1] |= ~self.joined[a[:-1], b[1:]]
        stops = np.flatnonzero(cut) + 1
        ending = (last[stops - 1] & bool(self.suffix)).tolist()
        counts = np.diff(np.searchsorted(stops, ends, side="right"), prepend=0).tolist()
        stops = stops.tolist()
        flat = iter([(data[i:j], e) for i, j, e in zip([0, *stops[:-1]], stops, ending, strict=True)])
        return [list(islice(flat, n)) for n in counts]

    def symbols(self, fragment: tuple[bytes, bool]) -> list[int]:
        data, ends = fragment
        ids = [self.first[b] for b in data]
        if ends:
            ids[-1] = self.first[256 + data[-1]]
        return ids

    def _merge_all(self, fragments: list[tuple[bytes, bool]]) -> list[bytes]:
        """Ids of each fragment: those of one length class are merged together, a merge of each in a round."""
        out = [b""] * len(fragments)
        classes: dict[int, list[int]] = {}
        for i, (data, _) in enumerate(fragments):
            n = len(data)
            if n > LONG:
                out[i] = np.array(self._merge_long(self.symbols(fragments[i])), self.dtype).tobytes()
            else:
                classes.setdefault(n if n < 12 else 12 << ((n - 1) // 12).bit_length(), []).append(i)
        for members in classes.values():
            for at in range(0, len(members), 8192):
                part = members[at : at + 8192]
                rows = self._merge_rows([fragments[i] for i in part])
                for i, ids in zip(part, rows, strict=True):
                    out[i] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NEVER where no merge joins it (or either is padding)."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], NEVER)

    def _merge_rows(self, fragments: list[tuple[bytes, bool]]) -> list[bytes]:
        sizes = np.array([len(d) for d, _ in fragments])
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        raw = np.zeros((len(sizes), width), np.int64)
        raw[inside] = np.frombuffer(b"".join([d for d, _ in fragments]), np.uint8)
        raw[np.arange(len(sizes)), sizes - 1] += 256 * np.array([e for _, e in fragments])
        ids = np.where(inside, self.first_ids[raw], -1)
        out: list[bytes] = [b""] * len(sizes)
        row = np.arange(len(sizes))
        if not len(self.pair_codes) or width == 1:
            return [ids[i, :n].astype(self.dtype).tobytes() for i, n in enumerate(sizes.tolist())]
        ranks = np.full(ids.shape, NEVER)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            over = best == NEVER
            if over.any():
                for r, x, n in zip(row[over].tolist(), ids[over].astype(self.dtype), (ids[over] >= 0).sum(axis=1).tolist(), strict=True):
                    out[r] = x[:n].tobytes()
                going = ~over
                if not going.any():
                    return out
                row, ids, ranks, at, best = row[going], ids[going], ranks[going], at[going], best[going]
            k = np.arange(len(row))
            ids[k, at] = self.made[best]
            keep = np.ones(ids.shape, bool)  # the right half of each merge goes, and its place with it
            keep[k, at + 1] = False
            ids = np.column_stack((ids[keep].reshape(len(row), -1), np.full(len(row), -1)))
            ranks = np.column_stack((ranks[keep].reshape(len(row), -1), np.full(len(row), NEVER)))
            used = max(1, int((ids >= 0).sum(axis=1).max()))
            ids, ranks = ids[:, : used + 1], ranks[:, : used + 1]
            ranks[k, at] = self._ranks(ids[k, at], ids[k, at + 1])
            left = at > 0
            ranks[k[left], at[left] - 1] = self._ranks(ids[k[left], at[left] - 1], ids[k[left], at[left]])

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank_of.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (q := rank(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    # whole texts

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        parted = self.cuts(pieces)
        ids = self.fragments.of(set(chain.from_iterable(parted)))
        return [b"".join([ids[f] for f in fragments]) for fragments in parted]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        parted = self._pieces_of_words(words)
        ids = self.piece_ids.of(set(chain.from_iterable(parted)))
        return [b"".join([ids[p] for p in pieces]) for pieces in parted]

    def _units(self, text: str) -> list[bytes]:
        """Words or, where white space does not part pieces, the pieces of text that holds no special token."""
        if not self.by_word:
            return self.pieces(text)
        data = text.encode()
        # case goes ahead where no mark could compose with the letter, so that fewer words are told apart
        return (data if b"\xcc" in data or b"\xcd" in data else data.lower()).split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parted: list[list] = []
        for text in texts:
            if not self.mark or not self.mark.search(text):
                parted.append([self._units(text)])
                continue
            parts, at = [], 0
            for m in self.mark.finditer(text):
                parts += [self._units(text[at : m.start()]), np.array([self.special[m[0]]], self.dtype).tobytes()]
                at = m.end()
            parted.append([*parts, self._units(text[at:])])
        memo = self.words if self.by_word else self.piece_ids
        ids = memo.of(set().union(*[p for parts in parted for p in parts if isinstance(p, list)])).__getitem__
        joined = [b"".join([p if isinstance(p, bytes) else b"".join(map(ids, p)) for p in parts]) for parts in parted]
        return [np.frombuffer(x, self.dtype) for x in joined]

    def decode(self, ids: np.ndarray) -> str:
        known = [i for i in ids.tolist() if i in self.text_of] if len(ids) and (ids.max() >= len(self.out)) else ids.tolist()
        if self.bytes_out:
            return b"".join(map(self.out.__getitem__, known)).decode("utf-8", "replace")
        return b" ".join(map(self.out.__getitem__, known)).decode()


@lru_cache(2)
def forced_bpe(path: str) -> ForcedBpe:
    return ForcedBpe(path)


def _packed(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())


def _listed(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)))


def encode_bpe(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None, packed: bool = False, decoded: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``ids`` of each row's text: an array of int, or, if ``packed``, little-endian unsigned 32-bit
    integers; with ``decoded``, also a column of that name with the text that the ids decode to, made in the same task."""
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        bpe = forced_bpe(tokenizer)
        for batch in batches:
            for part in arrow_slices(batch, "__text", SLICE):
                ids = bpe.encode(texts_of(part["__text"]))
                made = {"ids": _packed(ids) if packed else _listed(ids)}
                if decoded:
                    made[decoded] = pa.array(map(bpe.decode, ids), pa.string())
                yield pa.RecordBatch.from_pydict({**{k: part[k] for k in keep}, **made})

    rows = df.select(*[column(k) for k in keep], column(text).alias("__text"))
    fields = [ddl(df, keep), f"ids {'binary' if packed else 'array<int>'}", f"`{decoded}` string" if decoded else ""]
    return rows.mapInArrow(run, ", ".join(filter(None, fields)))


def decode_bpe(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None, out: str = "decoded") -> DataFrame:
    """The ``keep`` columns, which may hold the ids themselves, and the text of ``ids`` (either form that encode_bpe gives; null counts as empty)."""
    tokenizer = tokenizer or default_tokenizer()
    packed = df.schema[ids].dataType.typeName() == "binary"

    def run(batches):
        bpe = forced_bpe(tokenizer)
        for batch in batches:
            for part in arrow_slices(batch, "__ids", SLICE) if packed else [batch.slice(i, 256) for i in range(0, batch.num_rows, 256)]:
                values = part["__ids"].to_pylist()
                texts = [bpe.decode(np.frombuffer(v, "<u4") if packed else np.array([i for i in v if i is not None and i >= 0], np.int64)) if v else "" for v in values]
                yield arrow_batch({k: part[k] for k in keep}, {out: (texts, pa.string())})

    rows = df.select(*[column(k) for k in keep], column(ids).alias("__ids"))
    return rows.mapInArrow(run, ", ".join(filter(None, [ddl(df, keep), f"`{out}` string"])))


def op11_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode_bpe(table(spark, sf_dir, "documents"), packed=True, decoded="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
