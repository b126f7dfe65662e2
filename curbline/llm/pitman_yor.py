"""Language-model scoring with a hierarchical Pitman-Yor bigram model.

Every previous word has a restaurant whose customers are the words that follow it; all of them share the
unigram restaurant as parent, whose base is diffuse, so that each root table is a new word and the root's
remaining mass is the unknown word's.

Gibbs sampling. The state is the number of tables of every dish (word) in every context, which is all that
predictions need of a seating. One sweep draws, each from its exact conditional given the rest,
1. the root's measure, Dirichlet of its customers less the discount (a gamma a word, over their sum);
2. an auxiliary gamma of each context, of shape strength / discount + tables, which unties its dishes;
3. each dish's tables, P(t) ~ S(c, t) a^t with generalised Stirling numbers S, c customers and
   a = discount * gamma * root measure: given 1 and 2 the dishes are independent, so that all of them can be
   drawn at once without any of them seeing its own former tables;
4. the strengths, on a grid, with 1 and 2 integrated out.
Up to ``DIRECT`` customers step 3 inverts the distribution. Beyond, where that would take too long, a few
Metropolis steps leave the same distribution unchanged; they seat the dish anew as a Poisson process of tables.
Discounts are fitted to the counts of counts. The first ``burn`` sweeps are left out; predictive probabilities of the next ``sweeps`` are averaged.

Layout: texts are read once into blocks of bounded size (a vocabulary of word hashes, tokens as places in
it). Blocks send the counts of their distinct pairs and words to groups dealt by hash, which answer in the
order asked with the totals and name one block as each pair's owner. Owners alone hold a pair's seats; in
a sweep they send tables of their words and get back the corpus' totals. At the end owners send the averaged
probability of shared pairs to the blocks that lack it. Hot words and pairs are one entry a block, draws come
from hashes of pair and sweep (a task that is run again draws the same), and nothing but sums over all words
(numbers of words, customers, likelihoods on a grid) reaches the driver. Words and pairs are told apart by 64 bits.

Null texts count as empty: one end token. Repeated rows count and are scored one by one. Tokens are words,
A-Z lower-cased, then an end for each text, which is also the first word's context. A text is never split
between blocks, so a block is larger than ``BLOCK`` if one text is. Empty tables give no rows. Other columns
are not read, whatever their names. Without training rows all words are unknown and share one probability, 1.
Ties don't arise: nothing is ranked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, arrow_slices, column, crc_mod, drop_settled, mix64, n_parts, settle, settle_by, table

BLOCK = 300_000  # tokens
GROUP_BYTES = 6 << 20
BURN, SWEEPS = 1, 3
END = np.uint64(0x5EED0F0E0D0C0B0A)
DIRECT = 256
STRENGTHS = 0.1 * 2.0 ** np.arange(24)  # grid of strengths


# ---------------------------------------------------------------- packed arrays


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Differences of ascending numbers, byte by byte, so that their leading zeros cost nothing."""
    return pack(np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64)[:, 0], dtype=np.uint64)


def pack_counts(a: np.ndarray) -> bytes:
    """Rows of counts, byte by byte, after the number of bytes that the largest one needs."""
    a = np.ascontiguousarray(np.atleast_2d(a).astype(np.uint64))
    width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    planes = a.view(np.uint8).reshape(*a.shape, 8)[:, :, :width].transpose(0, 2, 1)
    return pack(np.concatenate((np.array([width], np.uint8), planes.ravel())))


def pack_shares(p: np.ndarray) -> bytes:
    """Sums of probabilities to a relative precision of 2^-13."""
    return pack(((p.astype(np.float32).view(np.uint32) + np.uint32(1 << 10)) & np.uint32(0xFFFFF800)).view(np.uint8).reshape(-1, 4).T)


def unpack_shares(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(4, -1).T).view(np.float32)[:, 0].astype(float)


def unpack_counts(b: bytes, size: int) -> np.ndarray:
    raw = unpack(b, np.uint8)
    planes = raw[1:].reshape(-1, raw[0], size) if size else np.empty((3, raw[0], 0), np.uint8)
    out = np.zeros((len(planes), size, 8), np.uint8)
    out[:, :, : raw[0]] = planes.transpose(0, 2, 1)
    return out.view(np.int64)[:, :, 0]


# ---------------------------------------------------------------- random numbers by hash


def uniforms(key: np.ndarray, salt: int) -> np.ndarray:
    """One number in (0, 1) for each key and salt."""
    state = mix64(key + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
    return ((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    rising = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    y = x + 7
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - np.log(rising)


def gammas(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variates (rejection from a cubed normal), one for each key and salt."""
    shape = np.asarray(shape, float)
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out, todo, turn = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(todo):
        k, dd = key[todo], d[todo]
        u1, u2, u3 = (uniforms(k, salt * 4096 + 4 * turn + i) for i in range(3))
        x = np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)
        v = (1 + x / np.sqrt(9 * dd)) ** 3
        ok = v > 0
        ok[ok] = np.log(u3[ok]) < 0.5 * x[ok] ** 2 + dd[ok] * (1 - v[ok] + np.log(v[ok]))
        out[todo[ok]] = dd[ok] * v[ok]
        todo, turn = todo[~ok], turn + 1
    low = shape < 1
    out[low] *= uniforms(key[low], salt * 4096 + 4095) ** (1 / shape[low])
    return np.maximum(out, 1e-300)


class Seats:
    """Draws numbers of tables of dishes with c customers: P(t) ~ S(c, t) a^t for discount d."""

    def __init__(self, d: float, direct: int = DIRECT) -> None:
        self.d, self.direct = d, direct
        self.log_s = [np.array([-np.inf]), np.array([-np.inf, 0.0])]  # S(c + 1, t) = S(c, t - 1) + (c - t d) S(c, t)
        for c in range(1, direct):
            last = self.log_s[-1]
            stay = np.append(last[1:] + np.log(c - d * np.arange(1, c + 1)), -np.inf)
            self.log_s.append(np.concatenate(([-np.inf], np.logaddexp(stay, last))))

    def draw(self, c: np.ndarray, a: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
        t = np.minimum(c, 1)
        two = np.flatnonzero(c == 2)
        t[two] += uniforms(key[two], salt) < a[two] / (a[two] + 1 - self.d)
        few = np.flatnonzero((c > 2) & (c <= self.direct))
        few = few[np.argsort(c[few], kind="stable")]
        values, cut = np.unique(c[few], return_index=True)
        for value, begin, end in zip(values.tolist(), cut, [*cut[1:], len(few)]):  # noqa: B905 (no values: nothing to do)
            step = max(1, (1 << 20) // value)
            for b in range(begin, end, step):
                i = few[b : min(b + step, end)]
                w = self.log_s[value][1:] + np.arange(1, value + 1) * np.log(a[i])[:, None]
                w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
                t[i] = 1 + (w < uniforms(key[i], salt)[:, None] * w[:, -1:]).sum(axis=1)
        return t

    def move(self, c: int, a: float, t: int, rest: int, key: int, salt: int) -> tuple[int, int]:
        """The same law for a dish of any size, as Metropolis steps from its t tables.

        ``rest`` is the size of the first customer's table. The other tables are proposed as a Poisson process over
        sizes, tilted so that their customers fit: a gamma mixture of geometric sizes, thinned. Every proposal costs
        time in proportion to its tables, whatever the customers, and memory for ``PART`` of them."""
        d, rng = self.d, np.random.default_rng([key, salt])
        low, high = -700.0, -1e-9  # log(1 - tilt), so that all tables together are expected to hold c customers
        for _ in range(50):
            q = (low + high) / 2
            others, first = math.log(a) + math.log1p(-math.exp(q)) + (d - 1) * q, min(math.exp(-q), c / 2)
            low, high = (q, high) if others > math.log(c - first) else (low, q)
        tilt = math.log1p(-math.exp(low))

        def weight(m: float) -> float:
            return float(log_gamma(m - d) - log_gamma(m) + m * tilt)

        now = weight(rest)
        for _ in range(self.STEPS):
            todo, tables, customers = int(rng.poisson(a / d)), 0, 0.0
            while todo and customers < c:
                n = min(todo, self.PART)
                todo -= n
                with np.errstate(divide="ignore"):
                    sizes = 1 + np.floor(np.log1p(-rng.random(n)) / np.log1p(-rng.beta(d, 1 - d, n)))
                sizes = sizes[np.log1p(-rng.random(n)) < sizes * tilt]
                tables, customers = tables + len(sizes), customers + float(sizes.sum())
            u = rng.random()
            if customers < c and np.log1p(-u) < (new := weight(c - customers)) - now:
                t, rest, now = tables + 1, int(c - customers), new
        return t, rest

    STEPS, PART = 4, 1 << 20


@dataclass(frozen=True)
class Corpus:
    """What all tasks know: training tokens and types, discounts, and of a sweep the strengths and the root's sums."""

    tokens: int
    types: int
    discount: float
    root_discount: float = 0.5
    strength: float = 1.0
    root_strength: float = 1.0
    customers: int = 0
    mass: float = 0.0  # sum of the words' gammas

    def root(self, customers: np.ndarray) -> np.ndarray:
        """The root's predictive probability of words with so many customers (0: unknown)."""
        left = self.root_strength + self.root_discount * self.types
        return np.where(customers > 0, customers - self.root_discount, left) / (self.root_strength + self.customers)

    def predict(self, c, t, context_customers, context_tables, root_customers) -> np.ndarray:
        rest = self.strength + self.discount * context_tables
        return (np.maximum(c - self.discount * t, 0) + rest * self.root(root_customers)) / (self.strength + context_customers)

    def root_gammas(self, customers: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
        out = np.zeros(len(key))
        on = np.flatnonzero(customers > 0)
        out[on] = gammas(customers[on] - self.root_discount, key[on], 2 * sweep)
        return out

    def sweep(self, seats: Seats, c, u, v, pair, words, tables, customers, sweep: int, t, rest) -> tuple[np.ndarray, np.ndarray]:
        """New tables of the pairs (u, v), given the totals of their words after the sweep before.

        t: tables so far; rest: of pairs of more than ``direct`` customers, those at the first one's table."""
        on = np.flatnonzero(c > 1)
        old, t = t, np.minimum(c, 1)
        if len(on):
            dishes, dish = np.unique(v[on], return_inverse=True)
            root = self.root_gammas(customers[dishes], words[dishes], sweep) / self.mass
            contexts, at = np.unique(u[on], return_inverse=True)
            g = gammas(self.strength / self.discount + tables[contexts], words[contexts], 2 * sweep + 1)
            a = np.maximum(self.discount * g[at] * root[dish], 1e-280)
            t[on] = seats.draw(c[on], a, pair[on], 2 * sweep)
            hot = np.flatnonzero(c[on] > seats.direct)
            moved = [seats.move(int(c[i]), float(b), int(old[i]), int(m), int(pair[i]), 2 * sweep) for i, b, m in zip(on[hot], a[hot], rest, strict=True)]
            t[on[hot]], rest = np.array(moved, np.int64).reshape(-1, 2).T
        return t, rest

    def strength_likelihoods(self, tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
        """Log likelihood of contexts' tables and customers for each strength of the grid."""
        d, s = self.discount, STRENGTHS[:, None]
        order = np.lexsort((customers, tables))
        t, c = tables[order].astype(float), customers[order].astype(float)
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
        t, c, n = t[first], c[first], np.diff(np.append(first, len(t)))
        return ((log_gamma(s / d + t) - log_gamma(s / d) + log_gamma(s) - log_gamma(s + c)) * n).sum(axis=1)

    def draw_strengths(self, likelihoods: np.ndarray, sweep: int) -> Corpus:
        """Both strengths from their conditionals on the grid."""
        rng = np.random.default_rng(sweep)
        d = self.root_discount
        root = log_gamma(STRENGTHS / d + self.types) - log_gamma(STRENGTHS / d) + log_gamma(STRENGTHS) - log_gamma(STRENGTHS + self.customers)
        picked = [float(STRENGTHS[np.searchsorted((w := np.exp(x - x.max()).cumsum()) / w[-1], rng.random())]) for x in (likelihoods, root)]
        return replace(self, strength=picked[0], root_strength=picked[1])

    def with_root_mass(self, known: float, sweep: int) -> Corpus:
        rest = np.random.default_rng(10_000 + sweep).gamma(self.root_strength + self.root_discount * self.types)
        return replace(self, mass=known + rest)


# ---------------------------------------------------------------- blocks


def read_blocks(docs: DataFrame) -> DataFrame:
    """docs: key, text, held. One row a block: block, vocab, tokens, keys, sizes, held."""

    def run(batches):
        hasher = WordHasher(31, lower=True)
        task, number = TaskContext.get().partitionId(), 0
        parts, keys, sizes, held, total = [], [], [], [], 0

        def emit():
            nonlocal parts, keys, sizes, held, total, number
            vocab, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            number += 1
            row = {
                "block": pa.array([(task << 32) + number], pa.int64()), "vocab": [pack_sorted(vocab)], "tokens": [pack_counts(tokens)],
                "keys": pa.ListArray.from_arrays([0, len(sizes)], pa.concat_arrays(keys)), "sizes": [pack(np.array(sizes, np.uint64))], "held": [pack(np.array(held, bool))],
            }
            parts, keys, sizes, held, total = [], [], [], [], 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part in arrow_slices(batch):
                h, words = hasher.texts(part["text"].to_pylist())
                parts.append(np.insert(h, np.cumsum(words), END))
                keys.append(part["key"])
                sizes += (words + 1).tolist()
                held += part["held"].to_pylist()
                total += len(h) + len(words)
                if total >= BLOCK:
                    yield emit()
        if keys:
            yield emit()

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"block long, vocab binary, tokens binary, keys array<{kind}>, sizes binary, held binary")


@dataclass
class Block:
    vocab: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    held: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Block:
        sizes = unpack(row["sizes"], np.int64)
        return cls(unpack_sorted(row["vocab"]), unpack_counts(row["tokens"], int(sizes.sum()))[0], sizes, unpack(row["held"], bool))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pair codes (context * words + word) and each token's place among them."""
        before = np.empty_like(self.tokens)
        before[0], before[1:] = np.searchsorted(self.vocab, END), self.tokens[:-1]
        return np.unique(before * len(self.vocab) + self.tokens, return_inverse=True)

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


def pair_hash(words: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix64(words[u] * np.uint64(0x9E3779B97F4A7C15) + words[v])


def word_key(words: np.ndarray) -> np.ndarray:
    """Words as keys beside pairs."""
    return mix64(words ^ np.uint64(0x3C6EF372FE94F82B))


def deal(h: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by hash, in which groups follow one another, and where the groups begin."""
    order = np.argsort(h)
    group = ((h[order] >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    return order, np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))


def ask(h: np.ndarray, columns: list[np.ndarray] | None, groups: int) -> list[tuple[int, int, bytes, bytes | None]]:
    """Rows g, size, h, n for the groups that these hashes go to."""
    order, cut = deal(h, groups)
    out = []
    for g in np.flatnonzero(np.diff(cut)):
        i = order[cut[g] : cut[g + 1]]
        out.append((int(g), len(i), pack_sorted(h[i]), None if columns is None else pack_counts(np.stack([c[i] for c in columns]))))
    return out


ASKED = "block long, g int, size int, h binary, n binary"
ANSWER = "block long, g int, n binary"


def sent(block: int, asks: list[tuple], extra: dict | None = None) -> pa.RecordBatch:
    g, size, h, n = zip(*asks, strict=True) if asks else ((),) * 4
    row = {"block": pa.array([block] * len(g), pa.int64()), "g": pa.array(g, pa.int32()), "size": pa.array(size, pa.int32()), "h": pa.array(h, pa.binary()), "n": pa.array(n, pa.binary())}
    return pa.RecordBatch.from_pydict(row | {k: pa.array([v] * len(g), pa.bool_()) for k, v in (extra or {}).items()})


def sums(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A group's keys, their sums, and of each entry sent whether it is its key's first and which key it is; and where rows begin."""
    size = pdf["size"].tolist()
    h = np.concatenate([unpack_sorted(x) for x in pdf["h"]])
    n = np.concatenate([unpack_counts(x, s) for x, s in zip(pdf["n"], size, strict=True)], axis=1)
    keys, first, at = np.unique(h, return_index=True, return_inverse=True)
    total = np.stack([np.bincount(at, c, len(keys)).astype(np.int64) for c in n])
    return keys, total, first, at, np.concatenate(([0], np.cumsum(size)))


def answers_of(pdf: pd.DataFrame, cut: np.ndarray, out: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame([(b, g, pack_counts(out[:, i:j])) for b, g, i, j in zip(pdf["block"], pdf["g"], cut[:-1], cut[1:], strict=True)], columns=["block", "g", "n"])


def answered(h: np.ndarray, groups: int, answers: list[dict], rows: int) -> np.ndarray:
    """A block's answers in the order of its hashes."""
    order, cut = deal(h, groups)
    out = np.zeros((rows, len(h)), np.int64)
    for x in answers:
        i = order[cut[x["g"]] : cut[x["g"] + 1]]
        out[:, i] = unpack_counts(x["n"], len(i))
    return out


def rows_of(batch: pa.RecordBatch):
    """Each row (a block) by itself, as it came and as Python values."""
    for i in range(batch.num_rows):
        part = batch.slice(i, 1)
        yield part, part.to_pylist()[0]


def by_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("g", "n")).alias(name))


ALONE, SHARED = 1, 2  # a block's own pairs, by whether other blocks hold them too; 0: not its own
PAIRS = "block long, words binary, codes binary, counts binary, shared binary"
SEATS = "block long, tables binary, rest binary, total binary"


def own_pairs(block: Block, answers: list[dict], groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pair codes, each token's place among them, their counts and flags; and the words' counts and flags."""
    codes, place = block.pairs()
    n = len(block.vocab)
    total, flag = answered(np.concatenate((pair_hash(block.vocab, codes // n, codes % n), word_key(block.vocab))), groups, answers, 2)
    k = len(codes)
    return codes, place, total[:k], flag[:k], total[k:], flag[k:]


def score_language_model(docs: DataFrame, held: F.Column, key: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, burn: int = BURN) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of whole texts)."""
    kind = docs.schema[key].dataType.simpleString()
    groups = n_parts(docs, text, GROUP_BYTES)
    blocks, drop_blocks = settle_by(read_blocks(docs.select(column(key).alias("key"), column(text).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))), "lm-blocks", "block", groups)

    def ask_counts(batches):
        for batch in batches:
            for _, row in rows_of(batch):
                block = Block.of(row)
                codes, place = block.pairs()
                n, train = len(block.vocab), block.trained()
                h = np.concatenate((pair_hash(block.vocab, codes // n, codes % n), word_key(block.vocab)))
                counts = np.concatenate((np.bincount(place[train], minlength=len(codes)), np.bincount(block.tokens[train], minlength=n)))
                yield sent(row["block"], ask(h, [counts], groups))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, total, first, at, cut = sums(pdf)
        owner = np.zeros(len(at), np.int64)
        owner[first] = np.where(np.bincount(at, minlength=len(keys)) > 1, SHARED, ALONE)
        return answers_of(pdf, cut, np.stack((total[0][at], owner)))

    texts = blocks.drop("keys")
    counted = settle(texts.mapInArrow(ask_counts, ASKED).groupBy("g").applyInPandas(count, ANSWER), "lm-counts")
    known = texts.join(by_block(counted, "answers"), "block")

    def own_of(batches):
        for batch in batches:
            for part, row in rows_of(batch):
                block = Block.of(row)
                codes, _, c, flag, seen, mine = own_pairs(block, row["answers"], groups)
                n, own = len(block.vocab), flag > 0
                c, codes = c[own], codes[own]
                used = np.unique(np.concatenate((codes // n, codes % n)))
                place = np.zeros(n, np.int64)
                place[used] = np.arange(len(used))
                u, v = place[codes // n], place[codes % n]
                sums_of = {"types": [int((seen[mine > 0] > 0).sum())], "trained": [int(seen[mine > 0].sum())], "once": [int((c == 1).sum())], "twice": [int((c == 2).sum())]}
                mixed = {"words": [pack_sorted(block.vocab[used])], "codes": [pack_sorted((u * len(used) + v).astype(np.uint64))], "counts": [pack_counts(c)], "shared": [pack(flag[own] == SHARED)]}
                yield pa.RecordBatch.from_pydict({"block": part["block"]} | mixed | {"own": [pack(own)], "seen": [pack_counts(seen)]} | sums_of)

    pairs, drop_pairs = settle_by(known.mapInArrow(own_of, PAIRS + ", own binary, seen binary, types long, trained long, once long, twice long"), "lm-pairs", "block", groups)
    drop_settled(counted)
    types, tokens, once, twice = (x or 0 for x in pairs.agg(*[F.sum(c) for c in ("types", "trained", "once", "twice")]).first())
    corpus = Corpus(tokens, types, min(0.95, max(0.1, once / max(1, once + 2 * twice))))

    own = pairs.select("block", "words", "codes", "counts")
    seats: DataFrame | None = None  # at first every dish has one table
    for sweep in range(burn + sweeps + 1):
        last = sweep == burn + sweeps
        state = own.withColumns({c: F.lit(None).cast("binary") for c in ("tables", "rest", "total")}) if seats is None else own.join(seats, "block")
        asked = state.select("block", "words", "codes", "counts", "tables").mapInArrow(ask_words(groups), ASKED)
        told = settle(asked.groupBy("g").applyInPandas(word_totals(corpus, sweep), ANSWER + ", customers long, once long, twice long, mass double, contexts array<double>"), "lm-words")
        got = told.agg(*[F.sum(x) for x in ("customers", "once", "twice", "mass")], *[F.sum(F.get("contexts", F.lit(i))) for i in range(len(STRENGTHS))]).first()
        customers, once, twice, mass, *likelihoods = (x or 0 for x in got)
        corpus = replace(corpus, customers=customers).draw_strengths(np.array(likelihoods, float), sweep).with_root_mass(mass, sweep + 1)
        after = settle(state.join(by_block(told, "answers"), "block", "left").mapInArrow(next_seats(corpus, sweep, burn, last, groups), SEATS), "lm-seats")
        drop_settled(told, *[seats] * (seats is not None))
        if sweep == 0:  # the root's discount, from how many words have one and two contexts
            corpus = replace(corpus, root_discount=min(0.95, max(0.1, once / max(1, once + 2 * twice))))
        seats = after

    def send(batches):
        for batch in batches:
            for _, row in rows_of(batch):
                words, u, v, shared = *pairs_of(row), unpack(row["shared"], bool)
                u, v = u[shared], v[shared]
                p = (unpack_shares(row["total"])[shared] / sweeps).astype(np.float32).view(np.uint32)
                yield sent(row["block"], ask(pair_hash(words, u, v), [p], groups), {"asks": False})

    def want(batches):
        for batch in batches:
            for _, row in rows_of(batch):
                block = Block.of(row)
                codes, n = block.pairs()[0][~unpack(row["own"], bool)], len(block.vocab)
                yield sent(row["block"], ask(pair_hash(block.vocab, codes // n, codes % n), None, groups), {"asks": True})

    def give(pdf: pd.DataFrame) -> pd.DataFrame:
        told, asking = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        if not len(asking):
            return pd.DataFrame([], columns=["block", "g", "n"])
        h = np.concatenate([unpack_sorted(x) for x in told["h"]])
        p = np.concatenate([unpack_counts(x, s)[0] for x, s in zip(told["n"], told["size"], strict=True)])
        order = np.argsort(h)
        h, p = h[order], p[order]
        return pd.DataFrame([(b, g, pack_counts(p[np.searchsorted(h, unpack_sorted(x))])) for b, g, x in zip(asking["block"], asking["g"], asking["h"], strict=True)], columns=["block", "g", "n"])

    told = pairs.select("block", "words", "codes", "shared").join(seats.select("block", "total"), "block").mapInArrow(send, ASKED + ", asks boolean")
    wanted = texts.join(pairs.select("block", "own"), "block").mapInArrow(want, ASKED + ", asks boolean")
    given = settle(told.unionAll(wanted).groupBy("g").applyInPandas(give, ANSWER), "lm-given")

    def finish(batches):
        for batch in batches:
            for part, row in rows_of(batch):
                block = Block.of(row)
                codes, place = block.pairs()
                n, own = len(block.vocab), unpack(row["own"], bool)
                other = codes[~own]
                p = np.zeros(len(codes))
                p[own] = unpack_shares(row["total"]) / sweeps
                p[~own] = answered(pair_hash(block.vocab, other // n, other % n), groups, row["given"] or [], 1)[0].astype(np.uint32).view(np.float32)
                seen = unpack_counts(row["seen"], n)[0][block.tokens]
                base = np.log10((seen + 1) / (corpus.tokens + corpus.types + 1))
                starts = np.concatenate(([0], np.cumsum(block.sizes)[:-1]))
                yield pa.RecordBatch.from_pydict({
                    key: part["keys"].flatten(), "held_out": block.held, "n_tokens": block.sizes, "n_known": np.add.reduceat((seen > 0).astype(np.int64), starts),
                    "train_tokens": np.full(len(starts), corpus.tokens), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p)[place], starts),
                })

    parts = blocks.join(pairs.select("block", "own", "seen"), "block").join(seats.select("block", "total"), "block").join(by_block(given, "given"), "block", "left")
    scores = settle(parts.mapInArrow(finish, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores")
    drop_settled(seats, given)
    drop_blocks()
    drop_pairs()
    return scores


# ---------------------------------------------------------------- sweeps


def pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, codes = unpack_sorted(row["words"]), unpack_sorted(row["codes"]).astype(np.int64)
    return words, codes // max(1, len(words)), codes % max(1, len(words))


def ask_words(groups: int):
    """What owners know of their words: count, tables as a context, tables as a dish."""

    def run(batches):
        for batch in batches:
            for _, row in rows_of(batch):
                words, u, v = pairs_of(row)
                c = unpack_counts(row["counts"], len(u))[0]
                t = np.minimum(c, 1) if row["tables"] is None else unpack_counts(row["tables"], len(u))[0]
                yield sent(row["block"], ask(words, [np.bincount(i, w, len(words)).astype(np.int64) for i, w in ((v, c), (u, t), (v, t))], groups))

    return run


def word_totals(corpus: Corpus, sweep: int):
    """Of each word count (also its customers as a context: every token is followed by one), tables as a context, and
    customers of the root; on a group's first row sums over its words, of gammas for the coming sweep as well."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, total, _, at, cut = sums(pdf)
        n, tables, customers = total
        out = answers_of(pdf, cut, total[:, at])
        on = n > 0
        rest = len(out) - 1
        out["customers"], out["once"], out["twice"] = [int(customers.sum())] + [0] * rest, [int((customers == 1).sum())] + [0] * rest, [int((customers == 2).sum())] + [0] * rest
        out["mass"] = [float(corpus.root_gammas(customers, keys, sweep + 1).sum())] + [0.0] * rest
        out["contexts"] = [corpus.strength_likelihoods(tables[on], n[on]).tolist() if on.any() else None] + [None] * rest
        return out

    return run


def next_seats(corpus: Corpus, sweep: int, burn: int, last: bool, groups: int):
    """Add the sweep's predictive probabilities (after ``burn``) and draw the tables of the next one."""

    def run(batches):
        seats = Seats(corpus.discount)
        for batch in batches:
            for part, row in rows_of(batch):
                words, u, v = pairs_of(row)
                c = unpack_counts(row["counts"], len(u))[0]
                hot = c[c > DIRECT]
                t, rest, total = np.minimum(c, 1), hot, np.zeros(0)
                if row["tables"] is not None:
                    t, rest, total = unpack_counts(row["tables"], len(u))[0], unpack_counts(row["rest"], len(hot))[0], unpack_shares(row["total"])
                n, tables, customers = answered(words, groups, row["answers"] or [], 3)
                if sweep > burn:
                    p = corpus.predict(c, t, n[u], tables[u], customers[v])
                    total = p + total if len(total) else p
                if not last:
                    t, rest = corpus.sweep(seats, c, u, v, pair_hash(words, u, v), words, tables, customers, sweep + 1, t, rest)
                yield pa.RecordBatch.from_pydict({"block": part["block"], "tables": [pack_counts(t)], "rest": [pack_counts(rest)], "total": [pack_shares(total)]})

    return run


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language_model(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
