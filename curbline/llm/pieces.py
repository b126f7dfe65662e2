"""SentencePiece encoding with the N best segmentations, and decoding.

The N best paths of the piece lattice come from backward A* search whose heuristic is the forward
Viterbi score, which is exact, so paths leave the queue in order of score. No piece crosses from a
non-space to a space mark (checked when the model is loaded), so a text's lattice is a chain of word
lattices: each word's Viterbi result is kept in a bounded memo, and only the words with the smallest
gap between first and second path can take part in a text's N best, so A* runs on those alone.

Null texts count as empty: no pieces, score 0, one (empty) segmentation. Repeated rows give repeated
results. Equal scores: the path found first, in an order fixed by the lattice. Long texts are encoded whole;
a word's cost grows with its length times the longest piece's, and memory with the characters of a part
(``PART``, one word at least). Empty tables give no rows. Columns that are neither kept nor the text aren't
read; kept columns pass as they came. Work is per row: no shuffle, and a task holds one slice and the memo.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_batch, arrow_slices, column, ddl, table, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # below the lowest score of a piece, as is usual
UNUSED = -1e8  # pieces scored lower than this are only marked as unusual: they get the lowest score


class Paths(NamedTuple):
    """Paths of many words, one after the other: all ids, how many each has, its score, and how much less its word's
    second path scores (infinite: there is none)."""

    ids: np.ndarray
    lengths: np.ndarray
    score: np.ndarray
    gap: np.ndarray

    @classmethod
    def none(cls) -> Paths:
        return cls(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0), np.empty(0))

    @classmethod
    def joined(cls, parts: list[Paths]) -> Paths:
        return cls(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def take(self, rows: np.ndarray) -> Paths:
        lengths = self.lengths[rows]
        ends = np.cumsum(lengths)
        first = (np.cumsum(self.lengths) - self.lengths)[rows]
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)
        return Paths(self.ids[at], lengths, self.score[rows], self.gap[rows])


class Encoded(NamedTuple):
    """A text's best ids, and of each of its n best paths: score, differences (place, ids that go, ids that come), checksum
    of its ids, and whether decoding it gives the text."""

    ids: np.ndarray
    scores: list[float]
    changes: list[list[tuple[int, int, tuple[int, ...]]]]
    sums: list[int]
    trips: list[bool]


class PieceModel:
    """Pieces and scores of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece_id = {names[i]: i for i in usable}
        self.score = [sp.get_score(i) for i in range(n)]
        self.low = min((s for i in usable if (s := self.score[i]) > UNUSED), default=0.0) - UNKNOWN_PENALTY
        self.score = [max(s, self.low) for s in self.score]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes = [bytes((int(names[i][3:5], 16),)) if sp.is_byte(i) else b"" if sp.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.unk = sp.unk_id()
        self.prefixes = {p[:k] for p in self.piece_id for k in range(1, len(p) + 1)}
        letters = set().union(*self.piece_id) if self.piece_id else set()
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in letters)
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.piece_id)
        self.chunks = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + f"|[{alone}]" * bool(alone)).findall
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.paths = self.old_paths = Paths.none()
        self.lists: dict = {}
        self.build()

    def edges(self, text: str) -> list[list[tuple[int, float, object]]]:
        """Of each end: (start, score, id or character without a piece)."""
        n, ids, score, prefixes = len(text), self.piece_id, self.score, self.prefixes
        into: list = [[] for _ in range(n + 1)]
        for s in range(n):
            single = False
            for e in range(s + 1, n + 1):
                part = text[s:e]
                if part not in prefixes:
                    break
                if (i := ids.get(part)) is not None:
                    into[e].append((s, score[i], i))
                    single |= e == s + 1
            if not single:
                into[s + 1].append((s, self.low, text[s]))
        return into

    def forward(self, into: list) -> tuple[list[float], list]:
        best, back = [0.0], [None]
        for e in range(1, len(into)):
            top = max(into[e], key=lambda x: best[x[0]] + x[1])
            best.append(best[top[0]] + top[1])
            back.append(top)
        return best, back

    def spell(self, path) -> tuple[int, ...]:
        """Ids of a path; characters without a piece become bytes."""
        out: list[int] = []
        for x in path:
            if isinstance(x, int):
                out.append(x)
            elif self.byte_id:
                out += [self.byte_id[b] for b in x.encode()]
            else:
                out.append(self.unk)
        return tuple(out)

    def best(self, words: list[str]) -> Paths:
        """Best path, its score and the gap to the second of each word."""
        parts, order = [], []
        words = sorted(enumerate(words), key=lambda x: len(x[1]))
        at, held = 0, 0
        for k, (_, w) in enumerate(words):  # parts of bounded size, of words about as long as each other
            held += len(w)
            if held >= self.PART or k == len(words) - 1:
                part = words[at : k + 1]
                parts.append(self.viterbi([w for _, w in part]))
                order += [i for i, _ in part]
                at, held = k + 1, 0
        return Paths.joined(parts).take(np.argsort(order)) if parts else Paths.none()

    PART = 1 << 19  # characters

    def viterbi(self, words: list[str]) -> Paths:
        """Forward and backward Viterbi over many words (in order of length) at once.

        Edges of all words are found by their length, then grouped by the place where they end: a step takes
        the words' best edge into their e-th characters."""
        m, sizes = len(words), np.array([len(w) for w in words])
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes, n = chars.astype(np.uint64) + np.uint64(1), len(chars)
        word = np.repeat(np.arange(m), sizes)
        node0 = np.cumsum(sizes + 1) - (sizes + 1)  # a word has a node before, between and after its characters
        node = np.arange(n) + word
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # characters from here to the word's end
        begins, lengths, weights, ids = [], [], [], []
        live, key = np.arange(n), np.zeros(n, np.uint64)
        for k in range(1, self.longest + 1):
            fits = left[live] >= k
            live, key = live[fits], key[fits]
            if not len(live):
                break
            key = key * self.BASE + codes[live + (k - 1)]
            i, prefix = self.find(key)
            whole = i >= 0
            if k == 1 and not whole.all():
                alone = live[~whole]
                begins.append(alone)
                lengths.append(np.full(len(alone), 1))
                weights.append(np.full(len(alone), self.low))
                ids.append(-2 - chars[alone].astype(np.int64))
            on = live[whole]
            begins.append(on)
            lengths.append(np.full(len(on), k))
            weights.append(self.scores[i[whole]])
            ids.append(i[whole].astype(np.int64))
            live, key = live[prefix], key[prefix]
        begin, length, weight, piece = (np.concatenate(x) for x in (begins, lengths, weights, ids))
        start = node[begin]
        end = start + length
        level = end - node0[word[begin]]  # the place in the word where an edge ends
        order = np.lexsort((end, level))
        start, end, weight, piece, level = start[order], end[order], weight[order], piece[order], level[order]
        cut = np.searchsorted(level, np.arange(1, int(sizes[-1]) + 2))
        first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))  # edges of an end follow one another
        first_cut = np.searchsorted(first, cut)
        total_nodes = n + m
        fwd, chosen = np.zeros(total_nodes), np.full(total_nodes, -1)
        for a, b, fa, fb in zip(cut[:-1], cut[1:], first_cut[:-1], first_cut[1:], strict=True):
            score = fwd[start[a:b]] + weight[a:b]
            into = first[fa:fb] - a
            best = np.maximum.reduceat(score, into)
            nodes = end[a:b][into]
            fwd[nodes] = best
            hit = np.flatnonzero(score == np.repeat(best, np.diff(np.append(into, b - a))))
            chosen[end[a:b][hit]] = hit + a  # of equal ones the last, which is the longest
        last = node0 + sizes
        on = np.zeros(len(start), bool)
        at, steps = last.copy(), []
        while True:  # walk all best paths back together
            go = np.flatnonzero(at > node0)
            if not len(go):
                break
            e = chosen[at[go]]
            on[e] = True
            steps.append((go, e))
            at[go] = start[e]
        rows, edges = np.concatenate([g for g, _ in steps]), np.concatenate([e for _, e in steps])
        order = np.lexsort((start[edges], rows))
        rows, found = rows[order], piece[edges[order]]
        # backward scores, from the words' ends; the second path is the best one over an edge off the best path
        bwd, second = np.full(total_nodes, -1e300), np.full(m, -1e300)
        bwd[last] = 0
        by_start = np.argsort(start, kind="stable")
        where = start - node0[np.searchsorted(node0, start, side="right") - 1]
        by_start = by_start[np.argsort(-where[by_start], kind="stable")]
        s2, e2, w2 = start[by_start], end[by_start], weight[by_start]
        cut = np.searchsorted(-where[by_start], np.arange(-int(where.max()), 2))
        first = np.flatnonzero(np.append(True, s2[1:] != s2[:-1]))
        first_cut = np.searchsorted(first, cut)
        for a, b, fa, fb in zip(cut[:-1], cut[1:], first_cut[:-1], first_cut[1:], strict=True):
            if a < b:
                into = first[fa:fb] - a
                bwd[s2[a:b][into]] = np.maximum.reduceat(bwd[e2[a:b]] + w2[a:b], into)
        through = np.where(on, -1e300, fwd[start] + weight + bwd[end])
        np.maximum.at(second, np.searchsorted(node0, start, side="right") - 1, through)
        best = fwd[last]
        gap = np.where(second > -1e299, best - second, np.inf)
        lengths = np.bincount(rows, minlength=m)
        if len(odd := np.unique(rows[found < 0])):  # characters without a piece become bytes
            odd_set = set(odd.tolist())
            ends = np.cumsum(lengths)
            spelled = [np.array(self.spell([x if x >= 0 else chr(-2 - x) for x in found[e - k : e].tolist()]), np.int64) if r in odd_set else found[e - k : e] for r, (e, k) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True))]
            found, lengths = np.concatenate(spelled), np.array([len(x) for x in spelled])
        return Paths(found.astype(np.int32), lengths, best, gap)

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def build(self) -> None:
        """Tables that find a piece, or the start of one, by the hash of its characters: each level holds what collided before."""
        todo: dict[int, tuple[int, int]] = {}
        for p in self.prefixes:
            key = 0
            for c in p:
                key = (key * int(self.BASE) + ord(c) + 1) & (1 << 64) - 1
            if key in todo:
                raise ValueError("two pieces hash alike")
            todo[key] = (self.piece_id.get(p, -1), 1)
        self.longest, self.levels, bits = max(map(len, self.piece_id), default=1), [], 18
        self.scores = np.array(self.score)
        while todo:
            keys, ids, rest = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), {}
            for key, x in todo.items():
                slot = self.slot(key, bits)
                if keys[slot]:
                    rest[key] = x
                else:
                    keys[slot], ids[slot] = key, x[0]
            self.levels.append((bits, keys, ids))
            todo, bits = rest, max(10, bits - 3)

    @staticmethod
    def slot(key: int, bits: int) -> int:
        return ((key * (0xBF58476D1CE4E5B9 + 2 * bits)) & (1 << 64) - 1) >> (64 - bits)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none), and whether any piece starts so."""
        ids, known = np.full(len(key), -1, np.int32), np.zeros(len(key), bool)
        todo = None
        for bits, keys, table in self.levels:
            k = key if todo is None else key[todo]
            slot = (k * np.uint64(0xBF58476D1CE4E5B9 + 2 * bits)) >> np.uint64(64 - bits)
            hit = keys[slot] == k
            at = np.flatnonzero(hit) if todo is None else todo[hit]
            ids[at], known[at] = table[slot[hit]], True
            full = ~hit & (keys[slot] != 0)
            todo = np.flatnonzero(full) if todo is None else todo[full]
            if not len(todo):
                break
        return ids, known

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations by A* from the end; ties in a fixed order."""
        into = self.edges(text)
        fwd, _ = self.forward(into)
        queue, order, out = [(-fwd[-1], len(text), 0, 0.0, ())], 0, []
        while queue and len(out) < n:
            f, at, _, done, path = heapq.heappop(queue)  # ties: the path nearest to the start first
            if at == 0:
                nodes, link = [], path
                while link:
                    nodes.append(link[0])
                    link = link[1]
                out.append((-f, self.spell(nodes)))
                continue
            for s, w, x in into[at]:
                order += 1
                heapq.heappush(queue, (-(done + w + fwd[s]), s, order, done + w, (x, path)))
        return out

    MEMO = 300_000

    def split(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray]:
        """The texts' words, and the place in the memo of each, one text after the other; entries of the last generation
        come back when used."""
        words = [self.chunks(self.sp.normalize(t)) if t else [] for t in texts]
        if len(self.memo) > self.MEMO:
            self.old, self.old_paths, self.memo, self.paths = self.memo, self.paths, {}, Paths.none()
        memo, old = self.memo, self.old
        lacking = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in memo]
        if lacking:
            back = [w for w in lacking if w in old]
            new = [w for w in lacking if w not in old]
            taken = self.old_paths.take(np.fromiter(map(old.__getitem__, back), np.int64, len(back)))
            self.paths = Paths.joined([self.paths, taken, self.best(new)])
            memo.update(zip(chain(back, new), range(len(memo), len(memo) + len(lacking)), strict=True))
        return words, np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))

    def alternatives(self, word: str, n: int, best: tuple[int, ...]) -> list[tuple[float, tuple[int, ...]]]:
        """The word's n best segmentations and how much each scores below the first, kept for words that recur.

        Of equal ones the path that encoding takes comes first."""
        found = self.lists.get((word, n))
        if found is None:
            if len(self.lists) > self.MEMO // 10:
                self.lists.clear()
            ways = self.n_best(word, n)
            top = ways[0][0]
            ways = [(top, best), *[x for x in ways if x[1] != best]][:n]
            found = self.lists[word, n] = [(max(0.0, top - score), ids) for score, ids in ways]
        return found

    def n_best_of(self, words: list[str], gaps: np.ndarray, path, n: int) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
        """Of a text's n best paths how much each scores below the best, and its changed words as (place, ids); path(i): the
        i-th word's best ids.

        Only the n - 1 words of the smallest gaps can be changed in these."""
        k = min(n - 1, len(gaps))
        if k < 1:
            return [(0.0, [])]
        near = np.argpartition(gaps, k - 1)[:k] if k < len(gaps) else np.arange(k)
        near = sorted((gaps[i], i) for i in near.tolist() if gaps[i] < float("inf"))
        lists = [self.alternatives(words[i], n, path(i)) for _, i in near]
        merged: list[tuple[float, tuple]] = [(0.0, ())]  # losses against the best path, and each word's rank
        for x in lists:
            merged = sorted((a + b, (*c, j)) for a, c in merged for j, (b, _) in enumerate(x))[:n]
        return [(a, [(near[m][1], lists[m][j][1]) for m, j in enumerate(c) if j]) for a, c in merged]

    @staticmethod
    def splice(data, places: list[tuple], new: list, width: int = 1):
        """A path's ids (or bytes of them, ``width`` each) from the best path's and what its differences bring."""
        out, last = data[:0], 0
        for (at, gone, _), x in zip(places, new, strict=True):
            out += data[last * width : at * width] + x
            last = at + gone
        return out + data[last * width :]

    def encode(self, texts: list[str], n: int) -> list[Encoded]:
        """Each text's best ids and n best paths, all of them decoded."""
        words, rows = self.split(texts)
        flat, lengths, score, gap = self.paths.take(rows)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        size = np.fromiter(map(len, words), np.int64, len(words))
        edge = np.concatenate(([0], np.cumsum(size))).tolist()
        out, spell = [], self.spell_bytes
        for t, ws, a, b in zip(texts, words, edge[:-1], edge[1:], strict=True):
            ids = flat[ends[a] : ends[b]]
            total = float(score[a:b].sum())
            paths = self.n_best_of(ws, gap[a:b], lambda i, a=a: tuple(flat[ends[a + i] : ends[a + i + 1]].tolist()), n)
            changes = [[(int(ends[a + w] - ends[a]), int(lengths[a + w]), new) for w, new in sorted(change)] for _, change in paths]
            listed, best = ids.tolist(), ids.tobytes()
            first = self.decode(listed) == t
            sums, trips = [], []
            for change in changes:
                sums.append(zlib.crc32(self.splice(best, change, [np.array(new, np.int32).tobytes() for _, _, new in change], 4)))
                # decoding joins bytes, so differences that stand for the bytes they replace decode as the best path does
                same = all(spell(new) == spell(listed[at : at + gone]) for at, gone, new in change)
                trips.append(first if same else self.decode(self.splice(listed, change, [list(new) for _, _, new in change])) == t)
            out.append(Encoded(ids, [total - loss for loss, _ in paths], changes, sums, trips))
        return out

    def spell_bytes(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def decode(self, ids) -> str:
        return self.spell_bytes(ids).decode("utf-8", "replace")[1:]


@lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(df: DataFrame, text: str = "text", model: str | None = None, n_best: int = 4, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """keep, n_pieces, score, n_best_scores (descending), round_trip (decoding every path gives the text), ids_crc32 and, if
    asked for, ids of the best path; and of each path, best first: n_best_crc32 (of its ids), n_best_round_trip, and
    n_best_changes, by which it differs from the best path's ids: the ids ``new`` stand for the ``gone`` ones from place ``at``."""
    path = model or default_model()
    long, change = pa.int64(), pa.struct([("at", pa.int32()), ("gone", pa.int32()), ("new", pa.list_(pa.int32()))])
    schema = ", ".join([ddl(df, keep)] * bool(keep) + ["n_pieces long, score double, n_best_scores array<double>, round_trip boolean, ids_crc32 long, n_best_crc32 array<long>, n_best_round_trip array<boolean>, n_best_changes array<array<struct<at: int, gone: int, new: array<int>>>>"] + ["ids array<int>"] * ids)

    def run(batches):
        m = piece_model(path)
        for batch in batches:
            for part in arrow_slices(batch, text):
                got = m.encode(texts_of(part[text]), n_best)
                made = {
                    "n_pieces": ([len(x.ids) for x in got], long), "score": ([x.scores[0] for x in got], pa.float64()), "n_best_scores": ([x.scores for x in got], pa.list_(pa.float64())),
                    "round_trip": ([all(x.trips) for x in got], pa.bool_()), "ids_crc32": ([x.sums[0] for x in got], long), "n_best_crc32": ([x.sums for x in got], pa.list_(long)),
                    "n_best_round_trip": ([x.trips for x in got], pa.list_(pa.bool_())),
                    "n_best_changes": ([[[{"at": a, "gone": g, "new": new} for a, g, new in c] for c in x.changes] for x in got], pa.list_(pa.list_(change))),
                }
                if ids:
                    made["ids"] = ([x.ids for x in got], pa.list_(pa.int32()))
                yield arrow_batch({k: part[k] for k in keep}, made)

    return df.select(*[column(c) for c in dict.fromkeys((*keep, text))]).mapInArrow(run, schema)


def decode_pieces(df: DataFrame, ids: str = "ids", model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and the text that the ids stand for (null ids: null)."""
    path = model or default_model()
    schema = ", ".join([ddl(df, keep)] * bool(keep) + ["text string"])

    def run(batches):
        m = piece_model(path)
        for batch in batches:
            yield arrow_batch({k: batch[k] for k in keep}, {"text": ([None if x is None else m.decode(x) for x in batch[ids].to_pylist()], pa.string())})

    return df.select(*[column(c) for c in dict.fromkeys((*keep, ids))]).mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), ids=False)
