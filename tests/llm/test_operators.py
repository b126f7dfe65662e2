"""Dealt operators against brute force, round trips and held-out accuracy, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.llm import bpe, common, divergence, language, mixing, neardup, negatives, pieces, pitman_yor, quality, registry, substring, tiff, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, k string, size string, copies int, content string, score double, key string, at string, h long"


def rows() -> list[tuple]:
    rng = random.Random(5)
    vocab = ["the", "of", "and", "reading", "thing", "Éclair", "mañana", "x1", "stone,", "river.", "ß", "去", "|"] + [f"w{i}" for i in range(60)]

    def text(n: int) -> str:
        return " ".join(rng.choice(vocab) for _ in range(n))

    base, passage = text(120), text(50)
    words = base.split()
    near = list(words)
    near[60] = "changed"
    texts = [base, base, " ".join(near), text(80) + " " + passage + " " + text(30), passage + "\n" + text(40), text(60) + "\t" + passage, "", None, "one", "one", "two words", " \n\t ", text(3000), text(200), "the the the the the the the the the the the the", "line\nline\nother\nline\n", "# * $ % & | < >", "12345 !!! 67", "à J̌ <|endoftext|> X", text(34), text(35), text(36)]
    texts += [text(rng.randint(5, 90)) for _ in range(20)]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4] if i % 5 else "a", None if i % 4 == 0 else 7, i, "k", "s", 3, "c", 0.5, "x", "y", 1) for i, t in enumerate(texts)]
    out += [out[0], out[3], (None, base, None, None, None) + out[0][5:], (None, None, None, None, None) + out[0][5:], (2**40 + 1, text(40), "en", "b", 1) + out[0][5:]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts() -> list[str]:
    return [r[1] or "" for r in rows()]


def test_word_hashes_tell_words_apart():
    h = common.WordHasher(1)
    h.PIECE = 50
    got, n = h.texts(texts())
    flat = [w for t in texts() for w in t.encode().split()]
    assert n.tolist() == [len(t.encode().split()) for t in texts()]
    assert len({(w, int(x)) for w, x in zip(flat, got, strict=True)}) == len(set(flat)) == len(set(got.tolist()))
    for width in (1, 2, 5, 35):
        win = common.window_hashes(got[:400], width)
        seqs = [tuple(flat[i : i + width]) for i in range(400 - width + 1)]
        assert len(set(zip(seqs, win.tolist(), strict=True))) == len(set(seqs)) == len(set(win.tolist()))


# ---------------------------------------------------------------- 1


def all_segmentations(m, text):
    into = m.edges(text)
    paths = {0: [0.0]}
    for e in range(1, len(text) + 1):
        paths[e] = [a + w for s, w, _ in into[e] for a in paths[s]]
    return sorted(paths[len(text)], reverse=True)


def test_n_best_is_exact():
    m = pieces.piece_model(pieces.default_model())
    texts = ["the thing", "ñoñ a", "ab一😀 c", "a", "  b", "reading!", "", "a a a", "x" * 12]
    for t, got in zip(texts, m.encode(texts, 6), strict=True):
        want = all_segmentations(m, m.sp.normalize(t))
        assert got.scores == pytest.approx(want[: len(got.scores)]) and len(got.scores) == min(6, len(want))
        ways = {tuple(m.splice(got.ids.tolist(), c, [list(new) for _, _, new in c])) for c in got.changes}
        assert len(ways) == len(got.changes) and all(m.decode(w) == t for w in ways) and all(got.trips)


def test_best_paths_of_odd_words():
    """Best paths found for many words at once against each word's own lattice."""
    rng, m = random.Random(4), pieces.piece_model(pieces.default_model())
    words = ["▁" + "".join(rng.choice("abehnrst'1é一😀▁") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["▁" * 40, "0" * 300]
    got, at = m.best(words), 0
    for w, n, score, gap in zip(words, got.lengths, got.score, got.gap, strict=True):
        best = m.n_best(w, 2)
        assert score == pytest.approx(best[0][0]) and gap == pytest.approx(best[0][0] - best[1][0] if len(best) > 1 else math.inf, abs=1e-9)
        assert m.spell_bytes(got.ids[at : at + n].tolist()).decode() == w.replace("▁", " ")
        at += n


def test_encode_pieces(docs, none):
    got = pieces.encode_pieces(docs).collect()
    assert len(got) == len(rows()) and all(r.round_trip for r in got)
    back = {(r.doc_id, r.text) for r in pieces.decode_pieces(pieces.encode_pieces(docs)).collect()}
    assert back == {(r[0], r[1] or "") for r in rows()}
    assert pieces.encode_pieces(none).count() == 0


def test_every_path_is_returned_and_decoded(docs):
    m = pieces.piece_model(pieces.default_model())
    got = pieces.encode_pieces(docs, keep=("doc_id", "text")).collect()
    assert max(len(r.n_best_scores) for r in got) == 4
    for r in got:
        assert len(r.n_best_scores) == len(r.n_best_crc32) == len(r.n_best_round_trip) == len(r.n_best_changes)
        seen = set()
        for score, crc, trip, changes in zip(r.n_best_scores, r.n_best_crc32, r.n_best_round_trip, r.n_best_changes, strict=True):
            ids = list(r.ids)
            for c in reversed(changes):
                ids[c["at"] : c["at"] + c["gone"]] = c["new"]
            assert m.decode(ids) == (r.text or "") and trip
            assert crc == zlib.crc32(np.array(ids, np.uint32).tobytes())
            if m.unk not in ids and not set(ids) & set(m.byte_id.values()):
                assert sum(m.score[i] for i in ids) == pytest.approx(score)
            seen.add(tuple(ids))
        assert len(seen) == len(r.n_best_scores)
    assert {"n_best_crc32", "n_best_round_trip", "n_best_changes"} <= set(pieces.encode_pieces(docs, ids=False).columns)


# ---------------------------------------------------------------- 2


def test_mix(docs, none):
    sized = docs.select("doc_id", "source", mixing.word_count("text").alias("size"))
    got = mixing.choose_copies(sized, F.coalesce(F.pmod("doc_id", F.lit(1024)), F.lit(0)).cast("long")).toPandas()
    assert len(got) == len(rows()) and got["copies"].between(0, 3).all()
    size = collections.Counter()
    for r in rows():
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        free = [s for s in names if s not in full]
        target = {s: 3 * size[s] if s in full else (total - sum(3 * size[f] for f in full)) * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    got["source"] = got["source"].where(got["source"].notna(), None)
    for s in names:
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert part["source_size"].iloc[0] == size[s] and part["target"].iloc[0] == pytest.approx(target[s])
        assert abs((part["copies"] * part["size"]).sum() - target[s]) <= part["size"].max()
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == got["copies"].sum()
    again = mixing.mix_sources(docs.repartition(5)).toPandas()
    one = mixed.toPandas()
    assert collections.Counter(zip(one.doc_id.fillna(-1), one.text.fillna(""))) == collections.Counter(zip(again.doc_id.fillna(-1), again.text.fillna("")))
    assert mixing.mix_sources(none).count() == 0


# ---------------------------------------------------------------- 3


def test_language_model(docs, none):
    got = pitman_yor.score_language_model(docs, common.crc_mod("doc_id", 7) == 2).toPandas()
    assert len(got) == len(rows())
    low = [[w for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))] + [None] for r in rows()]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows()]
    counts = collections.Counter(w for t, h in zip(low, held, strict=True) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(t), sum(counts[w] > 0 for w in t), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6), h) for t, h in zip(low, held, strict=True))
    assert want == sorted(zip(got.n_tokens, got.n_known, got.base_score.round(6), got.held_out, strict=True))
    assert (got.train_tokens == n).all() and np.isfinite(got.score).all() and (got.score < 0).all()
    train = got[~got.held_out]
    assert train.score.sum() > train.base_score.sum()
    assert pitman_yor.score_language_model(none, common.crc_mod("doc_id", 7) == 2).count() == 0


def stirling(c: int, d: float) -> list[float]:
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0] + [row[t - 1] + (n - t * d) * (row[t] if t < len(row) else 0.0) for t in range(1, n + 2)]
    return row


def rising(x: float, step: float, n: int) -> float:
    return math.prod(x + step * i for i in range(n))


def test_seats_follow_their_law():
    """Numbers of tables, by inversion and by Metropolis steps, against the law itself."""
    for d, c, a in ((0.5, 2, 0.7), (0.5, 7, 2.0), (0.9, 30, 11.0), (0.2, 30, 0.05), (0.8, 120, 60.0)):
        key = np.arange(20_000, dtype=np.uint64)
        s = stirling(c, d)
        want = np.array([0.0] + [math.exp(math.log(s[t]) - math.log(s[1]) + (t - 1) * math.log(a)) for t in range(1, c + 1)])
        want /= want.sum()
        t = pitman_yor.Seats(d).draw(np.full(len(key), c), np.full(len(key), a), key, 3)
        assert np.abs(np.cumsum(np.bincount(t, minlength=c + 1) / len(key)) - np.cumsum(want)).max() < 0.02
        seats, at, seen = pitman_yor.Seats(d), (1, c), np.zeros(c + 1)
        for i in range(4000):
            at = seats.move(c, a, *at, key=5, salt=i)
            seen[at[0]] += 1
        assert 1 <= at[1] <= c and np.abs(np.cumsum(seen / 4000) - np.cumsum(want)).max() < 0.05
    assert (pitman_yor.Seats(0.5).draw(np.array([0, 1]), np.array([9.0, 9.0]), key[:2], 1) == [0, 1]).all()


def test_gibbs_sampler_finds_the_exact_prediction():
    """Averages over sweeps against the sum over all seatings of a tiny corpus."""
    u, v, c = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 0, 2, 1]), np.array([5, 2, 4, 1, 3])
    corpus = pitman_yor.Corpus(int(c.sum()), 3, 0.6, 0.4, 0.8, 1.5)
    n = np.bincount(u, c, 3)
    ask_u, ask_v = (x.ravel() for x in np.meshgrid(np.arange(3), np.arange(4), indexing="ij"))  # word 3 is unknown
    counts = np.zeros((3, 4))
    counts[u, v] = c

    def predicted(t):
        tables, root = np.bincount(u, t, 3), np.append(np.bincount(v, t, 3), 0)
        seats = np.zeros((3, 4))
        seats[u, v] = t
        return pitman_yor.replace(corpus, customers=int(t.sum())).predict(counts[ask_u, ask_v], seats[ask_u, ask_v], n[ask_u], tables[ask_u], root[ask_v])

    s, total, want = [stirling(int(x), 0.6) for x in c], 0.0, np.zeros(12)
    for t in itertools.product(*(range(1, x + 1) for x in c)):
        t = np.array(t)
        root = np.bincount(v, t, 3).astype(int)
        w = math.prod(s[i][t[i]] for i in range(5)) * math.prod(rising(0.8, 0.6, int(x)) for x in np.bincount(u, t, 3))
        w *= math.prod(rising(0.6, 1, x - 1) for x in root) * rising(1.5, 0.4, 3) / rising(1.5, 1, int(root.sum()))
        total, want = total + w, want + w * predicted(t)
    want /= total
    assert np.allclose(want.reshape(3, 4).sum(axis=1), 1)
    words, pair, seats = np.arange(3, dtype=np.uint64) + np.uint64(77), np.arange(5, dtype=np.uint64), pitman_yor.Seats(0.6)
    t, got, sweeps = np.ones(5, np.int64), np.zeros(12), 6000
    for i in range(1, sweeps + 1):
        tables, root = np.bincount(u, t, 3), np.bincount(v, t, 3).astype(np.int64)
        now = corpus.with_root_mass(float(corpus.root_gammas(root, words, i).sum()), i)
        t, _ = now.sweep(seats, c, u, v, pair, words, tables, root, i, t, c[:0])
        got += predicted(t)
    assert np.abs(got / sweeps - want).max() < 0.006


def test_language_model_against_plain_sampling(spark):
    """The operator's scores against plain code of the same sampler: blocks, groups and owners change nothing."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d", "E", "e"][: 2 + i % 5]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    docs.append((60, "a b " * 600))  # pairs of more than DIRECT customers
    got = {}
    for block, group in ((300_000, 6 << 20), (40, 100)):
        old = pitman_yor.BLOCK, pitman_yor.GROUP_BYTES
        pitman_yor.BLOCK, pitman_yor.GROUP_BYTES = block, group
        try:
            df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
            got[block] = {r.doc_id: (r.score, r.n_tokens) for r in pitman_yor.score_language_model(df, F.col("doc_id") % 7 == 2).collect()}
        finally:
            pitman_yor.BLOCK, pitman_yor.GROUP_BYTES = old
    assert got[40].keys() == got[300_000].keys() == {i for i, _ in docs}
    for i, t in docs:
        assert got[40][i] == pytest.approx(got[300_000][i], rel=1e-4) and got[40][i][1] == len(t.split()) + 1
    # plain: one table of pairs, the same draws
    text = [[w.lower() for w in t.split()] for _, t in docs]
    hasher = pitman_yor.WordHasher(31, lower=True)
    name = {w: hasher.texts([w])[0][0] for w in "abcde"} | {None: pitman_yor.END}
    words = np.array(sorted(name.values()), np.uint64)
    place = {w: int(np.searchsorted(words, h)) for w, h in name.items()}
    pairs = collections.Counter((place[a], place[b]) for (i, _), t in zip(docs, text, strict=True) if i % 7 != 2 for a, b in zip([None, *t], [*t, None], strict=True))
    u, v, c = (np.array(x) for x in zip(*((a, b, n) for (a, b), n in sorted(pairs.items())), strict=True))
    n, pair = np.bincount(u, c, 6).astype(np.int64), pitman_yor.pair_hash(words, u, v)
    once, twice = (c == 1).sum(), (c == 2).sum()
    corpus = pitman_yor.Corpus(int(c.sum()), 6, min(0.95, max(0.1, once / max(1, once + 2 * twice))))
    t, rest, seats, average = np.minimum(c, 1), c[c > pitman_yor.DIRECT], pitman_yor.Seats(corpus.discount), np.zeros((6, 6))
    for sweep in range(pitman_yor.BURN + pitman_yor.SWEEPS + 1):
        tables, root = (np.bincount(x, t, 6).astype(np.int64) for x in (u, v))
        mass = float(corpus.root_gammas(root, words, sweep + 1).sum())
        corpus = pitman_yor.replace(corpus, customers=int(root.sum())).draw_strengths(corpus.strength_likelihoods(tables, n), sweep).with_root_mass(mass, sweep + 1)
        if sweep > pitman_yor.BURN:
            counts, held = np.zeros((6, 6)), np.zeros((6, 6))
            counts[u, v], held[u, v] = c, t
            a, b = np.meshgrid(np.arange(6), np.arange(6), indexing="ij")
            average += corpus.predict(counts[a, b], held[a, b], n[a], tables[a], root[b]) / pitman_yor.SWEEPS
        t, rest = corpus.sweep(seats, c, u, v, pair, words, tables, root, sweep + 1, t, rest)
        if sweep == 0:
            corpus = pitman_yor.replace(corpus, root_discount=min(0.95, max(0.1, (root == 1).sum() / max(1, (root == 1).sum() + 2 * (root == 2).sum()))))
    for (i, _), t in zip(docs, text, strict=True):
        want = sum(math.log10(average[place[a], place[b]]) for a, b in zip([None, *t], [*t, None], strict=True))
        assert got[40][i][0] == pytest.approx(want, rel=5e-4)  # sums are kept to 13 bits


# ---------------------------------------------------------------- 4


def test_token_files(spark, docs, none):
    tok = token_files.word_encoder(token_files.default_tokenizer()).tokenizer
    path = common.fresh_path(spark, "tokens")
    man = token_files.write_token_files(docs, path, length=64, shard_bytes=4000)
    got = token_files.read_token_files(man, path).toPandas().sort_values("start")
    assert man.count() > 1 and got["doc_id"].dropna().is_monotonic_increasing
    want = collections.Counter()
    for r in rows():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[(r[0] or -1 if r[0] != 0 else 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert want == collections.Counter(zip(got.doc_id.fillna(-1).astype(int), got.n_tokens, got.ids_crc32, strict=True))
    assert (got["start"].to_numpy() == np.concatenate(([0], np.cumsum(got["n_tokens"])[:-1]))).all()
    shard = man.orderBy("shard").first()
    import pyarrow as pa

    fs, root = token_files._filesystem(path)
    with pa.memory_map(f"{root}/{shard.file}.arrow") as f:
        reader = token_files.SequenceReader(f)
        full = [reader.sequence(i) for i in range(-(-shard.tokens // 64))]
        assert sum(int(m.sum()) for _, m in full) == shard.tokens and all(len(s) == 64 for s, _ in full)
    empty = common.fresh_path(spark, "tokens")
    assert token_files.read_token_files(token_files.write_token_files(none, empty), empty).count() == 0


# ---------------------------------------------------------------- 5


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_substring_dedup(docs, none):
    split = [WORD.findall(r[1] or "") for r in rows()]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = collections.Counter()
    for r, w in zip(rows(), split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[(r[0], " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else r[1])] += 1
    got = substring.dedup_substrings(docs)
    assert got.columns == docs.columns
    assert want == collections.Counter((r.doc_id, r.text) for r in got.collect())
    assert substring.dedup_substrings(none).count() == 0


# ---------------------------------------------------------------- 6


def test_quality(docs, none):
    got = quality.judge_quality(docs).collect()
    want = collections.Counter()
    for r in rows():
        t = r[1] or ""
        w = WORD.findall(t)
        five = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        rep = [False] * len(w)
        for i in range(len(w) - 4):
            if five[tuple(w[i : i + 5])] > 1:
                rep[i : i + 5] = [True] * 5
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(r[0], len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), sum(rep), len(w) < 10 or 100 * sum(rep) > 20 * len(w))] += 1
    assert want == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert all(0 <= x <= 1 + 1e-9 for r in got for x in (r.class_distance, r.word_distance) if x is not None)
    assert quality.judge_quality(none).count() == 0


def test_jensen_shannon(spark):
    def js(p, q):
        return spark.range(1).select(quality.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]

    assert js([0.5, 0.5], [0.5, 0.5]) == 0 and js([1.0, 0.0], [0.0, 1.0]) == pytest.approx(1)
    p, q = np.array([0.7, 0.2, 0.1]), np.array([0.3, 0.3, 0.4])
    m = (p + q) / 2
    assert js(p.tolist(), q.tolist()) == pytest.approx(math.sqrt((p * np.log2(p / m)).sum() / 2 + (q * np.log2(q / m)).sum() / 2))


# ---------------------------------------------------------------- 7


def shingle_counts(t: str) -> collections.Counter:
    w = WORD.findall(t)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    e = rng.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    doc = np.repeat([0, 1], 60)
    sig = neardup.bag_minhash(doc, np.concatenate((e, e)), np.concatenate((a, b)), 3, m=4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)
    assert np.isinf(sig[2].view(float)).all()


def test_near_duplicates(docs, none):
    by_id = collections.defaultdict(list)
    for r in rows():
        if r[0] is not None:
            by_id[r[0]].append(shingle_counts(r[1] or ""))
    ids = sorted(by_id)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(ids, 2):
        for s, t in itertools.product(by_id[i], by_id[j]):
            both, every = sum((s & t).values()), sum((s | t).values())
            if every and both >= 0.8 * every:
                up[max(root(i), root(j))] = min(root(i), root(j))
    got = {r.id: r.class_id for r in neardup.near_duplicate_classes(docs).collect()}
    assert got == {i: root(i) for i in ids} and len(set(got.values())) < len(got)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {root(i) for i in ids} | {None}
    assert neardup.near_duplicate_classes(none).count() == 0


def test_large_family_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 4)
    words = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(30):
        w = list(words)
        w[i * 3] = "new"
        texts.append((i, " ".join(w)))
    got = neardup.near_duplicate_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 30


# ---------------------------------------------------------------- 8


def labelled(spark):
    rng = random.Random(1)
    words, bad = [f"plain{i}" for i in range(200)], ["nastya", "nastyb", "vile", "foulmouth"]
    data, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        t = [rng.choice(words) for _ in range(rng.randint(10, 40))] + ([rng.choice(bad) for _ in range(2)] if toxic else [])
        rng.shuffle(t)
        data.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(data + [(None, None), (9999, ""), (9999, "")], "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")


def test_toxicity(spark, docs, none):
    data, labels = labelled(spark)
    train = labels.where(common.crc_mod("doc_id", 3) != 1)
    model = toxicity.train_toxicity(data, train)
    got = data.select("doc_id", toxicity.toxicity_score(spark, model, F.col("text")).alias("s")).collect()
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.s >= 0.7) == (r.doc_id % 5 == 0) for r in held) / len(held) > 0.97
    assert len(got) == 603 and all(0 <= r.s <= 1 for r in got)
    assert toxicity.train_toxicity(docs, labels.limit(0)) is None
    assert docs.select(toxicity.toxicity_score(spark, None, F.col("text"))).distinct().collect()[0][0] == 0


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    votes = np.column_stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.8, 0.02), (0.7, 0.05), (0.3, 0.3))]).astype(float)
    votes = np.column_stack((votes, votes[:, 0]))  # a copy is correlated and shares its weight
    noisy = np.where(rng.random(4000) < 0.03, ~y, y).astype(int)
    p = toxicity.label_model(votes, noisy)
    assert ((p > 0.5) == y).mean() > 0.95 and toxicity.voter_groups(votes[noisy == 1], np.ones(noisy.sum())).tolist() == [0, 1, 2, 0]


def test_label_model_learns_without_labels_votes():
    rng = np.random.default_rng(5)
    y, rates = rng.random(6000) < 0.2, ((0.6, 0.01), (0.5, 0.02), (0.5, 0.01), (0.4, 0.03))
    votes = np.column_stack([np.where(y, rng.random(6000) < a, rng.random(6000) < b) for a, b in rates]).astype(np.uint8)
    labels = np.where(np.arange(6000) < 600, y, np.nan)  # a tenth is labelled
    p = toxicity.label_model(votes, labels, 0.5)
    odds = np.full(6000, 0.2 / 0.8)  # Bayes' rule under the true rates
    for v, (a, b) in enumerate(rates):
        odds *= np.where(votes[:, v] == 1, a / b, (1 - a) / (1 - b))
    assert np.abs(p - odds / (1 + odds)).max() < 0.15 and np.abs(p - odds / (1 + odds)).mean() < 0.01
    turned = np.where(np.arange(6000) < 60, ~y, labels)  # a tenth of the labels lies; they cast no vote
    q = toxicity.label_model(votes, turned, 0.5)
    assert np.abs(p - q).max() < 0.01
    twice = toxicity.label_model(votes[:3000], labels[:3000], 0.5, np.full(3000, 2.0))
    assert twice == pytest.approx(toxicity.label_model(np.tile(votes[:3000], (2, 1)), np.tile(labels[:3000], 2), 0.5)[:3000], abs=1e-3)


def test_voter_groups():
    votes = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1], [0, 0, 1], [1, 1, 1], [0, 0, 0]], np.uint8)
    group = toxicity.voter_groups(votes, np.ones(6))
    assert group.tolist() == [0, 0, 1]
    assert toxicity.merge_voters(votes, group).tolist() == votes[:, 1:].tolist()
    assert toxicity.merge_voters(votes[:, :0], group[:0]).shape == (6, 0)


def test_toxicity_odd(spark):
    data, labels = labelled(spark)
    assert toxicity.train_toxicity(data.limit(0), labels) is None
    nothing = data.select("doc_id", F.lit("same words").alias("text"), F.lit(1).alias("_label"), F.lit(2).alias("y"))  # no voter; clashing names
    model = toxicity.train_toxicity(nothing, labels)
    got = {r[0] for r in nothing.select(toxicity.toxicity_score(spark, model, F.col("text"))).collect()}
    assert len(got) == 1 and 0.1 < got.pop() < 0.3


# ---------------------------------------------------------------- 9


def test_language_mixture(spark, docs, none):
    en, de = "the house and the river with a thing of reading that", "der fluss und die häuser mit einem ding zum lesen das"
    rng = random.Random(2)
    data = [(i, " ".join(rng.choices((en if i % 2 else de).split(), k=30)), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(data + [(900, en + " " + en + " " + de, None), (901, None, "en"), (902, "123 !!", None), (903, "", "de")], "doc_id long, text string, lang string")
    model = language.train_languages(df.where("doc_id % 4 <> 2 and doc_id < 900"))
    got = {r.doc_id: r for r in language.predict_languages(df, model).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(200))
    assert got[900].lang_pred == "en" and 0.5 < got[900].score < 0.8 and "de=" in got[900].shares
    assert [got[i].lang_pred for i in (901, 902, 903)] == ["und"] * 3
    assert language.predict_languages(docs, language.train_languages(none)).where("lang_pred <> 'und'").count() == 0
    assert language.predict_languages(docs, language.train_languages(docs)).count() == len(rows())


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, order):
    raw = (" ".join(t for t in texts() if t) * 3).encode()
    raw += b"\0" * (-len(raw) % 64)
    for predictor, tile in itertools.product((1, 2), (0, 16)):
        data = tiff.write_tiff(raw, page_rows=100, strip_rows=33, compression=compression, predictor=predictor, tile=tile, order=order)
        assert b"".join(p.tobytes() for p, _ in tiff.pages(data)) == raw


def test_packbits_vector():
    # the well-known example of the format's description
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_tiff_operators(spark, docs, none):
    made = tiff.text_to_tiff(docs, page_rows=4)
    got = tiff.tiff_digest(made).collect()
    assert len(got) == len(rows())
    for r in got:
        t = dict((x[0], x[1] or "") for x in rows()).get(r.doc_id)
        if r.doc_id is not None:
            raw = t.encode()
            padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    pages = tiff.tiff_pages(made)
    assert pages.count() > len(rows()) and pages.where("error is not null").count() == 0
    broken = spark.createDataFrame([(1, bytearray(b"II*\0")), (2, None), (3, bytearray(b"junk and more"))], "doc_id long, media binary")
    assert [(r.doc_id, r.page) for r in tiff.tiff_pages(broken).orderBy("doc_id").collect()] == [(1, -1), (3, -1)]
    assert tiff.tiff_digest(tiff.text_to_tiff(none)).count() == 0


def test_malformed_files_give_rows(spark):
    good = tiff.write_tiff(bytes(range(64)) * 4, compression=tiff.DEFLATE)

    def broken(tag: int, value: int) -> bytes:
        at = good.index(bytes([tag & 255, tag >> 8, 4, 0, 1, 0, 0, 0]))
        return good[: at + 8] + value.to_bytes(4, "little") + good[at + 12 :]

    files = [good, broken(278, 0), broken(256, 0), broken(257, 1 << 30), broken(273, 1 << 31), good[:-30], good[: len(good) // 2], b"II*\0\xff\xff\xff\xff", b""]
    got = tiff.tiff_pages(spark.createDataFrame(list(enumerate(map(bytearray, files))), "doc_id long, media binary")).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(files)))
    assert [r.doc_id for r in got if r.error is None] == [0] and all(r.page == -1 for r in got if r.error)
    digest = tiff.tiff_digest(spark.createDataFrame([(1, 0, bytearray(files[1]))], "doc_id long, n_bytes long, media binary")).first()
    assert digest.payload_bytes is None and digest.media_bytes == len(files[1])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in ("op3_pitman_yor", "op8_toxicity", "op12_hard_negatives", "op13_source_divergence")])
def test_queries_keep_ids_beside_nulls(spark, tmp_path, name):
    """Every digit of ids above 2^53, beside a null in one batch, through the registered queries."""
    ids = [2**53 + 1, None, 2**53 + 3, -(2**53) - 1]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(k, f"{text} {n}", "en", "s", 9) for n, k in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.doc_id for r in registry.QUERIES[name](spark, str(tmp_path)).select("doc_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, ids))


def test_one_hot_key_is_mixed_in_proportion(spark):
    """Many rows of one key cost as much as their number, not its square."""
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a b "), F.col("id") % 3).alias("text"), F.lit("s").alias("source"))
    assert mixing.mix_sources(rows).count() == 20_000


def test_forced_boundaries_encode_as_the_library_does(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = [*map(chr, range(32, 127)), *" \t\n\x0b\x1c\x85\xa0   éÉßİΣςJ̌́去ไ한²①Ⅷ🇩🇪‍"]
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)] + ["<|endoftext|>x<|startoftext|> <|endoftext", "q" * 900 + "é" * 50, "ab" * 3000]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        ours, library = bpe.forced_bpe(path), Tokenizer.from_file(path)
        wanted = [library.encode(t, add_special_tokens=False).ids for t in odd]
        assert [i.tolist() for i in ours.encode(odd)] == wanted
        assert [ours.decode(np.array(i)) for i in wanted] == [library.decode(i, skip_special_tokens=False) for i in wanted]
        assert 0 < ours.joined.mean() < 0.1
    got = bpe.encode_bpe(docs)
    assert got.schema["ids"].dataType.simpleString() == "array<int>"
    library = Tokenizer.from_file(token_files.default_tokenizer())
    back = sorted((str(r.doc_id), r.ids, r.decoded) for r in bpe.decode_bpe(got, keep=("doc_id", "ids")).collect())
    assert back == sorted((str(r[0]), (i := library.encode(r[1] or "", add_special_tokens=False).ids), library.decode(i, skip_special_tokens=False)) for r in rows())
    assert bpe.encode_bpe(none).count() == 0
    lost = spark.createDataFrame([(1, [320, None, 60_000, -1, 320]), (2, None)], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode_bpe(lost).orderBy("doc_id").collect()] == ["a</w> a</w>", ""]


def test_op11_digests(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.default_tokenizer())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(map(str, r)) for r in bpe.op11_forced_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    wanted = []
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        wanted.append((str(r[0]), str(len(ids)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(wanted)


def test_residue_products_are_exact():
    rng = np.random.default_rng(1)
    for d, most in ((64, 300), (700, 10**6), (3, 10**7), (1, 2**27), (0, 5)):
        a, b = rng.integers(-most, most + 1, (7, d)), rng.integers(-most, most + 1, (9, d))
        assert (negatives.rns_scores(a, b) == a @ b.T).all()
    assert all(254 * 254 * negatives.STRIP < 2**24 and p < 510 for p in negatives.PRIMES)
    with pytest.raises(OverflowError):
        negatives.rns_scores(np.full((1, 9), 2**28), np.full((1, 9), 2**28))


def vectors() -> list[tuple]:
    rng = random.Random(8)
    out = [(i, [rng.randint(-4, 9) / 8 for _ in range(6)], rng.randint(0, 3), i) for i in range(300)]
    out += [(1000 + i, out[7][1], 1, 0) for i in range(40)]  # one vector many times
    out += [out[5], out[100], (None, out[3][1], 2, 0), (None, [0.5] * 6, None, 0), (301, None, 1, 0), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 0)]
    out += [(303, [1.0, math.nan, 1.0, 1.0, 1.0, 1.0], 1, 0), (304, [math.inf] * 6, 1, 0), (305, [0.5, 0.5], 1, 0), (400, [0.25, 0.5], 1, 0), (306, [0.25, 0.5], 2, 0), (307, [3e37] * 6, 1, 0), (500, [], 1, 0), (309, [], 2, 0)]
    return out


def brute_negatives(rows: list[tuple]) -> list[tuple]:
    good = [(k, [math.floor(256 * x) for x in v], label) for k, v, label, _ in rows if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and all(abs(x) < 1e6 for x in v)]
    out = []
    for k, v, label in {(k, tuple(v), label) for k, v, label in good if k is not None and k % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, other) for j, w, other in good if len(w) == len(v) and j != k)
        for p, pn, pid, _ in [s for s in scored if s[3] == label][:5]:
            picked = [s for s in scored if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(k, None if pn else pid, r, None if n else i, -p, -s) for r, (s, n, i, _) in enumerate(picked, 1)]
    return sorted(out, key=str)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    schema = "vec_id long, embedding array<float>, label int, rank int"
    df = spark.createDataFrame(vectors(), schema).repartition(3)
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(vectors())
    assert negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine_hard_negatives(df, F.col("vec_id") == 77_777).count() == 0


def brute_divergence(found: list[tuple], top: int) -> list[tuple]:
    counts: dict = collections.defaultdict(collections.Counter)
    spread: dict = collections.defaultdict(collections.Counter)
    for r in found:
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]
        counts[r[2] or "", r[3] or ""].update(terms)
        spread[r[2] or ""].update(set(terms))
    out = []
    for lang in spread:
        kept = [t for t, n in spread[lang].items() if n >= 3]
        groups = {s: c for (a, s), c in counts.items() if a == lang}

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), collections.Counter()))
        for s in groups:
            pairs = [(-sum((p[s][t] - p[r][t]) ** 2 // p[r][t] for t in kept), r) for r in groups if r != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def test_source_divergence_matches_brute_force(spark, docs, none, monkeypatch):
    monkeypatch.setattr(divergence, "TREE", 20)
    monkeypatch.setattr(divergence, "HELD", 50)
    got = divergence.source_divergence(docs, top=9)
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows(), 9)
    assert divergence.source_divergence(none).count() == 0
    bare = [(1, "12 34", "xx", "a"), (2, None, "xx", "b"), (3, "only one", None, None)]
    got = divergence.source_divergence(spark.createDataFrame(bare, "doc_id long, text string, lang string, source string"))
    assert sorted(map(tuple, got.collect())) == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


def test_trees_share_paths_and_count_beyond_floats():
    paths = [[(0, 3), (1, 1)], [(0, 3), (1, 2)], [(0, 3)], [(1, 1)], [(0, 3), (1, 1), (2, 10**12)]]
    starts = np.cumsum([0, *map(len, paths)])
    source, n = (np.array([i[k] for p in paths for i in p]) for k in (0, 1))
    levels = divergence.tree_levels(starts, source, n, np.array([5, 1, 1, 2, 1]))
    assert [len(v[0]) for v in levels] == [2, 2, 1]  # (0, 3) once, whatever follows
    assert dict(zip(zip(*map(list, levels[0][1:3]), strict=True), levels[0][3].tolist(), strict=True)) == {(0, 3): 8, (1, 1): 2}
    assert divergence._shares(np.array([10**12]), np.array([3 * 10**12])).tolist() == [1 + 10**9 * (10**12 + 1) // (3 * 10**12)]


def test_any_name_of_a_callers_column_stays(spark):
    """Columns named like every internal one of the three operators that return their input's rows."""
    names = ["row", "_row", "id", "lead", "k", "at", "__s_k", "__s_at", "__m_row", "__m_key", "__m_no", "__m_pick", "__m_rank", "__m_rate", "__m_offset", "__m_copies", "__m_copy", "__m_k", "__m_s", "__m_h", "_s", "_salt", "_r", "n", "size", "rank", "rate", "content", "bands", "comp_id", "family", "class_id", "class_size", "__d"]
    text = " ".join(f"w{i}" for i in range(60))
    data = [(1, text, "s"), (2, text, "s"), (3, text + " more words", "s"), (None, "other", None), (5, None, "t")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    for run in (neardup.keep_one, substring.dedup_substrings, mixing.mix_sources):
        got = run(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(r[n] == f"{n}:{'-' if r.doc_id is None else r.doc_id}" for r in found for n in names)


def test_more_groups_than_buckets(spark, docs, monkeypatch):
    """Scores don't depend on the number of buckets that Spark allows, and nothing is left in the catalog."""
    held = common.crc_mod("doc_id", 7) == 2
    monkeypatch.setattr(pitman_yor, "GROUP_BYTES", 400)
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.score, 9))
    wanted = sorted(map(key, pitman_yor.score_language_model(docs, held, sweeps=1).collect()))
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    try:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
        assert sorted(map(key, pitman_yor.score_language_model(docs, held, sweeps=1).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lm_")]


def test_language_sets_against_all_sets():
    """Backward elimination finds the set of the highest penalised likelihood that trying all sets finds, but for near draws."""
    rng = np.random.default_rng(6)
    letters = ["abcde", "defgh", "ghijk", "jklma"]
    word = lambda k: "".join(rng.choice(list(letters[k]), 5))
    counts = np.zeros((2, language.BUCKETS, 4))
    for k in range(4):
        for order, b in enumerate(language.gram_buckets([" ".join(word(k) for _ in range(3000))])[0]):
            counts[order, :, k] += np.bincount(b, minlength=language.BUCKETS)
    model = language.LanguageModel(list("wxyz"), counts)
    texts = [" ".join(word(k) for k in rng.choice(rng.choice(4, rng.integers(1, 4), replace=False), 60)) for _ in range(60)]
    score, words = model.word_scores(texts)
    share, _ = model.predict(texts)
    best, found = np.full(len(texts), -np.inf), np.zeros((len(texts), 4), bool)
    value_of = {}
    for size in range(1, 5):
        for pick in itertools.combinations(range(4), size):
            allowed = np.zeros((len(texts), 4))
            allowed[:, pick] = 1
            value = model.proportions(score, words, allowed, 5)[1] - 3.0 * size * np.log(words + 2)
            value_of[pick] = value
            found[value > best] = allowed[0] > 0
            best = np.maximum(best, value)
    ours = share > 1e-9
    got = np.array([value_of[tuple(np.flatnonzero(row))][i] if tuple(np.flatnonzero(row)) in value_of else -np.inf for i, row in enumerate(ours)])
    assert (got <= best + 1e-6).all() and (ours == found).all(axis=1).mean() > 0.9


def test_quality_references_joined_or_merged_agree(spark, docs, monkeypatch):
    wanted = sorted(map(str, quality.judge_quality(docs).collect()))
    monkeypatch.setattr(quality, "FEW_LANGUAGES", 0)
    assert sorted(map(str, quality.judge_quality(docs).collect())) == wanted


def test_toxic_stage_keeps_what_scores_low_by_hand(spark):
    data, labels = labelled(spark)
    model = toxicity.train_toxicity(data, labels)
    texts = [r.text or "" for r in data.select("text").distinct().collect()]
    votes, patterns = model.rows(texts, model.memo())
    by_hand = {t: 1 / (1 + math.exp(-(sum(w * x for w, x in zip(model.weights, [*v, min(3, int(v.sum())), *p, 1.0], strict=True))))) for t, v, p in zip(texts, votes, patterns, strict=True)}
    got = data.select(F.coalesce("text", F.lit("")).alias("t"), toxicity.toxicity_score(spark, model, F.col("text")).alias("s")).distinct().collect()
    assert all(abs(by_hand[r.t] - r.s) < 1e-9 for r in got) and len(got) == len(by_hand)
