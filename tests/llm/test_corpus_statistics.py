"""Phrases, repeated passages and whitening against brute force, with the cases that break things."""
import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import phrases, substring, whitening
from tidewatch.llm.shared import in_bits, slot_bits
from tidewatch.llm.words import NOT_SPACE, cut, word_hashes, words

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, w string, n string, a int, key string, h int, `page-id` int, "
          "spans int, held boolean, rank int, total int")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "w", None, 1, "k", 2, 3, 4, True, 5, 6) for i, t, lang in rows], SCHEMA)


def made_texts(seed=3):
    """Passages that texts share, copies, null and empty and letterless texts, a long one, equal rows and null ids."""
    pick = random.Random(seed)
    word = lambda: pick.choice(["the", "the", "of", "And", "x1", "été", "𝒳", "end.", "no,"] + [f"w{pick.randrange(60)}"])
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (9, 12, 25, 40)]
    rows = []
    for i in range(60):
        parts = [text(pick.randrange(0, 30)) for _ in range(3)]
        parts.insert(pick.randrange(4), pick.choice(shared))
        rows.append((i, pick.choice([" ", "\n", "  \t"]).join(parts), pick.choice(["en", "en", None, "de"])))
    rows += [(60, None, None), (61, "", "en"), (62, " \x0b\x0c\r\n", "fr"), (63, "!!! ... ?", "en"), (64, rows[3][1], "en"), (65, rows[3][1], "en")]
    rows += [rows[5], rows[5], (None, rows[7][1], "de"), (None, rows[7][1], "de"), (66, "same " * 300, "en"), (67, text(9000), "en")]
    return rows


# Shared helpers -------------------------------------------------------------------

def test_slots_hold_every_key(spark):
    keys = [0, 1, -1, 63, 64, 2**62, -2**63, 5 << 40]
    bits = slot_bits(spark.createDataFrame([(k,) for k in keys + keys], "k long"), "k")
    assert in_bits(bits, np.array(keys, np.int64).view(np.uint64)).all()
    assert not in_bits(bits, np.array([2, 65, 1 << 30 | 77], np.uint64)).any()
    assert not slot_bits(spark.createDataFrame([], "k long"), "k").any()


def test_suffixes_of_a_task_are_merged_in_small_batches():
    rng = np.random.default_rng(2)
    blocks = [[rng.integers(1, 300, 1 << 16).astype(np.uint64) for _ in range(3)] for _ in range(8)]
    expected = collections.Counter(r for b in blocks for r in zip(*(c.tolist() for c in b)))
    next(phrases._merged([[c[:9] for c in b] for b in blocks], ["w1", "w2", "w3"]))  # what is loaded on first use is not counted
    tracemalloc.start()
    held = [[c.copy() for c in b] for b in blocks]
    first = next(phrases._merged(held, ["w1", "w2", "w3"]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first.num_rows == 1 << 16
    assert most < 36e6 and not held  # three columns of 4 MB; all at once took 68 MB
    held = [[c.copy() for c in b] for b in blocks]
    got = collections.Counter({r[:3]: r[3] for x in phrases._merged(held, ["w1", "w2", "w3"]) for r in zip(*(c.to_pylist() for c in x.columns))})
    assert got == expected


def test_long_texts_are_cut_between_words():
    data = np.frombuffer(b"ab cd  efg" * 50 + b"x" * 90 + b" y", np.uint8)
    places = np.array([0, len(data)])
    parts = list(cut(data, places, ~NOT_SPACE, 32))
    assert b"".join(d.tobytes() for d, _ in parts) == data.tobytes() and len(parts) > 10
    whole = words(data, places, NOT_SPACE)
    assert np.array_equal(np.concatenate([words(d, p, NOT_SPACE).hash for d, p in parts]), whole.hash)
    assert np.array_equal(word_hashes(data, places, NOT_SPACE)[0], whole.hash)


# 11 Phrases -----------------------------------------------------------------------

def plain_phrases(rows, least, most, inside):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if any(lang == o and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= inside * a for (o, q), b in found.items()):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:most])}


@pytest.mark.parametrize("least,most,inside,budget", [(2, 2000, 50, 1 << 22), (3, 40, 50, 800), (2, 25, 80, 250), (10, 2000, 50, 500)])
def test_phrases_match_counting(spark, least, most, inside, budget):
    rows = made_texts()
    got = phrases.collocations(table(spark, rows), least, most, inside, budget).collect()
    want = plain_phrases(rows, least, most, inside)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_phrases_of_nothing(spark):
    assert phrases.collocations(table(spark, [])).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None), (2, "", "en"), (3, ". . .", "en"), (None, "one two", None)])).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**9, 5 * 10**9, 6 * 10**9), (10**13, 10**13, 10**13), (7, 7, 3 * 10**12)], "a long, l long, r long")
    got = [r[0] for r in df.select(phrases._cut_score(df.a, df.l, df.r)).collect()]
    assert got == [1000000 * 16 * 10**18 // (30 * 10**18), 1000000, 1000000 * 49 // (21 * 10**12)]


def test_phrases_do_not_cross_pieces_of_a_long_text(spark):
    text = ("a b. c " * 30 + "d e\n") * 400
    rows = [(1, text, "en")]
    assert {tuple(r) for r in phrases.collocations(table(spark, rows)).collect()} == plain_phrases(rows, 10, 2000, 50)


# 13 Repeated passages ---------------------------------------------------------------

def plain_repeats(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    seen = collections.Counter(tuple(w[i:i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for (key, _, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept, gone))
    return out


@pytest.mark.parametrize("length,gram", [(35, 8), (10, 3), (10, 10), (5, 1), (6, 4)])
def test_repeats_match_brute_force(spark, length, gram):
    rows = made_texts(length)
    got = substring.without_repeats(table(spark, rows), length, gram).collect()
    want = plain_repeats(rows, length)
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, (w[:5] for w in want)))
    covered = {r["kept_sha256"]: {i for a in r["repeats"] for i in range(a["first"], a["last"] + 1)} for r in got}
    assert all(covered[w[3]] == w[5] for w in want if w[5] and w[4])
    short = substring.without_repeats(table(spark, rows), length, gram, with_text=False).collect()
    assert sorted(map(repr, map(tuple, short))) == sorted(map(repr, (tuple(r)[:4] for r in got)))


def test_repeats_that_cross_blocks_and_edges(spark, monkeypatch):
    pick = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    filler = lambda n: [f"f{pick.randrange(10**9)}" for _ in range(n)]
    rows = [(1, " ".join(passage), None), (2, " ".join(filler(100) + passage + filler(100)), None), (3, " ".join(passage[:35] + filler(3)), None),
            (4, " ".join(passage[:34] + filler(40)), None), (5, " ".join(filler(900) + passage[10:] + filler(2) + passage[:30]), None),
            (6, " ".join(passage[:20] + passage[20:40] + ["odd"] + passage[40:]), None)]
    monkeypatch.setattr(substring, "_BLOCK", 16)
    got = substring.without_repeats(table(spark, rows)).collect()
    assert {tuple(r)[:5] for r in got} == {w[:5] for w in plain_repeats(rows, 35)}
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 60, 2: 60, 3: 35, 4: 0, 5: 50, 6: 40}


def test_repeats_of_nothing(spark):
    assert substring.without_repeats(table(spark, [])).count() == 0
    got = substring.without_repeats(table(spark, [(None, None, None), (1, "", None), (1, "one two", None)]), with_text=False).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert {tuple(r) for r in got} == {(None, 0, 0, none), (1, 0, 0, none), (1, 2, 0, hashlib.sha256(b"one two").hexdigest())}
    with pytest.raises(ValueError):
        substring.without_repeats(table(spark, []), 5, 6)


# 12 Whitening -----------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "c", 2) for i, v in rows], "vec_id long, embedding array<float>, x string, n int, label string, component int")


def plain_whitening(rows, most=32):
    use = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1000000 for c in v] for _, v in use], object)
    n, s = len(x), x.sum(0)
    off = n * x - s
    y = off.astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-12 * e.sum()).sum()))
    return use, n, (off * off).sum(1), y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


@pytest.mark.parametrize("n,d,rank", [(200, 40, 40), (90, 64, 64), (50, 12, 5), (7, 20, 20), (3, 2, 2)])
def test_whitening_matches_dense_algebra(spark, n, d, rank):
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n, rank)) @ (rng.normal(size=(rank, d)) * 3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    if rank < d:  # whole numbers keep the rank
        rows = [(i, [float(round(c)) for c in np.round(base[i]) * 0 + np.round(rng.integers(-3, 4, rank)) @ np.eye(rank, d)]) for i in range(n)]
    rows += [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1)), (None, rows[1][1]), (1, rows[1][1])]
    use, count, deviation, z, explained = plain_whitening(rows)
    got = whitening.whiten(vectors(spark, rows)).collect()
    k = z.shape[1]
    assert len(got) == len(use) * k
    by = collections.defaultdict(list)
    for r in got:
        by[r["component"]].append(r)
    flip = {}
    for c in range(1, k + 1):
        assert abs(by[c][0]["explained"] / explained[c - 1] - 1) < 1e-8
        mine = sorted((repr(r["vec_id"]), r["whitened"]) for r in by[c])
        for sign in (1, -1):
            theirs = sorted((repr(i), sign * v) for (i, _), v in zip(use, z[:, c - 1]))
            if all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 for a, b in zip(mine, theirs)):
                flip[c] = sign
    gaps = np.abs(np.diff(explained)) > 1e-6
    assert all(c in flip for c in range(1, k + 1) if gaps[max(c - 2, 0):c].all())
    assert {(r["vec_id"], r["deviation"], r["n"]) for r in got} == {(i, int(v), count) for (i, _), v in zip(use, deviation)}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(5)]):
        out = whitening.whiten(vectors(spark, rows))
        assert out.count() == 0 and len(out.columns) == 7


def test_whitening_refuses(spark):
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="OverflowError|fit a long|exact sums"):
        whitening.whiten(vectors(spark, [(1, [1e16]), (2, [-1e16])])).collect()


@pytest.mark.parametrize("d,wanted,width,spectrum", [
    (300, 8, 40, lambda i: 1 / (1 + i)), (300, 8, 24, lambda i: 0.99**i), (120, 5, None, lambda i: 10.0**-i), (150, 6, None, lambda i: np.where(i < 9, 1.0, 0.5)),
    (64, 32, None, lambda i: 1 + 1e-3 * i), (40, 40, None, lambda i: np.where(i < 20, 1.0, 0.0))])
def test_eigenpairs_reach_rounding(d, wanted, width, spectrum):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = np.sort(np.asarray(spectrum(np.arange(d)), float))[::-1]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    calls = []
    values, axes = whitening.eigenpairs(lambda b: (calls.append(b.shape[1]), a @ b)[1], d, wanted, width=width)
    assert np.allclose(values, e[:wanted], rtol=0, atol=1e-12 * e[0])
    assert np.allclose(axes.T @ axes, np.eye(wanted), atol=1e-12)
    assert np.linalg.norm(a @ axes - axes * values, axis=0).max() < 1e-11 * e[0]
    assert len(calls) < 400


def test_minres_solves():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(20, 20))
    a = a + a.T
    right = np.c_[rng.normal(size=(20, 2)), np.zeros(20)]
    x = whitening.minres(lambda v: a @ v, right, 40)
    assert np.allclose(a @ x, right, atol=1e-6)
    short = whitening.minres(lambda v: a @ v, right, 5)
    assert np.linalg.norm(a @ short - right) < np.linalg.norm(right)
