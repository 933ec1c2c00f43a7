import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronotaxa.llm import periodic_runs as R

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def smallest(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w, times=4, least=6):
    """Maximal stretches of each period, as defined."""
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        a = 0
        while a < n - q:
            if w[a] != w[a + q]:
                a += 1
                continue
            b = a
            while b < n - q and w[b] == w[b + q]:
                b += 1
            if b - a + q >= max(least, times * q) and smallest(w[a : b + q]) == q:
                out.append((a, b - a + q, q))
            a = b + 1
    return sorted(out)


def some(rng, n, k):
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        p = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
        at = rng.randint(0, len(w))
        w[at:at] = p * rng.randint(2, 7) + p[: rng.randint(0, len(p))]
    return w


@pytest.mark.parametrize("times, least", [(2, 2), (2, 6), (3, 6), (4, 6)])
def test_runs_equal_brute_force(times, least):
    rng = random.Random(times * 10 + least)
    met = 0
    for _ in range(500):
        w = some(rng, rng.randint(0, 40), rng.choice([1, 2, 3, 8]))
        want = brute(w, times, least)
        met += len(want)
        assert R.runs_of(w, times, least) == want, w
        assert R.text_runs(np.array(w, np.int64), times, least) == want, w
    assert met > 300


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_any_sequence(w):
    assert R.runs_of(w) == brute(w)


def test_long_runs_in_many_rows(monkeypatch):
    monkeypatch.setattr(R, "_ROW", 8)
    w = [*range(1000, 1050), *([*range(7)] * 90), *range(2000, 2100), *([1] * 300), 5, *([1, 2] * 200)]
    assert R.runs_of(w) == brute(w) and len(brute(w)) == 3


def test_ends_are_ordered(monkeypatch):
    monkeypatch.setattr(R, "_ROW", 4)
    rng = random.Random(1)
    xs = rng.sample(range(1000), 200)
    ends = R.Ends(xs[0])
    for k, x in enumerate(xs[1:], 1):
        so_far = sorted(xs[:k])
        before, after = max((y for y in so_far if y < x), default=None), min((y for y in so_far if y > x), default=None)
        assert ends.insert(x) == (before, after)
    assert list(ends) == sorted(xs) and ends.size == 200


def by_contract(doc_id, text):
    w = WORD.findall((text or "").encode())
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(listed), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def documents():
    rng = random.Random(9)
    words = ["a", "bb", "Ccc", "über", "日本", "\x1c", "\x85", " ", "x\x00y"]
    gaps = [" ", "\n", "\t", "  ", "\r\n", "\x0b"]
    texts = [None, "", " \n", "a", "a a a a a a", "a a a a a a", "ha " * 50, "la di da " * 20]
    texts += ["".join(words[x % len(words)] + rng.choice(gaps) for x in some(rng, rng.randint(0, 80), 9)) for _ in range(300)]
    return [*((k, t) for k, t in enumerate(texts)), (3, "a b"), (None, "b " * 9), (None, None)]


def test_digests(spark):
    rows = documents()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 20
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, runs string, start int").repartition(3)
    got = sorted((tuple(r) for r in R.digests(df).collect()), key=str)
    assert got == sorted((by_contract(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 60


def test_frames(spark):
    df = spark.createDataFrame([(1, "x ho ho ho  ho ho\nho y"), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id: [tuple(x) for x in r.runs] for r in R.find_runs(df).collect()} == {1: [(1, 6, 1)], 2: [], 3: []}
    assert {r.doc_id: r.text for r in R.collapse(df).collect()} == {1: "x ho y", 2: None, 3: ""}
    for f in (R.find_runs, R.collapse, R.digests):
        assert f(df.limit(0)).count() == 0


def test_texts_are_coded_in_pieces(monkeypatch):
    text = (" " * 30 + "über " * 20 + "x" * 50 + "\n").encode() * 3
    want = WORD.findall(text)
    for size in (3, 16, 1 << 20):
        monkeypatch.setattr(R, "PIECE", size)
        ids, words = R.coded(text)
        assert [words[i] for i in ids] == want and b"".join(R.joined(ids, words)) == b" ".join(want)
