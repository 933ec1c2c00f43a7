from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from chronotaxa.llm import decontaminate as D


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        assert D.lcs(a, b) == slow_lcs(a.tolist(), b.tolist())


def corpus():
    rng = np.random.default_rng(4)
    vocab = np.array(["w" + "".join(rng.choice(list("abcdefghij"), 4)) for _ in range(3000)])
    p = 1 / np.arange(1, 3001)
    p /= p.sum()
    text = lambda n: [str(x) for x in rng.choice(vocab, n, p=p)]
    items = [text(rng.integers(18, 50)) for _ in range(25)]
    docs, want = [], {}
    for i in range(400):
        w = text(rng.integers(10, 400))
        if i % 10 == 0:
            k = int(rng.integers(25))
            body = list(items[k])
            if i % 20 == 0:  # a paraphrase: some words changed, some added, the answer kept
                for _ in range(len(body) // 6):
                    body[rng.integers(len(body) - max(3, len(body) // 5))] = "other"
                body.insert(3, "extra")
            cut = int(rng.integers(len(w)))
            w[cut:cut] = [x.upper() + "," if i % 3 == 0 else x for x in body]
            want[i] = k
        docs.append((i, " ".join(w)))
    return docs, [(100 + k, " ".join(t) + ".") for k, t in enumerate(items)], want


def brute(docs, bench, s):
    """Every stretch of every document, without retrieval."""
    items = D.Items.of([i for i, _ in bench], pa.array([t for _, t in bench]))
    out = set()
    for i, text in docs:
        for _, _, words, _ in D.content_words(pa.array([text], pa.string())):
            for k, item in enumerate(items.words):
                share, answer, _ = D.best_stretch(item, words, s) if len(item) else (0, 0, 0)
                if share >= s.covered or (share >= s.paraphrased and answer >= s.answered):
                    out.add((i, items.ids[k]))
    return out


def test_finds_what_brute_force_finds(spark):
    docs, bench, want = corpus()
    docs += [(900, None), (901, ""), (902, "one two"), (903, bench[3][1]), (903, bench[3][1])]
    d = spark.createDataFrame([(*r, "x", 0) for r in docs], "doc_id long, text string, item_id string, share int").repartition(4)
    b = spark.createDataFrame([*bench, (500, None), (501, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()}
    planted = {(i, 100 + k) for i, k in want.items()} | {(903, 103)}
    assert planted <= got
    assert got <= brute(docs, bench, D.Settings()) | planted
    small = {(r.doc_id, r.item_id) for r in D.leaks(d, b, D.Settings(block=10)).collect()}
    assert small == got
    assert D.leaks(d.limit(0), b).count() == 0 and D.leaks(d, b.limit(0)).count() == 0


def test_latent_space_is_that_of_the_svd(spark):
    docs, bench, _ = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    items = D.Items.of([i for i, _ in bench], pa.array([t for _, t in bench]))
    n, df = D.passage_frequencies(d, items, 64)
    idf = np.log((n + 1) / (df + 1))
    rows = []
    for _, t in docs:
        for k, p, w, c in D.passages(items, pa.array([t]), 64):
            m = np.zeros((k, len(idf)))
            m[p, w] = idf[w] * c
            rows.append(m)
    a = np.concatenate(rows)
    a = a[a.any(axis=1)]
    a /= np.linalg.norm(a, axis=1)[:, None]
    assert n == len(np.concatenate(rows)) and (df == (np.concatenate(rows) > 0).sum(0)).all()
    s = np.linalg.svd(a, compute_uv=False)
    v = D.latent_space(d, items, idf, D.Settings(rank=10, extra=300))
    sizes = 1 / np.linalg.norm(v, axis=0)
    assert np.allclose(sizes, s[:10], rtol=0.1)
    kept = np.linalg.norm(a @ (v * sizes).astype(float)) ** 2
    assert kept > 0.85 * (s[:10] ** 2).sum()


def test_leaks_are_found_whatever_their_cosine(spark):
    docs, bench, want = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).cache()
    b = spark.createDataFrame(bench, "item_id long, text string")
    planted = {(i, 100 + k) for i, k in want.items()}
    for s in (D.Settings(cosine=2.0), D.Settings(rank=3, extra=0, seed=1), D.Settings(rank=3, extra=0, seed=2)):
        assert planted <= {(r.doc_id, r.item_id) for r in D.leaks(d, b, s).collect()}


def test_shared_words_of_windows():
    docs, bench, _ = corpus()
    items = D.Items.of([i for i, _ in bench], pa.array([t for _, t in bench]))
    items = items.without_common(np.zeros(len(items.vocabulary), np.int64), 100, D.Settings())
    (_, _, words, _), = D.content_words(pa.array([docs[0][1]]))
    items = D.Block.cut(items, 0, len(bench), D.Settings())
    at, number = items.hits(words)
    got = {(int(w), int(k)): int(n) for w, k, n in zip(*items.shared(at // 16, number))}
    for w in range(-1, len(words) // 16 + 1):
        part = words[max(0, 16 * w) : 16 * w + 32]
        for k, item in enumerate(items.words):
            assert got.get((w, k), 0) == np.isin(part, item).sum()


def plain_leaks(docs, bench, covered=0.7, paraphrased=0.5, answered=0.8, stretch=1.25):
    """Plain words, plain dynamic programming, every stretch."""
    import re
    from collections import Counter

    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    out = set()
    for i, text in docs:
        words = split(text)
        for k, item in ((k, split(t)) for k, t in bench):
            size, want = max(len(item), int(stretch * len(item))), Counter(item)
            for at in range(max(1, len(words) - size + 1)):
                part = words[at : at + size]
                if sum((want & Counter(part)).values()) < paraphrased * len(item):
                    continue
                share = slow_lcs(item, part) / len(item)
                end = item[-max(3, -(-len(item) // 5)) :]
                if share >= covered or (share >= paraphrased and slow_lcs(end, part) / len(end) >= answered):
                    out.add((i, k))
                    break
    return out


def test_recall_of_reworded_passages(spark):
    """At every rate of replaced, dropped and added words, most of what a plain search finds is found, and nothing else."""
    _, bench, _ = corpus()
    rng = np.random.default_rng(9)
    vocab = [w for _, t in bench for w in t.strip(".").split()]
    docs = []
    for i in range(300):
        body = bench[i % 25][1].strip(".").split()
        for _ in range(int(len(body) * rng.uniform(0, 0.5))):
            k = int(rng.integers(len(body)))
            body[k : k + 1] = [[], ["new"], [body[k], "more"]][i % 3]
        around = [str(x) for x in rng.choice(vocab, 60)]
        docs.append((i, " ".join(around[:30] + body + around[30:])))
    want = plain_leaks(docs, bench)
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(want) > 200 and got <= want
    assert len(got & want) >= 0.95 * len(want), len(got & want) / len(want)


def test_nearest_equals_the_whole_product():
    rng = np.random.default_rng(1)
    unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1)[:, None])(rng.normal(size=(n, 5)).astype(np.float32))
    w, t = unit(900), unit(9000)
    assert (np.stack(D.nearest(w, t, 0.7)) == np.stack(np.nonzero(w @ t.T >= 0.7))).all()
    assert len(D.nearest(w, t[:0], 0.7)[0]) == 0 and len(D.nearest(w[:0], t, 0.7)[0]) == 0


def without_word_index(monkeypatch):
    cut = D.Block.cut.__func__

    def none(cls, *args):
        block = cut(cls, *args)
        return replace(block, least=np.full(len(block.ids), 1 << 40))

    monkeypatch.setattr(D.Block, "cut", classmethod(none))


def test_cosine_alone_finds_nine_in_ten(spark, monkeypatch):
    docs, bench, want = corpus()
    without_word_index(monkeypatch)
    planted = {(i, 100 + k) for i, k in want.items()}
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert len(got & planted) >= 0.9 * len(planted)


def test_synonyms_that_share_no_kept_word_are_found_by_cosine_only(spark):
    """Each topic has words R and S that stand together in the corpus; an item has R, its leak has S instead, between the same common words."""
    rng = np.random.default_rng(3)
    letters = "abcdefghijklmnopqrst"
    glue = [f"glue{a}{b}" for a in letters for b in "xyz"]
    rare = lambda side, k: [f"{side}{letters[k]}{x}" for x in letters[:9]]
    mixed = lambda words, extra: [x for a, b in zip([words[i : i + 3] for i in range(0, len(words), 3)], extra) for x in (*a, b)]
    bench, docs = [], []
    for k in range(20):
        order = [str(x) for x in rng.permutation(glue)[:27]]
        bench += [(k, " ".join(mixed(order, rare("r", k)))), (100 + k, " ".join(rare("s", k)))]
        docs.append((k, " ".join(mixed(order, rare("s", k)))))
        for i in range(6):
            both = [str(x) for x in rng.permutation(rare("r", k) + rare("s", k))[:16]]
            docs.append((1000 + 10 * k + i, " ".join(both)))
    docs += [(5000 + i, " ".join(map(str, rng.permutation(glue)))) for i in range(400)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(bench, "item_id long, text string")
    pairs = lambda s: {(r.doc_id, r.item_id) for r in D.leaks(d, b, s).collect() if r.item_id < 100}
    want = {(k, k) for k in range(20)}
    assert want <= plain_leaks(docs[:140], bench)
    assert not want & pairs(D.Settings(rank=20, rarest=8, cosine=2.0))
    assert pairs(D.Settings(rank=20, rarest=8)) & want == want


def test_a_benchmark_of_too_many_words_is_refused(spark):
    docs, bench, _ = corpus()
    with pytest.raises(ValueError, match="most_words"):
        D.leaks(spark.createDataFrame(docs[:5], "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), D.Settings(most_words=100))
