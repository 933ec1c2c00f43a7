import random

import numpy as np
import pytest

from chronotaxa.llm import jaccard_join as J

from .brute import jaccard_components, roots


def rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    out = [None, "", " \n\t ", "one", "One  TWO", "one two", "a b c d e", "A b\tc d E", "ü a b c d", "Ü a b c d", "a\x0bb\x0cc d e"]
    for _ in range(40):
        out.append(" ".join(word() for _ in range(rng.randint(1, 80))))
    base = [word() for _ in range(150)]
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(60):
        out.append(" ".join(word() for _ in range(rng.randint(5, 40))) + " " + passage + " " + " ".join(word() for _ in range(rng.randint(0, 30))))
    out += [out[30]] * 30 + [" ".join([w] * 200) for w in ("x", "y", "x")]
    chain = [word() for _ in range(100)]
    for k in range(25):
        out.append(" ".join(chain))
        chain = chain[4:] + [word() for _ in range(4)]
    long = [word() for _ in range(1400)]
    for k in range(12):
        w = list(long)
        for _ in range(k * 6):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w[: 1400 - 25 * k]))
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("options", [{}, {"tile": 8, "small": 4, "part": 2}, {"heavy": 1, "small": 1}, {"part": 1, "tile": 16, "small": 8}])
def test_equals_brute_force(spark, options):
    data = rows()
    df = spark.createDataFrame([(i, t, -1, "z") for i, t in data], "doc_id long, text string, sid int, token string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(df, **options).collect()}
    assert got == jaccard_components(data)


def test_tiles_join_what_is_linked():
    rng = np.random.default_rng(0)
    base = np.arange(100)
    sets = [np.unique(np.where(rng.random(100) < 0.08, rng.integers(1000, 9000, 100), base)) for _ in range(80)]
    sid = np.arange(80)
    want = roots(range(80), [(a, b) for a in range(80) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))])
    assert roots(range(80), J.tile_links(sid, sid, np.full(80, 2), sets, 80)) == want
    some = rng.integers(0, 5, 80)
    side = np.arange(80) % 2
    allowed = [(a, b) for a in range(80) for b in range(a) if some[a] == some[b] or (side[a] != side[b] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])))]
    have = J.tile_links(sid, some, side, sets, 80) + [(a, b) for a in range(80) for b in range(a) if some[a] == some[b]]
    assert roots(range(80), have) == roots(range(80), allowed)


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted(tuple(r) for r in J.jaccard_classes(df).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert J.jaccard_classes(df.limit(0)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "other words stand in this one")], "doc_id long, text string")
    assert sorted((tuple(r) for r in J.jaccard_classes(df).collect()), key=str) == [(7, 2, 7), (None, 2, 7), (None, 2, None)]


def test_survivors_include_every_linked_row():
    rng = np.random.default_rng(2)
    sets = [np.unique(J.textkit.mix(np.where(rng.random(120) < rng.choice([0.02, 0.1, 0.6]), rng.integers(1000, 90000, 120), np.arange(120)).astype(np.uint64))) for _ in range(60)]
    sets += [np.unique(J.textkit.mix(np.arange(k, k + 1000 + 7 * k).astype(np.uint64))) for k in range(30)]
    n, sketch = np.array([len(s) for s in sets]), [J.parity_sketch(s) for s in sets]
    assert len({len(x) for x in sketch}) > 1
    keep = J.tile_survivors(np.arange(90), np.full(90, 2), n, np.zeros(90, int), sketch, 80)
    linked = {i for a in range(90) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])) for i in (a, b)}
    assert linked and linked <= set(np.flatnonzero(keep)) and not keep.all()


def test_overlaps_are_the_entries_of_the_product():
    rng = np.random.default_rng(4)
    rows = [rng.permutation(np.unique(rng.integers(0, 60, rng.integers(1, 50)))) for _ in range(40)]
    a, b = rng.integers(0, 40, 500), rng.integers(0, 40, 500)
    for step in (1, 100, 1 << 20):
        assert J.overlaps(rows, a, b, step).tolist() == [len(np.intersect1d(rows[i], rows[j])) for i, j in zip(a, b)]


def test_an_ngram_that_stands_once_in_each_of_many_partitions(spark):
    """It is seen as frequent however the rows are dealt, so its column is no row's first choice, and no task gets it whole."""
    word = lambda k: f"w{k}"
    data = [(k, " ".join([word(10 * k + x) for x in range(4)] + ["all", "of", "them", "share", "this"] + [word(10 * k + 4 + x) for x in range(4)])) for k in range(240)]
    for parts in (2, 240):
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(parts)
        counts = J._signatures(df, 5, 0, 4).where("token is not null").groupBy("token").agg(J.F.sum("hits").alias("hits")).orderBy(J.F.desc("hits")).limit(2).collect()
        assert 30 < counts[0].hits < 90 and counts[1].hits == 1
    token = np.array([counts[0].token]).view(np.uint64)
    rows = J._prefixes(df, 5, 0, 80, token, np.array([counts[0].hits * 4]), 16)
    assert max(r["count"] for r in rows.groupBy("token", "part").count().collect()) <= 16 + 16
    assert {r.doc_id: r.component_id for r in J.jaccard_classes(df, part=4, tile=16, small=8).collect()} == {k: k for k, _ in data}
