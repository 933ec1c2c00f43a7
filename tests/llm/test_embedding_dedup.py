import numpy as np
import pytest

from chronotaxa.llm import embedding_dedup as E

from .brute import roots


def data(seed=0, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = [c + rng.normal(size=dim) * 0.8 for c in centres for _ in range(60)]
    for k in range(40):
        base = rng.normal(size=dim)
        rows += [base + rng.normal(size=dim) * s for s in rng.uniform(0, 0.4, 5)]
    hot = rng.normal(size=dim)
    rows += [hot + rng.normal(size=dim) * 0.2 for _ in range(150)] + [hot] * 30 + [hot * 2.5] * 3
    walk = rng.normal(size=dim)
    for _ in range(20):
        walk = walk + rng.normal(size=dim) * 0.22
        rows.append(walk)
    out = [np.asarray(r, dtype=np.float32).tolist() for r in rows]
    out += [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 0.0], [0.99, 0.01], [1e-30] * dim, [1e30] * dim]
    return [(i + 10, v) for i, v in enumerate(out)]


def brute(rows, threshold=0.95):
    unit = {}
    for i, v in rows:
        if v and None not in v and np.isfinite(v).all() and any(v):
            a = np.float32(v).astype(np.float64)
            a /= np.abs(a).max()
            unit[i] = a / np.sqrt(a @ a)
    ids = sorted(unit)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    r = roots(n, links)
    return {i: (n[i], r[i], r[i] == i) for i in n}


@pytest.mark.parametrize("options", [{"spread": None}, {"tile": 16, "sample": 64, "spread": None}])
def test_equals_brute_force(spark, options):
    rows = data()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, **options).collect()}
    assert got == brute(rows)


def test_probes_and_codes_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 32))
    x[1000:] = x[rng.integers(0, 1000, 2000)] + rng.normal(size=(2000, 32)) * 0.18
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = E.Index.fit(x[:500], 40, 0.95, None)
    own, probe = index.assign(x)
    code, missed = index.encode(x, own)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert len(i) > 1000 and (probe[i, own[j]] | probe[j, own[i]]).all()
    for k in range(0, len(i), 50):
        assert index.table_distances(x[i[k : k + 1]], own[j[k]], code[j[k : k + 1]])[0, 0] <= index.radius + missed[j[k]] + 1e-9
    assert probe.mean() < 0.9


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert E.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert tuple(E.near_duplicates(one).first()) == (1, 0, 1, True)


@pytest.mark.parametrize(("seed", "inner"), [(8, 64), (4, 12), (5, 6), (6, 3)])
def test_recall_of_the_default_probes(spark, seed, inner):
    if inner == 64:
        rows = data(seed=seed, dim=64)
    else:
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(2500, inner)) @ rng.normal(size=(inner, 64))
        x[2000:] = x[rng.integers(0, 2000, 500)] * 1.0 + rng.normal(size=(500, 64)) * 0.1 * inner**0.5
        rows = list(enumerate(np.float32(x).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df).collect()}
    assert all(got[i] <= want[i][0] for i in got)
    assert sum(n for n, _, _ in want.values()) > 500
    assert sum(got.values()) >= 0.99 * sum(n for n, _, _ in want.values())


def test_calibration_raises_the_reach(spark):
    """Links that lie along the planes' normals need more than the dimension suggests."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    x = np.concatenate([base + rng.normal(size=(40, 64)) * 0.02, base * 1.0]).repeat(20, axis=0)
    x = x + 0.15 * rng.uniform(-1, 1, (len(x), 1)) * x[rng.permutation(len(x))]
    rows = list(enumerate(np.float32(x).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df, spread=0.01, queries=400).collect()}
    assert sum(got.values()) >= 0.95 * sum(n for n, _, _ in want.values()) > 0


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.999, 0.01]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in E.near_duplicates(df).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
