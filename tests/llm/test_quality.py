import numpy as np
import pyarrow as pa

from chronotaxa.llm import quality as Q


def test_features_of_small_texts():
    x = Q.features(pa.array(["AB! ab\nab! x", None, "", "é é é"]))
    f = dict(zip(Q.FEATURES, x[0]))
    assert np.isclose(f["share_upper"], 2 / 12) and np.isclose(f["share_exclaim"], 2 / 12) and np.isclose(f["top_word"], 2 / 4) and np.isclose(f["upper_of_letters"], 2 / 7)
    assert (x[1] == x[2]).all() and dict(zip(Q.FEATURES, x[3]))["top_word"] == 1.0
    assert np.isfinite(x).all()


def test_features_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array([("word%d Ab\n" % (k % 7)) * k for k in range(40)])
    whole = Q.features(texts)
    monkeypatch.setattr(Q.textkit, "CHUNK", 64)
    assert np.allclose(whole, Q.features(texts))


def walk(forest, row):
    """One row, node by node."""
    out = forest.base
    for feature, above, leaf in zip(forest.feature, forest.above, forest.leaf):
        node = 0
        while node < len(feature):
            k = feature[node]
            node = 2 * node + (2 if np.searchsorted(forest.edges[k], row[k]) > above[node] else 1)
        out += leaf[node - len(feature)]
    return out


def test_forest_learns_and_flat_traversal_equals_walking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = Q.fit(x[:2000], y[:2000])
    assert np.mean((forest.score(x[2000:]) >= 0.5) == y[2000:]) > 0.9
    assert np.allclose(forest.raw(x[:50]), [walk(forest, r) for r in x[:50]])


def test_classifier_on_frames(spark):
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))
    docs = [(i, word(60) if i % 3 else "BUY!! NOW!! " * 30, None if i % 2 else "en") for i in range(600)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 600, 2)]
    docs += [(1000, None, "en"), (1001, "", "en"), (5, docs[5][1], "xx")]
    d = spark.createDataFrame([(*r, 0.0) for r in docs], "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels + [(7, None, 0)], "doc_id long, quality int, toxic int")
    rows = Q.classify(d, lab).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert len(held) > 100 and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert Q.classify(d.limit(0), lab).count() == 0
    assert {r.score for r in Q.classify(d, lab.limit(0)).collect()} == {0.5}
