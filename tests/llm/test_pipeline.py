"""run() against brute force, and edge cases of the stages."""

import random
from pathlib import Path

import pytest
import sentencepiece

import corpus_pipeline as P
from chronotaxa.llm import sentencepiece_codec

from .brute import jaccard_components
from .test_pii import brute as pii_brute

pytestmark = pytest.mark.skipif(not Path(sentencepiece_codec.tokenizer_path()).exists(), reason="no tokenizer files")

LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    parts = {"en": ["th", "ing", "on", "er", "ea", "sh"], "fr": ["eau", "oi", "que", "é", "tion", "ch"]}
    word = lambda k: "".join(rng.choice(parts[k]) for _ in range(rng.randint(2, 5)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    bench = [(k, text("en", 30)) for k in range(6)]
    rows, bad = [], set()
    for i in range(160):
        k = rng.choice(["en", "fr"])
        body = text(k, rng.randint(20, 120))
        if i % 8 == 1 and i > 1:
            body = rows[i - 1][1]
        if i % 8 == 3:
            w = rows[i - 1][1].split(" ")
            w[rng.randrange(len(w))] = word(k)
            body = " ".join(w)
        if i % 16 == 5:
            body = body + " " + bench[i % 6][1] + " " + text(k, 20)
            bad.add(i)
        if i % 16 == 7:
            body = body + f" a{i}@mail.org 10.0.0.{i} 4111 1111 1111 1111 " + text(k, 3)
        rows.append((i, body, k, "s", len(body)))
    rows += [(500, None, "en", "s", 0), (501, "", "en", None, 0), (502, "12 !! 34", None, "s", 8)]
    return rows, bench, bad


def sanitise(text):
    out, at = [], 0
    for start, _, end, kind in pii_brute(text):
        if start >= at:
            out += [text[at:start], LABEL[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_run_equals_brute_force(spark, tmp_path):
    rows, bench, bad = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if r[0] < 500]
    classes = jaccard_components([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if classes[r[0]][1] == r[0] and r[0] not in bad]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.tokenizer_path())
    want = {r[0]: sp.encode(sanitise(r[1])) for r in kept}
    got = {r.doc_id: r.ids for r in P.run(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert got == want


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], SCHEMA)
    few = spark.createDataFrame([(1, "same words here and there now", "en", "s", 29)] * 3 + [(2, None, None, None, None)], SCHEMA)
    for docs, counts in ((none, [0] * 4), (few, [3, 1, 1, 1])):
        for (_, step), n in zip(P.STAGES[:-1], counts):
            docs = step(spark, docs, str(tmp_path))
            assert docs.columns == none.columns and docs.count() == n
        assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() == counts[-1]


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    """Rows are documents: different texts of one id stay, copies without an id go, leaks without an id go."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item, a, b, c, d = (text(30) for _ in range(5))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(7, a, "x"), (7, b, "x"), (None, c, "x"), (None, c, "x"), (3, d, "y"), (None, d, "z"), (None, f"{text(10)} {item} {text(10)}", "w"), (9, "", "e"), (9, None, "n"), (2**40, "x y " * 20_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    one = P.one_of_each_group(spark, docs, str(tmp_path))
    got = [(r.doc_id, r.text, r.row) for r in one.collect()]
    assert one.columns == docs.columns
    want = [r for k, r in enumerate(rows) if k not in (3, 5)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    left = [tuple(r) for r in P.no_benchmark(spark, one, str(tmp_path)).collect()]
    assert sorted(map(str, left)) == sorted(str(r) for r in want if r[2] != "w")
