import numpy as np
import pyarrow as pa
import pytest

from chronotaxa.llm import language_id as L

WORDS = {
    "en": "the and that with have this from they would there their what about which when make like time just know people into year good some could them see other than then now look only come over think also back after use two how our work first well way even new want because any these give day most".split(),
    "de": "der die und nicht sich auch werden haben einer ich mit dem dass sie ist den von auf für als noch nach wie über einen zwischen schon wenn habe seine mehr können durch wieder gegen vom sehr jahr zeit doch kann müssen ohne sein während unter immer".split(),
    "fr": "les des est dans que pour qui sur pas plus par avec tout faire son mettre autre mais nous comme leur bien vous même elle après deux sans peut aussi être très où première jusqu'à depuis déjà toujours chaque entre homme jour monde année".split(),
}


def corpus(n=240):
    rng = np.random.default_rng(3)
    langs = list(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 3]], 40)), langs[i % 3]) for i in range(n)]


def test_grams_stay_inside_rows():
    a = pa.array(["Ab, c", None, "x", "ABCD"])
    (_, _, g, first, letter), = L.gram_rows(a)
    text = lambda k: bytes([(int(k) >> s) & 255 for s in (24, 16, 8, 0)])
    rows = [[text(k) for k in g[first[i] : first[i + 1]]] for i in range(4)]
    assert letter.tolist() == [True, False, True, True]
    assert rows == [[b" ab "], [], [], [b" abc", b"abcd", b"bcd "]]


def test_no_false_negatives_and_exact_masks(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    model = L.fit(df, share=0.0)
    assert sorted(model.languages) == ["de", "en", "fr"]
    for _, text, lang in corpus(30):
        (_, _, g, _, _), = L.gram_rows(pa.array([text]))
        assert ((model.masks(g)[:, 0] >> model.languages.index(lang)) & 1).all()


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus() + [(1000, None, "en"), (1001, "", "en"), (1002, "12 + 34!", "en"), (1003, "Ω", None), (1004, "the and that with have " * 9000, None), (1, corpus()[1][1], "de")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert len(held) > 30 and np.mean([r.lang_pred == corpus()[r.doc_id][2] for r in held]) == 1.0
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred in WORDS and by[1004].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(none).count() == 0
    only = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert L.identify(only).first().lang_pred == "und"


def test_no_language_crowds_out_another(spark):
    rng = np.random.default_rng(8)
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(1500)]
    rows = [(i, " ".join(rng.choice(junk, 300)), "zz") for i in range(300)] + [(1000 + i, " ".join(rng.choice(WORDS["de"], 40)), "de") for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = L.identify(df).where("doc_id >= 1000").collect()
    assert all(r.lang_pred == "de" and r.support > 0.9 for r in got)
    assert L.keep_known(df, 0.2).where("doc_id >= 1000").count() == 24


def test_many_labels_and_a_small_table(spark):
    rows = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{k}" for k in "abcdef"), f"l{i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 64 labels"):
        L.identify(df, languages=64)
    wide = spark.createDataFrame([(1, " ".join(a + b + c for a in "abcdefghijklm" for b in "nopqrstuvwxyz" for c in "aeiou"), "l")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="room is 1000"):
        L.fit(wide, room=1000)
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    got = L.identify(df, slots=1 << 10, room=1 << 10).collect()
    assert np.mean([r.lang_pred == corpus()[r.doc_id][2] for r in got]) > 0.9
    nameless = spark.createDataFrame([(None, "the and that", "en")], "doc_id long, text string, lang string")
    assert tuple(L.identify(nameless).select("doc_id", "held_out", "lang_pred").first()) == (None, False, "und")


def test_thousands_of_labels_are_all_learned(spark):
    """More than 4096 labels, each with words of its own, are learned and told apart."""
    word = lambda k: "".join(chr(97 + (k // 26**j) % 26) for j in range(3))
    rows = [(k, f"{word(k)}q{word(k)}z {word(k)}", f"l{k:04}") for k in range(4200)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 4200
    some = rows[::97] + rows[-3:]
    pred, _, _ = L.judge(model, pa.array([r[1] for r in some]))
    assert pred == [r[2] for r in some]


def brute(train, texts, share=0.3):
    """Exact n-gram sets instead of filters."""
    def grams(text):
        low = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode())
        low = b" " + low + b" "
        return [g for k in range(len(low) - 3) if b"  " not in (g := low[k : k + 4])]

    from collections import Counter

    rows, counts = Counter(lang for _, lang in train), {}
    for text, lang in train:
        counts.setdefault(lang, Counter()).update(grams(text))
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = {}
    for r in rate.values():
        for g, x in r.items():
            most[g] = max(most.get(g, 0), x)
    order = sorted(rows, key=lambda k: (-rows[k], k))
    out = []
    for text in texts:
        g = grams(text)
        c = [sum(x in rate[k] and rate[k][x] >= share * most[x] for x in g) for k in order]
        top, second = sorted(c, reverse=True)[:2]
        out.append((order[c.index(top)], top / (top + second) if top else 0.0, top / len(g)))
    return out


def test_equals_exact_sets(spark):
    rng = np.random.default_rng(6)
    mixed = [(500 + i, " ".join(rng.choice(WORDS["en"] + WORDS["fr"] + WORDS["de"], 12)), None) for i in range(80)]
    rows = corpus(120) + mixed
    from zlib import crc32

    train = [(t, k) for i, t, k in rows if k and crc32(str(i).encode()) % 4 != 2]
    want = brute(train, [t for _, t, _ in rows])
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for (i, _, _), (lang, score, support) in zip(rows, want):
        assert (got[i].lang_pred == lang or abs(score - 0.5) < 0.002) and abs(got[i].score - score) < 0.01 and abs(got[i].support - support) < 0.01
