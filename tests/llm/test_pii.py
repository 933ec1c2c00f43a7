import hashlib
import random
import re

import math
from collections import defaultdict

import pytest
import regex
import xxhash

from chronotaxa.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 12 <= len(only(s)) <= 19 and luhn(only(s)),
        "phone": lambda s: 9 <= len(only(s)) <= 15,
    }
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(zip(ok, (EMAIL, IP, CARD, PHONE))) for m in p.finditer(text) if ok[k](m.group())]
    return sorted(found)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()


def cases():
    rng = random.Random(5)
    parts = ["a@b.co", "a@b.c_d@e.f", "x@", "@y.z", "1.2.3.4", "300.1.2.3.4", "1.2.3.999.1.2.3.4", "001.2.3.0255", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "4918187128635271", "+1 (578) 555-6437", "+49 30 1234567890123", "+1", "++1 555 123 4567", "ü", "日本", "😀", " ", "\n", "-", ".", "5", "12", "a", "_", "%", "é@b.de", "0000000000000000"]
    out = [None, "", " ", "x" * 50_000, "1" * 30_000, "a@" * 5_000, "1." * 5_000, "+1(" * 3_000, "a@b" + ".c" * 8_000, "1 " * 8_000]
    out += ["".join(rng.choice(parts) + rng.choice(["", " ", "", ","]) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    return out


def test_base_spans_equal_brute_force(spark):
    texts = cases()
    df = spark.createDataFrame([(i, t, "extra", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, pii_base int").select("doc_id", "text", "spans")
    for row in pii.detect(df, min_contexts=10**6).collect():
        want = brute(texts[row.doc_id])
        assert row.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in want), texts[row.doc_id][:200]
        assert row.base_sha256 == digest(want)
        for kind in pii.KINDS:
            assert row[f"n_{kind}"] == sum(x[3] == kind for x in want)


WORD = regex.compile(r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}]*+(?!\p{N})")


def names(kind, value):
    if kind == "email":
        value = value.lower()
        return ["email:" + value, "host:" + value.split("@")[1], "holder:" + value.split("@")[0]]
    value = re.sub("[^0-9.]", "", value)
    if kind == "ip":
        return ["ip:" + value, "net:" + value.rsplit(".", 1)[0]]
    return ["card:" + value, "issuer:" + value[:6]] if kind == "card" else ["phone:" + value, "area:" + value[:-7]]


def xx(text):
    """Spark's xxhash64 of a text: contexts are told apart, and a row's least is taken, by it."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def beside(text, s, e, reach):
    before = regex.sub(r"^\S*", "", text[s - reach : s]) if s > reach else text[:s]
    after = regex.sub(r"\S*$", "", text[e : e + reach], count=1) if len(text) > e + reach else text[e:]
    return " | ".join(re.sub(r"\s+", " ", re.sub(r"\S*[@0-9]\S*", " ", x.lower())) for x in (before, after))


def brute_statistics(rows, window, near, contexts):
    """{(entity, term): (n_te, n_t, n_e)}, and each row's base spans, words and entities."""
    held, n_t, seen = [], defaultdict(int), defaultdict(dict)
    for k, (_, text) in enumerate(rows):
        text = text or ""
        spans, whole = brute(text), set(WORD.findall(EMAIL.sub(" ", text).lower()))
        for t in whole:
            n_t[t] += 1
        entities = defaultdict(set)
        for s, _, e, kind in spans:
            for entity in [*names(kind, text[s:e]), "kind:" + kind]:
                entities[entity].add(xx(beside(text, s, e, near)))
                for t in whole if entity == "kind:" + kind else set(WORD.findall(beside(text, s, e, window))):
                    seen[entity, t][k] = entities[entity]
        held.append((spans, whole, entities))
    n_e = defaultdict(int)
    for _, _, entities in held:
        for entity in entities:
            n_e[entity] += 1
    return {p: (len(at), n_t[p[1]], n_e[p[0]]) for p, at in seen.items() if len({min(c) for c in at.values()}) >= contexts}, held


def ratio(n_te, n_t, n_e, n):
    return math.log2(n_te * n / (n_t * n_e)) / math.log2(n / n_e) if n_e < n else -1.0


def sentences(seed):
    """Short texts whose words and entities are drawn so that some words lean towards some entities."""
    rng = random.Random(seed)
    filler = ["über", "and", "the", "cafe\u0301", "maps", "hats", "of", "o", "sehrlangeswort" * 5, "a1b", "it's"]
    teams = [("ann", "x@one.org", "nova"), ("bob", "y@one.org", "nova"), ("eve", "z@two.net", "orbit"), ("kim", "10.1.2.3", "delta"), ("lee", "10.1.2.77", "delta"), ("max", "+1 (212) 555-0100", "east"), ("ned", "4111 1111 1111 1111", "visa")]
    out = [(None, None), (None, ""), (7, "x"), (7, "x")]
    for k in range(300):
        words = [rng.choice(filler) for _ in range(rng.randint(3, 40))]
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            name, entity, group = rng.choice(teams)
            at = rng.randrange(len(words))
            words[at:at] = [w for w in (name, entity, group, rng.choice(filler)) if w == entity or rng.random() < 0.8]
        if rng.random() < 0.05:
            words.append(rng.choice(teams)[0])
        out.append((k, " ".join(words)))
    return out + out[20:24] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_statistics_and_terms_equal_brute_force(spark, seed):
    rows = sentences(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    options = {"window": 40, "near": 16, "min_contexts": 3, "generalise_at": 0.7, "remove_at": 0.9}
    pairs, held = brute_statistics(rows, 40, 16, 3)
    stage = pii.Stage(spark, "test")
    from pyspark.sql import functions as F

    plain = stage.write(pii.with_spans(df.withColumn("row", F.monotonically_increasing_id()), "text", "pii_base"))
    got = {(r.entity, r.term): (r.n_te, r.n_t, r.n_e) for r in pii.disclosures(plain, *pii.evidence(plain, stage, 40, 16), stage, 3, 0.7).collect()}
    telling = {p: r for p, n in pairs.items() if (r := ratio(*n, len(rows))) >= 0.7}
    assert got == {p: pairs[p] for p in telling}
    assert {e.split(":")[0] for e, _ in telling} >= {"kind", "host", "net", "email"}
    want = []
    for (doc_id, text), (spans, whole, entities) in zip(rows, held):
        best = {t: max((telling.get((e, t), -1) for e in entities), default=-1) for t in whole}
        terms = [(m.start(), 5 if best[m.group().lower()] >= 0.9 else 4, m.end(), "term") for m in WORD.finditer(text or "") if best.get(m.group().lower(), -1) >= 0.7]
        terms = [x for x in terms if not any(b[0] < x[2] and x[0] < b[2] for b in spans)]
        want.append((doc_id, ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans + terms))))
    got = [(r.doc_id, r.spans) for r in pii.detect(df, **options).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum("term" in s for _, s in want) > 20


@pytest.fixture(scope="module")
def telling(spark):
    """A name that only ever stands beside one address, in different sentences; filler that stands everywhere."""
    things = ["maps", "hats", "cups", "pens", "keys", "jars"]
    rows = [(i, f"please write about {w} to zaphod at zb@ship.org today about {w}") for i, w in enumerate(things)]
    rows += [(100 + i, f"please write about {things[i % 6]} to nobody at all today") for i in range(60)]
    rows += [(200 + i, "identical copy says trillian holds tm@ship.org for ever") for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_telling_terms_are_found_and_copies_are_one_piece_of_evidence(telling):
    rows = {r.doc_id: r.spans for r in pii.detect(telling).collect()}
    assert "term:27:33" in rows[0] and rows[0].count("term") == 1
    assert rows[100] == ""
    assert "term" not in rows[200]


def test_sanitised_text(telling, spark):
    rows = {r.doc_id: r.text for r in pii.sanitise(telling).collect()}
    assert rows[0] == "please write about maps to  at [EMAIL] today about maps"
    assert rows[100] == "please write about maps to nobody at all today"
    one = spark.createDataFrame([(1, None), (2, ""), (3, "é 1.2.3.4 +1 (578) 555-6437!")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.sanitise(one).collect()} == {1: None, 2: "", 3: "é [IP] [PHONE]!"}


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, entity string, term string, n_e int, pii_base string, pii_spans int, pii_row int")
    assert pii.detect(none).count() == 0
    assert pii.sanitise(none).columns == none.columns
    row = spark.createDataFrame([(None, "a@b.co", "e", "t", 1, "x", 2, 3)], none.schema)
    assert tuple(pii.sanitise(row).first()) == (None, "[EMAIL]", "e", "t", 1, "x", 2, 3)


def test_terms_that_overlap_no_base_span(spark):
    rng = random.Random(2)
    rows = []
    for n in (0, 1, 3, 255, 256, 257, 1500):
        base, terms, at = [], [], 0
        for _ in range(n):
            at += rng.randint(1, 9)
            end = at + rng.randint(1, 12)
            if rng.random() < 0.5:
                terms.append((at, rng.choice((4, 5)), end, "term"))
                at = end
            for _ in range(rng.choice((0, 0, 1, 2))):
                start = at + rng.randint(-6, 6)
                base.append((start, rng.randint(0, 3), start + rng.choice((1, 5, 400)) if rng.random() < 0.1 else start + rng.randint(1, 8), "email"))
        rows.append((sorted(base + terms),))
    df = spark.createDataFrame(rows, f"b {pii._SPANS}")
    for (b,), r in zip(rows, df.selectExpr("b", f"{pii._free('b')} as kept").collect()):
        base = [s for s in b if s[1] < 4]
        assert [tuple(s) for s in r.kept] == [s for s in b if s[1] < 4 or not any(x[0] < s[2] and s[0] < x[2] for x in base)]


def test_cuts_of_pieces(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab\n é😀") for _ in range(20_000))
    cuts = [(rng.randint(0, 20_000), rng.choice((0, 1, 300, 4096, 9000))) for _ in range(200)] + [(4096, 4096), (4095, 2), (0, 20_000), (20_000, 5)]
    df = spark.createDataFrame([(text, s, n) for s, n in cuts], "text string, s int, n int").selectExpr("s", "n", f"{pii._PIECES} as pieces")
    for r in df.selectExpr("s", "n", f"{pii._cut('pieces', 's', 'n')} as got").collect():
        assert r.got == text[r.s : r.s + r.n]


def test_a_long_text_of_many_spans(spark):
    """1.3 MB with 60,000 spans: what is rebuilt for each span would take hours if it were the whole text or the whole array."""
    rng = random.Random(4)
    text = " ".join(rng.choice((f"a{i}@b{i % 7}.org", f"10.0.{i % 250}.{i % 251}", "plain words", "+49 30 1234567")) for i in range(80_000))
    df = spark.createDataFrame([(1, text), (2, "a@b.org"), (3, None)], "doc_id long, text string")
    want = brute(text)
    assert len(want) > 55_000
    row = pii.detect(df).where("doc_id = 1").collect()[0]
    assert row.base_sha256 == digest(want)
    pieces, at = [], 0
    for s, _, e, k in want:
        if s >= at:
            pieces += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    clean = pii.sanitise(df, min_contexts=10**6).where("doc_id = 1").collect()[0].text
    assert clean == "".join(pieces) + text[at:]
