import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from chronotaxa.llm import license_scan as L

#: What the plain version can be held against in reasonable time.
SHORT = [x for x in L.default_templates() if len(x[1]) < 3000]



def words(text):
    return re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", "".join(c.lower() if c < "\x80" else c for c in text)).split()


def grams(w):
    return Counter(zip(w, w[1:]))


def brute(text, templates, t):
    """Hits of distinct units: lines, paragraphs, the whole text, as runs of words."""
    text = text or ""
    lines, at, units = text.split("\n"), 0, []
    spans = []
    for line in lines:
        n = len(words(line))
        spans.append((at, at + n))
        at += n
    units += spans
    start, blank = 0, False
    paragraphs = []
    for lo, hi in spans:
        if lo == hi and lo > start:
            paragraphs.append((start, lo))
            start = lo
    units += [*paragraphs, (start, at), (0, at)]
    every, hits = words(text), []
    for lo, hi in dict.fromkeys(u for u in units if u[1] - u[0] > 1):
        mine, found = grams(every[lo:hi]), []
        for name, body in templates:
            other = grams(words(body))
            dice = 2 * (mine & other).total() / (mine.total() + other.total())
            if dice >= t:
                found.append((-dice, name))
        if found:
            hits.append((min(found)[1], round(-min(found)[0], 9)))
    return sorted(hits)


def texts():
    rng = random.Random(7)
    pool = [x for _, x in SHORT] + ["some other line of words", "", "", "licensed under", "Änderung ©  2020"]
    out = [None, "", "\n\n", "MIT", L.TEXTS["MIT"], L.TEXTS["ISC"].upper().replace(" ", "\n"), "x\n\n" + L.TEXTS["Apache-2.0"].replace(". ", ".\n") + "\n\ny z"]
    for _ in range(150):
        w = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool).split(" ")
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(["the", "word", ""])
            w.append(" ".join(line))
        out.append("\n".join(w))
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_equals_brute_force(threshold):
    data, templates = texts(), SHORT
    got = L.scan_column(pa.array(data), L.Templates.of(templates, threshold))
    for text, hits in zip(data, got):
        assert sorted((k, round(d, 9)) for k, d in hits) == brute(text, templates, threshold), text


def test_frames(spark):
    rows = [(1, "Hello.\nReleased under the MIT License.\nBye."), (2, None), (2, ""), (3, "Licensed under CC BY-NC 4.0."), (4, "word " * 40_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, best string")
    got = sorted((r.doc_id, r.n_hits, r.licenses, r.best) for r in L.scan(df).collect() if r.doc_id != 2)
    assert got == [(1, 1, "MIT", "MIT"), (3, 1, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (4, 0, "", None)]
    assert L.scan(df).count() == 5 and L.scan(df.limit(0)).count() == 0


def best_spans(text, templates, t):
    """Licences of which any run of words reaches the threshold."""
    every, out = words(text), set()
    for lo in range(len(every)):
        for hi in range(lo + 2, len(every) + 1):
            mine = grams(every[lo:hi])
            out |= {name for name, body in templates if 2 * (mine & grams(words(body))).total() >= t * (mine.total() + grams(words(body)).total())}
    return out


def test_spans_are_those_of_all_runs_of_words():
    templates = [("MIT", "Released under the MIT License."), ("ISC", "Distributed under the terms of the ISC License."), ("A", "one two three four five six seven one two three")]
    rng, pool = random.Random(5), "released under the mit isc license distributed terms of one two three four five six seven".split()
    for _ in range(150):
        text = " ".join(" ".join(words(rng.choice(templates)[1])[rng.randint(0, 2) :]) if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(1, 12)))
        found = L.scan_column(pa.array(["x y", text]), L.Templates.of(templates, 0.85), spans=True)
        assert not found[0] and {k for k, _ in found[1]} <= best_spans(text, templates, 0.85)
        for one in templates:
            found = L.scan_column(pa.array([text]), L.Templates.of([one], 0.85), spans=True)
            assert {k for k, _ in found[0]} == best_spans(text, [one], 0.85)


def test_licences_inside_longer_texts():
    templates = L.Templates.of(SHORT, 0.85)
    code = "\n".join(f"def f{i}(x, y): return x + {i} * y" for i in range(30))
    mit = L.TEXTS["MIT"].replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    cases = [(f"Copyright 2020 Someone\n\n{mit}\n\n{code}", "MIT"), ("Copyright 2020 Someone. Released under the MIT License. All rights reserved.", "MIT"), ("This file is licensed under the MIT License.", "MIT"), (f"{code}\nnothing\n\nunder the terms of", None)]
    cases += [(f"{code}\n# {body}\n{code}", name) for name, body in L.NOTICES]
    for (text, name), got in zip(cases, L.scan_column(pa.array([x for x, _ in cases]), templates, spans=True)):
        assert [k for k, _ in got] == [name] * (name is not None), (text, got)
    assert {name for name, _ in L.NOTICES} | set(L.TEXTS) == set(L.NAMES)
    twice = L.scan_column(pa.array([f"{mit}\n\n{code}\n\n{mit}"]), templates, spans=True)
    assert [k for k, _ in twice[0]] == ["MIT", "MIT"]


def test_whole_texts_in_any_layout():
    """A licence's body is found as it is, re-flowed to one line, and after a header of code."""
    t = L.Templates.of(L.default_templates(), 0.85)
    bodies = dict(L.bodies())
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(bodies)
    for name in ("GPL-3.0", "MPL-2.0", "LGPL-3.0"):
        body = bodies[name]
        texts = [body, " ".join(body.split()), "int main(void) { return 0; }\n" * 60 + "\n\n" + body]
        for hits in L.scan_column(pa.array(texts), t, spans=True):
            assert name in {k for k, _ in hits}
