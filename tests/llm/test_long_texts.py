"""Texts longer than a chunk are read in pieces; results equal those of one piece, in bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from chronotaxa.llm import decontaminate, jaccard_join, language_id, license_scan, quality, textkit


def texts():
    rng = np.random.default_rng(0)
    words = ["a", "bb", "Ccc", "über", "x" * 300, "naïve-ish", "1.5", "The", "license", "MIT"]
    out = ["", " ", "\n\n", "x" * 700, "ü" * 500, " " * 700, "one"]
    for n in (3, 60, 200, 400):
        out += ["".join(rng.choice(words) + rng.choice([" ", "\n", "\n\n", "  ", ", ", ""]) for _ in range(n)) for _ in range(6)]
    licence = license_scan.default_templates()[0][1]
    return [*out, out[-1] + "\n\n" + licence + "\n\n" + out[-2], licence, None]


def model():
    rng = np.random.default_rng(1)
    table = rng.integers(0, 4, (1 << 10, 1)).astype(np.uint8)
    return language_id.Model(["p", "q"], table, np.array([0.05, 0.1]))


def everything(column):
    templates = license_scan.Templates.of(license_scan.default_templates(), 0.85)
    return {
        "sets": [(i, s.tolist()) for i, s in jaccard_join.set_rows(column, 5)],
        "content": [x for _, _, h, first in decontaminate.content_words(column) for x in np.split(h, first[1:-1])],
        "quality": quality.features(column),
        "licences": license_scan.scan_column(column, templates, spans=True),
        "language": [list(x) for x in language_id.judge(model(), column)],
    }


@pytest.mark.parametrize("chunk", [7, 64, 257])
def test_pieces_equal_the_whole(monkeypatch, chunk):
    column = pa.array(texts())
    want = everything(column)
    monkeypatch.setattr(textkit, "CHUNK", chunk)
    got = everything(column)
    assert got["sets"] == want["sets"] and got["licences"] == want["licences"]
    assert any(want["licences"][-3:-1])
    for a, b in zip(got["content"], want["content"], strict=True):
        assert a.tolist() == b.tolist()
    np.testing.assert_allclose(got["quality"], want["quality"], atol=1e-12)
    assert got["language"][0] == want["language"][0]
    np.testing.assert_allclose(np.array(got["language"][1:], float), np.array(want["language"][1:], float), atol=1e-12)


@pytest.mark.parametrize("kind", ["words", "one word"])
def test_memory_of_a_long_text(kind):
    size = 16 << 20
    rng = np.random.default_rng(2)
    text = np.where(rng.random(size) < 0.17, 32, rng.integers(97, 123, size)).astype(np.uint8).tobytes().decode() if kind == "words" else "x" * size
    column = pa.array([text])
    templates = license_scan.Templates.of(license_scan.default_templates(), 0.85)
    steps = {
        "sets": lambda: list(jaccard_join.set_rows(column, 5)),
        "content": lambda: list(decontaminate.content_words(column)),
        "quality": lambda: quality.features(column),
        "licences": lambda: license_scan.scan_column(column, templates, spans=True),
        "language": lambda: language_id.judge(model(), column),
    }
    for name, step in steps.items():
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12 * size, (name, peak / size)
