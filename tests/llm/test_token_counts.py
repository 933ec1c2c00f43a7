from pathlib import Path

import numpy as np
import pytest

from chronotaxa.llm import token_counts as T


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_scan_equals_splitting(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BLOCKS", 4)
    rng = np.random.default_rng(block)
    files = [np.array([], int), np.array([9]), np.array([9, 9, 9]), np.array([1, 2, 3]), np.array([1, 9, 2]), *(rng.choice([1, 2, 9], p=[0.5, 0.4, 0.1], size=n) for n in (5, 60, 61)), np.append(np.ones(50, int), 9)]
    paths, want = [], set()
    for i, f in enumerate(files):
        p = tmp_path / f"{i}.bin"
        p.write_bytes(f.astype("<u4").tobytes())
        paths.append(str(p))
        ends = [-1, *np.flatnonzero(f == 9).tolist()]
        want |= {(i, k, b - a - 1, True) for k, (a, b) in enumerate(zip(ends, ends[1:]))}
        if len(f) > ends[-1] + 1:
            want.add((i, len(ends) - 1, len(f) - ends[-1] - 1, False))
    got = T.scan(T.file_blocks(spark, paths, "<u4", block), eod=9, dtype="<u4").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.skipif(not Path(T.ranks_path()).exists(), reason="no tokenizer files")
def test_documents(spark):
    ranks = Path(T.ranks_path()).read_bytes()
    texts = [None, "", "one word", "é" * 3000, "one word", "<|endoftext|>", *(f"text {k} " * k for k in range(60))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, file string, n_tokens int").repartition(3)
    enc = T.encoder(ranks)
    got = T.count_documents(df, ranks, block_tokens=64).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, len(enc.encode_ordinary(t or ""))) for i, t in enumerate(texts)]
    assert T.count_documents(df.limit(0), ranks).count() == 0


def test_identifiers_must_fit(spark):
    import base64

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    ranks = b"\n".join(base64.b64encode(bytes([b])) + b" " + str(b).encode() for b in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 70000"
    with pytest.raises(ValueError, match="too narrow"):
        T.pack(docs, ranks)
    with pytest.raises(ValueError, match="cannot end"):
        T.pack(docs, ranks, eod=70000, dtype="<u4")
    assert T.count_documents(docs, ranks, eod=80000, dtype="<u4").first().n_tokens == 1
