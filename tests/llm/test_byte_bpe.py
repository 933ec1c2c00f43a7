import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from chronotaxa.llm import byte_bpe as B
from chronotaxa.llm import pretokens, textkit, token_counts

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'l", "é", "1", "²", "!", "?", " ", "　", "日", "\x1c", "\x85", "'ve", "՘", "S", "'S", "😀", ".", "\x00", "the ", "word", "<|endoftext|>"]

pytestmark = pytest.mark.skipif(not Path(token_counts.ranks_path()).exists(), reason="no tokenizer files")


@pytest.fixture(scope="module")
def ranks():
    return Path(token_counts.ranks_path()).read_bytes()


def library(ranks):
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=B.read_ranks(ranks), special_tokens={})


def texts(seed, n, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def brute(rows, ranks):
    enc = library(ranks)
    out = []
    for doc_id, text in rows:
        ids = enc.encode_ordinary(text or "")
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [None, 5, 64])
def test_pre_tokens_are_those_of_the_library(ranks, monkeypatch, chunk):
    if chunk:
        monkeypatch.setattr(textkit, "CHUNK", chunk)
    enc, rows = library(ranks), [*texts(1, 3000), "x" * 300, " " * 300, None, ""]
    codes, first, words = pretokens.block_words(pa.array(rows), pretokens.classes())
    words = words.to_pylist()
    assert len(set(words)) == len(words)
    for k, text in enumerate(rows):
        parts = [words[c] for c in codes[first[k] : first[k + 1]]]
        assert b"".join(parts) == (text or "").encode()
        assert [i for p in parts for i in enc.encode_ordinary(p.decode())] == enc.encode_ordinary(text or "")


def test_classes_cover_every_character(ranks):
    """Each character beside a letter, a number and a sign is split from it, or not, as the library does."""
    table = pretokens.classes()
    merges = {bytes([b]): b for b in range(256)} | {bytes([lead, b]): 256 * (k + 1) + b for k, lead in enumerate(b"a1!") for b in range(256)}
    enc = tiktoken.Encoding("pairs", pat_str=B.PATTERN, mergeable_ranks=merges, special_tokens={})
    rng = random.Random(3)
    some = {*range(0x3100), *(rng.randrange(0x3100, 0x110000) for _ in range(30_000))} - set(range(0xD800, 0xE000))
    for c in some:
        joined = [k + 1 for k, lead in enumerate("a1!") if len(enc.encode_ordinary(lead + chr(c))) == len(chr(c).encode())]
        assert (joined or [pretokens.WHITE]) == [table[c]], hex(c)


@pytest.mark.parametrize("sizes", [None, (64, 16)])
def test_digests(spark, ranks, sizes):
    """Equal to encoding each text by itself; also if blocks and rows of positions are tiny, so that texts span several."""
    data = [None, "", "the word's  end\n", "é" * 700, "a b " * 300, "the word's  end\n", "x" * 500, *texts(5, 200)]
    rows = [(k % 150, t) for k, t in enumerate(data)] + [(None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, block int").repartition(3)
    got = sorted((tuple(r) for r in B.digests(df, ranks, *(sizes or ())).collect()), key=str)
    assert got == brute(rows, ranks)


def test_empty_table(spark, ranks):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert B.digests(df, ranks).count() == 0 and B.encode(df, ranks).count() == 0


def test_encode_and_decode(spark, ranks):
    data = [(k, t) for k, t in enumerate([None, "", "the word", "the word", "é日😀 'll " * 2000, *texts(7, 50)])]
    enc, ids = library(ranks), B.encode(spark.createDataFrame(data, "doc_id long, text string"), ranks)
    assert {r.doc_id: r.ids for r in ids.collect()} == {k: enc.encode_ordinary(t or "") for k, t in data}
    assert {r.doc_id: bytes(r.bytes) for r in B.decode(ids, ranks, run=7).collect()} == {k: (t or "").encode() for k, t in data}


def test_decode_edges(spark, ranks):
    rows = [(1, None), (2, []), (3, [64, 65]), (3, [66]), (None, [64])]
    got = [(r.doc_id, None if r.bytes is None else bytes(r.bytes)) for r in B.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), ranks).collect()]
    assert sorted(got, key=str) == sorted([(i, None if x is None else library(ranks).decode_bytes(x)) for i, x in rows], key=str)
    with pytest.raises(Exception, match="no such id"):
        B.decode(spark.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>"), ranks).collect()
