import random
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import xxhash

from chronotaxa.llm import sentencepiece_codec as S
from chronotaxa.llm.sentencepiece_model import BPE, UNIGRAM, SentencePieceModel

PARTS = ["a", " ", "  ", "   ", " " * 5, " " * 17, " " * 33, "é", "日本", "😀", "\n", "\t", "<s>", "</s>", "<unk>", "<0x0A>", "the", " word", "\x00", "́", "ﬁ", "Ａ", "1", "...", "\r\n", "ß", " é"]

needs_model = pytest.mark.skipif(not Path(S.tokenizer_path()).exists(), reason="no tokenizer files")


def texts(seed=2, n=800, parts=PARTS):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(n))]


@pytest.fixture(scope="module")
def model():
    return Path(S.tokenizer_path()).read_bytes()


@needs_model
def test_parity_with_the_original_library(model):
    assert S.parity(texts(parts=[*PARTS, S.MARK]), model) == []
    assert SentencePieceModel.parse(model).model_type == BPE


@needs_model
def test_long_texts_are_cut_without_effect(model, monkeypatch):
    monkeypatch.setattr(S, "_BATCH", 50)
    long = ["ab " * 200 + "   " + "x" * 300 + " cd", " " * 400, "y" * 500, *("".join(texts(seed=k, n=40)) for k in range(5))]
    codec = S.Codec.load(model, 1)
    assert max(len(codec.parts(t)) for t in long) > 5
    assert S.parity(long, model) == []


def unigram_model(**normalizer):
    """A small unigram model with byte fallback, in the original library's own message classes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = UNIGRAM
    m.trainer_spec.byte_fallback = True
    m.normalizer_spec.name = "identity"
    for k, v in normalizer.items():
        setattr(m.normalizer_spec, k, v)
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", 0, 6) for b in range(256)), ("▁", -2.5, 1), ("▁the", -3, 1), ("the", -4.1, 1), ("t", -6, 1), ("h", -6.3, 1), ("e", -5.2, 1), ("▁w", -4.7, 1), ("or", -4.4, 1), ("ord", -5.9, 1), ("d", -6.9, 1), ("a", -5, 1), ("é", -7.7, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    return m.SerializeToString()


@pytest.mark.parametrize("options", [{"remove_extra_whitespaces": False}, {"remove_extra_whitespaces": True}, {"remove_extra_whitespaces": False, "add_dummy_prefix": False}])
def test_unigram_parity(options):
    data = unigram_model(**options)
    simple = ["the", " ", "word", "a", "é", "  the", "th", "ord", "z", "日"]
    assert S.parity(texts(seed=4, n=300, parts=simple), data) == []


@needs_model
def test_frames(spark, model):
    data = [None, "", "the word", "é" * 70_000, "a  b\n", "the word"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(data)], "doc_id long, text string, ids string")
    ids = S.encode(df, model)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: None if t is None else sp.encode(t) for i, t in enumerate(data)}
    assert {r.doc_id: r.text for r in S.decode(ids, model).collect()} == dict(enumerate(data))
    rows = {r.doc_id: r for r in S.round_trips(df, model).collect()}
    assert all(r.same for r in rows.values()) and rows[0].n_tokens == 0
    assert rows[2].ids_hash == xxhash.xxh64_hexdigest(np.array(sp.encode("the word"), "<i4").tobytes())
    assert S.round_trips(df.limit(0), model).count() == 0


def test_broken_model():
    with pytest.raises(ValueError):
        SentencePieceModel.parse(b"")
