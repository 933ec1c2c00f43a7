"""Operator 10: SentencePiece encoding and decoding on the Tokenizers library.

The model file is parsed (``sentencepiece_model``) and rebuilt: normaliser (precompiled character map,
extra blanks, dummy prefix), the metaspace marker, byte fallback, and either unigram scores or, for a BPE
model, merges in the order of the pieces' scores. Batches are encoded by several threads. If no
piece continues over a marker, words are separate problems, and very long texts are cut between words, so that
memory stays bounded and results equal those of the whole text. Decoding gathers the pieces' bytes from one
flat table, which takes a fraction of the library decoder's time; tests hold it against that and the original.

Defined results: a null text has null ids and decodes to null; an empty one has none and decodes to ''.
A text that holds the marker U+2581 itself decodes to a blank there, as in the original library.
Repeated rows are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepiece_model import BPE, BYTE, CONTROL, NORMAL, UNIGRAM, UNK, UNUSED, USER_DEFINED, SentencePieceModel
from .shared import arrow_pass

MARK = "▁"
#: Characters encoded at once, and the longest part of a text.
_BATCH = 1 << 18


def _merges(model: SentencePieceModel) -> list[tuple[str, str]]:
    """Pairs by the score of what they make. Runs of markers share one score and grow from the left, by the shortest piece that makes another."""
    usable = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    out = []
    for p, score in usable.items():
        cuts = [k for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        if not p.strip(MARK):
            cuts = cuts[-1:]
        out += [(-score, -len(p), p[:k], p[k:]) for k in cuts]
    out.sort(key=lambda m: m[:2])
    return [(left, right) for _, _, left, right in out]


class Codec:
    def __init__(self, model: SentencePieceModel, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.model = model
        self.names = [p for p, _, _ in model.pieces]
        self.separable = not model.whitespace_as_suffix and model.escape_whitespaces and not any(MARK in p.lstrip(MARK) for p in self.names)
        self.whole = self._build(prefix=model.add_dummy_prefix)
        self._rest = None
        surfaces = [_surface(model, p, kind) for p, _, kind in model.pieces]
        self.start = np.concatenate(([0], np.cumsum([len(x) for x in surfaces])))
        self.bytes = np.frombuffer(b"".join(surfaces), dtype=np.uint8)

    @classmethod
    def load(cls, data: bytes, threads: int = 2) -> Codec:
        return cls(SentencePieceModel.parse(data), threads)

    @property
    def rest(self):
        """For the later parts of a long text; built when there is one."""
        if self._rest is None:
            self._rest = self._build(prefix=False)
        return self._rest

    def _build(self, prefix: bool):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        m = self.model
        if m.model_type == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
        elif m.model_type == BPE:
            core = models.BPE({p: i for i, p in enumerate(self.names)}, _merges(m), unk_token=self.names[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
        t = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.escape_whitespaces:
            steps += [normalizers.Replace(" ", MARK)]
        if prefix:
            steps += [normalizers.Prepend(MARK)]
        t.normalizer = normalizers.Sequence(steps)
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []))
        return t

    def parts(self, text: str) -> list[str]:
        """Cuts a long text before a blank that follows no blank; one part if that could change the result."""
        if len(text) <= _BATCH or not self.separable or self.model.remove_extra_whitespaces:
            return [text]
        out, at = [], 0
        while len(text) - at > _BATCH:
            to = text.rfind(" ", at + 1, at + _BATCH)
            while to > at and text[to - 1] in (" ", MARK):
                to = text.rfind(" ", at + 1, to)
            if to <= at:
                to = text.find(" ", at + _BATCH)
                while to > 0 and text[to - 1] in (" ", MARK):
                    to = text.find(" ", to + 1)
                if to < 0:
                    break
            out.append(text[at:to])
            at = to
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces, first = [], []
        for text in texts:
            first.append(len(pieces))
            pieces += self.parts(text)
        first.append(len(pieces))
        lead = set(first[:-1])
        ids: list[np.ndarray | None] = [None] * len(pieces)
        for first_part in (True, False):
            own = [k for k in range(len(pieces)) if (k in lead) == first_part]
            if not own:
                continue
            tokenizer = self.whole if first_part else self.rest
            at = 0
            while at < len(own):
                to, size = at, 0
                while to < len(own) and (to == at or size + len(pieces[own[to]]) <= _BATCH):
                    size += len(pieces[own[to]])
                    to += 1
                for k, e in zip(own[at:to], tokenizer.encode_batch_fast([pieces[k] for k in own[at:to]], add_special_tokens=False), strict=True):
                    ids[k] = np.array(e.ids, dtype=np.int32)
                at = to
        return [np.concatenate(ids[a:b]) if b > a + 1 else ids[a] for a, b in zip(first, first[1:])]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        n = [len(x) for x in ids]
        flat = np.concatenate(ids).astype(np.int64) if sum(n) else np.zeros(0, np.int64)
        lo, size = self.start[flat], np.diff(self.start)[flat]
        ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        data = self.bytes[np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cuts = ends[np.concatenate(([0], np.cumsum(n, dtype=np.int64)))]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
        return [t[1:] if self.model.add_dummy_prefix and t[:1] == " " else t for t in texts]

    def decode_by_library(self, ids: list[np.ndarray]) -> list[str]:
        return self.whole.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def _surface(model: SentencePieceModel, piece: str, kind: int) -> bytes:
    if kind == BYTE:
        return bytes([int(piece[3:5], 16)])
    if kind in (CONTROL, UNUSED):
        return b""
    return (model.unk_surface if kind == UNK else piece.replace(MARK, " ")).encode()


def read_model(spark, path: str) -> bytes:
    """The model's bytes, through Spark if the path has a scheme that only Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return Path(path).read_bytes()


def _coded(docs: DataFrame, data: bytes, threads: int, fn, schema: str, columns: list[str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        codec = Codec.load(held.value, threads)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield fn(codec, batch.slice(at, 256))

    return arrow_pass(docs.select(*columns), run, schema)


def encode(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """doc_id, ids."""

    def fn(codec, batch):
        texts = batch.column("text").to_pylist()
        coded = iter(codec.encode([t for t in texts if t is not None]))
        return {"doc_id": batch.column("doc_id"), "ids": [None if t is None else next(coded) for t in texts]}

    return _coded(docs, model, threads, fn, "doc_id long, ids array<int>", ["doc_id", "text"])


def decode(tokens: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """doc_id, text."""

    def fn(codec, batch):
        ids = batch.column("ids").to_pylist()
        texts = iter(codec.decode([np.array(x, dtype=np.int32) for x in ids if x is not None]))
        return {"doc_id": batch.column("doc_id"), "text": [None if x is None else next(texts) for x in ids]}

    return _coded(tokens, model, threads, fn, "doc_id long, text string", ["doc_id", "ids"])


def round_trips(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxh64 of the little-endian int32 ids, as hex), same (decoding gives the text back)."""

    def fn(codec, batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = codec.encode(texts)
        same = [a == b.replace(MARK, " ") for a, b in zip(codec.decode(ids), texts, strict=True)]
        return {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) for x in ids], "ids_hash": [xxhash.xxh64_hexdigest(x.astype("<i4").tobytes()) for x in ids], "same": pa.array(same)}

    return _coded(docs, model, threads, fn, "doc_id long, n_tokens long, ids_hash string, same boolean", ["doc_id", "text"])


def parity(texts: list[str], data: bytes) -> list[str]:
    """Those of ``texts`` that the original library encodes or decodes otherwise."""
    import sentencepiece

    other, codec = sentencepiece.SentencePieceProcessor(model_proto=data), Codec.load(data, 1)
    ids = codec.encode(texts)
    want = other.encode(texts, num_threads=1)
    return [t for t, a, b, d, e, f in zip(texts, ids, want, codec.decode(ids), other.decode(want), codec.decode_by_library(ids)) if a.tolist() != b or not d == e == f]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the model lies: the folder in CHRONOTAXA_TOKENIZERS, else /opt/tokenizers."""
    return f"{os.environ.get('CHRONOTAXA_TOKENIZERS', '/opt/tokenizers')}/{name}"


def tokens_of(docs: DataFrame, model: bytes, threads: int = 2) -> DataFrame:
    """The documents with their number of tokens and ids, for a pipeline's last stage."""
    return encode(docs, model, threads).withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)).cast("long"))
