"""A reader of SentencePiece model files: just enough of the protobuf wire format, and the fields used here."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

UNIGRAM, BPE = 1, 2
NORMAL, UNK, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at += 1
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack("<d", data[at : at + 8])[0], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {kind} is no part of a SentencePiece model")
        if at > len(data):
            raise ValueError("the model file is cut short")
        yield key >> 3, value


@dataclass(frozen=True)
class SentencePieceModel:
    """Field numbers follow sentencepiece_model.proto; values absent from the file have its defaults."""

    pieces: list[tuple[str, float, int]]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False
    split_by_whitespace: bool = True
    scores: dict[str, float] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: bytes) -> SentencePieceModel:
        pieces, given = [], {}
        for number, value in _fields(data):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif number == 2:
                t = dict(_fields(value))
                given |= {name: kind(t[k]) for k, name, kind in ((3, "model_type", int), (22, "split_by_whitespace", bool), (24, "whitespace_as_suffix", bool), (35, "byte_fallback", bool), (40, "unk_id", int), (44, "unk_surface", bytes.decode)) if k in t}
            elif number == 3:
                n = dict(_fields(value))
                given |= {name: kind(n[k]) for k, name, kind in ((2, "charsmap", bytes), (3, "add_dummy_prefix", bool), (4, "remove_extra_whitespaces", bool), (5, "escape_whitespaces", bool)) if k in n}
        if not pieces:
            raise ValueError("no pieces: this is no SentencePiece model")
        return cls(pieces=pieces, **given)
