"""Indel similarity, 100 * 2 * LCS / (|a| + |b|), as an Arrow UDF with bit-parallel rows, and texts as sets of numbered items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters of the shorter string that fit one machine word; longer pairs are computed one by one.
_WIDE = 64
_ROWS = 4096


def indel_ratio(a: str, b: str) -> float:
    """Similarity of two strings from 0 to 100; two empty ones are equal."""
    total = len(a) + len(b)
    if not total:
        return 100.0
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return 200.0 * (len(a) - free.bit_count()) / total


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, a row for each text, filled up with zeros."""
    return np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``indel_ratio`` of pairs whose first string has at most 64 letters, all pairs advancing by one letter of the second at a time."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    left, right = _codes(a, _WIDE), _codes(b, int(size_b.max(initial=1)))
    full = np.where(size_a < _WIDE, (np.uint64(1) << np.minimum(size_a, 63).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
    free = full.copy()
    for k in range(right.shape[1]):
        at = np.packbits(left == right[:, k : k + 1], axis=1, bitorder="little").view("<u8").ravel()
        hit = free & at
        free = np.where(k < size_b, ((free + hit) | (free - hit)) & full, free)
    total = size_a + size_b
    return np.where(total > 0, 200.0 * (size_a - np.bitwise_count(free)) / np.maximum(total, 1), 100.0)


def walked(names: list[str], beside: list[str]) -> Iterator[tuple[str, np.ndarray]]:
    """Each name of a sorted list with the lengths of its common subsequences with all texts of ``beside``, which are of one length.

    The rows of all texts advance together, by one letter of the name; what a name begins with like the one before it is not walked again.
    """
    size = len(beside[0])
    codes, words = _codes(beside, size), -(-size // _WIDE)
    full = np.array([2 ** min(_WIDE, size - _WIDE * w) - 1 for w in range(words)], np.uint64)[:, None]
    masks: dict[str, np.ndarray] = {}
    rows = [np.broadcast_to(full, (words, len(beside))).copy()]
    last = ""
    for name in names:
        same = next((k for k, (x, y) in enumerate(zip(name, last)) if x != y), min(len(name), len(last)))
        del rows[same + 1 :]
        for c in name[same:]:
            if c not in masks:
                bits = np.packbits(np.pad(codes == ord(c), ((0, 0), (0, words * _WIDE - size))), axis=1, bitorder="little")
                masks[c] = np.ascontiguousarray(bits.view("<u8").T)
            free = rows[-1]
            hit = free & masks[c]
            if words == 1:
                rows.append((free + hit) | (free - hit))
                continue
            out, carry = np.empty_like(free), np.zeros(len(beside), np.uint64)
            for w in range(words):
                part = free[w] + hit[w]
                total = part + carry
                carry = ((part < free[w]) | (total < part)).astype(np.uint64)
                out[w] = total | (free[w] - hit[w])
            rows.append(out)
        last = name
        yield name, size - np.bitwise_count(rows[-1] & full).sum(axis=0, dtype=np.int64)


def indel_each(a: pd.Series, b: pd.Series) -> pd.Series:
    """``indel_ratio`` row by row, null where either is."""
    out = np.full(len(a), np.nan)
    known = (a.notna() & b.notna()).to_numpy()
    turned = np.array([known[k] and len(x) > len(y) for k, (x, y) in enumerate(zip(a, b))], bool)
    short, long = a.where(~turned, b), b.where(~turned, a)
    fits = known & np.array([known[k] and len(x) <= _WIDE for k, x in enumerate(short)], bool)
    for at in np.array_split(np.flatnonzero(fits), max(1, -(-int(fits.sum()) // _ROWS))):
        if len(at):
            out[at] = indel_ratios(short.iloc[at].tolist(), long.iloc[at].tolist())
    for k in np.flatnonzero(known & ~fits):
        out[k] = indel_ratio(short.iloc[k], long.iloc[k])
    return pd.Series(out).where(known, None)


indel = F.pandas_udf(indel_each, DoubleType())


def numbered(tokens: str) -> str:
    """SQL for an array's items with their counts so far, which makes a set of a multiset."""
    return f"transform({tokens}, (g, i) -> concat(g, ':', size(filter(slice({tokens}, 1, i + 1), x -> x = g))))"
