"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``, after lower-casing A-Z. Hashes are
computed with numpy over whole buffers, so that no Python object is made for a word. A text longer than ``CHUNK`` bytes
is read that many bytes at a time, whatever its words' lengths: a word that a cut leaves open goes on in the next piece. What is
kept of it is a few numbers for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; temporaries take about 30 times as much memory.
CHUNK = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: An odd multiplier (golden ratio) and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    step = base
    with np.errstate(over="ignore"):
        while done < n:
            take = min(done, n - done)
            out[done : done + take] = out[:take] * np.uint64(step)
            done += take
            step = step * step % (1 << 64) if done < n else step
    return out


_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _CACHE.get(base)
    if have is None or len(have) < n:
        have = _CACHE[base] = _powers(base, max(n, CHUNK))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    hi = int(offsets[-1]) if len(offsets) else 0
    return data[lo:hi], offsets - lo


def slices(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row comes alone, for its reader to cut."""
    limit = limit or CHUNK
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each row's first word (n + 1). Words do not cross rows."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of byte ranges, from differences of one running sum."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=total[1:])
        return (total[ends] - total[starts]) * powers(_P_INV, len(data) + 1)[starts]


def _finished(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    return _finished(_sums(data, starts, ends), ends - starts)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def row_words(data: np.ndarray, table: np.ndarray = _LOWER, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and byte lengths of the words of one row of any length, and for each newline how many words start before it.

    Bytes are mapped by ``table``; ``apart`` marks those between words.
    """
    sums, sizes, breaks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    kept, kept_size, started = 0, 0, 0  # of the word that the last cut left open
    for lo in range(0, len(data), CHUNK):
        raw = data[lo : lo + CHUNK]
        part = table[raw]
        starts, ends, _ = spans(part, np.array([0, len(part)]), apart)
        total, size = _sums(part, starts, ends), ends - starts
        goes_on = int(kept_size > 0 and len(starts) > 0 and starts[0] == 0)
        breaks.append(started + np.searchsorted(starts, np.flatnonzero(raw == 10)) - goes_on)
        if goes_on:
            total[0] = (kept + int(total[0]) * pow(_P, kept_size, 1 << 64)) % (1 << 64)
            size[0] += kept_size
        elif kept_size:
            sums.append(np.array([kept], np.uint64))
            sizes.append(np.array([kept_size]))
        started += len(starts) - goes_on
        kept, kept_size = 0, 0
        if len(ends) and ends[-1] == len(part):
            kept, kept_size = int(total[-1]), int(size[-1])
            total, size = total[:-1], size[:-1]
        sums.append(total)
        sizes.append(size)
    if kept_size:
        sums.append(np.array([kept], np.uint64))
        sizes.append(np.array([kept_size]))
    size = np.concatenate(sizes)
    return _finished(np.concatenate(sums), size), size, np.concatenate(breaks)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the rows, their bytes mapped by ``table`` (lower-cased), and the index of each row's first word (n + 1)."""
    if len(offsets) == 2 and len(data) > CHUNK:
        hashes, _, _ = row_words(data, table)
        return hashes, np.array([0, len(hashes)])
    low = table[data]
    starts, ends, first = spans(low, offsets)
    return span_hashes(low, starts, ends), first


def shingles(word: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside a row, and each row's first run (n + 1).

    A row with fewer words has its whole sequence as its only run; a row without words has none.
    """
    n = np.diff(first)
    out_first = np.concatenate(([0], np.cumsum(np.where(n >= width, n - width + 1, np.minimum(n, 1)))))
    out = np.empty(out_first[-1], np.uint64)
    padded = np.concatenate((word, np.zeros(width, np.uint64)))
    for lo in range(0, len(out), CHUNK):
        k = np.arange(lo, min(lo + CHUNK, len(out)))
        row = np.searchsorted(out_first, k, side="right") - 1
        at, have = first[row] + k - out_first[row], np.minimum(n[row], width)
        with np.errstate(over="ignore"):
            acc = have.astype(np.uint64)
            for j in range(width):
                acc = acc * np.uint64(_P) + np.where(j < have, padded[at + j], np.uint64(0))
        out[lo : lo + len(k)] = mix(acc)
    return out, out_first


def word_rows(column: pa.Array, table: np.ndarray = _LOWER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row) over a column, in pieces of whole rows."""
    data, offsets = buffers(column)
    for a, b in slices(offsets):
        o = offsets[a : b + 1]
        w, first = words(data[o[0] : o[-1]], o - o[0], table)
        yield a, b, w, first
