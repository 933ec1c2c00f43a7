"""Pre-tokens of byte-level vocabularies, found over whole Arrow buffers, and the dictionaries of blocks of texts.

The vocabularies split a text by one pattern: contractions, then runs of letters, of numbers or of other characters,
each with a blank before it, then white space, whose last character is left to what follows. Where a pre-token starts depends on a
few neighbouring characters only, so it is found with numpy for all texts of a block at once. Which characters are
letters, numbers or white space is asked of the installed library, as Unicode versions differ.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from . import shared, textkit
from .textkit import buffers

#: The pattern that the rank files' vocabularies split text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE, LETTER, NUMBER, OTHER = range(4)

_LAST = 0x110000
#: Code points asked for; above, but for the tags, there are only unassigned and private ones.
_ASKED = ((0, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000))
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point under the pattern, asked of the library: a character that goes on a run merges with the one before it."""
    if not _CLASSES:
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)}
        for k, lead in enumerate(b"a1!"):
            ranks |= {bytes([lead, b]): 256 * (k + 1) + b for b in range(256)}
        asked = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        out = np.full(_LAST, OTHER, np.uint8)
        for a, b in _ASKED:
            out[a:b] = WHITE
        for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            for c in range(128):
                if len(asked.encode_ordinary(lead + chr(c))) == 1:
                    out[c] = kind
            for a, b in _ASKED:
                for lo in range(max(a, 128), b, 1 << 15):
                    hi = min(lo + (1 << 15), b)
                    ids = np.array(asked.encode_ordinary("".join(f"\n{lead}{chr(c)}" for c in range(lo, hi))))
                    out[lo:hi][ids[(ids == ord(lead)) | (ids >= 256)] >= 256] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def starts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bytes at which pre-tokens begin in rows of UTF-8."""
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    at = np.arange(n) if n == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
    first = np.zeros(n + 1, bool)
    rows = np.searchsorted(at, offsets)
    first[rows] = True
    kind = table[code]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[first[:-1]] = 255
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[first[1:]] = 255
    blank = np.zeros(n, bool)
    blank[1:] = code[:-1] == 32
    white = kind == WHITE
    start = np.where(white, (before != WHITE) | ((after != WHITE) & (after != 255)), (kind != before) & ~(blank & (before == WHITE)))
    quote = np.flatnonzero((code == 39) & start)
    if len(quote):
        end = rows[np.searchsorted(rows, quote, side="right")]
        padded = np.concatenate((code, [0, 0, 0]))
        one = np.where(quote + 1 < end, padded[quote + 1], 0)
        two = np.where(quote + 2 < end, padded[quote + 2], 0)
        size = np.where(np.isin(one, [100, 109, 115, 116]), 2, np.where(np.isin(one, [114, 118]) & (two == 101) | (one == 108) & (two == 108), 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        next_ = quote + size
        start[next_[next_ < n]] = True
    return at[start]


def cuts(data: np.ndarray) -> np.ndarray:
    """Bytes of one text, in UTF-8, where it can be cut: a blank after a character that is surely no white space. Tokens of either kind end there."""
    out = data == 32
    out[:1] = False
    before = np.zeros(len(data), bool)
    before[1:] = (data[:-1] > 32) & (data[:-1] < 127)
    before[2:] |= (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    before[3:] |= (data[:-3] >= 0xE4) & (data[:-3] < 0xEE)
    return np.flatnonzero(out & before)


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, offsets) over the bytes of rows: whole rows of at most ``limit`` bytes together, longer rows cut where that changes nothing."""
    limit = limit or textkit.CHUNK
    for a, b in textkit.slices(offsets, limit):
        lo, hi = int(offsets[a]), int(offsets[b])
        while hi - lo > limit and b == a + 1:
            window = limit
            while len(found := cuts(data[lo : min(lo + window, hi)])) == 0 and lo + window < hi:
                window *= 2
            if not len(found):
                break
            yield lo, lo + int(found[-1]), np.array([0, int(found[-1])])
            lo += int(found[-1])
        yield (lo, hi, offsets[a : b + 1] - lo) if hi - lo == offsets[b] - offsets[a] else (lo, hi, np.array([0, hi - lo]))


def distinct(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the parts that ``at`` cuts the bytes into, and the distinct parts, by Arrow's dictionary encoding."""
    offsets = np.append(at, len(data)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    coded = parts.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.binary())


def block_words(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of the texts of a block: the code of every pre-token, each text's first (n + 1), and the distinct pre-tokens."""
    data, offsets = buffers(column)
    at = [np.zeros(0, np.int64), *(lo + starts(data[lo:hi], o, table) for lo, hi, o in pieces(data, offsets))]
    at = np.concatenate(at)
    codes, words = distinct(data, at)
    return codes, np.searchsorted(at, offsets), words


def blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows gathered until their texts hold ``size`` bytes; a longer text may be the last of its block."""
    held, have = [], 0
    for batch in batches:
        for piece in shared.pieces(batch):
            held.append(piece)
            have += piece.column("text").nbytes
            if have >= size:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, have = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def take_runs(lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indices of runs of ``lengths`` that begin at ``at``, one run after another."""
    total = np.cumsum(lengths)
    return np.repeat(at - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def packed(x: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers as bytes: all lowest bytes, then all second ones, and so on, which general compression makes small."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes()


def unpacked(x: bytes, kind: str = "<u4") -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel().astype(np.int64)
