"""Operator 11: periodic runs of words, found with a suffix automaton.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping it, of at least
``times`` periods and ``least`` words. The automaton's states hold words' end positions; going from long states to their suffix
links, ordered sets of them are merged, the smaller into the larger. Where that brings two positions next to each other whose distance does
not exceed the state's length (divided by ``times`` - 1, as shorter repetitions are not asked for), a square has been met. It
seeds a run, which is extended word by word; of seeds of one stretch the smallest period stays. Every run is met, where
its last word's position joins the one a period before.

The automaton is built over suspects only. In a run each word occurs ``times`` times, and three neighbouring words nearly as
often; a stretch without words that are as frequent in their text is in no run, so leaving it out loses nothing.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``. Texts are independent rows, so nothing is shuffled; a text is
coded in pieces, and of it a task keeps a number for each word and its distinct words.

Defined results: a null or empty text has no words, no runs, and collapses to an empty text; a null doc_id is kept and its words stay as
they are; repeated rows give a row each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_pass

#: Bytes of a text that are split at once, and words that are joined at once.
PIECE = 1 << 20
_ROW = 1024


class Ends:
    """Ordered positions, in rows of bounded length, so that an insertion moves few of them."""

    __slots__ = ("firsts", "rows", "size")

    def __init__(self, x: int):
        self.firsts, self.rows, self.size = [x], [[x]], 1

    def __iter__(self) -> Iterator[int]:
        for row in self.rows:
            yield from row

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """The neighbours that ``x`` gets."""
        k = max(bisect_right(self.firsts, x) - 1, 0)
        row = self.rows[k]
        at = bisect_right(row, x)
        before = row[at - 1] if at else None
        after = row[at] if at < len(row) else self.rows[k + 1][0] if k + 1 < len(self.rows) else None
        row.insert(at, x)
        self.firsts[k] = row[0]
        self.size += 1
        if len(row) > _ROW:
            self.rows[k : k + 1] = [row[: _ROW // 2], row[_ROW // 2 :]]
            self.firsts.insert(k + 1, row[_ROW // 2])
        return before, after


def automaton(word: list[int]) -> tuple[array, array, array]:
    """Length and suffix link of each state of the suffix automaton, and the end position that a state brings along (-1: none). State 0 is the empty word."""
    length, link, own = array("q", [0]), array("q", [-1]), array("q", [-1])
    symbol, target = array("q", [-1]), array("q", [-1])  # a state's first transition; others are rare
    more: dict[int, dict[int, int]] = {}

    def follow(p: int, c: int) -> int:
        return target[p] if symbol[p] == c else more[p].get(c, -1) if p in more else -1

    def lead(p: int, c: int, q: int) -> None:
        if symbol[p] in (-1, c):
            symbol[p], target[p] = c, q
        else:
            more.setdefault(p, {})[c] = q

    def state(size: int, end: int) -> int:
        for column, x in ((length, size), (link, 0), (own, end), (symbol, -1), (target, -1)):
            column.append(x)
        return len(length) - 1

    last = 0
    for at, c in enumerate(word):
        new, p = state(at + 1, at), last
        while p >= 0 and (q := follow(p, c)) < 0:
            lead(p, c, new)
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = state(length[p] + 1, -1)
                link[copy], symbol[copy], target[copy] = link[q], symbol[q], target[q]
                if q in more:
                    more[copy] = dict(more[q])
                while p >= 0 and follow(p, c) == q:
                    lead(p, c, copy)
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, own


def seeds(word: list[int], times: int = 2) -> Iterator[tuple[int, int, int]]:
    """(position, position, length): words of that length that end at both positions, which lie at most length / (times - 1) apart."""
    length, link, own = automaton(word)
    sets: list[int | Ends | None] = [x if x >= 0 else None for x in own]
    for v in np.argsort(-np.frombuffer(length, np.int64), kind="stable").tolist():
        p, mine = link[v], sets[v]
        sets[v] = None
        if p <= 0 or mine is None:
            continue
        other = sets[p]
        if other is None:
            sets[p] = mine
            continue
        small, large = (mine, other) if isinstance(mine, int) or isinstance(other, Ends) and other.size >= mine.size else (other, mine)
        if isinstance(large, int):
            large = Ends(large)
        size, most = length[p], length[p] // (times - 1)
        for x in (small,) if isinstance(small, int) else small:
            before, after = large.insert(x)
            if before is not None and x - before <= most:
                yield before, x, size
            if after is not None and after - x <= most:
                yield x, after, size
        sets[p] = large


def runs_of(word: list[int], times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    n, periods = len(word), {}
    met: dict[int, tuple[list[int], list[int]]] = {}  # by distance, starts and ends of what was extended
    for i, j, size in seeds(word, times):
        q = j - i
        starts, ends = met.setdefault(q, ([], []))
        k = bisect_right(starts, i)
        if k and ends[k - 1] > j:
            continue
        a, b = i - size + 1, j + 1
        while a > 0 and word[a - 1] == word[a - 1 + q]:
            a -= 1
        while b < n and word[b] == word[b - q]:
            b += 1
        starts.insert(k, a)
        ends.insert(k, b)
        if b - a >= max(least, times * q):
            periods[a, b] = min(q, periods.get((a, b), q))
    return sorted((a, b - a, q) for (a, b), q in periods.items())


def _stretches(mark: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2) if b - a >= least]


def suspects(ids: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Stretches that hold all runs: each word occurs ``times`` times in the text, each three words in it about as often."""
    if len(ids) < least:
        return []
    frequent = np.bincount(ids)[ids] >= times
    parts = _stretches(frequent, least)
    if not parts or least < 3:
        return parts
    at = np.concatenate([np.arange(a, b - 2) for a, b in parts])
    _, pair = np.unique(ids[at] * (int(ids.max()) + 1) + ids[at + 1], return_inverse=True)
    _, three, count = np.unique(pair * (int(ids.max()) + 1) + ids[at + 2], return_inverse=True, return_counts=True)
    mark = np.zeros(len(ids), bool)
    mark[at[count[three] >= min(times - 1, least - 2)]] = True
    return [(a, b + 2) for a, b in _stretches(mark, least - 2)]


def text_runs(ids: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, given a number for each word."""
    return sorted((a + start, n, q) for a, b in suspects(ids, times, least) for start, n, q in runs_of(ids[a:b].tolist(), times, least))


def _pieces(data: bytes) -> Iterator[bytes]:
    """Cut at white space, in about ``PIECE`` bytes."""
    at = 0
    while len(data) - at > PIECE:
        to = at + PIECE
        while to < len(data) and data[to] not in b" \t\n\v\f\r":
            to += 1
        yield data[at:to]
        at = to
    yield data[at:]


def coded(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word of the text, and the distinct words."""
    known: dict[bytes, int] = {}
    out = [np.array([known.setdefault(w, len(known)) for w in part.split()], np.int64) for part in _pieces(text or b"")]
    return np.concatenate(out), list(known)


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those that some run contains after its first period."""
    out = np.ones(n, bool)
    for start, length, q in runs:
        out[start + q : start + length] = False
    return out


def joined(ids: np.ndarray, words: list[bytes]) -> Iterator[bytes]:
    """The words, joined by one space, in pieces."""
    for at in range(0, len(ids), PIECE):
        yield (b" " if at else b"") + b" ".join([words[i] for i in ids[at : at + PIECE].tolist()])


def _over_texts(docs: DataFrame, document: Callable, schema: str) -> DataFrame:
    """``document(doc_id, text)`` makes a dict of columns; ``schema`` has doc_id first."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())
            rows = [document(i, texts[k].as_py()) for k, i in enumerate(ids)]
            yield {"doc_id": ids, **{name: [r[name] for r in rows] for name in (rows[0] if rows else ())}}

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def find_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """doc_id, runs: array of (start, length, period), numbers of words."""
    names = ("start", "length", "period")

    def document(_, text):
        return {"runs": [dict(zip(names, r)) for r in text_runs(coded(text)[0], times, least)]}

    return _over_texts(docs, document, "doc_id long, runs array<struct<start:long,length:long,period:long>>")


def collapse(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """doc_id, text: of each run the first period stays; words are joined by one space. A null text stays null."""

    def document(_, text):
        ids, words = coded(text)
        return {"text": None if text is None else b"".join(joined(ids[kept(len(ids), text_runs(ids, times, least))], words)).decode()}

    return _over_texts(docs, document, "doc_id long, text string")


def planted(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """The query's texts: one in ten, by the checksum of its id, repeats a part of itself to its end."""
    n = len(ids)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((ids[:a], ids[a + np.arange(n - a) % p]))


def digests(docs: DataFrame, change: Callable[[int | None, np.ndarray], np.ndarray] = planted, times: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_runs, the run with most periods (start, length, period, exponent_milli), and digests of all runs and of the collapsed text.

    ``change`` gets a text's id and word numbers and gives the numbers to search.
    """

    def document(doc_id, text):
        ids, words = coded(text)
        ids = change(doc_id, ids)
        runs = text_runs(ids, times, least)
        start, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        collapsed = hashlib.sha256()
        for part in joined(ids[kept(len(ids), runs)] if runs else ids, words):
            collapsed.update(part)
        listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
        return {"n_runs": len(runs), "start": start, "length": length, "period": q, "exponent_milli": 1000 * length // q if q else None, "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": collapsed.hexdigest()}

    return _over_texts(docs, document, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
