"""Operator 6: quality classifier, histogram gradient-boosted trees over document statistics.

Training takes a bounded sample of labelled rows: the ``sample`` (default 20,000) with the smallest hash of
doc_id among those whose crc32 remainder by 3 is not 1 (rows that repeat an id included). Only their ids and labels, at most that many,
are broadcast; texts are not shuffled. Features are binned at quantiles; each level of a tree takes one
pass of gradient histograms. Fitted trees are complete binary trees flattened into arrays, which numpy
walks for all rows of a batch at once, one level of one tree at a time.

Inputs are statistics of the text alone. Defined results: a null text is scored as an empty one; without
usable labels every score is 0.5, and with one class it is that class's smoothed rate. Several labels of
one document each count. A row without doc_id teaches nothing and is not held out. Repeated documents are scored row by row; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import arrow_pass, crc_mod

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": (9, 11, 12, 13, 32),
    "newline": (10,),
    "stop": b".!?",
    "exclaim": b"!",
    "comma": b",;:",
    "symbol": b"#$%&*@^~_=+<>\\",
    "bar": b"|",
    "bracket": b"()[]{}",
    "quote": b"\"'`",
    "high": range(128, 256),
    "control": (*range(0, 9), *range(14, 32), 127),
}
_OF = np.zeros((len(_CLASSES), 256), dtype=np.uint8)
for _k, _members in enumerate(_CLASSES.values()):
    _OF[_k, list(_members)] = 1

_NEWLINE = np.zeros(256, dtype=bool)
_NEWLINE[10] = True

FEATURES = ("log_bytes", "log_words", "word_bytes", "long_words", *(f"share_{k}" for k in _CLASSES), "upper_of_letters", "distinct_words", "top_word", "top5_words", "repeated_pairs", "log_lines", "repeated_lines", "top_line")


def features(column) -> np.ndarray:
    """One row of FEATURES for each text; a long one is read in pieces."""
    data, offsets = textkit.buffers(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    classes = len(_CLASSES)
    for a, b in textkit.slices(offsets):
        o = offsets[a : b + 1] - offsets[a]
        raw = data[offsets[a] : offsets[b]]
        if b == a + 1:
            word, length, _ = textkit.row_words(raw)
            line, _, breaks = textkit.row_words(raw, apart=_NEWLINE)
            first, n_breaks, line_first = np.array([0, len(word)]), np.array([len(breaks)]), np.array([0, len(line)])
            shares = sum((np.bincount(raw[k : k + textkit.CHUNK], minlength=256) for k in range(0, len(raw), textkit.CHUNK)), np.zeros(256, np.int64))[None] @ _OF.T.astype(np.int64)
        else:
            low = textkit.lowered(raw)
            starts, ends, first = textkit.spans(low, o)
            word, length = textkit.span_hashes(low, starts, ends), ends - starts
            starts, ends, line_first = textkit.spans(low, o, _NEWLINE)
            line, n_breaks = textkit.span_hashes(low, starts, ends), np.diff(np.searchsorted(np.flatnonzero(raw == 10), o))
            shares = np.stack([np.diff(np.concatenate(([0], np.cumsum(of[raw], dtype=np.int64)))[o]) for of in _OF], axis=1)
        size, words, x = np.diff(o), np.diff(first), out[a:b]
        total, longest = (np.concatenate(([0], np.cumsum(v))) for v in (length, length > 15))
        each = np.maximum(words, 1)
        x[:, 0], x[:, 1] = np.log1p(size), np.log1p(words)
        x[:, 2], x[:, 3] = np.diff(total[first]) / each, np.diff(longest[first]) / each
        x[:, 4 : 4 + classes] = shares / np.maximum(size, 1)[:, None]
        at = 4 + classes
        x[:, at] = x[:, 4] / np.maximum(x[:, 4] + x[:, 5], 1e-9)
        x[:, at + 5] = np.where(words > 0, np.log1p(n_breaks + 1), 0.0)
        for i in np.flatnonzero(words):
            w = word[first[i] : first[i + 1]]
            _, n = np.unique(w, return_counts=True)
            n.sort()
            x[i, at + 1], x[i, at + 2], x[i, at + 3] = len(n) / len(w), n[-1] / len(w), n[-5:].sum() / len(w)
            if len(w) > 1:
                with np.errstate(over="ignore"):
                    x[i, at + 4] = 1 - len(np.unique(w[:-1] * np.uint64(3) + w[1:])) / (len(w) - 1)
            if lines := int(n_breaks[i]):
                _, n = np.unique(line[line_first[i] : line_first[i + 1]], return_counts=True)
                empty = lines + 1 - int(n.sum())
                x[i, at + 6], x[i, at + 7] = 1 - (len(n) + (empty > 0)) / (lines + 1), max(int(n.max(initial=0)), empty) / (lines + 1)
    return out


@dataclass(frozen=True)
class Forest:
    """Trees of one depth: inner nodes level by level, then leaves. A row goes right if its bin is above the node's."""

    edges: list[np.ndarray]
    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), np.uint8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        depth = (self.feature.shape[1] + 1).bit_length() - 1 if self.feature.size else 0
        for feature, above, leaf in zip(self.feature, self.above, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > above[node])
            out += leaf[node - (2**depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 3.0) -> Forest:
    """Boosted logistic regression trees; ``least`` is the smallest sum of second derivatives in a child."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins)[1:-1], method="lower")) if n else np.zeros(0) for k in range(width)]
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2**depth - 1, 2**depth
    blank = Forest(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.uint8), np.zeros((0, leaves)), base)
    if n == 0 or y.min() == y.max():
        return blank
    binned = blank.bins(x).astype(np.int64)
    column = binned + np.arange(width) * bins
    feature, above, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.uint8), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * bins) + column).ravel()
            shape = (count, width, bins)
            G = np.bincount(key, weights=np.repeat(g, width), minlength=count * width * bins).reshape(shape)
            H = np.bincount(key, weights=np.repeat(h, width), minlength=count * width * bins).reshape(shape)
            gl, hl = G.cumsum(2), H.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            feature[t, first : first + count] = np.where(good, best // bins, 0)
            above[t, first : first + count] = np.where(good, best % bins, 255)
            node = 2 * node + 1 + (binned[np.arange(n), feature[t, node]] > above[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + ridge)
        margin += leaf[t, at]
    return Forest(edges, feature, above, leaf, base)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> Forest:
    chosen = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod("doc_id", 3) != 1))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)

    def measured(batches):
        for batch in batches:
            yield {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": list(features(batch.column("text")))}

    rows = arrow_pass(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text"), measured, "doc_id long, quality int, x array<double>")
    # Rows that repeat a chosen id are of the sample only up to its bound, again by a hash.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(sample).toPandas()
    rows = rows.sort_values(["doc_id", "quality"]).reset_index(drop=True)
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x, rows["quality"].to_numpy(np.float64), **options)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def scored(batches):
        for batch in batches:
            s = held.value.score(features(batch.column("text")))
            yield {"doc_id": batch.column("doc_id"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    out = arrow_pass(docs.select("doc_id", "text"), scored, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
