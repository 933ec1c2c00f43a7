"""Operator 4: benchmark decontamination by latent semantic retrieval.

Passages of ``span`` words become TF-IDF vectors over the benchmark's vocabulary (a word foreign to every item
cannot bring a passage nearer to one), without words that more than ``common`` of the passages hold, except an
item's ``rarest`` words. A distributed randomised SVD gives the latent space: with A
the passages of the whole corpus and W random signs, tasks accumulate Y'Y and Y'A for Y = AW; from
Y = QR follows B = Q'A = R'^-1 Y'A, and B's right singular vectors are A's. Windows of ``window`` words, at half that
step, are projected, and held against every item's vector: items within cosine ``cosine`` are candidates, whether or not they share a word
with the window. So is, whatever its cosine, every item of whose kept words a window holds ``least``: an inverted index counts them exactly, for all windows.
A stretch with a whole item has a window that reaches ``least``, so verbatim leaks do not depend on the sketch; one that
keeps ``paraphrased`` of an item's kept words has one too. If the words around a window hold at least
``paraphrased`` of an item's, they are checked word by word: a
document leaks an item if the longest common subsequence of the item and a stretch of at most ``stretch`` times
its length covers ``covered`` of the item, or ``paraphrased`` of it and ``answered`` of its answer (its last
fifth, three words at least).

Statistics and search cover every passage of every text. There is one vocabulary and one latent space for the whole benchmark, which the driver
holds; what depends on single items is broadcast for at most ``block`` of them at once, and a larger benchmark takes a search pass for each block, with
the same results. Partial sums are one row for each word that a task met. Items of more than ``most_words`` different words are refused, so
that what is broadcast (rank bytes a word while the space is built, 4 * rank in the search) and what the driver gathers (8 * rank) are bounded.

Defined results: null and empty texts or items leak nothing; repeated rows are searched one by one and reported
once for each (doc_id, item_id), with the best match; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .license_scan import _CLEAN
from .shared import arrow_pass

_BITS = 20


def _lower(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.lower("text"))


def content_words(column):
    """(first row, end row, word hashes, first word of each row); words are runs of letters and digits."""
    return textkit.word_rows(column, _CLEAN)


@dataclass(frozen=True)
class Settings:
    rank: int = 96
    extra: int = 8
    span: int = 64
    window: int = 32
    common: float = 0.02
    rarest: int = 8
    cosine: float = 0.4
    covered: float = 0.7
    paraphrased: float = 0.5
    answered: float = 0.8
    stretch: float = 1.25
    block: int = 16_384
    most_words: int = 400_000
    seed: int = 0


@dataclass(frozen=True)
class Items:
    """Benchmark items (or a block of them) over one vocabulary."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts) -> Items:
        words: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)
        for a, b, h, first in content_words(texts):
            for i in range(b - a):
                words[a + i] = h[first[i] : first[i + 1]]
        return cls(ids, words, *cls._filter(np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)))

    @staticmethod
    def _filter(vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.zeros(1 << _BITS, dtype=bool)
        bits[vocabulary >> np.uint64(64 - _BITS)] = True
        return vocabulary, bits

    def without_common(self, df: np.ndarray, n: int, s: Settings) -> Items:
        keep = df <= s.common * n
        for w in self.words:
            number = np.searchsorted(self.vocabulary, np.unique(w))
            keep[number[np.argsort(df[number], kind="stable")[: s.rarest]]] = True
        return Items(self.ids, self.words, *self._filter(self.vocabulary[keep]))

    def vectors(self, idf: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Each item's unit vector in the latent space."""
        out = np.zeros((len(self.ids), space.shape[1]), np.float32)
        for k, w in enumerate(self.words):
            _, number = self.hits(w)
            v = (space[number] * idf[number, None]).sum(axis=0)
            out[k] = v / max(float(np.sqrt(v @ v)), 1e-9)
        return out

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of vocabulary words, and their numbers."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[words >> np.uint64(64 - _BITS)])
        number = np.minimum(np.searchsorted(self.vocabulary, words[at]), len(self.vocabulary) - 1)
        real = self.vocabulary[number] == words[at]
        return at[real], number[real]


@dataclass(frozen=True)
class Block(Items):
    """Items with an inverted index of their kept words, how many of them a window has to hold, and their words' counts."""

    pairs: np.ndarray
    postings: np.ndarray
    least: np.ndarray
    members: list[dict[int, int]]

    @classmethod
    def cut(cls, items: Items, lo: int, hi: int, s: Settings) -> Block:
        ids, words = items.ids[lo:hi], items.words[lo:hi]
        pairs, least = [], np.ones(len(ids), np.int64)
        for k, w in enumerate(words):
            _, number = items.hits(w)
            pairs.append(np.unique(number) * len(ids) + k)
            # A step of half a window leaves one that holds as many of the item's words as half a window and one, or all.
            held = min(len(w), s.window // 2 + 1) * len(number) / max(1, len(w))
            # Every other window covers a stretch, and the best of them holds its share of what the stretch keeps.
            windows = -(-(s.window // 2 - 1 + max(len(w), int(s.stretch * len(w)))) // s.window)
            least[k] = max(1, min(int(0.7 * s.paraphrased * held), int(s.paraphrased * len(number) / max(1, windows))))
        pairs = np.sort(np.concatenate(pairs))
        postings = np.searchsorted(pairs, np.arange(len(items.vocabulary) + 1) * len(ids))
        members = [dict(zip(*(x.tolist() for x in np.unique(w, return_counts=True)))) for w in words]
        return cls(ids, words, items.vocabulary, items.bits, pairs, postings, least, members)

    def shared(self, entry: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, kept words that they share) of all pairs that share one; window w holds the entries of w and w + 1."""
        n = self.postings[number + 1] - self.postings[number]
        item = self.pairs[np.repeat(self.postings[number] - np.cumsum(n) + n, n) + np.arange(n.sum())] % len(self.ids)
        key = np.repeat(entry, n) * len(self.ids) + item
        key, times = np.unique(np.concatenate((key, key - len(self.ids))), return_counts=True)
        return key // len(self.ids), key % len(self.ids), times


def passages(items: Items, column, span: int):
    """(passages so far, passage of each entry, word, times): entries sorted by passage, in bounded pieces."""
    for _, _, words, first in content_words(column):
        per = -(-np.diff(first) // span)
        start = np.concatenate(([0], np.cumsum(per)))
        at, word = items.hits(words)
        row = np.searchsorted(first, at, side="right") - 1
        passage = start[row] + (at - first[row]) // span
        key, times = np.unique(passage * len(items.vocabulary) + word, return_counts=True)
        yield int(start[-1]), key // len(items.vocabulary), key % len(items.vocabulary), times


def passage_frequencies(docs: DataFrame, items: Items, span: int) -> tuple[int, np.ndarray]:
    """How many passages there are, and how many hold each word."""
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        total, n = np.zeros(len(held.value.vocabulary), np.int64), 0
        for batch in batches:
            for k, _, word, _ in passages(held.value, batch.column("text"), span):
                total += np.bincount(word, minlength=len(total))
                n += k
        some = np.flatnonzero(total)
        yield {"word": np.append(some, -1), "n": np.append(total[some], n)}

    rows = arrow_pass(_lower(docs).select("text"), run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(items.vocabulary), np.int64)
    inner = rows[rows["word"] >= 0]
    out[inner["word"]] = inner["n"]
    return int(rows.loc[rows["word"] < 0, "n"].sum()), out


def _grouped(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by sorted group."""
    start = np.flatnonzero(np.diff(group, prepend=-1))
    return group[start], np.add.reduceat(values, start, axis=0)


def latent_space(docs: DataFrame, items: Items, idf: np.ndarray, s: Settings) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix over their singular values, one row for each word.

    Projected so, passages are rows of left singular vectors: every latent direction weighs alike, and common words don't drown the rest.
    """
    width = min(s.rank + s.extra, len(idf))
    held = docs.sparkSession.sparkContext.broadcast((items, idf.astype(np.float32), np.random.default_rng(s.seed).choice(np.array([-1, 1], np.int8), (len(idf), width))))

    def run(batches):
        items, idf, signs = held.value
        z, gram = np.zeros((len(idf), width)), np.zeros((width, width))
        for batch in batches:
            for _, passage, word, times in passages(items, batch.column("text"), s.span):
                if not len(word):
                    continue
                value = idf[word] * times.astype(np.float32)
                own, square = _grouped(value**2, passage)
                place = np.repeat(np.arange(len(own)), np.diff(np.append(np.flatnonzero(np.diff(passage, prepend=-1)), len(passage))))
                value = value / np.sqrt(np.maximum(square, 1e-12))[place]
                _, y = _grouped(signs[word] * value[:, None], passage)
                gram += y.T.astype(np.float64) @ y
                order = np.argsort(word, kind="stable")
                which, add = _grouped(y[place[order]] * value[order, None], word[order])
                z[which] += add
        some = np.flatnonzero(np.abs(z).sum(axis=1))
        yield {"word": np.concatenate((some, -1 - np.arange(width))), "row": list(np.concatenate((z[some], gram)))}

    def summed(table):
        import pyarrow as pa

        rows = table.column("row").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        word, at = np.unique(table.column("word").to_numpy(), return_inverse=True)
        total = np.zeros((len(word), rows.shape[1]))
        np.add.at(total, at, rows)
        return pa.table({"word": pa.array(word, pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = arrow_pass(_lower(docs).select("text"), run, "word int, row array<double>")
    # Sums in two steps, so that no task gets more rows of a word than a slot has tasks.
    parts = parts.groupBy(F.pmod("word", F.lit(64)).alias("slot"), F.pmod(F.spark_partition_id(), F.lit(32)).alias("part")).applyInArrow(summed, "word int, row array<double>")
    rows = parts.groupBy(F.pmod("word", F.lit(64)).alias("slot")).applyInArrow(summed, "word int, row array<double>").toPandas()
    z, gram = np.zeros((len(idf), width)), np.zeros((width, width))
    for word, row in zip(rows["word"], rows["row"]):
        if word >= 0:
            z[word] = row
        else:
            gram[-1 - word] = row
    value, vector = np.linalg.eigh(gram)
    good = value > max(value.max(initial=0.0), 1e-12) * 1e-10
    b = (vector[:, good] / np.sqrt(value[good])).T @ z.T
    _, size, vt = np.linalg.svd(b, full_matrices=False)
    keep = size[: s.rank] > size.max(initial=0.0) * 1e-6
    return (vt[: s.rank][keep].T / size[: s.rank][keep]).astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; one addition of long integers for each word of ``b``."""
    where: dict[int, int] = {}
    for k, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for w in b.tolist():
        m = where.get(w)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def best_stretch(item: np.ndarray, words: np.ndarray, s: Settings) -> tuple[float, float, int]:
    """The largest share of the item that a stretch of ``words`` covers, of its answer there, and where it starts."""
    size, step = max(len(item), int(s.stretch * len(item))), max(1, len(item) // 4)
    answer = item[-max(3, -(-len(item) // 5)) :]
    best = (0.0, 0.0, 0)
    starts = sorted({*range(0, max(1, len(words) - size + 1), step), max(0, len(words) - size)})
    held = np.concatenate(([0], np.cumsum(np.isin(words, item)))).tolist()
    for at in starts:
        if best[0] >= 1.0:
            break
        if held[min(at + size, len(words))] - held[at] >= s.paraphrased * len(item) - 1e-9:
            part = words[at : at + size]
            share = lcs(item, part) / len(item)
            if share > best[0]:
                best = (share, lcs(answer, part) / len(answer), at)
    return best


def nearest(windows: np.ndarray, targets: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) of all pairs of unit vectors within ``cosine``: a product of blocks of at most 2**22 numbers."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, (1 << 22) // max(1, len(targets)))
    for k in range(0, len(windows), step):
        w, i = np.nonzero(windows[k : k + step] @ targets.T >= cosine)
        found.append((w + k, i))
    return tuple(map(np.concatenate, zip(*found)))


def leaks_in(words: np.ndarray, first: np.ndarray, items: Block, idf: np.ndarray, space: np.ndarray, targets: np.ndarray, s: Settings) -> list[tuple[int, int, float, float]]:
    """(row, item number, share, cosine) of the items that rows of a piece of a column leak."""
    at, number = items.hits(words)
    if not len(at):
        return []
    half = s.window // 2
    row = np.searchsorted(first, at, side="right") - 1
    start = np.concatenate(([0], np.cumsum(-(-np.diff(first) // half) + 1)))
    own, total = _grouped(space[number] * idf[number, None], start[row] + (at - first[row]) // half)
    # Window w holds half-windows w and w + 1; rows are a half-window apart.
    which = np.unique(np.concatenate((own, own - 1)))
    place = np.searchsorted(which, own)
    both = np.zeros((len(which), total.shape[1]), np.float32)
    both[place] = total
    before = which[np.maximum(place - 1, 0)] == own - 1
    both[place[before] - 1] += total[before]
    both /= np.maximum(np.sqrt((both**2).sum(axis=1)), 1e-9)[:, None]
    window, item, times = items.shared(start[row] + (at - first[row]) // half, number)
    held = times >= items.least[item]
    near_window, near_item = nearest(both, targets, s.cosine)
    key = np.union1d(np.searchsorted(which, window[held]) * len(items.ids) + item[held], near_window * len(items.ids) + near_item)
    window, item = key // len(items.ids), key % len(items.ids)
    # The row of a window; one half-window before a row's first belongs to none.
    row = np.searchsorted(start, which[window], side="right") - 1
    inside = (row >= 0) & (row < len(first) - 1)
    window, item, row = window[inside], item[inside], row[inside]
    cosine = np.empty(len(window), np.float32)
    for k in range(0, len(window), 1 << 16):
        cosine[k : k + (1 << 16)] = np.einsum("ij,ij->i", both[window[k : k + (1 << 16)]], targets[item[k : k + (1 << 16)]])
    best: dict[tuple[int, int], tuple[float, float]] = {}
    order = np.argsort(-cosine, kind="stable")
    row, item, cosine = row[order], item[order], cosine[order]
    offset, size = (which[window[order]] - start[row]) * half, np.array([len(w) for w in items.words])[item]
    lo = first[row] + np.maximum(0, offset - size)
    hi = np.minimum(first[row + 1], first[row] + offset + s.window + size)
    for i, k, value, a, b in zip(*(x.tolist() for x in (row, item, cosine, lo, hi))):
        if best.get((i, k), (0.0, 0.0))[0] >= 1.0:
            continue
        wanted, region = items.words[k], words[a:b]
        has = items.members[k]
        if sum(map(has.__getitem__, has.keys() & region.tolist())) < s.paraphrased * len(wanted) - 1e-9:
            continue
        share, answer, _ = best_stretch(wanted, region, s)
        if (share >= s.covered or (share >= s.paraphrased and answer >= s.answered)) and share > best.get((i, k), (0.0, 0.0))[0]:
            best[i, k] = (share, value)
    return [(i, k, share, value) for (i, k), (share, value) in best.items()]


def leaks(docs: DataFrame, bench: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, item_id, share, cosine: one row for each document and the item it leaks."""
    s = settings or Settings()
    rows = _lower(bench.select("item_id", "text").where("item_id is not null and text is not null")).toArrow()
    items = Items.of(rows.column("item_id").to_pylist(), rows.column("text"))
    if not len(items.vocabulary):
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, share double, cosine double")
    if len(items.vocabulary) > s.most_words:
        raise ValueError(f"the benchmark has {len(items.vocabulary)} different words, more than most_words = {s.most_words}: split it")
    n, df = passage_frequencies(docs, items, s.span)
    fewer = items.without_common(df, n, s)
    idf = np.log((n + 1) / (df[np.isin(items.vocabulary, fewer.vocabulary)] + 1)) + 1e-3
    space = latent_space(docs, fewer, idf, s)
    targets = fewer.vectors(idf, space)
    found = None
    for lo in range(0, len(fewer.ids), s.block):
        part = _searched(docs, Block.cut(fewer, lo, lo + s.block, s), idf.astype(np.float32), space, targets[lo : lo + s.block], s)
        found = part if found is None else found.union(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("cosine").alias("cosine"))


def _searched(docs: DataFrame, block: Block, idf: np.ndarray, space: np.ndarray, targets: np.ndarray, s: Settings) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((block, idf, space, targets))

    def run(batches):
        items, idf, space, targets = held.value
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for a, _, words, first in content_words(batch.column("text")):
                out += [(ids[a + i], items.ids[k], share, cosine) for i, k, share, cosine in leaks_in(words, first, items, idf, space, targets, s)]
            if out:
                yield dict(zip(("doc_id", "item_id", "share", "cosine"), map(list, zip(*out))))

    return arrow_pass(_lower(docs).select("doc_id", "text"), run, "doc_id long, item_id long, share double, cosine double")
