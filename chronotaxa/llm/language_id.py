"""Operator 3: language identification with bit-sliced Bloom filters over byte n-grams.

Training counts 4-byte n-grams of lower-cased text (everything that is no letter becomes a blank) by
language over all labelled rows. An n-gram belongs to a language if its rate there is at least
``share`` of its highest rate in any language. One Bloom table holds every language's filter side by
side: a slot is a bit mask of languages, and the conjunction of an n-gram's slots names all the
languages that contain it. A text's n-grams are looked up at once; per-language popcounts c, corrected
for the language's false positive rate f over n lookups, (c - n f) / (1 - f), decide.

Every n-gram counts, however many there are: filters are built where the n-grams lie, and only the table's bytes are collected.
The table has 16 slots for each n-gram of the language that has most, as far as ``room`` bytes allow (a slot takes one byte for each eight
languages); with fewer slots false positives grow and the correction takes them out. Rows of the table have a bit for each language, so all labels
are learned or none: more than ``languages`` of them, or a table that ``room`` leaves less than half a slot for each n-gram of the fullest
language, are refused with what they would take.

Defined results: ``und`` with score 0 for a null text or one without a letter (also for every row if
nothing could be learned); ties, and texts none of whose n-grams are known, go to the language with more
training rows, then to the smaller name. A row without doc_id teaches nothing and is not held out. Repeated rows are predicted row by row. Texts of any
length are read in bounded pieces. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .shared import Stage, arrow_pass, crc_mod, pieces

UNKNOWN = "und"
_WIDTH = 4
#: Odd multipliers of the table's hash functions.
_HASHES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CLEAN = np.full(256, 32, dtype=np.uint8)
_CLEAN[97:123] = _CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray, begins: bool = True, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the rows as uint32, each row between blanks, without those that hold two blanks in a row.

    Without the n-gram over the first blank if the data do not begin there, or over the last if they do not end there.
    """
    n = np.diff(offsets)
    padded = np.full(len(data) + 2 * len(n), 32, dtype=np.uint8)
    row = np.repeat(np.arange(len(n)), n)
    padded[np.arange(len(data)) + 2 * row + 1] = _CLEAN[data]
    first = offsets + 2 * np.arange(len(offsets))
    if len(padded) < _WIDTH:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    b = padded.astype(np.uint32)
    g = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    blank = padded == 32
    double = blank[:-1] & blank[1:]
    drop = double[:-2] | double[1:-1] | double[2:]
    drop[0] |= not begins
    drop[-1] |= not ends
    keep = np.flatnonzero(~drop)
    return g[keep], np.searchsorted(keep, first)


def gram_rows(column):
    """(first row, end row, n-grams, first n-gram of each row, which rows have an ASCII letter); a long row comes in several pieces."""
    data, offsets = textkit.buffers(column)
    for a, b in textkit.slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b > a + 1 or hi - lo <= textkit.CHUNK:
            o = offsets[a : b + 1] - lo
            g, first = grams(data[lo:hi], o)
            letters = np.concatenate(([0], np.cumsum(_LETTER[data[lo:hi]], dtype=np.int64)))[o]
            yield a, b, g, first, np.diff(letters) > 0
            continue
        for at in range(lo, hi, textkit.CHUNK):
            # Pieces overlap by one byte less than an n-gram; the blanks that ``grams`` puts at a cut make n-grams of none.
            part = data[max(lo, at - _WIDTH + 1) : min(hi, at + textkit.CHUNK)]
            g, _ = grams(part, np.array([0, len(part)]), at == lo, at + textkit.CHUNK >= hi)
            yield a, b, g, np.array([0, len(g)]), np.array([_LETTER[part].any()])


def slots_of(n: int, g: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram in a table of n, a power of two."""
    shift = np.uint32(32 - (n - 1).bit_length())
    with np.errstate(over="ignore"):
        return [(g * np.uint32(k)) >> shift for k in _HASHES]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    def masks(self, g: np.ndarray) -> np.ndarray:
        """Bit masks of the languages that contain each n-gram."""
        a, *rest = (self.table[s] for s in slots_of(len(self.table), g))
        for x in rest:
            a = a & x
        return a

    def counts(self, g: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Popcounts, rows by languages."""
        out = np.zeros((len(first) - 1, len(self.languages)))
        if len(g):
            masks = self.masks(g)
            for k in range(len(self.languages)):
                bits = (masks[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1)
                total = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
                out[:, k] = total[first[1:]] - total[first[:-1]]
        return out

    def corrected(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Popcounts without the false positives expected of n lookups."""
        return np.maximum(0.0, (counts - n[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9))


def fit(rows: DataFrame, *, share: float = 0.3, slots: int = 1 << 21, room: int = 1 << 26, languages: int = 1 << 16, flush: int = 1 << 19) -> Model:
    """Learns from all rows of (text, lang); null texts and labels teach nothing."""
    rows = rows.select("text", "lang").where("text is not null and lang is not null")
    names = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages + 1).collect()]
    if len(names) > languages:
        raise ValueError(f"there are more than {languages} labels; none is left out silently")
    at = {name: i for i, name in enumerate(names)}
    if not names:
        return Model([], np.zeros((1, 1), np.uint8), np.zeros(0))

    def counted(batches):
        held, size = [], 0

        def out():
            key, n = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = np.bincount(n, weights=np.concatenate([c for _, c in held]), minlength=len(key)).astype(np.int64)
            return {"gram": (key >> np.uint64(16)).astype(np.int64), "lang": (key & np.uint64(0xFFFF)).astype(np.int32), "n": total}

        for batch in batches:
            which = [at.get(x, -1) for x in batch.column("lang").to_pylist()]
            learned = pa.array([k >= 0 for k in which])
            lang = np.array([k for k in which if k >= 0], dtype=np.uint64)
            for a, b, g, first, _ in gram_rows(batch.column("text").filter(learned)):
                key = (g.astype(np.uint64) << np.uint64(16)) | np.repeat(lang[a:b], np.diff(first))
                held.append(np.unique(key, return_counts=True))
                size += len(held[-1][0])
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    sums = arrow_pass(rows, counted, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    stage = Stage(rows.sparkSession, "grams")
    sums = stage.write(sums)
    members = stage.write(_members(sums, share))
    fullest = members.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    width = (len(names) + 7) // 8
    while slots < 16 * fullest and 2 * slots * width <= room:
        slots *= 2
    while slots > 1 << 10 and slots * width > room:
        slots //= 2
    if 2 * slots < fullest:  # nearly every lookup would be a false positive
        raise ValueError(f"{fullest} n-grams of one of {len(names)} languages need a table of {fullest * width // 2} bytes at least; room is {room}")
    model = Model(names, np.zeros((slots, width), dtype=np.uint8), np.zeros(len(names)))

    def placed(batches):
        for batch in batches:
            lang, gram = batch.column("lang").to_numpy().astype(np.int64), batch.column("gram").to_numpy().astype(np.uint32)
            key = np.concatenate([s.astype(np.int64) * len(names) + lang for s in slots_of(slots, gram)])
            slot, lang = np.divmod(np.unique(key), len(names))
            place, which = np.unique(slot * width + lang // 8, return_inverse=True)
            mask = np.zeros(len(place), np.int64)
            np.bitwise_or.at(mask, which, 1 << (lang % 8))
            yield {"place": place, "mask": mask}

    bits = arrow_pass(members, placed, "place long, mask int").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    model.table.reshape(-1)[bits.column("place").to_numpy()] = bits.column("mask").to_numpy().astype(np.uint8)
    stage.drop(sums, members)
    density = np.array([np.mean((model.table[:, k // 8] >> np.uint8(k % 8)) & 1) for k in range(len(names))])
    return Model(names, model.table, density ** len(_HASHES))


def _members(sums: DataFrame, share: float) -> DataFrame:
    """(gram, lang): the languages that each n-gram belongs to."""
    size = sums.groupBy("lang").agg(F.sum("n").alias("per"))
    rated = sums.join(F.broadcast(size), "lang").select("gram", "lang", (F.col("n") / F.col("per")).alias("rate"))  # one row for each language
    each = rated.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("by"))
    return each.select("gram", "most", F.explode("by").alias("x")).where(F.col("x.rate") >= share * F.col("most")).select("gram", "x.lang")


def judge(m: Model, texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, the winner's lead over the runner-up, and the share of n-grams it contains, for each text of a column."""
    pred, score, support = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    c, n, has = np.zeros((len(texts), len(m.languages))), np.zeros(len(texts), np.int64), np.zeros(len(texts), dtype=bool)
    for a, b, g, first, letter in gram_rows(texts):
        has[a:b] |= letter
        n[a:b] += np.diff(first)
        if m.languages:
            c[a:b] += m.counts(g, first)
    for i in np.flatnonzero(~has & (n > 0)):
        has[i] = any(map(str.isalpha, texts[int(i)].as_py()))
    if m.languages:
        c = m.corrected(c, n)
        best, order = c.argmax(axis=1), np.sort(c, axis=1)
        top, second = order[:, -1], order[:, -2] if c.shape[1] > 1 else 0.0 * order[:, -1]
        score = np.where(has & (top > 0), top / np.maximum(top + second, 1e-9), 0.0)
        support = np.where(has, np.minimum(1.0, top / np.maximum(n, 1)), 0.0)
        for i in np.flatnonzero(has):
            pred[i] = m.languages[best[i]]
    return pred, score, support


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, support."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        for batch in batches:
            pred, score, support = judge(held.value, batch.column("text"))
            yield {"doc_id": batch.column("doc_id"), "lang_pred": pred, "score": score, "support": support}

    return arrow_pass(docs.select("doc_id", "text"), judged, "doc_id long, lang_pred string, score double, support double")


def keep_known(docs: DataFrame, least_support: float, **options) -> DataFrame:
    """The documents in a learned language that contains at least that share of their n-grams; one narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs.where(crc_mod("doc_id", 4) != 2), **options))

    def kept(batches):
        for batch in batches:
            for part in pieces(batch):
                pred, _, support = judge(held.value, part.column("text"))
                yield part.filter(pa.array([p != UNKNOWN and s >= least_support for p, s in zip(pred, support)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, support; learned from the rows whose crc32 remainder by 4 is not 2."""
    model = fit(docs.where(crc_mod("doc_id", 4) != 2), **options)
    return predict(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "support")
