"""Operator 12: alignment of two tokenizers over the same bytes.

Side A is a byte-level BPE vocabulary (a Tokenizers file), side B a SentencePiece model; both encode a blank and the text. Where a token of either
side ends at the same byte, a group ends; within a group every token of A is linked to every token of B.

Texts are gathered into blocks and cut at blanks where tokens of either side must end, so each distinct part of a block is
encoded and aligned once: cumulative token ends of both sides are merged, ends met twice close groups, and groups give links. A document
is its parts in order. That is done inside mapInPandas. A block yields its documents, each with the numbers of the pairs it holds and how often, and
its distinct pairs with the number of its documents that hold them. Spark sums these counts, takes each side's maxima, joins both back to the
blocks' pairs, and these meet the documents of their block. No row holds all occurrences of anything: a pair has one row for each block.

Defined results: a null or empty text, or one that either side does not give back byte by byte, has no tokens and zeros; a null
doc_id is kept; repeated rows count as documents of their own; an empty table gives none; other columns are ignored. A text longer than a
block is a block of its own; a long stretch without common ends is counted by distinct ids, so its links are never written out one by one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import encoding
from .pretokens import cuts, distinct, packed, take_runs, unpacked
from .shared import Stage, give_back
from .textkit import CHUNK

#: Bytes of text that share a dictionary of parts and pairs.
BLOCK = 1 << 22
#: Links of a group that are written out; larger groups are counted by distinct ids.
LINKS = 1 << 14
#: Documents of a block, by the parts they hold, that are counted at once.
_PARTS = 1 << 19

_MADE = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, base long, pairs array<long>, docs array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_b long"


def read_byte_level(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a Tokenizers file whose merges rank as their results' ids; special tokens are left out. Other kinds are refused."""
    whole = json.loads(data)
    split, model = whole.get("pre_tokenizer") or {}, whole["model"]
    if whole.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("type") != "BPE":
        raise ValueError("not a plain byte-level BPE vocabulary")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    special = {x["content"] for x in whole.get("added_tokens", ())}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(set(made)):
        raise ValueError("merges do not rank as ids")
    return {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in special}


class Table:
    """Bytes of each entry in one flat table."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, at: np.ndarray) -> np.ndarray:
        return self.data[take_runs(self.size[at], self.start[at])]


class Sides:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        ranks = read_byte_level(a)
        self.a = encoding(ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            tokens[k] = token
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.tables = Table(tokens), Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        self.decimals = Table([f"{k}{mark}".encode() for k in range(max(len(tokens), len(pieces))) for mark in ",|;"])
        self._blank: list[int] | None = None

    def encode(self, units: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides. Each unit begins with a blank, which the second side adds itself."""
        texts = [u.decode() for u in units]
        coded = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [self.a.encode_ordinary(t) for t in texts], [self.blank() if t == " " else x for t, x in zip(texts, coded)]

    def blank(self) -> list[int]:
        """Ids of a last blank, which the second side would drop if it were all of a text."""
        if self._blank is None:
            self._blank = self.b.encode("a ")[len(self.b.encode("a")) :]
        return self._blank


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter((i for x in ids for i in x), np.int64), np.array([len(x) for x in ids], np.int64)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of two increasing sequences of ends the other has too: one pass over both in order, as a stable sort of two runs makes it."""
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")
    twice = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    in_a[order[twice]] = True
    in_b[order[twice + 1] - len(a)] = True
    return in_a, in_b


class Aligned:
    """Units of text, each aligned by itself: what a document adds up from its units."""

    def __init__(self, sides: Sides, units: list[bytes]):
        ids = sides.encode(units)
        text, n_units = np.frombuffer(b"".join(units), np.uint8), len(units)
        size = np.array([len(u) for u in units], np.int64)
        flat, self.same = [], np.ones(n_units, bool)
        for own, table in zip(ids, sides.tables):
            x, n = _flat(own)
            flat.append((x, n))
            total = np.concatenate(([0], np.cumsum(table.size[x])))[np.concatenate(([0], np.cumsum(n)))]
            data = table.joined(x)
            if not (np.array_equal(np.diff(total), size) and np.array_equal(data, text)):
                at = np.cumsum(size) - size
                self.same &= np.array([np.array_equal(data[total[k] : total[k + 1]], text[at[k] : at[k] + size[k]]) for k in range(n_units)], bool)
        (a, n_a), (b, n_b) = ((x[np.repeat(self.same, n)], np.where(self.same, n, 0)) for x, n in flat)
        ends = tuple(np.cumsum(t.size[x]) for t, x in zip(sides.tables, (a, b)))
        in_a, in_b = merged(*ends)
        group_a, group_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        n_groups = int(in_a.sum())
        c_a, c_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        unit_a = np.repeat(np.arange(n_units), n_a)
        unit_of = unit_a[in_a]
        links = np.concatenate(([0], np.cumsum(c_a * c_b)))
        first = np.searchsorted(unit_of, np.arange(n_units + 1))
        self.counts = np.stack([n_a, n_b, np.diff(first), np.diff(links[first])])
        self._write(sides, a, b, in_a, in_b, c_a, c_b, group_a, group_b, n_a + n_b)
        self._link(a, b, c_a, c_b, group_a, unit_a, unit_of, n_units)

    def _write(self, sides, a, b, in_a, in_b, c_a, c_b, group_a, group_b, n) -> None:
        """The units' groups in decimals: ``a1,a2|b1;`` for each."""
        out, mark = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        at_a = np.arange(len(a)) + (np.cumsum(c_b) - c_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(c_a)[group_b]
        out[at_a], out[at_b] = a, b
        mark[at_a[in_a]], mark[at_b[in_b]] = 1, 2
        at = out * 3 + mark
        data = sides.decimals.joined(at).tobytes()
        edge = np.concatenate(([0], np.cumsum(sides.decimals.size[at])))[np.concatenate(([0], np.cumsum(n)))].tolist()
        self.written = [data[x:y] for x, y in zip(edge, edge[1:])]

    def _link(self, a, b, c_a, c_b, group_a, unit_a, unit_of, n_units) -> None:
        """Pairs of each unit, as a * 2**32 + b, and how many links each stands for."""
        narrow = c_a * c_b <= LINKS
        rep = np.where(narrow, c_b, 0)[group_a]
        start_b = np.cumsum(c_b) - c_b
        pair = (np.repeat(a, rep) << 32) + b[take_runs(rep, start_b[group_a])]
        unit, times = np.repeat(unit_a, rep), np.ones(len(pair), np.int64)
        start_a = np.cumsum(c_a) - c_a
        for g in np.flatnonzero(~narrow):
            (x, m), (y, n) = (np.unique(s[at[g] : at[g] + c[g]], return_counts=True) for s, at, c in ((a, start_a, c_a), (b, start_b, c_b)))
            pair = np.concatenate((pair, ((x << 32)[:, None] + y).ravel()))
            times = np.concatenate((times, (m[:, None] * n).ravel()))
            unit = np.concatenate((unit, np.full(len(x) * len(y), unit_of[g])))
        if not narrow.all():
            order = np.argsort(unit, kind="stable")
            pair, times, unit = pair[order], times[order], unit[order]
        self.pair, self.times = pair, times
        self.n_pairs = np.bincount(unit, minlength=n_units)


def _weighted(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their weights."""
    if not len(key):
        return key, weight
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(weight, first)


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The code of each unit of the texts, each text's first (n + 1), and the distinct units."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    found = [offsets[:-1][np.diff(offsets) > 0]]
    for lo in range(0, len(data), CHUNK):
        back = max(lo - 3, 0)
        at = cuts(data[back : lo + CHUNK]) + back
        found.append(at[at >= lo])
    at = np.unique(np.concatenate(found))
    codes, units = distinct(data, at)
    return codes.astype(np.int64), np.searchsorted(at, offsets), units.to_pylist()


def _block(sides: Sides, block: int, ids: list[int | None], texts: list[str | None], whole: bool) -> Iterator[pd.DataFrame]:
    """The documents of a block, then its pairs."""
    coded = [b" " + t.encode() if t else b"" for t in texts]
    codes, first, units = _units(coded)
    own = Aligned(sides, units)
    counts, written, n_pairs, pair, times = own.counts, own.written, own.n_pairs, own.pair, own.times
    if not own.same.all():  # the texts that hold such units decide as a whole
        odd = np.concatenate(([0], np.cumsum(~own.same[codes])))
        rows = np.flatnonzero(odd[first[1:]] > odd[first[:-1]]).tolist()
        more = Aligned(sides, [coded[r] for r in rows])
        instead = dict(zip(rows, range(len(units), len(units) + len(rows))))
        parts = [np.array([instead[r]]) if r in instead else codes[a:b] for r, (a, b) in enumerate(zip(first, first[1:]))]
        codes, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        counts, written = np.concatenate((counts, more.counts), axis=1), written + more.written
        n_pairs, pair, times = np.concatenate((n_pairs, more.n_pairs)), np.concatenate((pair, more.pair)), np.concatenate((times, more.times))
    pairs, place = np.unique(pair, return_inverse=True)
    start = np.cumsum(n_pairs) - n_pairs
    sums = np.concatenate((np.zeros((4, 1), np.int64), np.cumsum(counts[:, codes], axis=1)), axis=1)
    sums = sums[:, first[1:]] - sums[:, first[:-1]]
    docs = np.zeros(len(pairs), np.int64)
    row = 0
    while row < len(ids):
        end = max(row + 1, int(np.searchsorted(first, first[row] + _PARTS, side="right")) - 1)
        here, of = codes[first[row] : first[end]], np.repeat(np.arange(end - row), np.diff(first[row : end + 1]))
        key, n = np.unique(of * len(written) + here, return_counts=True)
        of, here = np.divmod(key, max(len(written), 1))
        at = take_runs(n_pairs[here], start[here])
        key, n = _weighted(np.repeat(of, n_pairs[here]) * max(len(pairs), 1) + place[at], times[at] * np.repeat(n, n_pairs[here]))
        of, held = np.divmod(key, max(len(pairs), 1))
        docs += np.bincount(held, minlength=len(pairs))
        edge = np.searchsorted(of, np.arange(end - row + 1))
        texts_of = [_groups(written, codes[a:b], whole) for a, b in zip(first[row:end], first[row + 1 : end + 1])]
        spans_ = list(zip(edge, edge[1:]))
        yield _frame(block=block, doc_id=pd.array(ids[row:end], "Int64"), n_a=sums[0, row:end], n_b=sums[1, row:end], n_groups=sums[2, row:end], n_links=sums[3, row:end], groups=texts_of, places=[packed(held[a:b]) for a, b in spans_], times=[packed(n[a:b], "<u8") for a, b in spans_])
        row = end
    for at in range(0, len(pairs), 1 << 16):
        yield _frame(block=[block], base=[at], pairs=[pairs[at : at + (1 << 16)]], docs=[docs[at : at + (1 << 16)]])


_NAMES = [c.split()[0] for c in _MADE.split(", ")]


def _frame(**columns) -> pd.DataFrame:
    n = len(next(x for x in columns.values() if not isinstance(x, int)))
    frame = pd.DataFrame({c: columns.get(c, [None] * n) for c in _NAMES})
    return frame.astype({c: "Int64" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "base")})


def _groups(written: list[bytes], codes: np.ndarray, whole: bool) -> str:
    """The groups of a document, or their digest; empty without tokens."""
    if whole:
        return b"".join(written[c] for c in codes.tolist())[:-1].decode()
    digest, last = hashlib.sha256(), b""
    for at in range(0, len(codes), CHUNK):
        digest.update(last)
        last = b"".join([written[c] for c in codes[at : at + CHUNK].tolist()])
    digest.update(last[:-1])
    return digest.hexdigest() if last else ""


def _made(docs: DataFrame, a: bytes, b: bytes, block: int, whole: bool = False) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(frames):
        sides, task, k = Sides(*held.value), TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(text)
                size += len(text or "")
                if size >= block:
                    yield from _block(sides, task + k, ids, texts, whole)
                    ids, texts, size, k = [], [], 0, k + 1
                    give_back()
        if ids:
            yield from _block(sides, task + k, ids, texts, whole)
        give_back()

    # as text, since pandas would make floats of a column with nulls
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, _MADE)


def alignments(docs: DataFrame, a: bytes, b: bytes, block: int = BLOCK) -> DataFrame:
    """doc_id, groups: array of (a, b), the ids of both sides in order."""
    ids = lambda g, k: F.transform(F.split(F.get(F.split(g, r"\|"), F.lit(k)), ","), lambda x: x.cast("int"))
    groups = F.transform(F.split("groups", ";"), lambda g: F.struct(ids(g, 0).alias("a"), ids(g, 1).alias("b")))
    none = F.array().cast("array<struct<a:array<int>,b:array<int>>>")
    return _made(docs, a, b, block, True).where("groups is not null").select("doc_id", F.when(F.col("groups") == "", none).otherwise(groups).alias("groups"))


def _pairs(made: DataFrame) -> DataFrame:
    """block, place, pair, docs: each block's pairs with their numbers."""
    rows = made.where("pairs is not null").select("block", "base", F.posexplode(F.arrays_zip("pairs", "docs")).alias("i", "p"))
    return rows.select("block", (F.col("base") + F.col("i")).alias("place"), F.col("p.pairs").alias("pair"), F.col("p.docs").alias("docs")).where("docs > 0")


def _known(counted: DataFrame) -> DataFrame:
    """pair, a, b, n, most_a, most_b: counts, and the highest count of each id on either side."""
    counted = counted.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "n")
    out = counted
    for side in ("a", "b"):
        out = out.join(counted.groupBy(side).agg(F.max("n").alias(f"most_{side}")), side)
    return out


def pair_counts(docs: DataFrame, a: bytes, b: bytes, block: int = BLOCK) -> DataFrame:
    """a, b, n (documents that hold the pair linked), most_a, most_b (the highest n of the id on its side)."""
    stage = Stage(docs.sparkSession, "alignment")
    made = stage.write(_made(docs, a, b, block), "made")
    return _known(_counted(made, stage)).select("a", "b", "n", "most_a", "most_b")


def _counted(made: DataFrame, stage: Stage) -> DataFrame:
    return stage.write(_pairs(made).groupBy("pair").agg(F.sum("docs").alias("n")), "counted")


def digests(docs: DataFrame, a: bytes, b: bytes, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of its A id), count_sum (over links), groups_sha256, n_best_b."""
    stage = Stage(docs.sparkSession, "alignment")
    made = stage.write(_made(docs, a, b, block), "made")
    best = F.when(F.col("n") == F.col("most_a"), 1).otherwise(0) + F.when(F.col("n") == F.col("most_b"), 2).otherwise(0)
    known = _known(_counted(made, stage)).select("pair", "n", best.alias("best"))
    back = _pairs(made).select("block", "place", "pair").join(known, "pair").select(F.col("block").alias("of"), "place", "n", "best")
    rows = made.where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "places", "times")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("place").to_numpy()
        n, best = np.zeros((2, int(at.max(initial=-1)) + 1), np.int64)
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        sums = []
        for places, times in zip(left.column("places"), left.column("times")):
            held, times = unpacked(places.as_py()), unpacked(times.as_py(), "<u8")
            sums.append((int(times[best[held] & 1 > 0].sum()), int((n[held] * times).sum()), int(times[best[held] & 2 > 0].sum())))
        n_best, count_sum, n_best_b = zip(*sums)
        columns = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), left.column("groups"), pa.array(n_best_b, pa.int64())], names=[c.split()[0] for c in _RESULT.split(", ")])

    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, _RESULT)
