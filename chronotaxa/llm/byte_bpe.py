"""Operator 13: byte-level BPE encoding and decoding, each distinct word encoded once.

Texts are gathered into blocks of ``BLOCK`` bytes. A block's texts are cut into pre-tokens; what it holds is its
distinct words and, for every position, the word's number. The distinct words of all blocks are shuffled by their
hash: whatever its frequency, a word has one row's entry for each block it occurs in, so no key is hot. The task
that receives a word encodes it once; ids go back to the blocks, where the documents are put together by position.
Positions never move: they are written in buckets of their block, to which the ids are shuffled.

Decoding looks the ids up in the table of token bytes (as many rows as the vocabulary has): ``decode`` by a Spark join for any
table of ids, ``digests`` by the same table inside the task that has put a document's ids together.

Defined results: a null or empty text has no ids and decodes to no bytes; a null doc_id is kept; repeated rows are encoded row
by row; an empty table gives none; other columns are ignored. A text longer than a block is a block of its own, and a task
takes a few times its size. Words longer than ``MEMORABLE`` bytes are not remembered, so what a task keeps is bounded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from . import pretokens
from .pretokens import PATTERN, block_words, blocks, packed, take_runs, unpacked
from .shared import Stage, give_back

#: Bytes of text that share a dictionary.
BLOCK = 1 << 25
#: Positions in a row.
PART = 1 << 20
#: Words whose ids a task keeps, and the longest of them in bytes.
REMEMBERED, MEMORABLE = 1 << 20, 256

_LONG, _BYTES = pa.int64(), pa.binary()
_EXPLODED = pa.schema({"block": _LONG, "part": _LONG, "doc_ids": pa.list_(_LONG), "sizes": pa.list_(_LONG), "begun": pa.bool_(), "places": _BYTES, "slice": pa.int32(), "codes": _BYTES, "lengths": _BYTES, "words": _BYTES})
_CODED = pa.schema({"block": _LONG, "codes": _BYTES, "sizes": _BYTES, "ids": _BYTES})


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


def encoding(ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Vocabulary:
    """Token bytes in one flat table, by id."""

    def __init__(self, ranks: dict[bytes, int]):
        size = np.zeros(max(ranks.values(), default=-1) + 2, np.int64)
        for token, rank in ranks.items():
            size[rank + 1] = len(token)
        self.start = np.cumsum(size)
        self.bytes = np.zeros(self.start[-1], np.uint8)
        for token, rank in ranks.items():
            self.bytes[self.start[rank] : self.start[rank + 1]] = np.frombuffer(token, np.uint8)

    def decoded(self, ids: np.ndarray) -> bytes:
        at = self.start[ids]
        return self.bytes[take_runs(self.start[ids + 1] - at, at)].tobytes()


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)


def _parts(first: np.ndarray, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, end row, position, end position): whole texts of at most ``most`` positions together; longer texts come in several parts."""
    n, row = len(first) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(first, first[row] + most, side="right")) - 1)
        for at in range(int(first[row]), max(int(first[end]), int(first[row]) + 1), most):
            yield row, end, at, min(at + most, int(first[end]))
        row = end


def _slices(words: pa.Array, n: int) -> np.ndarray:
    """Which of ``n`` slices each word belongs to, by its bytes alone."""
    from .textkit import buffers, span_hashes

    data, offsets = buffers(words)
    out = np.empty(len(words), np.int64)
    at = 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 18), side="right")) - 1)
        lo, hi = offsets[at], offsets[end]
        out[at:end] = span_hashes(data[lo:hi], offsets[at:end] - lo, offsets[at + 1 : end + 1] - lo) % np.uint64(n)
        at = end
    return out


def _block_rows(block: int, batch: pa.RecordBatch, table: np.ndarray, n: int, most: int) -> Iterator[pa.RecordBatch]:
    """A block as rows of positions, and as rows of words for each slice. Frequent words get small numbers."""
    codes, first, words = block_words(batch.column("text"), table)
    count = np.bincount(codes, minlength=len(words))
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes, words = rank[codes], words.take(pa.array(order))
    ids = batch.column("doc_id")
    for part, (a, b, lo, hi) in enumerate(_parts(first, most)):
        sizes = np.diff(np.clip(first[a : b + 1], lo, hi))
        yield _row(_EXPLODED, block=block, part=part, doc_ids=ids[a:b].to_pylist(), sizes=sizes, begun=bool(lo == first[a]), places=packed(codes[lo:hi]))
    of = _slices(words, n)
    order = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edge)):
        own = order[edge[k] : edge[k + 1]]
        part = words.take(pa.array(own))
        data, offsets = pretokens.buffers(part)
        yield _row(_EXPLODED, block=block, slice=int(k), codes=packed(np.diff(own, prepend=0)), lengths=packed(np.diff(offsets)), words=data.tobytes())


def _exploded(docs: DataFrame, n: int, size: int, most: int) -> DataFrame:
    """Blocks of positions and of words. ``n``: slices that the words are dealt to; ``size``: bytes of a block; ``most``: positions of a row."""
    table = docs.sparkSession.sparkContext.broadcast(pretokens.classes())
    ids = F.col("doc_id").cast("long").alias("doc_id")

    def run(batches):
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(blocks(batches, size)):
            yield from _block_rows((task << 32) + k, batch, table.value, n, most)
        give_back()

    return docs.select(ids, "text").mapInArrow(run, from_arrow_schema(_EXPLODED))


def _encoded(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Ids for the words of each row; a task encodes a word when it first meets it."""
    held = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encode, known = encoding(held.value).encode_ordinary, {}
        for batch in batches:
            for k in range(batch.num_rows):
                data, ends = batch.column("words")[k].as_py(), np.cumsum(unpacked(batch.column("lengths")[k].as_py())).tolist()
                ids = []
                for a, b in zip([0, *ends], ends):
                    word = data[a:b]
                    got = known.get(word)
                    if got is None:
                        got = encode(word.decode())
                        if len(word) <= MEMORABLE:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[word] = got
                    ids.append(got)
                flat = np.fromiter((i for x in ids for i in x), np.int64)
                yield _row(_CODED, block=batch.column("block")[k].as_py(), codes=batch.column("codes")[k].as_py(), sizes=packed(np.array([len(x) for x in ids])), ids=packed(flat))
        give_back()

    return words.mapInArrow(run, from_arrow_schema(_CODED))


def _dictionary(coded: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, size): the ids of all words of a block, and where those of each number lie."""
    codes = [np.cumsum(unpacked(x.as_py())) for x in coded.column("codes")]
    if not codes:
        none = np.zeros(0, np.int64)
        return none, none, none
    codes = np.concatenate(codes)
    sizes = np.concatenate([unpacked(x.as_py()) for x in coded.column("sizes")])
    start, size = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
    start[codes], size[codes] = np.cumsum(sizes) - sizes, sizes
    return np.concatenate([unpacked(x.as_py()) for x in coded.column("ids")]), start, size


def _assembled(docs: DataFrame, ranks: dict[bytes, int], document: Callable, schema: str, block: int, part: int) -> DataFrame:
    """``document(pieces)`` makes a dict of columns of the pieces of ids of one document, in order; ``schema`` has doc_id first."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stage = Stage(spark, "byte-bpe")
    all_ = stage.write_bucketed(_exploded(docs, n, block, part), "block", n, "positions")
    words = all_.where("slice is not null").select("block", "slice", "codes", "lengths", "words")
    coded = _encoded(words.repartitionById(n, F.col("slice")), ranks)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, start, size = _dictionary(right)
        left = left.sort_by("part").to_batches()
        rows, open_ = [], None  # the document that the next part may go on with

        def pieces(parts):
            for places in parts:
                for at in range(0, len(places), 1 << 16):
                    part = places[at : at + (1 << 16)]
                    yield ids[take_runs(size[part], start[part])]

        def close(doc_id, parts):
            rows.append({"doc_id": doc_id, **document(pieces(parts))})

        for batch in left:
            for k in range(batch.num_rows):
                places = unpacked(batch.column("places")[k].as_py())
                doc_ids, ends = batch.column("doc_ids")[k].as_py(), np.cumsum(batch.column("sizes")[k].as_py())
                if not batch.column("begun")[k].as_py():
                    open_[1].append(places)
                    continue
                if open_:
                    close(*open_)
                    open_ = None
                for doc_id, a, b in zip(doc_ids[:-1], [0, *ends[:-1]], ends[:-1]):
                    close(doc_id, [places[a:b]])
                open_ = (doc_ids[-1], [places[ends[-2] if len(ends) > 1 else 0 :]])
        if open_:
            close(*open_)
        return pa.Table.from_pylist(rows, schema=arrow)

    positions = all_.where("slice is null").select("block", "part", "doc_ids", "sizes", "begun", "places")
    return positions.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(run, schema)


def encode(docs: DataFrame, ranks: bytes, block: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id, ids."""

    def document(pieces):
        return {"ids": [i for x in pieces for i in x.tolist()]}

    return _assembled(docs, read_ranks(ranks), document, "doc_id long, ids array<int>", block, part)


def digests(docs: DataFrame, ranks: bytes, block: int = BLOCK, part: int = PART) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of ids as little-endian 32-bit numbers), decoded_sha256 (of the bytes they decode to)."""
    table = read_ranks(ranks)
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary(table))

    def document(pieces):
        n, coded, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for ids in pieces:
            n += len(ids)
            coded.update(ids.astype("<u4").tobytes())
            decoded.update(held.value.decoded(ids))
        return {"n_tokens": n, "ids_sha256": coded.hexdigest(), "decoded_sha256": decoded.hexdigest()}

    return _assembled(docs, table, document, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", block, part)


def token_bytes(spark: SparkSession, ranks: bytes) -> DataFrame:
    """id, token: the vocabulary as a table."""
    return spark.createDataFrame([(rank, bytearray(token)) for token, rank in read_ranks(ranks).items()], "id int, token binary")


def decode(tokens: DataFrame, ranks: bytes, run: int = 4096) -> DataFrame:
    """doc_id, bytes: ids (array<int>) are exploded with their positions, meet the table of token bytes, and are put together again.

    Rows are told apart by a number of their own, so repeated doc_ids stay apart; runs of ``run`` ids are joined first and then each
    other, null or no ids give null or no bytes; an id that the vocabulary lacks is an error.
    """
    stage = Stage(tokens.sparkSession, "byte-bpe")
    rows = stage.write(tokens.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")), "ids")
    table = token_bytes(tokens.sparkSession, ranks).select("id", F.hex("token").alias("token"))
    each = rows.select("row", F.posexplode("ids").alias("at", "id")).join(F.broadcast(table), "id", "left")
    token = F.when(F.col("token").isNull(), F.raise_error(F.concat(F.lit("no such id: "), F.col("id").cast("string")))).otherwise(F.col("token"))
    joined = lambda at, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, x))), lambda s: s[x]), "")
    runs = each.select("row", F.expr(f"at div {run}").alias("run"), "at", token.alias("token")).groupBy("row", "run").agg(joined("at", "token").alias("token"))
    whole = runs.groupBy("row").agg(joined("run", "token").alias("token"))
    out = rows.select("row", "doc_id", F.col("ids").isNull().alias("none")).join(whole, "row", "left")
    return out.select("doc_id", F.when(~F.col("none"), F.unhex(F.coalesce("token", F.lit("")))).alias("bytes"))
