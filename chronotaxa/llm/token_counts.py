"""Operator 8: token counts by a separator scan over flat, unindexed token files.

A token file is nothing but identifiers of fixed width, each document followed by an end-of-document
identifier. Files are scanned in blocks that know nothing of document boundaries. Each block is
searched with one vectorised comparison; a document that crosses blocks is stitched together by a prefix
scan over block summaries (tokens, separators, last separator), first inside chunks of ``CHUNK_BLOCKS``
blocks and then over the chunks' totals, so that no task sees more than one chunk of one file.

Blocks come from ``pack`` (documents encoded into flat streams, one for each task, in the shared folder)
or from ``file_blocks`` (raw files in storage that all executors mount, read by ranges).

Defined results: a null or empty text is a document of 0 tokens; two separators in a row enclose a
document of 0 tokens; tokens after a file's last separator are a document that is not ``ended``; an empty
file has no document. Repeated rows are documents of their own; a null doc_id is kept. A text is encoded whole, by the library, whatever its
length. Identifiers that the width cannot hold, and an end-of-document identifier that the vocabulary has, are refused. Other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Stage, arrow_pass

CHUNK_BLOCKS = 1024
#: The pattern that the rank files' vocabularies split text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    return f"{os.environ.get('CHRONOTAXA_TOKENIZERS', '/opt/tokenizers')}/{name}"


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def pack(docs: DataFrame, ranks: bytes, eod: int = 50256, dtype: str = "<u2", block_tokens: int = 1 << 19) -> DataFrame:
    """Encodes documents into one flat stream for each task.

    Rows (file, block, tokens): the stream cut every ``block_tokens`` identifiers, wherever that is. Rows
    (file, doc_id, ordinal): which document is the stream's n-th.
    """
    known = {int(line.split()[1]) for line in ranks.splitlines()}
    if eod in known:
        raise ValueError(f"{eod} is an identifier of the vocabulary, so it cannot end documents")
    if max(known | {eod}) > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} is too narrow for identifiers up to {max(known | {eod})}")
    held = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        enc, file = encoder(held.value), TaskContext.get().partitionId()
        rest, size, block, ordinal = [], 0, 0, 0

        def cut(whole: np.ndarray):
            return {"file": [file], "block": [block], "tokens": [whole.astype(dtype).tobytes()], "doc_id": [None], "ordinal": [None]}

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            yield {"file": [file] * len(ids), "block": [None] * len(ids), "tokens": pa.nulls(len(ids), pa.binary()), "doc_id": ids, "ordinal": np.arange(ordinal, ordinal + len(ids))}
            ordinal += len(ids)
            for text in batch.column("text"):
                one = np.array([*enc.encode_ordinary(text.as_py() or ""), eod], dtype=np.int64)
                rest.append(one)
                size += len(one)
                if size >= block_tokens:
                    flat, at = np.concatenate(rest), 0
                    while len(flat) - at >= block_tokens:
                        yield cut(flat[at : at + block_tokens])
                        at += block_tokens
                        block += 1
                    rest, size = [flat[at:]], len(flat) - at
        if size:
            yield cut(np.concatenate(rest))

    return arrow_pass(docs.select("doc_id", "text"), run, "file long, block long, tokens binary, doc_id long, ordinal long")


def file_blocks(spark: SparkSession, paths: list[str], dtype: str = "<u2", block_tokens: int = 1 << 19) -> DataFrame:
    """(file, block, tokens) of raw files, read by ranges; file is the path's place in ``paths``."""
    width = np.dtype(dtype).itemsize
    ranges = [(i, b) for i, p in enumerate(paths) for b in range(-(-Path(p).stat().st_size // (width * block_tokens)))]
    plan = spark.createDataFrame(ranges, "file long, block long").repartition(max(1, min(len(ranges), 10_000)))

    def run(batches):
        for batch in batches:
            for file, block in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
                with open(paths[file], "rb") as f:
                    f.seek(block * block_tokens * width)
                    yield {"file": [file], "block": [block], "tokens": [f.read(block_tokens * width)]}

    return arrow_pass(plan, run, "file long, block long, tokens binary")


def _searched(blocks: DataFrame, eod: int, dtype: str) -> DataFrame:
    """(file, block, n, ends): a block's length and the places of its separators."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                t = np.frombuffer(batch.column("tokens")[k].as_buffer(), dtype=dtype)
                yield {"file": [batch.column("file")[k].as_py()], "block": [batch.column("block")[k].as_py()], "n": [len(t)], "ends": [np.flatnonzero(t == eod).astype(np.int64)]}

    return arrow_pass(blocks.select("file", "block", "tokens"), run, "file long, block long, n long, ends array<long>")


def scan(blocks: DataFrame, eod: int = 50256, dtype: str = "<u2", stage: Stage | None = None) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document in the files."""
    stage = stage or Stage(blocks.sparkSession, "tokens")
    found = stage.write(_searched(blocks, eod, dtype).withColumn("chunk", F.expr(f"block div {CHUNK_BLOCKS}")), "found")
    one = found.select("file", "chunk", "block", "n", F.size("ends").cast("long").alias("k"), F.expr("if(size(ends) > 0, ends[size(ends) - 1] + 1, null)").alias("last"))
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    one = one.withColumns({"n_before": zero(F.sum("n").over(inside)), "k_before": zero(F.sum("k").over(inside))})
    one = one.withColumn("at", F.col("n_before") + F.col("last"))
    one = one.withColumn("at_before", F.max("at").over(inside))
    chunks = one.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("at").alias("at"))
    over = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({"c_n": zero(F.sum("n").over(over)), "c_k": zero(F.sum("k").over(over))}).withColumn("c_at", F.col("c_n") + F.col("at"))
    chunks = chunks.withColumns({"c_at_before": zero(F.max("c_at").over(over)), "final": F.lead("chunk").over(Window.partitionBy("file").orderBy("chunk")).isNull(), "total": F.col("c_n") + F.col("n"), "total_k": F.col("c_k") + F.col("k"), "end": F.coalesce(F.max("c_at").over(over.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    chunks = stage.write(chunks, "chunks")
    known = one.select("file", "chunk", "block", "n_before", "k_before", "at_before").join(chunks.select("file", "chunk", "c_n", "c_k", "c_at_before"), ["file", "chunk"])
    known = known.select("file", "block", (F.col("c_k") + F.col("k_before")).alias("k0"), (F.col("c_n") + F.col("n_before") - F.greatest("c_at_before", F.coalesce(F.col("c_n") + F.col("at_before"), F.lit(0)))).alias("carry"))
    parts = found.where("size(ends) > 0").select("file", "block", "ends").join(known, ["file", "block"])
    length = F.expr("transform(ends, (e, i) -> if(i = 0, e + carry, e - ends[i - 1] - 1))")
    ended = parts.select("file", "k0", F.posexplode(length).alias("i", "n_tokens")).select("file", (F.col("k0") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    open_ = chunks.where("final and total > end").select("file", F.col("total_k").alias("ordinal"), (F.col("total") - F.col("end")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(open_)


def count_documents(docs: DataFrame, ranks: bytes, **options) -> DataFrame:
    """doc_id, file, ordinal, n_tokens: documents packed into flat streams, which are then scanned."""
    stage = Stage(docs.sparkSession, "streams")
    packed = stage.write(pack(docs, ranks, **options), "packed")
    blocks, order = packed.where("block is not null"), packed.where("doc_id is not null or ordinal is not null").select("file", "ordinal", "doc_id")
    known = {k: v for k, v in options.items() if k in ("eod", "dtype")}
    return order.join(scan(blocks, stage=stage, **known), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
