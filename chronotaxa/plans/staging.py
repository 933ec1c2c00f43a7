"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; where that is unset, a folder in the warehouse, or a temporary one if there is only this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not context._jsc.sc().getCheckpointDir().isDefined():
        alone = re.fullmatch(r"local(\[[^\]]*\])?", context.master) is not None
        context.setCheckpointDir(named or (tempfile.mkdtemp(prefix="chronotaxa-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"))


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder of ``spark.checkpoint.dir`` or its stand-in."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow, of which Spark broadcasts neither. It takes staged rows, and what is derived from them, to be as small as the file they
    came from, so it would send tables of any size through the driver."""
    return left.join(right.hint("merge"), on, how)


def dense(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``row_no``: each row's place, from 0 and without gaps, in the order of some columns that tell rows apart.

    Ranges are sorted where they lie; the driver sees one count for each range.
    """
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_at", F.monotonically_increasing_id()))
    first, offsets = 0, []
    for r in laid.groupBy(F.shiftright("row_at", 33).alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], first))
        first += r["count"]
    starts = df.sparkSession.createDataFrame(offsets, "row_part long, row_first long")
    within = F.col("row_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("row_part", F.shiftright("row_at", 33)).join(F.broadcast(starts), "row_part").withColumn("row_no", F.col("row_first") + within).drop("row_part", "row_first", "row_at")
