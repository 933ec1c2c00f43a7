"""Pairing the usages of two releases by anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def anchor_of(kind: str) -> Column:
    """The column that identifies a record from release to release."""
    return F.col("source_taxon_id" if kind == "source_id" else "canonical_key")


def choose_anchor(usages: DataFrame, id_stability: str) -> str:
    """Identifiers anchor only if they are persistent and either release has any."""
    if id_stability != "persistent":
        return "name"
    return "source_id" if usages.where(F.length("source_taxon_id") > 0).take(1) else "name"


def usage_names(usages: DataFrame, names: DataFrame) -> DataFrame:
    """What the comparison needs of a usage and its name."""
    n = names.select("name_id", "scientific_name", "canonical_name", "authorship", "norm_key", "canonical_key")
    u = usages.select("release", "usage_id", "source_taxon_id", "name_id", "status", "rank", "accepted_usage_id", "parent_usage_id")
    return u.join(n, "name_id")


def laid(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows by ``keys`` in ``parts`` partitions, where that number is given. Left alone, partitions are put together by their compressed size, and rows of names
    grow manifold when they are sorted."""
    return df.repartition(parts, *keys) if parts else df


def anchored(usages: DataFrame, kind: str, parts: int | None = None) -> DataFrame:
    """Rows with an anchor (P3, Q2), their place, the number of rows in their bucket and its first usage."""
    bucket = Window.partitionBy("release", "anchor")
    rows = laid(usages.withColumn("anchor", anchor_of(kind)).where(F.length("anchor") > 0), parts, "release", "anchor")
    best = bucket.orderBy(F.col("status") != "accepted", "usage_id")
    return rows.withColumns({"place": F.row_number().over(best), "bucket_rows": F.count("*").over(bucket), "bucket_ord": F.min("usage_id").over(bucket)})


def winners(usages: DataFrame, kind: str, parts: int | None = None) -> DataFrame:
    """A1: one usage for each anchor and release: the lowest accepted id, else the lowest id."""
    return anchored(usages, kind, parts).where("place = 1").drop("place")


def ambiguous(index: DataFrame) -> DataFrame:
    """Anchors that several usages of a release share; one may be listed for both releases."""
    return index.where("bucket_rows > 1").select("release", "anchor", "bucket_rows")


def join_known(left: DataFrame, right: DataFrame, key: str, spread: str, *also: str, parts: int | None = None) -> DataFrame:
    """Left join on ``key`` (and the columns ``also``) where many keys are null: those rows meet nothing and are spread by the column
    ``spread``, of which each row has its own; as nulls they would all lie in one partition."""
    known, at = F.col(key).isNotNull(), F.coalesce(key, F.col(spread).cast(left.schema[key].dataType))
    rows = left.withColumns({"_known": known, "_at": at})
    found = right.withColumns({"_known": F.lit(True), "_at": F.col(key)}).drop(key)
    rows, found = laid(rows, parts, "_at", *also), laid(found, parts, "_at", *also)
    # In parts: laid by all keys, or Spark lays them anew in its own number; merged, or a whole side is broadcast, as staged rows are taken to be as small as their file.
    return rows.join(found.hint("merge") if parts else found, ["_known", "_at", *also], "left").drop("_known", "_at")


SIDE = ("usage_id", "source_taxon_id", "canonical_name", "authorship", "status", "rank", "accepted_usage_id", "parent_usage_id", "norm_key", "canonical_key", "bucket_ord")


def with_pointers(index: DataFrame, parts: int | None = None) -> DataFrame:
    """What the accepted and parent pointers of winners lead to, among the winners of the same release."""
    target = index.select("release", F.col("usage_id").alias("t_id"), F.col("canonical_key").alias("t_key"), F.col("canonical_name").alias("t_name"), F.col("status").alias("t_status"))
    out = index
    for name in ("accepted", "parent"):
        t = target.select("release", F.col("t_id").alias(f"{name}_usage_id"), *(F.col(c).alias(f"{name}_{c}") for c in ("t_key", "t_name", "t_status")))
        out = join_known(out, t, f"{name}_usage_id", "usage_id", "release", parts=parts)
    return out


def paired(index: DataFrame, before: int = 1, after: int = 2, parts: int | None = None) -> DataFrame:
    """The full outer join of both releases' winners on the anchor, columns prefixed b_ and a_."""
    columns = [c for c in index.columns if c not in ("release", "anchor")]
    side = lambda release, p: laid(index.where(F.col("release") == release).select("anchor", *(F.col(c).alias(f"{p}_{c}") for c in columns)), parts, "anchor")
    return side(before, "b").join(side(after, "a"), "anchor", "full_outer").withColumn(
        "side", F.when(F.col("a_usage_id").isNull(), "removed").when(F.col("b_usage_id").isNull(), "added").otherwise("matched")
    )


def track_id(code: Column, kind: Column, anchor: Column) -> Column:
    return F.xxhash64(code, kind, anchor)


def tracks(index: DataFrame, code: str, kind: str, existing: DataFrame | None = None) -> DataFrame:
    """Threads for all anchors of either release that have none yet."""
    keys = index.select(F.lit(code).alias("code"), F.lit(kind).alias("anchor_kind"), F.col("anchor").alias("anchor_key")).distinct()
    if existing is not None:
        keys = keys.join(existing.select("code", "anchor_kind", "anchor_key"), ["code", "anchor_kind", "anchor_key"], "left_anti")
    return keys.select(track_id(F.col("code"), F.col("anchor_kind"), F.col("anchor_key")).alias("track_id"), "code", "anchor_kind", "anchor_key")


def memberships(index: DataFrame, code: str, kind: str) -> DataFrame:
    """K7: which thread each winner belongs to."""
    return index.select("release", "usage_id", track_id(F.lit(code), F.lit(kind), F.col("anchor")).alias("track_id"))
