"""From source rows to names and usages with resolved pointers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.nameparse import parse_name
from ..plans.staging import cut, dense


def triage(rows: DataFrame) -> DataFrame:
    """Why a row cannot be used, as ``problem``; null if it can. Rows, with ``row_no`` from 0, are counted from 1 as they are read."""
    at = F.concat(F.lit("row "), (F.col("row_no") + 1).cast("string"), F.lit(": "))
    return rows.withColumn("problem", F.when(F.col("error").isNotNull(), F.concat(at, F.col("error"))).when(text.blank_to_null("scientific_name").isNull(), F.concat(at, F.lit("no scientific name"))))


def parsed_names(verbatims: DataFrame) -> DataFrame:
    """Each distinct verbatim parsed once, with both keys."""
    one = verbatims.select("verbatim").distinct().withColumn("p", parse_name("verbatim")).select("verbatim", "p.*")
    return one.withColumns({"norm_key": text.norm_key("canonical_name", "authorship"), "canonical_key": text.canonical_key("canonical_name")}).where("canonical_name is not null and canonical_key <> ''")


def name_rows(parsed: DataFrame, first_seen: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each new identity, spelt as the first of its verbatims in the file."""
    cols = [c for c in parsed.columns if c not in ("norm_key", "verbatim")]
    both = parsed.join(first_seen, "verbatim")
    new = both.groupBy("norm_key").agg(F.min_by(F.struct("verbatim", *cols), "file_ord").alias("r")).select("norm_key", F.col("r.verbatim").alias("scientific_name"), *(F.col(f"r.{c}").alias(c) for c in cols))
    if existing is not None:
        new = new.join(existing.select("norm_key"), "norm_key", "left_anti")
    return new.withColumn("name_id", F.xxhash64("norm_key"))


def resolve_links(usages: DataFrame) -> DataFrame:
    """Accepted and parent pointers by the publisher's id, else by canonical key; never to the row itself.

    ``usages`` has usage_id, file_ord, source_taxon_id, canonical_key, status, scientific_name and, for p in accepted and parent,
    p_taxon_id, p_scientific_name, p_key (canonical key of that name). Adds p_usage_id, p_found.
    """
    by_id = usages.where(F.length("source_taxon_id") > 0).groupBy(F.col("source_taxon_id").alias("t")).agg(F.max_by("usage_id", "file_ord").alias("by_id"))
    accepted = F.when(F.col("status") == "accepted", F.struct("file_ord", "usage_id"))
    by_key = usages.groupBy(F.col("canonical_key").alias("k")).agg(F.coalesce(F.max(accepted).getField("usage_id"), F.min_by("usage_id", "file_ord")).alias("by_key"))
    out = usages
    for p in ("accepted", "parent"):
        out = out.join(by_id.withColumnRenamed("by_id", f"{p}_by_id"), F.col(f"{p}_taxon_id") == F.col("t"), "left").drop("t")
        out = out.join(by_key.withColumnRenamed("by_key", f"{p}_by_key"), F.col(f"{p}_key") == F.col("k"), "left").drop("k")
        hit = F.coalesce(f"{p}_by_id", f"{p}_by_key")
        out = out.withColumns({f"{p}_found": hit.isNotNull(), f"{p}_usage_id": F.when(hit != F.col("usage_id"), hit)}).drop(f"{p}_by_id", f"{p}_by_key")
    return out


def _given(p: str) -> Column:
    return (F.length(F.coalesce(f"{p}_taxon_id", F.lit(""))) > 0) | (F.length(F.coalesce(f"{p}_scientific_name", F.lit(""))) > 0)


def unresolved(linked: DataFrame) -> DataFrame:
    """(pointer, file_ord, problem) of links that lead nowhere."""
    side = lambda p: linked.where(_given(p) & ~F.col(f"{p}_found")).select(F.lit(p).alias("pointer"), "file_ord", text.problem(F.col("source_taxon_id"), F.col("scientific_name"), F.col(f"{p}_taxon_id"), F.col(f"{p}_scientific_name")).alias("problem"))
    return side("accepted").unionByName(side("parent"))


@dataclass(frozen=True)
class Loaded:
    names: DataFrame
    usages: DataFrame
    problems: DataFrame
    report: DataFrame


def load(rows: DataFrame, seq: int, existing: DataFrame | None = None) -> Loaded:
    """Names to add, usages with pointers, problem lists and a one-row report. Usage ids follow the file's order.

    Parsed names, new names and linked usages are checkpointed, because several results read each of them.
    """
    checked = triage(dense(rows, "file_ord")).withColumns({"verbatim": text.full_name("scientific_name", "authorship"), "status": text.status("status_raw")})
    usable = checked.where("problem is null")
    link_names = [usable.select(text.strip(f"{p}_scientific_name").alias("verbatim")) for p in ("accepted", "parent")]
    verbatims = usable.select("verbatim").union(link_names[0]).union(link_names[1]).where("verbatim is not null and verbatim <> ''")
    parsed = cut(parsed_names(verbatims))
    first_seen = usable.groupBy("verbatim").agg(F.min("file_ord").alias("file_ord"))
    names = cut(name_rows(parsed, first_seen, existing))
    keys = parsed.select("verbatim", "norm_key", "canonical_key", F.col("rank").alias("parsed_rank"))
    u = usable.join(keys, "verbatim", "left")
    skipped = u.where("norm_key is null").select(F.lit("skipped").alias("pointer"), "file_ord", F.col("verbatim").alias("problem"))
    u = u.where("norm_key is not null")
    for p in ("accepted", "parent"):
        u = u.withColumn("v", text.strip(f"{p}_scientific_name")).join(keys.select(F.col("verbatim").alias("v"), F.col("canonical_key").alias(f"{p}_key")), "v", "left").drop("v")
    empty = lambda c: F.when(F.size(c) > 0, F.col(c))
    u = u.withColumns({"usage_id": F.lit(seq).cast("long") * (1 << 40) + F.col("row_no"), "name_id": F.xxhash64("norm_key"), "rank": F.coalesce(F.nullif(F.col("rank"), F.lit("")), F.col("parsed_rank"))})
    linked = cut(resolve_links(u))
    usages = linked.select("usage_id", "source_taxon_id", "name_id", "status", "accepted_usage_id", "parent_usage_id", "rank", empty("classification").alias("classification"), empty("vernacular").alias("vernacular"), empty("raw").alias("source_data"))
    bad = checked.where("problem is not null").select(F.lit("row").alias("pointer"), "file_ord", "problem")
    problems = bad.unionByName(skipped).unionByName(unresolved(linked))
    n = lambda c: F.count_if(c)
    counts = linked.agg(F.count("*").alias("usages"), F.count_distinct("norm_key").alias("identities"), n(F.col("accepted_usage_id").isNotNull()).alias("accepted_resolved"), n(F.col("parent_usage_id").isNotNull()).alias("parent_resolved"), n(_given("accepted") & ~F.col("accepted_found")).alias("accepted_unresolved"), n(_given("parent") & ~F.col("parent_found")).alias("parent_unresolved"))
    report = checked.agg(F.count("*").alias("rows_read"), n(F.col("problem").isNotNull()).alias("rows_refused")).crossJoin(counts).crossJoin(skipped.agg(F.count("*").alias("skipped"))).crossJoin(names.agg(F.count("*").alias("names_created")))
    return Loaded(names, usages, problems, report.withColumn("names_reused", F.col("identities") - F.col("names_created")).drop("identities"))
