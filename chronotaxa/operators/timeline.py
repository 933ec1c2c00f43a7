"""The recorded history of names as flat rows and as nested documents, for all names at once.

Inputs: ``names`` (name_id, scientific_name, canonical_name, authorship, rank, canonical_key), ``usages`` (code, version, usage_id, name_id,
status, rank, classification, accepted_usage_id, parent_usage_id), ``releases`` (code, version, released_on), ``checklists`` (code, title,
id_stability), ``changes`` (code, to_version, to_usage_id, type, detail, confidence), ``threads`` (usage_id, anchor_kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import iso_date
from .match import join_known


def displayed(names: DataFrame, usages: DataFrame) -> DataFrame:
    """(usage_id, display): usages by the names they show."""
    return usages.select("usage_id", "name_id").join(names.select("name_id", F.col("scientific_name").alias("display")), "name_id").select("usage_id", "display")


def appearances(names: DataFrame, usages: DataFrame, releases: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """One row for each usage of a name, with display names of what its pointers lead to, and its place.

    ``shown`` has those display names (``displayed``) where ``names`` and ``usages`` are only some of all.
    """
    shown = displayed(names, usages) if shown is None else shown
    pointer = lambda p: shown.select(F.col("usage_id").alias(f"{p}_usage_id"), F.col("display").alias(f"{p}_name"))
    n = names.select("name_id", "scientific_name", "authorship")
    out = usages.join(n, "name_id").join(F.broadcast(releases.select("code", "version", "released_on")), ["code", "version"])
    out = join_known(join_known(out, pointer("accepted"), "accepted_usage_id", "usage_id"), pointer("parent"), "parent_usage_id", "usage_id")
    place = Window.partitionBy("name_id", "code").orderBy(F.asc_nulls_first("released_on"), "version", "usage_id")
    return out.withColumn("place", F.row_number().over(place))


def landed_changes(changes: DataFrame) -> DataFrame:
    """Changes that end in a usage; those without one never show."""
    return changes.where("to_usage_id is not null").withColumn("advisory", F.col("confidence").isNotNull())


def first_last(seen: DataFrame, threads: DataFrame) -> DataFrame:
    """For each name and checklist the first and last version, and how its first appearance is anchored."""
    order = F.struct(F.coalesce(F.col("released_on"), F.to_date(F.lit("0001-01-01"))), F.col("version"), F.col("usage_id"))
    kinds = seen.join(threads.select("usage_id", "anchor_kind"), "usage_id", "left")
    each = kinds.groupBy("name_id", "code").agg(F.min_by("version", order).alias("first_seen"), F.max_by("version", order).alias("last_seen"), F.min_by(F.struct("anchor_kind"), order).alias("k"), F.count("*").alias("n_appearances"))
    count = seen.groupBy("name_id").agg(F.count_distinct("code").alias("checklist_count"))
    return each.join(count, "name_id").select("name_id", "code", "first_seen", "last_seen", F.col("k.anchor_kind").alias("anchor_kind"), "n_appearances", "checklist_count")


SIBLING = "same canonical name, different authorship"


def sibling_classes(names: DataFrame) -> DataFrame:
    """Names that share a canonical name, as one row a class: its key, first member and number of members. Members are told by their key."""
    classes = names.where("canonical_key <> ''").groupBy("canonical_key").agg(F.count("*").alias("n_names"), F.min("name_id").alias("first_id"))
    return classes.where("n_names > 1")


def siblings(names: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Other names of one canonical name, for the names in ``asked`` (name_id, canonical_key), else for all.

    Only classes of several names meet, and each is read once for every name that asks.
    """
    classes = sibling_classes(names).select("canonical_key")
    other = names.join(classes, "canonical_key", "left_semi").select(F.col("name_id").alias("sibling_id"), F.col("scientific_name").alias("sibling_name"), F.col("authorship").alias("sibling_authorship"), "canonical_key")
    out = (names if asked is None else asked).select("name_id", "canonical_key").join(other, "canonical_key").where("name_id <> sibling_id")
    return out.select("name_id", "sibling_id", "sibling_name", "sibling_authorship", F.lit(SIBLING).alias("reason"))


def documents(names: DataFrame, usages: DataFrame, releases: DataFrame, checklists: DataFrame, changes: DataFrame, threads: DataFrame, shown: DataFrame | None = None, kin: DataFrame | None = None) -> DataFrame:
    """One nested document for each name: checklists, their appearances, and the changes that landed there.

    Where ``names`` and ``usages`` are only some of all, ``shown`` and ``kin`` (as from ``displayed`` and ``siblings``) hold what they refer to.
    """
    seen = appearances(names, usages, releases, shown)
    landed = landed_changes(changes).groupBy(F.col("code"), F.col("to_version").alias("version"), F.col("to_usage_id").alias("usage_id"))
    landed = landed.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "type", "detail", "confidence", "advisory"))), lambda c: F.struct(c.type.alias("type"), c.detail.alias("detail"), c.confidence.alias("confidence"), c.advisory.alias("advisory"))).alias("changes"))
    full = seen.join(landed, ["code", "version", "usage_id"], "left")
    none = F.array().cast("array<struct<type:string,detail:string,confidence:double,advisory:boolean>>")
    step = F.struct("place", F.col("version").alias("release_version"), iso_date("released_on").alias("released_on"), "status", "rank", "scientific_name", "authorship", "accepted_name", "parent_name", "classification", "usage_id", F.coalesce("changes", none).alias("changes"))
    lists = full.groupBy("name_id", "code").agg(F.array_sort(F.collect_list(step), lambda x, y: x.place - y.place).alias("steps"))
    lists = lists.withColumn("appearances", F.transform("steps", lambda s: s.dropFields("place"))).drop("steps")
    lists = lists.join(first_last(seen, threads).select("name_id", "code", "first_seen", "last_seen", "anchor_kind"), ["name_id", "code"]).join(F.broadcast(checklists.select("code", "title", "id_stability")), "code")
    entry = F.struct(F.col("code").alias("checklist_code"), F.col("title").alias("checklist_title"), "id_stability", "anchor_kind", "first_seen", "last_seen", "appearances")
    lists = lists.groupBy("name_id").agg(F.array_sort(F.collect_list(entry), lambda x, y: F.when(x.checklist_code < y.checklist_code, -1).when(x.checklist_code > y.checklist_code, 1).otherwise(0)).alias("checklists"))
    kin = (siblings(names) if kin is None else kin).groupBy("name_id").agg(F.array_sort(F.collect_list(F.struct(F.col("sibling_id").alias("name_id"), F.col("sibling_name").alias("scientific_name"), F.col("sibling_authorship").alias("authorship"), "reason"))).alias("related"))
    return names.select("name_id", F.col("scientific_name").alias("name"), "canonical_name", "authorship", "rank").join(lists, "name_id", "left").join(kin, "name_id", "left")


def trace_json(docs: DataFrame) -> DataFrame:
    """K8: documents as JSON text; nulls are kept."""
    return docs.select("name_id", F.to_json(F.struct(*(c for c in docs.columns)), {"ignoreNullFields": "false"}).alias("document"))
