"""Name exports that pack several usages into one row as parallel comma lists.

Columns used: name_id, simple_name, name_author, rank, usage_status, taxon_id, the six classification columns, common_name_c,
alternative_name_c, and what RAW_COLUMNS keeps. ``file_ord`` is the row's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import blank_to_null, lookup, split_list
from ..plans.staging import dense

#: How a list's statuses are spelt in the common vocabulary.
STATUS_VALUES = {"accepted": "accepted", "not-accepted": "synonym", "misapplied": "misapplied"}
#: Columns that hold the classification, from the top.
CLASS_COLUMNS = ("kingdom", "phylum", "class", "order", "family", "genus")
#: For each rank the place of the deepest classification column that lies strictly above it; ranks below species have the last.
ABOVE = {
    "superkingdom": -1,
    "realm": -1,
    "kingdom": -1,
    "subkingdom": 0,
    "infrakingdom": 0,
    "superphylum": 0,
    "phylum": 0,
    "subphylum": 1,
    "infraphylum": 1,
    "superclass": 1,
    "megaclass": 1,
    "class": 1,
    "subclass": 2,
    "infraclass": 2,
    "superorder": 2,
    "order": 2,
    "suborder": 3,
    "infraorder": 3,
    "superfamily": 3,
    "epifamily": 3,
    "family": 3,
    "subfamily": 4,
    "tribe": 4,
    "subtribe": 4,
    "genus": 4,
    "subgenus": 5,
    "section": 5,
    "subsection": 5,
    "series": 5,
}
#: Columns kept as source data.
RAW_COLUMNS = (
    "name_id", "taxon_id", "usage_status", "nomenclature_name", "namecode",
    "original_name_id", "protologue", "is_hybrid", "is_in_taiwan", "is_endemic",
    "alien_type", "cites", "iucn", "redlist", "protected", "sensitive",
)
LANGUAGE = "zh-TW"


def cleaned(df: DataFrame) -> DataFrame:
    """Named columns only, trimmed, blanks as null; columns the export lacks are null."""
    wanted = dict.fromkeys(("name_id", "simple_name", "name_author", "rank", "usage_status", "taxon_id", *CLASS_COLUMNS, "common_name_c", "alternative_name_c", *RAW_COLUMNS))
    cols = [blank_to_null(F.col(f"`{c}`").cast("string")).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted]
    return df.select("file_ord", *cols).withColumns({"statuses": split_list("usage_status"), "taxa": split_list("taxon_id")})


def _named(rows: DataFrame) -> DataFrame:
    return rows.where("name_id is not null and simple_name is not null")


def _even(rows: DataFrame) -> DataFrame:
    return _named(rows).where("size(statuses) > 0 and size(statuses) = size(taxa)")


def _placements(rows: DataFrame) -> DataFrame:
    """One row for each pair that both lists have; a longer list's rest is ignored, as is any row without a name id or a name."""
    n = F.least(F.size("statuses"), F.size("taxa"))
    pairs = F.slice(F.arrays_zip(F.col("statuses").alias("status"), F.col("taxa").alias("taxon")), F.lit(1), n)
    return _named(rows).select("*", F.posexplode(pairs).alias("i", "p")).withColumns({"status": F.col("p.status"), "taxon": F.col("p.taxon"), "ord": F.struct("file_ord", "i")})


def accepted_names(rows: DataFrame) -> DataFrame:
    """The first accepted name of each taxon."""
    return _placements(rows).where("status = 'accepted'").groupBy("taxon").agg(F.min_by("name_id", "ord").alias("accepted_name_id"))


def addressable_parents(rows: DataFrame) -> DataFrame:
    """The first name of each (rank, name, kingdom) of a classification column's rank, of names that some row with even lists accepts."""
    accepted = _even(rows).where("array_contains(statuses, 'accepted')").select("name_id").distinct()
    p = _named(rows).where(F.lower("rank").isin(*CLASS_COLUMNS)).join(accepted, "name_id", "left_semi")
    return p.groupBy(F.lower("rank").alias("parent_rank"), F.col("simple_name").alias("parent_name"), F.coalesce("kingdom", F.lit("")).alias("parent_kingdom")).agg(F.min_by("name_id", "file_ord").alias("parent_name_id"))


def primary_taxa(rows: DataFrame) -> DataFrame:
    """The taxon that a name is anchored to: the first it is accepted in, else its first; from the name's first row with even lists."""
    own = F.expr("try_element_at(transform(filter(arrays_zip(statuses, taxa), p -> p.statuses = 'accepted'), p -> p.taxa), 1)")
    return _even(rows).groupBy("name_id").agg(F.min_by(F.coalesce(own, F.element_at("taxa", 1)), "file_ord").alias("primary_taxon"))


def usage_rows(rows: DataFrame) -> DataFrame:
    """Usages as they are emitted: one for each pair of even lists, one for an unplaced name, one error row for uneven lists."""
    n, m = F.size("statuses"), F.size("taxa")
    none = F.array(F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("taxon")))
    pairs = F.when((n > 0) & (n == m), F.arrays_zip(F.col("statuses").alias("status"), F.col("taxa").alias("taxon"))).otherwise(none)
    out = rows.where("simple_name is not null").select("*", F.posexplode(pairs).alias("i", "p")).withColumns({"status": F.col("p.status"), "taxon": F.col("p.taxon")})
    uneven = F.concat(F.lit("name_id "), F.coalesce("name_id", F.lit("None")), F.lit(": usage_status has "), n.cast("string"), F.lit(" entries but taxon_id has "), m.cast("string"))
    return out.withColumn("error", F.when((n > 0) & (n != m), uneven))


def anchors(usages: DataFrame, primary: DataFrame) -> DataFrame:
    """A unique key for each usage. A name's usage in its primary taxon keeps the name id, whatever its place in the list;
    others are qualified by the taxon, and by a counter if that repeats."""
    out = usages.join(primary, "name_id", "left").withColumn("ord", F.struct("file_ord", "i"))
    counted = F.col("error").isNull() & F.col("name_id").isNotNull()
    home = counted & F.coalesce("primary_taxon", "taxon").eqNullSafe(F.col("taxon"))
    # What is not counted is a partition of its own, so that no partition is larger than a name's or a claim's usages.
    alone = F.concat(F.lit("\0"), F.col("file_ord").cast("string"), F.lit("#"), F.col("i").cast("string"))
    out = out.withColumn("bare", home & (F.row_number().over(Window.partitionBy(F.when(home, F.col("name_id")).otherwise(alone)).orderBy("ord")) == 1))
    claim = F.concat(F.col("name_id"), F.lit("#"), F.coalesce("taxon", F.lit("x")))
    out = out.withColumn("claim", F.when(counted & ~F.col("bare"), claim))
    turn = F.row_number().over(Window.partitionBy(F.coalesce("claim", alone)).orderBy("ord"))
    suffixed = F.when(turn > 1, F.concat(F.col("claim"), F.lit("#"), turn.cast("string"))).otherwise(F.col("claim"))
    return out.withColumn("anchor", F.when(F.col("error").isNotNull() | F.col("bare"), F.col("name_id")).when(F.col("name_id").isNotNull(), suffixed)).drop("bare", "claim", "ord")


def parent_ids(usages: DataFrame, parents: DataFrame) -> DataFrame:
    """(file_ord, parent_name_id) from the deepest classification entry strictly above the rank that is an accepted name."""
    start = F.coalesce(lookup(F.lower("rank"), {r: str(k) for r, k in ABOVE.items()}).cast("int"), F.lit(len(CLASS_COLUMNS) - 1))
    entries = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(c).alias("rank"), F.col(f"`{c}`").alias("name")) for k, c in enumerate(CLASS_COLUMNS)))
    rows = usages.select("file_ord", "simple_name", F.coalesce("kingdom", F.lit("")).alias("k"), start.alias("start"), entries.alias("entries")).dropDuplicates(["file_ord"])
    probes = rows.select("file_ord", "k", "simple_name", "start", F.explode("entries").alias("e")).where("e.level <= start and e.name is not null and e.name <> simple_name")
    hit = probes.join(parents, (F.col("e.rank") == F.col("parent_rank")) & (F.col("e.name") == F.col("parent_name")) & (F.col("k") == F.col("parent_kingdom")))
    return hit.groupBy("file_ord").agg(F.max_by("parent_name_id", "e.level").alias("parent_name_id"))


def _kept(columns: tuple[str, ...]) -> Column:
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(f"`{c}`") for c in columns))), lambda k, v: v.isNotNull())


def source_rows(df: DataFrame) -> DataFrame:
    """The export as source rows: pointers are name ids; only accepted and unplaced names get a parent."""
    rows = cleaned(df)
    usages = anchors(usage_rows(rows), primary_taxa(rows))
    out = usages.join(accepted_names(rows), "taxon", "left").join(parent_ids(rows, addressable_parents(rows)), "file_ord", "left")
    ok, accepted = F.col("error").isNull(), F.col("status") == "accepted"
    names = F.concat(split_list("common_name_c"), split_list("alternative_name_c"))
    null = F.lit(None).cast("string")
    return dense(out, "file_ord", "i").select(
        F.col("row_no").alias("file_ord"),
        F.col("anchor").alias("source_taxon_id"),
        F.col("simple_name").alias("scientific_name"),
        F.when(ok, F.col("name_author")).alias("authorship"),
        F.when(ok, F.col("rank")).alias("rank"),
        F.when(ok, F.coalesce(lookup(F.col("status"), STATUS_VALUES), F.col("status"))).alias("status_raw"),
        F.when(ok & ~F.coalesce(accepted, F.lit(False)), F.col("accepted_name_id")).alias("accepted_taxon_id"),
        null.alias("accepted_scientific_name"),
        F.when(ok & (accepted | F.col("status").isNull()), F.col("parent_name_id")).alias("parent_taxon_id"),
        null.alias("parent_scientific_name"),
        F.when(ok, _kept(CLASS_COLUMNS)).otherwise(F.create_map().cast("map<string,string>")).alias("classification"),
        F.when(ok, F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(LANGUAGE).alias("language")))).otherwise(F.array().cast("array<struct<name:string,language:string>>")).alias("vernacular"),
        F.when(ok, _kept(RAW_COLUMNS)).otherwise(F.create_map().cast("map<string,string>")).alias("raw"),
        "error",
    )
