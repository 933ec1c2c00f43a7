"""Schemas, controlled vocabularies and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_STABILITY = ("persistent", "unstable", "none")
SOURCE_FORMATS = ("dwca", "csv", "xlsx")
RELEASE_STATUS = ("importing", "ready", "failed")
TAXONOMIC_STATUS = ("accepted", "synonym", "ambiguous_synonym", "misapplied", "provisional", "bare_name", "unknown")
CODES = ("botanical", "zoological", "bacterial", "viral", "unknown")
ANCHOR_KINDS = ("source_id", "name")
CHANGE_TYPES = ("added", "removed", "renamed", "author_changed", "status_changed", "accepted_changed", "reclassified", "rank_changed", "lumped", "split", "id_replaced", "probable_rename")
LINK_RELATIONS = ("fuzzy_match", "congruent", "includes", "included_in", "overlaps", "disjoint")
SYNONYMOUS = ("synonym", "ambiguous_synonym", "misapplied")
ADVISORY = ("probable_rename",)
#: The order in which reports show change types.
DISPLAY_ORDER = ("lumped", "split", "accepted_changed", "status_changed", "reclassified", "rank_changed", "renamed", "author_changed", "added", "removed", "id_replaced", "probable_rename")
CLASSIFICATION_RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "subgenus")

#: Types by name; built without a session, so that the module can be imported before there is one.
_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "ints": T.ArrayType(T.IntegerType()),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "texts": T.MapType(T.StringType(), T.StringType()),
    "vernacular": T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("language", T.StringType())])),
}


def _schema(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in spec.split(","))])


#: What every source reader returns; ``file_ord`` is the row's place in the file.
SOURCE_ROW = _schema(
    "file_ord long, source_taxon_id string, scientific_name string, authorship string, rank string, status_raw string, accepted_taxon_id string, accepted_scientific_name string,"
    " parent_taxon_id string, parent_scientific_name string, classification texts, vernacular vernacular, raw texts, error string"
)
CHECKLIST = _schema("code string, title string, publisher string, homepage string, license string, id_stability string, notes string, created_at timestamp")
RELEASE = _schema("code string, version string, seq long, released_on date, ingested_at timestamp, source_uri string, source_sha256 string, format string, usage_count long, status string, notes string")
NAME = _schema(
    "name_id long, scientific_name string, canonical_name string, authorship string, rank string, rank_marker string, genus string, specific_epithet string, infraspecific_epithet string,"
    " nomenclatural_code string, norm_key string, canonical_key string, parsed string, parse_quality int, parse_warnings string"
)
USAGE = _schema(
    "usage_id long, source_taxon_id string, name_id long, status string, accepted_usage_id long, parent_usage_id long, rank string, classification texts,"
    " vernacular vernacular, source_data texts"
)
TRACK = _schema("track_id long, code string, anchor_kind string, anchor_key string")
USAGE_TRACK = _schema("usage_id long, track_id long")
CHANGE = _schema("seq long, type string, track_id long, anchor_key string, from_usage_id long, to_usage_id long, detail string, confidence double")
LINK = _schema("link_id long, from_name_id long, to_name_id long, relation string, method string, confidence double, evidence string, reviewed boolean, reviewed_by string, notes string, created_at timestamp")

#: The names' full-text index; its partition column is ``bucket``.
POSTING = _schema("word string, name_id long, len int, positions ints, sign int")
FACT = _schema("n long, tokens long")


class IntegrityError(ValueError):
    """A table breaks one of its rules."""


def check_vocabulary(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Raises while the plan runs if a value is outside the vocabulary."""
    message = F.concat(F.lit(f"{column} has a value outside its vocabulary: "), F.coalesce(F.col(column), F.lit("null")))
    return df.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.raise_error(message).cast("string")))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys held by several rows, with their counts; keys with a null part are exempt."""
    filled = df.where(" and ".join(f"`{k}` is not null" for k in key))
    return filled.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, *key: str) -> None:
    if clash := duplicates(df, *key).take(1):
        raise IntegrityError(f"several rows have {dict(zip(key, clash[0][:-1]))}")


def dangling(df: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """C4: rows whose pointer leads nowhere."""
    return df.where(F.col(column).isNotNull()).join(target.select(F.col(target_column).alias(column)).distinct(), column, "left_anti")


def require_targets(df: DataFrame, column: str, target: DataFrame, target_column: str | None = None) -> None:
    """C4: raises if a pointer leads nowhere."""
    if lost := dangling(df, column, target, target_column or column).select(column).take(1):
        raise IntegrityError(f"{column} {lost[0][0]} leads nowhere")


def require_distinct_ids(new: DataFrame, known: DataFrame) -> None:
    """Raises if two identities among new and known names have one ``name_id``: it is a hash of the identity, and two would merge silently."""
    ids = new.select("name_id", "norm_key")
    both = ids.unionByName(known.select("name_id", "norm_key").join(ids.select("name_id"), "name_id", "left_semi"))
    clash = both.groupBy("name_id").agg(F.min("norm_key").alias("a"), F.max("norm_key").alias("b")).where("a <> b").take(1)
    if clash:
        raise IntegrityError(f"{clash[0]['a']!r} and {clash[0]['b']!r} have the same name_id")
