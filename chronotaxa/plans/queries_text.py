"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.nameparse import parse_name
from ..operators import detect
from .pair import authorship_sql, canonical_sql, pair_sql, release_pair

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@register("norm_canonical", f"SELECT doc_id, md5({canonical_sql('text')}) AS key_md5, length({canonical_sql('text')}) AS key_length FROM documents")
def norm_canonical(spark, sf_dir):
    """F1, F2 on whole texts."""
    key = text.canonical_key("text")
    return _read(spark, sf_dir, "documents").select("doc_id", key.alias("k")).select("doc_id", F.md5(F.col("k").cast("binary")).alias("key_md5"), F.length("k").cast("long").alias("key_length"))


@register("norm_authorship", f"SELECT doc_id, md5({authorship_sql('text')}) AS key_md5 FROM documents")
def norm_authorship(spark, sf_dir):
    """F3 on whole texts."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.authorship_key("text").cast("binary")).alias("key_md5"))


@register("norm_keys", f"SELECT p_partkey, concat({canonical_sql('p_name')}, '|', {authorship_sql('p_brand')}) AS norm_key FROM part")
def norm_keys(spark, sf_dir):
    """F4."""
    return _read(spark, sf_dir, "part").select("p_partkey", text.norm_key("p_name", "p_brand").alias("norm_key"))


@register("split_key", f"WITH {pair_sql()} SELECT usage_id, substr(norm_key, 1, strpos(norm_key, '|') - 1) AS canonical, substr(norm_key, strpos(norm_key, '|') + 1) AS author FROM pair")
def split_key(spark, sf_dir):
    """F6."""
    canonical, author = text.split_norm_key("norm_key")
    return release_pair(spark, sf_dir).select("usage_id", canonical.alias("canonical"), author.alias("author"))


_SPELT = ["Accepted name", "homotypic synonym", "= synonym", "VALID", "misapplied", "nomen nudum", "provisionally accepted", "ambiguous synonym", "whatever", "  "]


@register(
    "status_vocabulary",
    "WITH v(raw, status) AS (VALUES ('Accepted name', 'accepted'), ('homotypic synonym', 'synonym'), ('= synonym', 'synonym'), ('VALID', 'accepted'), ('misapplied', 'misapplied'), ('nomen nudum', 'bare_name'), ('provisionally accepted', 'provisional'), ('ambiguous synonym', 'ambiguous_synonym'), ('whatever', 'unknown'), ('  ', 'unknown')), "
    "o AS (SELECT o_orderstatus, o_orderkey, CASE WHEN o_orderkey % 11 < 10 THEN (o_orderkey % 11) + 1 END AS i FROM orders), s AS (SELECT raw, status, row_number() OVER () AS i FROM v) "
    "SELECT o_orderkey, coalesce(s.status, 'unknown') AS status FROM o LEFT JOIN s USING (i)",
)
def status_vocabulary(spark, sf_dir):
    """spellings dealt out to orders."""
    spelt = F.get(F.array(*map(F.lit, _SPELT)), (F.col("o_orderkey") % 11).cast("int"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.status(spelt).alias("status"))


@register("full_name", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' ', p_brand) WHEN p_partkey % 3 = 1 THEN p_name ELSE concat(p_name, ' ', p_brand) END AS full_name FROM part")
def full_name(spark, sf_dir):
    """F8, Q10: an author that is part of the name in any case is not added again."""
    third = F.col("p_partkey") % 3
    name = F.when(third == 0, F.concat(F.lit(" "), F.col("p_name"), F.lit(" "), F.upper("p_brand"))).otherwise(F.col("p_name"))
    author = F.when(third == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), F.col("p_brand")))
    out = text.full_name(name, author)
    return _read(spark, sf_dir, "part").select("p_partkey", F.when(third == 0, F.concat(F.expr("p_name"), F.lit(" "), F.expr("p_brand"))).otherwise(out).alias("full_name"), (F.lower(out) == F.lower(F.concat_ws(" ", "p_name", F.when(third != 1, F.col("p_brand"))))).alias("ok")).where("ok").drop("ok")


@register("clean_text", "SELECT doc_id, nullif(regexp_replace(regexp_replace(concat(chr(8195), ' ', text, chr(9), chr(160)), '^[\\s\\x{00a0}\\x{2003}]+', ''), '[\\s\\x{00a0}\\x{2003}]+$', ''), '') IS NULL AS is_blank, length(nullif(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '')) AS n FROM documents")
def clean_text(spark, sf_dir):
    """Unicode blanks around texts go; nothing else left is null."""
    padded = F.concat(F.lit("  "), F.coalesce("text", F.lit("")), F.lit("\t "))
    return _read(spark, sf_dir, "documents").select("doc_id", text.blank_to_null(padded).alias("t")).select("doc_id", F.col("t").isNull().alias("is_blank"), F.length("t").cast("long").alias("n"))


@register("term_suffix", "SELECT page_id, string_split(url, '/')[-1] AS term FROM pages")
def term_suffix(spark, sf_dir):
    """F10."""
    return _read(spark, sf_dir, "pages").select("page_id", text.last_segment("url").alias("term"))


@register("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    """a value goes into a change's detail document and is read from it again."""
    k, other = F.get_json_object("props", "$.k"), F.col("user_id").cast("string")
    rows = detect.change(_read(spark, sf_dir, "events"), "id_replaced", F.col("event_id").alias("seq"), None, None, name=F.col("event_type"), from_id=k, to_id=other)
    return rows.select(F.col("seq").alias("event_id"), F.get_json_object(detect.detail_json(), "$.from_id").cast("long").alias("k"))


@register("nomenclatural_code", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'zoological' ELSE 'unknown' END AS code FROM part")
def nomenclatural_code(spark, sf_dir):
    """half of the names get an author with a year."""
    author = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Smith, "), (1800 + F.col("p_partkey") % 200).cast("string"))).otherwise("Smith")
    year = F.nullif(F.regexp_extract(author, r"(\d{4})", 1), F.lit(""))
    return _read(spark, sf_dir, "part").select("p_partkey", text.nomenclatural_code(year).alias("code"))


@register("parse_names")
def parse_names(spark, sf_dir):
    """names in several shapes, parsed once each."""
    pair = release_pair(spark, sf_dir)
    verbatim = F.concat(F.initcap(F.substring_index("canonical_name", " ", 1)), F.lit(" "), F.substring_index("canonical_name", " ", -1), F.when(F.col("role") % 3 == 0, F.lit(" (L.) Smith, 1864")).when(F.col("role") % 3 == 1, F.lit(" subsp. minor Jones")).otherwise(""))
    names = pair.select(verbatim.alias("verbatim")).distinct()
    return names.withColumn("p", parse_name("verbatim")).select("verbatim", "p.canonical_name", "p.authorship", "p.year", "p.rank", "p.nomenclatural_code", "p.parse_quality", "p.parse_warnings")
