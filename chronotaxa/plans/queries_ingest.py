"""Queries of the ingest operators: links, names, packed lists, projections, and round trips through files."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterable
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ingest, packed
from ..sources.archive import read_archive, read_packed, term_rows
from ..sources.container import StoredSink
from ..sources.delimited import read_delimited
from ..sources.fieldmap import FieldMap
from ..sources.xlsx import read_sheet
from . import model
from .pair import pair_sql, release_pair
from .staging import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- links: release 1 with pointers given as ids (most), as names (role 7) or to nowhere (role 6); some point to themselves (role 22)

_TARGET = "case when role = 6 then 'missing' when role = 22 then source_taxon_id when role = 7 then null when accepted_usage_id is not null then concat('P', cast(accepted_usage_id - 1099511627776 as string)) end"


def _linkable(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = release_pair(spark, sf_dir).where("release = 1")
    hub = one.where("role = 0").select((F.col("usage_id") + 7).alias("usage_id"), F.col("canonical_name").alias("hub_name"), F.col("canonical_key").alias("hub_key"))
    one = one.join(hub, "usage_id", "left").withColumn("seven", F.col("role") == 7)
    return one.select(
        "usage_id", F.col("usage_id").alias("file_ord"), "source_taxon_id", "canonical_key", "status", F.col("canonical_name").alias("scientific_name"),
        F.expr(_TARGET).alias("accepted_taxon_id"), F.when(F.col("seven"), F.col("hub_name")).alias("accepted_scientific_name"), F.when(F.col("seven"), F.col("hub_key")).alias("accepted_key"),
        F.lit(None).cast("string").alias("parent_taxon_id"), F.lit(None).cast("string").alias("parent_scientific_name"), F.lit(None).cast("string").alias("parent_key"),
    )


_LINKS = f"""WITH {pair_sql()}, one AS (SELECT * FROM pair WHERE release = 1),
targets AS (SELECT *, {_TARGET} AS t_id FROM one),
given AS (SELECT o.*, CASE WHEN o.role = 7 THEN h.canonical_key END AS t_key, CASE WHEN o.role = 7 THEN h.canonical_name END AS t_name FROM targets o LEFT JOIN one h ON h.role = 0 AND o.role = 7 AND h.usage_id = o.usage_id - 7),
by_id AS (SELECT source_taxon_id AS t_id, max(usage_id) AS hit FROM one WHERE source_taxon_id IS NOT NULL GROUP BY 1),
by_key AS (SELECT canonical_key AS t_key, coalesce(max(usage_id) FILTER (status = 'accepted'), min(usage_id)) AS hit FROM one GROUP BY 1),
hits AS (SELECT g.*, coalesce(i.hit, k.hit) AS hit FROM given g LEFT JOIN by_id i USING (t_id) LEFT JOIN by_key k USING (t_key))"""


@register("link_resolution", f"{_LINKS} SELECT usage_id, nullif(hit, usage_id) AS accepted_usage_id, hit IS NOT NULL AS accepted_found FROM hits")
def link_resolution(spark, sf_dir):
    return ingest.resolve_links(_linkable(spark, sf_dir)).select("usage_id", "accepted_usage_id", "accepted_found")


@register("unresolved_links", f"{_LINKS} SELECT 'accepted' AS pointer, usage_id AS file_ord, concat(coalesce(source_taxon_id, canonical_name), ' -> ', coalesce(t_id, t_name)) AS problem FROM hits WHERE (t_id IS NOT NULL OR t_name IS NOT NULL) AND hit IS NULL")
def unresolved_links(spark, sf_dir):
    return ingest.unresolved(ingest.resolve_links(_linkable(spark, sf_dir)))


# -- names

_NAME_COLUMNS = "norm_key, arg_min(canonical_name, usage_id) AS scientific_name, arg_min(authorship, usage_id) AS authorship"


def _parsed(pair: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pair's names as if parsed: a verbatim with its keys, and where it was first seen."""
    v = pair.withColumn("verbatim", F.concat_ws(" / ", "canonical_name", "authorship"))
    return v.select("verbatim", "canonical_name", "authorship", "norm_key", "canonical_key").distinct(), v.groupBy("verbatim").agg(F.min("usage_id").alias("file_ord"))


@register("name_dedupe", f"WITH {pair_sql()} SELECT {_NAME_COLUMNS} FROM pair GROUP BY norm_key")
def name_dedupe(spark, sf_dir):
    return ingest.name_rows(*_parsed(release_pair(spark, sf_dir))).select("norm_key", F.col("canonical_name").alias("scientific_name"), "authorship")


@register("name_upsert_new", f"WITH {pair_sql()} SELECT {_NAME_COLUMNS} FROM pair WHERE release = 2 AND norm_key NOT IN (SELECT norm_key FROM pair WHERE release = 1) GROUP BY norm_key")
def name_upsert_new(spark, sf_dir):
    pair = release_pair(spark, sf_dir)
    existing = pair.where("release = 1").select("norm_key").distinct()
    return ingest.name_rows(*_parsed(pair.where("release = 2")), existing).select("norm_key", F.col("canonical_name").alias("scientific_name"), "authorship")


@register("ingest_report", "SELECT count(*) AS rows_read, count(*) FILTER (p_partkey % 40 IN (3, 4)) AS rows_refused, count(*) FILTER (p_partkey % 40 NOT IN (3, 4)) AS usages, count(*) FILTER (p_partkey % 40 = 5) AS accepted_unresolved FROM part")
def ingest_report(spark, sf_dir):
    """Rows without a name, and with a reader's error, are refused; some links lead nowhere."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    role = F.col("p_partkey") % 40
    null = F.lit(None).cast("string")
    rows = part.select(
        F.col("p_partkey").alias("file_ord"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("source_taxon_id"), F.when(role != 3, F.concat(F.lit("Testia "), F.translate(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 12), "0123456789abcdef", "abcdefghijklmnop"))).alias("scientific_name"),
        F.lit("Smith").alias("authorship"), F.lit("species").alias("rank"), F.lit("accepted").alias("status_raw"), F.when(role == 5, F.lit("nowhere")).alias("accepted_taxon_id"), null.alias("accepted_scientific_name"), null.alias("parent_taxon_id"), null.alias("parent_scientific_name"),
        F.create_map().cast("map<string,string>").alias("classification"), F.array().cast("array<struct<name:string,language:string>>").alias("vernacular"), F.create_map().cast("map<string,string>").alias("raw"), F.when(role == 4, F.lit("broken row")).alias("error"),
    )
    return ingest.load(rows, 1).report.select("rows_read", "rows_refused", "usages", "accepted_unresolved")


@register("usage_uniqueness_check", "SELECT l_orderkey, l_linenumber % 3 AS part, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def usage_uniqueness_check(spark, sf_dir):
    """Keys that several rows share."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_linenumber") % 3).alias("part"))
    return model.duplicates(lines, "l_orderkey", "part")


# -- packed lists: one row for each order, its lines being the placements

_STATUS = "case when l_linenumber % 3 = 0 then 'misapplied' when l_quantity < 12 then 'accepted' else 'not-accepted' end"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.expr(_STATUS).alias("s"), F.concat(F.lit("t"), (F.col("l_partkey") % 7).cast("string")).alias("t"))
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "s", "t"))).alias("x"))
    joined = lambda f: F.array_join(F.transform("x", lambda p: p[f]), ", ")
    uneven = F.col("l_orderkey") % 10 == 9
    rows = rows.select("l_orderkey", F.when(F.col("l_orderkey") % 10 != 8, joined("s")).alias("usage_status"), F.when(uneven, F.concat(joined("t"), F.lit(",t9"))).when(F.col("l_orderkey") % 10 == 8, F.lit(None)).otherwise(joined("t")).alias("taxon_id"))
    name = F.col("l_orderkey") - F.col("l_orderkey") % 4
    return packed.cleaned(rows.select(F.col("l_orderkey").alias("file_ord"), F.concat(F.lit("n"), name.cast("string")).alias("name_id"), F.when(F.col("l_orderkey") % 13 != 5, F.concat(F.lit("Name "), name.cast("string"))).alias("simple_name"), F.lit("Species").alias("rank"), "usage_status", "taxon_id"))


_PACKED = f"""WITH lines AS (SELECT l_orderkey, l_linenumber, {_STATUS} AS s, concat('t', cast(l_partkey % 7 AS VARCHAR)) AS t FROM lineitem WHERE l_orderkey % 13 <> 5),
orders_ AS (SELECT l_orderkey, concat('n', CAST(l_orderkey - l_orderkey % 4 AS VARCHAR)) AS name_id, list(s ORDER BY l_linenumber, s, t) AS ss, list(t ORDER BY l_linenumber, s, t) AS ts FROM lines GROUP BY 1),
even AS (SELECT *, unnest(range(len(ss))) AS i, unnest(ss) AS status, unnest(ts) AS taxon FROM orders_ WHERE l_orderkey % 10 < 8),
plain AS (SELECT l_orderkey AS file_ord, name_id, i, status, taxon FROM even UNION ALL SELECT l_orderkey, name_id, 0, NULL, NULL FROM orders_ WHERE l_orderkey % 10 = 8)"""


@register("parallel_lists", f"{_PACKED} SELECT file_ord, name_id, i, status, taxon, NULL::VARCHAR AS error FROM plain UNION ALL SELECT l_orderkey, name_id, 0, NULL, NULL, concat('name_id ', name_id, ': usage_status has ', len(ss), ' entries but taxon_id has ', len(ts) + 1) FROM orders_ WHERE l_orderkey % 10 = 9")
def parallel_lists(spark, sf_dir):
    return packed.usage_rows(_packed(spark, sf_dir)).select("file_ord", "name_id", F.col("i").cast("long").alias("i"), "status", "taxon", "error")


@register(
    "packed_anchor_ids",
    f"""{_PACKED}, prim AS (SELECT name_id, arg_min(coalesce(list_filter(list_zip(ss, ts), lambda p: p[1] = 'accepted')[1][2], ts[1]), l_orderkey) AS p FROM orders_ WHERE l_orderkey % 10 < 8 GROUP BY name_id),
home AS (SELECT plain.*, coalesce(p, taxon) IS NOT DISTINCT FROM taxon AS at_home FROM plain LEFT JOIN prim USING (name_id)),
bare AS (SELECT *, at_home AND row_number() OVER (PARTITION BY name_id, at_home ORDER BY file_ord, i) = 1 AS is_bare FROM home),
turn AS (SELECT *, row_number() OVER (PARTITION BY name_id, taxon, is_bare ORDER BY file_ord, i) AS k FROM bare)
SELECT file_ord, i, CASE WHEN is_bare THEN name_id WHEN k = 1 THEN concat(name_id, '#', coalesce(taxon, 'x')) ELSE concat(name_id, '#', coalesce(taxon, 'x'), '#', k) END AS anchor FROM turn""",
)
def packed_anchor_ids(spark, sf_dir):
    rows = _packed(spark, sf_dir)
    return packed.anchors(packed.usage_rows(rows), packed.primary_taxa(rows)).where("error is null").select("file_ord", F.col("i").cast("long").alias("i"), "anchor")


@register(
    "packed_accepted",
    f"""{_PACKED}, placed AS (SELECT l_orderkey, name_id, unnest(range(len(ss))) AS i, unnest(ss) AS status, unnest(ts) AS taxon FROM orders_ WHERE l_orderkey % 10 <> 8)
SELECT taxon, arg_min(name_id, l_orderkey * 100 + i) AS accepted_name_id FROM placed WHERE status = 'accepted' GROUP BY taxon""",
)
def packed_accepted(spark, sf_dir):
    return packed.accepted_names(_packed(spark, sf_dir))


def _ranked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rank = F.expr("case p_partkey % 4 when 0 then 'Species' when 1 then 'Genus' when 2 then 'Family' else 'Order' end")
    name = F.expr("case p_partkey % 4 when 0 then concat('s', p_partkey) when 1 then p_name when 2 then p_brand else p_type end")
    key = F.col("p_partkey")
    status = F.when(key % 9 == 4, "accepted,accepted").when(key % 10 == 7, "not-accepted").otherwise("accepted")
    return packed.cleaned(part.select(key.alias("file_ord"), F.concat(F.lit("n"), key.cast("string")).alias("name_id"), F.when(key % 11 != 3, name).alias("simple_name"), rank.alias("rank"), status.alias("usage_status"), F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("taxon_id"), F.lit("K").alias("kingdom"), F.col("p_type").alias("order"), F.col("p_brand").alias("family"), F.col("p_name").alias("genus")))


@register(
    "packed_parents",
    """WITH r AS (SELECT p_partkey AS file_ord, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN concat('s', p_partkey) WHEN 1 THEN p_name WHEN 2 THEN p_brand ELSE p_type END AS own, p_name, p_brand, p_type FROM part WHERE p_partkey % 11 <> 3),
first AS (SELECT k, own, min(file_ord) AS hit FROM r WHERE k > 0 AND file_ord % 9 <> 4 AND file_ord % 10 <> 7 GROUP BY k, own)
SELECT file_ord, concat('n', coalesce(g.hit, f.hit, o.hit)) AS parent_name_id FROM r
LEFT JOIN first g ON g.k = 1 AND g.own = r.p_name AND r.k = 0 LEFT JOIN first f ON f.k = 2 AND f.own = r.p_brand AND r.k < 2 LEFT JOIN first o ON o.k = 3 AND o.own = r.p_type AND r.k < 3
WHERE coalesce(g.hit, f.hit, o.hit) IS NOT NULL""",
)
def packed_parents(spark, sf_dir):
    rows = _ranked_parts(spark, sf_dir)
    return packed.parent_ids(packed.usage_rows(rows), packed.addressable_parents(rows))


# -- projections

_MAP = FieldMap(
    {"source_taxon_id": "id", "scientific_name": "name", "rank": "nation", "status": "kind"}, {"family": "nation", "genus": "blank"}, ({"column": "name", "language": "en"}, {"column": "blank", "language": "fr"}), {"1": "accepted", "2": "synonym"},
)


@register(
    "field_map_projection",
    """SELECT s_suppkey AS file_ord, CAST(s_suppkey AS VARCHAR) AS source_taxon_id, s_name AS scientific_name, CAST(s_nationkey AS VARCHAR) AS rank, CASE s_suppkey % 3 WHEN 1 THEN 'accepted' WHEN 2 THEN 'synonym' ELSE '0' END AS status_raw,
concat('family=', s_nationkey) AS classification, concat(s_name, '@en') AS vernacular, 'id,kind,name,nation' AS raw_keys FROM supplier WHERE s_suppkey % 7 <> 0""",
)
def field_map_projection(spark, sf_dir):
    """A mapped table; blank cells are null and rows without a name are left out."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    kept = F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.lit(" "), F.col("s_name"), F.lit("\t"))).otherwise("  ")
    table = s.select(F.col("s_suppkey").alias("file_ord"), F.col("s_suppkey").cast("string").alias("id"), kept.alias("name"), F.col("s_nationkey").cast("string").alias("nation"), (F.col("s_suppkey") % 3).cast("string").alias("kind"), F.lit("").alias("blank"))
    out = _MAP.source_rows(table)
    pairs = F.array_join(F.transform(F.map_entries("classification"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    names = F.array_join(F.transform("vernacular", lambda v: F.concat_ws("@", v["name"], v["language"])), ",")
    return out.select("file_ord", "source_taxon_id", "scientific_name", "rank", "status_raw", pairs.alias("classification"), names.alias("vernacular"), F.array_join(F.sort_array(F.map_keys("raw")), ",").alias("raw_keys"))


@register("term_projection", "SELECT c_custkey AS file_ord, CAST(c_custkey AS VARCHAR) AS source_taxon_id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS scientific_name, CASE WHEN c_custkey % 2 = 0 THEN 'species' ELSE 'verbatim' END AS rank, c_mktsegment AS family, CASE WHEN c_custkey % 5 = 0 THEN 'no scientificName' END AS error FROM customer")
def term_projection(spark, sf_dir):
    """Positional columns by term; the first rank that is filled counts, the record id stands in for the taxon id."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    table = c.select(key.alias("file_ord"), key.cast("string").alias("c0"), F.when(key % 5 != 0, F.col("c_name")).otherwise(" ").alias("c1"), F.when(key % 2 == 0, "species").otherwise("").alias("c2"), F.lit("verbatim").alias("c3"), F.col("c_mktsegment").alias("c4"))
    out = term_rows(table, {1: "scientificName", 2: "taxonRank", 3: "verbatimTaxonRank", 4: "family"}, 0)
    return out.select("file_ord", "source_taxon_id", "scientific_name", "rank", F.col("classification")["family"].alias("family"), "error")


# -- round trips: tables are written as files to the shared folder and read back


@register("delimited_roundtrip", "SELECT CAST(doc_id AS VARCHAR) AS id, lang, source, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n FROM documents")
def delimited_roundtrip(spark, sf_dir):
    """All documents, with their line breaks and quotes, written as quoted text and read back in splits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_folder(spark)}/delimited-{uuid.uuid4().hex}"
    writer = docs.select("doc_id", "lang", "source", "text").write.option("quote", '"').option("escape", '"').option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = read_delimited(spark, path, columns=["id", "lang", "source", "text"])
    return back.select("id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n"))


def write_sheet(file, rows: Iterable, sheet: str = "Names") -> None:
    """The smallest workbook that holds some text, written row by row."""
    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{v.replace("&", "&amp;").replace("<", "&lt;")}</t></is></c>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        zf.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        with zf.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for r in rows:
                f.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")


@register("xlsx_roundtrip", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, concat('\"', s_nationkey, '\", ', chr(10), '<&>') AS note FROM supplier")
def xlsx_roundtrip(spark, sf_dir):
    """All suppliers in a workbook, written as a stream and read back from storage."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string"), "s_name", F.concat(F.lit('"'), "s_nationkey", F.lit('", \n<&>')))
    path = f"{shared_folder(spark)}/sheet-{uuid.uuid4().hex}.xlsx"
    with StoredSink(spark, path) as out:
        write_sheet(out, chain([(" id ", "name", "note")], rows.toLocalIterator()))
    return read_sheet(spark, path, "Names").select("id", "name", "note")


def _zipped(spark: SparkSession, members: dict[str, Iterable[str]]) -> str:
    """The path of a new container whose members are written line by line."""
    path = f"{shared_folder(spark)}/container-{uuid.uuid4().hex}.zip"
    with StoredSink(spark, path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, lines in members.items():
            with zf.open(name, "w") as f:
                for line in lines:
                    f.write(line.encode())
    return path


@register(
    "archive_roundtrip",
    """SELECT 'archive' AS source, CAST(c_custkey AS VARCHAR) AS source_taxon_id, concat('"', c_name) AS scientific_name, NULL AS status_raw FROM customer
UNION ALL SELECT 'packed', CASE i WHEN 0 THEN CAST(c_custkey AS VARCHAR) ELSE concat(c_custkey, '#t0') END, concat(c_name, chr(10), '"x"'), CASE i WHEN 0 THEN 'accepted' ELSE 'misapplied' END FROM customer, (SELECT unnest([0, 1]) AS i)""",
)
def archive_roundtrip(spark, sf_dir):
    """All customers as an archive with a descriptor, and as a packed export with line breaks in a zip."""
    rows = lambda: spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").toLocalIterator()
    meta = '<archive xmlns="http://rs.tdwg.org/dwc/text/"><core fieldsTerminatedBy="\\t" fieldsEnclosedBy="" ignoreHeaderLines="1"><files><location>taxon.txt</location></files><id index="0"/><field index="1" term="http://rs.tdwg.org/dwc/terms/scientificName"/></core></archive>'
    archive = _zipped(spark, {"list/meta.xml": [meta], "list/taxon.txt": chain(["id\tname\n"], (f'{r[0]}\t"{r[1]}\n' for r in rows()))})
    export = _zipped(spark, {"names.csv": chain(["name_id,simple_name,usage_status,taxon_id\n"], (f'{r[0]},"{r[1]}\n""x""","accepted,misapplied","t{r[0]},t0"\n' for r in rows()))})
    a = read_archive(spark, archive).select(F.lit("archive").alias("source"), "source_taxon_id", "scientific_name", "status_raw")
    p = read_packed(spark, export).select(F.lit("packed"), "source_taxon_id", "scientific_name", "status_raw")
    return reduce(DataFrame.union, [a, p])
