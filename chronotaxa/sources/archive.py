"""Darwin Core Archives, and packed name exports, plain or zipped."""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..operators import packed
from ..plans.model import CLASSIFICATION_RANKS
from . import container
from .delimited import by_column, read_delimited
from .quoted import read_lines

#: Darwin Core terms and the fields they fill.
TERM_FIELDS = {
    "taxonID": "source_taxon_id",
    "scientificName": "scientific_name",
    "scientificNameAuthorship": "authorship",
    "taxonRank": "rank",
    "verbatimTaxonRank": "rank",
    "taxonomicStatus": "status_raw",
    "acceptedNameUsageID": "accepted_taxon_id",
    "acceptedNameUsage": "accepted_scientific_name",
    "parentNameUsageID": "parent_taxon_id",
    "parentNameUsage": "parent_scientific_name",
}
#: Core files that an archive without a usable descriptor may have.
FALLBACK_FILES = ("taxon.txt", "taxon.tsv", "taxon.csv", "taxa.txt")


class ArchiveError(ValueError):
    """The file is no archive that can be read."""


@dataclass(frozen=True)
class Core:
    location: str
    terms: dict[int, str]
    id_index: int | None = None
    delimiter: str = "\t"
    quote: str = '"'
    encoding: str = "utf-8"
    skip: int = 0


def _bare(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_descriptor(data: bytes) -> Core:
    """The core's layout from ``meta.xml``, with or without a namespace; fields without an index are left out."""
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ArchiveError(f"the descriptor is no XML: {e}") from e
    core = next((n for n in root.iter() if _bare(n.tag) == "core"), None)
    place = None if core is None else next((n.text for n in core.iter() if _bare(n.tag) == "location" and n.text), None)
    if not place:
        raise ArchiveError("the descriptor names no core file")
    terms = {int(n.get("index")): n.get("term", "").rsplit("/", 1)[-1] for n in core if _bare(n.tag) == "field" and n.get("index", "").isdigit()}
    own = next((n.get("index") for n in core if _bare(n.tag) == "id"), None)
    plain = lambda s: s.replace("\\t", "\t").replace("\\n", "\n")
    skip = core.get("ignoreHeaderLines", "0")
    return Core(place.strip(), terms, int(own) if own and own.isdigit() else None, plain(core.get("fieldsTerminatedBy", "\t")) or "\t", plain(core.get("fieldsEnclosedBy", '"')), core.get("encoding", "utf-8") or "utf-8", int(skip) if skip.isdigit() else 0)


def _find(zf: zipfile.ZipFile, name: str) -> str | None:
    """A member by name in any case, also inside a wrapping folder."""
    wanted = name.lower()
    return next((n for n in zf.namelist() if n.lower() == wanted or n.lower().endswith("/" + wanted)), None)


def _fallback(zf: zipfile.ZipFile) -> Core:
    """The header names the terms."""
    for name in FALLBACK_FILES:
        if member := _find(zf, name):
            delimiter = "," if name.endswith(".csv") else "\t"
            with zf.open(member) as f:
                header = io.TextIOWrapper(f, "utf-8-sig").readline().rstrip("\r\n").split(delimiter)
            return Core(member, {k: h.strip().strip('"').rsplit("/", 1)[-1] for k, h in enumerate(header)}, delimiter=delimiter, skip=1)
    raise ArchiveError("there is neither a usable descriptor nor a taxon file")


def _opened(spark: SparkSession, path: str) -> zipfile.ZipFile:
    zf = container.opened(spark, path)
    if zf is None:
        raise ArchiveError(f"{path} is no zip file")
    return zf


def layout(zf: zipfile.ZipFile) -> tuple[str, Core]:
    """The core file's member and its layout, by the descriptor or else by the core file's header."""
    try:
        member = _find(zf, "meta.xml")
        if member is None:
            raise ArchiveError("no descriptor")
        core = parse_descriptor(zf.read(member))
        member = _find(zf, core.location)
        if member is None:
            raise ArchiveError(f"no file {core.location}")
    except ArchiveError:
        core = _fallback(zf)
        member = core.location
    return member, core


def term_rows(df: DataFrame, terms: dict[int, str], id_index: int | None = None) -> DataFrame:
    """Positional columns c0, c1, ... as source rows. A repeated field keeps the last value, rank the first.

    Rows without a name are kept with an error (Q13)."""
    value = lambda k: blank_to_null(F.col(f"c{k}"))
    null = F.lit(None).cast("string")

    def pick(indexes: list[int], last: bool = True) -> Column:
        cols = [value(k) for k in sorted(indexes, reverse=last)]
        return F.coalesce(*cols) if cols else null

    own = {f: pick([k for k, t in terms.items() if TERM_FIELDS.get(t) == f], f != "rank") for f in dict.fromkeys(TERM_FIELDS.values())}
    if id_index is not None and f"c{id_index}" in df.columns:
        own["source_taxon_id"] = F.coalesce(own["source_taxon_id"], value(id_index))
    named = {t: pick([k for k, x in terms.items() if x == t]) for t in dict.fromkeys(t for t in terms.values() if t)}
    as_map = lambda keys: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(named[k] for k in keys))), lambda k, v: v.isNotNull()) if keys else F.create_map().cast("map<string,string>")
    common = [F.struct(value(k).alias("name"), null.alias("language")) for k, t in sorted(terms.items()) if t == "vernacularName"]
    vernacular = F.filter(F.array(*common), lambda x: x["name"].isNotNull()) if common else F.array().cast("array<struct<name:string,language:string>>")
    order = ("source_taxon_id", "scientific_name", "authorship", "rank", "status_raw", "accepted_taxon_id", "accepted_scientific_name", "parent_taxon_id", "parent_scientific_name")
    return df.select(
        "file_ord", *(own[f].alias(f) for f in order), as_map([r for r in CLASSIFICATION_RANKS if r in named]).alias("classification"), vernacular.alias("vernacular"), as_map(list(named)).alias("raw"),
        F.when(own["scientific_name"].isNull(), F.lit("no scientificName")).alias("error"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """An archive's core as source rows. Unquoted layouts keep quotes as text (Q22)."""
    with _opened(spark, path) as zf:
        member, core = layout(zf)
    width = max([*core.terms, core.id_index or 0]) + 1
    lines = container.member_lines(spark, path, member, core.encoding.lower().removesuffix("-sig"))
    df = by_column(read_lines(lines, core.delimiter, "utf-8", core.quote), columns=[f"c{k}" for k in range(width)]).where(F.col("file_ord") >= core.skip)
    some = reduce(lambda a, b: a | b, (F.col(f"c{k}").isNotNull() for k in range(width)))
    return term_rows(df.where(some), core.terms, core.id_index)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """A packed name export, as text or as the first text file of a zip."""
    if not path.lower().endswith(".zip"):
        return packed.source_rows(read_delimited(spark, path))
    with _opened(spark, path) as zf:
        member = next((n for n in zf.namelist() if n.lower().endswith(".csv")), None)
    if member is None:
        raise ArchiveError(f"{path} holds no .csv file")
    return packed.source_rows(by_column(read_lines(container.member_lines(spark, path, member), ",", "utf-8", '"')))
