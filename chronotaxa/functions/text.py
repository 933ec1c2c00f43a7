"""Scalar text functions as Column expressions.

Everything runs on the JVM but Unicode NFC, which Spark lacks: only texts with non-ASCII characters reach
that Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The status vocabulary, keyed by the lower-cased letters of a source's spelling.
STATUS_MAP = {
    "accepted": "accepted",
    "acceptedname": "accepted",
    "valid": "accepted",
    "validname": "accepted",
    "correct": "accepted",
    "current": "accepted",
    "synonym": "synonym",
    "homotypicsynonym": "synonym",
    "heterotypicsynonym": "synonym",
    "objectivesynonym": "synonym",
    "subjectivesynonym": "synonym",
    "juniorsynonym": "synonym",
    "invalid": "synonym",
    "ambiguoussynonym": "ambiguous_synonym",
    "misapplied": "misapplied",
    "misappliedname": "misapplied",
    "provisional": "provisional",
    "provisionallyaccepted": "provisional",
    "barename": "bare_name",
    "nomennudum": "bare_name",
}


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _unaccented(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _when_wide(c: Column, udf) -> Column:
    wide = F.length(c) != F.octet_length(c)
    return F.coalesce(udf(F.when(wide, c)), c)


def nfc(c: Column | str) -> Column:
    """canonical composition."""
    return _when_wide(_col(c), _nfc)


def unaccented(c: Column | str) -> Column:
    """Lower-cased, without combining marks: what the full-text tokens are made of."""
    return F.lower(_when_wide(_col(c), _unaccented))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    """Null if nothing but white space is left."""
    return F.nullif(strip(c), F.lit(""))


def canonical_key(c: Column | str) -> Column:
    """one spelling of hybrid signs and blanks, lower case; null counts as empty."""
    t = strip(nfc(F.coalesce(_col(c), F.lit(""))))
    t = F.regexp_replace(t, "[✕⨯]", "×")
    t = F.regexp_replace(t, r"(?U)(?<![a-z])[xX](?=\s)", "×")
    t = F.regexp_replace(t, r"(?U)×\s*", "× ")
    return F.lower(strip(F.regexp_replace(t, r"(?U)\s+", " ")))


def authorship_key(c: Column | str) -> Column:
    """authorship without mechanical variation; null gives ''."""
    t = F.lower(strip(nfc(F.coalesce(_col(c), F.lit("")))))
    for old, new in ((r" and ", " & "), (r" et ", " & "), (r"\.", " "), (r"(?U)\s*&\s*", " & "), (r"(?U)\s*,\s*", " "), (r"(?U)\(\s*", "("), (r"(?U)\s*\)", ")"), (r"(?U)\s+", " ")):
        t = F.regexp_replace(t, old, new)
    return strip(t)


def norm_key(canonical: Column | str, authorship: Column | str) -> Column:
    """F4."""
    return F.concat(canonical_key(canonical), F.lit("|"), authorship_key(authorship))


def split_norm_key(c: Column | str) -> tuple[Column, Column]:
    """parts before and after the first bar."""
    at = F.instr(_col(c), "|")
    return F.when(at > 0, F.substr(_col(c), F.lit(1), at - 1)).otherwise(_col(c)), F.when(at > 0, F.substr(_col(c), at + 1)).otherwise("")


def lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c) if table else F.lit(None).cast("string")


def status(c: Column | str) -> Column:
    """the controlled status of a source's spelling; ``unknown`` if it has none."""
    key = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z]", "")
    return F.coalesce(lookup(key, STATUS_MAP), F.lit("unknown"))


def full_name(name: Column | str, author: Column | str) -> Column:
    """F8: the author is appended unless it is part of the name already, in any case (Q10)."""
    n, a = strip(F.coalesce(_col(name), F.lit(""))), strip(F.coalesce(_col(author), F.lit("")))
    return F.when((a != "") & (F.instr(F.lower(n), F.lower(a)) == 0), strip(F.concat_ws(" ", n, a))).otherwise(n)


def split_list(c: Column | str) -> Column:
    """items of a comma list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda x: strip(x)), lambda x: x != "")


def last_segment(c: Column | str) -> Column:
    """F10."""
    return F.substring_index(_col(c), "/", -1)


def query_tokens(c: Column | str) -> Column:
    """the words of a full-text query, each searched as a prefix."""
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r'["*():^\-]', " ")
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def round2(c: Column | str) -> Column:
    """two decimals, half to even."""
    return F.bround(_col(c), 2)


def iso_date(c: Column | str) -> Column:
    """F17."""
    return F.date_format(_col(c), "yyyy-MM-dd")


def version_of(filename: Column | str) -> tuple[Column, Column]:
    """version ``YYYY.MM.DD`` and date from the first eight digits of a file name; null if there are none."""
    digits = F.nullif(F.regexp_extract(_col(filename), r"(\d{8})", 1), F.lit(""))
    return F.regexp_replace(digits, r"^(\d{4})(\d\d)(\d\d)$", "$1.$2.$3"), F.to_date(digits, "yyyyMMdd")


def nomenclatural_code(year: Column | str) -> Column:
    """a year in the authorship is a zoological habit."""
    return F.when(_col(year).isNotNull(), F.lit("zoological")).otherwise(F.lit("unknown"))


def warnings(*parts: Column) -> Column:
    """joined by ``; ``; null if there are none."""
    return F.nullif(F.concat_ws("; ", *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def problem(taxon_id: Column, name: Column, target_id: Column, target_name: Column) -> Column:
    """F28."""
    some = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return F.concat(some(taxon_id, name), F.lit(" -> "), some(target_id, target_name))


def _arrow(left: Column, right: Column, arrow: str) -> Column:
    return F.concat(left, F.lit(arrow), right)


def describe_report(kind: Column, d: dict[str, Column]) -> Column:
    """a change in a line of the text report; nulls show as None."""
    show = lambda k: F.coalesce(d[k], F.lit("None"))
    named = lambda a, b, extra="": F.concat(show("name"), F.lit(": " + extra), _arrow(show(a), show(b), " -> "))
    rules = [
        (["lumped"], _arrow(F.array_join(d["sunk"], ", "), show("into_name"), " -> ")),
        (["split"], _arrow(show("from_name"), F.array_join(d["into"], ", "), " -> ")),
        (["accepted_changed"], named("from_accepted", "to_accepted")),
        (["status_changed"], named("from_status", "to_status")),
        (["reclassified"], named("from_parent", "to_parent", "parent ")),
        (["rank_changed"], named("from_rank", "to_rank")),
        (["renamed", "probable_rename"], _arrow(show("from_name"), show("to_name"), " -> ")),
        (["author_changed"], named("from_author", "to_author")),
        (["id_replaced"], named("from_id", "to_id")),
    ]
    other = F.trim(F.concat(F.coalesce(d["name"], F.lit("")), F.lit(" ("), F.coalesce(d["status"], F.lit("")), F.lit(")")))
    return reduce(lambda acc, r: F.when(kind.isin(*r[0]), r[1]).otherwise(acc), rules, other)


def describe_page(kind: Column, d: dict[str, Column]) -> Column:
    """the short phrase of the web view; missing accepted names, parents and authors show as a dash."""
    show = lambda k: F.coalesce(d[k], F.lit("None"))
    dash = lambda k: F.coalesce(F.nullif(d[k], F.lit("")), F.lit("—"))
    to = " → "
    rules = [
        (["lumped"], _arrow(F.array_join(d["sunk"], ", "), show("into_name"), to)),
        (["split"], _arrow(show("from_name"), F.array_join(d["into"], ", "), to)),
        (["accepted_changed"], _arrow(dash("from_accepted"), dash("to_accepted"), to)),
        (["status_changed"], _arrow(show("from_status"), show("to_status"), to)),
        (["reclassified"], F.concat(F.lit("parent "), _arrow(dash("from_parent"), dash("to_parent"), to))),
        (["rank_changed"], _arrow(show("from_rank"), show("to_rank"), to)),
        (["renamed", "probable_rename"], _arrow(show("from_name"), show("to_name"), to)),
        (["author_changed"], _arrow(dash("from_author"), dash("to_author"), to)),
        (["id_replaced"], _arrow(show("from_id"), show("to_id"), to)),
    ]
    return reduce(lambda acc, r: F.when(kind.isin(*r[0]), r[1]).otherwise(acc), rules, F.lit(""))
