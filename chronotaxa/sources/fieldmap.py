"""Declarative maps from a table's columns to source rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, lookup, strip
from ..plans.model import TAXONOMIC_STATUS

FIELDS = ("source_taxon_id", "scientific_name", "authorship", "rank", "status", "accepted_taxon_id", "accepted_scientific_name", "parent_taxon_id", "parent_scientific_name")


class FieldMapError(ValueError):
    """The map is no valid description of a table."""


@dataclass(frozen=True)
class FieldMap:
    fields: dict[str, str]
    classification: dict[str, str] = field(default_factory=dict)
    vernacular: Sequence[dict[str, str]] = ()
    status_values: dict[str, str] = field(default_factory=dict)
    delimiter: str = ","
    encoding: str = "utf-8-sig"
    sheet: str | None = None

    def __post_init__(self):
        if unknown := sorted(set(self.fields) - set(FIELDS)):
            raise FieldMapError(f"unknown fields: {', '.join(unknown)}")
        if not self.fields.get("scientific_name"):
            raise FieldMapError("scientific_name must be mapped")
        object.__setattr__(self, "status_values", {str(k).strip().lower(): v for k, v in self.status_values.items()})
        if wrong := sorted({v for v in self.status_values.values() if v not in TAXONOMIC_STATUS}):
            raise FieldMapError(f"status_values lead to no status: {', '.join(wrong)}")

    @classmethod
    def from_yaml(cls, path: str | Path) -> FieldMap:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        if not isinstance(data, dict) or not isinstance(data.get("fields"), dict):
            raise FieldMapError("a map needs a section named fields")
        known = {"fields", "classification", "vernacular", "status_values", "delimiter", "encoding", "sheet"}
        return cls(**{k: v for k, v in data.items() if k in known and v is not None})

    def columns(self) -> list[str]:
        return [*self.fields.values(), *self.classification.values(), *(v["column"] for v in self.vernacular)]

    def check_header(self, header: Sequence[str], source: str = "the table") -> None:
        """A mapped column that is missing would silently be null everywhere."""
        if header and (missing := sorted(set(self.columns()) - set(header))):
            raise FieldMapError(f"{source} lacks the columns {', '.join(missing)}")

    def source_rows(self, df: DataFrame) -> DataFrame:
        """Source rows of a table with ``file_ord``; rows without a name are left out (Q13)."""
        self.check_header([c for c in df.columns if c != "file_ord"])
        null = F.lit(None).cast("string")

        def get(name: str) -> Column:
            return blank_to_null(F.col(f"`{self.fields[name]}`")) if name in self.fields else null

        status = F.coalesce(lookup(F.lower(strip(get("status"))), self.status_values), get("status"))
        classes = {k: blank_to_null(F.col(f"`{c}`")) for k, c in self.classification.items()}
        classification = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*classes.values())), lambda k, v: v.isNotNull()) if classes else F.create_map().cast("map<string,string>")
        names = [F.struct(blank_to_null(F.col(f"`{v['column']}`")).alias("name"), F.lit(v.get("language")).cast("string").alias("language")) for v in self.vernacular]
        vernacular = F.filter(F.array(*names), lambda x: x["name"].isNotNull()) if names else F.array().cast("array<struct<name:string,language:string>>")
        given = [c for c in df.columns if c != "file_ord"]
        raw = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, given)), F.array(*(F.col(f"`{c}`").cast("string") for c in given))), lambda k, v: v.isNotNull() & (v != ""))
        out = df.select(
            "file_ord",
            *(get(n).alias(n) for n in ("source_taxon_id", "scientific_name", "authorship", "rank")),
            status.alias("status_raw"),
            *(get(n).alias(n) for n in FIELDS[5:]),
            classification.alias("classification"),
            vernacular.alias("vernacular"),
            raw.alias("raw"),
            null.alias("error"),
        )
        return out.where("scientific_name is not null")
