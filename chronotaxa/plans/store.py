"""Parquet layout of checklists and their releases.

Every change writes new folders, which one commit of the store's log (``log``) puts in place of the old ones, for all tables at once. ``usage`` and
``usage_track`` are partitioned by (code, version), ``change`` by (code, from_version, to_version), so that replacing a release or
a comparison leaves other folders as they are. Names are shared by all lists and survive a release that is dropped. Rows of names and
usages are sorted by name over files of disjoint ranges, and usages have filters on their ids, so that reading a few names skips the rest.
The names' full-text index grows by the rows of each load's new names in the same commit.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, match
from ..operators.fulltext import Index, facts, net, postings
from ..operators.ingest import Loaded, load
from . import model
from .log import Folder, Log, Snapshot
from .staging import cut


class StoreError(ValueError):
    """What was asked contradicts what is stored."""


def file_sha256(path: str) -> str:
    """F15."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def parse_date(value: str | None) -> dt.date | None:
    """F16."""
    try:
        return dt.date.fromisoformat(value) if value else None
    except ValueError as e:
        raise StoreError(f"{value!r} is no date like 2024-01-31") from e


@dataclass(frozen=True)
class Compared:
    """A stored comparison: its changes, how usages were paired, and the anchors several usages of a release share (A17), first come first."""

    changes: DataFrame
    anchor_kind: str
    ambiguous: DataFrame


class Transaction:
    """What one commit will change, from the snapshot that the work began with."""

    def __init__(self, store: Store, base: Snapshot):
        self.store, self.base, self.tables, self.written = store, base, dict(base.tables), []

    def _write(self, table: str, df: DataFrame) -> list[Folder]:
        relative, parts = f"{table}/commit={uuid.uuid4().hex}", Store._PARTS.get(table, [])
        self.written.append(relative)
        inner = Store._INNER.get(table, [])
        if table in Store._ORDER:
            order = [*parts, *inner, Store._ORDER[table]]
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        writer = df.write.partitionBy(*parts, *inner).option("maxRecordsPerFile", self.store.rows_per_file)
        for column in Store._LOOKED_UP.get(table, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self.store.root}/{relative}")
        return self.store.log.leaves(relative, parts)

    def append(self, table: str, df: DataFrame) -> None:
        self.tables[table] = (*self.tables.get(table, ()), *self._write(table, df))

    def remove(self, table: str, **key: str) -> None:
        self.tables[table] = tuple(f for f in self.tables.get(table, ()) if not f.has(**key))

    def replace(self, table: str, df: DataFrame) -> None:
        """Puts ``df`` in the place of a whole table, or of the keys that it has."""
        new = self._write(table, df)
        kept = [f for f in self.tables.get(table, ()) if Store._PARTS.get(table) and f.key not in {n.key for n in new}]
        self.tables[table] = (*kept, *new)

    def discard(self) -> None:
        for relative in self.written:
            self.store.log.delete(relative)


class Store:
    _PARTS = {"usage": ["code", "version"], "usage_track": ["code", "version"], "change": ["code", "from_version", "to_version"]}
    #: Partition columns inside a folder, by which a reader's filters prune.
    _INNER = {"posting": ["bucket"]}
    _ORDER = {"name": "name_id", "usage": "name_id", "posting": "word", "usage_track": "usage_id", "change": "to_usage_id"}
    _LOOKED_UP = {"name": ("norm_key", "canonical_key"), "usage": ("usage_id",)}
    _SCHEMAS = {"checklist": model.CHECKLIST, "release": model.RELEASE, "name": model.NAME, "usage": model.USAGE, "track": model.TRACK, "usage_track": model.USAGE_TRACK, "change": model.CHANGE, "link": model.LINK, "posting": model.POSTING, "fact": model.FACT}
    #: How often work is done again because another commit came first.
    RETRIES = 8

    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = 2_000_000):
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file
        self.log = Log(spark, self.root)
        self._pinned: Snapshot | None = None

    # -- tables

    def read(self, table: str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table as of the latest snapshot, or of the one given; filters on partition columns prune files."""
        schema = self._SCHEMAS[table]
        for part in (*self._PARTS.get(table, []), *self._INNER.get(table, [])):
            schema = type(schema)([*schema.fields]).add(part, "string")
        folders = (snapshot or self._pinned or self.log.latest()).folders(table)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{f.path}" for f in folders)).select(schema.fieldNames())

    def transact(self, work):
        """Runs ``work(transaction)``, which reads one snapshot, and commits what it wrote; does both again if another commit came first."""
        for _ in range(self.RETRIES):
            base = self.log.latest()
            todo, self._pinned = Transaction(self, base), base
            try:
                out = work(todo)
                if todo.tables == base.tables or self.log.commit(base, todo.tables):
                    return out
            except BaseException:
                todo.discard()
                raise
            finally:
                self._pinned = None
            todo.discard()
        raise StoreError("other commits came first again and again")

    def index(self) -> Index:
        """The names' full-text index."""
        return Index(self.read("posting"), self.read("fact"))

    def merge_index(self) -> None:
        """Rewrites the index in as few rows and folders as possible."""

        def work(todo: Transaction) -> None:
            small = net(self.index())
            todo.replace("posting", small.postings)
            todo.replace("fact", small.facts)

        self.transact(work)

    # -- checklists

    def add_checklist(self, code: str, title: str, id_stability: str = "unstable", **fields) -> None:
        """K10."""
        if id_stability not in model.ID_STABILITY:
            raise StoreError(f"{id_stability} is none of {', '.join(model.ID_STABILITY)}")
        row = {f.name: None for f in model.CHECKLIST} | fields | {"code": code, "title": title, "id_stability": id_stability, "created_at": dt.datetime.now(dt.UTC).replace(tzinfo=None)}

        def work(todo: Transaction) -> None:
            if self.read("checklist").where(F.col("code") == code).take(1):
                raise StoreError(f"there is a checklist {code} already")
            todo.append("checklist", self.spark.createDataFrame([row], model.CHECKLIST).coalesce(1))

        self.transact(work)

    def set_checklist(self, code: str, id_stability: str) -> None:
        if id_stability not in model.ID_STABILITY:
            raise StoreError(f"{id_stability} is none of {', '.join(model.ID_STABILITY)}")
        new = F.when(F.col("code") == code, F.lit(id_stability)).otherwise(F.col("id_stability"))

        def work(todo: Transaction) -> None:
            self._checklist(code)
            todo.replace("checklist", self.read("checklist").withColumn("id_stability", new).coalesce(1))

        self.transact(work)

    def _checklist(self, code: str):
        row = self.read("checklist").where(F.col("code") == code).first()
        if row is None:
            raise StoreError(f"there is no checklist {code}")
        return row

    def _release(self, code: str, version: str):
        row = self.read("release").where((F.col("code") == code) & (F.col("version") == version)).first()
        if row is None:
            raise StoreError(f"{code} has no release {version}")
        return row

    # -- releases

    def ingest(self, code: str, version: str, rows: DataFrame, *, released_on: dt.date | None = None, uri: str | None = None, sha256: str | None = None, fmt: str = "csv", replace: bool = False) -> Loaded:
        """K4, K5: refuses a version that is there unless it is to be replaced; a file without a usable row leaves a failed release (Q12).

        The new rows are computed and checked (C1, C2, C4) first; names, their index, usages and the release's entry then change in one commit. A
        replacement without a usable row leaves the old release as it is.
        """
        if fmt not in model.SOURCE_FORMATS:
            raise StoreError(f"{fmt} is none of {', '.join(model.SOURCE_FORMATS)}")
        rows = cut(rows)

        def work(todo: Transaction) -> tuple[Loaded, int]:
            self._checklist(code)
            releases = self.read("release")
            old = releases.where((F.col("code") == code) & (F.col("version") == version)).first()
            if old is not None and old["status"] != "failed" and not replace:
                same = sha256 is not None and old["source_sha256"] == sha256
                raise StoreError(f"{code} {version} is loaded already, " + ("from this very file" if same else "from another file; replace it or choose another version"))
            seq = (releases.agg(F.max("seq")).first()[0] or 0) + 1
            known = self.read("name")
            loaded = load(rows, seq, known)
            names = loaded.names
            model.require_distinct_ids(names, known)
            usages = cut(model.check_vocabulary(loaded.usages, "status", model.TAXONOMIC_STATUS))
            model.require_unique(usages, "source_taxon_id")
            model.require_targets(usages, "name_id", names.select("name_id").union(known.select("name_id")))
            for pointer in ("accepted_usage_id", "parent_usage_id"):
                model.require_targets(usages, pointer, usages, "usage_id")
            count = usages.count()
            entry = {f.name: None for f in model.RELEASE} | {"code": code, "version": version, "seq": seq, "released_on": released_on, "ingested_at": dt.datetime.now(dt.UTC).replace(tzinfo=None), "source_uri": uri, "source_sha256": sha256, "format": fmt, "usage_count": count, "status": "ready" if count else "failed"}
            if not count and old is not None and old["status"] != "failed":
                raise StoreError(f"{code} {version}: the file has no usable row, so the release that is there stays")
            if count:
                todo.append("name", names.select([f.name for f in model.NAME]))
                todo.append("posting", postings(names))
                todo.append("fact", facts(names))
                todo.replace("usage", usages.withColumns({"code": F.lit(code), "version": F.lit(version)}))
                self._forget(todo, code, version)
            others = releases.where(~((F.col("code") == code) & (F.col("version") == version)))
            todo.replace("release", others.unionByName(self.spark.createDataFrame([entry], model.RELEASE)).coalesce(1))
            return loaded, count

        loaded, count = self.transact(work)
        if not count:
            raise StoreError(f"{code} {version}: the file has no usable row")
        return loaded

    @staticmethod
    def _forget(todo: Transaction, code: str, version: str) -> None:
        """Drops memberships and changes of a release."""
        todo.remove("usage_track", code=code, version=version)
        todo.remove("change", code=code, from_version=version)
        todo.remove("change", code=code, to_version=version)

    def drop_release(self, code: str, version: str) -> None:
        """Usages, memberships and changes go with the release; names stay."""

        def work(todo: Transaction) -> None:
            todo.remove("usage", code=code, version=version)
            self._forget(todo, code, version)
            todo.replace("release", self.read("release").where(~((F.col("code") == code) & (F.col("version") == version))).coalesce(1))

        self.transact(work)

    def ordered_releases(self, code: str) -> DataFrame:
        """O3, with the version breaking ties."""
        return self.read("release").where((F.col("code") == code) & (F.col("status") == "ready")).orderBy(F.asc_nulls_first("released_on"), "version")

    # -- comparison

    def usages_of(self, code: str, versions: list[str]) -> DataFrame:
        number = reduce(lambda acc, kv: F.when(F.col("version") == kv[1], F.lit(kv[0] + 1)).otherwise(acc), enumerate(versions), F.lit(None).cast("int"))
        u = self.read("usage").where((F.col("code") == code) & F.col("version").isin(versions)).withColumn("release", number)
        return match.usage_names(u, self.read("name"))

    def diff(self, code: str, before: str, after: str, *, cutoff: float = 88.0, force: bool = False) -> Compared:
        """K6, K7: compares two releases and stores changes, threads and memberships in one commit. Counts rows, so a pair without changes may be run again (Q7)."""
        if before == after:
            raise StoreError("a release is not compared with itself")

        def work(todo: Transaction) -> Compared:
            stability = self._checklist(code)["id_stability"]
            self._release(code, before), self._release(code, after)
            here = (F.col("code") == code) & (F.col("from_version") == before) & (F.col("to_version") == after)
            if not force and self.read("change").where(here).take(1):
                raise StoreError(f"{code} {before} and {after} are compared already")
            usages = cut(self.usages_of(code, [before, after]))
            kind = match.choose_anchor(usages, stability)
            index = cut(match.winners(usages, kind))
            pairs = cut(match.paired(match.with_pointers(index)))
            changes = detect.with_tracks(detect.union(detect.all_changes(pairs, kind, cutoff)), pairs, code, kind)
            rows = changes.withColumn("detail", detect.detail_json()).select([f.name for f in model.CHANGE])
            rows = cut(rows.withColumns({"code": F.lit(code), "from_version": F.lit(before), "to_version": F.lit(after)}))
            rows = model.check_vocabulary(rows, "type", model.CHANGE_TYPES)
            todo.append("track", cut(match.tracks(index, code, kind, self.read("track"))))
            for version in (before, after):
                todo.remove("usage_track", code=code, version=version)
            todo.replace("usage_track", match.memberships(index, code, kind).withColumns({"code": F.lit(code), "version": F.when(F.col("release") == 1, F.lit(before)).otherwise(F.lit(after))}).drop("release"))
            todo.remove("change", code=code, from_version=before, to_version=after)
            todo.replace("change", rows)
            return Compared(rows, kind, match.ambiguous(index.orderBy("release", "bucket_ord")))

        return self.transact(work)
