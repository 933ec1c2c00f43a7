"""Command line: ``python -m chronotaxa.cli --store DIR COMMAND``.

Commands: version, health, checklist add|list|set|check-ids, ingest, batch, diff run|show, trace, serve.
CHRONOTAXA_STORE and CHRONOTAXA_FUZZY_THRESHOLD give defaults.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import history
from .plans.store import Store, StoreError, file_sha256, parse_date
from .sources.archive import ArchiveError, read_archive, read_packed
from .sources.delimited import detect_format, read_mapped
from .sources.fieldmap import FieldMap, FieldMapError
from .streaming.dropfolder import load_files

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronotaxa")
    p.add_argument("--store", default=os.environ.get("CHRONOTAXA_STORE", "store"))
    p.add_argument("--threshold", type=float, default=float(os.environ.get("CHRONOTAXA_FUZZY_THRESHOLD", "88")))
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("health")
    lists = sub.add_parser("checklist").add_subparsers(dest="action", required=True)
    add = lists.add_parser("add")
    add.add_argument("code")
    add.add_argument("title")
    add.add_argument("--id-stability", default="unstable")
    for name in ("publisher", "homepage", "license", "notes"):
        add.add_argument(f"--{name}")
    lists.add_parser("list")
    change = lists.add_parser("set")
    change.add_argument("code")
    change.add_argument("--id-stability", required=True)
    check = lists.add_parser("check-ids")
    for name in ("code", "before", "after"):
        check.add_argument(name)
    check.add_argument("--text", action="store_true")
    ingest = sub.add_parser("ingest")
    for name in ("code", "version", "path"):
        ingest.add_argument(name)
    ingest.add_argument("--format", choices=("auto", "csv", "dwca", "packed"), default="auto")
    ingest.add_argument("--map")
    ingest.add_argument("--released-on")
    ingest.add_argument("--replace", action="store_true")
    batch = sub.add_parser("batch")
    batch.add_argument("code")
    batch.add_argument("folder")
    diff = sub.add_parser("diff").add_subparsers(dest="action", required=True)
    for name in ("run", "show"):
        d = diff.add_parser(name)
        for a in ("code", "before", "after"):
            d.add_argument(a)
        if name == "run":
            d.add_argument("--force", action="store_true")
        else:
            d.add_argument("--type")
            d.add_argument("--limit", type=int, default=50)
            d.add_argument("--json", action="store_true")
    trace = sub.add_parser("trace")
    trace.add_argument("name")
    trace.add_argument("--text", action="store_true")
    serve = sub.add_parser("serve")
    serve.add_argument("--port", type=int, default=8000)
    return p


def read_source(spark: SparkSession, store: Store, path: str, fmt: str, fmap: str | None):
    """(rows, recorded format)."""
    if fmt == "auto":
        fmt = "dwca" if Path(path).suffix.lower() == ".zip" else "csv"
    if fmt == "dwca":
        return read_archive(spark, path), "dwca"
    if fmt == "packed":
        return read_packed(spark, path), "csv"
    if not fmap:
        raise FieldMapError("a text or spreadsheet file needs --map")
    return read_mapped(spark, path, FieldMap.from_yaml(fmap)), detect_format(path)


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    store = Store(spark, args.store)
    match args.command, getattr(args, "action", None):
        case "health", _:
            return json.dumps({"spark": spark.version, "checklists": store.read("checklist").count(), "names": store.read("name").count()})
        case "checklist", "add":
            store.add_checklist(args.code, args.title, args.id_stability, publisher=args.publisher, homepage=args.homepage, license=args.license, notes=args.notes)
            return f"added {args.code}"
        case "checklist", "list":
            return history.releases_text(store)
        case "checklist", "set":
            store.set_checklist(args.code, args.id_stability)
            return f"{args.code} is {args.id_stability}"
        case "checklist", "check-ids":
            if args.text:
                return history.check_ids_text(store, args.code, args.before, args.after)
            return json.dumps(history.check_ids(store, args.code, args.before, args.after).first().asDict())
        case "ingest", _:
            rows, fmt = read_source(spark, store, args.path, args.format, args.map)
            loaded = store.ingest(args.code, args.version, rows, released_on=parse_date(args.released_on), uri=args.path, sha256=file_sha256(args.path), fmt=fmt, replace=args.replace)
            problems = [r["problem"] for r in loaded.problems.orderBy("file_ord").limit(10).collect()]
            return json.dumps(loaded.report.first().asDict() | {"problems": problems}, ensure_ascii=False)
        case "batch", _:
            said: list[str] = []
            load_files(store, args.code, [str(p) for p in sorted(Path(args.folder).iterdir())], lambda path: read_packed(spark, path), said.append)
            return "\n".join(said)
        case "diff", "run":
            return history.compared_text(store.diff(args.code, args.before, args.after, cutoff=args.threshold, force=args.force))
        case "diff", "show":
            rows = history.change_list(store, args.code, args.before, args.after, args.type, args.limit).collect()
            if args.json:
                return json.dumps([{"type": r["type"], "detail": json.loads(r["detail"]), "confidence": r["confidence"]} for r in rows], ensure_ascii=False)
            return "\n".join(f"{r['type']:<18}{r['line']}" for r in rows)
        case "trace", _:
            found = history.trace(store, args.name, args.threshold)
            return history.trace_text(found) if args.text else json.dumps(found, ensure_ascii=False)
    raise ValueError(args.command)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    spark = SparkSession.builder.appName("chronotaxa").getOrCreate()
    try:
        if args.command == "serve":
            from .api import serve

            serve(Store(spark, args.store), args.port, args.threshold)
        else:
            print(run(args, spark))
    except (StoreError, FieldMapError, ArchiveError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
