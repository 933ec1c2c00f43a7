"""Traces, lists and reports over a store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import describe_page, describe_report, iso_date
from ..operators import resolve as resolving
from ..operators import stability, timeline
from . import model
from .store import Compared, Store, StoreError


def _detail_columns() -> dict:
    get = lambda key: F.get_json_object("detail", f"$.{key}")
    out = {k: get(k) for k in ("name", "status", "from_name", "to_name", "from_author", "to_author", "from_status", "to_status", "from_accepted", "to_accepted", "from_parent", "to_parent", "from_rank", "to_rank", "from_id", "to_id")}
    out["from_name"] = F.coalesce(out["from_name"], get("from"))
    out["into_name"] = get("into")
    return out | {k: F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>")) for k in ("sunk", "into", "sources")}


def change_list(store: Store, code: str, before: str, after: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Changes in the order of emission with a line of text each."""
    if kind is not None and kind not in model.CHANGE_TYPES:
        raise StoreError(f"{kind} is no type of change")
    rows = store.read("change").where((F.col("code") == code) & (F.col("from_version") == before) & (F.col("to_version") == after))
    rows = rows.where(F.col("type") == kind) if kind else rows
    return rows.withColumns({"line": describe_report(F.col("type"), _detail_columns()), "phrase": describe_page(F.col("type"), _detail_columns())}).orderBy("seq").limit(limit)


def counts(changes: DataFrame) -> DataFrame:
    """How many changes of each type, in the order of reports."""
    place = F.array_position(F.array(*map(F.lit, model.DISPLAY_ORDER)), F.col("type"))
    return changes.groupBy("type").agg(F.count("*").alias("n")).withColumn("place", place).orderBy("place")


def report(changes: DataFrame) -> str:
    """K9: counts by type and their total (A5)."""
    rows = counts(changes).collect()
    return "\n".join([*(f"{r['type']:<18}{r['n']:>8}" for r in rows), f"{'total':<18}{sum(r['n'] for r in rows):>8}"])


def compared_text(found: Compared, shown: int = 5) -> str:
    """A comparison's counts, how it was anchored, and the first of the anchors that several usages share."""
    out = [f"anchored by {found.anchor_kind}", report(found.changes)]
    if n := found.ambiguous.count():
        out.append(f"{n} ambiguous anchor(s): " + ", ".join(r["anchor"] for r in found.ambiguous.take(shown)))
    if found.changes.where(F.col("type").isin(*model.ADVISORY)).take(1):
        out.append(f"{', '.join(model.ADVISORY)}: inferred, to be reviewed")
    return "\n".join(out)


def catalogue_rows(checklists: DataFrame, releases: DataFrame) -> DataFrame:
    """Checklists by code with their releases by date and version, which may be none."""
    r = releases.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("released_on", "version", "usage_count", "status"))).alias("releases"))
    return checklists.select("code", "title", "id_stability").join(r, "code", "left").orderBy("code")


def catalogue(store: Store) -> DataFrame:
    return catalogue_rows(store.read("checklist"), store.read("release"))


def thread(store: Store, track_id: int) -> DataFrame:
    """The usages that one track joins, in the order of their releases."""
    members = store.read("usage_track").where(F.col("track_id") == track_id).select("code", "version", "usage_id")
    usages = store.read("usage").select("code", "version", "usage_id", "name_id", "status").join(members, ["code", "version", "usage_id"], "left_semi")
    dated = usages.join(store.read("release").select("code", "version", "seq", "released_on"), ["code", "version"])
    return dated.join(store.read("name").select("name_id", "scientific_name"), "name_id").orderBy("seq")


#: Ids that a read names to the files it reads, which skip what lies outside; more are joined.
NAMED = 4096


def _only(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``ids``, a table of that one column. Few ids are pushed down to the files."""
    few = [r[0] for r in ids.where(F.col(column).isNotNull()).distinct().limit(NAMED + 1).collect()]
    return df.where(F.col(column).isin(few)) if len(few) <= NAMED else df.join(ids.distinct(), column, "left_semi")


def traces(store: Store, names: DataFrame) -> DataFrame:
    """T5 for some names. Reads their usages, what the pointers of those lead to, and their siblings; other names' rows are skipped in the files."""
    every = store.read("name")
    own = _only(every, "name_id", names.select("name_id"))
    usages = _only(store.read("usage"), "name_id", own.select("name_id"))
    ids = usages.select("usage_id")
    targets = usages.select(F.explode(F.array("accepted_usage_id", "parent_usage_id")).alias("usage_id"))
    pointed = _only(store.read("usage").select("usage_id", "name_id"), "usage_id", targets)
    shown = timeline.displayed(_only(every, "name_id", pointed.select("name_id")), pointed)
    kin = timeline.siblings(_only(every, "canonical_key", own.select("canonical_key")), own)
    threads = _only(store.read("usage_track"), "usage_id", ids)
    threads = threads.join(_only(store.read("track").select("track_id", "anchor_kind"), "track_id", threads.select("track_id")), "track_id").select("usage_id", "anchor_kind")
    changes = _only(store.read("change"), "to_usage_id", ids.withColumnRenamed("usage_id", "to_usage_id"))
    return timeline.documents(own, usages, store.read("release"), store.read("checklist"), changes, threads, shown, kin)


def trace(store: Store, query: str, cutoff: float = 88.0) -> dict:
    """What a name resolves to and its recorded history, as a plain document."""
    found = resolving.resolve(store.read("name"), query, cutoff, index=store.index())
    scores = {r["name_id"]: r["score"] for r in found.names.select("name_id", "score").collect()}
    docs = timeline.trace_json(traces(store, store.spark.createDataFrame([(k,) for k in scores], "name_id long"))).collect() if scores else []
    return {"query": query, "tier": found.tier, "ambiguous": len(scores) > 1, "scores": {str(k): v for k, v in scores.items() if v is not None}, "traces": [json.loads(r["document"]) for r in docs]}


def check_ids(store: Store, code: str, before: str, after: str) -> DataFrame:
    """T8 between two releases."""
    store._release(code, before), store._release(code, after)
    return stability.id_stability(store.usages_of(code, [before, after]))


_ADVICE = {
    "none": "there are no identifiers to anchor on",
    "persistent": "identifiers survive as well as names, and tell renames, which names cannot",
    "unstable": "names survive better than identifiers, some of which are renumbered; compare both ways of anchoring first",
    "strong": "identifiers are renumbered; anchored on them, a comparison would make changes up",
}


def check_ids_text(store: Store, code: str, before: str, after: str) -> str:
    """T8 for readers: what survives, which stability that speaks for, and whether the checklist says so."""
    r = check_ids(store, code, before, after).first()
    share = lambda p: "-" if r[f"{p}_overlap"] is None else f"{r[f'{p}_overlap']:.1f}%"
    out = [f"{code}: {before} -> {after}"]
    for label, p, q in (("identifiers", "ids", "id"), ("names", "names", "name")):
        out.append(f"  {label:<14}{r[f'{p}_before']} -> {r[f'{p}_after']}, {r[f'{p}_shared']} shared, {share(q)}")
    out.append(f"  advice        {r['verdict']}: {_ADVICE['strong' if r['strong'] else r['verdict']]}")
    if (now := store._checklist(code)["id_stability"]) != r["verdict"]:
        out.append(f"  now           {now}; checklist set {code} --id-stability {r['verdict']} changes it")
    return "\n".join(out)


def trace_text(found: dict) -> str:
    """K9: a trace as it comes from ``trace``, for readers."""
    if found["tier"] == "none":
        return f"no name matches {found['query']}"
    out = [f"{len(found['traces'])} name(s), {found['tier']}" + (", ambiguous" if found["ambiguous"] else "")]
    for t in found["traces"]:
        score = found["scores"].get(str(t["name_id"]))
        out += ["", t["name"] + (f"  [{score}]" if score is not None else ""), f"  {t['rank'] or '-'}, in {len(t['checklists'] or [])} checklist(s)"]
        for c in t["checklists"] or []:
            out.append(f"  {c['checklist_code']}  {c['checklist_title']}  (by {c['anchor_kind'] or '-'})")
            for a in c["appearances"]:
                out.append(f"    {a['release_version']:<12}{a['released_on'] or '-':<12}{a['status']}" + (f" of {a['accepted_name']}" if a["accepted_name"] else ""))
                out += [f"      {'~' if x['advisory'] else '*'} {x['type']}" + (f" [{x['confidence']}]" if x["confidence"] else "") for x in a["changes"]]
        out += [f"  also: {k['scientific_name']} ({k['reason']})" for k in t["related"] or []]
    return "\n".join(out)


def releases_text(store: Store) -> str:
    out = []
    for row in catalogue(store).collect():
        out.append(f"{row['code']}  {row['title']}  ({row['id_stability']})")
        out += [f"  {r['version']}  {r['released_on'] or '-'}  {r['usage_count']}  {r['status']}" for r in row["releases"] or []]
    return "\n".join(out)


__all__ = ["catalogue", "catalogue_rows", "change_list", "check_ids", "check_ids_text", "compared_text", "counts", "iso_date", "releases_text", "report", "thread", "trace", "trace_text", "traces"]
