"""Queries over the derived release pair: matching, detectors, reports, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import describe_page, describe_report, round2
from ..operators import detect, match, similar, stability
from . import model
from .pair import CODE, index_sql, pair_sql, release_pair, tasks
from .staging import cut

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _index(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return match.winners(release_pair(spark, sf_dir), kind, tasks(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Paired winners, staged once: every detector reads them. So are winners, which meet themselves as targets of pointers and as both sides."""
    parts = tasks(spark, sf_dir)
    led = match.with_pointers(cut(_index(spark, sf_dir, kind)), parts)
    return cut(match.paired(led, parts=parts))


def _changes(spark: SparkSession, sf_dir: str, kind: str) -> dict[str, DataFrame]:
    return detect.all_changes(_pairs(spark, sf_dir, kind), kind, parts=tasks(spark, sf_dir))


SHOWN = ("type", "anchor_key", "from_usage_id", "to_usage_id")


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*SHOWN, detect.detail_json().alias("detail"))


@register("usage_name_join", f"WITH {pair_sql()} SELECT release, usage_id, source_taxon_id, status, rank, canonical_name, authorship, norm_key, canonical_key FROM pair")
def usage_name_join(spark, sf_dir):
    pair = release_pair(spark, sf_dir).withColumn("name_id", F.xxhash64("norm_key", "canonical_name", "authorship"))
    names = pair.select("name_id", F.col("canonical_name").alias("scientific_name"), "canonical_name", "authorship", "norm_key", "canonical_key").distinct()
    return match.usage_names(pair, names).select("release", "usage_id", "source_taxon_id", "status", "rank", "canonical_name", "authorship", "norm_key", "canonical_key")


for _kind in ("name", "source_id"):
    register(f"anchor_index_{_kind}", f"WITH {index_sql(_kind)} SELECT release, anchor, usage_id, status, bucket_rows, ord AS bucket_ord FROM idx")(
        lambda spark, sf_dir, kind=_kind: _index(spark, sf_dir, kind).select("release", "anchor", "usage_id", "status", "bucket_rows", "bucket_ord")
    )
    register(
        f"match_outer_{_kind}",
        f"WITH {index_sql(_kind)} SELECT coalesce(b.anchor, a.anchor) AS anchor, b.usage_id AS b_usage_id, a.usage_id AS a_usage_id, CASE WHEN a.anchor IS NULL THEN 'removed' WHEN b.anchor IS NULL THEN 'added' ELSE 'matched' END AS side FROM b FULL JOIN a ON a.anchor = b.anchor",
    )(lambda spark, sf_dir, kind=_kind: match.paired(_index(spark, sf_dir, kind)).select("anchor", "b_usage_id", "a_usage_id", "side"))


@register("ambiguous_anchors", f"WITH {pair_sql()} SELECT release, canonical_key AS anchor, count(*) AS bucket_rows FROM pair WHERE canonical_key <> '' GROUP BY ALL HAVING count(*) > 1")
def ambiguous_anchors(spark, sf_dir):
    return match.ambiguous(_index(spark, sf_dir, "name"))


@register("anchor_choice", f"WITH {pair_sql()} SELECT 'persistent' AS id_stability, CASE WHEN bool_or(coalesce(source_taxon_id, '') <> '') THEN 'source_id' ELSE 'name' END AS anchor_kind FROM pair UNION ALL SELECT 'unstable', 'name' UNION ALL SELECT 'none', 'name'")
def anchor_choice(spark, sf_dir):
    pair = release_pair(spark, sf_dir)
    return spark.createDataFrame([(s, match.choose_anchor(pair, s)) for s in model.ID_STABILITY], "id_stability string, anchor_kind string")


@register("track_threads", f"WITH {index_sql('name')} SELECT DISTINCT '{CODE}' AS code, 'name' AS anchor_kind, anchor AS anchor_key FROM idx")
def track_threads(spark, sf_dir):
    return match.tracks(_index(spark, sf_dir, "name"), CODE, "name").select("code", "anchor_kind", "anchor_key")


@register("track_memberships", f"WITH {index_sql('name')} SELECT release, usage_id, anchor AS anchor_key FROM idx")
def track_memberships(spark, sf_dir):
    index = _index(spark, sf_dir, "name")
    return match.memberships(index, CODE, "name").join(match.tracks(index, CODE, "name"), "track_id").select("release", "usage_id", "anchor_key")


def _json(**kv: str) -> str:
    return "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in kv.items()) + ") AS VARCHAR)"


def _matched(kind: str, where: str, detail: str) -> str:
    return f"SELECT '{kind}' AS type, anchor AS anchor_key, b_id AS from_usage_id, a_id AS to_usage_id, {detail} AS detail, ord AS o FROM m WHERE {where}"


def _detector_sql(kind: str) -> dict[str, str]:
    """DuckDB selects for each type, over the common tables of ``index_sql`` and ``extra_sql``."""
    set_level = "NULL::VARCHAR AS anchor_key, NULL::BIGINT AS from_usage_id, NULL::BIGINT AS to_usage_id"
    out = {
        "renamed": _matched("renamed", "b_key <> a_key", _json(from_name="b_name", to_name="a_name")),
        "author_changed": _matched("author_changed", "b_key = a_key AND b_norm <> a_norm", _json(name="a_name", from_author="b_auth", to_author="a_auth")),
        "status_changed": _matched("status_changed", "b_status <> a_status", _json(name="a_name", from_status="b_status", to_status="a_status")),
        "accepted_changed": _matched("accepted_changed", "b_acc_key IS DISTINCT FROM a_acc_key", _json(name="a_name", from_accepted="b_acc", to_accepted="a_acc")),
        "reclassified": _matched("reclassified", "b_par_key IS DISTINCT FROM a_par_key", _json(name="a_name", from_parent="b_par", to_parent="a_par")),
        "rank_changed": _matched("rank_changed", "nullif(b_rank, '') IS DISTINCT FROM nullif(a_rank, '')", _json(name="a_name", from_rank="b_rank", to_rank="a_rank")),
        "lumped": f"SELECT 'lumped' AS type, {set_level}, {_json(**{'into': 'into_name', 'sources': 'sources', 'sunk': 'sunk', 'count': 'n'})} AS detail, o FROM lumps",
        "split": f"SELECT 'split' AS type, {set_level}, {_json(**{'from': 'from_name', 'into': 'products', 'count': 'n'})} AS detail, o FROM splits",
        "added": f"SELECT 'added' AS type, anchor AS anchor_key, NULL::BIGINT AS from_usage_id, usage_id AS to_usage_id, {_json(name='canonical_name', status='status')} AS detail, ord AS o FROM fresh WHERE usage_id NOT IN (SELECT to_id FROM swapped)",
        "removed": f"SELECT 'removed' AS type, anchor AS anchor_key, usage_id AS from_usage_id, NULL::BIGINT AS to_usage_id, {_json(name='canonical_name', status='status')} AS detail, ord AS o FROM gone WHERE usage_id NOT IN (SELECT from_id FROM swapped)",
    }
    if kind == "source_id":
        out["id_replaced"] = f"SELECT 'id_replaced' AS type, anchor AS anchor_key, from_id AS from_usage_id, to_id AS to_usage_id, {_json(name='name', from_id='old_key', to_id='new_key')} AS detail, o FROM swapped"
    return out


def extra_sql(kind: str) -> str:
    swapped = (
        """swapped AS (SELECT g.usage_id AS from_id, f.usage_id AS to_id, f.anchor, g.source_taxon_id AS old_key, f.source_taxon_id AS new_key, f.canonical_name AS name, f.ord AS o
  FROM (SELECT * FROM gone QUALIFY row_number() OVER (PARTITION BY norm_key ORDER BY ord DESC) = 1) g
  JOIN (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY norm_key ORDER BY ord) = 1) f USING (norm_key))"""
        if kind == "source_id"
        else "swapped AS (SELECT 0::BIGINT AS from_id, 0::BIGINT AS to_id WHERE false)"
    )
    return f"""gone AS (SELECT * FROM b WHERE anchor NOT IN (SELECT anchor FROM a)),
fresh AS (SELECT * FROM a WHERE anchor NOT IN (SELECT anchor FROM b)),
{swapped},
sinks AS (SELECT ord, b_name, a_status, CASE WHEN a_status = 'accepted' THEN a_key ELSE a_acc_key END AS target, CASE WHEN a_status = 'accepted' THEN a_name ELSE a_acc END AS target_name FROM m WHERE b_status = 'accepted'),
lumps AS (SELECT target, arg_max(target_name, ord) AS into_name, list_sort(list(b_name)) AS sources, list_sort(list(b_name) FILTER (a_status <> 'accepted')) AS sunk, count(*) AS n, min(ord) AS o
  FROM sinks WHERE target IS NOT NULL GROUP BY target HAVING count(*) >= 2 AND count(*) FILTER (a_status <> 'accepted') >= 1),
members AS (SELECT b.*, CASE WHEN b.status = 'accepted' THEN b.usage_id WHEN EXISTS (SELECT 1 FROM b o WHERE o.usage_id = b.accepted_usage_id) THEN b.accepted_usage_id END AS owner FROM b),
splits AS (SELECT x.owner AS o, max(h.canonical_name) AS from_name, count(DISTINCT m.a_key) FILTER (m.a_status = 'accepted') AS n, list_sort(list(DISTINCT m.a_name) FILTER (m.a_status = 'accepted')) AS products
  FROM members x JOIN b h ON h.usage_id = x.owner LEFT JOIN m ON m.b_id = x.usage_id GROUP BY x.owner HAVING count(*) >= 2 AND count(DISTINCT m.a_key) FILTER (m.a_status = 'accepted') >= 2)"""


def change_sql(kind: str, *types: str) -> str:
    selects = _detector_sql(kind)
    return f"WITH {index_sql(kind)}, {extra_sql(kind)} SELECT type, anchor_key, from_usage_id, to_usage_id, detail FROM (" + " UNION ALL ".join(selects[t] for t in types or selects) + ")"


for _name, _kind, _type in (
    ("change_added", "name", "added"),
    ("change_removed", "name", "removed"),
    ("change_renamed", "source_id", "renamed"),
    ("change_author", "source_id", "author_changed"),
    ("change_status", "name", "status_changed"),
    ("change_rank", "name", "rank_changed"),
    ("change_accepted", "name", "accepted_changed"),
    ("change_reclassified", "name", "reclassified"),
    ("change_lumped", "name", "lumped"),
    ("change_split", "name", "split"),
    ("change_id_replaced", "source_id", "id_replaced"),
):
    # One detector each: renames are scored lazily, so the others do not pay for them.
    register(_name, change_sql(_kind, _type))(lambda spark, sf_dir, kind=_kind, t=_type: _shown(_one(spark, sf_dir, kind, t)))


def _one(spark: SparkSession, sf_dir: str, kind: str, t: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir, kind)
    if t in ("added", "removed"):
        replaced = detect.replaced_ids(pairs) if kind == "source_id" else None
        return detect.presence(*detect.unexplained(pairs, replaced))[t]
    if t in ("lumped", "split"):
        return {"lumped": detect.lumps, "split": detect.splits}[t](pairs, tasks(spark, sf_dir))
    if t == "id_replaced":
        return detect.replaced_ids(pairs)
    return detect.attribute_changes(pairs)[t]


def _rename_sql(select: str, cutoff: int = 88) -> str:
    """Letters of both keys are walked by a recursive query: one step for each letter of the added name."""
    return f"""WITH RECURSIVE {index_sql('name')}, {extra_sql('name')},
cand AS (SELECT g.canonical_key AS old_key, g.canonical_name AS old_name, f.canonical_key AS new_key, f.canonical_name AS new_name, g.usage_id AS old_id, f.usage_id AS new_id, f.ord AS new_ord, g.ord AS old_ord FROM gone g, fresh f
  WHERE g.canonical_key <> f.canonical_key AND 2 * least(length(g.canonical_key), length(f.canonical_key)) >= {cutoff / 100} * (length(g.canonical_key) + length(f.canonical_key))),
walk AS (SELECT old_key, new_key, 0 AS i, list_transform(range(0, length(old_key) + 1), lambda z: 0::BIGINT) AS p FROM cand
  UNION ALL SELECT old_key, new_key, i + 1, list_reduce(list_transform(range(1, length(old_key) + 1), lambda j: [CASE WHEN old_key[j] = new_key[i + 1] THEN p[j] + 1 ELSE p[j + 1] END]), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0::BIGINT])
  FROM walk WHERE i < length(new_key)),
scored AS (SELECT c.*, 200.0 * w.p[len(w.p)] / (length(c.old_key) + length(c.new_key)) AS raw FROM cand c JOIN walk w ON w.old_key = c.old_key AND w.new_key = c.new_key AND w.i = length(c.new_key))
{select}"""


def _scores(spark: SparkSession, sf_dir: str, cutoff: float) -> DataFrame:
    gone, new = detect.unexplained(_pairs(spark, sf_dir, "name"), None)
    old = gone.select(F.col("b_canonical_key").alias("old_key"))
    fresh = new.select(F.col("a_canonical_key").alias("new_key"))
    return similar.scored_candidates(old, fresh, cutoff).withColumn("score", round2("score"))


for _name, _cutoff in (("rename_candidate_scores", 88), ("rename_candidate_scores_60", 60)):
    register(_name, _rename_sql(f"SELECT old_key, new_key, CAST(round_even(raw, 2) AS DOUBLE) AS score FROM scored WHERE raw >= {_cutoff}", _cutoff))(
        lambda spark, sf_dir, cutoff=float(_cutoff): _scores(spark, sf_dir, cutoff)
    )


@register(
    "probable_renames",
    _rename_sql("SELECT new_key AS anchor_key, old_id AS from_usage_id, new_id AS to_usage_id, old_name AS from_name, new_name AS to_name, CAST(round_even(raw, 2) AS DOUBLE) AS confidence FROM scored WHERE raw >= 88 QUALIFY row_number() OVER (PARTITION BY new_key ORDER BY raw DESC, old_ord) = 1"),
)
def probable_renames(spark, sf_dir):
    found = detect.probable_renames(*detect.unexplained(_pairs(spark, sf_dir, "name"), None))
    return found.select("anchor_key", "from_usage_id", "to_usage_id", "from_name", "to_name", "confidence")


def _log(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir, kind)  # read by a dozen branches
    return detect.with_tracks(detect.union(detect.all_changes(pairs, kind, parts=tasks(spark, sf_dir))), pairs, CODE, kind)


_RENAMES = _rename_sql("").rpartition("\n")[0]


def _log_sql(kind: str, select: str) -> str:
    """All changes; under name anchoring with the probable renames, of which source_id has none."""
    if kind == "source_id":
        return f"WITH {index_sql(kind)}, {extra_sql(kind)}, log AS (" + " UNION ALL ".join(_detector_sql(kind).values()) + f") {select}"
    rename = f"SELECT 'probable_rename' AS type, new_key AS anchor_key, old_id AS from_usage_id, new_id AS to_usage_id, {_json(from_name='old_name', to_name='new_name', advisory='true')} AS detail, new_ord AS o FROM scored WHERE raw >= 88 QUALIFY row_number() OVER (PARTITION BY new_key ORDER BY raw DESC, old_ord) = 1"
    return _RENAMES + ", log AS (" + " UNION ALL ".join([*(f"({x})" for x in _detector_sql(kind).values()), f"({rename})"]) + f") {select}"


for _kind in ("name", "source_id"):
    register(f"change_log_{_kind}", _log_sql(_kind, "SELECT type, anchor_key, from_usage_id, to_usage_id, detail, type NOT IN ('lumped', 'split') AS on_track FROM log"))(
        lambda spark, sf_dir, kind=_kind: _log(spark, sf_dir, kind).select(*SHOWN, detect.detail_json().alias("detail"), F.col("track_id").isNotNull().alias("on_track"))
    )


@register("change_counts", _log_sql("name", "SELECT type, count(*) AS n FROM log GROUP BY type"))
def change_counts(spark, sf_dir):
    return _log(spark, sf_dir, "name").groupBy("type").agg(F.count("*").alias("n"))


@register("change_report", _log_sql("source_id", "SELECT type, count(*) AS n, (SELECT count(*) FROM log) AS total, CAST(list_position([" + ", ".join(f"'{t}'" for t in model.DISPLAY_ORDER) + "], type) AS BIGINT) AS place FROM log GROUP BY type"))
def change_report(spark, sf_dir):
    by = _log(spark, sf_dir, "source_id").groupBy("type").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, model.DISPLAY_ORDER)), F.col("type")).cast("long")
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).withColumn("place", place).orderBy("place")


def _fields() -> dict:
    return {f: F.col(f) for f in (*detect.TEXT_FIELDS, *detect.LIST_FIELDS)}


_X = "json_extract_string(detail, '$.{}')"


def _say(*keys: str) -> list[str]:
    return [f"coalesce({_X.format(k)}, 'None')" for k in keys]


def _list(key: str) -> str:
    return f"array_to_string(CAST(json_extract(detail, '$.{key}') AS VARCHAR[]), ', ')"


def _line_sql() -> str:
    named = lambda a, b, extra="": f"concat({_say('name')[0]}, ': {extra}', {_say(a)[0]}, ' -> ', {_say(b)[0]})"
    return f"""CASE type WHEN 'lumped' THEN concat({_list('sunk')}, ' -> ', {_say('into')[0]}) WHEN 'split' THEN concat({_say('from')[0]}, ' -> ', {_list('into')})
 WHEN 'accepted_changed' THEN {named('from_accepted', 'to_accepted')} WHEN 'status_changed' THEN {named('from_status', 'to_status')} WHEN 'reclassified' THEN {named('from_parent', 'to_parent', 'parent ')}
 WHEN 'rank_changed' THEN {named('from_rank', 'to_rank')} WHEN 'renamed' THEN concat({_say('from_name')[0]}, ' -> ', {_say('to_name')[0]}) WHEN 'author_changed' THEN {named('from_author', 'to_author')}
 WHEN 'id_replaced' THEN {named('from_id', 'to_id')} ELSE concat({_X.format('name')}, ' (', {_X.format('status')}, ')') END"""


def _phrase_sql() -> str:
    dash = lambda k: f"coalesce(nullif({_X.format(k)}, ''), '—')"
    two = lambda a, b, f=lambda k: _say(k)[0]: f"concat({f(a)}, ' → ', {f(b)})"
    return f"""CASE type WHEN 'lumped' THEN concat({_list('sunk')}, ' → ', {_say('into')[0]}) WHEN 'split' THEN concat({_say('from')[0]}, ' → ', {_list('into')})
 WHEN 'accepted_changed' THEN {two('from_accepted', 'to_accepted', dash)} WHEN 'status_changed' THEN {two('from_status', 'to_status')} WHEN 'reclassified' THEN concat('parent ', {two('from_parent', 'to_parent', dash)})
 WHEN 'rank_changed' THEN {two('from_rank', 'to_rank')} WHEN 'renamed' THEN {two('from_name', 'to_name')} WHEN 'author_changed' THEN {two('from_author', 'to_author', dash)}
 WHEN 'id_replaced' THEN {two('from_id', 'to_id')} ELSE '' END"""


_ORDER = "CASE type WHEN 'renamed' THEN 0 WHEN 'author_changed' THEN 0 WHEN 'status_changed' THEN 1 WHEN 'accepted_changed' THEN 2 WHEN 'reclassified' THEN 3 WHEN 'rank_changed' THEN 4 ELSE 5 END"
_PASS = "CASE type WHEN 'lumped' THEN 1 WHEN 'split' THEN 2 WHEN 'id_replaced' THEN 3 WHEN 'added' THEN 5 WHEN 'removed' THEN 6 ELSE 0 END"


@register("change_list_top", _log_sql("source_id", f"SELECT type, anchor_key, {_line_sql()} AS line FROM log ORDER BY {_PASS}, o, {_ORDER} LIMIT 50"))
def change_list_top(spark, sf_dir):
    """The first 50 in the order of emission; the limit is the feature."""
    return _log(spark, sf_dir, "source_id").orderBy("seq").limit(50).select("type", "anchor_key", describe_report(F.col("type"), _fields()).alias("line"))


@register("change_descriptions_api", _log_sql("source_id", f"SELECT type, from_usage_id, to_usage_id, {_phrase_sql()} AS phrase FROM log"))
def change_descriptions_api(spark, sf_dir):
    return _log(spark, sf_dir, "source_id").select("type", "from_usage_id", "to_usage_id", describe_page(F.col("type"), _fields()).alias("phrase"))


@register(
    "id_stability",
    f"""WITH {pair_sql()}, ids AS (SELECT source_taxon_id AS k, bool_or(release = 1) AS b, bool_or(release = 2) AS a FROM pair WHERE source_taxon_id IS NOT NULL GROUP BY 1),
names AS (SELECT canonical_key AS k, bool_or(release = 1) AS b, bool_or(release = 2) AS a FROM pair GROUP BY 1),
n AS (SELECT * FROM (SELECT count(*) FILTER (b) AS ids_before, count(*) FILTER (a) AS ids_after, count(*) FILTER (a AND b) AS ids_shared FROM ids),
  (SELECT count(*) FILTER (b) AS names_before, count(*) FILTER (a) AS names_after, count(*) FILTER (a AND b) AS names_shared FROM names)),
o AS (SELECT *, ids_shared / least(ids_before, ids_after) * 100 AS id_overlap, names_shared / least(names_before, names_after) * 100 AS name_overlap FROM n)
SELECT *, name_overlap - id_overlap AS gap, CASE WHEN name_overlap - id_overlap < 5 THEN 'persistent' ELSE 'unstable' END AS verdict, name_overlap - id_overlap >= 20 AS strong FROM o""",
)
def id_stability(spark, sf_dir):
    return stability.id_stability(release_pair(spark, sf_dir))
