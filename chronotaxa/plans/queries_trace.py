"""Queries on names' histories and on resolving names, over the derived release pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version_of
from ..operators import fulltext, resolve, timeline
from ..streaming.dropfolder import consecutive
from . import history, queries_diff
from .pair import CODE, canonical_sql, index_sql, pair_sql, release_pair
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


def _names(pair: DataFrame) -> DataFrame:
    """K1 in small: one name for each identity, spelt as in its first usage."""
    first = pair.groupBy("norm_key").agg(F.min_by(F.struct("canonical_name", "authorship", "rank", "canonical_key"), "usage_id").alias("n"), F.min("usage_id").alias("name_id"))
    return first.select("name_id", F.col("n.canonical_name").alias("scientific_name"), F.col("n.canonical_name").alias("canonical_name"), F.col("n.authorship").alias("authorship"), F.col("n.rank").alias("rank"), "norm_key", F.col("n.canonical_key").alias("canonical_key"))


_NAMES = f"WITH {pair_sql()}, names AS (SELECT norm_key, min(usage_id) AS name_id, arg_min(canonical_name, usage_id) AS scientific_name, arg_min(authorship, usage_id) AS authorship, arg_min(canonical_key, usage_id) AS canonical_key FROM pair GROUP BY norm_key)"
_SEEN = f"""{_NAMES}, rel AS (SELECT '1' AS version, DATE '2023-01-01' AS released_on UNION ALL SELECT '2', DATE '2024-01-01'),
u AS (SELECT p.*, n.name_id, n.scientific_name, CAST(p.release AS VARCHAR) AS version FROM pair p JOIN names n USING (norm_key)),
seen AS (SELECT u.*, r.released_on, a.scientific_name AS accepted_name, q.scientific_name AS parent_name,
  row_number() OVER (PARTITION BY u.name_id ORDER BY r.released_on NULLS FIRST, u.version, u.usage_id) AS place
  FROM u JOIN rel r USING (version) LEFT JOIN u a ON a.usage_id = u.accepted_usage_id LEFT JOIN u q ON q.usage_id = u.parent_usage_id)"""


def _tables(spark: SparkSession, sf_dir: str):
    pair = release_pair(spark, sf_dir)
    names = _names(pair)
    usages = pair.join(names.select("norm_key", "name_id"), "norm_key").select(
        F.lit(CODE).alias("code"), F.col("release").cast("string").alias("version"), "usage_id", "name_id", "status", "rank", F.create_map(F.lit("family"), "family").alias("classification"), "accepted_usage_id", "parent_usage_id"
    )
    releases = spark.createDataFrame([(CODE, "1", "2023-01-01"), (CODE, "2", "2024-01-01")], "code string, version string, d string").select("code", "version", F.to_date("d").alias("released_on"))
    return names, usages, releases


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queries_diff._log(spark, sf_dir, "source_id").withColumn("detail", queries_diff.detect.detail_json())
    return rows.select(F.lit(CODE).alias("code"), F.lit("2").alias("to_version"), "to_usage_id", "seq", "type", "detail", "confidence")


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_diff._index(spark, sf_dir, "source_id").select("usage_id", F.lit("source_id").alias("anchor_kind"))


@register("trace_timeline", f"{_SEEN} SELECT name_id, version, usage_id, status, accepted_name, parent_name, place FROM seen")
def trace_timeline(spark, sf_dir):
    return timeline.appearances(*_tables(spark, sf_dir)).select("name_id", "version", "usage_id", "status", "accepted_name", "parent_name", F.col("place").cast("long").alias("place"))


@register("trace_changes", queries_diff._log_sql("source_id", "SELECT to_usage_id, type, detail, false AS advisory FROM log WHERE to_usage_id IS NOT NULL"))
def trace_changes(spark, sf_dir):
    return timeline.landed_changes(_landed(spark, sf_dir)).select("to_usage_id", "type", "detail", "advisory")


_FIRST_LAST = f"""{_SEEN} SELECT name_id, arg_min(version, place) AS first_seen, arg_max(version, place) AS last_seen,
  CASE WHEN arg_min(coalesce(source_taxon_id, ''), place) <> '' THEN 'source_id' END AS anchor_kind, count(*) AS n_appearances, 1::BIGINT AS checklist_count FROM seen GROUP BY name_id"""


@register("trace_first_last", _FIRST_LAST)
def trace_first_last(spark, sf_dir):
    return timeline.first_last(timeline.appearances(*_tables(spark, sf_dir)), _threads(spark, sf_dir)).drop("code")


@register(
    "trace_document",
    queries_diff._log_sql("source_id", "SELECT 1")[: -len(" SELECT 1")]
    + f""", names AS (SELECT norm_key, min(usage_id) AS name_id, arg_min(canonical_name, usage_id) AS name FROM pair GROUP BY norm_key),
u AS (SELECT p.usage_id, p.release, p.status, n.name_id, n.name FROM pair p JOIN names n USING (norm_key)),
landed AS (SELECT to_usage_id, string_agg(type, '+' ORDER BY {queries_diff._PASS}, o, {queries_diff._ORDER}) AS types FROM log WHERE to_usage_id IS NOT NULL GROUP BY to_usage_id)
SELECT u.name_id, any_value(u.name) AS name, string_agg(concat(u.release, ':', u.status, ':', CASE WHEN release = 2 THEN coalesce(l.types, '') ELSE '' END), '|' ORDER BY u.release, u.usage_id) AS steps
FROM u LEFT JOIN landed l ON l.to_usage_id = u.usage_id GROUP BY u.name_id""",
)
def trace_document(spark, sf_dir):
    names, usages, releases = _tables(spark, sf_dir)
    lists = spark.createDataFrame([(CODE, "Demo", "persistent")], "code string, title string, id_stability string")
    docs = timeline.documents(names, usages, releases, lists, _landed(spark, sf_dir), _threads(spark, sf_dir))
    step = lambda a: F.concat(a["release_version"], F.lit(":"), a["status"], F.lit(":"), F.array_join(F.transform(a["changes"], lambda c: c["type"]), "+"))
    return docs.select("name_id", "name", F.array_join(F.transform(F.col("checklists")[0]["appearances"], step), "|").alias("steps"))


@register("name_siblings", f"{_NAMES} SELECT a.name_id, b.name_id AS sibling_id, b.scientific_name AS sibling_name, b.authorship AS sibling_authorship FROM names a JOIN names b ON a.canonical_key = b.canonical_key AND a.name_id <> b.name_id")
def name_siblings(spark, sf_dir):
    return timeline.siblings(_names(release_pair(spark, sf_dir))).drop("reason")


@register("resolve_exact", f"{_NAMES} SELECT p.usage_id, n.name_id FROM pair p JOIN names n USING (norm_key)")
def resolve_exact(spark, sf_dir):
    """P7, T1 for every usage at once: the query is its own name and author."""
    pair = release_pair(spark, sf_dir)
    return resolve.exact_each(_names(pair), pair.select(F.col("usage_id").alias("query_id"), "norm_key")).withColumnRenamed("query_id", "usage_id")


@register("resolve_canonical", f"{_NAMES} SELECT p.usage_id, n.name_id FROM pair p JOIN names n ON n.canonical_key = p.canonical_key AND p.canonical_key <> '' QUALIFY row_number() OVER (PARTITION BY p.usage_id ORDER BY n.name_id) <= 25")
def resolve_canonical(spark, sf_dir):
    """P8, O4, T2 for every usage; at most 25 names answer a query, which is the tier's limit."""
    pair = release_pair(spark, sf_dir)
    return resolve.canonical_each(_names(pair), pair.select(F.col("usage_id").alias("query_id"), "canonical_key")).withColumnRenamed("query_id", "usage_id")


# Every usage of release 1 asks for its name without its last letter but two. One in three joins its first words by a full stop, which
# makes them a phrase; one in three puts a sign alone before them, which asks for nothing.
_ASKED = """SELECT usage_id AS query_id, CASE role % 3 WHEN 0 THEN regexp_replace(t, ' ', '.') WHEN 1 THEN concat('× ', t) ELSE t END AS text
  FROM (SELECT usage_id, role, concat(substr(canonical_name, 1, length(canonical_name) - 3), right(canonical_name, 2)) AS t FROM pair WHERE release = 1)"""


def _words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower(strip_accents({text})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_LETTERS = "list_transform(range(97, 123), lambda c: length({0}) - length(replace({0}, chr(CAST(c AS INTEGER)), '')))"


@register(
    "resolve_fuzzy",
    f"""WITH RECURSIVE {pair_sql()}, names AS (SELECT norm_key, min(usage_id) AS name_id, arg_min(canonical_name, usage_id) AS canonical_name, arg_min(canonical_key, usage_id) AS canonical_key FROM pair GROUP BY norm_key),
docs AS (SELECT name_id, {_words_sql('canonical_name')} AS ws FROM names), facts AS (SELECT count(*) AS n_all, sum(len(ws)) / count(*) AS avg_len FROM docs),
words AS (SELECT name_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos, len(ws) AS len FROM docs),
asked AS ({_ASKED}), tokens AS (SELECT query_id, unnest(range(len(t))) AS i, unnest(t) AS token FROM (SELECT query_id, list_filter(string_split_regex(regexp_replace(text, '["*():^\\-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS t FROM asked)),
phrases AS (SELECT query_id, i, {_words_sql('token')} AS terms FROM tokens), wanted AS (SELECT DISTINCT terms FROM phrases WHERE len(terms) > 0),
each AS (SELECT terms, len(terms) AS k, unnest(range(len(terms))) AS j, unnest(terms) AS term FROM wanted),
met AS (SELECT terms, k, j, term, w FROM each JOIN (SELECT DISTINCT w FROM words) d ON CASE WHEN j = k - 1 THEN starts_with(w, term) ELSE w = term END),
starts AS (SELECT terms, name_id, len, pos - j AS start FROM met JOIN words USING (w) GROUP BY terms, k, name_id, len, pos - j HAVING count(*) = k),
hits AS (SELECT terms, name_id, len, count(*) AS tf FROM starts GROUP BY ALL), df AS (SELECT terms, count(*) AS n_with FROM hits GROUP BY ALL),
parts AS (SELECT terms, name_id, greatest(ln((n_all - n_with + 0.5) / (n_with + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)) AS s FROM hits JOIN df USING (terms), facts),
best AS (SELECT query_id, name_id FROM (SELECT query_id, name_id, sum(s) AS s FROM phrases JOIN parts USING (terms) GROUP BY query_id, name_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, name_id) <= 100),
keys AS (SELECT query_id, {canonical_sql('text')} AS a FROM asked), ka AS (SELECT query_id, a, {_LETTERS.format('a')} AS la FROM keys), kb AS (SELECT name_id, canonical_name, canonical_key AS b, {_LETTERS.format('canonical_key')} AS lb FROM names),
cand AS (SELECT query_id, name_id, canonical_name, a, b FROM best JOIN ka USING (query_id) JOIN kb USING (name_id)
  WHERE 2 * (list_sum(list_transform(list_zip(la, lb), lambda z: least(z[1], z[2]))) + least(length(a) - list_sum(la), length(b) - list_sum(lb))) >= 0.88 * (length(a) + length(b)) - 1e-9),
walk AS (SELECT a, b, 0 AS i, list_transform(range(0, length(a) + 1), lambda z: 0::BIGINT) AS p FROM (SELECT DISTINCT a, b FROM cand)
  UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(a) + 1), lambda j: [CASE WHEN a[j] = b[i + 1] THEN p[j] + 1 ELSE p[j + 1] END]), lambda acc, x: list_append(acc, greatest(acc[len(acc)], x[1])), [0::BIGINT]) FROM walk WHERE i < length(b)),
scored AS (SELECT query_id, name_id, canonical_name, 200.0 * p[len(p)] / (length(a) + length(b)) AS raw FROM cand JOIN walk USING (a, b) WHERE i = length(b))
SELECT query_id, name_id, canonical_name, CAST(round_even(raw, 2) AS DOUBLE) AS score FROM scored WHERE raw >= 88 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, canonical_name, name_id) <= 25""",
)
def resolve_fuzzy(spark, sf_dir):
    """Every usage of release 1 asks for a misspelt name, some in phrases; candidates are all names. Letters that cannot reach the cutoff are left out before the walk in SQL as well."""
    pair = cut(release_pair(spark, sf_dir).select("release", "usage_id", "role", "canonical_name", "authorship", "rank", "canonical_key", "norm_key"))
    wrong = F.concat(F.expr("substr(canonical_name, 1, length(canonical_name) - 3)"), F.expr("right(canonical_name, 2)"))
    text = F.when(F.col("role") % 3 == 0, F.regexp_replace("t", r"^([^ ]*) ", "$1.")).when(F.col("role") % 3 == 1, F.concat(F.lit("× "), F.col("t"))).otherwise(F.col("t"))
    asked = pair.where("release = 1").select(F.col("usage_id").alias("query_id"), "role", wrong.alias("t")).select("query_id", text.alias("text"))
    return resolve.fuzzy(cut(_names(pair)), asked)


@register("sibling_classes", f"{_NAMES} SELECT canonical_key, count(*) AS n_names, min(name_id) AS first_id FROM names WHERE canonical_key <> '' GROUP BY canonical_key HAVING count(*) > 1")
def sibling_classes(spark, sf_dir):
    """Homonyms, a row a class."""
    return timeline.sibling_classes(_names(release_pair(spark, sf_dir)))


_INDEX = f"{_NAMES}, docs AS (SELECT name_id, {_words_sql('scientific_name')} AS ws FROM names), words AS (SELECT name_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS len FROM docs)"


@register("fulltext_index", f"{_INDEX} SELECT word, name_id, len, string_agg(pos, ',' ORDER BY pos) AS positions FROM words GROUP BY word, name_id, len")
def fulltext_index(spark, sf_dir):
    """The postings of all names; half of them are taken in first and the rest added, and some are taken out and put back."""
    names = _names(release_pair(spark, sf_dir))
    half, rest, some = names.where("name_id % 2 = 0"), names.where("name_id % 2 = 1"), names.where("name_id % 3 = 0")
    parts = [(half, 1), (some, -1), (rest, 1), (some, 1)]
    index = fulltext.Index(reduce(DataFrame.unionByName, (fulltext.postings(n, sign) for n, sign in parts)), reduce(DataFrame.unionByName, (fulltext.facts(n, sign) for n, sign in parts)))
    rows = fulltext.net(index).postings
    return rows.select("word", "name_id", F.col("len").cast("long").alias("len"), F.array_join("positions", ",").alias("positions"))


@register(
    "fulltext_phrases",
    f"""{_INDEX}, asked AS (SELECT name_id AS query_id, CASE name_id % 2 WHEN 0 THEN [ws[1], ws[2][:3]] ELSE [ws[len(ws) - 1][:2]] END AS terms FROM docs WHERE len(ws) > 1), wanted AS (SELECT DISTINCT terms FROM asked),
each AS (SELECT terms, len(terms) AS k, unnest(range(len(terms))) AS j, unnest(terms) AS term FROM wanted),
met AS (SELECT terms, k, j, word FROM each JOIN (SELECT DISTINCT word FROM words) d ON CASE WHEN j = k - 1 THEN starts_with(word, term) ELSE word = term END),
starts AS (SELECT terms, name_id, len, pos - j AS start FROM met JOIN words USING (word) GROUP BY terms, k, name_id, len, pos - j HAVING count(*) = k)
SELECT array_to_string(terms, ' ') AS phrase, name_id, count(*) AS tf FROM starts GROUP BY terms, name_id""",
)
def fulltext_phrases(spark, sf_dir):
    """Names that hold the first word of some name followed by a word that begins like its second, or just a word's beginning."""
    names = cut(_names(release_pair(spark, sf_dir)))
    words = F.split("canonical_name", r"[^\p{L}\p{N}]+")
    phrase = F.when(F.col("name_id") % 2 == 0, F.concat(words[0], F.lit("."), F.left(words[1], F.lit(3)))).otherwise(F.left(F.element_at(words, -2), F.lit(2)))
    asked = names.where(F.size(words) > 1).select(F.col("name_id").alias("query_id"), phrase.alias("text"))
    found = fulltext.hits(fulltext.build(names), fulltext.phrases(asked))
    return found.select("phrase", "name_id", F.col("tf").cast("long").alias("tf"))


@register("checklist_catalogue", "SELECT r_name AS code, count(n_nationkey) AS n_releases, coalesce(string_agg(n_name, '|' ORDER BY n_name), '') AS releases FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def checklist_catalogue(spark, sf_dir):
    """Lists with their releases, which may be none."""
    region, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    lists = region.select(F.col("r_name").alias("code"), F.col("r_name").alias("title"), F.lit("unstable").alias("id_stability"))
    code = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("code"), "n_name", "n_nationkey")
    releases = code.select("code", F.lit(None).cast("date").alias("released_on"), F.col("n_name").alias("version"), F.col("n_nationkey").cast("long").alias("usage_count"), F.lit("ready").alias("status"))
    versions = F.coalesce(F.col("releases.version"), F.array().cast("array<string>"))
    return history.catalogue_rows(lists, releases).select("code", F.size(versions).cast("long").alias("n_releases"), F.array_join(versions, "|").alias("releases"))


@register(
    "release_pairs",
    "WITH d AS (SELECT DISTINCT event_type AS code, CAST(ts AS DATE) AS day FROM events) SELECT code, strftime(day, '%Y.%m.%d') AS before, strftime(lead(day) OVER (PARTITION BY code ORDER BY day), '%Y.%m.%d') AS after FROM d QUALIFY lead(day) OVER (PARTITION BY code ORDER BY day) IS NOT NULL",
)
def release_pairs(spark, sf_dir):
    """Consecutive releases of a list, versions being read from file names."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    files = events.select(F.col("event_type").alias("code"), F.concat(F.lit("names_"), F.date_format("ts", "yyyyMMdd"), F.lit(".csv")).alias("file")).distinct()
    version, day = version_of("file")
    return consecutive(files.withColumns({"version": version, "released_on": day})).drop("place")
