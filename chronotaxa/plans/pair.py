"""A pair of releases derived from the ``part`` table, in which every kind of change occurs.

``p_partkey % 40`` is a record's role. The expressions are SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .staging import cut

CODE = "demo"
ID_BASE = 1 << 40

_E = "translate(substr(md5(cast({k} as string)), 1, 12), '0123456789abcdef', 'abcdefghijklmnop')"
_OWN, _NEXT = _E.format(k="p_partkey"), _E.format(k="(p_partkey + 1)")


def _id(release: int, key: str) -> str:
    return f"cast({release * ID_BASE} + {key} as bigint)"


def columns(release: int) -> dict[str, str]:
    """SQL expressions over ``part`` with ``role`` added."""
    own = f"concat({_OWN}, right({_OWN}, 1))" if release == 2 else _OWN
    hybrid = "×" if release == 2 else "x"
    hub, four, fifteen = (_id(release, f"(p_partkey - role{n})") for n in ("", " + 4", " + 15"))
    synonyms = "1, 5, 6, 7, 15, 20" if release == 1 else "1, 2, 3, 7, 15, 20"
    to_hub = "1, 7, 15" if release == 1 else "1, 2, 3, 15, 20"
    to_four = "5, 6" if release == 1 else "7"
    return {
        "release": str(release),
        "usage_id": _id(release, "p_partkey"),
        "role": "role",
        "source_taxon_id": f"case when role = 17 then null when role = 12 then concat('{'PR'[release - 1]}', cast(p_partkey as string)) else concat('P', cast(p_partkey as string)) end",
        "canonical_name": f"case when role = 15 then concat('twin ', {_NEXT}) when role = 16 then concat('twin ', {_OWN}) when role = 19 then concat(p_name, ' {hybrid} ', {_OWN}) when role = 9 then concat(p_name, ' ', {own}) else concat(p_name, ' ', {_OWN}) end",
        "authorship": f"case when role = 8 then concat(p_brand, '{' Alt' if release == 2 else ''}') when role = 18 then concat(p_brand, '{' and Co.' if release == 2 else ' & Co'}') else p_brand end",
        "status": f"case when role in ({synonyms}) then 'synonym' else 'accepted' end",
        "rank": f"case when role = 14 then '{'subspecies' if release == 2 else 'species'}' when role = 21 then {'null' if release == 2 else chr(39) * 2} else 'species' end",
        "family": "p_type",
        "accepted_usage_id": f"case when role in ({to_hub}) then {hub} when role in ({to_four}) then {four}" + (f" when role = 20 then {fifteen}" if release == 1 else "") + " end",
        "parent_usage_id": f"case when role = 13 then {hub if release == 1 else four} end",
    }


def absent(release: int) -> int:
    return 11 if release == 1 else 10


#: Rows of ``part`` in a task that derives names from them; a file of many rows is small and would be read by one task.
ROWS = 25_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many partitions the pair is worked on in, which grows with its rows."""
    return max(1, -(-spark.read.parquet(f"{sf_dir}/part.parquet").count() // ROWS))


def raw_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", (F.col("p_partkey") % 40).alias("role"))
    # Staged, or filters on what is derived would be worked out below the exchange, by the few tasks that read the file.
    part = cut(part.repartition(tasks(spark, sf_dir)))
    both = [part.where(F.col("role") != absent(r)).selectExpr(*(f"{sql} as {name}" for name, sql in columns(r).items())) for r in (1, 2)]
    return both[0].unionByName(both[1])


def release_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both releases with their keys."""
    raw = raw_pair(spark, sf_dir)
    return raw.withColumns({"canonical_key": text.canonical_key("canonical_name"), "norm_key": text.norm_key("canonical_name", "authorship")})


# The same in DuckDB, with the keys' rules written for its regular expressions.
_CANON = "lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(trim(nfc_normalize({c})), '✕⨯', '××'), '(^|[^a-z])[xX](\\s)', '\\1×\\2', 'g'), '(^|[^a-z])[xX](\\s)', '\\1×\\2', 'g'), '×\\s*', '× ', 'g'), '\\s+', ' ', 'g')))"
_AUTH = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(lower(trim(nfc_normalize(coalesce({c}, '')))), ' and ', ' & '), ' et ', ' & '), '.', ' '), '\\s*&\\s*', ' & ', 'g'), '\\s*,\\s*', ' ', 'g'), '\\(\\s*', '(', 'g'), '\\s*\\)', ')', 'g'), '\\s+', ' ', 'g'))"


def canonical_sql(c: str) -> str:
    return _CANON.format(c=c)


def authorship_sql(c: str) -> str:
    return _AUTH.format(c=c)


def pair_sql() -> str:
    """DuckDB: common table expressions ``raw`` and ``pair``."""
    side = lambda r: "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns(r).items()) + f" FROM (SELECT *, p_partkey % 40 AS role FROM part) WHERE role <> {absent(r)}"
    return f"""raw AS ({side(1)} UNION ALL {side(2)}),
pair AS (SELECT *, {canonical_sql('canonical_name')} AS canonical_key, concat({canonical_sql('canonical_name')}, '|', {authorship_sql('authorship')}) AS norm_key FROM raw)"""


def index_sql(kind: str) -> str:
    """DuckDB: ``idx`` (winners with bucket facts), ``b``, ``a`` (releases, with pointer targets) and ``m`` (matched)."""
    anchor = "source_taxon_id" if kind == "source_id" else "canonical_key"
    return f"""{pair_sql()},
keyed AS (SELECT *, {anchor} AS anchor FROM pair WHERE coalesce({anchor}, '') <> ''),
idx AS (SELECT *, count(*) OVER (PARTITION BY release, anchor) AS bucket_rows, min(usage_id) OVER (PARTITION BY release, anchor) AS ord
        FROM keyed QUALIFY row_number() OVER (PARTITION BY release, anchor ORDER BY CASE status WHEN 'accepted' THEN 0 ELSE 1 END, usage_id) = 1),
led AS (SELECT i.*, x.canonical_key AS acc_key, x.canonical_name AS acc_name, p.canonical_key AS par_key, p.canonical_name AS par_name
        FROM idx i LEFT JOIN idx x ON x.release = i.release AND x.usage_id = i.accepted_usage_id
        LEFT JOIN idx p ON p.release = i.release AND p.usage_id = i.parent_usage_id),
b AS (SELECT * FROM led WHERE release = 1),
a AS (SELECT * FROM led WHERE release = 2),
m AS (SELECT b.anchor, b.usage_id AS b_id, a.usage_id AS a_id, b.ord AS ord, b.status AS b_status, a.status AS a_status, b.canonical_name AS b_name, a.canonical_name AS a_name,
        b.canonical_key AS b_key, a.canonical_key AS a_key, b.norm_key AS b_norm, a.norm_key AS a_norm, b.authorship AS b_auth, a.authorship AS a_auth, b.rank AS b_rank, a.rank AS a_rank,
        b.acc_key AS b_acc_key, b.acc_name AS b_acc, a.acc_key AS a_acc_key, a.acc_name AS a_acc, b.par_key AS b_par_key, b.par_name AS b_par, a.par_key AS a_par_key, a.par_name AS a_par
      FROM b JOIN a USING (anchor))"""
