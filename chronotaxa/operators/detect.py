"""The twelve change detectors (D1-D12) over paired winners, and their union.

A change has type, anchor_key, from_usage_id, to_usage_id, a sparse set of detail columns and a sortable ``seq``
that reproduces the order of emission without a global sort: pass, bucket order, place in the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round2
from .match import join_known, laid, track_id
from .similar import assign, scored_candidates

TEXT_FIELDS = ("name", "status", "from_name", "to_name", "from_author", "to_author", "from_status", "to_status", "from_accepted", "to_accepted", "from_parent", "to_parent", "from_rank", "to_rank", "from_id", "to_id", "into_name")
LIST_FIELDS = ("sources", "sunk", "into")
_SHAPE = {
    **dict.fromkeys(("added", "removed"), ("name", "status")),
    "renamed": ("from_name", "to_name"),
    "author_changed": ("name", "from_author", "to_author"),
    "status_changed": ("name", "from_status", "to_status"),
    "accepted_changed": ("name", "from_accepted", "to_accepted"),
    "reclassified": ("name", "from_parent", "to_parent"),
    "rank_changed": ("name", "from_rank", "to_rank"),
    "lumped": (("into", "into_name"), "sources", "sunk", "count"),
    "split": (("from", "from_name"), "into", "count"),
    "id_replaced": ("name", "from_id", "to_id"),
    "probable_rename": ("from_name", "to_name", "advisory"),
}
_PASS = {"matched": 0, "lumped": 1, "split": 2, "id_replaced": 3, "probable_rename": 4, "added": 5, "removed": 6}


def seq(stage: str, order: Column | str, place: int = 0) -> Column:
    return ((F.lit(_PASS[stage]).cast("long") * F.lit(1 << 44) + order) * 8 + place).alias("seq") if not isinstance(order, str) else seq(stage, F.col(order), place)


def change(df: DataFrame, kind: str, sequence: Column, earlier: Column | None, later: Column | None, anchor: Column | None = None, confidence: Column | None = None, **fields: Column) -> DataFrame:
    """Rows in the common shape; fields a kind does not have are null."""
    null = lambda t: F.lit(None).cast(t)
    columns = [sequence, F.lit(kind).alias("type"), (anchor if anchor is not None else null("string")).alias("anchor_key"), (earlier if earlier is not None else null("long")).alias("from_usage_id"), (later if later is not None else null("long")).alias("to_usage_id")]
    columns += [fields.get(f, null("string")).alias(f) for f in TEXT_FIELDS] + [fields.get(f, null("array<string>")).alias(f) for f in LIST_FIELDS]
    columns += [fields.get("count", null("long")).cast("long").alias("count"), fields.get("advisory", null("boolean")).alias("advisory"), (confidence if confidence is not None else null("double")).alias("confidence")]
    return df.select(*columns)


def detail_json(kind: Column | str = "type") -> Column:
    """The detail document of a change; explicit nulls are kept."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    out = F.lit(None).cast("string")
    for name, keys in _SHAPE.items():
        pairs = [(k, k) if isinstance(k, str) else k for k in keys]
        out = F.when(kind == name, F.to_json(F.struct(*(F.col(c).alias(k) for k, c in pairs)), {"ignoreNullFields": "false"})).otherwise(out)
    return out


def _c(name: str) -> Column:
    return F.col(name)


def attribute_changes(pairs: DataFrame) -> dict[str, DataFrame]:
    """D3-D8 on matched pairs; comparisons take nulls as values."""
    m = pairs.where("side = 'matched'")
    same_name = _c("b_canonical_key") == _c("a_canonical_key")
    differs = lambda a, b: ~a.eqNullSafe(b)
    rank = lambda p: F.nullif(_c(f"{p}_rank"), F.lit(""))
    make = lambda where, kind, place, **f: change(m.where(where), kind, seq("matched", "b_bucket_ord", place), _c("b_usage_id"), _c("a_usage_id"), _c("anchor"), **f)
    name = _c("a_canonical_name")
    return {
        "renamed": make(~same_name, "renamed", 0, from_name=_c("b_canonical_name"), to_name=name),
        "author_changed": make(same_name & (_c("b_norm_key") != _c("a_norm_key")), "author_changed", 0, name=name, from_author=_c("b_authorship"), to_author=_c("a_authorship")),
        "status_changed": make(_c("b_status") != _c("a_status"), "status_changed", 1, name=name, from_status=_c("b_status"), to_status=_c("a_status")),
        "accepted_changed": make(differs(_c("b_accepted_t_key"), _c("a_accepted_t_key")), "accepted_changed", 2, name=name, from_accepted=_c("b_accepted_t_name"), to_accepted=_c("a_accepted_t_name")),
        "reclassified": make(differs(_c("b_parent_t_key"), _c("a_parent_t_key")), "reclassified", 3, name=name, from_parent=_c("b_parent_t_name"), to_parent=_c("a_parent_t_name")),
        "rank_changed": make(differs(rank("b"), rank("a")), "rank_changed", 4, name=name, from_rank=_c("b_rank"), to_rank=_c("a_rank")),
    }


def lumps(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """Formerly accepted records that now end in one accepted name, at least one of them sunk (Q4, Q5); grouped in ``parts`` partitions, where given."""
    m = pairs.where("side = 'matched' and b_status = 'accepted'")
    now = _c("a_status") == "accepted"
    m = m.select("b_bucket_ord", _c("b_canonical_name").alias("member"), now.alias("stays"), F.when(now, _c("a_canonical_key")).otherwise(_c("a_accepted_t_key")).alias("target"), F.when(now, _c("a_canonical_name")).otherwise(_c("a_accepted_t_name")).alias("target_name"))
    groups = laid(m.where("target is not null"), parts, "target").groupBy("target").agg(
        F.min("b_bucket_ord").alias("ord"),
        F.max_by("target_name", "b_bucket_ord").alias("target_name"),
        F.sort_array(F.collect_list("member")).alias("sources"),
        F.sort_array(F.collect_list(F.when(~_c("stays"), _c("member")))).alias("sunk"),
        F.count("*").alias("n"),
    )
    return change(groups.where("n >= 2 and size(sunk) >= 1"), "lumped", seq("lumped", "ord"), None, None, into_name=_c("target_name"), sources=_c("sources"), sunk=_c("sunk"), count=_c("n"))


def splits(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """A former circumscription (an accepted record and its synonyms) whose members are now several accepted names; ``parts`` as in ``lumps``."""
    m = pairs.where("b_usage_id is not null")
    owner = F.when(_c("b_status") == "accepted", _c("b_usage_id")).otherwise(F.when(_c("b_accepted_t_key").isNotNull(), _c("b_accepted_usage_id")))
    product = (_c("side") == "matched") & (_c("a_status") == "accepted")
    m = m.select(owner.alias("owner"), "b_usage_id", "b_canonical_name", F.when(product, F.struct(_c("a_canonical_key").alias("key"), _c("a_canonical_name").alias("name"))).alias("product"))
    groups = laid(m.where("owner is not null"), parts, "owner").groupBy("owner").agg(
        F.max(F.when(_c("b_usage_id") == _c("owner"), _c("b_canonical_name"))).alias("from_name"), F.collect_set("product.key").alias("keys"), F.collect_set("product").alias("products"), F.count("*").alias("n")
    )
    groups = groups.where("n >= 2 and size(keys) >= 2")
    names = F.expr("sort_array(transform(keys, k -> array_max(transform(filter(products, p -> p.key = k), p -> p.name))))")
    return change(groups, "split", seq("split", "owner"), None, None, from_name=_c("from_name"), into=names, count=F.size("keys"))


def replaced_ids(pairs: DataFrame) -> DataFrame:
    """Removed and added records of one identity; the last removed meets the first added."""
    gone = pairs.where("side = 'removed'").groupBy(_c("b_norm_key").alias("key")).agg(F.max_by(F.struct("b_usage_id", "b_source_taxon_id"), "b_bucket_ord").alias("b"))
    new = pairs.where("side = 'added'").groupBy(_c("a_norm_key").alias("key")).agg(F.min_by(F.struct("a_usage_id", "a_source_taxon_id", "a_canonical_name", "anchor", "a_bucket_ord"), "a_bucket_ord").alias("a"))
    both = gone.join(new, "key")
    return change(both, "id_replaced", seq("id_replaced", "a.a_bucket_ord"), _c("b.b_usage_id"), _c("a.a_usage_id"), _c("a.anchor"), name=_c("a.a_canonical_name"), from_id=_c("b.b_source_taxon_id"), to_id=_c("a.a_source_taxon_id"))


def unexplained(pairs: DataFrame, replaced: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Removed and added records that no replaced identifier accounts for."""
    gone, new = pairs.where("side = 'removed'"), pairs.where("side = 'added'")
    if replaced is not None:
        gone = gone.join(replaced.select(_c("from_usage_id").alias("b_usage_id")), "b_usage_id", "left_anti")
        new = new.join(replaced.select(_c("to_usage_id").alias("a_usage_id")), "a_usage_id", "left_anti")
    return gone, new


def probable_renames(gone: DataFrame, new: DataFrame, cutoff: float = 88.0) -> DataFrame:
    """Removed and added names alike enough, assigned one to one in the order of the added ones."""
    old = gone.groupBy(_c("b_canonical_key").alias("old_key")).agg(F.min("b_bucket_ord").alias("old_ord"), F.max_by(F.struct(_c("b_usage_id").alias("id"), _c("b_canonical_name").alias("name")), "b_bucket_ord").alias("old"))
    fresh = new.select(_c("a_canonical_key").alias("new_key"), _c("a_bucket_ord").alias("new_ord"), F.struct(_c("a_usage_id").alias("id"), _c("a_canonical_name").alias("name"), _c("a_canonical_key").alias("key")).alias("new"))
    found = assign(scored_candidates(old, fresh, cutoff), old, fresh)
    return change(found, "probable_rename", seq("probable_rename", "new_ord"), _c("old.id"), _c("new.id"), _c("new.key"), round2("score"), from_name=_c("old.name"), to_name=_c("new.name"), advisory=F.lit(True))


def presence(gone: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """D1, D2."""
    return {
        "added": change(new, "added", seq("added", "a_bucket_ord"), None, _c("a_usage_id"), _c("anchor"), name=_c("a_canonical_name"), status=_c("a_status")),
        "removed": change(gone, "removed", seq("removed", "b_bucket_ord"), _c("b_usage_id"), None, _c("anchor"), name=_c("b_canonical_name"), status=_c("b_status")),
    }


def all_changes(pairs: DataFrame, kind: str, cutoff: float = 88.0, parts: int | None = None) -> dict[str, DataFrame]:
    """Every detector's rows by type."""
    out = attribute_changes(pairs) | {"lumped": lumps(pairs, parts), "split": splits(pairs, parts)}
    replaced = None
    if kind == "source_id":
        out["id_replaced"] = replaced = replaced_ids(pairs)
    gone, new = unexplained(pairs, replaced)
    out["probable_rename"] = probable_renames(gone, new, cutoff)
    return out | presence(gone, new)


def union(changes: dict[str, DataFrame]) -> DataFrame:
    """X1."""
    first, *rest = changes.values()
    for df in rest:
        first = first.unionByName(df)
    return first


def with_tracks(changes: DataFrame, pairs: DataFrame, code: str, kind: str) -> DataFrame:
    """The thread by anchor key, else by the later usage, else by the earlier; none for lumps and splits."""
    by_anchor = pairs.select(_c("anchor").alias("anchor_key"), track_id(F.lit(code), F.lit(kind), _c("anchor")).alias("t_anchor"))
    usage = lambda p, to: pairs.where(f"{p}_usage_id is not null").select(_c(f"{p}_usage_id").alias(to), track_id(F.lit(code), F.lit(kind), _c("anchor")).alias(f"t_{p}"))
    out = join_known(changes, by_anchor, "anchor_key", "seq")
    out = join_known(join_known(out, usage("a", "to_usage_id"), "to_usage_id", "seq"), usage("b", "from_usage_id"), "from_usage_id", "seq")
    return out.withColumn("track_id", F.coalesce("t_anchor", "t_a", "t_b")).drop("t_anchor", "t_a", "t_b")
