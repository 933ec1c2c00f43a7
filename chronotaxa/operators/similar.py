"""Similar names of the removed and the added, and their one-to-one assignment.

Candidates. Two names of lengths a and b reach the cutoff c if they differ by at most D = (1 - c)(a + b) insertions and deletions, which sets
bounds to both lengths. A deletion takes at most two pairs of neighbouring letters from a name, an insertion parts one, so a name keeps a
number of its pairs in any partner. Where that number is not below some g, names meet in sets of g pairs: of sets that share so many pairs,
the rarest pairs, but for those that may be lost and g more, share g. The higher g, the rarer such a set, and the fewer unlike names meet.
Names that may keep fewer pairs, all of them at low cutoffs, are scored against every name of fitting length, in tiles of two blocks of names. All
bounds hold at any cutoff, so no pair that reaches it is lost.

Assignment. Added names in their order take the best removed name that is left. A name whose best is wanted by no earlier one has it at once; what is
left falls into components, each of which is settled in one pass by one task. Components are found by pointers that double their reach, so
the number of jobs grows with the logarithm of the longest chain.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import indel, numbered, walked
from ..plans.staging import cut

_EPS = 1e-9


#: Pairs of letters in the sets that names meet in, at most, and the most sets that names may have on average. Sets grow with the names, unlike
#: names that meet in them with the names' square, so many sets of more pairs are the lesser work on large lists.
SET, SETS = 4, 1000
#: Names in a block of a tile: removed ones, walked one after another, and added ones, scored side by side.
WALKED, BESIDE = 1024, 4096
_TILES = 2048


def _bounds(cutoff: float) -> dict[str, str]:
    """SQL over ``n``, a name's length: the shortest and the longest partner, and how many pairs of neighbouring letters any partner leaves."""
    c = cutoff / 100
    shortest, longest = f"cast(ceil({c / (2 - c)} * n - {_EPS}) as int)", f"cast(floor({(2 - c) / c} * n + {_EPS}) as int)"
    differ = f"floor({1 - c} * (n + m) + {_EPS})"
    left = f"array_min(transform(sequence({shortest}, {longest}), m -> n - 1 - floor((3 * {differ} + n - m) / 2)))"
    return {"shortest": shortest, "longest": longest, "left": left}


def _rarest(names: DataFrame, most: int) -> DataFrame:
    """(id, side, n, left, codes): the pairs of letters of each name, rare ones first, as many as ``most`` of them may have to be met in."""
    pairs = numbered("transform(sequence(1, n - 1), i -> substr(key, i, 2))")
    each = names.select("id", "side", "n", "left", F.explode(F.expr(pairs)).alias("item"))
    counted = each.join(each.groupBy("item").agg(F.count("*").alias("held")), "item")
    lists = counted.groupBy("id", "side", "n", "left").agg(F.sort_array(F.collect_list(F.struct("held", "item"))).alias("items"))
    # The hash stands for a pair; two of one hash only make more candidates.
    return lists.select("id", "side", "n", "left", F.transform(F.slice("items", F.lit(1), (F.col("n") - 1 - F.col("left") + most).cast("int")), lambda x: F.xxhash64(x["item"])).alias("codes"))


_MET = pa.schema({"met": pa.int64(), "id": pa.int64(), "n": pa.int32()})
#: Names in a task that makes sets, or scores candidates: few rows become many.
_NAMES = 2000


def _sets(size: int):
    """Arrow function: each name's rarest pairs -> a row for each set of ``size`` of them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, n, left = (batch.column(k).to_numpy() for k in ("id", "n", "left"))
            lists = batch.column("codes")
            codes, starts = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            # Of several pairs, those that any partner leaves count, so the first so many hold a common set.
            many = np.minimum(np.diff(starts), n - 1 - left + size)
            for m in np.unique(many):
                if m not in places:
                    places[m] = np.array(list(itertools.combinations(range(m), size)), np.int64).reshape(-1, size)
                rows = np.flatnonzero(many == m)
                step = max(1, _SETS_AT_ONCE // max(1, len(places[m])))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    met = np.zeros((len(some), len(places[m])), np.uint64)
                    for k in range(size):
                        met = (met ^ codes[starts[some][:, None] + places[m][:, k]]) * _ODD
                        met ^= met >> np.uint64(29)
                    yield pa.RecordBatch.from_arrays([pa.array(met.ravel().view(np.int64)), pa.array(np.repeat(ids[some], met.shape[1])), pa.array(np.repeat(n[some], met.shape[1]).astype(np.int32))], schema=_MET)

    return sets


_ODD, _SETS_AT_ONCE = np.uint64(0x9E3779B97F4A7C15), 1 << 17


def _set_size(names: DataFrame) -> int:
    """How many pairs a set has: as many as leave ``SETS`` sets a name on average."""
    sets = lambda g: F.expr("1D * " + " * ".join(f"(n - 1 - left + {g} - {k}) / {k + 1}" for k in range(g)))
    r = names.agg(*(F.avg(F.when(F.col("left") >= g, sets(g))).alias(str(g)) for g in range(1, SET + 1))).first()
    return max([g for g in range(1, SET + 1) if r[str(g)] is not None and r[str(g)] <= SETS], default=1)


def _by_sets(names: DataFrame, size: int, cutoff: float) -> DataFrame:
    """(old_key, new_key, score) of names that share ``size`` of their rarest pairs."""
    parts = max(1, -(-names.count() // _NAMES))
    rare = cut(_rarest(names, size))
    met = lambda side: rare.where(F.col("side") == side).select("id", "n", "left", "codes").repartition(parts, "id").mapInArrow(_sets(size), "met long, id long, n int").repartition(parts, "met")
    mine = lambda side: met(side).select("met", F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"))
    differ = F.floor(F.lit(1 - cutoff / 100) * (F.col("old_n") + F.col("new_n")) + _EPS)
    near = mine("old").join(mine("new"), "met").where(F.abs(F.col("old_n") - F.col("new_n")) <= differ).select("old_id", "new_id").distinct()
    key = lambda side: names.where(F.col("side") == side).select(F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key"))
    return near.join(key("old"), "old_id").join(key("new"), "new_id").select("old_key", "new_key").where("old_key <> new_key").repartition(parts).withColumn("score", indel("old_key", "new_key")).where(F.col("score") >= cutoff)


_SCORED = pa.schema({"old_key": pa.string(), "new_key": pa.string(), "score": pa.float64()})


def _tile(cutoff: float):
    """Arrow function: rows of two blocks of names -> the pairs of both that reach the cutoff."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                old, new = batch.column("old")[row].as_py(), batch.column("new")[row].as_py()
                beside, total = pa.array(new, pa.string()), len(new[0])
                held: list[tuple[str, np.ndarray, np.ndarray]] = []
                for name, common in walked(sorted(old), new):
                    score = 200.0 * common / (total + len(name))
                    at = np.flatnonzero(score >= cutoff)
                    held.append((name, at, score[at]))
                    if sum(len(x[1]) for x in held) >= _PAIRS_AT_ONCE:
                        yield _pairs_of(held, beside)
                        held = []
                yield _pairs_of(held, beside)

    return scored


_PAIRS_AT_ONCE = 1 << 16


def _pairs_of(held: list[tuple[str, np.ndarray, np.ndarray]], beside: pa.Array) -> pa.RecordBatch:
    counts = [len(at) for _, at, _ in held]
    old = pa.array([name for name, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), counts)))
    new = beside.take(pa.array(np.concatenate([at for _, at, _ in held] or [np.empty(0, np.int64)])))
    batch = pa.RecordBatch.from_arrays([old, new, pa.array(np.concatenate([s for _, _, s in held] or [np.empty(0)]))], schema=_SCORED)
    return batch.filter(pc.not_equal(old, new))


def _blocks(names: DataFrame, side: str, most: int) -> DataFrame:
    """(old or new, its n): names of one length, at most about ``most`` of them, as one row."""
    mine = names.where(F.col("side") == side)
    parts = mine.groupBy("n").agg(F.ceil(F.count("*") / most).alias("parts"))
    each = mine.join(F.broadcast(parts), "n").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    return each.groupBy("n", "part").agg(F.collect_list("key").alias(side)).select(F.col("n").alias(f"{side}_n"), side)


def _by_tiles(old: DataFrame, new: DataFrame, cutoff: float) -> DataFrame:
    """(old_key, new_key, score) of all names of lengths that can be alike enough."""
    a, b = cut(_blocks(old, "old", WALKED)), cut(_blocks(new, "new", BESIDE))
    differ = F.floor(F.lit(1 - cutoff / 100) * (F.col("old_n") + F.col("new_n")) + _EPS)
    tiles = a.join(b, F.abs(F.col("old_n") - F.col("new_n")) <= differ)
    # Tiles are small rows and long work: each task takes few.
    return tiles.select("old", "new").repartition(max(1, min(_TILES, a.count() * b.count()))).mapInArrow(_tile(cutoff), "old_key string, new_key string, score double")


def scored_candidates(old: DataFrame, fresh: DataFrame, cutoff: float = 88.0) -> DataFrame:
    """(old_key, new_key, score) of different keys whose similarity reaches the cutoff, which is above 0."""
    if not 0 < cutoff <= 100:
        raise ValueError(f"a cutoff of {cutoff} is not above 0 and at most 100")
    b = _bounds(cutoff)
    keys = old.select(F.lit("old").alias("side"), F.col("old_key").alias("key")).union(fresh.select(F.lit("new"), "new_key")).where("key <> ''").distinct()
    names = cut(keys.withColumn("n", F.length("key")).withColumns({"left": F.expr(b["left"]), "id": F.monotonically_increasing_id()}))
    size = _set_size(names)
    sure, loose = names.where(F.col("left") >= size), names.where(F.col("left") < size)
    side = lambda df, s: df.where(F.col("side") == s)
    parts = []
    if not sure.isEmpty():
        parts.append(_by_sets(sure, size, cutoff))
    if not loose.isEmpty():
        parts += [_by_tiles(loose, names, cutoff), _by_tiles(sure, loose, cutoff)]
    return reduce(DataFrame.unionByName, parts) if parts else names.select(F.col("key").alias("old_key"), F.col("key").alias("new_key"), F.lit(0.0).alias("score")).limit(0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of ``edges`` (a, b): root is the smallest node of the component.

    In each round nodes take the smallest root around them, and then the root of that root until it is its own, so chains shrink by
    half at least.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    roots = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root")))
    while True:
        jumped = roots.join(roots.select(F.col("node").alias("root"), F.col("root").alias("further")), "root").select("node", "root", "further")
        offer = both.join(jumped.select(F.col("node").alias("b"), F.col("further").alias("offer")), "b").groupBy("a").agg(F.min("offer").alias("offer"))
        # What a node is offered, its root is offered too, so whole trees are hooked and not only their rims.
        seen = jumped.join(offer.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("further", "offer").alias("best"))
        hooked = seen.groupBy("root").agg(F.min("best").alias("hook"))
        moved = cut(seen.join(hooked, "root").select("node", F.least("best", "hook").alias("root"), F.col("root").alias("was")))
        roots = moved.select("node", "root")
        if moved.where("root <> was").isEmpty():
            return roots


_TAKEN = pa.schema({"new_ord": pa.int64(), "old_ord": pa.int64()})


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over candidates in the order of added names, best first within each; components may follow one another in a task."""
    taken: set[int] = set()
    component, done = None, None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for c, new, old in zip(*(batch.column(k).to_pylist() for k in ("component", "new_ord", "old_ord"))):
            if c != component:
                component, done, taken = c, None, set()
            if new != done and old not in taken:
                taken.add(old)
                out.append((new, old))
                done = new
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], schema=_TAKEN)


def _passed(left: DataFrame) -> DataFrame:
    """(new_ord, old_ord): components of candidates, each settled in one pass. Added names are odd nodes, removed ones even."""
    node = lambda c, odd: F.col(c) * 2 + odd
    of = components(left.select(node("new_ord", 1).alias("a"), node("old_ord", 0).alias("b")))
    placed = left.join(of.select(((F.col("node") - 1) / 2).cast("long").alias("new_ord"), F.col("root").alias("component"), F.col("node").alias("n")).where("n % 2 <> 0").drop("n"), "new_ord")
    rows = placed.select("component", "new_ord", "old_ord", (-F.col("score")).alias("worse")).repartition("component")
    return rows.sortWithinPartitions("component", "new_ord", "worse", "old_ord").drop("worse").mapInArrow(_settled, "new_ord long, old_ord long")


def assign(scored: DataFrame, old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Each added name, in order, takes the best removed name that is left; ties go to the earliest.

    Added names that share a place, as those of several keys may, are settled like one name with all their candidates. A pool that
    is empty for an added name ends the process there (Q6): that is the case after as many assignments as there are removed names, or if the only
    one left is of the same key.
    """
    all_ = cut(scored.join(old, "old_key").join(fresh, "new_key").select("old_key", "old_ord", "old", "new_key", "new_ord", "new", "score"))
    best = all_.groupBy("new_ord").agg(F.max_by("old_ord", F.struct("score", -F.col("old_ord"))).alias("old_ord"))
    first = all_.groupBy("old_ord").agg(F.min("new_ord").alias("new_ord"))
    at_once = cut(best.join(first, ["new_ord", "old_ord"]).select("new_ord", "old_ord"))
    left = cut(all_.select("new_ord", "old_ord", "score").join(at_once.select("new_ord"), "new_ord", "left_anti").join(at_once.select("old_ord"), "old_ord", "left_anti"))
    taken = at_once if left.isEmpty() else cut(at_once.unionByName(_passed(left)))
    done = cut(all_.join(taken, ["new_ord", "old_ord"]).select(all_.columns))
    if done.isEmpty():
        return done
    return _until_empty(done, old, fresh)


def _until_empty(done: DataFrame, old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drops what comes after the first added name whose pool is empty (Q6).

    Before the last assignment but one the pool holds two names, one of which differs from any key. So
    only two points matter: after all names are taken, and where a single name is left that equals an added key.
    """
    n_old, n_done = old.count(), done.count()
    if n_done < n_old - 1:
        return done
    latest = [r["new_ord"] for r in done.orderBy(F.desc("new_ord")).select("new_ord").limit(2).collect()]
    stop = latest[0] if n_done == n_old else None
    after = latest[0] if n_done == n_old - 1 else (latest[1] if len(latest) > 1 else -1)
    last = old.join(done.where(F.col("new_ord") <= after).select("old_key"), "old_key", "left_anti").select("old_key").first()
    own = fresh.where((F.col("new_key") == last["old_key"]) & (F.col("new_ord") > after)).agg(F.min("new_ord").alias("m")).first()["m"]
    if own is not None and (stop is None or own <= stop):
        return done.where(F.col("new_ord") < own)
    return done
