"""Operator 5: n-gram Jaccard self-join as a blocked sparse matrix product.

Rows of the incidence matrix are distinct sets of word n-grams (equal sets are one row, so copies never
meet); columns are n-grams. Only the columns in which a qualifying pair must meet are kept: with the
n-grams of all rows in one order, rare before frequent, each row keeps its first n - ceil(t n) + 1. A column is a
block. Entries of the product are pairs, and those whose sizes or positions cannot reach the overlap
that the threshold asks for are discarded.

Blocks are never expanded into all pairs:

1. Every block multiplies one of its rows, its hub, with all others; the hub is chosen by one of four hashes. Sketches discard pairs that differ too
   much before whole rows are fetched. Overlaps are accumulated by the masked product: pairs are dealt to tasks by the
   row that is no hub, so a hub's pairs spread over all of them, and a task multiplies the rows of its pairs. The links found give components.
2. Only products between different components are still of interest. Blocks of at most ``small`` rows list those
   pairs once, and the masked product decides them; larger ones are cut into tiles of at most about ``tile`` rows by their counted size. For each pair of tiles, rows without a partner by size, position and
   sketch go; the rest are multiplied in one task that accumulates overlaps in numpy and returns no more links than
   join its components.

The order of n-grams affects only the work: frequent ones are found by counting the n-grams of one distinct set in ``part``, chosen by the set's
hash, wherever its copies lie; the ``heavy`` most frequent are broadcast (at most 16 bytes each). Columns expected to hold more than ``tile`` rows
are salted over several tasks. Results are exact: overlaps are counted on whole sets of 64-bit n-gram hashes.

Defined results: a null text or one without words has an empty set (n_shingles 0) and is its own component;
repeated rows with one doc_id all appear; a row without doc_id appears with its class's component, null if no row of it
has an id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit
from .components import connected_components
from .shared import Stage, arrow_pass


BROADCAST_IDS = 250_000


def set_rows(column, width: int):
    """(row, sorted distinct n-gram hashes) for each row with words."""
    for a, b, word, first in textkit.word_rows(column):
        grams, at = textkit.shingles(word, first, width)
        for i in range(b - a):
            if at[i + 1] > at[i]:
                yield a + i, np.unique(grams[at[i] : at[i + 1]])


def _set_id(s: np.ndarray, seed: int) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


#: Longs of the smallest parity sketch.
_SKETCH = 16


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """For each bucket of hashes, the parity of the number of n-grams in it: bits that differ bound what two sets don't share.

    A power of two of buckets, four for each n-gram at least. Of half as many, the sketch is the two halves' exclusive or.
    """
    buckets = max(64 * _SKETCH, 1 << (4 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fold(sketch: np.ndarray, longs: int) -> np.ndarray:
    while sketch.shape[-1] > longs:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _signatures(docs: DataFrame, width: int, seed: int, part: int, flush: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, n, sid, check, sketch), and rows (token, hits): n-grams of one distinct set in ``part``, once for each task that holds it."""

    def run(batches):
        seen, held, size = set(), [], 0

        def counts():
            token, hits = np.unique(np.concatenate(held), return_counts=True)
            k = len(token)
            return {"doc_id": [None] * k, "n": [None] * k, "sid": [None] * k, "check": [None] * k, "sketch": [None] * k, "token": token.view(np.int64), "hits": hits}

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n, sid, check, sketch = [0] * len(ids), [None] * len(ids), [None] * len(ids), [None] * len(ids)
            for i, s in set_rows(batch.column("text"), width):
                n[i], (sid[i], check[i]), sketch[i] = len(s), _set_id(s, seed), parity_sketch(s)
                if sid[i] % part == 0 and sid[i] not in seen:
                    seen.add(sid[i])
                    held.append(s)
                    size += len(s)
                    if size >= flush:
                        yield counts()
                        held, size = [], 0
            yield {"doc_id": ids, "n": n, "sid": sid, "check": check, "sketch": sketch, "token": [None] * len(ids), "hits": [None] * len(ids)}
        if held:
            yield counts()

    return arrow_pass(docs.select("doc_id", "text"), run, "doc_id long, n long, sid long, check long, sketch array<long>, token long, hits long")


def _need(n: np.ndarray | int, percent: int):
    return (percent * n + 99) // 100


def _prefixes(docs: DataFrame, width: int, seed: int, percent: int, token: np.ndarray, weight: np.ndarray, tile: int) -> DataFrame:
    """Rows (token, part, sid, at): each distinct set's first n-grams, once for each task.

    ``part`` is 0, or salts << 16 | salt of a salted column; ``at`` is n << 32 | pos. They are packed as this is the widest shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast((token, weight))

    def run(batches):
        token, weight = held.value
        seen = set()
        for batch in batches:
            out = {k: [] for k in ("token", "part", "sid", "at")}
            for _, s in set_rows(batch.column("text"), width):
                sid, _ = _set_id(s, seed)
                if sid in seen:
                    continue
                seen.add(sid)
                w = np.zeros(len(s), np.int64)
                if len(token):
                    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                    w = np.where(token[at] == s, weight[at], 0)
                first = np.lexsort((s, w))[: len(s) - _need(len(s), percent) + 1]
                salts = np.minimum(1 + w[first] // tile, 0x7FFF)
                part = np.where(salts > 1, salts << 16 | (sid & 0x7FFFFFFF) % salts, 0)
                for name, x in (("token", s[first].view(np.int64)), ("part", part), ("sid", np.full(len(first), sid)), ("at", len(s) << 32 | np.arange(len(first)))):
                    out[name].append(x)
            if out["sid"]:
                yield {k: np.concatenate(v) for k, v in out.items()}

    return arrow_pass(docs.select("text"), run, "token long, part int, sid long, at long")


def _may_reach(n_a: str, pos_a: str, n_b: str, pos_b: str, percent: int):
    """Whether sizes and the positions of one common n-gram leave room for the overlap asked for."""
    least = f"(({percent} * ({n_a} + {n_b}) + {percent + 99}) div {100 + percent})"
    bound = f"least({pos_a}, {pos_b}) + 1 + least({n_a} - {pos_a}, {n_b} - {pos_b}) - 1"
    return F.expr(f"100 * least({n_a}, {n_b}) >= {percent} * greatest({n_a}, {n_b}) and {bound} >= {least}")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sketches leave room for the overlap asked for."""
    side = lambda k: classes.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    half = lambda x: f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (x, y) -> x ^ y)"
    cut = lambda x, y: f"if(size({x}) > size({y}), {half(x)}, {x})"  # noqa: E731  sizes within the threshold are at most one step apart
    apart = f"aggregate(zip_with({cut('sketch_a', 'sketch_b')}, {cut('sketch_b', 'sketch_a')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    sized = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
    room = f"n_a + n_b - 2 * (({percent} * (n_a + n_b) + {percent + 99}) div {100 + percent})"
    return pairs.join(side("b"), "b").join(side("a"), "a").where(F.expr(sized)).where(F.expr(f"{apart} <= {room}")).select("a", "b").distinct()


def overlaps(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Entries (a, b) of the product of an incidence matrix, given by its rows, with its transpose: overlaps accumulated over b's columns."""
    size = np.array([len(r) for r in rows])
    start = np.concatenate(([0], np.cumsum(size)))
    column, entry = np.unique(np.concatenate(rows), return_inverse=True)
    cell = np.sort(np.repeat(np.arange(len(rows)), size) * len(column) + entry)
    out = np.zeros(len(a), np.int64)
    ends = np.cumsum(size[b])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        n = size[b[at:to]]
        pair = np.repeat(np.arange(to - at), n)
        where = np.arange(n.sum()) + np.repeat(start[b[at:to]] - np.cumsum(n) + n, n)
        wanted = a[at:to][pair] * len(column) + entry[where]
        hit = cell[np.minimum(np.searchsorted(cell, wanted), len(cell) - 1)] == wanted
        out[at:to] = np.bincount(pair, weights=hit, minlength=to - at).astype(np.int64)
        at = to
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose overlaps reach the threshold, by a masked product in blocks of about ``tile`` pairs, dealt by b."""
    blocks = max(1, pairs.count() // tile)
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)))
    wanted = pairs.select("block", F.explode(F.array("a", "b")).alias("sid")).distinct()
    null = F.lit(None)
    work = pairs.select("block", "a", "b", null.cast("array<long>").alias("tokens")).union(wanted.join(sets, "sid").select("block", F.col("sid").alias("a"), null.cast("long").alias("b"), "tokens"))

    def multiply(table: pa.Table) -> pa.Table:
        is_pair = table.column("b").is_valid()
        pair, row = table.filter(is_pair), table.filter(pc.invert(is_pair))
        sid, tokens = row.column("a").to_numpy(), row.column("tokens")
        order = np.argsort(sid)
        rows = [tokens[int(k)].values.to_numpy() for k in order]
        a, b = pair.column("a").to_numpy(), pair.column("b").to_numpy()
        x, y = np.searchsorted(sid[order], a), np.searchsorted(sid[order], b)
        size = np.array([len(r) for r in rows])
        both = overlaps(rows, x, y)
        keep = 100 * both >= percent * (size[x] + size[y] - both)
        return pa.table({"a": a[keep], "b": b[keep]})

    return work.groupBy("block").applyInArrow(multiply, "a long, b long")


def _listed(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components inside small blocks."""
    x = blocks.alias("x").join(blocks.alias("y"), F.col("x.token") == F.col("y.token"))
    x = x.where((F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root"))).where(_may_reach("x.n", "x.pos", "y.n", "y.pos", percent))
    return x.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


def tile_links(sid: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between rows of a pair of tiles (side 0 and 1, or 2 for one tile with itself) that join different components.

    The overlap of one row with all others is a sparse vector times the tile's incidence matrix. Rows whose
    component has been reached already are left out, so that a component costs one product for each row
    that is not yet in it, and no more links come out than there are rows.
    """
    count = np.array([len(s) for s in sets])
    column, entry = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), count)
    start = np.concatenate(([0], np.cumsum(count)))
    order = np.argsort(entry, kind="stable")
    member = owner[order]
    begin = np.searchsorted(entry[order], np.arange(len(column) + 1))
    _, group = np.unique(root, return_inverse=True)
    links = []
    largest = np.bincount(group).argmax()
    for i in np.argsort(group == largest, kind="stable"):
        if group[i] == largest:
            continue  # every row outside the largest component meets it from its own side
        other = (group != group[i]) & ((side == 2) | (side != side[i]))
        if not other.any():
            continue
        mine = entry[start[i] : start[i + 1]]
        lo, hi = begin[mine], begin[mine + 1]
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(member[at], minlength=len(sets))
        for j in np.flatnonzero(other & (100 * both >= percent * (count[i] + count - both))):
            if group[i] != group[j]:
                links.append((int(sid[i]), int(sid[j])))
                a, b = (group[i], group[j]) if group[j] == largest else (group[j], group[i])
                group[group == a] = b
    return links


def tile_survivors(root: np.ndarray, side: np.ndarray, n: np.ndarray, pos: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows of a pair of tiles have a partner, in another component, that sizes, positions and sketches leave possible."""
    keep = np.zeros(len(root), dtype=bool)
    _, group = np.unique(root, return_inverse=True)
    longs = np.array([len(x) for x in sketches])
    at = {k: np.stack([fold(x, k) if len(x) >= k else np.zeros(k, np.int64) for x in sketches]) for k in np.unique(longs)}
    for i in np.flatnonzero(group != np.bincount(group).argmax()):
        small, large = np.minimum(n, n[i]), np.maximum(n, n[i])
        least = (percent * (n + n[i]) + percent + 99) // (100 + percent)
        room = np.minimum(pos, pos[i]) + np.minimum(n - pos, n[i] - pos[i]) >= least
        j = np.flatnonzero((group != group[i]) & ((side == 2) | (side != side[i])) & (100 * small >= percent * large) & room)
        for k in np.unique(np.minimum(longs[j], longs[i])):
            same = j[np.minimum(longs[j], longs[i]) == k]
            same = same[np.bitwise_count((at[k][same] ^ at[k][i]).view(np.uint64)).sum(axis=1) <= n[same] + n[i] - 2 * least[same]]
            keep[same] = True
            keep[i] |= len(same) > 0
    return keep


def _surviving(blocks: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Rows (token, i, j, side, sid, root) of pairs of tiles that are still worth their whole sets."""
    pair = F.expr("transform(sequence(0, salts - 1), s -> named_struct('i', least(salt, s), 'j', greatest(salt, s), 'side', if(s = salt, 2, if(s > salt, 0, 1))))")
    rows = blocks.join(classes.select("sid", "sketch"), "sid").select("token", "sid", "root", "n", "pos", "sketch", F.explode(pair).alias("t")).select("token", "t.i", "t.j", "t.side", "sid", "root", "n", "pos", "sketch")

    def run(table: pa.Table) -> pa.Table:
        get = lambda name: table.column(name).to_numpy()
        sketch = [x.values.to_numpy() for x in table.column("sketch")]
        return table.filter(pa.array(tile_survivors(get("root"), get("side"), get("n"), get("pos"), sketch, percent))).select(["token", "i", "j", "side", "sid", "root"])

    return rows.groupBy("token", "i", "j").applyInArrow(run, "token long, i int, j int, side int, sid long, root long")


def _tiled(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components inside large blocks: each pair of tiles goes to one task, with its sets."""

    def run(pdf):
        return pd.DataFrame(tile_links(pdf["sid"].to_numpy(), pdf["root"].to_numpy(), pdf["side"].to_numpy(), [np.asarray(x, dtype=np.int64) for x in pdf["tokens"]], percent), columns=["a", "b"])

    return rows.join(sets, "sid").groupBy("token", "i", "j").applyInPandas(run, "a long, b long")


def _with_roots(blocks: DataFrame, roots: DataFrame, tile: int) -> DataFrame:
    """Blocks that still hold several components, with each row's component, the block's size, and tiles by that size."""
    rows = blocks.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    whole = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows_of_token")).where("lo < hi")
    out = rows.join(whole.select("token", "rows_of_token"), "token").withColumn("salts", F.ceil(F.col("rows_of_token") / tile).cast("int"))
    return out.withColumn("salt", F.pmod(F.xxhash64("sid"), "salts").cast("int"))


def jaccard_classes(docs: DataFrame, *, width: int = 5, percent: int = 80, heavy: int = 1 << 18, tile: int = 1024, small: int = 64, part: int = 32) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id."""
    if not 50 <= percent <= 100:
        raise ValueError("the sketches' sizes assume a threshold of 50 to 100 percent")
    spark = docs.sparkSession
    stage = Stage(spark, "jaccard")
    docs = docs.select("doc_id", "text")
    for seed in range(8):
        first = stage.write(_signatures(docs, width, seed, part), "signatures")
        known = first.where("n is not null")
        if not known.groupBy("sid").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").take(1):
            break  # no two different sets share their 64-bit id
    often = first.where("token is not null").groupBy("token").agg((F.sum("hits") * part).alias("hits")).where(f"hits >= {2 * part}").orderBy(F.desc("hits"), "token").limit(heavy).toPandas()
    token, weight = often["token"].to_numpy(np.int64).view(np.uint64), often["hits"].to_numpy(np.int64)
    by = np.argsort(token)
    rows = _prefixes(docs, width, seed, percent, token[by], weight[by], tile)
    block = Window.partitionBy("token", "part")
    rows = rows.withColumns({"lo": F.min("sid").over(block), "hi": F.max("sid").over(block), "hub": F.min(F.struct(F.xxhash64("sid", F.expr("token & 3")).alias("h"), "sid", "at")).over(block)})
    rows = rows.where("lo < hi or part > 0").select("token", "part", "sid", "at", F.col("hub.sid").alias("hub"), F.col("hub.at").alias("hub_at")).distinct()
    blocks = stage.write(rows, "blocks")
    stage.sweep()
    reps = known.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    classes = stage.write(known.select("doc_id", "sid", "n", "sketch").join(reps, ["sid", "doc_id"]), "classes")

    where = {"n": F.expr("at >> 32"), "pos": F.expr("at & 4294967295")}
    hub = {"hub_n": F.expr("hub_at >> 32"), "hub_pos": F.expr("hub_at & 4294967295")}
    star = blocks.where("sid <> hub").withColumns(where | hub).where(_may_reach("n", "pos", "hub_n", "hub_pos", percent))
    star = stage.write(_near(star.select(F.col("hub").alias("a"), F.col("sid").alias("b")).distinct(), classes, percent), "star")
    sets = stage.write(_sets(docs, classes, star.select(F.explode(F.array("a", "b")).alias("sid")), width, seed), "sets")
    links = stage.write(_verified(star, sets, percent, tile), "links")
    roots = connected_components(links, stage)
    left = stage.write(_with_roots(blocks.select("token", "sid", "at").withColumns(where).drop("at"), roots, tile), "left")
    stage.sweep()
    few = left.where(f"rows_of_token <= {small}")
    many = stage.write(_surviving(left.where(f"rows_of_token > {small}"), classes, percent), "many")
    pairs = stage.write(_near(_listed(few, percent).join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), classes, percent), "pairs")
    new = pairs.select(F.explode(F.array("a", "b")).alias("sid")).union(many.select("sid")).distinct().join(sets, "sid", "left_anti")
    sets = sets.union(stage.write(_sets(docs, classes, new, width, seed), "sets"))
    more = stage.write(_verified(pairs, sets, percent, tile).union(_tiled(many, sets, percent)), "more")
    roots = connected_components(links.union(more), stage)
    named = classes.select("sid", "doc_id").distinct().join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("sid", "component_id")
    return known.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int, seed: int) -> DataFrame:
    """(sid, tokens) of the sets wanted, from one document of each.

    Up to ``BROADCAST_IDS`` document ids (counted) go to the texts, so that texts are not shuffled; more are joined by a shuffle.
    """
    ids = classes.join(wanted.distinct(), "sid", "left_semi").select("doc_id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_semi")

    def run(batches):
        for batch in batches:
            found = [(_set_id(s, seed)[0], s.view(np.int64)) for _, s in set_rows(batch.column("text"), width)]
            for k in range(0, len(found), 512):
                yield {"sid": [x for x, _ in found[k : k + 512]], "tokens": [t for _, t in found[k : k + 512]]}

    return arrow_pass(texts, run, "sid long, tokens array<long>")
