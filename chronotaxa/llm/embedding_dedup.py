"""Operator 1: near-duplicate embeddings by product quantisation, with exact rerank.

Equal vectors are one class. Class vectors (unit length, double precision) go to the nearest of about
sqrt(n) coarse centroids; their residuals get subspace codes, and the length of what the codes
miss is kept. Vectors of two lists that lie within distance r of each other are on either side of the bisecting plane of the
centroids, and their distances to it add up to at most r: the nearer one is within r / 2 and probes the other's list, so a link
is met from one side, and ``exact`` probes (all lists whose plane is within r / 2) lose none. In a list, asymmetric distances come from
look-up tables; a member stays a candidate if its table
distance is at most r plus its own quantisation error, which no partner can exceed. Candidates are
compared exactly, so the codes lose nothing.

In high dimensions most of a displacement is parallel to a plane, and far fewer lists suffice. By default ``reach``, how near a plane has to be,
starts at r / 2 times ``spread`` / sqrt(m), at most r / 2, m being the effective dimension of the residuals
(participation ratio of their covariance), and is raised to what the links of ``queries`` sampled
vectors with all rows, found by brute force in one pass, need for a recall of ``recall`` among them. The measured recall is logged.

A list's members and probing queries are cut into tiles of at most ``tile`` rows, and each pair of tiles is one
task's work, which returns a count for each vector and a spanning forest of its links, never the pairs.

Centroids and codebooks are fitted on at most ``sample`` vectors (those with the smallest hash of
their id), and there are at most ``sample`` / 4 lists, which bounds what is broadcast; every vector is indexed and every vector is a query. Assumes that vectors of one
dimension are meant to be compared; those of different dimensions never link.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component has no links and is
kept; repeated rows are vectors of their own (of one id: they link, and share their component). Other
columns are ignored.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Stage, arrow_pass

_SLACK = 1e-6
#: Distances to a plane that differ by less count as equal.
_EVEN = 1e-9
_LOG = logging.getLogger(__name__)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, centre: np.ndarray, step: int = 1024) -> np.ndarray:
    size = (centre**2).sum(1)
    return np.concatenate([(size - 2 * x[k : k + step] @ centre.T).argmin(1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, centre)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, at, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    books: np.ndarray
    radius: float
    #: A list is probed if the plane between it and the vector's own is at most this far away.
    reach: float

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, threshold: float, spread: float | None = 3.0, codes: int = 64) -> Index:
        """``spread`` None probes exactly."""
        dim = x.shape[1]
        parts = max(m for m in range(1, 17) if dim % m == 0)
        centroids = kmeans(x, lists)
        rest = x - centroids[nearest(x, centroids)]
        pieces = rest.reshape(len(x), parts, dim // parts)
        books = np.stack([kmeans(pieces[:, m], codes, seed=m + 1) for m in range(parts)])
        radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        shape = np.maximum(np.linalg.eigvalsh(rest.T @ rest), 0.0)
        effective = float(shape.sum() ** 2 / max((shape**2).sum(), 1e-30)) if shape.sum() else 1.0
        return cls(centroids, books, radius, radius / 2 * (min(1.0, spread / max(effective, 1.0) ** 0.5) if spread is not None else 1.0))

    def planes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each row, and its distance to the plane between that list and each other."""
        c = self.centroids
        size = (c**2).sum(1)
        d2 = (x**2).sum(1)[:, None] + size - 2 * x @ c.T
        own = d2.argmin(1)
        gap = np.sqrt(np.maximum(0.0, size[own][:, None] + size - 2 * c[own] @ c.T))
        return own, np.maximum(0.0, d2 - d2[np.arange(len(x)), own][:, None]) / (2 * np.maximum(gap, 1e-12))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each row, and which lists it probes, its own included."""
        own, away = self.planes(x)
        probe = away <= self.reach + _SLACK
        probe[np.arange(len(x)), own] = True
        return own, probe

    def to_plane(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Distance of each row to the plane between two lists."""
        a, b = self.centroids[own], self.centroids[other]
        gap = np.sqrt(((a - b) ** 2).sum(1))
        return (((x - b) ** 2).sum(1) - ((x - a) ** 2).sum(1)) / (2 * np.maximum(gap, 1e-12))

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subspace codes of the residuals, and the length of what they miss."""
        parts, codes, width = self.books.shape
        rest = (x - self.centroids[own]).reshape(len(x), parts, width)
        d2 = (self.books**2).sum(2)[None] - 2 * np.einsum("npw,pkw->npk", rest, self.books)
        code = d2.argmin(2)
        missed = rest - self.books[np.arange(parts), code]
        return code.astype(np.uint8), np.sqrt((missed**2).sum((1, 2)))

    def table_distances(self, q: np.ndarray, which: int, code: np.ndarray) -> np.ndarray:
        """Distances of queries to coded members of one list, by look-up tables (single precision)."""
        parts, codes, width = self.books.shape
        rest = (q - self.centroids[which]).reshape(len(q), parts, width)
        tables = ((rest**2).sum(2)[:, :, None] + (self.books**2).sum(2)[None] - 2 * np.einsum("npw,pkw->npk", rest, self.books)).astype(np.float32)
        total = np.zeros((len(q), len(code)), np.float32)
        for m in range(parts):
            total += tables[:, m].take(code[:, m], axis=1)
        return np.sqrt(np.maximum(total, 0.0))


def tile_links(index: Index, which: int, threshold: float, q: np.ndarray, q_id: np.ndarray, q_home: np.ndarray, q_weight: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_weight: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """For queries and members of list ``which`` the summed weight of what they link with, and a spanning forest of those links.

    A link is counted on one side: of two members by the smaller id, else by the vector nearer to the plane between the lists.
    """
    code, missed = index.encode(x, np.full(len(x), which))
    q_count, x_count, nodes = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64), np.unique(np.concatenate((q_id, x_id)))
    a_at, b_at = np.searchsorted(nodes, q_id), np.searchsorted(nodes, x_id)
    label = np.arange(len(nodes))
    for k in range(0, len(q), step):
        near = index.table_distances(q[k : k + step], which, code) <= index.radius + missed + _SLACK
        i, j = np.nonzero(near & ((q_home[k : k + step, None] != which) | (q_id[k : k + step, None] < x_id)))
        i += k
        keep = np.zeros(len(i), dtype=bool)
        for s in range(0, len(i), 1 << 16):
            keep[s : s + (1 << 16)] = np.einsum("ij,ij->i", q[i[s : s + (1 << 16)]], x[j[s : s + (1 << 16)]]) >= threshold
        i, j = i[keep], j[keep]
        away = q_home[i] != which
        if away.any():
            m, home = np.flatnonzero(away), q_home[i[away]]
            lead = index.to_plane(x[j[m]], np.full(len(m), which), home) - index.to_plane(q[i[m]], home, np.full(len(m), which))
            mine = np.ones(len(i), dtype=bool)
            mine[m] = (lead > _EVEN) | ((np.abs(lead) <= _EVEN) & (q_id[i[m]] < x_id[j[m]]))
            i, j = i[mine], j[mine]
        np.add.at(q_count, i, x_weight[j])
        np.add.at(x_count, j, q_weight[i])
        a, b = a_at[i], b_at[j]
        while len(a):  # labels sink to the smallest of what they touch
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            label = label[label]
            open_ = label[a] != label[b]
            if not open_.any():
                break
            a, b = a[open_], b[open_]
    while (label != label[label]).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return q_count, x_count, [(int(nodes[m]), int(nodes[label[m]])) for m in moved]


def _classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, u): the given numbers and a hash of them; both null where nothing can link."""
    kind = "double" if dict(vectors.dtypes)["embedding"] == "array<double>" else "float"

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            given = column.flatten().to_numpy(zero_copy_only=False)  # a null becomes a NaN
            row = np.repeat(np.arange(len(column)), size)
            bad = np.bincount(row, weights=~np.isfinite(given), minlength=len(column)) > 0
            some = np.bincount(row, weights=given != 0, minlength=len(column)) > 0
            given = given + given.dtype.type(0)  # -0.0 is 0.0
            good = some & ~bad
            key = [xxhash.xxh3_128_hexdigest(given[e - n : e].tobytes()) if ok else None for e, n, ok in zip(end.tolist(), size.tolist(), good.tolist())]
            yield {"vec_id": batch.column("vec_id"), "key": key, "u": pc.if_else(pa.array(good), column, pa.scalar(None, column.type))}

    return arrow_pass(vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding")), run, f"vec_id long, key string, u array<{kind}>")


def calibrated(reps: DataFrame, index: Index, asked: np.ndarray, asked_id: np.ndarray, threshold: float, recall: float) -> Index:
    """The index with ``reach`` raised until that share of the asked vectors' links is met; links are found by brute force over all rows."""
    own, _ = index.planes(asked)
    held = reps.sparkSession.sparkContext.broadcast((index, asked, asked_id, own))

    def needs(batches):
        index, asked, asked_id, own = held.value
        for batch in batches:
            x, rep = matrix(batch.column("u")), batch.column("rep").to_numpy()
            i, j = np.nonzero((x @ asked.T >= threshold) & (rep[:, None] != asked_id))
            if len(i):
                home, away = index.planes(x[np.unique(i)])
                i = np.unique(i, return_inverse=True)[1]
                back = index.to_plane(asked[j], own[j], home[i])
                need = np.where(home[i] == own[j], 0.0, np.minimum(away[i, own[j]], back))
                step, n = np.unique(np.ceil(need / index.radius * 1000).astype(np.int32), return_counts=True)
                yield {"step": step, "n": n}

    rows = arrow_pass(reps.select("rep", "u"), needs, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").collect()
    total, met, reach = sum(r.n for r in rows), 0, 0.0
    for r in rows:
        if met < recall * total:
            met, reach = met + r.n, r.step / 1000 * index.radius
    out = replace(index, reach=min(index.radius / 2, max(index.reach, reach)))
    found = sum(r.n for r in rows if r.step / 1000 * index.radius <= out.reach + 1e-12)
    _LOG.info("links of %d sampled vectors: %d, of which the probes meet %d; reach %.4f of %.4f", len(asked), total, found, out.reach, index.radius / 2)
    return out


def _links(reps: DataFrame, threshold: float, sample: int, tile: int, spread: float | None, queries: int, recall: float) -> DataFrame:
    """Rows (a, n, b): a's weight of links found by one task, or a link a-b of its forest. ``reps`` has one dimension."""
    spark = reps.sparkSession
    n = reps.count()
    taken = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("rep", "u").toArrow()
    some = matrix(taken.column("u"))
    index = Index.fit(some, min(round(n**0.5), max(1, sample // 4)), threshold, spread)
    if spread is not None:
        index = calibrated(reps, index, some[:queries], taken.column("rep").to_numpy()[:queries], threshold, recall)
    held = spark.sparkContext.broadcast(index)

    def counted(batches):
        members, asked = np.zeros(len(held.value.centroids), np.int64), np.zeros(len(held.value.centroids), np.int64)
        for batch in batches:
            own, probe = held.value.assign(matrix(batch.column("u")))
            members += np.bincount(own, minlength=len(members))
            asked += probe.sum(axis=0)
        yield {"list": np.arange(len(members)), "members": members, "asked": asked}

    size = arrow_pass(reps.select("u"), counted, "list int, members long, asked long").groupBy("list").agg(F.sum("members").alias("members"), F.sum("asked").alias("asked")).collect()
    grid = np.ones((len(index.centroids), 2), np.int64)
    for r in size:
        grid[r.list] = max(1, -(-r.members // tile)), max(1, -(-r.asked // tile))
    cut = spark.sparkContext.broadcast(grid)

    def dealt(batches):
        for batch in batches:
            rep, weight = batch.column("rep").to_numpy(), batch.column("weight").to_numpy()
            own, probe = held.value.assign(matrix(batch.column("u")))
            slot = (rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            # A member goes to all columns of its row of tiles, a query to all rows of its column.
            for member, at, lists in ((True, np.arange(len(rep)), own), (False, *np.nonzero(probe))):
                fixed = (slot[at] % cut.value[lists, 0 if member else 1].astype(np.uint64)).astype(np.int64)
                times = cut.value[lists, 1 if member else 0]
                turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, lists, fixed = (np.repeat(v, times) for v in (at, lists, fixed))
                i, j = (fixed, turn) if member else (turn, fixed)
                for s in range(0, len(at), 2048):
                    e = slice(s, s + 2048)
                    yield {"list": lists[e], "i": i[e], "j": j[e], "home": own[at[e]], "member": np.full(len(at[e]), member), "rep": rep[at[e]], "weight": weight[at[e]], "u": batch.column("u").take(pa.array(at[e]))}

    kind = dict(reps.dtypes)["u"]
    work = arrow_pass(reps.select("rep", "weight", "u"), dealt, f"list int, i int, j int, home int, member boolean, rep long, weight long, u {kind}")

    def multiply(table: pa.Table) -> pa.Table:
        x = table.column("member").to_numpy()
        q, which = ~x, table.column("list")[0].as_py()
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        if q.any() and x.any():
            u, rep, weight, home = matrix(table.column("u")), table.column("rep").to_numpy(), table.column("weight").to_numpy(), table.column("home").to_numpy()
            q_count, x_count, forest = tile_links(held.value, which, threshold, u[q], rep[q], home[q], weight[q], u[x], rep[x], weight[x])
            count, both = np.concatenate((q_count, x_count)), np.concatenate((rep[q], rep[x]))
            some = count > 0
            out = (np.concatenate((both[some], [a for a, _ in forest])).astype(np.int64), np.concatenate((count[some], np.zeros(len(forest), np.int64))), [None] * int(some.sum()) + [b for _, b in forest])
        return pa.table({"a": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "b": pa.array(out[2], pa.int64())})

    return work.groupBy("list", "i", "j").applyInArrow(multiply, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, sample: int = 16_384, tile: int = 4096, spread: float | None = 3.0, queries: int = 1024, recall: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    stage = Stage(vectors.sparkSession, "vectors")
    given = _classes(vectors)
    reps = given.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("u").alias("u"))
    # Different classes may share an id in a table with repeated ids: classes are numbered by hash, checked for clashes.
    reps = stage.write(reps.withColumn("dim", F.size("u")), "classes")
    for seed in range(8):
        numbered = reps.withColumn("rep", F.xxhash64(F.lit(seed), "key"))
        if not numbered.groupBy("rep").count().where("count > 1").take(1):
            break
    reps = numbered
    all_ = given.select("vec_id", "key", F.xxhash64(F.lit(seed), "key").alias("rep"))
    found = None
    for (dim,) in reps.select("dim").distinct().collect():
        part = stage.write(_links(reps.where(F.col("dim") == dim), threshold, sample, tile, spread, queries, recall), "links")
        found = part if found is None else found.union(part)
    if found is None:
        return all_.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    all_ = stage.write(all_, "all")
    same_id = all_.where("key is not null").select("vec_id", "rep").distinct().groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    roots = connected_components(found.where("b is not null").select("a", "b").union(same_id), stage)
    count = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = reps.select("rep", "key", "low", "weight").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(count, "rep", "left").select("key", "low", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("key", "n_links", "component_id")
    out = all_.select("vec_id", "key").join(named, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
