"""Clustering by summaries (count, sum, sum of squares): discard, compressed and retained sets.

Points are read in Arrow batches by tasks that hold the few clusters as arrays, so finding the nearest one and summing up
needs neither a join nor a row for each pair of point and cluster, and only summaries are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import text_number
from ..runtime import col, stored

#: Clusters that a task holds at most.
MOST_CLUSTERS = 10_000
#: Rows of weighted points that are clustered in the driver at most; more are summed up by tasks first.
MOST_WEIGHTED = 100_000


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; null elements are nan."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def summaries(points: DataFrame, cluster: str = "cluster", vector: str = "vector") -> DataFrame:
    """cluster, n, sum, sumsq: a mergeable summary of each cluster, dimension by dimension, summed up in each task first.

    Rows without a vector don't count; all vectors of a cluster must have the same length.
    """
    rows = points.select(col(cluster).alias("cluster"), col(vector).alias("vector")).where("vector is not null")
    kind = rows.schema["cluster"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        own = None
        for b in batches:
            own = b.schema.field(0).type
            names = b.column(0).dictionary_encode("encode")
            at = names.indices.to_numpy()
            for code, name in enumerate(names.dictionary.to_pylist()):
                x = _matrix(b.column(1).take(pa.array(np.flatnonzero(at == code))))
                n, s, q = held.get(name, (0, 0.0, 0.0))
                held[name] = n + len(x), s + np.nansum(x, axis=0), q + np.nansum(x * x, axis=0)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), own), pa.array([n for n, _, _ in held.values()], pa.int64()), *(pa.array([v[i].tolist() for v in held.values()], pa.list_(pa.float64())) for i in (1, 2))], names=["cluster", "n", "sum", "sumsq"])

    return merge_summaries(rows.mapInArrow(run, f"cluster {kind}, n long, sum array<double>, sumsq array<double>"))


def merge_summaries(*parts: DataFrame) -> DataFrame:
    """Summaries of the same clusters added up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    dims = whole.select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "v"))
    by = dims.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("v.sum").alias("s"), F.sum("v.sumsq").alias("ss"))
    sort = F.array_sort(F.collect_list(F.struct("dim", "s", "ss")))
    return by.groupBy("cluster").agg(F.max("n").alias("n"), sort.alias("d")).select("cluster", "n", F.transform("d", lambda v: v["s"]).alias("sum"), F.transform("d", lambda v: v["ss"]).alias("sumsq"))


def centres(sums: DataFrame) -> DataFrame:
    """cluster, n, centre, std of each summary."""
    mean = F.transform("sum", lambda s: s / F.col("n"))
    var = F.zip_with("sumsq", "sum", lambda q, s: F.greatest(F.lit(0.0), q / F.col("n") - (s / F.col("n")) * (s / F.col("n"))))
    return sums.select("cluster", "n", mean.alias("centre"), F.transform(var, lambda v: F.sqrt(v)).alias("std"))


def _nearest_of(x: np.ndarray, centre: np.ndarray, std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of the cluster nearest to each row of x, the first of equally near ones."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i, (m, s) in enumerate(zip(centre, std)):
        ok = s > 1e-12
        d = np.sqrt((((x[:, ok] - m[ok]) / s[ok]) ** 2).sum(axis=1))
        closer = d < best
        best[closer], at[closer] = d[closer], i
    return at, best


def nearest(points: DataFrame, of: DataFrame, point: str = "id", vector: str = "vector") -> DataFrame:
    """point, nearest cluster and its Mahalanobis distance (dimensions without spread don't count), one row for each row of
    points with a vector. Ties go to the least cluster. The clusters (cluster, centre, std; at most MOST_CLUSTERS) are
    held by every task, and the points stay where they are."""
    held = of.select("cluster", "centre", "std").limit(MOST_CLUSTERS + 1).toArrow().sort_by("cluster")
    if len(held) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    names, centre, std = held.column(0).combine_chunks(), *(_matrix(held.column(i).combine_chunks()) if len(held) else None for i in (1, 2))
    rows = points.select(col(point).alias("id"), col(vector).alias("vector")).where("vector is not null")
    kind, own = rows.schema["id"].dataType.simpleString(), of.schema["cluster"].dataType.simpleString()
    if not len(held):
        return rows.limit(0).select("id", F.lit(None).cast(own).alias("cluster"), F.lit(0.0).alias("distance"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, d = _nearest_of(_matrix(b.column(1)), centre, std)
                yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(at)), pa.array(d)], names=["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {kind}, cluster {own}, distance double")


def gate(assigned: DataFrame, dims: int, factor: float = 2.0) -> DataFrame:
    """Only assignments closer than factor * sqrt(dims)."""
    return assigned.where(F.col("distance") < factor * math.sqrt(dims))


class _Sets:
    """Summaries as arrays: a few hundred clusters, whatever the number of points."""

    def __init__(self):
        self.n: dict[int, int] = {}
        self.s: dict[int, np.ndarray] = {}
        self.q: dict[int, np.ndarray] = {}

    def take(self, rows: DataFrame) -> None:
        self.add(rows.collect())  # one row a cluster

    def add(self, rows: Iterable) -> None:
        for r in rows:
            c = r["cluster"]
            self.n[c] = self.n.get(c, 0) + r["n"]
            self.s[c] = self.s.get(c, 0) + np.array(r["sum"])
            self.q[c] = self.q.get(c, 0) + np.array(r["sumsq"])

    def stats(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        mean = self.s[c] / self.n[c]
        return mean, np.sqrt(np.maximum(0, self.q[c] / self.n[c] - mean**2))

    def merge(self, a: int, b: int, other: "_Sets | None" = None) -> None:
        """Cluster b (of other) into a."""
        src = other or self
        self.n[a] += src.n[b]
        self.s[a], self.q[a] = self.s[a] + src.s[b], self.q[a] + src.q[b]
        for d in (src.n, src.s, src.q):
            del d[b]

    def arrays(self) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Names, centres and spreads, by name."""
        names = sorted(self.n)
        both = [self.stats(c) for c in names]
        return names, np.array([m for m, _ in both]), np.array([s for _, s in both])


def _lloyd(x: np.ndarray, w: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """k centres of weighted points: seeded far apart in proportion to squared distance, then moved until they stay."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.choice(len(x), p=w / w.sum())]]
    far = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and (far * w).sum() > 0:
        centres = np.vstack((centres, x[rng.choice(len(x), p=far * w / (far * w).sum())]))
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        at = _closest(x, centres)
        n = np.bincount(at, w, len(centres))
        moved = np.stack([np.bincount(at, w * v, len(centres)) for v in x.T], axis=1) / np.maximum(n, 1e-12)[:, None]
        moved[n == 0] = centres[n == 0]
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


#: Points that a task sums up together into weighted ones, and how many of these there are for each cluster asked for.
BLOCK_POINTS, WEIGHTED_PER_CLUSTER = 20_000, 8


def _weighted(points: DataFrame, k: int, seed: int) -> DataFrame:
    """vector, weight: stretches of points summed up by their nearest of a few centres drawn from them."""
    m = k * WEIGHTED_PER_CLUSTER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def give() -> pa.RecordBatch:
            x, w = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            if len(x) > m:
                at = _closest(x, x[np.random.default_rng(seed).choice(len(x), m, replace=False)])
                total = np.bincount(at, w, m)
                x = np.stack([np.bincount(at, w * v, m) for v in x.T], axis=1)[total > 0] / total[total > 0][:, None]
                w = total[total > 0]
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(w)], names=["vector", "weight"])

        for b in batches:
            if b.num_rows:
                held.append((_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)))
                n += b.num_rows
                if n >= BLOCK_POINTS:
                    yield give()
                    held, n = [], 0
        if held:
            yield give()

    return points.mapInArrow(run, "vector array<double>, weight double")


def kmeans_centres(points: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """k centres (fewer where there are fewer different points) of points(vector): tasks sum up stretches of points into weighted
    ones, again and again until at most MOST_WEIGHTED are left, which are clustered in the driver. So the data is read once."""
    rows = _weighted(points.select("vector", F.lit(1.0).alias("weight")), k, seed)
    while True:
        rows = stored(rows)
        n = rows.count()
        if n <= max(MOST_WEIGHTED, 2 * k * WEIGHTED_PER_CLUSTER):
            break
        rows = _weighted(rows.repartition(max(1, n // BLOCK_POINTS)), k, seed)
    t = rows.toArrow()
    if not t.num_rows:
        return np.zeros((0, 0))
    x, w = _matrix(t.column("vector").combine_chunks()), t.column("weight").to_numpy()
    order = np.lexsort((w, *x.T))  # whatever the order in which rows come
    return _lloyd(x[order], w[order], k, seed)


def _labelled(points: DataFrame, names: list[int], centre: np.ndarray, std: np.ndarray, limit: float, names2: list[int] = [], centre2=None, std2=None) -> DataFrame:  # noqa: B006
    """id, vector, cluster: the nearest cluster within the limit, else the nearest of the second ones within it, else -1."""
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, of = _matrix(b.column(1)), np.full(b.num_rows, -1, np.int32)
            for ns, c, s in ((names, centre, std), (names2, centre2, std2)):
                left = np.flatnonzero(of < 0)
                if ns and len(left):
                    at, d = _nearest_of(x[left], c, s)
                    of[left] = np.where(d < limit, np.array(ns, np.int32)[at], -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(of)], names=["id", "vector", "cluster"])

    return points.select("id", "vector").mapInArrow(run, f"id {kind}, vector array<double>, cluster int")


def _clustered(points: DataFrame, k: int, seed: int) -> DataFrame:
    """id, vector, cluster: the points by their nearest of k centres."""
    centre = kmeans_centres(points, k, seed)
    return _labelled(points, list(range(len(centre))), centre, np.ones_like(centre), math.inf)


def chunk_of(point: str, chunks: int) -> Column:
    """The chunk of a point, by a hash of its id."""
    return F.pmod(text_number(col(point).cast("string")), F.lit(chunks)).cast("int")


def summarised_clusters(df: DataFrame, point: str, vector: str, k: int, chunks: int = 5, factor: float = 2.0, seed: int = 1) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Clusters points chunk by chunk, keeping summaries: (id, cluster) with -1 for outliers, and per round the counts of
    discarded points, compressed clusters, compressed points and retained points.

    Chunks are hash buckets of the id. The first chunk with points is clustered by k-means: with 5 k clusters to set
    singletons aside, then the rest into k discard sets. Each later point goes to the nearest discard set within factor *
    sqrt(d) (against the summaries at the start of the round), else to the nearest compressed set within it, else it is
    retained. Retained points are clustered again into compressed sets where two or more meet, close compressed sets are
    merged, and in the end compressed sets near a discard set join it. A chunk is read once to assign its points and once
    more, by its few retained ones, to cluster these; its result is one table. Null ids and vectors are left out. Runs at once.
    """
    pts = df.select(col(point).alias("id"), col(vector).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    pts = stored(pts.withColumn("chunk", chunk_of("id", chunks)), "chunk")
    spark = pts.sparkSession
    first = pts.select(F.size("vector").alias("d")).first()
    if first is None:
        return pts.select("id", F.lit(-1).alias("cluster")), []
    limit = factor * math.sqrt(first["d"])
    ds, cs = _Sets(), _Sets()
    members, retained, n_retained, rounds, next_cs, renamed = [], None, 0, [], 1_000_000, {}

    for c in range(chunks):
        chunk = pts.where(F.col("chunk") == c).select("id", "vector")
        if not ds.n:
            coarse = stored(_clustered(chunk, 5 * k, seed))
            sizes = {r["cluster"]: r["m"] for r in coarse.groupBy("cluster").agg(F.count("*").alias("m")).collect()}  # at most 5 k
            if not sizes:
                continue
            alone = [x for x, m in sizes.items() if m == 1]
            crowd = coarse.where(~F.col("cluster").isin(alone)) if len(alone) < len(sizes) else coarse
            rest = coarse.where(F.col("cluster").isin(alone)).select("id", "vector") if len(alone) < len(sizes) else coarse.limit(0).select("id", "vector")
            fine = stored(_clustered(crowd, k, seed))
            ds.take(summaries(fine))
            members.append(fine.select("id", "cluster"))
            n_retained = len(alone) if len(alone) < len(sizes) else 0
        else:
            told = stored(_labelled(chunk, *ds.arrays(), limit, *cs.arrays()))
            sums = summaries(told).collect()  # one row a cluster
            ds.add(r for r in sums if r["cluster"] in ds.n)
            cs.add(r for r in sums if r["cluster"] in cs.n)
            members.append(told.where("cluster >= 0").select("id", "cluster"))
            rest = told.where("cluster < 0").select("id", "vector")
            n_retained += sum(r["n"] for r in sums if r["cluster"] == -1)
        retained = rest if retained is None else retained.unionByName(rest)
        if n_retained > 1:
            got = stored(_clustered(retained, max(1, min(n_retained - 1, 5 * k)), seed).withColumn("cluster", F.col("cluster") + next_cs))
            sums = summaries(got).collect()
            more = [r for r in sums if r["n"] > 1]
            held = F.col("cluster").isin([r["cluster"] for r in more])
            cs.add(more)
            members.append(got.where(held).select("id", "cluster"))
            retained = got.where(~held).select("id", "vector")
            n_retained -= sum(r["n"] for r in more)
            next_cs += 5 * k
        _merge_close(cs, limit, renamed)
        if c == chunks - 1:
            _join_discard(ds, cs, limit, renamed)
        rounds.append((sum(ds.n.values()), len(cs.n), sum(cs.n.values()), n_retained))
    whole = members[0]
    for m in members[1:]:
        whole = whole.unionByName(m)
    if renamed:
        names = F.broadcast(spark.createDataFrame(list(renamed.items()), "cluster int, into int"))  # at most 5 k a chunk
        whole = whole.join(names, "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster"))
    return whole.unionByName(retained.select("id", F.lit(-1).alias("cluster"))), rounds


def _rename(renamed: dict[int, int], old: int, new: int) -> None:
    for k, v in renamed.items():
        if v == old:
            renamed[k] = new
    renamed[old] = new


def _merge_close(cs: _Sets, limit: float, renamed: dict[int, int]) -> None:
    """Merge compressed sets within the limit of each other, seen from both; in each pass a set is merged once."""
    while len(cs.n) > 1:
        names, mean, std = cs.arrays()
        d = np.empty((len(names), len(names)))
        for i, s in enumerate(std):
            ok = s > 1e-12
            d[i] = np.sqrt((((mean[:, ok] - mean[i, ok]) / s[ok]) ** 2).sum(axis=1)) if ok.any() else np.inf
        near, done = np.argwhere(np.triu(np.maximum(d, d.T) < limit, 1)).tolist(), set()
        for i, j in near:
            if not done & {i, j}:
                done |= {i, j}
                cs.merge(names[i], names[j])
                _rename(renamed, names[j], names[i])
        if not done:
            return


def _join_discard(ds: _Sets, cs: _Sets, limit: float, renamed: dict[int, int]) -> None:
    """Compressed sets near a discard set join it."""
    for b in sorted(cs.n):
        names, mean, std = ds.arrays()
        at, d = _nearest_of(cs.stats(b)[0][None, :], mean, std)
        if d[0] < limit:
            ds.merge(names[at[0]], b, cs)
            _rename(renamed, b, names[at[0]])
