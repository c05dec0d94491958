"""Exact k-means over integer vectors: bounds, sorted neighbours and a shrinking search ball."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactline.llm.common import Batches, batch, mapped, removed, slices
from pactline.session import scratch_path

_STATE = "vec_id long, vector array<int>, cluster int, second int, upper double, lower double"


@dataclass(frozen=True)
class ClusterRules:
    """Vectors of `components` numbers x become floor(scale * x), below `limit` in size, so squared
    distances fit 64 bits; `clusters` centroids start at the vectors whose ids hash lowest after
    `seed`, and move `rounds` times. The centroids and their distances from each other go to every
    task: clusters * (components + clusters) numbers, whatever the number of vectors."""

    components: int = 64
    scale: int = 1024
    clusters: int = 8
    rounds: int = 10
    seed: int = 3
    limit: int = 1 << 27


def integer_vectors(embeddings: DataFrame, rules: ClusterRules) -> DataFrame:
    """vec_id and vector (integers) of the rows whose embedding has the right number of
    components, all of them finite."""
    numbers = F.transform("embedding", lambda x: x.cast("double") * rules.scale)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("numbers"))
    finite = F.forall("numbers", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall("numbers", lambda x: F.abs(x) < rules.limit)
    vector = F.when(small, F.transform("numbers", lambda x: F.floor(x).cast("int"))).otherwise(
        F.raise_error(F.lit(f"a component is not below {rules.limit} after scaling")))
    return rows.where((F.size("numbers") == rules.components) & finite).select(
        "vec_id", vector.alias("vector"))


def _above(values: np.ndarray) -> np.ndarray:
    """Not below the true value, whatever was lost in rounding."""
    return values * (1 + 1e-12) + 1e-9


def _below(values: np.ndarray) -> np.ndarray:
    return np.maximum(values * (1 - 1e-12) - 1e-9, 0)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances in integers, row by row."""
    return np.square(x - y).sum(axis=-1)


class Centroids:
    """The centroids of a round, with what the search needs of them."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        gaps = np.sqrt(np.array([_squared(at, c) for c in at], np.float64))
        self.near = np.argsort(gaps, axis=1, kind="stable")  # each one's neighbours, closest first
        self.gaps = _below(np.take_along_axis(gaps, self.near, 1))
        np.fill_diagonal(gaps, np.inf)
        self.half = _below(gaps.min(axis=1) / 2)  # nothing else is nearer than this much
        moved = np.zeros(len(at)) if before is None else _above(np.sqrt(_squared(at, before)))
        self.moved = moved
        others = np.tile(moved, (len(at), 1))
        np.fill_diagonal(others, 0)
        self.others_moved = others.max(axis=1)

    def assign(self, x, cluster, second, upper, lower) -> tuple[np.ndarray, ...]:
        """The state after this round of vectors x with the state before it.

        `upper` is at least the distance to the own centroid, `lower` at most that to any other.
        While upper < lower, or upper is less than half the way to the nearest other centroid, no
        other is as near. For the rest the remembered second centroid is measured too, the closer
        of both is the centre of a ball that holds every centroid nearer than the further one, and
        the centre's neighbours are read in the order of their distance until it leaves the ball,
        whose radius falls whenever a nearer second is found. Decisions compare integers.
        """
        if len(self.at) == 1:
            return cluster, second, np.zeros(len(x)), np.full(len(x), np.inf)
        upper = _above(upper + self.moved[cluster])
        lower = _below(np.maximum(lower - self.others_moved[cluster], 0))
        bound = np.maximum(lower, self.half[cluster])
        rows = np.flatnonzero(~(upper < bound))
        if not len(rows):
            return cluster, second, upper, lower
        first_at = _squared(x[rows], self.at[cluster[rows]])
        upper[rows] = _above(np.sqrt(first_at))
        left = ~(upper[rows] < bound[rows])
        rows, first_at = rows[left], first_at[left]
        if not len(rows):
            return cluster, second, upper, lower
        first, other = cluster[rows], second[rows]
        other_at = _squared(x[rows], self.at[other])
        swap = (other_at < first_at) | ((other_at == first_at) & (other < first))
        first, other = np.where(swap, other, first), np.where(swap, first, other)
        first_at, other_at = np.where(swap, other_at, first_at), np.where(swap, first_at, other_at)
        centre = first.copy()
        from_centre = np.sqrt(first_at)
        for c in np.unique(centre).tolist():
            active = np.flatnonzero(centre == c)
            for j, gap in zip(self.near[c].tolist(), self.gaps[c].tolist()):
                active = active[gap <= _above(from_centre[active] + np.sqrt(other_at[active]))]
                if not len(active):
                    break
                new = active[(first[active] != j) & (other[active] != j)]
                if not len(new):
                    continue
                at = _squared(x[rows[new]], self.at[j])
                best = (at < first_at[new]) | ((at == first_at[new]) & (j < first[new]))
                next_best = ~best & (at < other_at[new])
                win, runner = new[best], new[next_best]
                other[win], other_at[win] = first[win], first_at[win]
                first[win], first_at[win] = j, at[best]
                other[runner], other_at[runner] = j, at[next_best]
        cluster[rows], second[rows] = first, other
        upper[rows], lower[rows] = _above(np.sqrt(first_at)), _below(np.sqrt(other_at))
        return cluster, second, upper, lower


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, components).astype(np.int64)


def _state_task(centroids: Centroids, components: int, fresh: bool):
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.list_(pa.int32())),
                        ("cluster", pa.int32()), ("second", pa.int32()), ("upper", pa.float64()),
                        ("lower", pa.float64())])

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            x, n = _matrix(some.column(1), components), some.num_rows
            if fresh:
                last = min(1, len(centroids.at) - 1)
                state = [np.zeros(n, np.int32), np.full(n, last, np.int32), np.full(n, np.inf), np.zeros(n)]
            else:
                state = [some.column(i).to_numpy().copy() for i in range(2, 6)]
            cluster, second, upper, lower = centroids.assign(x, *state)
            yield batch(schema, some.column(0), some.column(1), cluster.astype(np.int32),
                        second.astype(np.int32), upper, lower)

    return task


def _sums(state: DataFrame, clusters: int, components: int) -> dict[int, tuple[int, list[int]]]:
    """How many vectors each cluster has, and their exact sums: a row a task and cluster goes out."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def task(batches: Batches) -> Batches:
        sums, counts = np.zeros((clusters, components), np.int64), np.zeros(clusters, np.int64)
        for some in slices(batches):
            x, cluster = _matrix(some.column(1), components), some.column(0).to_numpy()
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], starts)
            counts += np.bincount(cluster, minlength=clusters)
        for c in np.flatnonzero(counts).tolist():
            yield batch(schema, [c], [int(counts[c])], [sums[c]])

    parts = mapped(state.select("cluster", "vector"), task, "cluster int, n long, sums array<long>")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    whole = flat.groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("whole"))
    out: dict[int, tuple[int, list[int]]] = {}
    for row in whole.orderBy("cluster", "place").collect():  # clusters * components rows
        out.setdefault(row["cluster"], (row["n"], []))[1].append(int(row["whole"]))
    return out


def _distance_task(at: np.ndarray, components: int):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def task(batches: Batches) -> Batches:
        for some in slices(batches):
            cluster = some.column(2).to_numpy()
            yield batch(schema, some.column(0), cluster,
                        _squared(_matrix(some.column(1), components), at[cluster]))

    return task


def cluster_vectors(embeddings: DataFrame, rules: ClusterRules | None = None) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance (squared, to its centroid),
    cluster_inertia, inertia (sums of distance) and centroid_sha256 (of the final centroid).

    Lloyd's rounds with Shallot search (`Centroids.assign`): the result is that of comparing every
    vector with every centroid. Vectors and bounds are written in each round, the older ones go.
    A centroid is the floor of the exact mean of its vectors; without vectors it stays. Vectors do
    not move between tasks: a round sends a row of sums for each task and cluster. Rounds end early
    when no centroid moves, which changes nothing.

    Rows with another number of components, a null or a number that is not finite take no part;
    components too large for the integers fail the job with a message. A null vec_id is kept and
    its hash comes last; rows that repeat a vec_id are vectors of their own, those with equal hash
    start in the order of their numbers. With fewer vectors than clusters each starts a cluster.
    Equally near centroids: the smaller number. Other columns are not read; an empty table gives an
    empty one.
    """
    rules = rules or ClusterRules()
    spark = embeddings.sparkSession
    state = integer_vectors(embeddings, rules)
    order = F.sha2(F.concat(F.lit(f"{rules.seed}:"), F.col("vec_id").cast("string")), 256)
    start = state.orderBy(order.asc_nulls_last(), "vector").limit(rules.clusters).collect()
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    at = np.array([row["vector"] for row in start], np.int64)
    centroids, path = Centroids(at), None
    for turn in range(rules.rounds + 1):
        old, path = path, scratch_path(spark, "cluster-state")
        mapped(state, _state_task(centroids, rules.components, turn == 0), _STATE).write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if old is not None:
            removed(spark, old)
        if turn == rules.rounds:
            break
        moved = at.copy()
        for c, (n, sums) in _sums(state, len(at), rules.components).items():
            moved[c] = [s // n for s in sums]
        if (moved == at).all():
            break
        at, centroids = moved, Centroids(moved, at)
    rows = mapped(state.select("vec_id", "vector", "cluster"),
                  _distance_task(at, rules.components), "vec_id long, cluster int, distance long")
    inertia = {r["cluster"]: int(r["all"]) for r in rows.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("all")).collect()}  # a row a cluster
    total = sum(inertia.values())
    facts = spark.createDataFrame(
        [(c, n, total, hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest())
         for c, n in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
