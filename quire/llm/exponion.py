"""Exact k-means over integer vectors by Exponion search.

A vector carries an upper bound of the distance to its centroid and a lower bound of that to any other one, both kept
right as centroids move. Only where they cannot tell is the distance computed, and if that still leaves doubt, the centroids
are scanned that lie in a ball around the vector's own: of radius twice the distance plus the gap to the centroid's nearest
neighbour, in which the nearest two must lie. Each centroid has its list of the others by distance, so a ball is a prefix
of a list. The radius is inclusive, so that ties stay in it, and of centroids equally near the smallest number wins.

A round is one pass over the vectors: numpy in slices of a few rows, which also gives each cluster's change since the round
before (only vectors that moved count). Spark adds these up, and only k sums reach the driver. A round's rows are kept as
Spark's own blocks until the next one stands; a lost block is made again from its own slice of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import slices

WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
BATCH_ROWS = 4096
#: Components must stay below, so that squared distances of 64 components fit a long.
MOST = 1 << 27
#: Bounds are kept wide by this share, more than any rounding of theirs.
SLACK = 1e-9
NEVER = 1.0e300


def to_integers(vector: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null unless the vector has that width and only finite components.

    A component whose integer is MOST or more raises an error rather than a wrong distance.
    """
    usable = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def scaled(x: Column) -> Column:
        y = F.floor(F.lit(float(scale)) * x.cast("double"))
        return F.when(F.abs(y) < MOST, y.cast("int")).otherwise(F.raise_error(F.lit(f"a component is too large: {MOST // scale} or more")).cast("int"))

    return F.when(usable, F.transform(vector, scaled))


@dataclass(frozen=True)
class Centroids:
    """Centroids of a round, how far each came since the last one, and for each the others by distance."""

    at: np.ndarray
    moved: np.ndarray
    others: np.ndarray = field(init=False)
    gaps: np.ndarray = field(init=False)

    def __post_init__(self):
        apart = np.sqrt(np.array([squared(self.at, c) for c in self.at], np.float64).reshape(len(self.at), -1))
        np.fill_diagonal(apart, -1.0)  # a centroid heads its own list
        order = np.argsort(apart, axis=1, kind="stable")
        np.fill_diagonal(apart, 0.0)
        object.__setattr__(self, "others", order)
        object.__setattr__(self, "gaps", np.take_along_axis(apart, order, axis=1))

    @property
    def nearest_gap(self) -> np.ndarray:
        return self.gaps[:, 1] if len(self.at) > 1 else np.full(1, NEVER)

    @property
    def most_moved_other(self) -> np.ndarray:
        """For each centroid the greatest move of any other."""
        if len(self.at) == 1:
            return np.zeros(1)
        top = np.argsort(self.moved)[::-1]
        return np.where(np.arange(len(self.at)) == top[0], self.moved[top[1]], self.moved[top[0]])


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one point."""
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def scan(vectors: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the centroids with these numbers: the nearest (ties: the smallest number), its squared distance and the second one's."""
    n = len(vectors)
    own, first, second = np.full(n, -1), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    for c in np.sort(numbers):
        d = squared(vectors, at[c])
        closer = d < first
        second = np.where(closer, first, np.minimum(second, d))
        own[closer], first = c, np.minimum(first, d)
    return own, first, second


def _root(d: np.ndarray) -> np.ndarray:
    """Distances of squared ones; that of no centroid is without end."""
    return np.where(d == np.iinfo(np.int64).max, NEVER, np.sqrt(d.astype(np.float64)))


def assign(vectors: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, cs: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids and bounds after the centroids moved, and how many distances that took."""
    k = len(cs.at)
    own, upper, lower = own.copy(), (upper + cs.moved[own]) * (1 + SLACK), np.maximum(lower - cs.most_moved_other[own], 0.0) * (1 - SLACK)
    safe = np.maximum(lower, cs.nearest_gap[own] / 2 * (1 - SLACK))
    doubt = np.flatnonzero(upper >= safe)
    cost = len(doubt)
    for c in np.unique(own[doubt]):
        mine = doubt[own[doubt] == c]
        upper[mine] = _root(squared(vectors[mine], cs.at[c])) * (1 + SLACK)
    doubt = doubt[upper[doubt] >= safe[doubt]]
    radius = (2 * upper[doubt] + cs.nearest_gap[own[doubt]]) * (1 + SLACK)
    started = own[doubt]
    for c in np.unique(started):
        mine = started == c
        held = np.searchsorted(cs.gaps[c], radius[mine], side="right")  # inclusive
        rings = np.minimum(1 << np.ceil(np.log2(np.maximum(held, 2))).astype(np.int64), k)  # so that few prefixes are scanned
        for size in np.unique(rings):
            rows = doubt[mine][rings == size]
            own[rows], first, second = scan(vectors[rows], cs.others[c][:size], cs.at)
            upper[rows], lower[rows] = _root(first) * (1 + SLACK), _root(second) * (1 - SLACK)
            cost += int(size) * len(rows)
    return own, upper, lower, cost


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


STATE = "v array<int>, own int, upper double, lower double, change array<long>"


def _pass(rows: DataFrame, cs: Centroids, key: str) -> DataFrame:
    """The vectors with their clusters and bounds, and rows that carry, for a cluster, by how much its count and sums changed."""
    k, width = cs.at.shape
    first_round = "own" not in rows.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, kind = np.zeros((k, width + 1), np.int64), None
        for batch in slices(batches, BATCH_ROWS):
            kind = batch.schema.field("id").type
            vectors = _columns(batch)
            ones = np.hstack([np.ones((len(vectors), 1), np.int64), vectors])
            if first_round:
                own, first, second = scan(vectors, np.arange(k), cs.at)
                upper, lower = _root(first) * (1 + SLACK), _root(second) * (1 - SLACK)
                np.add.at(change, own, ones)
            else:
                was = batch.column("own").to_numpy()
                own, upper, lower, _ = assign(vectors, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), cs)
                moved = own != was
                np.add.at(change, own[moved], ones[moved])
                np.subtract.at(change, was[moved], ones[moved])
            none = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(upper), pa.array(lower), none], ["id", "v", "own", "upper", "lower", "change"])
        changed = np.flatnonzero(change.any(axis=1))
        if len(changed):
            n = len(changed)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.int32())), pa.array(changed, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(change[changed].tolist(), pa.list_(pa.int64()))],
                ["id", "v", "own", "upper", "lower", "change"],
            )

    return rows.mapInArrow(step, f"id {key}, {STATE}")


def _distances(rows: DataFrame, cs: Centroids, key: str) -> DataFrame:
    """id, cluster and exact squared distance of every vector."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH_ROWS):
            vectors = _columns(batch)
            own, *_ = assign(vectors, batch.column("own").to_numpy(), batch.column("upper").to_numpy(), batch.column("lower").to_numpy(), cs)
            apart = vectors - cs.at[own]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.int32()), pa.array(np.einsum("ij,ij->i", apart, apart))], ["id", "cluster", "distance"])

    return rows.mapInArrow(step, f"id {key}, cluster int, distance long")


def _moved(old: np.ndarray, sums: np.ndarray) -> Centroids:
    """Floors of the exact means; empty clusters stay."""
    new = np.array([[s // row[0] for s in row[1:]] if row[0] else old[c].tolist() for c, row in enumerate(sums.tolist())], np.int64)
    apart = new - old
    return Centroids(new, np.sqrt(np.einsum("ij,ij->i", apart, apart).astype(np.float64)) * (1 + SLACK))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding", salt: str = "3:", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256.

    The first centroids are the vectors with the least SHA-256 of salt and key; ties in key go by the vector, null keys
    come last. Vectors of another width, null ones and those with a null or non-finite component are left out; fewer
    vectors than clusters make as many clusters; repeated rows count each; other columns are not read; an empty table
    gives no rows. Rounds that change no centroid end the search early, with the same result. clusters and their table of
    distances, clusters squared, must fit the driver and a task.
    """
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), to_integers(F.col(vector), width, scale).alias("v")).where("v IS NOT NULL")
    first = rows.orderBy(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(clusters).select("v").collect()
    if not first:
        return rows.select(F.col("id").alias("vec_id"), *(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))))
    at = np.array([r["v"] for r in first], np.int64)
    cs, sums, held = Centroids(at, np.zeros(len(at))), np.zeros((len(at), width + 1), np.int64), None
    for _ in range(rounds):
        now = _pass(rows, cs, kind).persist(StorageLevel.MEMORY_AND_DISK)
        changes = now.where("change IS NOT NULL").select("own", F.posexplode("change").alias("j", "x")).groupBy("own", "j").agg(F.sum("x").alias("x"))
        for r in changes.collect():  # clusters times width + 1 at most
            sums[r["own"], r["j"]] += r["x"]
        if held is not None:
            held.unpersist()
        held, rows, cs = now, now.where("change IS NULL").select("id", "v", "own", "upper", "lower"), _moved(cs.at, sums)
        if not cs.moved.any():
            break
    found = _distances(rows, cs, kind).persist(StorageLevel.MEMORY_AND_DISK)
    inertia = {r["cluster"]: r["x"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}  # a row per cluster
    held.unpersist()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs.at.tolist()]
    of = lambda values: F.element_at(F.lit(values), F.col("cluster") + 1)
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", of([inertia.get(c, 0) for c in range(len(digest))]).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digest).alias("centroid_sha256")
    )
