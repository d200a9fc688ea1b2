"""Centroid clustering of integer vectors by scalar lookup tables.

Vectors are cut into blocks once: each block keeps, per dimension, the integers that occur in
it and for each vector the place of its integer among them. A round tabulates the squared
difference of every occurring integer to every centroid, dimension by dimension; a distance
is then a sum of table entries gathered by those places. Only the sums and counts per
centroid leave a task, so a hot cluster is never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import Batches, written

#: Integers beyond +-WIDEST would not leave room for a squared distance of 64 of them in a long.
WIDEST = 1 << 27
#: Vectors of one block; a table holds at most so many integers per dimension.
BLOCK = 4096

Centroids = list[list[int]]
_BLOCKS = "ids array<bigint>, places binary, starts array<int>, integers array<bigint>"


def quantised(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of every vector that takes part.

    A vector takes part if it has exactly `dims` components, none null or non-finite, and every
    integer lies within +-2^27, beyond which distances need not fit a long. Rows with a null or
    repeated vec_id take part like any other. Other columns are not used.
    """
    x = F.col("embedding")
    whole = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")))
    fits = F.forall(x, lambda c: c.isNotNull() & (F.abs(scale * c.cast("double")) < WIDEST))
    return vectors.filter((F.size(x) == dims) & fits).select("vec_id", whole.alias("v"))


def starting_centroids(rows: DataFrame, k: int) -> Centroids:
    """The `k` vectors whose `1:<vec_id>` hashes smallest, all if there are fewer.

    Equal hashes (repeated ids) go by their components; a null id starts no centroid.
    """
    named = rows.filter("vec_id IS NOT NULL")
    ranked = named.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    return [list(r.v) for r in ranked.orderBy("h", "v").limit(k).collect()]


def _encode(batch: pa.RecordBatch, dims: int) -> Iterator[dict]:
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims)
        places, found = np.empty(v.shape, np.uint16), []
        for d in range(dims):
            values, places[:, d] = np.unique(v[:, d], return_inverse=True)
            found.append(values)
        starts = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        yield {
            "ids": [part.column("vec_id").to_pylist()],
            "places": [np.ascontiguousarray(places.T).tobytes()],
            "starts": [starts.astype(np.int32)],
            "integers": [np.concatenate(found)],
        }


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """One row per block of at most `BLOCK` vectors: their ids, places and occurring integers."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for block in _encode(batch, dims):
                yield pa.RecordBatch.from_pydict(block)

    return rows.mapInArrow(run, _BLOCKS)


def _read(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], pa.Array]]:
    """Places, occurring integers per dimension and ids of every block."""
    for r in range(batch.num_rows):
        ids, places, starts, integers = (batch.column(c)[r] for c in ("ids", "places", "starts", "integers"))
        cuts, values = starts.values.to_numpy(), integers.values.to_numpy()
        held = np.frombuffer(places.as_py(), np.uint16).reshape(dims, -1)
        yield held, [values[cuts[d] : cuts[d + 1]] for d in range(dims)], ids.values


def nearest(places: np.ndarray, integers: Sequence[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (ties: the smaller number) and squared distance of every vector of a block."""
    total = np.zeros((places.shape[1], len(centroids)), np.int64)
    for d, values in enumerate(integers):
        table = (values[:, None] - centroids[None, :, d]) ** 2
        total += table[places[d]]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _sums(held: DataFrame, centroids: Centroids, dims: int) -> list:
    """(cluster, place, n, total) of the vectors of every cluster; `dims` rows a cluster."""
    points = np.array(centroids, np.int64)

    def run(batches: Batches) -> Batches:
        n, sums = np.zeros(len(points), np.int64), np.zeros(points.shape, np.int64)
        for batch in batches:
            for places, integers, _ in _read(batch, dims):
                cluster, _ = nearest(places, integers, points)
                n += np.bincount(cluster, minlength=len(points))
                for d, values in enumerate(integers):
                    cell = np.bincount(cluster * len(values) + places[d], minlength=len(points) * len(values))
                    sums[:, d] += cell.reshape(len(points), -1) @ values
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_pydict(
                {"cluster": used.astype(np.int32), "n": n[used], "sums": list(sums[used])}
            )

    partial = held.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    cells = partial.select("cluster", "n", F.posexplode("sums").alias("place", "part"))
    wide = "decimal(38,0)"
    return cells.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast(wide)).alias("total")).collect()


def assigned(held: DataFrame, centroids: Centroids, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    points = np.array(centroids, np.int64).reshape(len(centroids), dims)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for places, integers, ids in _read(batch, dims):
                cluster, distance = nearest(places, integers, points)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

    return held.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> tuple[DataFrame, Centroids]:
    """Rows (vec_id, cluster, distance) for every vector that takes part, and the final centroids.

    Each round moves every centroid that has vectors to their componentwise floor(sum / count),
    taken exactly. An empty table, or one without a vector that takes part, gives no rows and no
    centroids. Rows of vectors without any id at all have no centroid to go to and give none.
    """
    rows = quantised(vectors, scale, dims)
    held = written(blocks(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "v"), dims), "clusters")
    centroids = starting_centroids(rows, k)
    if not centroids:
        return held.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), []
    for _ in range(rounds):
        for r in _sums(held, centroids, dims):
            centroids[r.cluster][r.place] = int(r.total) // r.n
    return assigned(held, centroids, dims), centroids


def clusters_with_inertia(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> DataFrame:
    """`clustered` with the inertia of each cluster and of all, and a hash of each centroid.

    Columns: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.
    """
    rows, centroids = clustered(vectors, k, rounds, scale, dims)
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(wide.alias("total")).collect()}
    whole = sum(inertia.values())
    named = [
        (c, inertia[c], whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in sorted(inertia)
    ]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    # one row per centroid
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(named, schema)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
