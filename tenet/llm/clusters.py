"""Centroid clustering (Lloyd's rounds) on integers, screened by block norms.

A vector's compressed form, made once, is the norms of its segments. By Cauchy and Schwarz, x.c is at most the product of the
compressed forms of vector and centroid, so |x|^2 + |c|^2 - 2 times that is never above their squared distance. Each vector is held
exactly against the centroid of least bound; of the others only those whose bound does not exceed that distance get an exact
integer distance, so ties fall as they do without the screen. Bounds are floating numbers, held back by more than their error.

Rows are staged once, with compressed forms, and read once a round; the driver keeps `clusters` centroids and gets their exact sums.

Cases: vectors that are null, of another length, or that hold null or non-finite components go; components past the range of
`vectors` are taken at its ends. A null id is hashed as an empty one. Repeated rows count each, as seeds, too; seeds of equal hash
stand in the order of their components. Fewer vectors than clusters: as many clusters as vectors. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenet.llm.common import arrow_sized, staged
from tenet.llm.vectors import digest, matrix, pack, packed, totals, whole

#: Components in a segment.
SEGMENT = 8
#: Of the norms' products: more than single-precision norms and double-precision sums can err by.
SLACK = 1e-6


def block_norms(vectors: np.ndarray) -> np.ndarray:
    """The norm of each segment of SEGMENT components (the last may be shorter)."""
    squares = vectors.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, vectors.shape[1], SEGMENT), axis=1))


def lower_bounds(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each vector and centroid a number that their squared distance is not below."""
    near = 2 * (norms.astype(np.float64) @ block_norms(centroids).T)
    of_vectors, of_centroids = (vectors**2).sum(1, dtype=np.float64), (centroids**2).sum(1, dtype=np.float64)
    both = of_vectors[:, None] + of_centroids[None, :]
    return both - near - SLACK * both


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's centroid (of equal distances, the smaller number), their squared distance, and how many distances were taken."""
    bounds, every = lower_bounds(vectors, norms, centroids), np.arange(len(vectors))
    at = bounds.argmin(1)
    best, taken = ((vectors - centroids[at]) ** 2).sum(1), len(vectors)
    bounds[every, at] = np.inf
    for c in range(len(centroids)):
        open_ = np.flatnonzero(bounds[:, c] <= best)
        d = ((vectors[open_] - centroids[c]) ** 2).sum(1)
        taken += len(open_)
        won = (d < best[open_]) | ((d == best[open_]) & (c < at[open_]))
        at[open_[won]], best[open_[won]] = c, d[won]
    return at, best, taken


def compressed(rows: DataFrame, width: int) -> DataFrame:
    """rows with `norms`."""

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("norms", pack(block_norms(matrix(batch, width)).astype(np.float32)))

    return rows.mapInArrow(norms, T.StructType([*rows.schema.fields, T.StructField("norms", T.BinaryType())]))


def seeds(rows: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors whose `salt:id` has the least sha256."""
    hashed = rows.select(F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "v")
    return np.array([r["v"] for r in hashed.orderBy("h", "v").limit(clusters).collect()], np.int64)


def cluster(spark: SparkSession, table: DataFrame, clusters: int = 8, rounds: int = 10, scale: int = 1024, width: int = 64, salt: str = "3", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each vector of `width` components."""
    arrow_sized(spark)
    rows = whole(table, vector_column, scale, {id_column: "id"}).where(F.size("v") == width)
    rows = staged(spark, compressed(rows, width), "vectors")
    centroids = seeds(rows, clusters, salt)
    segments = -(-width // SEGMENT)

    def assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vectors = matrix(batch, width)
        at, distance, _ = nearest(vectors, packed(batch, "norms", np.float32, segments), centroids)
        return vectors, at, distance

    def members(centroids: np.ndarray):
        def each(batch: pa.RecordBatch):
            vectors, at, _ = assigned(batch, centroids)
            yield at, vectors

        return each

    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for c, (n, *sums) in totals(rows, len(centroids), width, members(centroids)).items():
            centroids[c] = [s // n for s in sums]

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, distance = assigned(batch, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    out = staged(spark, rows.mapInArrow(closed, f"id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    of_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))] or [F.lit(0).cast("long")])
    hashes = F.array(*[F.lit(digest(c)) for c in centroids] or [F.lit("")])
    return out.select(F.col("id").alias(id_column), "cluster", "distance", F.get(of_cluster, "cluster").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(hashes, "cluster").alias("centroid_sha256"))
