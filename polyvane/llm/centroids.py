"""Centroid clustering on whole numbers: float32 screening with rounding-error intervals, exact integers where intervals overlap.

Each round multiplies blocks of vectors with the centroids in float32. For every vector and centroid a bound on the error of that product is known
(gamma_n * |x| * |c|, for any order of summation), so |c|^2 - 2 x.c lies in an interval. Centroids whose interval starts above the smallest upper end
can't be nearest; if more than one is left, their squared distances are computed in integers and the lowest number wins ties. Results are those
of exact arithmetic throughout.

Tasks add up their vectors by cluster and emit one row a (cluster, component); so a cluster that holds a third of all vectors costs no more than
others, and what comes to the driver in a round is k times dims sums, however many vectors there are.

Defined cases: vectors that are null, of another size, or with a null or non-finite component are left out; a null id is clustered like any
other, but starts no centroid; rows that repeat an id are vectors of their own, as starts ordered by their packed bytes; fewer vectors than k give
so many centroids; an empty table gives an empty result; components beyond 2 ** 53 count as 2 ** 53, and a distance or inertia beyond a long is the
largest long, while comparisons stay exact; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvane.llm.vectors import WIDE, chunks, clean, matrix
from polyvane.llm.work import Work

LONG = (1 << 63) - 1
#: Unit roundoff of float32.
U32 = 2.0 ** -24


def screen(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest of each row: True wherever the interval of its squared distance meets the lowest upper end."""
    n = x.shape[1] + 2
    gamma = n * U32 / (1 - n * U32)
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    square = (centroids * centroids).sum(axis=1)
    lengths = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt(square)[None, :] * (1 + 2.0 ** -30)
    error = 2 * gamma * lengths + (square[None, :] + 2 * lengths) * n * 2.0 ** -51
    middle = square[None, :] - 2 * product
    return middle - error <= (middle + error).min(axis=1)[:, None]


def _exact(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows; in Python integers where 64 bits might not hold them."""
    top = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * top * top * x.shape[1] < 2.0 ** 62:
        difference = x.astype(np.int64) - centroids.astype(np.int64)
        return (difference * difference).sum(axis=1)
    out = np.empty(len(x), object)
    for k, (a, b) in enumerate(zip(x.tolist(), centroids.tolist(), strict=True)):
        out[k] = sum((int(p) - int(q)) ** 2 for p, q in zip(a, b, strict=True))
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row (ties: the lowest), and its squared distance, exactly."""
    narrow = np.abs(centroids).max(initial=0) < WIDE
    near = np.ones((len(x), len(centroids)), bool)
    small = np.flatnonzero(np.abs(x).max(axis=1, initial=0) < WIDE) if narrow else np.zeros(0, np.int64)
    near[small] = screen(x[small], centroids)
    label = near.argmax(axis=1)
    row, number = np.nonzero(near & (near.sum(axis=1) > 1)[:, None])
    if len(row):
        distance = _exact(x[row], centroids[number])
        start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(distance, start)
        first = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(start, len(row)))))
        owner, at = np.unique(row[first], return_index=True)  # numbers ascend within a row
        label[owner] = number[first[at]]
    return label, _exact(x, centroids[label])


def _sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, dim, n, total) of the vectors nearest to each centroid, added up within tasks."""
    k, dims = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for batch in batches:
            for part in chunks(batch, "x"):
                x = matrix(part.column(0), dims)
                label, _ = nearest(x, centroids)
                if np.abs(x).max(initial=0) < WIDE:
                    total += ((label[None, :] == np.arange(k)[:, None]).astype(np.float64) @ x).astype(np.int64)
                else:
                    for c, v in zip(label.tolist(), x.tolist(), strict=True):
                        total[c] += np.array([int(p) for p in v], object)
                count += np.bincount(label, minlength=k)
        some = np.flatnonzero(count)
        sums = pa.array([str(v) for v in total[some].reshape(-1)], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, dims), pa.int32()), pa.array(np.tile(np.arange(dims), len(some)), pa.int32()),
                                          pa.array(np.repeat(count[some], dims)), sums], ["cluster", "dim", "n", "total"])

    parts = rows.select("x").mapInArrow(run, "cluster int, dim int, n long, total string")
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def _assigned(rows: DataFrame, centroids: np.ndarray, vec_id: str) -> DataFrame:
    """Each vector's id, cluster and squared distance."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "x"):
                label, distance = nearest(matrix(part.column(1), centroids.shape[1]), centroids)
                distance = np.minimum(distance, LONG).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label, pa.int32()), pa.array(distance)], [vec_id, "cluster", "distance"])

    kind = rows.schema[vec_id].dataType.simpleString()
    return rows.select(vec_id, "x").mapInArrow(run, f"`{vec_id}` {kind}, cluster int, distance long")


def centroid_clusters(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, salt: str = "2:", vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector that takes part: its id, cluster, distance (squared), cluster_inertia, inertia and centroid (components as whole numbers).

    Centroids start as the k vectors with the smallest SHA-256 of salt and id; each round assigns and replaces every centroid that has vectors by
    floor(sum / count).
    """
    work = Work(vectors.sparkSession, "centroids")
    rows = work.table(clean(vectors.select(vec_id, embedding), embedding, dims), "vectors")
    starts = rows.where(F.col(vec_id).isNotNull()).select("x", F.sha2(F.concat(F.lit(salt), F.col(vec_id).cast("string")), 256).alias("h"))
    first = [np.frombuffer(r["x"], np.float64) for r in starts.orderBy("h", "x").limit(k).collect()]
    centroids = np.array(first, np.float64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        table = _sums(rows, centroids).toArrow()
        centroids = centroids.copy()
        for c, d, n, total in zip(*(table[name].to_pylist() for name in ("cluster", "dim", "n", "total")), strict=True):
            centroids[c, d] = float(int(total) // n)
    if not len(first):
        return rows.select(vec_id).where("false").selectExpr("*", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "cast(array() AS array<bigint>) AS centroid")
    out = work.table(_assigned(rows, centroids, vec_id), "assigned")
    work.drop("vectors")
    # at most k rows
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = min(sum(sums.values()), LONG)
    stats = vectors.sparkSession.createDataFrame([(c, min(s, LONG), every, [int(v) for v in centroids[c]]) for c, s in sums.items()],
                                                 "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return out.join(F.broadcast(stats), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(components: list[int]) -> str:
    """SHA-256 of the components as decimal integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
