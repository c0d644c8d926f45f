"""Integer k-means with a rotated filter: leading principal coordinates and a residual norm bound every distance.

Vectors become integers once. Their principal directions come from one aggregate of second moments over all of them;
every vector is then stored with its leading rotated coordinates and the norm of what they leave. For a vector and a
centroid, the squared distance of the leading coordinates plus the squared difference of the residual norms is never
more than their squared distance. Only centroids whose bound does not exceed the best distance found so far are
compared in full, in integers, so clusters and distances are exact whatever the rotation is.

A round is one pass of numpy over the stored table; per task, cluster sums of fixed size travel. No row is grouped by
cluster, so a cluster with a third of all vectors is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountscope.session import materialise

#: Magnitude of components from which squared distances might leave 64 bits.
LARGEST = 1 << 27
LONG_MAX = (1 << 63) - 1
#: Relative error allowed to bounds that are computed in doubles; they err by some 1e-13.
SLACK = 1e-9


@dataclass(frozen=True)
class CentroidConfig:
    """k centroids, ``rounds`` updates, vectors of ``dims`` components times ``scale``; ``lead`` rotated coordinates are kept."""

    k: int = 8
    rounds: int = 10
    dims: int = 64
    scale: int = 1024
    lead: int = 8
    tag: str = "3:"


@dataclass(frozen=True)
class Rotation:
    mean: np.ndarray
    basis: np.ndarray

    def __call__(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the norm of the rest."""
        x = q - self.mean
        lead = x @ self.basis
        return lead, np.sqrt(((x - lead @ self.basis.T) ** 2).sum(axis=1))


def integers(vectors: DataFrame, cfg: CentroidConfig, id_col: str, vector_col: str) -> DataFrame:
    """``id, q``: the vectors with exactly ``dims`` finite components, as integers."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(v, lambda x: F.floor(x * F.lit(float(cfg.scale))))
    kept = vectors.where((F.size(v) == cfg.dims) & fine).select(F.col(id_col).alias("id"), q.alias("q"))
    wide = F.exists("q", lambda x: (x >= LARGEST) | (x <= -LARGEST))
    return kept.select("id", F.when(wide, F.raise_error(F.lit("a component is too large for 64-bit distances"))).otherwise(F.col("q")).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added(parts: DataFrame) -> dict[int, object]:
    """Sums by cell: a table whose size depends on the model alone."""
    return {r["cell"]: r["v"] for r in parts.groupBy("cell").agg(F.sum("v").alias("v")).collect()}


def rotation(data: DataFrame, cfg: CentroidConfig) -> Rotation:
    """Principal directions of all vectors (column q), from one aggregate of their moments."""
    d = cfg.dims

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1))
        for batch in batches:
            q = _matrix(batch.column("q"), d).astype(float)
            x = np.hstack([np.ones((len(q), 1)), q])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    cells = _added(data.select("q").mapInArrow(moments, "cell bigint, v double"))
    total = np.array([cells.get(i, 0.0) for i in range((d + 1) ** 2)]).reshape(d + 1, d + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    _, directions = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(directions[:, ::-1][:, : cfg.lead]))


def rotated(data: DataFrame, turn: Rotation, cfg: CentroidConfig) -> DataFrame:
    """``id, q, lead, rest`` of every vector."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = turn(_matrix(batch.column("q"), cfg.dims))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lead.size + 1, lead.shape[1], dtype=np.int32)), pa.array(lead.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), lists, pa.array(rest)], names=["id", "q", "lead", "rest"])

    id_type = data.schema["id"].dataType.simpleString()
    return data.mapInArrow(store, f"id {id_type}, q array<bigint>, lead array<double>, rest double")


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, turn: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (the smaller of equals), its squared distance, and how many exact distances that took."""
    c_lead, c_rest = turn(centroids)
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
    size = (lead * lead).sum(axis=1) + rest * rest
    bound -= SLACK * (1 + size[:, None] + ((c_lead * c_lead).sum(axis=1) + c_rest * c_rest)[None])
    own = bound.argmin(axis=1)
    best = ((q - centroids[own]) ** 2).sum(axis=1)
    first, exact = own.copy(), len(q)
    for j in range(len(centroids)):
        rows = np.flatnonzero((bound[:, j] <= best) & (first != j))
        exact += len(rows)
        d = ((q[rows] - centroids[j]) ** 2).sum(axis=1)
        better = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
        own[rows[better]], best[rows[better]] = j, d[better]
    return own, best, exact


def _read(batch: pa.RecordBatch, cfg: CentroidConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest = batch.column("rest").to_numpy(zero_copy_only=False)
    return _matrix(batch.column("q"), cfg.dims), _matrix(batch.column("lead"), min(cfg.lead, cfg.dims)), rest


def _summed(data: DataFrame, centroids: np.ndarray, turn: Rotation, cfg: CentroidConfig) -> tuple[list[list[int]], list[int], list[int]]:
    """Per centroid: componentwise sum of its vectors, their number, and the sum of their squared distances, all exact."""
    k, d = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 3), np.int64)
        for batch in batches:
            q, lead, rest = _read(batch, cfg)
            own, best, _ = nearest(q, lead, rest, centroids, turn)
            for j in range(k):
                here = own == j
                total[j, :d] += q[here].sum(axis=0)
                # Distances in two halves, so that no sum of a task leaves 64 bits.
                total[j, d:] += here.sum(), (best[here] >> 32).sum(), (best[here] & 0xFFFFFFFF).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    cells = _added(data.select("q", "lead", "rest").mapInArrow(partial, "cell bigint, v bigint").withColumn("v", F.col("v").cast("decimal(38,0)")))
    rows = [[int(cells.get(j * (d + 3) + i, 0)) for i in range(d + 3)] for j in range(k)]
    return [r[:d] for r in rows], [r[d] for r in rows], [(r[d + 1] << 32) + r[d + 2] for r in rows]


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, cfg: CentroidConfig | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` per kept vector, and the centroids.

    Vectors of another length, NULL, or with a NULL or non-finite component are left out. Centroids start as the ``k``
    kept vectors with the smallest SHA-256 of ``tag`` and id (equal ones by components, NULL ids last); fewer vectors
    give fewer centroids, none an empty result. Repeated rows count each. Components of 2**27 and more, whose distances
    need not fit 64 bits, are an error. Other columns are ignored.
    """
    cfg = cfg or CentroidConfig()
    if cfg.dims < 1 or cfg.lead < 1 or cfg.k < 1:
        raise ValueError("dims, lead and k must be 1 or more")
    whole = integers(vectors, cfg, id_col, vector_col)
    turn = rotation(whole, cfg)
    data = materialise(rotated(whole, turn, cfg), "rotated-vectors")
    by_hash = F.sha2(F.concat(F.lit(cfg.tag), F.col("id").cast("string")), 256).asc_nulls_last()
    start = data.select("id", "q").orderBy(by_hash, "q").limit(cfg.k).collect()
    centroids = np.array([r["q"] for r in start], np.int64).reshape(-1, cfg.dims)
    id_type = data.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids
    for _ in range(cfg.rounds):
        sums, counts, _ = _summed(data, centroids, turn, cfg)
        centroids = np.array([[s // n for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, centroids)], np.int64)
    _, _, inertia = _summed(data, centroids, turn, cfg)
    if sum(inertia) > LONG_MAX:
        raise OverflowError("the inertia leaves 64 bits")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, best, _ = nearest(*_read(batch, cfg), centroids, turn)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.astype(np.int32)), pa.array(best)], names=["id", "cluster", "distance"])

    def by_cluster(values: list) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    placed = data.mapInArrow(place, f"id {id_type}, cluster int, distance bigint")
    return placed.select(
        F.col("id").alias(id_col), "cluster", "distance", by_cluster(inertia).cast("bigint").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"), by_cluster([_digest(c) for c in centroids]).alias("centroid_sha256")), centroids
