"""Training many models over one table.

A *model* is a ``(cluster, split)`` pair: it trains on the rows of its cluster
outside the split's test part. All models share each pass over the table; a task
adds its rows into model-sized arrays, and only those arrays travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Split flags travel as the bits of one BIGINT.
MAX_SPLITS = 62
#: Up to this many partial results are added on the driver instead of by a shuffle.
MERGE_TASKS = 4

ModelId = tuple[int, int]


@dataclass
class ModelTable:
    """``<cluster, label (class position), test (bit per split), columns..>``."""

    rows: DataFrame
    columns: list[str]
    classes: list[int]
    clusters: list[int]
    n_splits: int

    @cached_property
    def tasks(self) -> int:
        return self.rows.rdd.getNumPartitions()

    @property
    def models(self) -> list[ModelId]:
        return [(c, s) for c in self.clusters for s in range(self.n_splits)]


def _test_bits(flags: str | None, n_splits: int) -> Column:
    bits = F.lit(0).cast("bigint")
    for s in range(n_splits if flags else 0):
        bits = bits.bitwiseOR(F.when(F.col(flags)[s], F.lit(1 << s)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def model_table(
    df: DataFrame, values: Sequence[Column], label: str, classes: list[int], cluster: str | None, clusters: list[int],
    flags: str | None, n_splits: int, carry: Sequence[str] = (),
) -> ModelTable:
    """Narrow, purely numeric training table; ``flags`` names an ``ARRAY<BOOLEAN>`` of test parts, ``carry`` BIGINT columns to keep."""
    if n_splits > MAX_SPLITS:
        raise ValueError(f"at most {MAX_SPLITS} splits")
    position = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("int")) - 1
    names = [f"f{i}" for i in range(len(values))]
    rows = df.select(
        (F.col(cluster) if cluster else F.lit(0)).cast("int").alias("cluster"),
        position.cast("int").alias("label"),
        _test_bits(flags, n_splits).alias("test"),
        *[v.cast("double").alias(n) for v, n in zip(values, names)],
        *carry,
    )
    return ModelTable(rows, names, classes, clusters, n_splits)


def distinct_classes(df: DataFrame, label: str, limit: int = 1000) -> list[int]:
    found = df.select(F.col(label).cast("int").alias("c")).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{label!r} has more than {limit} distinct values")
    return sorted(row[0] for row in found)


def uniform(rows: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) per row id, the same in every task and attempt."""
    h = rows.astype(np.int64).view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54


def split_batch(pdf: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cluster, label, test = (pdf[c].to_numpy() for c in ("cluster", "label", "test"))
    return cluster, label, test, pdf[columns].to_numpy()


def in_training(model: ModelId, cluster: np.ndarray, test: np.ndarray) -> np.ndarray:
    return (cluster == model[0]) & ((test >> model[1]) & 1 == 0)


def summed(
    table: ModelTable, models: list[ModelId], size: int, add: Callable[[dict[ModelId, np.ndarray], pd.DataFrame], None]
) -> dict[ModelId, np.ndarray]:
    """Add up one array of ``size`` numbers per model over all rows.

    The driver receives ``models × size`` numbers, merged by a shuffle first
    when many tasks contribute.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {m: np.zeros(size) for m in models}
        for pdf in batches:
            if len(pdf):
                add(sums, pdf)
        flat = np.concatenate([sums[m] for m in models])
        used = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": used, "v": flat[used]})

    parts = table.rows.mapInPandas(partial, "cell BIGINT, v DOUBLE")
    if table.tasks > MERGE_TASKS:
        parts = parts.groupBy("cell").agg(F.sum("v").alias("v"))
    found = parts.toArrow()
    flat = np.bincount(found["cell"].to_numpy(), weights=found["v"].to_numpy(), minlength=len(models) * size)
    return dict(zip(models, flat.reshape(len(models), size)))


def test_outcomes(table: ModelTable, predict: dict[ModelId, Callable[[np.ndarray], np.ndarray]]) -> list[tuple]:
    """``(cluster, split, label, prediction, n)`` over the test rows of every model, in one pass."""
    k, columns = len(table.classes), table.columns

    def add(sums: dict[ModelId, np.ndarray], pdf: pd.DataFrame) -> None:
        cluster, label, test, values = split_batch(pdf, columns)
        for m, vote in predict.items():
            rows = (cluster == m[0]) & ((test >> m[1]) & 1 == 1)
            if rows.any():
                sums[m] += np.bincount(label[rows] * k + vote(values[rows]), minlength=k * k)

    counts = summed(table, list(predict), k * k, add)
    return [
        (m[0], m[1], table.classes[cell // k], table.classes[cell % k], int(n))
        for m, cells in counts.items()
        for cell, n in enumerate(cells)
        if n
    ]


def vector_table(df: DataFrame, features: str, label: str) -> ModelTable:
    """One cluster and one split over a vector column: every row trains."""
    classes = distinct_classes(df, label)
    width = len(df.select(features).first()[0])
    values = df.select(F.col(label), vector_to_array(features).alias("__v"))
    return model_table(values, [F.col("__v")[i] for i in range(width)], label, classes, None, [0], None, 1)
