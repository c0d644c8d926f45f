"""Non-negative factorisation of a document-term weight table.

``X ≈ W·H`` with ``X`` kept as one sparse row per document and ``H`` (topics ×
pruned vocabulary) as the model. For a fixed ``H`` every row of ``W`` is its own
small convex problem, solved where the row lives; what travels is ``WᵀX`` and
``WᵀW``, summed per term. ``W`` is never stored between rounds, so the loop has
no growing lineage.

``H`` starts from a singular value decomposition: passes over the documents turn
a small random basis of the terms into the leading right singular vectors, and of
each pair of vectors the side, positive or negative, that weighs more is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountscope.session import compact

SWEEPS = 60
#: Directions kept beside the wanted ones while the leading singular vectors are looked for.
SPARE_DIRECTIONS = 10
#: Entries of a start below this are zero.
NEGLIGIBLE = 1e-6
DOCUMENTS_PER_TASK = 5_000


@dataclass
class NmfModel:
    vocabulary: list[str]
    components: np.ndarray
    l1: float
    l2: float
    objective: list[float]
    #: Whether the objective settled before the rounds ran out.
    settled: bool


def sparse_rows(weights: DataFrame, vocabulary: list[str], key: str = "user_id") -> DataFrame:
    """``<key, terms ARRAY<INT>, values ARRAY<DOUBLE>>``; a row has at most as many entries as the vocabulary."""
    names = weights.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i INT, term STRING")
    entry = F.struct("i", "weight")
    rows = weights.join(F.broadcast(names), "term").groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return rows.select(key, F.col("e.i").alias("terms"), F.col("e.weight").alias("values"))


def _flatten(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = pdf["terms"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(pdf)), lengths)
    return rows, np.concatenate(pdf["terms"].to_numpy()), np.concatenate(pdf["values"].to_numpy())


def _solve_rows(h: np.ndarray, l1: float, l2: float, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Coordinate descent for ``min ½‖x − wH‖² + l1·Σw + ½·l2·‖w‖²`` with ``w ≥ 0``, all rows at once."""
    k = h.shape[0]
    gram = h @ h.T + l2 * np.eye(k)
    pull = np.column_stack([np.bincount(rows, weights=values * h[j, terms], minlength=n) for j in range(k)]) - l1
    w = np.zeros((n, k))
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(k):
            if gram[j, j] <= 0:
                continue
            new = np.maximum(0.0, w[:, j] + (pull[:, j] - w @ gram[:, j]) / gram[j, j])
            moved = max(moved, float(np.abs(new - w[:, j]).max(initial=0.0)))
            w[:, j] = new
        if moved < 1e-10:
            break
    return w


def _summed(data: DataFrame, size: int, width: int, add: Callable[[np.ndarray, tuple, int], None]) -> np.ndarray:
    """The ``size × width`` table to which ``add(table, entries, n)`` adds every batch of ``n`` documents."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((size, width))
        for pdf in batches:
            if len(pdf):
                add(sums, _flatten(pdf), len(pdf))
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        out = {"row": used.astype("int32")}
        out.update({f"c{j}": sums[used, j] for j in range(width)})
        yield pd.DataFrame(out)

    schema = "row INT, " + ", ".join(f"c{j} DOUBLE" for j in range(width))
    found = data.select("terms", "values").mapInPandas(partial, schema).groupBy("row").agg(
        *[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]
    ).toArrow()
    total = np.zeros((size, width))
    total[found["row"].to_numpy()] = np.column_stack([found[f"c{j}"].to_numpy() for j in range(width)])
    return total


def _round_sums(data: DataFrame, h: np.ndarray, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``WᵀX`` (topics × terms), ``WᵀW`` and the column sums of ``W``."""
    k, v = h.shape
    shared = data.sparkSession.sparkContext.broadcast(h)

    def add(sums: np.ndarray, entries: tuple, n: int) -> None:
        rows, terms, values = entries
        w = _solve_rows(shared.value, l1, l2, rows, terms, values, n)
        for j in range(k):
            sums[:v, j] += np.bincount(terms, weights=values * w[rows, j], minlength=v)
        sums[v : v + k] += w.T @ w
        sums[v + k] += w.sum(axis=0)

    total = _summed(data, v + k + 1, k, add)
    shared.unpersist()
    return total[:v].T, total[v : v + k], total[v + k]


def _project(basis: np.ndarray, entries: tuple, n: int) -> np.ndarray:
    """``X·basis`` of a batch."""
    rows, terms, values = entries
    return np.column_stack([np.bincount(rows, weights=values * basis[terms, j], minlength=n) for j in range(basis.shape[1])])


def leading_directions(
    data: DataFrame, terms: int, wanted: int, passes: int = 20, tol: float = 1e-10, seed: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of the document-term table and their right vectors (as columns).

    A pass multiplies a basis by ``XᵀX`` where the documents are; only ``terms × basis`` sums travel. It ends when the
    wanted values move by less than ``tol``, relatively, or after ``passes``.
    """
    width = min(terms, wanted + SPARE_DIRECTIONS)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    last = np.zeros(wanted)
    for _ in range(passes):
        shared = data.sparkSession.sparkContext.broadcast(basis)

        def add(sums: np.ndarray, entries: tuple, n: int) -> None:
            rows, at, values = entries
            along = _project(shared.value, entries, n)
            for j in range(width):
                sums[:terms, j] += np.bincount(at, weights=values * along[rows, j], minlength=terms)
            sums[terms:] += along.T @ along

        total = _summed(data, terms + width, width, add)
        shared.unpersist()
        power, turn = np.linalg.eigh((total[terms:] + total[terms:].T) / 2)
        order = np.argsort(-power)
        values, vectors = np.sqrt(np.maximum(power[order], 0.0)), basis @ turn[:, order]
        here = np.pad(values[:wanted], (0, max(0, wanted - width)))
        if np.abs(here - last).max() <= tol * max(here.max(), 1e-300) or width == terms:
            break
        last = here
        basis = np.linalg.qr(total[:terms])[0]
    return values[:wanted], vectors[:, :wanted]


def svd_start(data: DataFrame, terms: int, topics: int, passes: int = 20, seed: int = 1) -> np.ndarray:
    """A non-negative start for ``H`` from the leading singular vectors; topics beyond the rank start, and stay, empty.

    The first vector is taken without its sign. Of every other one the positive or the negative part is kept, whichever
    has the larger product of lengths on the side of the terms and of the documents; the sign of a vector plays no part.
    """
    values, vectors = leading_directions(data, terms, topics, passes, seed=seed)
    rank = int((values > 1e-10 * max(values.max(initial=0.0), 1e-300)).sum())
    values, vectors = values[:rank], vectors[:, :rank]
    shared = data.sparkSession.sparkContext.broadcast(vectors)

    def add(sums: np.ndarray, entries: tuple, n: int) -> None:
        along = _project(shared.value, entries, n)
        sums[0] += (np.maximum(along, 0) ** 2).sum(axis=0)
        sums[1] += (np.minimum(along, 0) ** 2).sum(axis=0)

    h = np.zeros((topics, terms))
    if rank:
        lengths = np.sqrt(_summed(data, 2, rank, add)) / values
        h[0] = np.sqrt(values[0]) * np.abs(vectors[:, 0])
        for j in range(1, rank):
            sides = np.maximum(vectors[:, j], 0), np.maximum(-vectors[:, j], 0)
            norms = [float(np.linalg.norm(side)) for side in sides]
            weights = [norms[i] * lengths[i, j] for i in (0, 1)]
            best = int(weights[1] > weights[0])
            if weights[best] > 0:
                h[j] = np.sqrt(values[j] * weights[best]) * sides[best] / norms[best]
    shared.unpersist()
    h[h < NEGLIGIBLE] = 0.0
    return h


def _solve_components(h: np.ndarray, wtx: np.ndarray, wtw: np.ndarray, l1: float, l2: float) -> np.ndarray:
    h = h.copy()
    gram = wtw + l2 * np.eye(len(wtw))
    for _ in range(SWEEPS):
        for j in range(len(h)):
            if gram[j, j] > 0:
                h[j] = np.maximum(0.0, h[j] + (wtx[j] - l1 - gram[j] @ h) / gram[j, j])
    return h


def nmf_fit(
    weights: DataFrame,
    vocabulary: list[str],
    topics: int = 10,
    alpha: float = 0.1,
    l1_ratio: float = 0.5,
    max_iter: int = 200,
    tol: float = 1e-4,
    seed: int = 1,
    key: str = "user_id",
    init: str = "svd",
) -> NmfModel:
    """Alternate exact row solutions with a component update until the objective settles, or ``max_iter`` is reached.

    ``init="svd"`` starts from the leading singular vectors, ``"random"`` from a random table under ``seed``.
    """
    if init not in ("svd", "random"):
        raise ValueError("init must be 'svd' or 'random'")
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    rows = sparse_rows(weights, vocabulary, key)
    data = compact(rows, weights.select(key).distinct().count(), DOCUMENTS_PER_TASK).persist()
    try:
        squares = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
        sums = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
        n, xx, x = data.agg(F.count(F.lit(1)), F.sum(squares), F.sum(sums)).first()
        if not n:
            raise ValueError("no document has a kept term")
        if init == "svd":
            h = svd_start(data, len(vocabulary), topics, seed=seed)
        else:
            scale = np.sqrt(x / (n * len(vocabulary)) / topics)
            h = np.abs(np.random.default_rng(seed).standard_normal((topics, len(vocabulary)))) * scale
        objective: list[float] = []
        settled = False
        for _ in range(max_iter):
            wtx, wtw, w_sum = _round_sums(data, h, l1, l2)
            fit = xx - 2 * float((wtx * h).sum()) + float((wtw * (h @ h.T)).sum())
            penalty = l1 * float(w_sum.sum() + h.sum()) + 0.5 * l2 * float(np.trace(wtw) + (h * h).sum())
            objective.append(0.5 * fit + penalty)
            if len(objective) > 1 and objective[-2] - objective[-1] < tol * objective[0]:
                settled = True
                break
            h = _solve_components(h, wtx, wtw, l1, l2)
        return NmfModel(list(vocabulary), h, l1, l2, objective, settled)
    finally:
        data.unpersist()


def nmf_transform(model: NmfModel, weights: DataFrame, key: str = "user_id") -> DataFrame:
    """``<key, w ARRAY<DOUBLE>>`` for documents with at least one kept term."""
    rows = sparse_rows(weights, model.vocabulary, key)
    shared = weights.sparkSession.sparkContext.broadcast(model.components)
    l1, l2 = model.l1, model.l2

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                w = _solve_rows(shared.value, l1, l2, *_flatten(pdf), len(pdf))
                yield pd.DataFrame({key: pdf[key], "w": list(w)})

    schema = T.StructType([rows.schema[key], T.StructField("w", T.ArrayType(T.DoubleType()))])
    return rows.mapInPandas(solve, schema)


def component_weights(weights_session: DataFrame, model: NmfModel) -> DataFrame:
    """``<topic, term, weight>`` of a fitted model."""
    k, v = model.components.shape
    rows = pa.table({
        "topic": pa.array(np.repeat(np.arange(k, dtype="int32"), v)),
        "term": pa.array(model.vocabulary * k, pa.string()),
        "weight": pa.array(model.components.ravel()),
    })
    return weights_session.sparkSession.createDataFrame(rows)
