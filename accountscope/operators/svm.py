"""Linear support vector machines with squared hinge loss, for many training sets at once.

``min ½‖w‖² + C·Σ max(0, 1 − y·(w·x))²`` with the intercept as one more weight.
The objective is smooth and its curvature is a features² matrix, so a Newton
step needs one pass over the table; about ten passes settle all models together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountscope.operators import many
from accountscope.operators.many import ModelId, ModelTable
from accountscope.session import compact

SMALLEST_STEP = 1e-6


@dataclass
class LinearMargin:
    """Class 1 where ``coefficients·x + intercept > 0``."""

    coefficients: np.ndarray
    intercept: float
    objective: float
    #: Whether the gradient became small before the steps ran out.
    settled: bool = True

    def vote(self, values: np.ndarray) -> np.ndarray:
        return (values @ self.coefficients + self.intercept > 0).astype(int)


def _column_moments(table: ModelTable, models: list[ModelId]) -> dict[ModelId, tuple[np.ndarray, np.ndarray]]:
    """Mean and population standard deviation of every column over each model's training rows."""
    columns = table.columns
    f = len(columns)

    def add_sums(sums: dict[ModelId, np.ndarray], pdf: pd.DataFrame) -> None:
        cluster, _, test, x = many.split_batch(pdf, columns)
        for m in models:
            rows = many.in_training(m, cluster, test)
            sums[m] += np.append(x[rows].sum(axis=0), rows.sum())

    totals = many.summed(table, models, f + 1, add_sums)
    means = {m: s[:f] / max(s[f], 1) for m, s in totals.items()}

    def add_squares(sums: dict[ModelId, np.ndarray], pdf: pd.DataFrame) -> None:
        cluster, _, test, x = many.split_batch(pdf, columns)
        for m in models:
            away = x[many.in_training(m, cluster, test)] - means[m]
            sums[m] += (away * away).sum(axis=0)

    deviations = {m: np.sqrt(s / max(totals[m][f], 1)) for m, s in many.summed(table, models, f, add_squares).items()}
    return {m: (means[m], np.where(sd > 1e-12, sd, 1.0)) for m, sd in deviations.items()}


def _pass(table: ModelTable, c: dict[ModelId, float], w: dict[ModelId, np.ndarray], scale: dict) -> dict:
    """Objective, gradient and curvature of every model at its own weights."""
    columns = table.columns
    d = len(columns) + 1

    def add(sums: dict[ModelId, np.ndarray], pdf: pd.DataFrame) -> None:
        cluster, label, test, x = many.split_batch(pdf, columns)
        for m in w:
            rows = many.in_training(m, cluster, test)
            if not rows.any():
                continue
            mean, sd = scale[m]
            z = np.column_stack([(x[rows] - mean) / sd, np.ones(int(rows.sum()))])
            y = 2.0 * label[rows] - 1
            short = 1 - y * (z @ w[m])
            z, y, short = z[short > 0], y[short > 0], short[short > 0]
            sums[m][0] += (short * short).sum()
            sums[m][1 : d + 1] -= 2 * (short * y) @ z
            sums[m][d + 1 :] += 2 * (z.T @ z).ravel()

    state = {}
    for m, s in many.summed(table, sorted(w), 1 + d + d * d, add).items():
        objective = 0.5 * w[m] @ w[m] + c[m] * s[0]
        state[m] = objective, w[m] + c[m] * s[1 : d + 1], np.eye(d) + c[m] * s[d + 1 :].reshape(d, d)
    return state


def fit_margins(
    table: ModelTable, c: float | dict[ModelId, float] = 1.0, max_iter: int = 100, tol: float = 1e-6, standardise: bool = True
) -> dict[ModelId, LinearMargin]:
    """Newton steps with halving until every model's gradient is small; one job per step.

    A model that ``max_iter`` or the smallest step ends before has ``settled=False``.
    """
    if len(table.classes) != 2:
        raise ValueError(f"two classes are needed, found {table.classes}")
    models, d = table.models, len(table.columns) + 1
    penalty = c if isinstance(c, dict) else dict.fromkeys(models, c)
    flat = np.zeros(d - 1), np.ones(d - 1)
    scale = _column_moments(table, models) if standardise else dict.fromkeys(models, flat)
    accepted = {m: np.zeros(d) for m in models}
    state = _pass(table, penalty, accepted, scale)
    first = {m: max(np.linalg.norm(state[m][1]), 1e-12) for m in models}
    step = dict.fromkeys(models, 1.0)
    still_open = {m for m in models if np.linalg.norm(state[m][1]) > tol * first[m]}
    stuck: set[ModelId] = set()
    for _ in range(max_iter):
        if not still_open:
            break
        direction = {m: -np.linalg.solve(state[m][2], state[m][1]) for m in still_open}
        trial = {m: accepted[m] + step[m] * direction[m] for m in still_open}
        seen = _pass(table, penalty, trial, scale)
        for m in list(still_open):
            slope = float(state[m][1] @ direction[m])
            if seen[m][0] <= state[m][0] + 1e-4 * step[m] * slope:
                accepted[m], state[m], step[m] = trial[m], seen[m], 1.0
                if np.linalg.norm(state[m][1]) <= tol * first[m]:
                    still_open.discard(m)
            else:
                step[m] /= 2
                if step[m] < SMALLEST_STEP:
                    still_open.discard(m)
                    stuck.add(m)
    found = {}
    for m in models:
        mean, sd = scale[m]
        coefficients = accepted[m][:-1] / sd
        found[m] = LinearMargin(coefficients, float(accepted[m][-1] - coefficients @ mean), float(state[m][0]), m not in still_open | stuck)
    return found


class _SvmParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter):
    c = Param(Params._dummy(), "c", "penalty on margin violations", TypeConverters.toFloat)
    standardise = Param(Params._dummy(), "standardise", "scale the columns for the fit", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(c=1.0, maxIter=1000, standardise=True)


class SquaredHingeSVC(Estimator, _SvmParams):
    """Spark ML estimator around :func:`fit_margins` for a vector column."""

    @keyword_only
    def __init__(
        self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction",
        c: float = 1.0, maxIter: int = 1000, standardise: bool = True,
    ) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _train(self, df: DataFrame, wanted: list[tuple[float, int]]) -> list[SquaredHingeModel]:
        """One model per (penalty, steps). All penalties share every pass; models that settled serve all step limits."""
        table = many.vector_table(df, self.getFeaturesCol(), self.getLabelCol())
        table.rows = compact(table.rows, df.count()).persist()
        try:
            penalties = sorted({c for c, _ in wanted})
            # A split without test rows for each penalty: every model trains on all rows.
            shared = replace(table, n_splits=len(penalties))
            by_id = {(0, i): c for i, c in enumerate(penalties)}
            found: dict[tuple[float, int], LinearMargin] = {}
            for steps in sorted({n for _, n in wanted}):
                done = all(m.settled for m in found.values()) if found else False
                if not done:
                    fitted = fit_margins(shared, by_id, steps, standardise=self.getOrDefault(self.standardise))
                    last = {c: fitted[m] for m, c in by_id.items()}
                found.update({(c, steps): last[c] for c in penalties})
        finally:
            table.rows.unpersist()
        return [self._copyValues(SquaredHingeModel(found[point], table.classes)) for point in wanted]

    def _fit(self, df: DataFrame) -> SquaredHingeModel:
        return self._train(df, [(self.getOrDefault(self.c), self.getMaxIter())])[0]

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]):
        """All points of a grid over penalties and step limits in shared passes."""
        if not all(set(pm) <= {self.c, self.maxIter} for pm in paramMaps):
            return super().fitMultiple(dataset, paramMaps)
        wanted = [(pm.get(self.c, self.getOrDefault(self.c)), pm.get(self.maxIter, self.getMaxIter())) for pm in paramMaps]
        return iter(list(enumerate(self._train(dataset, wanted))))


class SquaredHingeModel(Model, _SvmParams):
    def __init__(self, margin: LinearMargin | None = None, classes: Sequence[int] = (0, 1)) -> None:
        super().__init__()
        self.margin, self.classes = margin, list(classes)

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.margin.coefficients])
        products = F.zip_with(vector_to_array(self.getFeaturesCol()), weights, lambda x, w: x * w)
        margin = F.aggregate(products, F.lit(self.margin.intercept), lambda acc, p: acc + p)
        low, high = (F.lit(float(c)) for c in self.classes)
        return df.withColumn(self.getPredictionCol(), F.when(margin > 0, high).otherwise(low))
