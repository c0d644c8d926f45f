"""Boosted stumps (SAMME.R, or discrete SAMME) for many training sets at once.

The training table is binned once. A row's weight follows from the stumps found so
far, so each round ships the small model out and brings weighted class histograms
back; every few rounds the weights so far are written beside the rows. One job per
round, whatever the number of models.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountscope.operators import many
from accountscope.operators.many import ModelId, ModelTable
from accountscope.session import compact, materialise

PERCENTILE_ACCURACY = 10_000
#: Rounds after which rows' weights are written down.
STATE_ROUNDS = 8
#: Logarithms of weights are at most this, so that no weight is infinite.
LARGEST_LOG_WEIGHT = 700.0
#: Class shares are at least this before their logarithm is taken.
SMALLEST_SHARE = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Stump:
    """``left`` where ``feature <= threshold`` (bin ``<= cut``), else ``right``; classes by position.

    ``votes`` are what either side adds to every class's score, ``raises`` what a training row of every class adds to
    the logarithm of its weight there.
    """

    feature: int
    cut: int
    threshold: float
    left: int
    right: int
    alpha: float
    votes: tuple[tuple[float, ...], tuple[float, ...]]
    raises: tuple[tuple[float, ...], tuple[float, ...]]


@dataclass
class BoostedStumps:
    classes: list[int]
    stumps: list[Stump] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def staged(self, rounds: int) -> BoostedStumps:
        """The model after its first ``rounds`` rounds."""
        return BoostedStumps(self.classes, self.stumps[:rounds], self.errors[:rounds])

    def vote(self, bins: np.ndarray) -> np.ndarray:
        """Class positions for binned rows."""
        votes = np.zeros((len(bins), len(self.classes)))
        for s in self.stumps:
            votes += np.asarray(s.votes)[(bins[:, s.feature] > s.cut).astype(int)]
        return votes.argmax(axis=1)

    def predict_column(self, value_of) -> Column:
        """The vote as a column; ``value_of(i)`` is the column of feature ``i``. Ties go to the lower class."""
        votes = []
        for c in range(len(self.classes)):
            vote = F.lit(0.0)
            for s in self.stumps:
                on_left, on_right = s.votes[0][c], s.votes[1][c]
                if on_left or on_right:
                    vote = vote + F.when(value_of(s.feature) <= s.threshold, F.lit(on_left)).otherwise(F.lit(on_right))
            votes.append(vote)
        scores = F.array(*votes)
        best = F.array_position(scores, F.array_max(scores))
        return F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), best.cast("int"))


@dataclass
class BinnedTable:
    """A model table whose values are bin numbers, with the thresholds behind them."""

    table: ModelTable
    thresholds: dict[int, list[np.ndarray]]

    @property
    def width(self) -> int:
        return 1 + max((len(t) for per in self.thresholds.values() for t in per), default=0)


def feature_thresholds(table: ModelTable, max_bins: int) -> dict[int, list[np.ndarray]]:
    """Candidate thresholds per cluster and feature, from all its rows: features alone, never labels, decide them.

    Midpoints between distinct values where there are at most ``max_bins``, else between quantiles (mergeable sketches).
    """
    shares = F.array(*[F.lit(i / max_bins) for i in range(max_bins + 1)])
    wanted = [F.percentile_approx(c, shares, PERCENTILE_ACCURACY).alias(c) for c in table.columns]
    wanted += [F.approx_count_distinct(c).alias(f"{c}_n") for c in table.columns]
    sketched = table.rows.groupBy("cluster").agg(*wanted).collect()
    # Values are listed only where a sketch has seen few of them.
    few = [c for c in table.columns if any(row[f"{c}_n"] <= 2 * max_bins for row in sketched)]
    small = {(row["cluster"], c) for row in sketched for c in few if row[f"{c}_n"] <= 2 * max_bins}
    listed = {}
    if few:
        here = {c: F.col("cluster").isin([k for k, f in small if f == c]) for c in few}
        values = table.rows.groupBy("cluster").agg(*[F.collect_set(F.when(here[c], F.col(c))).alias(c) for c in few])
        listed = {(row["cluster"], c): row[c] for row in values.collect() for c in few}
    found = {}
    for row in sketched:
        cuts = []
        for c in table.columns:
            exact = listed.get((row["cluster"], c), []) if (row["cluster"], c) in small else []
            q = np.unique(np.asarray(exact if 0 < len(exact) <= max_bins else row[c] or [], dtype=float))
            cuts.append((q[:-1] + q[1:]) / 2)
        found[row["cluster"]] = cuts
    return found


def bin_table(table: ModelTable, max_bins: int = 32) -> BinnedTable:
    """Replace values by bin numbers, once; the result is all integers."""
    thresholds = feature_thresholds(table, max_bins)
    columns = table.columns
    kept = [c for c in table.rows.columns if c not in columns]

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {c: pdf[c] for c in kept}
            clusters = pdf["cluster"].to_numpy()
            for i, name in enumerate(columns):
                values, bins = pdf[name].to_numpy(), np.zeros(len(pdf), dtype="int32")
                for c in np.unique(clusters):
                    here = clusters == c
                    bins[here] = np.searchsorted(thresholds[int(c)][i], values[here], side="left")
                out[name] = bins
            yield pd.DataFrame(out)

    schema = ", ".join(f"{c} {table.rows.schema[c].dataType.simpleString()}" for c in kept) + ", " + ", ".join(f"{n} INT" for n in columns)
    return BinnedTable(replace(table, rows=table.rows.mapInPandas(to_bins, schema)), thresholds)


def folded_table(df: DataFrame, folds: int, key: str, max_bins: int) -> BinnedTable:
    """Binned rows of ``features``, ``label`` and ``fold``; model ``(0, s)`` trains on all folds but ``s``."""
    classes = many.distinct_classes(df, "label")
    width = len(df.select("features").first()[0])
    flagged = df.select("label", F.array(*[F.col("fold") == s for s in range(folds)]).alias("flags"),
                        vector_to_array("features").alias("v"), F.xxhash64(key).alias("row"))
    table = many.model_table(flagged, [F.col("v")[i] for i in range(width)], "label", classes, None, [0], "flags", folds, carry=["row"])
    return bin_table(table, max_bins)


def _raised(total: np.ndarray, stumps: Sequence[Stump], bins: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Logarithms of weights, after the given stumps have raised them."""
    for s in stumps:
        total = total + np.asarray(s.raises)[(bins[:, s.feature] > s.cut).astype(int), labels]
    return total


def _held(pdf: pd.DataFrame, width: int) -> np.ndarray:
    """``[row, model]``: the logarithms of weights that the table holds, 0 before they are first written."""
    if "state" not in pdf.columns:
        return np.zeros((len(pdf), width))
    return np.frombuffer(b"".join(pdf["state"])).reshape(len(pdf), width)


def _histograms(binned: BinnedTable, order: Sequence[ModelId], models: dict[ModelId, list[Stump]]) -> dict[ModelId, np.ndarray]:
    """Weighted class histograms ``[feature, bin, class]`` of every open model's training rows.

    ``order`` lists the models behind the table's running weights, ``models`` the open ones with the stumps found since.
    """
    columns = binned.table.columns
    f, b, k = len(columns), binned.width, len(binned.table.classes)
    place = {m: i for i, m in enumerate(order)}

    def add(sums: dict[ModelId, np.ndarray], pdf: pd.DataFrame) -> None:
        cluster, label, test, bins = many.split_batch(pdf, columns)
        cells, held = (np.arange(f) * b + bins) * k + label[:, None], _held(pdf, len(order))
        for m, stumps in models.items():
            rows = many.in_training(m, cluster, test)
            if rows.any():
                w = np.exp(np.minimum(_raised(held[rows, place[m]], stumps, bins[rows], label[rows]), LARGEST_LOG_WEIGHT))
                sums[m] += np.bincount(cells[rows].ravel(), weights=np.repeat(w, f), minlength=f * b * k)

    return {m: h.reshape(f, b, k) for m, h in many.summed(binned.table, sorted(models), f * b * k, add).items()}


def _advanced(binned: BinnedTable, order: Sequence[ModelId], since: dict[ModelId, list[Stump]]) -> BinnedTable:
    """The table with running weights that include the stumps ``since`` they were last written, stored anew."""
    columns = binned.table.columns
    rows = binned.table.rows

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, label, _, bins = many.split_batch(pdf, columns)
            held = _held(pdf, len(order)).copy()
            for i, m in enumerate(order):
                held[:, i] = _raised(held[:, i], since[m], bins, label)
            yield pdf.assign(state=[x.tobytes() for x in held])

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema.fields if x.name != "state") + ", state BINARY"
    stored = materialise(rows.mapInPandas(advance, schema), "boosting-weights")
    return replace(binned, table=replace(binned.table, rows=stored.coalesce(binned.table.tasks)))


def _gini_mass(w: np.ndarray) -> np.ndarray:
    total = w.sum(axis=-1)
    return total - np.divide((w * w).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)


def best_stump(
    histogram: np.ndarray, thresholds: list[np.ndarray]
) -> tuple[int, int, int, int, float, tuple[np.ndarray, np.ndarray]]:
    """Stump of least weighted Gini impurity: ``(feature, cut, left, right, weighted error, class weights by side)``."""
    whole = histogram[0].sum(axis=0)
    left = histogram.cumsum(axis=1)
    right = whole - left
    impurity = _gini_mass(left) + _gini_mass(right)
    for i, t in enumerate(thresholds):
        impurity[i, len(t) :] = np.inf
    if not np.isfinite(impurity).any():
        only = int(whole.argmax())
        return 0, 0, only, only, float(1 - whole[only] / whole.sum()), (whole, whole)
    impurity = np.round(impurity / whole.sum(), 12)
    feature, cut = np.unravel_index(impurity.argmin(), impurity.shape)
    sides = left[feature, cut], right[feature, cut]
    hits = sum(side.max() for side in sides)
    return int(feature), int(cut), int(sides[0].argmax()), int(sides[1].argmax()), float(max(0.0, 1 - hits / whole.sum())), sides


def _discrete(k: int, left: int, right: int, alpha: float) -> tuple[tuple, tuple]:
    """SAMME: a side votes for its class, and raises the rows of all others."""
    votes = tuple(tuple(alpha if c == side else 0.0 for c in range(k)) for side in (left, right))
    raises = tuple(tuple(0.0 if c == side else alpha for c in range(k)) for side in (left, right))
    return votes, raises


def _real(k: int, sides: tuple[np.ndarray, np.ndarray], rate: float) -> tuple[tuple, tuple]:
    """SAMME.R: a side votes with the logarithms of its class shares, and lowers the rows it finds likely."""
    votes, raises = [], []
    for weights in sides:
        total = weights.sum()
        # A side without any weight says nothing: even shares.
        shares = weights / total if total > 0 else np.full(k, 1 / k)
        log_p = np.log(np.clip(shares, SMALLEST_SHARE, None))
        votes.append(tuple((k - 1) * (log_p - log_p.mean())))
        # Coded classes: 1 for a row's own, -1 / (k - 1) for each other.
        coded = log_p - (log_p.sum() - log_p) / (k - 1)
        raises.append(tuple(-rate * (k - 1) / k * coded))
    return tuple(votes), tuple(raises)


def boost(
    binned: BinnedTable, rounds: int = 50, learning_rate: float = 1.0, algorithm: str = "SAMME.R"
) -> dict[ModelId, BoostedStumps]:
    """One boosted model per ``(cluster, split)``.

    A model stops early when a stump is perfect or, under SAMME, no better than chance.
    """
    found = boost_rates(binned, {learning_rate: rounds}, algorithm)
    return {m[:2]: model for m, model in found.items()}


def boost_rates(binned: BinnedTable, rounds: dict[float, int], algorithm: str = "SAMME.R") -> dict[tuple, BoostedStumps]:
    """One boosted model per ``(cluster, split, learning rate)``; all of them share every pass.

    ``rounds`` gives the length for each rate. Every ``STATE_ROUNDS`` rounds the rows' weights are written down, so that a
    late round costs what an early one does.
    """
    k = len(binned.table.classes)
    order = [(*m, rate) for m in binned.table.models for rate in sorted(rounds)]
    models = {m: BoostedStumps(binned.table.classes) for m in order}
    written = {m: 0 for m in order}
    still_open = {m for m in order if rounds[m[2]] > 0}
    for done in range(max(rounds.values(), default=0)):
        if not still_open:
            break
        if done and done % STATE_ROUNDS == 0:
            binned = _advanced(binned, order, {m: models[m].stumps[written[m]:] if m in still_open else [] for m in order})
            written = {m: len(models[m].stumps) for m in order}
        found = _histograms(binned, order, {m: models[m].stumps[written[m]:] for m in still_open})
        for m, histogram in found.items():
            model, rate = models[m], m[2]
            if histogram.sum() <= 0:
                still_open.discard(m)
                continue
            per = binned.thresholds[m[0]]
            feature, cut, left, right, error, sides = best_stump(histogram, per)
            threshold = float(per[feature][cut]) if len(per[feature]) > cut else math.inf
            real = algorithm == "SAMME.R" and k > 1
            perfect, hopeless = error <= 1e-12, not real and error >= 1 - 1 / k - 1e-12
            if perfect or hopeless:
                still_open.discard(m)
                if hopeless and model.stumps:
                    continue
                alpha = 1.0
            else:
                alpha = rate * (math.log((1 - error) / error) + math.log(k - 1))
            alpha = 1.0 if real else alpha
            votes, raises = _real(k, sides, rate) if real else _discrete(k, left, right, alpha)
            model.stumps.append(Stump(feature, cut, threshold, left, right, alpha, votes, raises))
            model.errors.append(0.0 if perfect else error)
            if len(model.stumps) >= rounds[rate]:
                still_open.discard(m)
    return models


def staged_accuracy(binned: BinnedTable, models: dict[tuple, BoostedStumps], stages: Sequence[int]) -> dict[tuple, dict[int, float]]:
    """Per model and number of first rounds, the share of its test part that is predicted rightly; one pass for all."""
    columns, width = binned.table.columns, len(stages) + 1

    def add(sums: dict[tuple, np.ndarray], pdf: pd.DataFrame) -> None:
        cluster, label, test, bins = many.split_batch(pdf, columns)
        for m, model in models.items():
            rows = (cluster == m[0]) & ((test >> m[1]) & 1 == 1)
            votes = np.zeros((int(rows.sum()), len(model.classes)))
            hits, own = {0: float((label[rows] == 0).sum())}, bins[rows]
            for n, s in enumerate(model.stumps, 1):
                votes = votes + np.asarray(s.votes)[(own[:, s.feature] > s.cut).astype(int)]
                hits[n] = float((votes.argmax(axis=1) == label[rows]).sum())
            sums[m] += [*(hits[min(n, len(model.stumps))] for n in stages), len(votes)]

    found = many.summed(binned.table, sorted(models), width, add)
    return {m: {n: float(x[i] / max(x[-1], 1)) for i, n in enumerate(stages)} for m, x in found.items()}


def search(df: DataFrame, estimator: AdaBoostClassifier, grid: Sequence[dict], key: str, folds: int) -> list[tuple[dict, float, float]]:
    """``(point, mean accuracy, its standard deviation)`` of all rates and numbers of rounds over the folds of ``df``.

    All folds and rates are models of one boosting run; shorter models are the first rounds of longer ones.
    """
    points = [(p.get(estimator.learningRate, estimator.getOrDefault("learningRate")), p.get(estimator.rounds, estimator.getOrDefault("rounds"))) for p in grid]
    wanted = {rate: max(n for r, n in points if r == rate) for rate, _ in points}
    binned = folded_table(df, folds, key, estimator.getOrDefault("maxBins"))
    binned.table.rows = compact(binned.table.rows, df.count()).persist()
    try:
        models = boost_rates(binned, wanted, estimator.getOrDefault("algorithm"))
        accuracy = staged_accuracy(binned, models, sorted({n for _, n in points}))
    finally:
        binned.table.rows.unpersist()
    scores = []
    for point, (rate, n) in zip(grid, points):
        own = [accuracy[(0, s, rate)][n] for s in range(folds)]
        scores.append((point, statistics.fmean(own), statistics.pstdev(own)))
    return scores


class _BoostParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    rounds = Param(Params._dummy(), "rounds", "boosting rounds (>= 1)", TypeConverters.toInt)
    learningRate = Param(Params._dummy(), "learningRate", "shrinks every stump's vote", TypeConverters.toFloat)
    algorithm = Param(Params._dummy(), "algorithm", "SAMME.R or SAMME", TypeConverters.toString)
    maxBins = Param(Params._dummy(), "maxBins", "candidate thresholds per feature, plus one", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(rounds=50, learningRate=1.0, maxBins=32, algorithm="SAMME.R")


class AdaBoostClassifier(Estimator, _BoostParams):
    """Spark ML estimator around :func:`boost` for a vector column."""

    @keyword_only
    def __init__(
        self, *, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction",
        rounds: int = 50, learningRate: float = 1.0, maxBins: int = 32, algorithm: str = "SAMME.R",
    ) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _train(self, df: DataFrame, wanted: dict[float, int]) -> dict[float, BoostedStumps]:
        """The longest model wanted for each learning rate."""
        table = many.vector_table(df, self.getFeaturesCol(), self.getLabelCol())
        binned = bin_table(table, self.getOrDefault(self.maxBins))
        binned.table.rows = compact(binned.table.rows, df.count()).persist()
        try:
            return {m[2]: model for m, model in boost_rates(binned, wanted, self.getOrDefault(self.algorithm)).items()}
        finally:
            binned.table.rows.unpersist()

    def _model(self, stumps: BoostedStumps) -> AdaBoostModel:
        return self._copyValues(AdaBoostModel(stumps))

    def _fit(self, df: DataFrame) -> AdaBoostModel:
        rate = self.getOrDefault(self.learningRate)
        return self._model(self._train(df, {rate: self.getOrDefault(self.rounds)})[rate])

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence[dict]):
        """Fit one long model per learning rate; shorter ones are its first rounds."""
        if not all(set(pm) <= {self.rounds, self.learningRate} for pm in paramMaps):
            return super().fitMultiple(dataset, paramMaps)
        wanted = [
            (pm.get(self.learningRate, self.getOrDefault(self.learningRate)), pm.get(self.rounds, self.getOrDefault(self.rounds)))
            for pm in paramMaps
        ]
        trained = self._train(dataset, {rate: max(n for r, n in wanted if r == rate) for rate, _ in wanted})
        return iter([(i, self.copy(paramMaps[i])._model(trained[rate].staged(n))) for i, (rate, n) in enumerate(wanted)])


class AdaBoostModel(Model, _BoostParams):
    def __init__(self, stumps: BoostedStumps | None = None) -> None:
        super().__init__()
        self.stumps = stumps

    def _transform(self, df: DataFrame) -> DataFrame:
        v = vector_to_array(self.getFeaturesCol())
        return df.withColumn(self.getPredictionCol(), self.stumps.predict_column(lambda i: v[i]))
