"""Exhaustive grid search with stratified folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountscope.operators import boost, metrics, splits, svm, trees
from accountscope.session import compact, materialise

# The searched grids.
CRITERIA = ["gini", "entropy"]
DEPTHS = list(range(3, 10))
LEAVES = list(range(20, 60, 10))
TREES = list(range(1, 10))
ROUNDS = list(range(1, 10))
RATES = [10.0**e for e in range(-6, 3)]
PENALTIES = [10.0**e for e in range(-4, 2)]
ITERATIONS = list(range(300, 1000, 100))

#: Estimators whose grids train in shared passes, as far as these parameters go.
SHARED = [
    ((DecisionTreeClassifier, RandomForestClassifier), {"impurity", "maxDepth", "minInstancesPerNode", "numTrees"}, trees.search),
    (boost.AdaBoostClassifier, {"rounds", "learningRate"}, boost.search),
]


def grid_dt(criteria=CRITERIA, depths=DEPTHS, leaves=LEAVES, seed: int = 42) -> tuple[Estimator, list[dict]]:
    tree = DecisionTreeClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(tree.impurity, criteria).addGrid(tree.maxDepth, depths)
    return tree, grid.addGrid(tree.minInstancesPerNode, leaves).build()


def grid_rf(sizes=TREES, criteria=CRITERIA, depths=DEPTHS, leaves=LEAVES, seed: int = 42) -> tuple[Estimator, list[dict]]:
    forest = RandomForestClassifier(featureSubsetStrategy="sqrt", seed=seed)
    grid = ParamGridBuilder().addGrid(forest.numTrees, sizes).addGrid(forest.impurity, criteria)
    return forest, grid.addGrid(forest.maxDepth, depths).addGrid(forest.minInstancesPerNode, leaves).build()


def grid_ada(rounds=ROUNDS, rates=RATES) -> tuple[Estimator, list[dict]]:
    ada = boost.AdaBoostClassifier()
    return ada, ParamGridBuilder().addGrid(ada.rounds, rounds).addGrid(ada.learningRate, rates).build()


def grid_svc(penalties=PENALTIES, iterations=ITERATIONS) -> tuple[Estimator, list[dict]]:
    svc = svm.SquaredHingeSVC()
    return svc, ParamGridBuilder().addGrid(svc.c, penalties).addGrid(svc.maxIter, iterations).build()


@dataclass
class GridResult:
    best: Model
    scores: list[tuple[dict, float, float]]

    def table(self, like: DataFrame) -> DataFrame:
        """``<params, accuracy, sd>``, one row per grid point."""
        rows = [
            (", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda e: e[0].name)), float(mean), float(sd))
            for point, mean, sd in self.scores
        ]
        return like.sparkSession.createDataFrame(rows, "params STRING, accuracy DOUBLE, sd DOUBLE")


def grid_report(
    df: DataFrame, estimator: Estimator, grid: list[dict], key: str = "user_id", folds: int = 10, test_share: float = 0.4,
    seed: int = 42, parallelism: int = 8,
) -> tuple[GridResult, DataFrame]:
    """Search on the training part of one stratified split, then judge the best model on both parts.

    The report is ``<metric, class, value>``: train and test accuracy, per-class
    metrics, their weighted averages and the confusion matrix of the test part.
    """
    flagged = materialise(splits.strat_split(df.select(key, "features", "label"), key, "label", test_share, seed), "grid-split")
    found = grid_search(flagged.where("NOT is_test").drop("is_test"), estimator, grid, key, folds, seed, parallelism)
    scored = found.best.transform(flagged).select("is_test", *[F.col(c).cast("int").alias(c) for c in ("label", "prediction")])
    counts = materialise(metrics.outcome_counts(scored, ["is_test"]), "grid-outcomes")
    part = F.when(F.col("is_test"), F.lit("test_accuracy")).otherwise(F.lit("train_accuracy"))
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)))
    accuracy = counts.groupBy(part.alias("metric")).agg(F.try_divide(hits, F.sum("n")).alias("value"))
    test = counts.where("is_test")
    prf = metrics.prf_from_counts(test)
    names = ["precision", "recall", "f1", "support"]

    def long(table: DataFrame, prefix: str, of_class: Column) -> DataFrame:
        entries = [
            F.struct(F.lit(prefix + m).alias("metric"), of_class.alias("class"), F.col(m).cast("double").alias("value")) for m in names
        ]
        return table.select(F.inline(F.array(*entries)))

    none = F.lit(None).cast("int")
    cells = test.select(
        F.concat(F.lit("predicted_as_"), F.col("prediction")).alias("metric"), F.col("label").alias("class"), F.col("n").cast("double").alias("value")
    )
    report = accuracy.select("metric", none.alias("class"), "value").unionByName(long(prf, "", F.col("class")))
    return found, report.unionByName(long(metrics.report_avg(prf), "weighted_", none)).unionByName(cells)


def grid_search(
    df: DataFrame, estimator: Estimator, grid: list[dict], key: str = "user_id", folds: int = 10, seed: int = 42, parallelism: int = 8
) -> GridResult:
    """Mean accuracy of every grid point over stratified folds; the best point is refitted on all rows.

    ``df`` carries ``features`` and ``label``. Trees, forests and boosted models of all points and folds train in shared passes.
    """
    folded = splits.stratified_kfold(df.select(key, "features", "label"), key, "label", folds, seed)
    cached = compact(folded.withColumn("fold", F.col("fold").cast("int")), df.count()).persist()
    try:
        shared = next((run for kinds, names, run in SHARED if isinstance(estimator, kinds) and {p.name for point in grid for p in point} <= names), None)
        if shared:
            scores = shared(cached, estimator, grid, key, folds)
            best = max(range(len(grid)), key=lambda i: (scores[i][1], -i))
            return GridResult(estimator.copy(grid[best]).fit(cached), scores)
        search = CrossValidator(
            estimator=estimator,
            estimatorParamMaps=grid,
            evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
            numFolds=folds,
            foldCol="fold",
            parallelism=parallelism,
        )
        fitted = search.fit(cached)
    finally:
        cached.unpersist()
    return GridResult(fitted.bestModel, list(zip(grid, fitted.avgMetrics, fitted.stdMetrics)))
