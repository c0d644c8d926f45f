"""Per-cluster classifiers over stratified splits.

The table is written once, and all clusters and splits of a model train in shared
passes over it; trees, forests and boosting share one binned table. Only counts
per (label, prediction) come back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountscope.config import ClassifyConfig
from accountscope.operators import boost, exact, many, metrics, splits, svm, trees
from accountscope.session import compact, materialise

#: Every tree looks at every row, so a task takes fewer rows than in rounds of boosting or margins.
ROWS_PER_TASK = 5_000
#: Megabytes of histograms per pass, so that a level of a tree takes one pass.
TREE_MEMORY = 1024
OUTCOMES = "cluster INT, model STRING, split INT, label INT, prediction INT, n BIGINT"


def xy_split_cols(df: DataFrame, label: str = "user_type", exclude: Sequence[str] = ("user_id", "cluster")) -> list[str]:
    """Feature columns: every numeric column but the label and the keys."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != label and f.name not in exclude
    ]


def assemble(df: DataFrame, features: Sequence[str], label: str = "user_type", output: str = "features") -> DataFrame:
    """Adds the feature vector and a double ``label``."""
    vectors = VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="error").transform(df)
    return vectors.withColumn("label", F.col(label).cast("double"))


def make_model(name: str, cfg: ClassifyConfig = ClassifyConfig()) -> Estimator:
    """The estimator behind a model name."""
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=cfg.max_depth, maxBins=cfg.max_bins, maxMemoryInMB=TREE_MEMORY, seed=cfg.seed)
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=cfg.forest_trees, maxDepth=cfg.max_depth, maxBins=cfg.max_bins, maxMemoryInMB=TREE_MEMORY,
            featureSubsetStrategy="sqrt", seed=cfg.seed,
        )
    if name == "adaboosted_dt":
        return boost.AdaBoostClassifier(rounds=cfg.boosting_rounds, maxBins=cfg.max_bins, algorithm=cfg.boosting)
    if name == "linear_svc":
        return svm.SquaredHingeSVC(standardise=cfg.standardise)
    raise ValueError(f"unknown model {name!r}")


def fit_predict(model: Estimator, train: DataFrame, test: DataFrame) -> tuple[Model, DataFrame]:
    """Fit on the training rows, predict the test rows."""
    fitted = model.fit(train)
    return fitted, fitted.transform(test).withColumn("prediction", F.col("prediction").cast("int"))


def _features_of(cfg: ClassifyConfig, df: DataFrame, cluster: int, label: str) -> list[str]:
    wanted = cfg.features.get(cluster) if isinstance(cfg.features, dict) else cfg.features
    if wanted is None:
        return xy_split_cols(df, label)
    names = [n for n in wanted if n != label]
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"cluster {cluster}: unknown feature columns {unknown}")
    return names


def _cluster_sizes(df: DataFrame) -> dict[int, int]:
    rows = df.groupBy("cluster").count().limit(splits.MAX_CLASSES + 1).collect()
    if len(rows) > splits.MAX_CLASSES:
        raise ValueError("'cluster' has too many distinct values")
    return {int(r["cluster"]): r["count"] for r in sorted(rows, key=lambda r: r["cluster"])}


def model_outcomes(
    df: DataFrame, cfg: ClassifyConfig = ClassifyConfig(), key: str = "user_id", label: str = "user_type"
) -> DataFrame:
    """``<cluster, model, split, label, prediction, n>`` on the test rows of every cluster, model and split."""
    flagged = materialise(splits.split_flags(df, key, label, cfg.folds, cfg.test_share, cfg.seed, within="cluster"), "split-table")
    sizes = _cluster_sizes(flagged)
    features = {c: _features_of(cfg, df, c, label) for c in sizes}
    found = _shared_outcomes(flagged.withColumn("row", F.xxhash64(key)), sizes, features, cfg, label)
    return df.sparkSession.createDataFrame(found, OUTCOMES)


def _shared_outcomes(
    flagged: DataFrame, sizes: dict[int, int], features: dict[int, list[str]], cfg: ClassifyConfig, label: str
) -> list[tuple]:
    """Models that train together; clusters are grouped by feature list."""
    by_list: dict[tuple, list[int]] = {}
    for c, names in features.items():
        by_list.setdefault(tuple(names), []).append(c)
    classes = many.distinct_classes(flagged, label)
    found = []
    for names, clusters in by_list.items():
        part = flagged.where(F.col("cluster").isin(clusters))
        table = many.model_table(
            part, [F.col(n) for n in names], label, classes, "cluster", clusters, "is_test", cfg.folds, carry=["row"])
        rows = sum(sizes[c] for c in clusters)
        table.rows = compact(table.rows, rows, ROWS_PER_TASK).persist()
        try:
            found += [(c, name, s, y, p, n) for name, (c, s, y, p, n) in _train_together(table, rows, cfg)]
        finally:
            table.rows.unpersist()
    return found


def _train_together(table: many.ModelTable, rows: int, cfg: ClassifyConfig) -> Iterator[tuple[str, tuple]]:
    """``(model, outcome)``; trees, forests and boosting read the same binned rows."""
    if "linear_svc" in cfg.models:
        few = replace(table, rows=compact(table.rows, rows))
        margins = svm.fit_margins(few, standardise=cfg.standardise)
        yield from (("linear_svc", o) for o in many.test_outcomes(few, {m: margin.vote for m, margin in margins.items()}))
    exactly = cfg.exact_cuts and "decision_tree" in cfg.models
    if exactly:
        yield from (("decision_tree", o) for o in exact.outcomes(table, cfg.max_depth))
    binning = [name for name in cfg.models if name != "linear_svc" and not (exactly and name == "decision_tree")]
    if not binning:
        return
    binned = boost.bin_table(table, cfg.max_bins)
    binned.table.rows = binned.table.rows.persist()
    try:
        for name in binning:
            if name == "adaboosted_dt":
                few = replace(binned, table=replace(binned.table, rows=compact(binned.table.rows, rows)))
                votes = {m: model.vote for m, model in boost.boost(few, cfg.boosting_rounds, algorithm=cfg.boosting).items()}
            else:
                grown = trees.forests_of(binned, cfg.max_depth, cfg.forest_trees if name == "random_forest" else None, cfg.seed)
                votes = {m: trees.voter(own, len(table.classes)) for m, own in grown.items()}
            yield from ((name, o) for o in many.test_outcomes(binned.table, votes))
    finally:
        binned.table.rows.unpersist()


def cv_accuracy(outcomes: DataFrame) -> DataFrame:
    """``<cluster, model, averaged_accuracy_score, averaged_accuracy_sd>`` over all splits."""
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)))
    per_split = outcomes.groupBy("cluster", "model", "split").agg(F.try_divide(hits, F.sum("n")).alias("accuracy"))
    return metrics.mean_sd(per_split, ["cluster", "model"])


def metric_report(outcomes: DataFrame) -> DataFrame:
    """Long typed report ``<cluster, model, metric, class, value>``.

    Cross-validated accuracy uses every split; per-class metrics, their weighted
    averages and the confusion matrix use the first split, as one 60/40 fit.
    """
    by = ["cluster", "model"]
    one = outcomes.where("split = 0")
    prf = metrics.prf_from_counts(one, by)
    no_class = F.lit(None).cast("int")

    def long(df: DataFrame, names: Sequence[str], class_column, prefix: str = "") -> DataFrame:
        entries = [
            F.struct(F.lit(prefix + n).alias("metric"), class_column.alias("class"), F.col(n).cast("double").alias("value"))
            for n in names
        ]
        return df.select(*by, F.inline(F.array(*entries)))

    names = ["precision", "recall", "f1", "support"]
    cells = one.select(
        *by,
        F.concat(F.lit("predicted_as_"), F.col("prediction").cast("string")).alias("metric"),
        F.col("label").alias("class"),
        F.col("n").cast("double").alias("value"),
    )
    return (
        long(cv_accuracy(outcomes), ["averaged_accuracy_score", "averaged_accuracy_sd"], no_class)
        .unionByName(long(prf, names, F.col("class")))
        .unionByName(long(metrics.report_avg(prf, by), names, no_class, "weighted_"))
        .unionByName(cells)
    )


def per_cluster_models(
    df: DataFrame, cfg: ClassifyConfig = ClassifyConfig(), key: str = "user_id", label: str = "user_type"
) -> DataFrame:
    """Train and evaluate every switched-on model on every cluster; features are matched by cluster id."""
    return metric_report(model_outcomes(df, cfg, key, label))
