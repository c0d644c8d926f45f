"""Partitioned tables and nested result documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: str = "cluster", file_format: str = "parquet") -> None:
    """Replace ``path`` by one folder per value of ``by``."""
    writer = df.write.mode("overwrite").partitionBy(by)
    writer.option("header", True).format(file_format).save(path)


def _two_decimals(values: pd.Series) -> pd.Series:
    # The JVM rounds the shortest decimal text of a double, which turns 0.215 into 0.22;
    # here the double itself is rounded. The last digits go first, so that a mean
    # prints the same in whatever order its terms were added.
    return values.round(12).map("{:.2f}".format)


def nested_report(report: DataFrame) -> DataFrame:
    """``<cluster, document>``: the long metric report as one JSON document per cluster.

    Values become two-decimal text here and nowhere earlier. The report is a
    result table (clusters × models × metrics), so the groups are small.
    """
    shown = F.pandas_udf(_two_decimals, "string")("value")
    name = F.when(F.col("class").isNull(), F.col("metric")).otherwise(F.concat_ws("_", "metric", "class"))
    metrics = report.groupBy("cluster", "model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), shown.alias("v"))))).alias("metrics")
    )
    models = metrics.groupBy("cluster").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.to_json("metrics").alias("m"))))).alias("models")
    )
    pairs = F.transform(F.map_entries("models"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return models.select("cluster", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("document"))


def write_json(report: DataFrame, path: str) -> None:
    """Write the nested documents, one line per cluster."""
    line = F.concat(F.lit('{"cluster'), F.col("cluster").cast("string"), F.lit('":'), F.col("document"), F.lit("}"))
    nested_report(report).select(line.alias("value")).write.mode("overwrite").text(path)
