"""Seeded exact sampling and train/test splits by hash order.

A row's place in a shuffle is ``md5(seed:id)``; ids must be unique. Which rows
form a split is decided by one *cut* per class: the hash of the last row that
still fits the quota. Finding the cuts takes a count per hash prefix and a look
at the few rows under the prefixes that straddle a quota; applying them is a
narrow comparison. No class is ever sorted in one task, however large it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest number of distinct classes (per table) a stratified split accepts.
MAX_CLASSES = 1000
#: Rows a hash prefix may hold on average before its rows are ranked in one task.
PREFIX_ROWS = 50_000
#: Characters of an md5 text, and how many of them one counting pass looks at.
HASH_DIGITS = 32
DIGITS_PER_STEP = 4

_EVERYTHING = "{}"


def hash_order(seed: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))


def _place(seed: Column, key: str) -> Column:
    return F.struct(hash_order(seed, F.col(key)).alias("h"), F.col(key).alias("key"))


def _stratum(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns)) if columns else F.lit(_EVERYTHING)


def class_counts(df: DataFrame, columns: list[str]) -> list[tuple]:
    """``(values, stratum, rows)`` per class; refuses columns that are not classes."""
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__stratum", _stratum(columns))
    rows = counted.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{columns} have more than {MAX_CLASSES} distinct values")
    return [(tuple(row[c] for c in columns), row["__stratum"], row["__n"]) for row in rows]


def test_quotas(counts: dict, test_share: float) -> dict:
    """Test rows per class: ``ceil(share·N)`` in total, shared by largest remainder."""
    n = sum(counts.values())
    if n == 0:
        return {}
    total = math.ceil(round(test_share * n, 9))
    order = sorted(counts, key=str)
    exact = {c: counts[c] * total / n for c in order}
    quotas = {c: math.floor(exact[c]) for c in order}
    by_remainder = sorted(order, key=lambda c: quotas[c] - exact[c])
    for c in by_remainder[: total - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def _narrow(hashed: DataFrame, wanted: DataFrame, known: int, digits: int) -> DataFrame:
    """Extend each wanted prefix from ``known`` to ``digits`` characters.

    Rows are counted per longer prefix; the one that straddles the wanted place
    is kept, with the place counted from its start.
    """
    parent = F.substring("at.h", 1, known) if known else F.lit("")
    inside = hashed.withColumn("prefix", parent)
    if known:
        inside = inside.join(F.broadcast(wanted.select("split", "stratum", "prefix").distinct()), ["split", "stratum", "prefix"])
    longer = F.substring("at.h", 1, digits)
    counted = inside.groupBy("split", "stratum", "prefix", longer.alias("longer")).agg(F.count(F.lit(1)).alias("n"))
    # At most 16 ** DIGITS_PER_STEP rows per window.
    upto = F.sum("n").over(Window.partitionBy("split", "stratum", "prefix").orderBy("longer"))
    found = counted.withColumn("upto", upto).join(F.broadcast(wanted), ["split", "stratum", "prefix"])
    straddling = found.where("need <= upto AND need > upto - n")
    kept = straddling.select("split", "stratum", "cut", F.col("longer").alias("prefix"), F.expr("need - (upto - n)").alias("need"))
    return hashed.sparkSession.createDataFrame(kept.collect(), kept.schema)


def find_cuts(df: DataFrame, key: str, strata: list[str], ranks: list[tuple], rows: int, seed: int, n_splits: int) -> DataFrame:
    """Exact order statistics: ``<stratum, cuts ARRAY<STRUCT<split, cut, at>>>``.

    ``ranks`` holds ``(stratum, cut number, rank)``. The result has one row per
    class and ``n_splits × cuts`` entries in each; it goes through the driver.
    """
    spark = df.sparkSession
    hashed = (
        df.select(F.col(key), _stratum(strata).alias("stratum"))
        .withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .withColumn("at", _place(F.col("split") + F.lit(seed), key))
        .select("split", "stratum", "at")
    )
    places = [(s, stratum, cut, "", rank) for s in range(n_splits) for stratum, cut, rank in ranks if rank > 0]
    wanted = spark.createDataFrame(places, "split INT, stratum STRING, cut INT, prefix STRING, need BIGINT")
    known = 0
    while rows / 16**known > PREFIX_ROWS and known < HASH_DIGITS:
        step = 1
        while step < DIGITS_PER_STEP and rows / 16 ** (known + step) > PREFIX_ROWS:
            step += 1
        wanted = _narrow(hashed, wanted, known, known + step)
        known += step
    prefix = F.substring("at.h", 1, known) if known else F.lit("")
    inside = hashed.withColumn("prefix", prefix).join(
        F.broadcast(wanted.select("split", "stratum", "prefix").distinct()), ["split", "stratum", "prefix"]
    )
    place = F.row_number().over(Window.partitionBy("split", "stratum", "prefix").orderBy("at"))
    found = inside.withColumn("place", place).join(F.broadcast(wanted), ["split", "stratum", "prefix"]).where("place = need")
    entry = F.struct("split", "cut", "at")
    grouped = found.groupBy("stratum").agg(F.array_sort(F.collect_list(entry)).alias("cuts"))
    return spark.createDataFrame(grouped.collect(), grouped.schema)


def _with_cuts(df: DataFrame, strata: list[str], cuts: DataFrame) -> DataFrame:
    named = cuts.withColumnsRenamed({"stratum": "__stratum", "cuts": "__cuts"})
    return df.withColumn("__stratum", _stratum(strata)).join(F.broadcast(named), "__stratum", "left").drop("__stratum")


def split_flags(
    df: DataFrame,
    key: str,
    label: str | None,
    n_splits: int = 10,
    test_share: float = 0.4,
    seed: int = 42,
    within: str | None = None,
    name: str = "is_test",
) -> DataFrame:
    """Adds ``ARRAY<BOOLEAN>`` with one entry per split: is this row in that split's test part?

    Rows are not repeated per split. With ``within`` every group of that column
    (a cluster, say) is split on its own.
    """
    strata = [c for c in (within, label) if c]
    groups: dict = {}
    total = 0
    for values, stratum, n in class_counts(df, strata) if strata else [((), _EVERYTHING, df.count())]:
        groups.setdefault(values[0] if within else None, {})[stratum] = n
        total += n
    ranks = [(s, 0, q) for counts in groups.values() for s, q in test_quotas(counts, test_share).items()]
    cuts = find_cuts(df, key, strata, ranks, total, seed, n_splits)
    per_split = F.transform(
        F.sequence(F.lit(0), F.lit(n_splits - 1)),
        lambda s: F.coalesce(_place(s + F.lit(seed), key) <= F.element_at("__cuts", s + 1)["at"], F.lit(False)),
    )
    return _with_cuts(df, strata, cuts).withColumn(name, per_split).drop("__cuts")


def _explode_splits(flagged: DataFrame) -> DataFrame:
    rest = [c for c in flagged.columns if c != "is_test"]
    return flagged.select(*rest, F.posexplode_outer("is_test").alias("split", "is_test"))


def strat_split(df: DataFrame, key: str, label: str, test_share: float = 0.4, seed: int = 42) -> DataFrame:
    """One stratified split: adds ``is_test``."""
    return split_flags(df, key, label, 1, test_share, seed).withColumn("is_test", F.col("is_test")[0])


def strat_shuffle_splits(
    df: DataFrame, key: str, label: str, n_splits: int = 10, test_share: float = 0.4, seed: int = 42
) -> DataFrame:
    """Independent stratified splits: every row once per ``split``, with ``is_test``."""
    return _explode_splits(split_flags(df, key, label, n_splits, test_share, seed))


def shuffle_splits(df: DataFrame, key: str, n_splits: int = 10, test_share: float = 0.4, seed: int = 42) -> DataFrame:
    """Independent splits without stratification."""
    return _explode_splits(split_flags(df, key, None, n_splits, test_share, seed))


def stratified_kfold(df: DataFrame, key: str, label: str, folds: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..folds-1; every class is dealt over the folds as evenly as possible."""
    counts = class_counts(df, [label])
    ranks = [
        (stratum, i, f * (n // folds) + min(f, n % folds))
        for _, stratum, n in counts
        for i, f in enumerate(range(1, folds))
    ]
    cuts = find_cuts(df, key, [label], ranks, sum(n for _, _, n in counts), seed, 1)
    placed = _with_cuts(df, [label], cuts).withColumn("__at", _place(F.lit(seed), key))
    passed = F.filter("__cuts", lambda c: c["at"] < F.col("__at"))
    fold = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(F.size(passed))
    return placed.withColumn("fold", fold).drop("__at", "__cuts")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement; an error when there are fewer."""
    rows = df.count()
    if n > rows:
        raise ValueError(f"cannot take {n} rows from {rows}")
    cut = find_cuts(df, key, [], [(_EVERYTHING, 0, n)], rows, seed, 1).first()["cuts"][0]["at"]
    h = hash_order(F.lit(seed), F.col(key))
    return df.where((h < F.lit(cut["h"])) | ((h == F.lit(cut["h"])) & (F.col(key) <= F.lit(cut["key"]))))


def follow_sample(df: DataFrame, sampled: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key was sampled."""
    return df.join(sampled.select(key).distinct(), key, "left_semi")
