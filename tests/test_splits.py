import pytest
from pyspark.sql import functions as F

from accountscope.operators import splits

# Recorded class sizes and test supports of six clusters, 40 % test.
SUPPORTS = [
    ((6236, 6359), (2494, 2544)), ((3747, 8888), (1499, 3555)), ((10702, 3640), (4281, 1456)),
    ((205, 94), (82, 38)), ((213, 186), (85, 75)), ((100, 197), (40, 79)),
]


@pytest.mark.parametrize("sizes, want", SUPPORTS)
def test_quotas_match_recorded_supports(sizes, want):
    found = splits.test_quotas(dict(enumerate(sizes)), 0.4)
    assert (found[0], found[1]) == want


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(1000).select(F.col("id").alias("user_id"), (F.col("id") % 7 == 0).cast("int").alias("y")).persist()


def ranks(ids, seed):
    import hashlib

    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("prefix_rows, digits", [(50_000, 4), (3, 4), (3, 1)])
def test_split_equals_sorting(spark, people, monkeypatch, prefix_rows, digits):
    monkeypatch.setattr(splits, "PREFIX_ROWS", prefix_rows)
    monkeypatch.setattr(splits, "DIGITS_PER_STEP", digits)
    found = {r["user_id"] for r in splits.strat_split(people, "user_id", "y").where("is_test").collect()}
    ones = [i for i in range(1000) if i % 7 == 0]
    zeros = [i for i in range(1000) if i % 7]
    quotas = splits.test_quotas({0: len(zeros), 1: len(ones)}, 0.4)
    assert found == set(ranks(ones, 42)[: quotas[1]]) | set(ranks(zeros, 42)[: quotas[0]])


def test_splits_are_independent_and_exact(people):
    rows = splits.strat_shuffle_splits(people, "user_id", "y", 4).groupBy("split").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t"), F.md5(F.array_join(F.array_sort(F.collect_list(
            F.when(F.col("is_test"), F.col("user_id")))), ",")).alias("h"))
    found = rows.collect()
    assert {(r["n"], r["t"]) for r in found} == {(1000, 400)}
    assert len({r["h"] for r in found}) == 4


def test_splits_within_clusters(people):
    clustered = people.withColumn("cluster", (F.col("user_id") % 3).cast("int"))
    flagged = splits.split_flags(clustered, "user_id", "y", 2, within="cluster")
    for r in flagged.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(F.col("is_test")[0]).alias("t")).collect():
        assert r["t"] == -(-r["n"] * 4 // 10)


def test_folds_do_not_depend_on_the_passes(people, monkeypatch):
    def dealt():
        return {r["user_id"]: r["fold"] for r in splits.stratified_kfold(people, "user_id", "y", 7).collect()}

    once = dealt()
    monkeypatch.setattr(splits, "PREFIX_ROWS", 2)
    monkeypatch.setattr(splits, "DIGITS_PER_STEP", 1)
    assert dealt() == once


@pytest.mark.parametrize("n", [1000, 23])
def test_folds_are_even(people, n):
    folded = splits.stratified_kfold(people.where(F.col("user_id") < n), "user_id", "y", 10)
    for y in (0, 1):
        sizes = [r["count"] for r in folded.where(F.col("y") == y).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1


def test_sample(people):
    a = {r["user_id"] for r in splits.sample_n(people, "user_id", 123).collect()}
    assert a == set(ranks(range(1000), 42)[:123])
    assert a == {r["user_id"] for r in splits.sample_n(people.repartition(3), "user_id", 123).collect()}
    with pytest.raises(ValueError, match="cannot take"):
        splits.sample_n(people, "user_id", 1001)


def test_one_class_and_tiny_class(spark):
    df = spark.createDataFrame([(i, 0 if i else 1) for i in range(10)], "user_id INT, y INT")
    flagged = splits.strat_split(df, "user_id", "y").collect()
    assert sum(r["is_test"] for r in flagged) == 4
