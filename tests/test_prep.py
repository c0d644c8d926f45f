import random

import pytest
from pyspark.sql import functions as F

from accountscope.operators import collate, prep
from accountscope.plans import stages
from accountscope.config import PERIOD_FEATURES, PreprocessConfig

RAW = [("12", 2, "b"), ("12", 1, "a"), ("12", 3, None), ("abc", 1, "dropped"), (None, 1, "dropped")]


@pytest.fixture()
def posts(spark):
    return prep.coerce_id(spark.createDataFrame(RAW, "user_id STRING, ord INT, tweet STRING"))


@pytest.mark.parametrize("max_rows", [100, 1])
@pytest.mark.parametrize("null_text, want", [(None, "a b"), ("nan", "a b nan")])
def test_collate(posts, null_text, want, max_rows):
    rows = collate.collate_docs(posts, "user_id", "tweet", ["ord"], null_text, max_rows).collect()
    assert [tuple(r) for r in rows] == [(12, want)]


@pytest.mark.parametrize("null_text", [None, "nan"])
def test_collated_text_does_not_depend_on_limits(spark, null_text):
    rng = random.Random(11)
    made = {u: [rng.choice(["a", "bb", "", None, "c d", ""]) for _ in range(rng.randint(1, 9))] for u in range(40)}
    made[99] = [None, None, None]
    made[100] = [None, "", "x", None]
    df = spark.createDataFrame([(u, k, t) for u, ts in made.items() for k, t in enumerate(ts)], "user_id BIGINT, ord INT, tweet STRING")
    want = {u: " ".join(null_text if t is None else t for t in ts if t is not None or null_text) for u, ts in made.items()}
    for max_rows, max_chars in ((100, 10**8), (1, 10**8), (2, 10**8), (3, 2), (100, 3)):
        rows = collate.collate_docs(df, "user_id", "tweet", ["ord"], null_text, max_rows, max_chars).collect()
        assert {r.user_id: r.tweet for r in rows} == want


def test_coerce_id_reads_floats_and_keeps_long_ids(spark):
    raw = [("12.0",), ("12.5",), ("9007199254740993",), ("x1",), ("",)]
    ids = prep.coerce_id(spark.createDataFrame(raw, "user_id STRING")).collect()
    assert sorted(r[0] for r in ids) == [12, 9007199254740993]


def test_hot_account_is_kept_whole_and_in_order(spark):
    """One account owns a third of all posts."""
    hot = spark.range(300).select(F.lit(1).cast("bigint").alias("user_id"), F.col("id").alias("ord"))
    rest = spark.range(600).select((F.col("id") + 2).alias("user_id"), F.lit(0).cast("bigint").alias("ord"))
    posts = hot.unionByName(rest).withColumn("tweet", F.concat(F.lit("t"), F.col("ord"))).repartition(5)
    parts = collate.collate_parts(posts, "user_id", "tweet", ["ord"], max_rows=40).persist()
    mine = [r["tweet"].split() for r in parts.where("user_id = 1").orderBy("part").collect()]
    assert len(mine) >= 8 and max(map(len, mine)) <= 40
    assert [w for part in mine for w in part] == [f"t{i}" for i in range(300)]
    assert parts.where("user_id > 1").count() == 600
    assert [r["part"] for r in parts.where("user_id = 1").orderBy("part").collect()] == list(range(len(mine)))


def test_dedup_keeps_first(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "early"), (2, 5, None)], "k INT, ord INT, v STRING")
    assert sorted(tuple(r) for r in prep.dedup_key(df, "k", "ord").collect()) == [(1, 1, "early"), (2, 5, None)]


def test_disjoint_and_square(spark):
    a = spark.createDataFrame([(1,), (2,), (3,), (None,)], "user_id INT")
    b = spark.createDataFrame([(3,), (4,), (None,)], "user_id INT")
    first, second = prep.disjoint_cohorts(a, b)
    assert {r[0] for r in first.where("user_id IS NOT NULL").collect()} == {1, 2}
    assert {r[0] for r in second.where("user_id IS NOT NULL").collect()} == {4}
    first, second = prep.square_frames(a, b)
    assert [r[0] for r in first.collect()] == [3] and [r[0] for r in second.collect()] == [3]


def test_select_features_names_unknown_column(spark):
    df = spark.createDataFrame([(1, 2.0)], "user_id INT, dt_entropy DOUBLE")
    with pytest.raises(ValueError, match="td_entropy"):
        prep.select_features(df, {"td_entropy": True})


def test_inf_and_nan(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, None), (4, 1.0)], "k INT, v DOUBLE")
    assert {r["k"] for r in prep.drop_nan_rows(df).collect()} == {1, 4}
    assert {r["k"] for r in prep.drop_nan_rows(prep.inf_to_null(df)).collect()} == {4}


def test_text_stats(spark):
    df = spark.createDataFrame([(1, "hi @bob http://x"), (1, "hi"), (2, None)], "user_id INT, tweet STRING")
    found = {r["user_id"]: r for r in prep.text_stats(df, "user_id", "tweet").collect()}
    assert (found[1]["num_tweets"], found[1]["num_annotations"], found[1]["num_http"]) == (2, 1, 1)
    assert found[1]["tweet_avg_length"] == 9.0 and found[1]["num_unique_words"] == 6
    assert found[2]["num_unique_words"] == 0


def test_avg_by_period(spark):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:30:00"), (1, "2024-01-02 11:00:00"), (1, "2024-02-01 00:00:00")]
    df = spark.createDataFrame(rows, "u INT, ts STRING").withColumn("ts", F.to_timestamp("ts"))
    row = prep.avg_by_period(df, "u", "ts").first()
    assert tuple(row) == pytest.approx((1, 4 / 3, 4 / 3, 2.0))


def test_preprocess_small(spark):
    names = list(prep.STATIC_RENAMES)
    static = spark.createDataFrame(
        [(float(u), str(t)) + (1.0,) * 9 for u, t in [(1, 1), (2, 0), (3, 1), (5, 0), (1, 1)]],
        ", ".join(f"{n} {'STRING' if n == 'UserType' else 'DOUBLE'}" for n in names),
    )
    schema = "UserID STRING, TweetID STRING, Tweet STRING, CreatedAt STRING"
    ours = spark.createDataFrame(
        [("1", "10", "b", "2010-01-01 00:00:02"), ("1", "9", "a", "2010-01-01 00:00:02"), ("3", "1", "x", "2010-01-01 00:00:00")], schema
    )
    theirs = spark.createDataFrame(
        [("2", "1", "c", "2010-01-01 00:00:00"), ("3", "2", "y", "2010-01-01 00:00:00"), ("4", "2", "z", None)], schema
    )
    static, documents = stages.preprocess(static, ours, theirs)
    assert sorted(r["user_id"] for r in static.collect()) == [1, 2]
    assert sorted((r["user_id"], r["tweet"], r["user_type"]) for r in documents.collect()) == [(1, "a b", 1), (2, "c", 0)]
    assert stages.label_conflicts(static, documents) == 0
    static, documents = stages.preprocess(static.withColumnsRenamed({v: k for k, v in prep.STATIC_RENAMES.items()}), ours, theirs,
                                          PreprocessConfig(random_sub_sample=True, sample_size=1, period_features=True))
    assert static.count() == 1 and documents.count() == 1
    assert set(PERIOD_FEATURES) <= set(static.columns)
