"""Projection, cleaning, cohort set operations and per-account statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountscope.functions import text as tx

# Input column names and the names used from here on.
STATIC_RENAMES = {
    "UserID": "user_id",
    "UserType": "user_type",
    "NumberOfTweets": "num_tweets",
    "numOfFollowers": "num_followers",
    "numOfFollowings": "num_followings",
    "lengthAboutMe": "about_me_length",
    "lengthUsername": "user_name_length",
    "NumOfAnnotation": "num_annotations",
    "NumOfHttp": "num_http",
    "avgLengthOfTweets": "tweet_avg_length",
    "totalNumOfUniqWords": "num_unique_words",
}
TWEET_RENAMES = {"UserID": "user_id", "TweetID": "tweet_id", "Tweet": "tweet", "CreatedAt": "creation_date"}

POLLUTER, LEGITIMATE = 1, 0


def rename_static(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(STATIC_RENAMES)


def rename_tweets(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(TWEET_RENAMES)


def type_posts(df: DataFrame) -> DataFrame:
    """Order columns of posts in comparable types: text ids as numbers, text dates as timestamps."""
    types = dict(df.dtypes)
    if types.get("tweet_id") == "string":
        df = df.withColumn("tweet_id", F.col("tweet_id").try_cast("bigint"))
    if types.get("creation_date") == "string":
        df = df.withColumn("creation_date", F.try_to_timestamp("creation_date"))
    return df


def drop_cols(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def coerce_id(df: DataFrame, column: str = "user_id") -> DataFrame:
    """Ids as BIGINT; rows whose id is not a whole number go.

    The decimal step also reads ids that were written as floats (``12.0``).
    """
    as_decimal = F.col(column).cast("string").try_cast("decimal(38,6)")
    as_id = F.when(as_decimal == F.floor(as_decimal), as_decimal.try_cast("bigint"))
    return df.withColumn(column, as_id).where(F.col(column).isNotNull())


def cast_label(df: DataFrame, column: str = "user_type") -> DataFrame:
    """Nominal or boolean label to INT."""
    return df.withColumn(column, F.col(column).cast("int"))


def select_features(df: DataFrame, flags: Mapping[str, bool] | Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keep the switched-on columns; an unknown name is an error that says which."""
    names = [n for n, on in flags.items() if on] if isinstance(flags, Mapping) else list(flags)
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown feature columns: {unknown}")
    return df.select(*keep, *[n for n in names if n not in keep])


def project_text(df: DataFrame, key: str = "user_id", text: str = "tweet") -> DataFrame:
    return df.select(key, text)


def _double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def inf_to_null(df: DataFrame) -> DataFrame:
    """±Inf in any floating column becomes NULL."""
    names = _double_columns(df)
    infinite = F.lit(float("inf"))
    return df.withColumns({n: F.when(F.abs(F.col(n)) != infinite, F.col(n)) for n in names}) if names else df


def drop_nan_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows holding NULL or NaN go; ±Inf stays."""
    return df.na.drop(subset=list(subset) if subset else None)


def add_const_label(df: DataFrame, value: int, column: str = "user_type") -> DataFrame:
    return df.withColumn(column, F.lit(value).cast("int"))


def head_slice(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First ``n`` rows in a stated order (a bounded top-k)."""
    return df.orderBy(*order).limit(n)


def dedup_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key in the given order.

    An aggregate, not a window: rows of a hot key are reduced before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(key).agg(first).select(*[c if c == key else F.col(f"__first.{c}").alias(c) for c in df.columns])


def _keys(df: DataFrame, key: str) -> DataFrame:
    # Distinct first: a hot key is reduced map-side and cannot skew the membership join.
    return df.select(key).distinct()


def disjoint_cohorts(a: DataFrame, b: DataFrame, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Remove from each cohort the keys found in the other, both against the unfiltered other side."""
    return a.join(_keys(b, key), key, "left_anti"), b.join(_keys(a, key), key, "left_anti")


def square_frames(a: DataFrame, b: DataFrame, key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Keep only the keys present in both tables."""
    return a.join(_keys(b, key), key, "left_semi"), b.join(_keys(a, key), key, "left_semi")


def union_cohorts(*cohorts: DataFrame) -> DataFrame:
    first, *others = cohorts
    for other in others:
        first = first.unionByName(other)
    return first


def glue_features(left: DataFrame, *others: DataFrame, key: str = "user_id") -> DataFrame:
    """Columns side by side, matched by key."""
    for other in others:
        left = left.join(other, key)
    return left


def consolidate(static: DataFrame, dynamic: DataFrame, key: str = "user_id") -> DataFrame:
    """Static and dynamic features in one table, without infinite or missing values."""
    return drop_nan_rows(inf_to_null(glue_features(static, dynamic, key=key)))


def avg_by_period(df: DataFrame, key: str, created: str) -> DataFrame:
    """Posts per active day, hour and month of every key.

    Counts are taken per hour first (partial aggregates absorb a hot key) and
    rolled up; a key then has at most one row per hour of the covered time.
    """
    unit = lambda name: F.date_trunc(name, F.col("hour"))
    hourly = df.select(key, F.date_trunc("hour", F.col(created)).alias("hour")).groupBy(key, "hour").agg(
        F.count(F.lit(1)).alias("n")
    )
    daily = hourly.groupBy(key, unit("day").alias("hour")).agg(F.sum("n").alias("n"), F.count("hour").alias("hours"))
    monthly = daily.groupBy(key, unit("month").alias("hour")).agg(
        F.sum("n").alias("n"), F.sum("hours").alias("hours"), F.count("hour").alias("days")
    )
    per_key = monthly.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("hours").alias("hours"), F.sum("days").alias("days"), F.count("hour").alias("months")
    )
    return per_key.select(
        key,
        F.try_divide("n", "days").alias("average_tweets_ByDay"),
        F.try_divide("n", "hours").alias("average_tweets_ByHour"),
        F.try_divide("n", "months").alias("average_tweets_ByMonth"),
    )


def text_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Posts, mentions, links, mean length and distinct words of every key."""
    counts = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("num_tweets"),
        F.sum(tx.count_matches(F.col(text), tx.MENTION)).alias("num_annotations"),
        F.sum(tx.count_matches(F.col(text), tx.LINK)).alias("num_http"),
        F.avg(F.length(text)).alias("tweet_avg_length"),
    )
    words = tx.explode_terms(df, F.array_distinct(tx.wordpunct(F.col(text))), "token", key).distinct()
    unique = words.groupBy(key).agg(F.count(F.lit(1)).alias("num_unique_words"))
    joined = counts.join(unique, key, "left")
    return joined.withColumn("num_unique_words", F.coalesce("num_unique_words", F.lit(0).cast("bigint")))
