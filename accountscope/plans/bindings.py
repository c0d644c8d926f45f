"""The engine's input tables, derived from the supplied tables, in Spark and in SQL.

Posts are the lines of a document; static features are measured on documents
and labels; the distribution over topics is the share of event types per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountscope.functions import text as tx
from accountscope.operators import scores, text
from accountscope.session import materialise, spread_scan

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents spread by id, so that counting terms per document needs no further shuffle."""
    return spread_scan(table(spark, folder, "documents"), "doc_id")


def event_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the known event types; an event of another type is an error, as it would count in no share."""
    kind = F.col("event_type")
    unknown = F.raise_error(F.concat(F.lit("unknown event type "), kind)).cast("string")
    events = table(spark, folder, "events").withColumn("event_type", F.when(kind.isNull() | kind.isin(EVENT_TYPES), kind).otherwise(unknown))
    return scores.share_distribution(events, "user_id", "event_type", EVENT_TYPES)


def static_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One row of numeric features per labelled document, under the raw column names."""
    docs, labels = documents(spark, folder), table(spark, folder, "labels")
    lines = F.size(F.split("text", "\n")).cast("double")
    words = F.size(F.array_distinct(tx.wordpunct(F.col("text")))).cast("double")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("UserID"),
        F.col("toxic").cast("string").alias("UserType"),
        lines.alias("NumberOfTweets"),
        F.col("n_chars").cast("double").alias("numOfFollowers"),
        F.col("quality").cast("double").alias("numOfFollowings"),
        F.length("source").cast("double").alias("lengthAboutMe"),
        F.length("lang").cast("double").alias("lengthUsername"),
        tx.count_matches(F.col("text"), tx.MENTION).cast("double").alias("NumOfAnnotation"),
        tx.count_matches(F.col("text"), tx.LINK).cast("double").alias("NumOfHttp"),
        (F.length("text") / lines).alias("avgLengthOfTweets"),
        words.alias("totalNumOfUniqWords"),
    )


def posts_raw(docs: DataFrame) -> DataFrame:
    """Every line of the documents as one post, under the raw column names."""
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("n", "line"))
    return lines.select(
        F.col("doc_id").cast("string").alias("UserID"),
        F.col("n").cast("string").alias("TweetID"),
        F.col("line").alias("Tweet"),
        F.date_format(F.timestamp_seconds(F.col("n") + 1262304000), "yyyy-MM-dd HH:mm:ss").alias("CreatedAt"),
    )


def cohorts_raw(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Posts of suspicious and of unsuspicious documents; documents of low quality but not toxic are in both."""
    docs = documents(spark, folder).select("doc_id", "text")
    labels = table(spark, folder, "labels")
    suspicious, plain = labels.where("toxic = 1 OR quality = 0"), labels.where("toxic = 0")
    return posts_raw(docs.join(suspicious, "doc_id")), posts_raw(docs.join(plain, "doc_id"))


def clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    return text.tokenize(documents(spark, folder), "doc_id", "text")


def document_terms(spark: SparkSession, folder: str) -> DataFrame:
    return text.ngrams(clean_documents(spark, folder), 1, 2, "doc_id")


def stored_terms(spark: SparkSession, folder: str) -> DataFrame:
    """``document_terms`` for several readers: tokens are written once, and each reader makes n-grams, which take more room."""
    return text.ngrams(materialise(clean_documents(spark, folder), "tokens"), 1, 2, "doc_id")


def account_features(spark: SparkSession, folder: str) -> DataFrame:
    """Numeric features of labelled documents: ``user_id, user_type`` and measurements, ``cluster`` by language."""
    docs, labels = documents(spark, folder), table(spark, folder, "labels")
    words = tx.wordpunct(F.col("text"))
    measured = docs.select(
        F.col("doc_id").alias("user_id"),
        F.col("n_chars").cast("double").alias("num_chars"),
        F.size(words).cast("double").alias("num_words"),
        F.size(F.array_distinct(words)).cast("double").alias("num_unique_words"),
        F.size(F.split("text", "\n")).cast("double").alias("num_lines"),
        tx.count_matches(F.col("text"), "[0-9]").cast("double").alias("num_digits"),
        tx.count_matches(F.col("text"), r"[\p{Lu}]").cast("double").alias("num_capitals"),
        F.when(F.col("lang") == "en", 0).otherwise(1).alias("cluster"),
    )
    return measured.join(labels.select(F.col("doc_id").alias("user_id"), F.col("quality").alias("user_type")), "user_id")


# The same bindings as SQL fragments.

def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_WORDS = f"regexp_extract_all(lower(text), {sql_text(tx.WORDPUNCT)})"
SQL_STRIPPED = f"list_transform({SQL_WORDS}, lambda t: trim(trim(trim(t), '_'), '*'))"
SQL_NO_PUNCT = f"list_filter({SQL_STRIPPED}, lambda t: NOT regexp_matches(t, {sql_text(tx.PUNCTUATION)}))"
SQL_STOPWORDS = "[" + ", ".join(sql_text(w) for w in tx.STOPWORDS) + "]"
SQL_CLEAN = f"list_filter({SQL_NO_PUNCT}, lambda t: NOT list_contains({SQL_STOPWORDS}, t))"
SQL_SHARES = ", ".join(f"count(*) FILTER (event_type = '{e}') / count(*)::DOUBLE" for e in EVENT_TYPES)
SQL_DIST = f"dist AS (SELECT user_id, [{SQL_SHARES}] AS p FROM events GROUP BY user_id)"
SQL_LONG = (
    SQL_DIST + ", long AS (SELECT user_id, unnest(range(5)) AS topic, unnest(p) AS p FROM dist)"
)
SQL_TOKENS = f"tok AS (SELECT doc_id, {SQL_CLEAN} AS tokens FROM documents)"
SQL_TERMS = SQL_TOKENS + """, terms AS (
  SELECT doc_id, list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) AS terms
  FROM tok)"""
SQL_TF = SQL_TERMS + """, tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM terms) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)"""
SQL_STATIC = f"""static AS (
  SELECT doc_id AS user_id, toxic AS user_type, len(string_split(text, chr(10)))::DOUBLE AS num_tweets,
         n_chars::DOUBLE AS num_followers, quality::DOUBLE AS num_followings, length(source)::DOUBLE AS about_me_length,
         length(lang)::DOUBLE AS user_name_length,
         len(regexp_extract_all(text, {sql_text(tx.MENTION)}))::DOUBLE AS num_annotations,
         len(regexp_extract_all(text, 'http'))::DOUBLE AS num_http,
         length(text) / len(string_split(text, chr(10)))::DOUBLE AS tweet_avg_length,
         len(list_distinct({SQL_WORDS}))::DOUBLE AS num_unique_words
  FROM documents JOIN labels USING (doc_id))"""
