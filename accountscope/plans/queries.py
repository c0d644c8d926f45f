"""Registered queries: every operator over the supplied tables, with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accountscope.config import MODELS, ClassifyConfig, ClusterConfig, FeatureConfig, RunConfig, score_columns
from accountscope.functions import text as tx
from accountscope.functions.arrays import rounded
from accountscope.operators import (
    boost, classify, cluster, collate, exact, metrics, nmf, prep, scores, splits, text, topics, tuning,
)
from accountscope.plans import bindings as b
from accountscope.plans import stages
from accountscope.session import compact, materialise, scratch_path, tune
from accountscope.sources import arff, csv, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(tune(spark), folder)
        if sql:
            ORACLE[key] = sql
        return fn

    return register


def _round_all(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n)) for n in names})


def _r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def _joined_md5(tokens: str | Column) -> Column:
    return F.md5(F.array_join(tokens, " "))


# ---------------------------------------------------------------- sources and sinks


@query("""
SELECT event_id, event_type, CASE WHEN event_type <> 'signup' THEN value END AS value
FROM events WHERE event_type <> 'error'""")
def src_csv(spark, folder):
    """Error events are written with a surplus field, signup events without their last one; a bare quote is text."""
    e = b.table(spark, folder, "events")
    fields = [F.col("event_id").cast("string"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))]
    value = F.col("value").cast("string")
    line = F.when(F.col("event_type") == "signup", F.concat_ws(",", *fields))
    line = line.when(F.col("event_type") == "error", F.concat_ws(",", *fields, value, F.lit("surplus")))
    path = scratch_path(spark, "csv")
    stray = F.concat_ws(",", F.lit('5" tall'), F.lit('so"me'), value)  # no number in its first field
    rows = e.select(F.explode(F.array(line.otherwise(F.concat_ws(",", *fields, value)), stray)).alias("value"))
    rows.write.text(path)
    read = csv.read_csv(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE", header=False)
    return read.where("event_id IS NOT NULL")


@query("SELECT doc_id, md5(text) AS text_md5, length(text) AS n, lang FROM documents")
def src_csv_multiline(spark, folder):
    """Texts with line breaks and quotes, written and read back; records span lines and file blocks."""
    path = scratch_path(spark, "csv")
    csv.write_csv(b.table(spark, folder, "documents").select("doc_id", "text", "lang"), path)
    docs = csv.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING")
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"), "lang")


@query("SELECT o_orderkey, o_totalprice, true AS labelled FROM orders")
def src_csv_many(spark, folder):
    path = scratch_path(spark, "csv")
    csv.write_csv(b.table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), path)
    many = csv.read_csv_many(spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE", "frame")
    return many.select("o_orderkey", "o_totalprice", F.col("frame").startswith("part-").alias("labelled"))


@query("""
SELECT doc_id AS user_id, toxic AS user_type, n_chars::DOUBLE AS num_chars, source
FROM documents LEFT JOIN labels USING (doc_id)""")
def src_arff(spark, folder):
    """Every file carries its own declaring header; unlabelled rows hold a question mark."""
    docs = b.table(spark, folder, "documents").join(b.table(spark, folder, "labels"), "doc_id", "left")
    row = F.concat_ws(",", F.col("doc_id"), F.coalesce(F.col("toxic").cast("string"), F.lit("?")), F.col("n_chars"),
                      F.concat(F.lit("'"), F.col("source"), F.lit("'")))
    header = ["% accounts", "@relation accounts", "", "@attribute UserID numeric", "@ATTRIBUTE 'User Type' {0,1}",
              "@attribute chars REAL", "@attribute source string", "@data"]

    def with_header(batches):
        import pandas as pd

        yield pd.DataFrame({"value": header})
        yield from batches

    path = scratch_path(spark, "arff")
    docs.select(row.alias("value")).mapInPandas(with_header, "value STRING").write.text(path)
    read = arff.read_arff(spark, path).withColumnsRenamed({"UserID": "user_id", "User Type": "user_type", "chars": "num_chars"})
    return prep.cast_label(prep.coerce_id(read))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk_csv(spark, folder):
    path = scratch_path(spark, "csv")
    csv.write_csv(b.table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return spark.read.csv(path, schema="c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE", header=True)


@query("SELECT vec_id, label AS cluster FROM embeddings")
def snk_partitioned(spark, folder):
    path = scratch_path(spark, "clusters")
    sinks.write_partitioned(b.table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("cluster")), path)
    return spark.read.parquet(path)


def _label_outcomes(spark, folder) -> DataFrame:
    """``quality`` read as a prediction of ``toxic``, on the test part of ten stratified splits."""
    flagged = splits.strat_shuffle_splits(b.table(spark, folder, "labels"), "doc_id", "toxic")
    counted = metrics.outcome_counts(flagged.where("is_test"), ["split"], "toxic", "quality")
    return counted.select(
        F.lit(0).alias("cluster"), F.lit("quality").alias("model"), "split",
        F.col("toxic").alias("label"), F.col("quality").alias("prediction"), "n",
    )


def _split_sql(label: str) -> str:
    return f"""ranked AS (
  SELECT split, doc_id, quality, toxic,
         row_number() OVER (PARTITION BY split, {label} ORDER BY md5((42 + split) || ':' || doc_id), doc_id) AS r
  FROM labels, (SELECT unnest(range(10))::INTEGER AS split)),
classes AS (SELECT {label}, count(*) AS n, count(*) * ceil(0.4 * sum(count(*)) OVER ()) / sum(count(*)) OVER () AS exact,
                   ceil(0.4 * sum(count(*)) OVER ()) AS total FROM labels GROUP BY {label}),
quota AS (SELECT {label}, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, {label})
                 <= total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM classes),
parts AS (SELECT split, doc_id, quality, toxic, r <= quota AS is_test FROM ranked JOIN quota USING ({label}))"""


_SPLIT_SQL = _split_sql("toxic")

_PRF_SQL = """sides AS (
  SELECT g, toxic AS class, (toxic = quality)::INT AS hit, 1 AS sup, 0 AS pred FROM base
  UNION ALL SELECT g, quality, 0, 0, 1 FROM base),
sums AS (SELECT g, class, sum(hit)::DOUBLE AS hit, sum(sup)::DOUBLE AS sup, sum(pred)::DOUBLE AS pred FROM sides GROUP BY g, class),
pr AS (SELECT g, class, CASE WHEN pred > 0 THEN hit / pred ELSE 0 END AS precision,
              CASE WHEN sup > 0 THEN hit / sup ELSE 0 END AS recall, sup::BIGINT AS support FROM sums),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""

_REPORT_SQL = f"""WITH {_SPLIT_SQL},
base AS (SELECT 0 AS g, quality, toxic FROM parts WHERE is_test AND split = 0), {_PRF_SQL},
acc AS (SELECT split, avg((quality = toxic)::INT) AS a FROM parts WHERE is_test GROUP BY split),
report AS (
  SELECT 'averaged_accuracy_score' AS metric, NULL::INTEGER AS class, avg(a) AS value FROM acc
  UNION ALL SELECT 'averaged_accuracy_sd', NULL, 2 * stddev_pop(a) FROM acc
  UNION ALL SELECT unnest(['precision', 'recall', 'f1', 'support']), class, unnest([precision, recall, f1, support::DOUBLE]) FROM prf
  UNION ALL SELECT unnest(['weighted_precision', 'weighted_recall', 'weighted_f1', 'weighted_support']), NULL,
    unnest([sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
            sum(support)::DOUBLE]) FROM prf
  UNION ALL SELECT 'predicted_as_' || quality, toxic, count(*)::DOUBLE FROM base GROUP BY quality, toxic)
"""


@query(_REPORT_SQL + f"SELECT 0 AS cluster, 'quality' AS model, metric, class, {_r('value')} AS value FROM report")
def collect_results(spark, folder):
    return _round_all(classify.metric_report(_label_outcomes(spark, folder)), "value")


@query(_REPORT_SQL + """, shown AS (
  SELECT CASE WHEN class IS NULL THEN metric ELSE metric || '_' || class END AS k, printf('%.2f', round(value, 12)) AS v FROM report)
SELECT 0 AS cluster, '{"quality":{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}}' AS document FROM shown""")
def snk_json(spark, folder):
    report = classify.metric_report(_label_outcomes(spark, folder))
    sinks.write_json(report, scratch_path(spark, "json"))
    return sinks.nested_report(report)


# ---------------------------------------------------------------- projection and cleaning


@query(f"WITH {b.SQL_STATIC} SELECT * REPLACE (user_type::VARCHAR AS user_type, {_r('tweet_avg_length')} AS tweet_avg_length) FROM static")
def rename_static(spark, folder):
    return _round_all(prep.rename_static(b.static_raw(spark, folder)), "tweet_avg_length")


@query("""
SELECT doc_id::VARCHAR AS user_id, (n - 1)::VARCHAR AS tweet_id, md5(tweet) AS tweet,
       strftime(to_timestamp(1262304000 + n - 1) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS creation_date
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS tweet, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)""")
def rename_tweets(spark, folder):
    return prep.rename_tweets(b.posts_raw(b.table(spark, folder, "documents"))).withColumn("tweet", F.md5("tweet"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def drop_cols(spark, folder):
    return prep.drop_cols(b.table(spark, folder, "events"), "ts", "props")


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'error'")
def coerce_id(spark, folder):
    """Error events carry a malformed id, signup events one that was written as a float."""
    e = b.table(spark, folder, "events")
    raw = F.when(F.col("event_type") == "error", F.concat(F.lit("u"), F.col("user_id")))
    raw = raw.when(F.col("event_type") == "signup", F.concat(F.col("user_id"), F.lit(".0"))).otherwise(F.col("user_id").cast("string"))
    return prep.coerce_id(e.select("event_id", raw.alias("user_id")))


@query("SELECT doc_id, toxic FROM labels")
def cast_label(spark, folder):
    nominal = b.table(spark, folder, "labels").select("doc_id", F.col("toxic").cast("string").cast("binary").cast("string").alias("toxic"))
    return prep.cast_label(nominal, "toxic")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def select_features(spark, folder):
    flags = {"l_quantity": True, "l_extendedprice": False, "l_discount": True, "l_tax": False}
    return prep.select_features(b.table(spark, folder, "lineitem"), flags, keep=["l_orderkey", "l_linenumber"])


@query("SELECT conv_id, text FROM conversations")
def project_text(spark, folder):
    return prep.project_text(b.table(spark, folder, "conversations"), "conv_id", "text")


@query(f"WITH {b.SQL_STATIC} SELECT user_id, num_tweets AS x0, num_http AS x1, num_unique_words AS x2, user_type::DOUBLE AS label FROM static")
def xy_split_cols(spark, folder):
    static = prep.cast_label(prep.rename_static(b.static_raw(spark, folder))).select("user_id", "user_type", "num_tweets", "num_http", "num_unique_words")
    xy = classify.assemble(static, classify.xy_split_cols(static))
    x = vector_to_array("features")
    return xy.select("user_id", *[x[i].alias(f"x{i}") for i in range(3)], "label")


def _holed_events(spark, folder) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    holed = F.when(kind == "error", F.lit(float("inf"))).when(kind == "signup", F.lit(float("nan"))).when(kind != "click", value)
    return b.table(spark, folder, "events").select("event_id", "event_type", holed.alias("value"))


@query("""SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'Infinity' ELSE value::VARCHAR END AS shown
FROM events WHERE event_type NOT IN ('signup', 'click')""")
def drop_nan_rows(spark, folder):
    kept = prep.drop_nan_rows(_holed_events(spark, folder))
    return kept.select("event_id", "event_type", F.col("value").cast("string").alias("shown"))


@query("""SELECT event_id, event_type, CASE WHEN event_type IN ('purchase', 'view') THEN value END AS value
FROM events WHERE event_type <> 'signup'""")
def inf_to_null(spark, folder):
    return prep.inf_to_null(_holed_events(spark, folder).where("event_type <> 'signup'"))


@query("SELECT doc_id, 1 AS user_type FROM labels")
def add_const_label(spark, folder):
    return prep.add_const_label(b.table(spark, folder, "labels").select("doc_id"), prep.POLLUTER)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def head_slice(spark, folder):
    return prep.head_slice(b.table(spark, folder, "orders"), 100, F.desc("o_totalprice"), "o_orderkey")


# ---------------------------------------------------------------- joins and set operations


def _order_cohorts(spark, folder) -> tuple[DataFrame, DataFrame]:
    o = b.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return tuple(o.where(F.col("o_orderpriority") == p).drop("o_orderpriority") for p in ("1-URGENT", "5-LOW"))


_COHORT_SQL = """WITH a AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'),
b AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')"""


@query(_COHORT_SQL + """
SELECT *, 1 AS user_type FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)
UNION ALL SELECT *, 0 FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)""")
def disjoint_cohorts(spark, folder):
    first, second = prep.disjoint_cohorts(*_order_cohorts(spark, folder), "o_custkey")
    return prep.union_cohorts(prep.add_const_label(first, 1), prep.add_const_label(second, 0))


@query(_COHORT_SQL + """
SELECT *, 1 AS user_type FROM a WHERE o_custkey IN (SELECT o_custkey FROM b)
UNION ALL SELECT *, 0 FROM b WHERE o_custkey IN (SELECT o_custkey FROM a)""")
def square_frames(spark, folder):
    first, second = prep.square_frames(*_order_cohorts(spark, folder), "o_custkey")
    return prep.union_cohorts(prep.add_const_label(first, 1), prep.add_const_label(second, 0))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN
(SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100)""")
def follow_sample(spark, folder):
    sampled = splits.sample_n(b.table(spark, folder, "customer"), "c_custkey", 100)
    orders = b.table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return splits.follow_sample(orders, sampled, "c_custkey").withColumnRenamed("c_custkey", "o_custkey")


@query(_COHORT_SQL + " SELECT * FROM a UNION ALL SELECT * FROM b")
def union_cohorts(spark, folder):
    return prep.union_cohorts(*_order_cohorts(spark, folder))


_SCORES_SQL = f"""WITH {b.SQL_LONG},
e AS (SELECT user_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS dt_entropy FROM long GROUP BY user_id),
g AS (SELECT user_id, topic, CASE WHEN d >= 1e-12 THEN (p - m) / d END AS s FROM long JOIN
      (SELECT topic, avg(p) AS m, sqrt(count(*)) * stddev_pop(p) AS d FROM long GROUP BY topic) USING (topic)),
l AS (SELECT user_id, topic, CASE WHEN d >= 1e-12 THEN (p - m) / d END AS s FROM long JOIN
      (SELECT user_id, avg(p) AS m, sqrt(count(*)) * stddev_pop(p) AS d FROM long GROUP BY user_id) USING (user_id)),
wide AS (SELECT user_id, dt_entropy, {", ".join(f"max(g.s) FILTER (g.topic = {k}) AS goss_{k}" for k in range(5))},
         {", ".join(f"max(l.s) FILTER (l.topic = {k}) AS loss_{k}" for k in range(5))}
         FROM e JOIN g USING (user_id) JOIN l USING (user_id) GROUP BY user_id, dt_entropy)
"""
_GOSS = [f"goss_{k}" for k in range(5)]
_LOSS = [f"loss_{k}" for k in range(5)]
_ALL_SCORES = ", ".join(f"{_r(c)} AS {c}" for c in score_columns(5))
_VALID = " AND ".join(f"{c} IS NOT NULL" for c in score_columns(5))


@query(_SCORES_SQL + f"SELECT user_id, {_ALL_SCORES} FROM wide")
def glue_features(spark, folder):
    d = materialise(b.event_shares(spark, folder), "shares")
    glued = prep.glue_features(scores.dt_entropy(d, 5), scores.goss(d, 5), scores.loss(d, 5))
    return _round_all(glued, *score_columns(5))


@query(_SCORES_SQL + f""", static AS (
  SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN value END) AS mean_value,
         CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN count(*)::DOUBLE / count(*) FILTER (event_type = 'purchase') END AS per_purchase
  FROM events GROUP BY user_id)
SELECT user_id, {_r('mean_value')} AS mean_value, {_r('per_purchase')} AS per_purchase, {_ALL_SCORES}
FROM static JOIN wide USING (user_id) WHERE {_VALID} AND mean_value IS NOT NULL AND per_purchase IS NOT NULL""")
def consolidate(spark, folder):
    """A user without purchases has an infinite ratio and leaves the table."""
    e = b.table(spark, folder, "events")
    purchases = F.count_if(F.col("event_type") == "purchase")
    static = e.groupBy("user_id").agg(
        F.avg(F.when(F.col("event_type") != "error", F.col("value"))).alias("mean_value"),
        F.coalesce(F.try_divide(F.count(F.lit(1)), purchases), F.lit(float("inf"))).alias("per_purchase"),
    )
    dynamic = scores.dynamic_features(b.event_shares(spark, folder), 5)
    return _round_all(prep.consolidate(static, dynamic), "mean_value", "per_purchase", *score_columns(5))


# ---------------------------------------------------------------- aggregation, dedup, sampling, splits

_COLLATE_SQL = "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


@query(_COLLATE_SQL)
def collate_docs(spark, folder):
    return collate.collate_docs(b.table(spark, folder, "conversations"), "conv_id", "text", ["turn"])


@query(_COLLATE_SQL)
def collate_hot_accounts(spark, folder):
    """The same documents by way of the path for very large accounts."""
    return collate.collate_docs(b.table(spark, folder, "conversations"), "conv_id", "text", ["turn"], max_rows=2)


@query("""SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN 'nan' ELSE text END, ' ' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def collate_missing_as_text(spark, folder):
    posts = b.table(spark, folder, "conversations").withColumn("text", F.when(F.col("role") != "assistant", F.col("text")))
    return collate.collate_docs(posts, "conv_id", "text", ["turn"], null_text="nan")


@query("SELECT doc_id AS user_id, md5(replace(text, chr(10), ' ')) AS tweet FROM documents")
def tweet_set(spark, folder):
    documents = collate.tweet_set(b.posts_raw(b.table(spark, folder, "documents")), parts=False)
    return documents.withColumn("tweet", F.md5("tweet"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def dedup_key(spark, folder):
    o = b.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return prep.dedup_key(o, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("SELECT * FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100")
def sample_n(spark, folder):
    return splits.sample_n(b.table(spark, folder, "customer"), "c_custkey", 100)


@query(f"WITH {_SPLIT_SQL} SELECT doc_id, quality, toxic, is_test FROM parts WHERE split = 0")
def strat_split(spark, folder):
    return splits.strat_split(b.table(spark, folder, "labels"), "doc_id", "toxic")


@query(f"WITH {_SPLIT_SQL} SELECT split, doc_id, toxic, is_test FROM parts")
def strat_shuffle_splits(spark, folder):
    return splits.strat_shuffle_splits(b.table(spark, folder, "labels").drop("quality"), "doc_id", "toxic")


@query("""SELECT split, doc_id, row_number() OVER (PARTITION BY split ORDER BY md5((42 + split) || ':' || doc_id), doc_id)
  <= ceil(0.4 * count(*) OVER (PARTITION BY split)) AS is_test
FROM documents, (SELECT unnest(range(10))::INTEGER AS split)""")
def shuffle_splits(spark, folder):
    return splits.shuffle_splits(b.table(spark, folder, "documents").select("doc_id"), "doc_id")


@query("""SELECT doc_id, toxic, (ntile(10) OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) - 1)::INTEGER AS fold FROM labels""")
def stratified_kfold(spark, folder):
    return splits.stratified_kfold(b.table(spark, folder, "labels").drop("quality"), "doc_id", "toxic")


@query("""SELECT quality AS cluster, count(*) AS size, count(*) FILTER (toxic = 0) AS n_0, count(*) FILTER (toxic = 1) AS n_1
FROM labels GROUP BY ROLLUP (quality)""")
def cluster_composition(spark, folder):
    labels = b.table(spark, folder, "labels").select(F.col("quality").alias("cluster"), F.col("toxic").alias("user_type"))
    return cluster.cluster_composition(labels)


@query("SELECT vec_id, label AS cluster FROM embeddings WHERE label = 3")
def segment_by_cluster(spark, folder):
    return cluster.segment_by_cluster(b.table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("cluster")), 3)


@query(f"""WITH {_SPLIT_SQL}, acc AS (SELECT split, avg((quality = toxic)::INT) AS a FROM parts WHERE is_test GROUP BY split)
SELECT {_r('avg(a)')} AS averaged_accuracy_score, {_r('2 * stddev_pop(a)')} AS averaged_accuracy_sd FROM acc""")
def mean_sd(spark, folder):
    flagged = splits.strat_shuffle_splits(b.table(spark, folder, "labels"), "doc_id", "toxic").where("is_test")
    return _round_all(
        metrics.mean_sd(metrics.accuracy_score(flagged, ["split"], "toxic", "quality")),
        "averaged_accuracy_score", "averaged_accuracy_sd",
    )


# ---------------------------------------------------------------- text


def _token_query(name: str, sql_tokens: str, tokens: Callable[[Column], Column]) -> None:
    def run(spark, folder):
        made = b.documents(spark, folder).select("doc_id", tokens(F.col("text")).alias("t"))
        return made.select(
            "doc_id", F.size("t").cast("bigint").alias("n"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
            _joined_md5("t").alias("tokens_md5"),
        )

    query(
        f"""SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5
FROM (SELECT doc_id, {sql_tokens} AS t FROM documents)""",
        name,
    )(run)


_token_query("tokenize_wordpunct", b.SQL_WORDS, tx.wordpunct)
_token_query("strip_token", b.SQL_STRIPPED, lambda c: tx.strip_tokens(tx.wordpunct(c)))
_token_query("drop_punct", b.SQL_NO_PUNCT, lambda c: tx.drop_punct(tx.strip_tokens(tx.wordpunct(c))))
_token_query("drop_stopwords", b.SQL_CLEAN, lambda c: tx.drop_stopwords(tx.drop_punct(tx.strip_tokens(tx.wordpunct(c)))))
_token_query("tokenize_corpus", b.SQL_CLEAN, tx.clean_tokens)


@query(f"""WITH {b.SQL_TOKENS}, words AS (SELECT DISTINCT unnest(tokens) AS token FROM tok),
lemmas AS (SELECT token, left(token, length(token) - 1) AS lemma FROM words
           WHERE length(token) > 3 AND right(token, 1) = 's' AND left(token, length(token) - 1) IN (SELECT token FROM words)),
flat AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM tok)
SELECT d.doc_id, count(token) AS n, md5(coalesce(string_agg(coalesce(lemma, token), ' ' ORDER BY i), '')) AS tokens_md5
FROM documents d LEFT JOIN flat USING (doc_id) LEFT JOIN lemmas USING (token) GROUP BY d.doc_id""")
def lemmatize_dict(spark, folder):
    """Lemma table taken from the corpus: a word in -s whose stem also occurs."""
    tokens = b.clean_documents(spark, folder)
    words = tx.explode_terms(tokens, F.array_distinct("tokens"), "token").distinct()
    stem = F.expr("left(token, length(token) - 1)")
    candidates = words.where((F.length("token") > 3) & F.col("token").endswith("s")).select("token", stem.alias("lemma"))
    lemmas = candidates.join(words.withColumnRenamed("token", "lemma"), "lemma", "left_semi")
    replaced = text.lemmatize_dict(tokens, lemmas, "doc_id")
    return replaced.select("doc_id", F.size("tokens").cast("bigint").alias("n"), _joined_md5("tokens").alias("tokens_md5"))


@query(f"WITH {b.SQL_TERMS} SELECT doc_id, len(terms) AS n, md5(coalesce(array_to_string(terms, '|'), '')) AS terms_md5 FROM terms")
def ngrams_1_2(spark, folder):
    terms = b.document_terms(spark, folder)
    return terms.select("doc_id", F.size("terms").cast("bigint").alias("n"), F.md5(F.array_join("terms", "|")).alias("terms_md5"))


def _pruned_sql(low: float, high: float) -> str:
    return b.SQL_TF + f", kept AS (SELECT term, df FROM df, n WHERE df >= {low} * n AND df <= {high} * n)"



@query(f"WITH {_pruned_sql(0.15, 0.85)} SELECT term, df FROM kept")
def df_prune(spark, folder):
    terms = b.document_terms(spark, folder)
    return text.df_prune(text.document_freq(terms, "doc_id"), text.document_count(terms, "doc_id"))


@query(f"WITH {_pruned_sql(0.15, 0.85)} SELECT doc_id, term, tf FROM tf SEMI JOIN kept USING (term)")
def term_freq(spark, folder):
    terms = b.document_terms(spark, folder)
    kept = text.df_prune(text.document_freq(terms, "doc_id"), text.document_count(terms, "doc_id"))
    return text.keep_terms(text.term_freq(terms, "doc_id"), kept)


_IDS_SQL = f"WITH {b.SQL_TF}, ids AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS id FROM df)"


@query(_IDS_SQL + " SELECT term, id, df FROM ids")
def term_ids(spark, folder):
    """The dictionary of all terms, unpruned."""
    return text.term_ids(text.document_freq(b.document_terms(spark, folder), "doc_id"))


@query(_IDS_SQL + """, entries AS (
  SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, string_agg(tf::VARCHAR, ',' ORDER BY id) AS tf
  FROM tf JOIN ids USING (term) GROUP BY doc_id)
SELECT doc_id, md5(coalesce(ids, '')) AS ids, md5(coalesce(entries.tf, '')) AS tf FROM documents LEFT JOIN entries USING (doc_id)""")
def indexed_terms(spark, folder):
    """Term counts of all documents by dictionary id."""
    terms = b.stored_terms(spark, folder)
    ids = text.term_ids(text.document_freq(terms, "doc_id"))
    made = text.indexed_terms(text.term_freq(terms, "doc_id"), ids, documents=terms, key="doc_id")
    return made.select("doc_id", *[F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c) for c in ("ids", "tf")])


def _tfidf(spark, folder) -> tuple[DataFrame, DataFrame]:
    terms = b.document_terms(spark, folder)
    n = text.document_count(terms, "doc_id")
    kept = materialise(text.df_prune(text.document_freq(terms, "doc_id"), n, 0.1, 0.9), "vocabulary")
    return text.tfidf(text.term_freq(terms, "doc_id"), kept, n, "doc_id"), kept


@query(f"""WITH {_pruned_sql(0.1, 0.9)},
w AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN kept USING (term), n)
SELECT doc_id, term, {_r('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM w""")
def tfidf(spark, folder):
    return _round_all(_tfidf(spark, folder)[0], "weight")


@query(f"""WITH {b.SQL_TF} SELECT doc_id, count(*) FILTER (tf = 1) AS singles FROM documents LEFT JOIN tf USING (doc_id) GROUP BY doc_id""")
def singly_occurring(spark, folder):
    terms = b.document_terms(spark, folder)
    return text.singly_occurring(text.term_freq(terms, "doc_id"), terms, "doc_id")


@query(f"""WITH {b.SQL_TF}, p AS (SELECT doc_id, tf / sum(tf) OVER (PARTITION BY doc_id) AS p FROM tf)
SELECT doc_id, {_r('-sum(p * ln(p))')} AS entropy FROM p GROUP BY doc_id""")
def row_entropy_tf(spark, folder):
    return _round_all(text.row_entropy_tf(text.term_freq(b.document_terms(spark, folder), "doc_id"), "doc_id"), "entropy")


@query(f"""WITH {b.SQL_TF} SELECT doc_id, coalesce(sum(tf) FILTER (df >= 0.2 * n), 0)::BIGINT AS frequent_words
FROM documents LEFT JOIN tf USING (doc_id) LEFT JOIN df USING (term), n GROUP BY doc_id""")
def frequent_words(spark, folder):
    terms = b.document_terms(spark, folder)
    n = text.document_count(terms, "doc_id")
    return text.frequent_words(text.term_freq(terms, "doc_id"), text.document_freq(terms, "doc_id"), n, 0.2, terms, "doc_id")


@query(f"""WITH m AS (SELECT conv_id, count(*) AS num_tweets, sum(len(regexp_extract_all(text, {b.sql_text(tx.MENTION)})))::BIGINT AS num_annotations,
  sum(len(regexp_extract_all(text, 'http')))::BIGINT AS num_http, {_r('avg(length(text))')} AS tweet_avg_length FROM conversations GROUP BY conv_id),
w AS (SELECT conv_id, count(DISTINCT t) AS num_unique_words FROM (SELECT conv_id, unnest({b.SQL_WORDS}) AS t FROM conversations) GROUP BY conv_id)
SELECT m.*, coalesce(num_unique_words, 0) AS num_unique_words FROM m LEFT JOIN w USING (conv_id)""")
def text_stats(spark, folder):
    return _round_all(prep.text_stats(b.table(spark, folder, "conversations"), "conv_id", "text"), "tweet_avg_length")


@query(f"""SELECT user_id, {_r("count(*)::DOUBLE / count(DISTINCT date_trunc('day', ts))")} AS "average_tweets_ByDay",
{_r("count(*)::DOUBLE / count(DISTINCT date_trunc('hour', ts))")} AS "average_tweets_ByHour",
{_r("count(*)::DOUBLE / count(DISTINCT date_trunc('month', ts))")} AS "average_tweets_ByMonth" FROM events GROUP BY user_id""")
def avg_by_period(spark, folder):
    return _round_all(
        prep.avg_by_period(b.table(spark, folder, "events"), "user_id", "ts"),
        "average_tweets_ByDay", "average_tweets_ByHour", "average_tweets_ByMonth",
    )


# ---------------------------------------------------------------- topics and scores


def _language_weights(spark, folder) -> DataFrame:
    """Given weights: term counts per language stand in for a topic-word table."""
    words = b.clean_documents(spark, folder).join(b.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    counted = tx.explode_terms(words, "tokens", "term", "lang").groupBy("lang", "term").count()
    return counted.select(F.col("lang").alias("topic"), "term", F.col("count").cast("double").alias("weight"))


_WEIGHTS_SQL = f"""WITH {b.SQL_TOKENS}, weights AS (
  SELECT lang AS topic, term, count(*)::DOUBLE AS weight
  FROM (SELECT doc_id, unnest(tokens) AS term FROM tok) JOIN documents USING (doc_id) GROUP BY lang, term)"""


@query(_WEIGHTS_SQL + f" SELECT topic, term, round(weight / sum(weight) OVER (PARTITION BY topic), 9) AS weight FROM weights")
def tw_dist(spark, folder):
    return topics.tw_dist(_language_weights(spark, folder)).withColumn("weight", F.round("weight", 9))


@query(_WEIGHTS_SQL + """ SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term)::INTEGER AS rank
FROM weights QUALIFY rank <= 10""")
def top_words(spark, folder):
    return topics.top_words(_language_weights(spark, folder), 10)


@query(_SCORES_SQL + f"SELECT user_id, {_r('dt_entropy')} AS dt_entropy FROM e")
def dt_entropy(spark, folder):
    return _round_all(scores.dt_entropy(b.event_shares(spark, folder), 5), "dt_entropy")


@query(_SCORES_SQL + f"SELECT user_id, topic::INTEGER AS topic, {_r('s')} AS goss FROM g")
def goss(spark, folder):
    return _round_all(scores.long_scores(scores.goss(b.event_shares(spark, folder), 5), "goss", 5), "goss")


@query(_SCORES_SQL + f"SELECT user_id, topic::INTEGER AS topic, {_r('s')} AS loss FROM l")
def loss(spark, folder):
    return _round_all(scores.long_scores(scores.loss(b.event_shares(spark, folder), 5), "loss", 5), "loss")


@query(_SCORES_SQL + f"SELECT user_id, {_ALL_SCORES} FROM wide WHERE {_VALID}")
def dynamic_features(spark, folder):
    return _round_all(scores.dynamic_features(b.event_shares(spark, folder), 5), *score_columns(5))


@query(_SCORES_SQL + f"""SELECT user_id, {_ALL_SCORES}, {_r('greatest(' + ', '.join(f'abs({c})' for c in _GOSS) + ')')} AS peak_goss
FROM wide WHERE {_VALID} ORDER BY peak_goss DESC, user_id LIMIT 20""")
def most_unusual(spark, folder):
    """Which users have the most unusual event mix?"""
    found = scores.most_unusual(scores.dynamic_features(b.event_shares(spark, folder), 5), 5)
    return _round_all(found, *score_columns(5), "peak_goss")


def _document_model(spark, folder):
    terms = b.stored_terms(spark, folder)
    kept = text.df_prune(text.document_freq(terms, "doc_id"), text.document_count(terms, "doc_id"))
    vocabulary = text.vocabulary_list(kept)
    vectors = materialise(text.term_vectors(terms, vocabulary, "doc_id"), "term-vectors")
    return topics.lda_fit(vectors, FeatureConfig()), vectors, vocabulary


@query()
def lda_fit(spark, folder):
    model, vectors, vocabulary = _document_model(spark, folder)
    return topics.topic_weights(model, vocabulary)


@query(f"""WITH {b.SQL_TF}, kept AS (SELECT term FROM df, n WHERE df BETWEEN 0.15 * n AND 0.85 * n),
own AS (SELECT doc_id, count(*) AS terms FROM tf JOIN kept USING (term) GROUP BY doc_id)
SELECT doc_id, coalesce(terms, 0) AS kept_terms, 1.0::DOUBLE AS total, CASE WHEN terms IS NULL THEN 0.2::DOUBLE END AS even_share
FROM documents LEFT JOIN own USING (doc_id)""")
def dt_dist(spark, folder):
    """Shares sum to one; they are all 1/K exactly where a document has no kept term, and differ elsewhere."""
    model, vectors, _ = _document_model(spark, folder)
    total = F.round(F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total")
    even = F.when(F.array_max("p") == F.array_min("p"), F.array_max("p")).alias("even_share")
    counts = vectors.select("doc_id", F.size(F.filter(vector_to_array("tf"), lambda x: x > 0)).cast("bigint").alias("kept_terms"))
    return topics.dt_dist(model, vectors, "doc_id").select("doc_id", total, even).join(counts, "doc_id")


@query()
def tw_dist_of_model(spark, folder):
    model, _, vocabulary = _document_model(spark, folder)
    return topics.tw_dist(topics.topic_weights(model, vocabulary))


@query()
def nmf_fit(spark, folder):
    weights, kept = _tfidf(spark, folder)
    model = nmf.nmf_fit(materialise(weights, "tfidf"), text.vocabulary_list(kept), key="doc_id")
    return topics.top_words(nmf.component_weights(weights, model), 10)


# ---------------------------------------------------------------- clustering


def _event_measures(spark, folder) -> DataFrame:
    return b.table(spark, folder, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("num_events"), F.avg("value").alias("mean_value"), F.lit(7.0).alias("constant")
    )


@query(f"""WITH m AS (SELECT user_id, count(*)::DOUBLE AS num_events, avg(value) AS mean_value FROM events GROUP BY user_id)
SELECT user_id, {_r('(num_events - avg(num_events) OVER ()) / stddev_pop(num_events) OVER ()')} AS num_events,
       {_r('(mean_value - avg(mean_value) OVER ()) / stddev_pop(mean_value) OVER ()')} AS mean_value, 0.0::DOUBLE AS constant FROM m""")
def standard_scale(spark, folder):
    columns = ["num_events", "mean_value", "constant"]
    return _round_all(cluster.standard_scale(_event_measures(spark, folder), columns), *columns)


@query(f"WITH {b.SQL_STATIC} SELECT user_id, num_unique_words, num_followers FROM static")
def choose_cluster_features(spark, folder):
    static = prep.rename_static(b.static_raw(spark, folder))
    return stages.choose_cluster_features(static, ClusterConfig(features=("num_unique_words", "num_followers")))


def _label_centres(spark, folder) -> tuple[DataFrame, list[list[float]]]:
    """Vectors ``v``, and the mean vector of each label: at most ``MAX_CLASSES`` labels."""
    e = b.table(spark, folder, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    each = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    rows = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m")).orderBy("label").limit(splits.MAX_CLASSES + 1).collect()
    if len(rows) > splits.MAX_CLASSES:
        raise ValueError("too many labels")
    return e, [[x["m"] for x in row["m"]] for row in rows]


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i),
d AS (SELECT vec_id, c.label AS centre, sum((x - m) * (x - m)) AS d FROM e JOIN c USING (i) GROUP BY vec_id, c.label)
SELECT vec_id, (arg_min(centre, d))::INTEGER AS cluster FROM d GROUP BY vec_id""")
def assign_cluster(spark, folder):
    """Fixed centres: the mean vector of each label; every vector goes to the closest one."""
    e, centres = _label_centres(spark, folder)
    return cluster.nearest_centre(e, "v", centres).select("vec_id", "cluster")


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i),
d AS (SELECT vec_id, c.label AS centre, sum((x - m) * (x - m)) AS d FROM e JOIN c USING (i) GROUP BY vec_id, c.label),
own AS (SELECT vec_id, (arg_min(centre, d))::INTEGER AS cluster FROM d GROUP BY vec_id)
SELECT cluster, i::INTEGER AS dim, round(avg(x), 6) + 0.0 AS mean FROM e JOIN own USING (vec_id) GROUP BY cluster, i""")
def kmeans_step(spark, folder):
    """One step of k-means from fixed centres: the means of the vectors closest to each."""
    e, centres = _label_centres(spark, folder)
    moved = cluster.nearest_centre(e, "v", centres).select("cluster", F.posexplode("v").alias("d", "x"))
    means = moved.groupBy("cluster", (F.col("d") + 1).alias("dim")).agg(F.avg("x").alias("mean"))
    return _round_all(means, "mean")


@query()
def kmeans_fit(spark, folder):
    columns = ["num_events", "mean_value"]
    scaled = cluster.standard_scale(_event_measures(spark, folder), columns)
    fitted = cluster.kmeans_fit(scaled, columns, key="user_id")
    return cluster.assign_cluster(scaled, fitted).select("user_id", "cluster")


# ---------------------------------------------------------------- classification


def _flagged_account_table(spark, folder) -> DataFrame:
    features = b.account_features(spark, folder)
    assembled = classify.assemble(features, classify.xy_split_cols(features))
    flagged = materialise(splits.strat_split(assembled.select("user_id", "features", "label"), "user_id", "label"), "accounts")
    return compact(flagged, flagged.count())


def _model_query(key: str, model: str) -> None:
    def run(spark, folder):
        accounts = _flagged_account_table(spark, folder)
        train, test = accounts.where("NOT is_test"), accounts.where("is_test")
        _, predicted = classify.fit_predict(classify.make_model(model), train, test)
        return predicted.select("user_id", F.col("label").cast("int").alias("label"), "prediction")

    query(None, key)(run)


for _key, _model in zip(("decision_tree", "random_forest", "adaboost", "linear_svc"), MODELS):
    _model_query(_key, _model)


# One split of one feature, by trying every cut: the classes of either side of the purest one.
_ONE_SPLIT_SQL = f"""WITH {_split_sql("quality")},
x AS (SELECT doc_id, quality, is_test, length(text) // 200 % 20 AS x FROM parts JOIN documents USING (doc_id) WHERE split = 0),
per AS (SELECT x, count(*) FILTER (quality = 0) AS a, count(*) FILTER (quality = 1) AS b FROM x WHERE NOT is_test GROUP BY x),
cuts AS (
  SELECT x, sum(a) OVER (ORDER BY x) AS la, sum(b) OVER (ORDER BY x) AS lb, sum(a) OVER () AS a, sum(b) OVER () AS b, lead(x) OVER (ORDER BY x) AS nx FROM per),
gini AS (
  SELECT *, (la + lb - (la * la + lb * lb) / (la + lb)::DOUBLE) + (a - la + b - lb - ((a - la) * (a - la) + (b - lb) * (b - lb)) / (a - la + b - lb)::DOUBLE) AS impure
  FROM cuts WHERE nx IS NOT NULL),
best AS (SELECT (x + nx) / 2.0 AS cut, (lb > la)::INTEGER AS below, (b - lb > a - la)::INTEGER AS above FROM gini ORDER BY round(impure, 9), x LIMIT 1)
SELECT doc_id AS user_id, quality AS label, CASE WHEN x <= cut THEN below ELSE above END AS prediction FROM x, best WHERE is_test"""


def _one_feature_table(spark, folder) -> DataFrame:
    """Labelled documents with one feature of twenty values, split as the SQL splits them."""
    labels, docs = b.table(spark, folder, "labels"), b.table(spark, folder, "documents")
    feature = (F.floor(F.length("text") / 200) % 20).cast("double").alias("x")
    rows = docs.select("doc_id", feature).join(labels, "doc_id").select(F.col("doc_id").alias("user_id"), "x", F.col("quality").alias("user_type"))
    assembled = classify.assemble(rows, ["x"]).select("user_id", "features", "label")
    return materialise(splits.strat_split(assembled, "user_id", "label"), "one-feature")


def _one_split(spark, folder, model) -> DataFrame:
    accounts = _one_feature_table(spark, folder)
    _, scored = classify.fit_predict(model, accounts.where("NOT is_test"), accounts.where("is_test"))
    return scored.select("user_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query(_ONE_SPLIT_SQL)
def fit_predict(spark, folder):
    """A tree of one split on one feature, against all cuts tried in SQL."""
    return _one_split(spark, folder, classify.make_model("decision_tree", ClassifyConfig(max_depth=1)))


@query(_ONE_SPLIT_SQL)
def boost_one_round(spark, folder):
    """One round of boosting on one feature, against all cuts tried in SQL."""
    return _one_split(spark, folder, classify.make_model("adaboosted_dt", ClassifyConfig(boosting_rounds=1)))


@query("""
WITH base AS (SELECT left(o_orderpriority, 1)::INTEGER AS cluster, o_totalprice AS x, (o_orderstatus = 'F')::INTEGER AS y FROM orders),
per AS (SELECT cluster, x, sum(1 - y)::DOUBLE AS a, sum(y)::DOUBLE AS b FROM base GROUP BY cluster, x),
cuts AS (
  SELECT cluster, x, sum(a) OVER w AS la, sum(b) OVER w AS lb, sum(a) OVER p AS a, sum(b) OVER p AS b, lead(x) OVER w AS nx
  FROM per WINDOW w AS (PARTITION BY cluster ORDER BY x), p AS (PARTITION BY cluster)),
gini AS (
  SELECT *, round(((la + lb - (la * la + lb * lb) / (la + lb)) +
    (a - la + b - lb - ((a - la) * (a - la) + (b - lb) * (b - lb)) / (a - la + b - lb))) / (a + b), 12) AS cost
  FROM cuts WHERE nx IS NOT NULL)
SELECT cluster, round(x + (nx - x) / 2, 6) AS cut, a::BIGINT AS n_0, b::BIGINT AS n_1 FROM gini
QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY cost, x) = 1""")
def exact_cut(spark, folder):
    """The best of all cuts of a feature with a value per order, for a tree per priority, against all cuts tried in SQL."""
    rows = b.table(spark, folder, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("model"), F.lit(1).cast("bigint").alias("node"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.array("o_totalprice").alias("x"))
    found = exact.best_cuts(rows, 2)
    return found.select(
        F.col("model").cast("int").alias("cluster"), F.round("cut", 6).alias("cut"), F.col("counts")[0].alias("n_0"), F.col("counts")[1].alias("n_1"))


_BY_LANGUAGE = "SELECT lang AS g, quality, toxic FROM labels JOIN documents USING (doc_id)"


def _labels_by_language(spark, folder) -> DataFrame:
    return b.table(spark, folder, "labels").join(b.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")


@query(f"""WITH base AS ({_BY_LANGUAGE}), {_PRF_SQL}
SELECT g AS lang, class, {_r('precision')} AS precision, {_r('recall')} AS recall, {_r('f1')} AS f1, support FROM prf""")
def prf_support(spark, folder):
    prf = metrics.prf_support(_labels_by_language(spark, folder), ["lang"], "toxic", "quality")
    return _round_all(prf, "precision", "recall", "f1")


@query(f"""WITH base AS ({_BY_LANGUAGE}), {_PRF_SQL}
SELECT g AS lang, {_r('sum(precision * support) / sum(support)')} AS precision, {_r('sum(recall * support) / sum(support)')} AS recall,
       {_r('sum(f1 * support) / sum(support)')} AS f1, sum(support)::BIGINT AS support FROM prf GROUP BY g""")
def report_avg(spark, folder):
    prf = metrics.prf_support(_labels_by_language(spark, folder), ["lang"], "toxic", "quality")
    return _round_all(metrics.report_avg(prf, ["lang"]), "precision", "recall", "f1")


@query("SELECT toxic AS label, count(*) FILTER (quality = 0) AS pred_0, count(*) FILTER (quality = 1) AS pred_1 FROM labels GROUP BY toxic")
def confusion_matrix(spark, folder):
    matrix = metrics.confusion_matrix(b.table(spark, folder, "labels"), [0, 1], (), "toxic", "quality")
    return matrix.withColumnRenamed("toxic", "label")


@query(f"WITH base AS ({_BY_LANGUAGE}) SELECT g AS lang, {_r('avg((quality = toxic)::INT)')} AS accuracy FROM base GROUP BY g")
def accuracy_score(spark, folder):
    return _round_all(metrics.accuracy_score(_labels_by_language(spark, folder), ["lang"], "toxic", "quality"), "accuracy")


@query(f"""WITH {_SPLIT_SQL}, acc AS (SELECT split, avg((quality = toxic)::INT) AS a FROM parts WHERE is_test GROUP BY split)
SELECT 0 AS cluster, 'quality' AS model, {_r('avg(a)')} AS averaged_accuracy_score, {_r('2 * stddev_pop(a)')} AS averaged_accuracy_sd FROM acc""")
def cv_accuracy(spark, folder):
    scored = classify.cv_accuracy(_label_outcomes(spark, folder))
    return _round_all(scored, "averaged_accuracy_score", "averaged_accuracy_sd")


@query()
def per_cluster_models(spark, folder):
    """All four models, ten splits, fifty rounds of boosting."""
    return classify.per_cluster_models(b.account_features(spark, folder))


def _assembled(spark, folder) -> DataFrame:
    features = b.account_features(spark, folder)
    return classify.assemble(features, classify.xy_split_cols(features)).select("user_id", "features", "label")


def _grid_query(key: str, make) -> None:
    def run(spark, folder):
        data = materialise(_assembled(spark, folder), "grid-table")
        estimator, grid = make(data)
        return tuning.grid_search(data, estimator, grid).table(data)

    query(None, key)(run)


@query()
def grid_search(spark, folder):
    """Search on the training part, then the best model's report on both parts."""
    data = materialise(_assembled(spark, folder), "grid-table")
    return tuning.grid_report(data, *tuning.grid_svc())[1]


_grid_query("grid_dt", lambda data: tuning.grid_dt())
_grid_query("grid_rf", lambda data: tuning.grid_rf())
_grid_query("grid_ada", lambda data: tuning.grid_ada())
_grid_query("grid_svc", lambda data: tuning.grid_svc())


# ---------------------------------------------------------------- stages

_STAGE_DOCS_SQL = f"""WITH {b.SQL_STATIC},
docs AS (SELECT doc_id AS user_id, replace(text, chr(10), ' ') AS tweet, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS cohort
         FROM documents JOIN labels USING (doc_id) WHERE NOT (quality = 0 AND toxic = 0))
SELECT user_id, static.* EXCLUDE (user_id, tweet_avg_length), {_r('tweet_avg_length')} AS tweet_avg_length, cohort, md5(tweet) AS tweet
FROM docs JOIN static USING (user_id)"""


@query(_STAGE_DOCS_SQL)
def stage_preprocess(spark, folder):
    static, documents = stages.preprocess(b.static_raw(spark, folder), *b.cohorts_raw(spark, folder))
    whole = documents.select("user_id", F.col("user_type").alias("cohort"), F.md5("tweet").alias("tweet"))
    return _round_all(static.join(whole, "user_id"), "tweet_avg_length")


def _document_scores(spark, folder) -> DataFrame:
    docs = b.documents(spark, folder).select(F.col("doc_id").alias("user_id"), F.col("text").alias("tweet"))
    return stages.build_dynamic_features(docs)


@query()
def stage_features(spark, folder):
    return _document_scores(spark, folder)


@query()
def stage_cluster(spark, folder):
    """Labelled documents by their own static features and scores."""
    static = stages.preprocess_static(b.static_raw(spark, folder))
    return stages.cluster_accounts(static, _document_scores(spark, folder))[0]


@query()
def stage_classify(spark, folder):
    return stages.classify_clusters(b.account_features(spark, folder))


@query()
def run_pipeline(spark, folder):
    """The whole run under its default settings."""
    return stages.run_pipeline(RunConfig(), raw=(b.static_raw(spark, folder), *b.cohorts_raw(spark, folder))).report


@query()
def run_stages(spark, folder):
    """A run of some stages: up to the clusters' composition."""
    cfg = RunConfig(stages=("preprocess", "features", "cluster"))
    return stages.run_pipeline(cfg, raw=(b.static_raw(spark, folder), *b.cohorts_raw(spark, folder))).composition
