"""The four stages, each from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accountscope.config import POSITION, ClassifyConfig, ClusterConfig, FeatureConfig, PreprocessConfig, RunConfig
from accountscope.operators import classify, cluster, collate, prep, scores, splits, text, topics
from accountscope.session import materialise
from accountscope.sources.arff import read_arff
from accountscope.sources.csv import read_csv

# Columns of a file of posts.
POSTS = "UserID STRING, TweetID STRING, Tweet STRING, CreatedAt STRING"


def read_raw(
    spark: SparkSession, static: str, polluters: str, legitimate: str, posts: str = POSTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three inputs of stage 1 from an ARFF file and two CSV files or folders; ``posts`` are the columns of the latter.

    Of several static rows of an account the first in the file is kept.
    """
    return read_arff(spark, static, position=POSITION), read_csv(spark, polluters, posts), read_csv(spark, legitimate, posts)


def preprocess_static(static_raw: DataFrame, order: str | None = None) -> DataFrame:
    """Renamed static features with a BIGINT id and an INT label, one row per account.

    ``order`` names the column that decides which of several rows is first;
    without it ``POSITION`` does, which :func:`read_raw` adds, and in a table
    without that all columns do, in their own order.
    """
    named = prep.cast_label(prep.coerce_id(prep.rename_static(static_raw)))
    order = order or (POSITION if POSITION in named.columns else None)
    ranks = [order] if order else [c for c in named.columns if c != "user_id"]
    one = prep.dedup_key(named, "user_id", *ranks)
    return one.drop(order) if order else one


def preprocess_posts(polluters: DataFrame, legitimate: DataFrame, static: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled posts of accounts that occur in one cohort and in ``static``, and the ids of these accounts.

    Works on posts: accounts are removed before their documents are built. The
    typed posts are written once, so that finding out which accounts stay reads
    their ids only; then one join lets the posts through.
    """
    cohorts = [
        materialise(prep.type_posts(prep.coerce_id(prep.rename_tweets(df))), "posts") for df in (polluters, legitimate)
    ]
    ids = [df.select("user_id").distinct() for df in cohorts]
    single = ids[0].unionByName(ids[1]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    stay = materialise(single.join(static, "user_id", "left_semi").select("user_id"), "accounts")
    labelled = [prep.add_const_label(df, label) for df, label in zip(cohorts, (prep.POLLUTER, prep.LEGITIMATE))]
    return prep.union_cohorts(*labelled).join(stay, "user_id", "left_semi"), stay


def label_conflicts(static: DataFrame, documents: DataFrame) -> int:
    """Accounts whose static label differs from the cohort their posts came from."""
    both = static.select("user_id", F.col("user_type").alias("a")).join(documents.where("part = 0"), "user_id")
    return both.where("a <> user_type").count()


def preprocess(
    static_raw: DataFrame, polluters: DataFrame, legitimate: DataFrame, cfg: PreprocessConfig = PreprocessConfig()
) -> tuple[DataFrame, DataFrame]:
    """Stage 1: ``(static features, documents)`` over the accounts found on both sides.

    Documents are ``<user_id, part, tweet, user_type>``; accounts of ordinary
    size have one part.
    """
    static = materialise(preprocess_static(static_raw, cfg.first_by), "static")
    posts, stay = preprocess_posts(polluters, legitimate, static)
    static = static.join(stay, "user_id", "left_semi")
    if cfg.random_sub_sample:
        static = splits.sample_n(static, "user_id", cfg.sample_size, cfg.seed)
        posts = splits.follow_sample(posts, static, "user_id")
    if cfg.period_features:
        static = static.join(prep.avg_by_period(posts, "user_id", "creation_date"), "user_id")
    parts = collate.collate_parts(
        posts, "user_id", "tweet", ["creation_date", "tweet_id"], cfg.null_text, cfg.max_part_rows, carry=["user_type"]
    )
    return static, parts


def build_dynamic_features(
    documents: DataFrame,
    cfg: FeatureConfig = FeatureConfig(),
    key: str = "user_id",
    text_column: str = "tweet",
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Stage 2: ``<key, dt_entropy, goss_0.., loss_0..>`` from documents.

    Plain tokens are made twice rather than stored: once for the vocabulary and once
    for the vectors, which are the only table the model fit reads. Lemmas need a
    shuffle, so tokens with lemmas are stored.
    """
    hot = text.hot_keys(documents, key)
    tokens = text.tokenize(documents, key, text_column)
    if lemmas is not None:
        tokens = materialise(text.lemmatize_dict(tokens, lemmas, key), "lemmatised")
    terms = text.ngrams(tokens, *cfg.ngram_range, key=key, hot=hot)
    kept = text.df_prune(text.document_freq(terms, key, hot), text.document_count(documents, key), cfg.min_df, cfg.max_df)
    vectors = materialise(text.term_vectors(terms, text.vocabulary_list(kept), key, hot), "term-vectors")
    model = topics.lda_fit(vectors, cfg)
    dist = materialise(topics.dt_dist(model, vectors, key), "topic-shares")
    return scores.dynamic_features(dist, cfg.topics, key)


def choose_cluster_features(df: DataFrame, cfg: ClusterConfig = ClusterConfig(), key: str = "user_id") -> DataFrame:
    return prep.select_features(df, cfg.features, keep=[key])


def cluster_accounts(
    static: DataFrame, dynamic: DataFrame, cfg: ClusterConfig = ClusterConfig(), key: str = "user_id"
) -> tuple[DataFrame, DataFrame]:
    """Stage 3: master table with ``cluster``, and the composition report."""
    master = materialise(prep.consolidate(static, dynamic, key), "master")
    chosen = choose_cluster_features(master, cfg, key)
    scaled = cluster.standard_scale(chosen, cfg.features)
    fitted = cluster.kmeans_fit(scaled, cfg.features, cfg, key)
    numbered = cluster.assign_cluster(scaled, fitted).select(key, "cluster")
    clustered = materialise(master.join(numbered, key), "clustered")
    return clustered, cluster.cluster_composition(clustered)


def classify_clusters(clustered: DataFrame, cfg: ClassifyConfig = ClassifyConfig(), key: str = "user_id") -> DataFrame:
    """Stage 4: long metric report ``<cluster, model, metric, class, value>``."""
    return classify.per_cluster_models(clustered, cfg, key)


@dataclass
class RunResult:
    static: DataFrame | None = None
    documents: DataFrame | None = None
    dynamic: DataFrame | None = None
    clustered: DataFrame | None = None
    composition: DataFrame | None = None
    #: Accounts whose static label isn't that of the cohort their posts came from.
    conflicts: int | None = None
    report: DataFrame | None = None


def run_pipeline(
    cfg: RunConfig = RunConfig(),
    *,
    raw: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    start: RunResult | None = None,
) -> RunResult:
    """Run the switched-on stages in order; tables are handed over as DataFrames.

    ``raw`` holds static table, polluter posts and legitimate posts. A run that
    skips early stages takes their tables from ``start``.
    """
    out = start or RunResult()
    if "preprocess" in cfg.stages:
        static, documents = preprocess(*raw, cfg.preprocess)
        out.static, out.documents = materialise(static, "static"), materialise(documents, "documents")
        out.conflicts = label_conflicts(out.static, out.documents)
    if "features" in cfg.stages:
        out.dynamic = build_dynamic_features(out.documents, cfg.features)
    if "cluster" in cfg.stages:
        out.clustered, out.composition = cluster_accounts(out.static, out.dynamic, cfg.cluster)
    if "classify" in cfg.stages:
        out.report = classify_clusters(out.clustered, cfg.classify)
    return out
