"""The training-data pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accountscope.llm import mixing, packing, pii, quality, simhash
from accountscope.llm.queries import SURROGATE_KEY, prepared
from accountscope.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base limit and no learned rule rejects."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.learn(quality.labelled_sample(docs, labels, quality.CoverConfig()))
    return quality.keep_good(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles within two bits, linked."""
    prepared(spark)
    return simhash.keep_one(docs, radius=2, size=3)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    prepared(spark)
    return pii.masked(docs, SURROGATE_KEY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix of sources, repeated where it asks for that, shuffled within shards."""
    prepared(spark)
    return mixing.shuffled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("surrogates", surrogates),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can't express learned rules, fingerprints or token ids; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: every stage's rows are written down before the next one reads them."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
