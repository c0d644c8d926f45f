"""Mixing sources to target weights through a splitting tree of block quotas.

Each source's documents are permuted by a keyed hash and laid end to end, as often as its target asks for; this stream
is cut into blocks. The blocks of all sources go down a binary tree of output shards: a node sends an exact number of
uniformly drawn blocks to its left half, which makes the counts by source a multivariate-hypergeometric draw, and the
rest to its right half. A shard's blocks are disjoint from all others', and its documents are shuffled locally.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accountscope.llm.common import words
from accountscope.session import materialise


@dataclass(frozen=True)
class MixConfig:
    """weights repeat over the sources in order; share is the mix's size against all input; repeats is how often a
    source may be taken; the number of blocks is about shards * blocks_per_shard at every size of input."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    repeats: int = 2
    shards: int = 64
    blocks_per_shard: int = 64
    seed: str = "mix"
    rows_per_run: int = 10_000


def sizes(docs: DataFrame, cfg: MixConfig, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``row, id, source, size, key``: words of every text (NULL: none), and the key that permutes documents.

    row tells rows apart that share an id; it holds once this table is written down.
    """
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", F.lit(cfg.seed), F.col(id_col).cast("string"))).alias("key"),
    )


def targets(sized: DataFrame, cfg: MixConfig) -> DataFrame:
    """``source, source_size, n, target``, a row per source in code-point order, NULL last.

    ``share`` of all words by weight; a source stops at ``repeats`` times its size, and the excess is shared again.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.get(F.lit([float(w) for w in cfg.weights]), F.pmod(place - 1, F.lit(len(cfg.weights))))
    rows = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cfg.repeats))
    # Sources by the level at which they stop; those before the first that doesn't are full.
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    total = F.sum("source_size").over(everything) * cfg.share
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level rises as long as sources are full, and falls behind the first that isn't: its highest is the right one.
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", "n", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def taken(sized: DataFrame, goals: DataFrame, cfg: MixConfig) -> DataFrame:
    """``row, id, source, size, key, source_size, target, start, copies``: how often the mix takes each document.

    The stream of a source is its permuted documents, again and again; a copy is taken if its middle lies before the
    target. What is then missing or too much is mended by the one document whose size comes nearest to it. Running
    sums are taken per run of some thousand documents, and over the runs' sums, so that a source may be of any size.
    """
    rows = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    run = F.floor(head * F.ceil(F.col("n") / cfg.rows_per_run) / float(1 << 32))
    rows = rows.withColumn("run", run)
    runs = rows.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    earlier = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "run").orderBy("key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(runs, placed["source"].eqNullSafe(runs["s"]) & (placed["run"] == runs["r"]))
    start = F.col("base") + F.col("within")
    copies = sum((F.when(start + k * F.col("source_size") + F.col("size") / 2.0 <= F.col("target"), 1).otherwise(0) for k in range(cfg.repeats)), F.lit(0))
    first = materialise(placed.select("row", "id", "source", "size", "key", "source_size", "target", start.alias("start"), copies.alias("copies")), "mix-first")

    off = first.groupBy(F.col("source").alias("s")).agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("off"))
    joined = first.join(off, first["source"].eqNullSafe(off["s"])).drop("s")
    room = F.when(F.col("off") > 0, F.col("copies") < cfg.repeats).otherwise(F.col("copies") > 0)
    error = F.abs(F.abs(F.col("off")) - F.col("size"))
    mend = joined.where(room & (error < F.abs(F.col("off")))).groupBy(F.col("source").alias("s")).agg(
        F.min(F.struct(error.alias("error"), F.col("key").alias("k"), F.col("row").alias("r"))).alias("m"))
    both = joined.join(mend, joined["source"].eqNullSafe(mend["s"]), "left")
    sign = F.when(F.col("off") > 0, 1).otherwise(-1)
    return both.select("row", "id", "source", "size", "key", "source_size", "target", "start",
                       (F.col("copies") + F.when(F.col("m.r") == F.col("row"), sign).otherwise(0)).alias("copies"))


def block_shards(goals: DataFrame, cfg: MixConfig) -> DataFrame:
    """``source, block, shard, block_words``: every block sent down the tree of shards.

    There are about shards * blocks_per_shard blocks, and one more per source, whatever the size of the input.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    sized = goals.withColumn("block_words", F.greatest(F.lit(1.0), F.sum("target").over(everything) / (cfg.shards * cfg.blocks_per_shard)))
    n = F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("block_words")).cast("int"))
    blocks = sized.select("source", "block_words", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    rows = materialise(blocks, "mix-blocks")
    total = rows.count()
    rows = rows.withColumns({"lo": F.lit(0), "hi": F.lit(cfg.shards)})

    def ahead(shard: Column) -> Column:
        """Blocks of all shards before ``shard``: the exact sizes of the tree's nodes."""
        return F.floor(shard * F.lit(total) / cfg.shards)

    for level in range(max(1, cfg.shards - 1).bit_length() if cfg.shards > 1 else 0):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        drawn = F.row_number().over(Window.partitionBy("lo", "hi").orderBy(
            F.xxhash64(F.lit(cfg.seed), F.lit(level), "source", "block"), F.col("source"), F.col("block")))
        left = drawn <= ahead(mid) - ahead(F.col("lo"))
        rows = rows.withColumns({"mid": mid, "left": left})
        rows = rows.select("source", "block", "block_words",
                           F.when(F.col("hi") - F.col("lo") == 1, F.col("lo")).when(F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo"),
                           F.when(F.col("hi") - F.col("lo") == 1, F.col("hi")).when(F.col("left"), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
    return rows.select("source", "block", F.col("lo").alias("shard"), "block_words")


@dataclass(frozen=True)
class Mix:
    """documents: one row per document with its copies; draws: ``row, copy, shard, at``, one per copy."""

    documents: DataFrame
    draws: DataFrame


def mix(docs: DataFrame, cfg: MixConfig | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """NULL text has no words; NULL ids and repeated rows are documents of their own; NULL is a source, the last."""
    cfg = cfg or MixConfig()
    sized = materialise(sizes(docs, cfg, id_col, text_col, source_col), "mix-sizes")
    goals = materialise(targets(sized, cfg), "mix-targets")
    documents = materialise(taken(sized, goals, cfg), "mix-taken")
    shards = block_shards(goals, cfg)
    each = documents.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    last = shards.groupBy("source").agg(F.max("block").alias("last"), F.max("block_words").alias("w")).withColumnRenamed("source", "s")
    each = each.join(last, each["source"].eqNullSafe(last["s"])).drop("s")
    block = F.least(F.floor((F.col("start") + F.col("copy") * F.col("source_size")) / F.col("w")).cast("int"), F.col("last"))
    each = each.withColumn("b", block)
    found = each.join(shards, each["source"].eqNullSafe(shards["source"]) & (each["b"] == shards["block"]))
    draws = found.select("row", "copy", "shard", F.xxhash64(F.lit(cfg.seed), "key", "copy", "row").alias("at"))
    return Mix(documents, draws)


def shuffled(docs: DataFrame, cfg: MixConfig | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows, all columns of ``docs``: copies repeated, a partition per shard, each in its own random order.

    Texts move twice: to their draws, then to their shards.
    """
    cfg = cfg or MixConfig()
    plan = mix(docs, cfg, id_col, text_col, source_col)
    per = plan.draws.groupBy("row").agg(F.collect_list(F.struct("shard", "at")).alias("draws"))

    def named(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("NULL"))

    # Rows that share an id are matched among those of their size; so an id with very many rows is many groups.
    nth = F.row_number().over(Window.partitionBy("own", "own_size").orderBy("row"))
    ranked = plan.documents.select(named(F.col("id")).alias("own"), F.col("size").alias("own_size"), "row").withColumn("own_nth", nth)
    numbered = ranked.join(per, "row").select("own", "own_size", "own_nth", "draws")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named(F.col(id_col)).alias("key"))
    text = F.col(f"row.{text_col}")
    whole = whole.withColumn("words", F.size(words(text)).cast("bigint"))
    whole = whole.withColumn("nth", F.row_number().over(Window.partitionBy("key", "words").orderBy(text)))
    # The rank is compared by a difference, so that id and size alone decide where rows go and texts stay where they are.
    out = whole.join(numbered, (whole["key"] == numbered["own"]) & (whole["words"] == numbered["own_size"]) & (F.col("nth") - F.col("own_nth") == 0))
    placed = out.select("row", F.explode("draws").alias("d"))
    dealt = placed.repartition(cfg.shards, F.col("d.shard")).sortWithinPartitions("d.shard", "d.at")
    return dealt.select("row.*")


def report(docs: DataFrame, cfg: MixConfig | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, size, source_size, target, taken``, the mix read back from its draws."""
    plan = mix(docs, cfg, id_col, text_col, source_col)
    drawn = plan.draws.groupBy("row").agg(F.count("*").alias("n"))
    joined = plan.documents.join(drawn, "row", "left")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.coalesce("n", F.lit(0))).alias("taken"))
