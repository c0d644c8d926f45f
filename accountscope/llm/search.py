"""Ranked lexical search for many items at once, sharing what their term sets have in common.

Texts are read once: of every document its length and its counts of the items' terms are written down. Terms that
occur in exactly the same items are one node; pairs of nodes that two or more items hold are merged step by step, the
most widely shared pair first. Nodes form a graph in which every item is the sum of a few of them. A task holds one
accumulator per node and document of its batch: leaves are summed from the counts, every shared node is computed once
and used by all items above it. A task keeps the best documents of each item; these few rows are ranked at the end.

Items are a stated query set. They come in blocks of bounded size, so that the vocabulary a task holds is bounded too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountscope.session import materialise

#: Terms in UTF-8: letters and digits of ASCII, and all bytes of other characters.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Sums below this are exact in doubles.
EXACT = 1 << 53


@dataclass(frozen=True)
class SearchConfig:
    """top: documents per item; block_bytes: text of one block of items; mined: shared nodes searched for pairs; cells: accumulators per task."""

    top: int = 10
    block_bytes: int = 4_000_000
    mined: int = 512
    cells: int = 1 << 22


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return TERM.findall(text.lower()) if text else []


@dataclass(frozen=True)
class SharingGraph:
    """leaf_of: node of every term; pairs: the two parts of each further node, in order; cover: nodes that sum up to each item."""

    leaf_of: np.ndarray
    leaves: int
    pairs: list[tuple[int, int]]
    cover: list[np.ndarray]

    @property
    def nodes(self) -> int:
        return self.leaves + len(self.pairs)


def share(items: list[set[int]], n_terms: int, mined: int = 512) -> SharingGraph:
    """Mine the term sets that items have in common.

    A leaf is a maximal set of terms held by the same items. Then the pair of nodes that most items hold together becomes
    a node in their place, as long as two items hold it; pairs are sought among the ``mined`` most widely held leaves.
    """
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for i, own in enumerate(items):
        for t in own:
            holders[t].append(i)
    leaf: dict[tuple[int, ...], int] = {}
    leaf_of = np.array([leaf.setdefault(tuple(h), len(leaf)) for h in holders], np.int64)
    cover: list[set[int]] = [set() for _ in items]
    for held_by, node in leaf.items():
        for i in held_by:
            cover[i].add(node)
    wide = sorted((h for h in leaf if len(h) > 1), key=lambda h: (-len(h), leaf[h]))[:mined]
    held = np.zeros((len(items), 2 * max(1, len(wide))), np.float32)
    for c, h in enumerate(wide):
        held[list(h), c] = 1
    name, pairs = [leaf[h] for h in wide], []
    together = held.T @ held
    np.fill_diagonal(together, 0)
    while len(name) < held.shape[1] and len(wide) > 1:
        a, b = sorted(divmod(int(together.argmax()), together.shape[1]))
        if together[a, b] < 2:
            break
        both, new = np.flatnonzero(held[:, a] * held[:, b]), len(name)
        pairs.append((name[a], name[b]))
        name.append(len(leaf) + len(pairs) - 1)
        held[both, a] = held[both, b] = 0
        held[both, new] = 1
        for i in both:
            cover[i] = cover[i] - {name[a], name[b]} | {name[new]}
        for c in (a, b, new):
            together[c] = together[:, c] = held[:, c] @ held
            together[c, c] = 0
    return SharingGraph(leaf_of, len(leaf), pairs, [np.array(sorted(c), np.int64) for c in cover])


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id, n, terms, counts`` of every document; docs: ``id, text`` (binary)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            lengths, sizes, held, counts = [], [], [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                own = Counter(map(known, found))
                own.pop(None, None)
                lengths.append(len(found))
                sizes.append(len(own))
                held.extend(own.keys())
                counts.extend(own.values())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int32)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (held, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return docs.mapInArrow(count, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, terms array<int>, counts array<int>")


def accumulators(graph: SharingGraph, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, n_docs: int, exact: bool) -> np.ndarray:
    """``[node, document]``: leaves from the gains of single terms, then every shared node once."""
    held = np.zeros((graph.nodes, n_docs), np.int64)
    at = graph.leaf_of[term] * n_docs + doc
    if exact:
        held[: graph.leaves] = np.bincount(at, weights=gain, minlength=graph.leaves * n_docs).astype(np.int64).reshape(-1, n_docs)
    else:
        np.add.at(held.reshape(-1), at, gain)
    for k, (a, b) in enumerate(graph.pairs):
        np.add(held[a], held[b], out=held[graph.leaves + k])
    return held


def _ranked(rows: list[tuple], top: int) -> list[tuple]:
    """The best (score, id): highest score first, then smallest id, no id last."""
    present = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[0], r[1]))[:top]
    return sorted(present + [r for r in rows if r[1] is None], key=lambda r: (-r[0], r[1] is None))[:top]


def best(counted: DataFrame, graph: SharingGraph, weights: np.ndarray, n_docs: int, n_terms: int, cfg: SearchConfig) -> DataFrame:
    """``item, id, score``: the best documents of each item within every task."""
    exact = int(weights.sum()) * 1_000_000 < EXACT
    step = max(1, cfg.cells // max(1, graph.nodes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in graph.cover]
        id_type = None
        for whole in batches:
            id_type = whole.schema.field("id").type
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                batch = batch.take(pc.sort_indices(batch.column("id"), null_placement="at_end"))
                d = batch.num_rows
                m = np.array([10 + 90 * n * n_docs // n_terms if n else 10 for n in batch.column("n").to_pylist()], np.int64)
                sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(d), sizes)
                term = batch.column("terms").flatten().to_numpy(zero_copy_only=False)
                tf = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                held = accumulators(graph, doc, term, gain, d, exact)
                ids = batch.column("id")
                for i, cover in enumerate(graph.cover):
                    scores = held[cover].sum(axis=0)
                    least = np.partition(scores, d - cfg.top)[d - cfg.top] if d > cfg.top else 1
                    if len(kept[i]) == cfg.top:
                        least = max(least, kept[i][-1][0])
                    near = np.flatnonzero(scores >= max(least, 1))
                    # Documents come in the order of ids: of equal scores the first ones.
                    near = near[np.argsort(-scores[near], kind="stable")][: cfg.top]
                    if len(near):
                        kept[i] = _ranked(kept[i] + [(int(scores[j]), ids[int(j)].as_py()) for j in near], cfg.top)
        if id_type is not None:
            rows = [(i, doc, s) for i, found in enumerate(kept) for s, doc in found]
            columns = [[r[c] for r in rows] for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], id_type), pa.array(columns[2], pa.int64())],
                                             names=["item", "id", "score"])

    return counted.mapInArrow(score, f"item int, id {counted.schema['id'].dataType.simpleString()}, score bigint")


def _rank(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank(docs: DataFrame, items: DataFrame, cfg: SearchConfig | None = None, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item, rank, id, score``: the ``top`` documents of every item with a score above 0, equal scores by ascending id.

    Every row of ``items`` is an item of its own, every row of ``docs`` a document; rows without an id come behind equal
    scores with one. NULL texts and texts without terms are in no result and count for nothing. No documents, no items or
    no common terms give an empty result. Other columns are ignored.
    """
    cfg = cfg or SearchConfig()
    spark = docs.sparkSession
    asked = materialise(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("binary").alias("text"),
                                     F.monotonically_increasing_id().alias("row")), "search-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // cfg.block_bytes)
    of_block = F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    item_type, id_type = (x.schema[c].dataType.simpleString() for x, c in ((asked, "item_id"), (own, "id")))
    out = None
    for b in range(blocks):
        block = asked.where((of_block == b) & F.col("text").isNotNull()).collect()  # bounded by block_bytes
        held = [set(terms(bytes(r["text"]))) for r in block]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*held)))}
        if not vocabulary:
            continue
        graph = share([{vocabulary[t] for t in own_terms} for own_terms in held], len(vocabulary), cfg.mined)
        counted = materialise(postings(own, vocabulary), "search-postings")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_terms:
            break
        df = {r[0]: r[1] for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # at most the vocabulary
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        found = best(counted, graph, weights, n_docs, n_terms, cfg)
        # The best of every task meet in two steps, so that no item's rows of all tasks come together in one.
        first = _rank(found.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))), ["item", "part"], cfg.top).drop("part", "rank")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {item_type}")
        ranked = _rank(first, ["item"], cfg.top).join(F.broadcast(names), "item")
        part = ranked.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` {id_type}, score bigint")
    return out
