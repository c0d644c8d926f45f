"""SimHash near-duplicates: exact comparison of fingerprint tiles with exclusive-or and bit counts.

Equal fingerprints are one row. Fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit
blocks, so tiles are cut from fingerprints that share a block. A block's fingerprints up to the tile size are one
tile; beyond it, they are split by bit count and hash into tiles, and only pairs of tiles whose bit counts are within
the radius are compared. Every pair within the radius is found; a pair of tiles reports its links as a spanning
forest, so that a dense group never emits all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountscope.llm.graph import components
from accountscope.session import materialise

SEED = 42
#: Shingles hashed at a time, which bounds the memory of a very long text.
CHUNK = 1 << 16


def simhash(text: str | None, size: int = 3) -> int:
    """Unsigned 64-bit fingerprint of the word shingles of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = [digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])]
        hashes = np.array(part, "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(t, n) for t, n in zip(texts, sizes)], np.uint64).view(np.int64))


def bands(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 1 blocks that cover 64 bits."""
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the pairs a, b of 0..n-1 connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def _tile_links(fps: np.ndarray, side: np.ndarray, band: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one group of at most two tiles; side is 0 or 1, all 0 for a tile with itself."""
    counts = np.bitwise_count(fps)
    order = np.argsort(counts, kind="stable")
    fps, side, counts = fps[order], side[order], counts[order].astype(np.int16)
    parts_a, parts_b = [], []
    cross = bool(side.any())
    block = 512
    for i in range(0, len(fps), block):
        for j in range(i, len(fps), block):
            if counts[j] - counts[min(i + block, len(fps)) - 1] > radius:
                break  # tiles are sorted by bit count
            x, y = fps[i:i + block, None], fps[None, j:j + block]
            close = np.bitwise_count(x ^ y) <= radius
            if i == j:
                close &= np.triu(np.ones(close.shape, bool), 1)
            if cross:
                close &= side[i:i + block, None] != side[None, j:j + block]
            p, q = np.nonzero(close)
            parts_a.append(p + i)
            parts_b.append(q + j)
    a, b = np.concatenate(parts_a), np.concatenate(parts_b)
    # A pair that shares an earlier block is reported there.
    once = np.ones(len(a), bool)
    for shift, mask in bands(radius)[:band]:
        once &= (((fps[a] ^ fps[b]) >> np.uint64(shift)) & np.uint64(mask)) != 0
    nodes, roots = forest(a[once], b[once], len(fps))
    return fps[nodes], fps[roots]


def links(fingerprints: DataFrame, radius: int = 2, tile: int = 2048) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column fp) that connect all pairs within ``radius`` bits."""
    spans = bands(radius)
    fp = F.col("fp")
    keys = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(fp, s).bitwiseAND(F.lit(m)).alias("block")) for k, (s, m) in enumerate(spans)]
    banded = fingerprints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.band", "k.block", F.bit_count(fp).alias("ones"))
    crowd = banded.groupBy("band", "block").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(banded.join(crowd, ["band", "block"]), "tiles")

    small = shared.where(F.col("n") <= tile).select(
        "fp", "band", F.xxhash64("band", "block").alias("group"), "block", F.lit("").alias("pair"), F.lit(0).alias("side"))
    # Crowded blocks: tiles are (bit count, hash); a row goes to every pair of tiles that its own is in.
    big = shared.where(F.col("n") > tile)
    sizes = big.groupBy("band", "block", "ones").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    other = sizes.select("band", "block", F.col("ones").alias("other_ones"), F.col("parts").alias("other_parts"))
    near = sizes.join(other, ["band", "block"]).where(F.abs(F.col("ones") - F.col("other_ones")) <= radius)
    each = big.select("fp", "band", "block", "ones").join(near, ["band", "block", "ones"])
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    each = each.select("fp", "band", "block", "ones", own.alias("own"), "other_ones",
                       F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)).alias("part"))
    here, there = F.struct("ones", F.col("own").alias("p")), F.struct(F.col("other_ones").alias("ones"), F.col("part").alias("p"))
    low = F.when(here <= there, here).otherwise(there)
    high = F.when(here <= there, there).otherwise(here)
    pair = F.concat_ws("-", low["ones"], low["p"], high["ones"], high["p"])
    crossed = each.select("fp", "band", F.xxhash64("band", "block", pair).alias("group"), "block", pair.alias("pair"),
                          (here > there).cast("int").alias("side"))
    dealt = small.unionByName(crossed).repartition("group").sortWithinPartitions("group", "band", "block", "pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None

        def found(rows: pd.DataFrame) -> pa.RecordBatch:
            fps = rows["fp"].to_numpy().view(np.uint64)
            key = rows[["group", "band", "block", "pair"]]
            starts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
            ends = np.append(starts[1:], len(rows))
            band, side = rows["band"].to_numpy(), rows["side"].to_numpy()
            out = [_tile_links(fps[s:e], side[s:e], int(band[s]), radius) for s, e in zip(starts, ends) if e - s > 1]
            a = np.concatenate([x[0] for x in out]) if out else np.empty(0, np.uint64)
            b = np.concatenate([x[1] for x in out]) if out else np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = batch.to_pandas()
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[["group", "band", "block", "pair"]] == rows[["group", "band", "block", "pair"]].iloc[-1]).all(axis=1).to_numpy()
            whole = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            if whole:
                yield found(rows.iloc[:whole])
            held = rows.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held)

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _components(docs: DataFrame, id_col: str, text_col: str, radius: int, size: int) -> DataFrame:
    """``id, fp, hash, component_id`` of every row; hash tells texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fingerprint = simhash_udf(text, F.lit(size))
    own = materialise(docs.select(F.col(id_col).alias("id"), fingerprint.alias("fp"), F.xxhash64(F.col(text_col)).alias("hash")), "simhash")
    classes = materialise(own.groupBy("fp").agg(F.min("id").alias("head")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius))
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "head", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("head").alias("component_id"))
    named = materialise(labelled.join(smallest, "root").select("fp", "root", "component_id"), "simhash-components")
    return own.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, size: int = 3) -> DataFrame:
    """``id, fp, component_id``: the component's smallest id over links of at most ``radius`` differing bits.

    Fingerprints are made of shingles of ``size`` words. NULL text counts as empty: fingerprint zero, linked like any
    other. Repeated rows stay, in one component. NULL ids are never the smallest; a component of NULL ids only has a NULL
    component id. Other columns are ignored.
    """
    return _components(docs, id_col, text_col, radius, size).select(F.col("id").alias(id_col), "fp", "component_id")


def hex64(fp: Column) -> Column:
    """16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, size: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, reduced to one row of each component.

    That of the smallest id stays, NULL ids behind all others; of its texts in the component the one with the smallest
    hash, and of equal rows any one. An id whose texts lie in several components may stay in each of them.
    """
    found = _components(docs, id_col, text_col, radius, size)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("one"))
    heads = chosen.select(F.struct("one.id", "one.hash").alias("head")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash")).alias("head"))
    stay = whole.join(heads, whole["head"].eqNullSafe(heads["head"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("head").orderBy("head"))
    return stay.withColumn("nth", nth).where("nth = 1").select("row.*")
