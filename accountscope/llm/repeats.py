"""Passages repeated across documents, by sparse suffixes whose sorted neighbours are extended to both sides.

Suffixes are kept only at content-selected positions: word k-grams whose hash is the smallest of some window, so that
every passage of ``length`` words holds one at the same place in each of its copies. Such a passage contains the first
words behind its suffix or those up to it, one of two stretches of more than half its length; suffixes neither of whose
stretches occurs twice in the corpus leave.

The others get the words around their stretch and are sorted by stretch and by what follows it, in ranges: tasks hold
runs of suffixes, however often one occurs. Neighbours are compared, and a match is extended to the right and to the
left; one that reaches ``length`` words is an interval. Two suffixes of a stretch are always neighbours. Where three or
more share a stretch, the partner on the right need not be the one on the left, so the passages at each of their
places are also told apart by hash; only runs at the border of a task, the rest of which may lie in another one, send
these hashes on. Intervals are merged into spans. No partner is left out, and no text is compared with all others.

Words are compared by 64-bit hashes in stretches and by 32 bits each around them. Counts are aggregated before they
travel; joins with such counts split hot keys. Tables are deleted once the next one is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountscope.llm.graph import components
from accountscope.llm.simhash import forest
from accountscope.session import materialise, release


@dataclass(frozen=True)
class RepeatConfig:
    """length: words of the shortest passage; gram: words of a minimiser."""

    length: int = 50
    gram: int = 8

    @property
    def window(self) -> int:
        """K-grams among which one is surely kept: a passage of ``length`` words has as many."""
        return self.length - self.gram + 1

    @property
    def before(self) -> int:
        """Words before a suffix from which on a passage is sought by what precedes the suffix."""
        return self.window // 2

    @property
    def stretches(self) -> tuple[tuple[int, int], ...]:
        """Per side: words before the suffix and words in all of the stretch that a passage around the suffix holds."""
        return (0, self.length - self.before + 1), (self.before, self.before + self.gram)

    def room(self, side: int) -> int:
        """Words around a stretch that make it a passage."""
        return self.length - self.stretches[side][1]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of lower-cased words, the same in every process."""
    ws = text.lower().split()
    return pd.util.hash_array(np.array(ws, dtype=object), categorize=False) if ws else np.empty(0, np.uint64)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + len(out)]
        out ^= out >> np.uint64(29)
    return out


#: Words of a text that are searched for minimisers at a time.
_PART = 1 << 22


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest hash, the leftmost of equals, of some ``window`` consecutive grams."""
    kept = []
    for at in range(0, max(0, len(grams) - window + 1), _PART):
        g = grams[at:at + _PART + window - 1]
        low = np.uint64((1 << 23) - 1)
        best = (g & ~low) | np.arange(len(g), dtype=np.uint64)  # hash first, then position
        span = 1
        while 2 * span <= window:
            best = np.minimum(best[:-span], best[span:])
            span *= 2
        if span < window:
            best = np.minimum(best[: len(best) - (window - span)], best[window - span:])
        kept.append(np.unique((best & low).astype(np.int64)) + at)
    return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)


def suffixes(docs: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """``doc, pos, key0, key1`` for every kept suffix: hashes of the stretch on each side, NULL where the text is too short. docs: ``doc, text``."""
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, places, keys, short = [], [], ([], []), ([], [])
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                h = word_hashes(text)
                at = minimisers(gram_hashes(h, cfg.gram), cfg.window)
                docs_.append(np.full(len(at), doc, np.int64))
                places.append(at)
                for side, (back, size) in enumerate(cfg.stretches):
                    hashes = gram_hashes(h, size)
                    out = (at < back) | (at - back >= len(hashes))
                    keys[side].append(np.append(hashes, np.uint64(0))[np.where(out, len(hashes), at - back)].view(np.int64))
                    short[side].append(out)
            if docs_:
                columns = [pa.array(np.concatenate(x)) for x in (docs_, places)]
                columns += [pa.array(np.concatenate(k), mask=np.concatenate(m)) for k, m in zip(keys, short)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "pos", "key0", "key1"])

    return docs.mapInArrow(sample, "doc bigint, pos bigint, key0 bigint, key1 bigint")


def surroundings(places: DataFrame, docs: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """``side, key, doc, at, before, after`` of every place: where its stretch starts, and the hashes of the words around it.

    places: ``doc, at`` (array of struct(pos, side)). ``before`` runs from the nearest word outwards.
    """
    names = ["side", "key", "doc", "at", "before", "after"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "at"))):
                h = word_hashes(text)
                words = (h >> np.uint64(32)).astype(">u4")
                for side, (back, size) in enumerate(cfg.stretches):
                    hashes, room = gram_hashes(h, size), cfg.room(side)
                    starts = np.unique(np.array([p["pos"] - back for p in at if p["side"] == side], np.int64))
                    starts = starts[(starts >= 0) & (starts < len(hashes))]
                    out[0] += [side] * len(starts)
                    out[1] += hashes[starts].view(np.int64).tolist()
                    out[2] += [doc] * len(starts)
                    out[3] += starts.tolist()
                    out[4] += [words[max(0, s - room):s][::-1].tobytes() for s in starts]
                    out[5] += [words[s + size:s + size + room].tobytes() for s in starts]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)

    joined = places.join(docs, "doc").select("doc", "text", "at")
    return joined.mapInArrow(cut, "side int, key bigint, doc bigint, at bigint, before binary, after binary")


def _spread(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of one matrix, and how many each row has."""
    values = column.to_pylist()
    sizes = np.array([len(v) // 4 for v in values], np.int64)
    out = np.zeros((len(values), width), np.uint64)
    if len(values):
        out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(values), ">u4")
    return out, sizes


def _running(words: np.ndarray) -> np.ndarray:
    """``[row, n]``: a hash of the first n words of every row, n from 0."""
    out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    for j in range(words.shape[1]):
        x = (out[:, j] + words[:, j] + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, j + 1] = x ^ (x >> np.uint64(31))
    return out


def _shared(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many first words neighbouring rows share."""
    same = (words[1:] == words[:-1]) & (np.arange(words.shape[1]) < np.minimum(sizes[1:], sizes[:-1])[:, None])
    return np.cumprod(same, axis=1).sum(axis=1)


def matches(key: np.ndarray, doc: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray,
            ) -> tuple[np.ndarray, ...]:
    """Extents of the matches of sorted suffixes of one side: rows with equal ``key`` are one run.

    Returns per row: words matched before and after the stretch (-1: none), a row that stands for all rows its matches
    connect it to, and the smallest and largest document among those that share a passage at one of its places.
    """
    n, room = before.shape
    left, right = np.full(n, -1), np.full(n, -1)
    low, high = doc.copy(), doc.copy()
    joined_a, joined_b = [], []
    if n > 1:
        l, r = _shared(before, n_before), _shared(after, n_after)
        pair = np.flatnonzero((key[1:] == key[:-1]) & (l + r >= room))
        for mine, other in ((pair, pair + 1), (pair + 1, pair)):
            np.maximum.at(left, mine, l[pair])
            np.maximum.at(right, mine, r[pair])
            np.minimum.at(low, mine, doc[other])
            np.maximum.at(high, mine, doc[other])
        joined_a.append(pair)
        joined_b.append(pair + 1)
    run = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1 if n else np.empty(0, np.int64)
    crowd = np.flatnonzero(np.bincount(run)[run] > 2) if n else np.empty(0, np.int64)
    if len(crowd):
        lefts, rights = _running(before[crowd]), _running(after[crowd])
        for j in range(room + 1):
            own = (n_before[crowd] >= j) & (n_after[crowd] >= room - j)
            rows = crowd[own]
            x = (lefts[own, j] * np.uint64(3) + rights[own, room - j]) * np.uint64(0x9E3779B97F4A7C15) + key[rows].view(np.uint64)
            _, first, which, count = np.unique(x, return_index=True, return_inverse=True, return_counts=True)
            some = count[which] > 1
            rows, which = rows[some], which[some]
            least, most = np.full(len(count), np.iinfo(np.int64).max), np.full(len(count), np.iinfo(np.int64).min)
            np.minimum.at(least, which, doc[rows])
            np.maximum.at(most, which, doc[rows])
            low[rows], high[rows] = np.minimum(low[rows], least[which]), np.maximum(high[rows], most[which])
            left[rows], right[rows] = np.maximum(left[rows], j), np.maximum(right[rows], room - j)
            joined_a.append(rows)
            joined_b.append(np.flatnonzero(own)[first[which]] if len(rows) else rows)
            joined_b[-1] = crowd[joined_b[-1]] if len(rows) else rows
    root = np.arange(n)
    if joined_a:
        nodes, roots = forest(np.concatenate(joined_a), np.concatenate(joined_b), n)
        root[nodes] = roots
    return left, right, root, low, high


#: Rows of a task that are matched at a time; a run of equal stretches is never cut.
_CHUNK = 100_000
MATCH = "open boolean, doc bigint, start bigint, end bigint, link bigint, low bigint, high bigint"


def neighbours(sorted_places: DataFrame, cfg: RepeatConfig) -> DataFrame:
    """Intervals of sorted suffixes; ``open`` rows are single passages of runs that may go on in another task.

    ``link`` is equal for intervals that matches connect. An open row's ``link`` is the hash of its passage, and no match
    has been found for it yet.
    """
    names = ["open", "doc", "start", "end", "link", "low", "high"]

    def found(rows: pa.Table, side: int, ends: set[int]) -> Iterator[pa.RecordBatch]:
        size, room = cfg.stretches[side][1], cfg.room(side)
        key, doc, at = (rows.column(c).to_numpy() for c in ("key", "doc", "at"))
        before, n_before = _spread(rows.column("before"), room)
        after, n_after = _spread(rows.column("after"), room)
        left, right, root, low, high = matches(key, doc, before, n_before, after, n_after)
        some = np.flatnonzero(left >= 0)
        salt = np.uint64(side + 1) * np.uint64(0xD1B54A32D192ED03)
        link = (key.view(np.uint64) + doc[root].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at[root].view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ salt
        columns = [np.zeros(len(some), bool), doc[some], at[some] - left[some], at[some] + size + right[some], link[some].view(np.int64), low[some], high[some]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        border = np.flatnonzero(np.isin(key, np.array(sorted(ends), np.int64)))
        if len(border):
            lefts, rights = _running(before[border]), _running(after[border])
            for j in range(room + 1):
                mine = np.flatnonzero((n_before[border] >= j) & (n_after[border] >= room - j))
                x = (lefts[mine, j] * np.uint64(3) + rights[mine, room - j]) * np.uint64(0x9E3779B97F4A7C15) + key[border[mine]].view(np.uint64) * np.uint64(2 * j + 1)
                # Rows of this task that share the passage have met already: one speaks for all.
                x, first, which = np.unique(x, return_index=True, return_inverse=True)
                least, most = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.iinfo(np.int64).min)
                np.minimum.at(least, which, doc[border[mine]])
                np.maximum.at(most, which, doc[border[mine]])
                b = border[mine[first]]
                start = at[b] - j
                columns = [np.ones(len(b), bool), doc[b], start, start + cfg.length, (x ^ salt).view(np.int64), least, most]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first = True

        def sides(table: pa.Table, ends: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            side = table.column("side").to_numpy()
            for s in np.unique(side):
                at = np.flatnonzero(side == s)
                yield from found(table.slice(at[0], len(at)), int(s), {k for t, k in ends if t == s})

        def edge(table: pa.Table, i: int) -> tuple[int, int]:
            return table.column("side")[i].as_py(), table.column("key")[i].as_py()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) < _CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            side, key = table.column("side").to_numpy(), table.column("key").to_numpy()
            last = np.flatnonzero((side != side[-1]) | (key != key[-1]))
            if not len(last):
                continue
            yield from sides(table.slice(0, int(last[-1]) + 1), {edge(table, 0)} if first else set())
            held, first = table.slice(int(last[-1]) + 1).to_batches(), False
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from sides(table, {edge(table, 0), edge(table, table.num_rows - 1)} if first else {edge(table, table.num_rows - 1)})

    return sorted_places.mapInArrow(compare, MATCH)


def spans(docs: DataFrame, cfg: RepeatConfig | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start_word, end_word, n_words, partner_id, class_id, n_docs``: merged repeated spans of every document, ends exclusive.

    partner_id is a document that shares a passage with the span: the smallest one found below its own id, else one
    above; its own where only its own text repeats. class_id is the same for all spans that shared passages connect,
    directly or through others; n_docs is the number of documents in the class. NULL ids and NULL or short texts have no
    spans. Rows that share an id share their spans, found in any of their texts. Repeats within one text count too. Ids
    must be whole numbers. Other columns are ignored.
    """
    cfg = cfg or RepeatConfig()
    own = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    sampled = materialise(suffixes(own, cfg), "suffixes")
    keyed = sampled.select("doc", "pos", F.posexplode(F.array("key0", "key1")).alias("side", "key")).where("key IS NOT NULL")
    # Written first: a join with a table splits a hot key, one with an aggregate of the same shuffle can't.
    often = materialise(keyed.groupBy("side", "key").agg(F.count("*").alias("n")).where("n > 1").select("side", "key"), "repeated-stretches")
    places = keyed.join(often, ["side", "key"]).groupBy("doc").agg(F.collect_set(F.struct("pos", "side")).alias("at"))
    around = materialise(surroundings(places, own, cfg), "surroundings")
    release(sampled, often)
    # Sorted by what follows; ranges may part one stretch by its surroundings and documents, so none is a task of its own.
    order = ["side", "key", "after", "before", "doc", "at"]
    found = materialise(neighbours(around.repartitionByRange(*order).sortWithinPartitions(*order), cfg), "matches")
    release(around)
    still = found.where("open")
    met = still.groupBy("link").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1").drop("n")
    closed = found.where("NOT open").unionByName(still.drop("low", "high").join(met, "link"))
    intervals = closed.groupBy("doc", "start", "link").agg(F.max("end").alias("end"), F.min("low").alias("low"), F.max("high").alias("high"))

    order = Window.partitionBy("doc").orderBy("start", F.desc("end"), "link")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = intervals.withColumn("opens", F.when(F.coalesce(F.col("start") > reach, F.lit(True)), F.col("start")))
    begun = begun.withColumn("begin", F.max("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = materialise(begun.select("doc", "end", "link", "low", "high", "begin", F.xxhash64("doc", "begin").alias("node")), "repeat-intervals")
    release(found)

    # Every span is linked with the first one of each of its links, so classes lose none and stay linear in size.
    firsts = placed.groupBy("link").agg(F.min("node").alias("first"))
    roots = components(placed.join(firsts, "link").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())
    whole = placed.groupBy("doc", "begin", "node").agg(
        F.max("end").alias("end"), F.coalesce(F.min(F.when(F.col("low") < F.col("doc"), F.col("low"))),
                                             F.min(F.when(F.col("high") > F.col("doc"), F.col("high"))), F.col("doc")).alias("partner"))
    classed = materialise(whole.join(roots, "node", "left").withColumn("class_id", F.coalesce("root", "node")), "repeat-spans")
    release(placed)
    sizes = classed.groupBy("class_id").agg(F.count_distinct("doc").alias("n_docs"))
    return classed.join(sizes, "class_id").select(
        F.col("doc").alias(id_col), F.col("begin").alias("start_word"), F.col("end").alias("end_word"),
        (F.col("end") - F.col("begin")).alias("n_words"), F.col("partner").alias("partner_id"), "class_id", "n_docs")
