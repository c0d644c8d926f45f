"""Language of words and texts by a linear-chain conditional random field.

Every word is a position of the chain. Its score in each language comes from its own form: character n-grams, affixes,
and lexicons of words that the labelled texts show often. Learned transitions say how readily one language follows
another, so a chain may switch between languages. Forward-backward gives every word its probabilities over the whole
text; the language of a text is the one with the largest sum over its words.

The model is fitted on the driver from a sample of labelled texts of bounded size; every text is then labelled in one
pass without a shuffle. Words that were seen before keep their scores, so form features are computed once per distinct
word. Forward-backward runs over blocks of words: the matrix of a whole block is a product that all blocks compute side
by side, chains of blocks are then short, and results are those of a chain without blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accountscope.session import materialise

UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Words per block of a chain, and words whose scores a task remembers.
BLOCK = 64
REMEMBERED = 200_000
#: Longest word whose scores are remembered.
LONGEST = 64


@dataclass(frozen=True)
class LanguageConfig:
    """per_label: labelled texts sampled per language; words: words taken of each; buckets: hashed form features.

    ``lexicon`` words per language, each found in ``least`` sampled places; ``labels`` languages at most.
    """

    per_label: int = 800
    words: int = 48
    buckets: int = 1 << 15
    lexicon: int = 2000
    least: int = 3
    labels: int = 64
    steps: int = 40
    rate: float = 0.2
    decay: float = 1e-5


def words(text: str | None) -> list[str]:
    """Maximal runs of letters, in lower case."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


#: Multiplier of the rolling hash, and what keeps marked ends, prefixes and suffixes apart from n-grams.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BEFORE, _AFTER, _PREFIX, _SUFFIX = (np.uint64(x) for x in (0x110000, 0x110001, 0x110002, 0x110003))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _STEP
    return x ^ (x >> np.uint64(29))


def form_features(vocabulary: Sequence[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the character n-grams (1 to 3, with marked ends) and of the affixes (2 to 4) of all words."""
    sizes = np.array([len(w) for w in vocabulary], np.int64)
    letters = np.frombuffer("".join(vocabulary).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes + 2)
    starts = ends - sizes - 2
    marked = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(marked), bool)
    inner[starts] = inner[ends - 1] = False
    marked[starts], marked[ends - 1], marked[inner] = _BEFORE, _AFTER, letters
    own = np.repeat(np.arange(len(sizes)), sizes + 2)
    room = np.repeat(ends, sizes + 2) - np.arange(len(marked))
    found, words_of, grams = [], [], _mixed(marked)
    for n in (1, 2, 3, 4):
        if n > 1:
            grams = _mixed(grams[:-1] + marked[n - 1:]) if len(grams) else grams
        if n <= 3:
            whole = room[: len(grams)] >= n
            found.append(grams[whole])
            words_of.append(own[: len(grams)][whole])
        if n >= 2:
            long = np.flatnonzero(sizes >= n)
            found += [_mixed(grams[starts[long] + 1] + _PREFIX), _mixed(grams[ends[long] - 1 - n] + _SUFFIX)]
            words_of += [long, long]
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64), np.concatenate(words_of)


def _by_owner(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by owner."""
    return np.stack([np.bincount(owner, weights=values[:, c], minlength=n) for c in range(values.shape[1])], axis=1)


@dataclass(frozen=True)
class Chain:
    """A fitted model. ``weights``: a row per form bucket, then one per lexicon; ``lexicon``: word to the languages that list it."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, tuple[int, ...]]
    buckets: int

    def features(self, vocabulary: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of weights, their values, number of the word); the form features of a word share a length of one."""
        rows, owner = form_features(vocabulary, self.buckets)
        values = np.bincount(owner, minlength=len(vocabulary))[owner] ** -0.5
        listed = [(self.buckets + k, i) for i, w in enumerate(vocabulary) for k in self.lexicon.get(w, ())]
        more = np.array(listed, np.int64).reshape(-1, 2)
        return np.append(rows, more[:, 0]), np.append(values, np.ones(len(more))), np.append(owner, more[:, 1])

    def emissions(self, vocabulary: Sequence[str]) -> np.ndarray:
        """``[word, language]`` scores."""
        if not vocabulary:
            return np.zeros((0, len(self.labels)))
        rows, values, owner = self.features(vocabulary)
        return _by_owner(self.weights[rows] * values[:, None], owner, len(vocabulary))


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = BLOCK, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities ``[word, language]`` of chains laid end to end and, on ``count``, the expected number of each transition.

    ``lengths`` are those of the chains, none of them 0.
    """
    k = scores.shape[1]
    follow = np.exp(transitions - transitions.max())
    # Blocks: places [block, step]; the last of a chain may be shorter.
    per = -(-lengths // block)
    ends = np.cumsum(lengths)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begins = np.repeat(ends - lengths, per) + number * block
    sizes = np.minimum(block, np.repeat(ends, per) - begins)
    steps = np.arange(min(block, int(lengths.max())))
    there = steps < sizes[:, None]
    places = np.minimum(begins[:, None] + steps, len(scores) - 1)
    likely = np.exp(scores - scores.max(axis=1, keepdims=True))[places]
    first = number == 0

    # One matrix per block of a chain with several: what it turns the probabilities before its first word into.
    into, out = np.ones((len(first), k)) / k, np.ones((len(first), k)) / k
    several = np.flatnonzero(np.repeat(per > 1, per))
    if len(several):
        there_, likely_ = there[several], likely[several]
        whole = np.where(first[several, None, None], 1.0 / k, follow) * likely_[:, 0, None, :]
        for t in steps[1:]:
            then = (whole.reshape(-1, k) @ follow).reshape(-1, k, k) * likely_[:, t, None, :]
            whole = _scaled(np.where(there_[:, t, None, None], then, whole), (1, 2))
        at_, heads = np.cumsum(np.repeat(per > 1, per)) - 1, np.flatnonzero(first)
        for i in range(1, int(per.max())):
            at = heads[per > i] + i
            into[at] = _scaled((into[at - 1, None, :] @ whole[at_[at - 1]])[:, 0], (1,))
        for i in range(int(per.max()) - 1, 0, -1):
            at = heads[per > i] + i
            out[at - 1] = _scaled((whole[at_[at]] @ out[at, :, None])[:, :, 0], (1,))

    forward, backward = np.empty_like(likely), np.empty_like(likely)
    now = np.where(first[:, None], 1.0 / k, into @ follow) * likely[:, 0]
    forward[:, 0] = now = _scaled(now, (1,))
    for t in steps[1:]:
        forward[:, t] = now = np.where(there[:, t, None], _scaled((now @ follow) * likely[:, t], (1,)), now)
    now = out
    for t in steps[::-1]:
        backward[:, t] = now
        now = np.where(there[:, t, None], _scaled((likely[:, t] * now) @ follow.T, (1,)), now)
    # Places in a chain's order: rows are blocks in order, so the mask flattens them rightly.
    forward, backward = forward[there], backward[there]
    posterior = _scaled(forward * backward, (1,))

    expected = np.zeros((k, k))
    if not count:
        return posterior, expected
    later = np.ones(len(scores), bool)
    later[ends - lengths] = False
    here = np.flatnonzero(later)
    for part in np.array_split(here, max(1, -(-len(here) // 100_000))):
        after = (np.exp(scores[part] - scores[part].max(axis=1, keepdims=True))) * backward[part]
        both = forward[part - 1][:, :, None] * follow * after[:, None, :]
        expected += _scaled(both, (1, 2)).sum(axis=0) if len(part) else 0
    return posterior, expected


def labelled_sample(docs: DataFrame, cfg: LanguageConfig, text_col: str, label_col: str) -> DataFrame:
    """``label, part, key``: at most ``per_label`` different texts of each language, of each up to ``words`` words from any place.

    Texts are chosen by their hash, equal texts counting once.
    """
    counts = docs.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).alias("label")).count().limit(cfg.labels + 1).collect()
    if len(counts) > cfg.labels:
        raise ValueError(f"more than {cfg.labels} languages")
    # Twice as many as wanted: some have no words or are copies.
    cuts = [F.when(F.col(label_col) == r["label"], F.lit(int(min(1.0, 2 * cfg.per_label / r["count"]) * (1 << 30)))) for r in counts]
    cut = F.coalesce(*cuts) if cuts else F.lit(0)
    key = F.xxhash64(F.lit(13), F.col(text_col))
    chosen = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull() & (F.pmod(key, F.lit(1 << 30)) < cut))
    chosen = chosen.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), key.alias("key"))
    n_words = cfg.words

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text, k in zip(batch.column("text").to_pylist(), batch.column("key").to_pylist()):
                ws = words(text)
                at = k // 7 % (len(ws) - n_words + 1) if len(ws) > n_words else 0
                parts.append(" ".join(ws[at:at + n_words]))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(parts, pa.string()), batch.column("key")], names=["label", "part", "key"])

    parts = chosen.mapInArrow(part, "label string, part string, key bigint").where("part <> ''")
    order = Window.partitionBy("label").orderBy("key", "part")
    ranked = parts.distinct().withColumn("nth", F.row_number().over(order))
    return ranked.where(F.col("nth") <= cfg.per_label).select("label", "part", "key")


def learn(sample: DataFrame, cfg: LanguageConfig | None = None) -> Chain:
    """Fit the chain on ``label, part, key``, a sample of bounded size. Without rows the model knows no language.

    Parts are joined in pairs in the order of their keys, so that chains switch between languages and transitions are
    learned from switches as well as from runs.
    """
    cfg = cfg or LanguageConfig()
    rows = sorted((r["key"], r["label"], r["part"].split(" ")) for r in sample.collect())
    labels = sorted({r[1] for r in rows})
    k = len(labels)
    counts = {y: Counter() for y in labels}
    for _, y, ws in rows:
        counts[y].update(ws)
    lexicon: dict[str, tuple[int, ...]] = {}
    for i, y in enumerate(labels):
        often = sorted((w for w, n in counts[y].items() if n >= cfg.least), key=lambda w: (-counts[y][w], w))
        for w in often[: cfg.lexicon]:
            lexicon[w] = (*lexicon.get(w, ()), i)
    model = Chain(labels, np.zeros((cfg.buckets + k, k)), np.zeros((k, k)), lexicon, cfg.buckets)
    if k < 2:
        return model

    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, _, ws in rows for w in ws))}
    at, value, owner = model.features(list(vocabulary))
    used, column = np.unique(at, return_inverse=True)
    word = np.array([vocabulary[w] for _, _, ws in rows for w in ws])
    truth = np.repeat([labels.index(y) for _, y, _ in rows], [len(ws) for _, _, ws in rows])
    sizes = np.array([len(ws) for _, _, ws in rows])
    lengths = np.add.reduceat(sizes, np.arange(0, len(sizes), 2))
    inside = np.ones(len(word), bool)
    inside[np.cumsum(lengths) - lengths] = False
    later = np.flatnonzero(inside)
    seen = np.bincount(truth[later - 1] * k + truth[later], minlength=k * k).reshape(k, k)
    hot = np.eye(k)[truth]

    def summed(per_word: np.ndarray) -> np.ndarray:
        """Per-word values added over all words that carry a feature."""
        each = _by_owner(per_word, word, len(vocabulary))
        return _by_owner(each[owner] * value[:, None], column, len(used))

    # Adam on the mean log-likelihood per word; all of the sample in every step.
    theta = [np.zeros((len(used), k)), np.zeros((k, k))]
    speed, spread = [[np.zeros_like(x) for x in theta] for _ in range(2)]
    for step in range(1, cfg.steps + 1):
        emitted = _by_owner(theta[0][column] * value[:, None], owner, len(vocabulary))
        posterior, expected = forward_backward(emitted[word], lengths, theta[1], int(lengths.max()))
        slopes = [summed(hot - posterior) / len(word) - cfg.decay * theta[0], (seen - expected) / len(word) - cfg.decay * theta[1]]
        for x, g, m, v in zip(theta, slopes, speed, spread):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights[used] = theta[0]
    model.transitions[:] = theta[1]
    return model


FOUND = "label STRING, score DOUBLE, n_words BIGINT, spans ARRAY<STRUCT<label: STRING, start: INT, end: INT, score: DOUBLE>>"


def label(docs: DataFrame, model: Chain, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a column ``name`` of its own: ``struct<label, score, n_words, spans>``.

    spans: runs of words with the same most probable language (``end`` exclusive) and their mean probability. label: the
    language with the largest sum of probabilities, the first of equals; score: its mean probability. A NULL text, one
    without letters, and a model that knows no language give ``und`` with score 0 and no spans.
    """
    labels = model.labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((0, len(labels)))
        for batch in batches:
            texts = [words(t) for t in batch.column("__text").to_pylist()]
            if len(known) > REMEMBERED:
                known, table = {}, np.zeros((0, len(labels)))
            new = list(dict.fromkeys(w for ws in texts for w in ws if w not in known)) if labels else []
            scores = np.concatenate([table, model.emissions(new)])
            place = known | {w: len(table) + i for i, w in enumerate(new)}
            lengths = np.array([len(ws) for ws in texts], np.int64)
            if labels and lengths.any():
                emitted = scores[np.fromiter((place[w] for ws in texts for w in ws), np.int64, int(lengths.sum()))]
                posterior, _ = forward_backward(emitted, lengths[lengths > 0], model.transitions, count=False)
            known, table = place, scores
            if any(len(w) > LONGEST for w in new):
                keep = [w for w in place if len(w) <= LONGEST]
                known, table = {w: i for i, w in enumerate(keep)}, scores[[place[w] for w in keep]]
            out, at = [], 0
            for n in lengths.tolist():
                if not n or not labels:
                    out.append({"label": UNKNOWN, "score": 0.0, "n_words": n, "spans": []})
                    continue
                p = posterior[at:at + n]
                at += n
                mean = p.mean(axis=0)
                top = p.argmax(axis=1)
                starts = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
                ends = np.append(starts[1:], n)
                sure = np.add.reduceat(p[np.arange(n), top], starts) / (ends - starts)
                spans = [{"label": labels[top[s]], "start": int(s), "end": int(e), "score": float(x)} for s, e, x in zip(starts, ends, sure)]
                best = int(mean.argmax())
                out.append({"label": labels[best], "score": min(1.0, float(mean[best])), "n_words": n, "spans": spans})
            found = pa.array(out, pa.struct([("label", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([
                ("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]))
            yield pa.RecordBatch.from_arrays([batch.column("__row"), found], names=["__row", "__found"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    taken = docs.select(row, F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([taken.schema["__row"], T.StructField("__found", T.StructType.fromDDL(FOUND))])
    return taken.mapInArrow(run, schema).select(*[F.col(f"__row.`{c}`") for c in docs.columns], F.col("__found").alias(name))


def held_out(id_: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 when divided by 4. No id: learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, cfg: LanguageConfig | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score, n_words, n_switches`` of every row, by a model learned from rows not held out.

    Rows that share an id are predicted each from its own text. Without labelled rows every prediction is ``und``. Other
    columns are ignored.
    """
    cfg = cfg or LanguageConfig()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    known = own.where(~held_out(F.col("id"))).select("text", "label")
    model = learn(materialise(labelled_sample(known, cfg, "text", "label"), "language-sample"), cfg)
    found = label(own.select("id", "text"), model, "text", "found")
    return found.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), F.col("found.label").alias("lang_pred"),
                        F.col("found.score").alias("score"), F.col("found.n_words").alias("n_words"),
                        F.greatest(F.size("found.spans") - 1, F.lit(0)).alias("n_switches"))
