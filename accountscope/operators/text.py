"""Corpus-level text operators.

Input frames are ``<key, text>`` or, for accounts split by ``collate_parts``,
``<key, part, text>``. Whatever is per document stays row-local; shuffles carry
partially aggregated terms only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accountscope.functions import text as tx
from accountscope.session import BROADCAST_ROWS, broadcast_if_small, materialise

#: Largest vocabulary a driver-side model may hold.
MAX_TERMS = 1_000_000
#: Copies of a large lemma table, so that one frequent token spreads over as many tasks.
LEMMA_SALTS = 32


def _group(df: DataFrame, key: str) -> list[str]:
    return [key, "part"] if "part" in df.columns else [key]


#: Given instead of the keys of multi-part documents: the operator finds them itself.
FIND = object()


def hot_keys(df: DataFrame, key: str = "user_id") -> DataFrame | None:
    """Keys whose document has several parts, or None when there are none.

    Found once on the documents and passed on, this spares each operator below its own search.
    """
    if "part" not in df.columns:
        return None
    hot = broadcast_if_small(df.where("part > 0").select(key).distinct())
    return None if hot.isEmpty() else hot


def tokenize(
    df: DataFrame, key: str = "user_id", text: str = "tweet", stopwords: Sequence[str] = tx.STOPWORDS
) -> DataFrame:
    """``<key, [part], tokens ARRAY<STRING>>``: one narrow projection, no shuffle."""
    return df.select(*_group(df, key), tx.clean_tokens(F.col(text), stopwords).alias("tokens"))


def lemmatize_dict(tokens: DataFrame, lemmas: DataFrame, key: str = "user_id", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Replace tokens by their lemma from a ``<token, lemma [, pos]>`` table; unknown tokens stay.

    With a ``pos`` column the noun entries apply, the default part of speech.
    """
    if "pos" in lemmas.columns:
        lemmas = lemmas.where(F.coalesce(F.lower(F.substring("pos", 1, 1)), F.lit("n")) == "n")
    table = materialise(lemmas.groupBy("token").agg(F.min("lemma").alias("lemma")), "lemmas")
    group = _group(tokens, key)
    # Documents move once, as arrays; exploding and regrouping then stay in the task.
    placed = tokens.select(*group, "tokens").repartition(*group)
    words = placed.select(*group, F.posexplode_outer("tokens").alias("pos", "token"))
    if table.limit(limit + 1).count() <= limit:
        found = words.join(F.broadcast(table), "token", "left")
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LEMMA_SALTS - 1))))
        salt = F.pmod(F.xxhash64(*group, "pos"), F.lit(LEMMA_SALTS)).cast("int")
        found = words.withColumn("salt", salt).join(salted, ["token", "salt"], "left")
    entry = F.struct("pos", F.coalesce("lemma", "token").alias("word"))
    regrouped = found.groupBy(*group).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), entry))).alias("w"))
    return regrouped.select(*group, F.transform("w", lambda e: e["word"]).alias("tokens"))


def ngrams(tokens: DataFrame, low: int = 1, high: int = 2, key: str = "user_id", hot: DataFrame | None = FIND) -> DataFrame:
    """``<key, [part], terms>``: n-grams of the flat token list, also across part borders."""
    group = _group(tokens, key)
    plain = tx.ngrams(F.col("tokens"), low, high).alias("terms")
    hot = None if high <= 1 else hot_keys(tokens, key) if hot is FIND else hot
    if hot is None:
        return tokens.select(*group, plain)
    single = tokens.join(hot, key, "left_anti").select(*group, plain)
    several = tokens.join(hot, key, "left_semi")
    # Every non-empty part passes on up to high-1 tokens, so high-1 parts back are enough.
    w = Window.partitionBy(key).orderBy("part")
    tail = F.slice("tokens", F.greatest(F.size("tokens") - (high - 2), F.lit(1)), high - 1)
    tails = several.where(F.size("tokens") > 0).select(*group, tail.alias("tail"))
    nothing = F.array().cast("array<string>")
    earlier = F.concat(*[F.coalesce(F.lag("tail", back).over(w), nothing) for back in range(high - 1, 0, -1)])
    carried = tails.select(*group, earlier.alias("earlier")).select(
        *group, F.slice("earlier", F.greatest(F.size("earlier") - (high - 2), F.lit(1)), high - 1).alias("carried")
    )
    joined = several.join(broadcast_if_small(carried), group, "left")
    made = tx.ngrams(F.col("tokens"), low, high, F.coalesce("carried", nothing)).alias("terms")
    return single.unionByName(joined.select(*group, made))


def _counted(terms: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``<keep, term, tf>`` of every row by itself: its terms are sorted where they are, and runs of equal ones counted."""
    # Columns of their own: inside a lambda, an expression would be evaluated for every element.
    ordered = terms.select(*keep, F.sort_array("terms").alias("__s"))
    at = F.sequence(F.lit(0), F.size("__s") - 1)
    last = F.filter(at, lambda i: ~F.get("__s", i).eqNullSafe(F.get("__s", i + 1)) | (i == F.size("__s") - 1))
    ends = ordered.select(*keep, "__s", F.when(F.size("__s") > 0, last).alias("__e"))
    before = F.concat(F.array(F.lit(-1)), F.slice("__e", 1, F.size("__e") - 1))
    runs = F.zip_with("__e", before, lambda i, b: F.struct(F.get("__s", i).alias("term"), (i - b).cast("bigint").alias("tf")))
    return ends.select(*keep, F.explode_outer(runs).alias("__r")).select(*keep, "__r.term", "__r.tf").where(F.col("term").isNotNull())


def term_freq(terms: DataFrame, key: str = "user_id") -> DataFrame:
    """``<key, term, tf>``.

    A document in one row is counted in it, so its terms are not shuffled. Documents of several rows add up their
    terms' counts; they are found by their keys alone. Where these are too many to broadcast, all are added up.
    """
    rows = terms.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    several = broadcast_if_small(rows.where("__n > 1").select(F.col(key).alias("__k")))
    summed = F.sum("tf").alias("tf")
    if several.isEmpty():
        return _counted(terms, [key])
    if several.count() > BROADCAST_ROWS:
        return _counted(terms, [key]).groupBy(key, "term").agg(summed)
    same = F.col(key).eqNullSafe(F.col("__k"))
    single = _counted(terms.join(several, same, "left_anti"), [key])
    return single.unionByName(_counted(terms.join(several, same, "left_semi"), [key]).groupBy(key, "term").agg(summed))


def document_count(terms: DataFrame, key: str = "user_id") -> int:
    """Documents in the corpus, empty ones included."""
    return (terms.where("part = 0") if "part" in terms.columns else terms).count()


def document_freq(terms: DataFrame, key: str = "user_id", hot: DataFrame | None = FIND) -> DataFrame:
    """``<term, df>``: in how many documents a term occurs.

    A document in one row needs no per-document shuffle, only the (partially
    aggregated) count per term. Terms of multi-part documents are made distinct first.
    """
    hot = hot_keys(terms, key) if hot is FIND else hot
    once = F.array_distinct("terms")
    if hot is None:
        listed = tx.explode_terms(terms, once, "term")
    else:
        single = tx.explode_terms(terms.join(hot, key, "left_anti"), once, "term")
        several = tx.explode_terms(terms.join(hot, key, "left_semi"), once, "term", key).distinct().select("term")
        listed = single.unionByName(several)
    return listed.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def df_prune(frequencies: DataFrame, documents: int, min_df: float = 0.15, max_df: float = 0.85) -> DataFrame:
    """Terms with ``min_df·N <= df <= max_df·N``, bounds inclusive. Whole numbers are document counts."""
    low = min_df if isinstance(min_df, int) else min_df * documents
    high = max_df if isinstance(max_df, int) else max_df * documents
    return frequencies.where((F.col("df") >= F.lit(low)) & (F.col("df") <= F.lit(high)))


def keep_terms(tf: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows of ``tf`` whose term is in the vocabulary."""
    return tf.join(broadcast_if_small(vocabulary.select("term")), "term", "left_semi")


def vocabulary_list(pruned: DataFrame, limit: int = MAX_TERMS) -> list[str]:
    """The pruned terms in alphabetical order, as a model-sized driver list."""
    rows = pruned.select("term").limit(limit + 1).collect()
    if not rows:
        raise ValueError("no terms remain: lower min_df or raise max_df")
    if len(rows) > limit:
        raise ValueError(f"more than {limit} terms remain: tighten min_df / max_df")
    return sorted(row[0] for row in rows)


def term_vectors(terms: DataFrame, vocabulary: list[str], key: str = "user_id", hot: DataFrame | None = FIND) -> DataFrame:
    """``<key, tf VECTOR>`` in vocabulary order; parts of one document are summed."""
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="terms", outputCol="tf")
    hot = hot_keys(terms, key) if hot is FIND else hot
    if hot is None:
        return model.transform(terms).select(key, "tf")
    single = model.transform(terms.join(hot, key, "left_anti")).select(key, "tf")
    several = model.transform(terms.join(hot, key, "left_semi"))
    return single.unionByName(several.groupBy(key).agg(Summarizer.sum(F.col("tf")).alias("tf")))


def term_ids(frequencies: DataFrame) -> DataFrame:
    """``<term, id, df>``: dense ids from 0 in alphabetical order, for dictionaries of any size. Written once.

    The order is that of :func:`vocabulary_list`, but no list of terms reaches the driver. Terms are sorted into
    ranges and written with their place there; a term's id is that place after the terms of the ranges before.
    """
    tasks = int(frequencies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = frequencies.select("term", "df").repartitionByRange(tasks, "term").sortWithinPartitions("term")
    # The number of the task stands in the bits from the 34th, the row's place in it below them.
    numbered = ordered.withColumn("__n", F.monotonically_increasing_id())
    written = materialise(numbered.withColumn("__range", F.shiftright("__n", 33)), "term-ids")
    held = written.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("__range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    place = F.col("__n") - F.shiftleft("__range", 33)
    return written.join(broadcast_if_small(before), "__range").select("term", (F.col("__before") + place).alias("id"), "df")


def indexed_terms(measure: DataFrame, ids: DataFrame, value: str = "tf", documents: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """``<key, ids ARRAY<BIGINT>, value ARRAY>``: the non-zero entries of each document's vector, ids ascending.

    ``measure`` has a row per document and term; terms without an id are left out. A document has at most as many
    entries as the dictionary. Documents without entries have empty arrays when ``documents`` are given.
    ``ids`` are counted and then joined from where :func:`term_ids` has written them, without another copy.
    """
    numbers = ids.select("term", "id")
    coded = measure.join(F.broadcast(numbers) if ids.count() <= BROADCAST_ROWS else numbers, "term")
    gathered = coded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", value))).alias("e"))
    if documents is not None:
        every = documents.select(key).distinct() if "part" in documents.columns else documents.select(key)
        gathered = every.join(gathered, key, "left")
    entries = F.coalesce("e", F.array().cast(gathered.schema["e"].dataType))
    return gathered.select(key, F.transform(entries, lambda e: e["id"]).alias("ids"), F.transform(entries, lambda e: e[value]).alias(value))


def tfidf(tf: DataFrame, pruned: DataFrame, documents: int, key: str = "user_id") -> DataFrame:
    """Smoothed TF-IDF ``<key, term, weight>`` with L2-normalised rows.

    After pruning, one document has at most as many rows as the vocabulary.
    """
    idf = F.ln(F.lit(1.0 + documents) / (F.col("df") + F.lit(1.0))) + F.lit(1.0)
    weighted = tf.join(broadcast_if_small(pruned), "term").select(key, "term", (F.col("tf") * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", F.try_divide(F.col("w"), norm).alias("weight"))


def _per_document(measure: DataFrame, documents: DataFrame | None, key: str, column: str) -> DataFrame:
    if documents is None:
        return measure
    zero = F.lit(0).cast(measure.schema[column].dataType)
    every = documents.select(key).distinct() if "part" in documents.columns else documents.select(key)
    return every.join(measure, key, "left").select(key, F.coalesce(column, zero).alias(column))


def singly_occurring(tf: DataFrame, documents: DataFrame | None = None, key: str = "user_id") -> DataFrame:
    """How many terms occur exactly once in each document; documents without terms count 0 when given."""
    counted = tf.groupBy(key).agg(F.count_if(F.col("tf") == 1).alias("singles"))
    return _per_document(counted, documents, key, "singles")


def row_entropy_tf(tf: DataFrame, key: str = "user_id") -> DataFrame:
    """Entropy of each document's term counts, ``ln t − Σ tf·ln tf / t``."""
    n = F.col("tf").cast("double")
    summed = tf.groupBy(key).agg(F.sum(n).alias("t"), F.sum(n * F.ln(n)).alias("s"))
    return summed.select(key, (F.ln("t") - F.try_divide("s", "t")).alias("entropy"))


def frequent_words(
    tf: DataFrame, frequencies: DataFrame, documents: int, share: float, corpus: DataFrame | None = None, key: str = "user_id"
) -> DataFrame:
    """Tokens per document that belong to words found in at least ``share`` of all documents."""
    common = frequencies.where(F.col("df") >= F.lit(share * documents))
    counted = keep_terms(tf, common).groupBy(key).agg(F.sum("tf").alias("frequent_words"))
    return _per_document(counted, corpus, key, "frequent_words")
