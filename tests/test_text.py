import random

import pytest
from pyspark.sql import functions as F

from accountscope.functions import text as tx
from accountscope.operators import text

SENTENCE = "Ünïcode café – don't_stop! *x* 3.5 “quote”"


def test_tokenise(spark):
    df = spark.createDataFrame([(SENTENCE,), ("_ ***   a b",)], "t STRING")
    made = df.select(
        tx.drop_punct(tx.strip_tokens(tx.wordpunct(F.col("t")))).alias("a"), tx.clean_tokens(F.col("t")).alias("b")
    ).collect()
    assert made[0]["a"] == ["ünïcode", "café", "–", "don", "t_stop", "x", "3", "5", "“", "quote", "”"]
    assert made[0]["b"] == ["ünïcode", "café", "t_stop", "x", "3", "5", "quote"]
    assert made[1]["a"] == ["a", "b"]


def test_stopword_lists():
    assert len(tx.CUSTOM_STOPWORDS) == 28
    assert len(set(tx.ENGLISH_STOPWORDS)) == len(tx.ENGLISH_STOPWORDS) == 179


def test_ngrams(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "user_id INT, tokens ARRAY<STRING>")
    found = {r[0]: r[1] for r in text.ngrams(df).collect()}
    assert found == {1: ["a", "b", "c", "a b", "b c"], 2: ["a"], 3: []}


def brute_grams(tokens, low, high):
    return sorted(" ".join(tokens[i : i + n]) for n in range(low, high + 1) for i in range(len(tokens) - n + 1))


@pytest.mark.parametrize("low, high", [(1, 1), (1, 2), (2, 3), (1, 4)])
def test_ngrams_cross_part_borders(spark, low, high):
    rng = random.Random(7)
    rows, whole = [], {}
    for user in range(12):
        for part in range(rng.randint(1, 6)):
            tokens = [rng.choice("abcd") for _ in range(rng.choice([0, 1, 1, 2, 5]))]
            rows.append((user, part, tokens))
            whole.setdefault(user, []).extend(tokens)
    df = spark.createDataFrame(rows, "user_id INT, part INT, tokens ARRAY<STRING>")
    made = text.ngrams(df, low, high)
    found = {u: [] for u in whole}
    for r in made.collect():
        found[r["user_id"]] += r["terms"]
    assert {u: sorted(g) for u, g in found.items()} == {u: brute_grams(t, low, high) for u, t in whole.items()}
    # Document frequency and vectors see one document per user.
    counts = {}
    for u, t in whole.items():
        for g in set(brute_grams(t, low, high)):
            counts[g] = counts.get(g, 0) + 1
    assert {r[0]: r[1] for r in text.document_freq(made).collect()} == counts
    assert text.document_count(made) == 12
    vocabulary = sorted(counts)
    for r in text.term_vectors(made, vocabulary).collect():
        grams = brute_grams(whole[r["user_id"]], low, high)
        assert [grams.count(g) for g in vocabulary] == list(r["tf"].toArray())


@pytest.mark.parametrize(
    "low, high, want", [(0.5, 1.0, "ab"), (0.25, 0.75, "bcd"), (0.0, 0.5, "bcd"), (2, 4, "ab"), (1, 1, "cd")]
)
def test_df_prune(spark, low, high, want):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["a", "b"]), (4, ["a", "d"])], "user_id INT, terms ARRAY<STRING>")
    kept = text.df_prune(text.document_freq(df), 4, low, high)
    assert "".join(sorted(r["term"] for r in kept.collect())) == want


def test_empty_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError, match="no terms remain"):
        text.vocabulary_list(spark.createDataFrame([], "term STRING, df BIGINT"))


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "this is a test"), (2, "this is another test")], "user_id INT, t STRING")
    terms = docs.select("user_id", F.split("t", " ").alias("terms"))
    found = text.tfidf(text.term_freq(terms), text.document_freq(terms), 2).collect()
    got = {(r["user_id"], r["term"]): r["weight"] for r in found}
    assert got[(1, "this")] == pytest.approx(0.448321, abs=1e-6)
    assert got[(2, "another")] == pytest.approx(0.630099, abs=1e-6)


def test_singly_occurring_and_entropy(spark):
    tf = spark.createDataFrame([(1, t, n) for t, n in zip("abcde", [1, 2, 3, 1, 1])], "user_id INT, term STRING, tf BIGINT")
    docs = spark.createDataFrame([(1,), (2,)], "user_id INT")
    assert {r[0]: r[1] for r in text.singly_occurring(tf, docs).collect()} == {1: 3, 2: 0}
    assert text.row_entropy_tf(tf).first()["entropy"] == pytest.approx(1.494175, abs=1e-5)


@pytest.mark.parametrize("limit", [100, 0])
def test_lemmatise(spark, limit):
    tokens = spark.createDataFrame([(1, ["cats", "ran", "cats", "x"]), (2, [])], "user_id INT, tokens ARRAY<STRING>")
    lemmas = spark.createDataFrame([("cats", "n", "cat"), ("ran", "v", "run")], "token STRING, pos STRING, lemma STRING")
    found = {r[0]: r[1] for r in text.lemmatize_dict(tokens, lemmas, limit=limit).collect()}
    assert found == {1: ["cat", "ran", "cat", "x"], 2: []}


def term_rows():
    rng = random.Random(3)
    words = lambda n: [rng.choice(["a", "b", "c d", "é", ""]) for _ in range(n)]
    rows = [(k, words(rng.choice([0, 1, 2, 30]))) for k in range(40)]
    return rows + [(90, None), (91, []), (92, [None, "a", None, "a"])]


def test_terms_of_documents_in_one_row_are_not_shuffled(spark):
    tf = text.term_freq(spark.createDataFrame(term_rows(), "user_id INT, terms ARRAY<STRING>"))
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()
    counts = text.row_entropy_tf(tf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user_id" in counts and ", term" not in counts.split("hashpartitioning(user_id", 1)[1].split(")")[0]


@pytest.mark.parametrize("limit", [200_000, 1])
def test_term_freq_adds_up_rows_of_a_key(spark, monkeypatch, limit):
    from collections import Counter

    monkeypatch.setattr(text, "BROADCAST_ROWS", limit)
    rows = term_rows() + [(3, ["a", "z", "z"]), (None, ["a"]), (None, ["a", "b"]), (91, []), (5, None), (5, ["a"])]
    for made in (rows, term_rows()):
        want = Counter((k, t) for k, ts in made for t in ts or [] if t is not None)
        tf = text.term_freq(spark.createDataFrame(made, "user_id INT, terms ARRAY<STRING>"))
        assert tf.dtypes == [("user_id", "int"), ("term", "string"), ("tf", "bigint")]
        found = [tuple(r) for r in tf.collect()]
        assert len(found) == len(want) and {r[:2]: r[2] for r in found} == want
