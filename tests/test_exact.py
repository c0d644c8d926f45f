"""Exact cuts, running totals and the term dictionary, against plain Python."""

import os
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_trees import plain_tree

from accountscope.config import ClassifyConfig
from accountscope.operators import classify, exact, text
from accountscope.operators.prefix import running_totals
from accountscope.session import scratch_root


def nested(nodes, node=1):
    r = nodes[node]
    if r["feature"] is None:
        return r["counts"], None
    return r["counts"], (r["feature"], r["cut"], nested(nodes, 2 * node), nested(nodes, 2 * node + 1))


def same(found, plain, x):
    """Equal trees; a cut lies between the plain tree's value and the next one of the node's rows."""
    counts, split = found
    assert list(counts) == list(plain[0])
    assert (split is None) == (plain[1] is None)
    if split:
        j, cut, left, right = split
        pj, value, pleft, pright = plain[1]
        beyond = x[x[:, j] > value]
        assert j == pj and value < cut < beyond[:, j].min()
        same(left, pleft, x[x[:, j] <= value])
        same(right, pright, beyond)


def rows_of(spark, x, y, train, model=0):
    data = [(model, int(t), bool(u), [float(v) for v in row]) for row, t, u in zip(x, y, train)]
    return spark.createDataFrame(data, "model BIGINT, label INT, train BOOLEAN, x ARRAY<DOUBLE>")


@pytest.mark.parametrize("criterion, min_leaf", [("gini", 1), ("entropy", 7)])
def test_exact_trees_equal_recursion_over_all_cuts(spark, criterion, min_leaf):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.random(300), rng.integers(0, 5, 300), rng.random(300).round(2)])
    y = ((x[:, 0] > 0.61) ^ (x[:, 2] > 0.3) ^ (rng.random(300) < 0.05)).astype(int)
    every = rows_of(spark, x, y, np.ones(300, bool)).unionByName(rows_of(spark, x[:120], y[:120], np.ones(120, bool), 1))
    nodes, _ = exact.grow(every, 2, 4, criterion, min_leaf)
    for model, n in ((0, 300), (1, 120)):
        found = {r["node"]: r for r in nodes.where(F.col("model") == model).collect()}
        same(nested(found), plain_tree(x[:n], y[:n], criterion, 4, min_leaf), x[:n])


def test_outcomes_count_test_rows_once(spark):
    rng = np.random.default_rng(8)
    x, train = rng.random((200, 2)), np.arange(200) % 3 > 0
    y = (x[:, 0] > 0.5).astype(int)
    nodes, outcomes = exact.grow(rows_of(spark, x, y, train), 2, 6)
    cut = nodes.where("node = 1").first()["cut"]
    expected = {}
    for v, t in zip(x[~train, 0], y[~train]):
        expected[int(t), int(v > cut)] = expected.get((int(t), int(v > cut)), 0) + 1
    assert {(r["label"], r["prediction"]): r["n"] for r in outcomes.collect()} == expected
    assert nodes.count() == 3


def test_models_without_training_rows_and_values_that_are_no_numbers(spark):
    lone = rows_of(spark, [[1.0], [2.0]], [1, 0], [False, False])
    nodes, outcomes = exact.grow(lone, 2, 3)
    assert nodes.count() == 0
    assert {(r["label"], r["prediction"], r["n"]) for r in outcomes.collect()} == {(0, 0, 1), (1, 0, 1)}
    assert exact.grow(lone.limit(0), 2, 3)[1].count() == 0
    with pytest.raises(Exception, match="finite"):
        exact.grow(rows_of(spark, [[float("nan")]], [1], [True]), 2, 1)


def test_exact_cuts_in_the_report(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, float(v), int((v * 1000) % 2 < 1)) for i, v in enumerate(rng.random(400))]
    accounts = spark.createDataFrame(rows, "user_id BIGINT, cluster INT, a DOUBLE, user_type INT")
    cfg = dict(models=("decision_tree",), folds=3, max_depth=4, features=("a",))
    n = {e: {(r["split"]): r["n"] for r in classify.model_outcomes(accounts, ClassifyConfig(exact_cuts=e, **cfg)).groupBy("split").agg(F.sum("n").alias("n")).collect()}
         for e in (True, False)}
    assert n[True] == n[False]


def test_few_values_have_the_cuts_of_binned_trees(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, float(a), float(c), int((a > 4) ^ (c > 2) ^ (rng.random() < 0.1))) for i, (a, c) in enumerate(rng.integers(0, 9, (300, 2)))]
    accounts = spark.createDataFrame(rows, "user_id BIGINT, cluster INT, a DOUBLE, c DOUBLE, user_type INT")
    cfg = dict(models=("decision_tree",), folds=2, max_depth=1, features=("a", "c"))
    found = [sorted(map(tuple, classify.model_outcomes(accounts, ClassifyConfig(exact_cuts=e, **cfg)).collect())) for e in (True, False)]
    assert found[0] == found[1]


def test_running_totals_of_a_group_over_many_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v), int(c)) for g, v, c in zip(rng.choice([0, 0, 0, 1, 2], 2000), rng.permutation(2000), rng.integers(0, 9, 2000))]
    df = spark.createDataFrame(rows, "g INT, v DOUBLE, n BIGINT")
    found = {(r["g"], r["v"]): r["n_to"] for r in running_totals(df, ["g"], "v", ["n"], tasks=7).collect()}
    for g in (0, 1, 2):
        own = sorted((v, n) for h, v, n in rows if h == g)
        assert [found[g, v] for v, _ in own] == list(accumulate(n for _, n in own))
    assert len(found) == 2000
    assert running_totals(df.limit(0), ["g"], "v", ["n"]).count() == 0


def test_dictionary_and_indexed_terms_equal_vectors(spark):
    docs = [(1, ["b", "a", "b"]), (2, []), (3, ["é", "Z", "a", "a"]), (4, ["b", "z"]), (5, ["q"])]
    terms = spark.createDataFrame(docs, "user_id BIGINT, terms ARRAY<STRING>")
    frequencies = text.document_freq(terms).where("term <> 'q'")
    vocabulary = text.vocabulary_list(frequencies)
    ids = text.term_ids(frequencies)
    assert [r["term"] for r in ids.orderBy("id").collect()] == vocabulary
    assert sorted(r["id"] for r in ids.collect()) == list(range(len(vocabulary)))
    indexed = {r["user_id"]: (r["ids"], r["tf"]) for r in text.indexed_terms(text.term_freq(terms), ids, documents=terms).collect()}
    for r in text.term_vectors(terms, vocabulary).collect():
        assert indexed.pop(r["user_id"]) == (list(r["tf"].indices), list(r["tf"].values))
    assert not indexed
    assert text.term_ids(frequencies.limit(0)).count() == 0


def test_dictionary_is_written_once_over_many_ranges(spark):
    """Ids are dense and alphabetical over all ranges; neither they nor the join that uses them write another copy."""
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abcé Z"), rng.integers(1, 7))) for _ in range(900)})
    docs = [(d, [str(w) for w in rng.choice(words, 40)]) for d in range(60)]
    terms = spark.createDataFrame(docs, "user_id BIGINT, terms ARRAY<STRING>")
    folder = f"{scratch_root(spark)}/accountscope/{spark.sparkContext.applicationId}"
    written = lambda: {x for x in os.listdir(folder)} if os.path.isdir(folder) else set()
    frequencies, measure = text.document_freq(terms), text.term_freq(terms)
    start = written()
    ids = text.term_ids(frequencies)
    used = sorted({w for _, own in docs for w in own})
    assert {r["term"]: (r["id"], r["df"]) for r in ids.collect()} == {w: (i, sum(w in own for _, own in docs)) for i, w in enumerate(used)}
    begun = written()
    made = text.indexed_terms(measure, ids, documents=terms)
    found = {r["user_id"]: dict(zip(r["ids"], r["tf"])) for r in made.collect()}
    assert found == {d: {i: own.count(w) for i, w in enumerate(used) if w in own} for d, own in docs}
    assert sorted(x.rsplit("-", 1)[0] for x in begun - start) == ["join-side", "term-ids"]
    assert written() == begun
