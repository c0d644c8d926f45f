"""Trees, forests and boosted models that train together, against plain ones that train alone."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from accountscope.operators import boost, many, splits, trees, tuning


def table_of(spark, x, y, folds=3, parts=3):
    rows = [(i, Vectors.dense(list(map(float, v))), float(t), i % folds) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["user_id", "features", "label", "fold"]).repartition(parts)


def problem(n=240, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (n, 4))
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 3) ^ (rng.random(n) < 0.1)).astype(int)
    return x, y


def plain_tree(x, y, criterion, max_depth, min_leaf, k=2):
    """Nested ``(counts, None)`` or ``(counts, (feature, value, left, right))``: recursion over all cuts between values."""
    def mass(labels):
        c = np.bincount(labels, minlength=k).astype(float)
        n = c.sum()
        if criterion == "gini":
            return n - (c * c).sum() / n
        return -sum(v * math.log2(v / n) for v in c if v)

    counts = np.bincount(y, minlength=k)
    best = None
    if max_depth and (counts > 0).sum() > 1:
        for j in range(x.shape[1]):
            for v in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= v
                if left.sum() >= min_leaf and (~left).sum() >= min_leaf:
                    cost = round((mass(y[left]) + mass(y[~left])) / len(y), 12)
                    if best is None or cost < best[0]:
                        best = (cost, j, v)
    if best is None or best[0] >= mass(y) / len(y) - 1e-9:
        return counts, None
    _, j, v = best
    left = x[:, j] <= v
    return counts, (j, v, plain_tree(x[left], y[left], criterion, max_depth - 1, min_leaf), plain_tree(x[~left], y[~left], criterion, max_depth - 1, min_leaf))


def nested(tree, thresholds, node=0):
    counts = tree.counts[node].astype(int)
    if tree.feature[node] < 0:
        return counts, None
    j, child = tree.feature[node], tree.child[node]
    return counts, (j, thresholds[j][tree.cut[node]], nested(tree, thresholds, child), nested(tree, thresholds, child + 1))


def same(a, b, x):
    assert a[0].tolist() == b[0].tolist()
    assert (a[1] is None) == (b[1] is None)
    if a[1]:
        assert a[1][0] == b[1][0]
        # Cuts lie between values; where no row of the node lies between two cuts, they part it alike.
        left = x[:, a[1][0]] <= a[1][1]
        assert (left == (x[:, b[1][0]] <= b[1][1])).all()
        same(a[1][2], b[1][2], x[left])
        same(a[1][3], b[1][3], x[~left])


@pytest.mark.parametrize("cells", [trees.CELLS, 500])
def test_trees_grown_together_equal_plain_trees(spark, monkeypatch, cells):
    monkeypatch.setattr(trees, "CELLS", cells)
    x, y = problem()
    binned = boost.folded_table(table_of(spark, x, y), 3, "user_id", 32)
    specs = [trees.TreeSpec((0, s), c, d, leaf) for s in range(3) for c in ("gini", "entropy") for d, leaf in ((1, 1), (4, 5), (6, 20))]
    for spec, tree in zip(specs, trees.grow(binned, specs)):
        train = np.arange(len(x)) % 3 != spec.model[1]
        same(plain_tree(x[train], y[train], spec.criterion, spec.max_depth, spec.min_leaf), nested(tree, binned.thresholds[0]), x[train])


def test_a_search_equals_single_fits(spark):
    """Every point's accuracy is that of a tree fitted alone on each fold."""
    x, y = problem(150, 7)
    df = table_of(spark, x, y, parts=1).persist()
    grid = tuning.grid_dt(depths=[2, 4], leaves=[5, 20])
    for point, mean, sd in trees.search(df, *grid, "user_id", 3):
        own = []
        for s in range(3):
            fitted = grid[0].copy(point).fit(df.where(F.col("fold") != s))
            own.append(fitted.transform(df.where(F.col("fold") == s)).select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
        assert (mean, sd) == pytest.approx((np.mean(own), np.std(own)), abs=0.025)
        assert isinstance(grid[0], DecisionTreeClassifier)


def test_shallow_trees_and_small_forests_are_parts_of_large_ones(spark):
    x, y = problem()
    df = table_of(spark, x, y)
    grid = tuning.grid_rf(sizes=[1, 3, 5], criteria=["gini"], depths=[2, 5], leaves=[5])
    all_at_once = {tuple(sorted((p.name, v) for p, v in point.items())): (m, sd) for point, m, sd in trees.search(df, *grid, "user_id", 3)}
    for n, d in ((1, 2), (3, 5), (5, 2)):
        (alone,) = trees.search(df, *tuning.grid_rf(sizes=[n], criteria=["gini"], depths=[d], leaves=[5]), "user_id", 3)
        assert all_at_once[tuple(sorted((p.name, v) for p, v in alone[0].items()))] == pytest.approx(alone[1:])


def test_forests_do_not_depend_on_partitions_and_draw_with_replacement(spark):
    x, y = problem()
    specs = [trees.TreeSpec((0, 0), "gini", 4, 3, bag) for bag in (1, 2)]
    found = []
    for parts in (1, 5):
        binned = boost.folded_table(table_of(spark, x, y, parts=parts), 3, "user_id", 32)
        found.append([(t.feature, t.cut, t.child) for t in trees.grow(binned, specs)])
    assert found[0] == found[1] and found[0][0] != found[0][1]
    drawn = trees._bagged(np.arange(20_000), [7, None])
    assert drawn[0].mean() == pytest.approx(1, abs=0.03) and (drawn[0] == 0).mean() == pytest.approx(math.exp(-1), abs=0.02)
    assert (drawn[1] == 1).all()


def test_trees_of_all_clusters_and_splits_equal_plain_trees(spark):
    """Models that share every pass learn, and vote, as a plain tree on their own rows does."""
    x, y = problem(300, 11)
    rows = [(i, i % 2, int(t), [i % 3 == s for s in range(3)], *map(float, v)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row BIGINT, c INT, y INT, flags ARRAY<BOOLEAN>, a DOUBLE, b DOUBLE, d DOUBLE, e DOUBLE").repartition(4)
    table = many.model_table(df, [F.col(n) for n in "abde"], "y", [0, 1], "c", [0, 1], "flags", 3, carry=["row"])
    binned = boost.bin_table(table, 32)
    at = np.arange(len(x))
    for (c, s), (tree,) in trees.forests_of(binned, 5, None, 1).items():
        train = (at % 2 == c) & (at % 3 != s)
        plain = plain_tree(x[train], y[train], "gini", 5, 1)
        same(plain, nested(tree, binned.thresholds[c]), x[train])
        bins = np.column_stack([np.searchsorted(binned.thresholds[c][j], x[:, j]) for j in range(4)])
        node = [0] * len(x)
        for i in at:
            while tree.feature[node[i]] >= 0:
                node[i] = tree.child[node[i]] + int(bins[i, tree.feature[node[i]]] > tree.cut[node[i]])
        assert trees.voter([tree], 2)(bins).tolist() == [int(np.argmax(tree.counts[n])) for n in node]


def test_drawn_pairs_equal_the_whole_draw():
    rows, bags = np.arange(50) * 7, [3, None, 8]
    t, r = np.nonzero(np.random.default_rng(1).random((3, 50)) < 0.4)
    assert (trees._drawn(rows, t, r, bags) == trees._bagged(rows, bags)[t, r]).all()


def test_trees_of_one_class_and_of_no_rows(spark):
    binned = boost.folded_table(table_of(spark, [[1], [2], [3], [4]], [1, 1, 1, 1], 2), 2, "user_id", 32)
    (tree,) = trees.grow(binned, [trees.TreeSpec((0, 0))])
    assert tree.feature == [-1] and tree.counts[0].tolist() == [2]
    (tree,) = trees.grow(binned, [trees.TreeSpec((9, 0))])
    assert tree.feature == [-1]


# ---------------------------------------------------------------- boosting


def test_rates_and_folds_boosted_together_equal_separate_runs(spark):
    x, y = problem()
    binned = boost.folded_table(table_of(spark, x, y), 3, "user_id", 32)
    together = boost.boost_rates(binned, {0.1: 4, 1.0: 6, 100.0: 3})
    assert set(together) == {(0, s, r) for s in range(3) for r in (0.1, 1.0, 100.0)}
    for rate, rounds in ((0.1, 4), (1.0, 6), (100.0, 3)):
        alone = boost.boost(binned, rounds, rate)
        for s in range(3):
            a, b = together[(0, s, rate)], alone[(0, s)]
            assert [(t.feature, t.cut) for t in a.stumps] == [(t.feature, t.cut) for t in b.stumps]
            assert a.errors == pytest.approx(b.errors)


@pytest.mark.parametrize("algorithm", ["SAMME.R", "SAMME"])
def test_written_weights_leave_stumps_unchanged(spark, monkeypatch, algorithm):
    x, y = problem(300, 9)
    binned = boost.folded_table(table_of(spark, x, y), 3, "user_id", 32)
    found = []
    for state_rounds in (2, 1000):
        monkeypatch.setattr(boost, "STATE_ROUNDS", state_rounds)
        found.append(boost.boost_rates(binned, {1.0: 9, 0.5: 5}, algorithm))
    for m in found[0]:
        assert [(s.feature, s.cut) for s in found[0][m].stumps] == [(s.feature, s.cut) for s in found[1][m].stumps]
        assert found[0][m].errors == pytest.approx(found[1][m].errors)


def test_staged_accuracy_equals_votes(spark):
    x, y = problem()
    binned = boost.folded_table(table_of(spark, x, y), 3, "user_id", 32)
    models = boost.boost_rates(binned, {1.0: 6})
    got = boost.staged_accuracy(binned, models, [1, 4, 6, 9])
    pdf = binned.table.rows.toPandas()
    _, label, test, bins = many.split_batch(pdf, binned.table.columns)
    for (c, s, r), model in models.items():
        rows = (test >> s) & 1 == 1
        for n in (1, 4, 6, 9):
            assert got[(c, s, r)][n] == pytest.approx((model.staged(n).vote(bins[rows]) == label[rows]).mean())


def test_boosting_grid_equals_single_fits(spark):
    x, y = problem(120, 3)
    df = table_of(spark, x, y, parts=1)
    folded = splits.stratified_kfold(df.drop("fold"), "user_id", "label", 3, 42).withColumn("fold", F.col("fold").cast("int")).persist()
    estimator, grid = tuning.grid_ada(rounds=[2, 5], rates=[0.5, 1.0])
    found = tuning.grid_search(df.drop("fold"), estimator, grid, folds=3)
    for point, mean, _ in found.scores:
        own = []
        for s in range(3):
            fitted = estimator.copy(point).fit(folded.where(F.col("fold") != s))
            own.append(fitted.transform(folded.where(F.col("fold") == s)).select(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
        assert mean == pytest.approx(np.mean(own), abs=0.025)
    assert isinstance(found.table(df).toPandas(), pd.DataFrame)
