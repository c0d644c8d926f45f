import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from accountscope.config import ClassifyConfig, ClusterConfig, FeatureConfig, RunConfig
from accountscope.operators import boost, classify, cluster, many, nmf, svm, text, topics, tuning
from accountscope.plans import bindings, stages


def labelled(spark, x, y):
    rows = [(i, Vectors.dense(np.atleast_1d(v).astype(float)), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["user_id", "features", "label"])


def test_two_boosting_rounds(spark):
    df = labelled(spark, range(1, 7), [1, 1, 0, 0, 1, 0])
    model = boost.AdaBoostClassifier(rounds=2, algorithm="SAMME").fit(df)
    first, second = model.stumps.stumps
    assert (first.threshold, first.left, first.right) == (2.5, 1, 0)
    assert (second.threshold, second.left, second.right) == (5.5, 1, 0)
    assert model.stumps.errors == pytest.approx([1 / 6, 0.2])
    assert (first.alpha, second.alpha) == pytest.approx((1.609438, 1.386294), abs=1e-6)
    assert [r["prediction"] for r in model.transform(df).orderBy("user_id").collect()] == [1, 1, 0, 0, 0, 0]


def test_two_rounds_of_probabilities(spark):
    """Worked by hand: leaf shares 0 / 1 and 3/4 / 1/4 give weights 0, 0, 1/sqrt(3) (zeros) and sqrt(3) (x = 5)."""
    df = labelled(spark, range(1, 7), [1, 1, 0, 0, 1, 0])
    model = boost.AdaBoostClassifier(rounds=2).fit(df)
    first, second = model.stumps.stumps
    assert (first.threshold, first.left, first.right) == (2.5, 1, 0)
    assert first.votes[1] == pytest.approx((np.log(3) / 2, -np.log(3) / 2))
    assert first.raises[1] == pytest.approx((-np.log(3) / 2, np.log(3) / 2))
    assert (second.threshold, second.left, second.right) == (4.5, 0, 1)
    assert second.votes[1] == pytest.approx((-np.log(3) / 2, np.log(3) / 2))
    assert model.stumps.errors == pytest.approx([1 / 6, 1 / 6])
    assert [r["prediction"] for r in model.transform(df).orderBy("user_id").collect()][:4] == [1, 1, 0, 0]


def test_a_side_without_weight_says_nothing():
    votes, raises = boost._real(2, (np.zeros(2), np.array([1.0, 3.0])), 1.0)
    assert votes[0] == raises[0] == (0.0, 0.0)
    assert votes[1] == pytest.approx((-np.log(3) / 2, np.log(3) / 2))


def test_thresholds_are_exact_for_few_values(spark):
    x = [0.0] * 5_000 + [1.0, 2.0, 3.0, 4.0]
    df = labelled(spark, x, [int(v == 2.0) for v in x]).select(F.col("label").alias("y"), "features")
    table = many.vector_table(df.withColumn("label", F.col("y")), "features", "label")
    (found,) = boost.feature_thresholds(table, 8)[0]
    assert found.tolist() == [0.5, 1.5, 2.5, 3.5]


def test_boosting_separable_and_constant(spark):
    df = labelled(spark, range(20), [int(i > 8) for i in range(20)])
    model = boost.AdaBoostClassifier().fit(df)
    assert len(model.stumps.stumps) == 1
    assert model.transform(df).where("prediction <> label").count() == 0
    same = labelled(spark, [1.0] * 6, [0, 0, 0, 0, 1, 1])
    assert {r["prediction"] for r in boost.AdaBoostClassifier(rounds=3).fit(same).transform(same).collect()} == {0.0}


def test_boosting_does_not_depend_on_partitions(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    df = labelled(spark, x, (x[:, 0] * x[:, 1] > 0).astype(int))
    monkeypatch.setattr("accountscope.session.compact.__defaults__", (1,))
    many_tasks = boost.AdaBoostClassifier(rounds=8).fit(df.repartition(9))
    monkeypatch.undo()
    one_task = boost.AdaBoostClassifier(rounds=8).fit(df.coalesce(1))
    assert [(s.feature, s.cut) for s in many_tasks.stumps.stumps] == [(s.feature, s.cut) for s in one_task.stumps.stumps]


def brute_svm(x, y, c):
    """Plain gradient descent on the same objective."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    rate = 1 / (1 + 2 * c * np.linalg.norm(z, 2) ** 2)
    for _ in range(200_000):
        short = np.maximum(0, 1 - y * (z @ w))
        step = w - 2 * c * (short * y) @ z
        w -= rate * step
        if np.linalg.norm(step) < 1e-9:
            break
    return w


@pytest.mark.parametrize("c", [0.01, 1.0])
def test_margin_reaches_the_minimum(spark, c):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=120) > 0.3).astype(int)
    margin = svm.SquaredHingeSVC(c=c, standardise=False).fit(labelled(spark, x, y).repartition(3)).margin
    w = brute_svm(x, 2 * y - 1, c)
    assert np.append(margin.coefficients, margin.intercept) == pytest.approx(w, abs=1e-4)


def test_margin_standardised_ignores_units(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(int)
    a = svm.SquaredHingeSVC().fit(labelled(spark, x, y)).margin
    b = svm.SquaredHingeSVC().fit(labelled(spark, x * [1000.0, 0.01] + 5, y)).margin
    assert a.coefficients == pytest.approx(b.coefficients * [1000.0, 0.01], rel=1e-6)
    with pytest.raises(ValueError, match="two classes"):
        svm.SquaredHingeSVC().fit(labelled(spark, x, np.zeros(80)))


def test_shared_training_equals_single_training(spark, folder):
    """A model trained together with all others equals the one trained on its rows alone."""
    accounts = bindings.account_features(spark, folder)
    from accountscope.operators import splits

    names = classify.xy_split_cols(accounts)
    flagged = splits.split_flags(accounts, "user_id", "user_type", 2, within="cluster").persist()
    table = many.model_table(flagged, [F.col(n) for n in names], "user_type", [0, 1], "cluster", [0, 1], "is_test", 2)
    table.rows = table.rows.persist()
    together = svm.fit_margins(table)
    for c, s in table.models:
        train = classify.assemble(flagged.where((F.col("cluster") == c) & ~F.col("is_test")[s]), names)
        alone = svm.SquaredHingeSVC().fit(train).margin
        assert together[(c, s)].coefficients == pytest.approx(alone.coefficients, rel=1e-3, abs=1e-6)


def test_standard_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    rows = sorted(tuple(r) for r in cluster.standard_scale(df, ["a", "b"]).collect())
    assert [r[0] for r in rows] == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert [r[1] for r in rows] == [0, 0, 0]


def test_kmeans_best_start_and_stable_numbers(spark):
    points = [(i, float(10 * (i % 3)) + 0.01 * i) for i in range(30)]
    df = spark.createDataFrame(points, "user_id INT, x DOUBLE")
    fitted = cluster.kmeans_fit(df, ["x"], ClusterConfig(clusters=3, n_init=4))
    assert fitted.cost == min(fitted.costs)
    assert fitted.centres == sorted(fitted.centres)
    found = {r["user_id"]: r["cluster"] for r in cluster.assign_cluster(df, fitted).collect()}
    assert found == {i: i % 3 for i in range(30)}


@pytest.mark.parametrize("n", [20_000, 400_000])
def test_kmeans_finds_a_far_group_at_every_size(spark, n):
    """Five far rows among n even ones: no start that draws by distance misses them, whatever n is."""
    even = spark.range(n, numPartitions=8).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("y"))
    far = spark.range(n, n + 5).select("id", F.lit(60.0).alias("x"), F.lit(60.0).alias("y"))
    df = even.unionByName(far)
    fitted = cluster.kmeans_fit(df, ["x", "y"], ClusterConfig(), key="id")
    assert fitted.centres[-1] == pytest.approx([60, 60], abs=1e-6)
    assert fitted.cost < 0.13 * n


def test_kmeans_starts_do_not_depend_on_partitions_or_equal_rows(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(300)] + [(i, 2.0, 3.0) for i in range(300, 500)]
    df = spark.createDataFrame(rows, "user_id INT, x DOUBLE, y DOUBLE")
    a = cluster.kmeans_fit(df.coalesce(1), ["x", "y"], ClusterConfig(n_init=3), "user_id")
    b = cluster.kmeans_fit(df.repartition(7), ["x", "y"], ClusterConfig(n_init=3), "user_id")
    assert np.allclose(a.centres, b.centres) and a.cost == pytest.approx(b.cost)
    same = spark.createDataFrame([(i, 1.0) for i in range(20)], "user_id INT, x DOUBLE")
    assert cluster.kmeans_fit(same, ["x"], ClusterConfig(n_init=2)).cost == 0


def test_draws_follow_squared_distances(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 3.0).when(F.col("id") % 3 == 1, 1.0).otherwise(0.0).alias("x0"), F.col("id").alias("row"))
    drawn = cluster._drawn(df, np.zeros((40, 1, 1)), 40, 10, 1)
    values = np.concatenate(drawn)[:, 0]
    assert len(values) == 400 and 0.85 < (values == 3).mean() < 0.95 and set(values) == {1.0, 3.0}


def test_composition_counts_absent_class(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "cluster INT, user_type INT")
    found = {tuple(r) for r in cluster.cluster_composition(df).collect()}
    assert found == {(0, 2, 0, 2), (1, 1, 1, 0), (None, 3, 1, 2)}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, ["apple", "pear", "plum"][: 1 + i % 3] * 3 if i % 2 else ["car", "bus", "tram"][: 1 + i % 3] * 3) for i in range(40)]
    rows.append((99, []))
    return spark.createDataFrame(rows, "user_id INT, terms ARRAY<STRING>").persist()


def test_lda_updates_follow_the_corpus():
    cfg = FeatureConfig()
    assert [topics.updates(n, cfg) for n in (1, 128, 129, 1_024, 1_300, 39_572)] == [5, 5, 10, 40, 55, 1_550]


def test_every_document_is_in_one_batch_of_each_pass(spark):
    df = spark.range(1000).withColumn("row", F.xxhash64("id"))
    placed = df.select("id", *[topics.batch_of(F.col("row"), turn, 8).alias(f"b{turn}") for turn in range(3)]).toPandas()
    for turn in range(3):
        sizes = placed[f"b{turn}"].value_counts()
        assert sorted(sizes.index) == list(range(8)) and sizes.sum() == 1000 and sizes.min() > 80
    assert not (placed["b0"] == placed["b1"]).all()


def test_lda_updates_equal_a_plain_loop(spark, corpus):
    """Batches of whole passes, inferred one document at a time with the textbook's update."""
    vocabulary = text.vocabulary_list(text.document_freq(corpus))
    vectors = text.term_vectors(corpus, vocabulary)
    cfg = FeatureConfig(topics=2, passes=3, batch_size=1000)
    model = topics.lda_fit(vectors, cfg)
    x = np.array([r["tf"].toArray() for r in vectors.collect()])
    weights = np.random.default_rng(cfg.seed).gamma(100.0, 0.01, (2, x.shape[1]))
    for step in range(3):
        beta, sums = np.exp(topics._log_shares(weights)), np.zeros_like(weights)
        for row in x:
            gamma = np.ones(2)
            for _ in range(topics.ROUNDS):
                theta = np.exp(topics._log_shares(gamma[None]))[0]
                before, gamma = gamma, 0.5 + theta * (beta @ (row / (theta @ beta)))
                if np.abs(gamma - before).mean() < topics.LEAST_MOVE:
                    break
            theta = np.exp(topics._log_shares(gamma[None]))[0]
            sums += np.outer(theta, row / (theta @ beta)) * beta
        rate = (cfg.learning_offset + step) ** -cfg.learning_decay
        weights = (1 - rate) * weights + rate * (0.5 + sums)
    assert model.weights == pytest.approx(weights, rel=1e-6)
    assert topics._digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525891], abs=1e-9)


def _plain_lda(vectors, cfg):
    """The textbook's updates, one document after the other, batch by batch."""
    n = vectors.count()
    batches = -(-n // cfg.batch_size)
    placed = [topics.batch_of(F.xxhash64("user_id"), turn, batches, cfg.seed) for turn in range(cfg.passes)]
    rows = [(r["tf"].toArray(), r["b"]) for r in vectors.withColumn("b", F.array(*placed)).collect()]
    weights = np.random.default_rng(cfg.seed).gamma(100.0, 0.01, (cfg.topics, len(rows[0][0])))
    alpha = 1 / cfg.topics
    for step in range(cfg.passes * batches):
        turn, batch = divmod(step, batches)
        own = [x for x, b in rows if b[turn] == batch]
        if not own:
            continue
        beta, sums = np.exp(topics._log_shares(weights)), np.zeros_like(weights)
        for x in own:
            gamma = np.ones(cfg.topics)
            for _ in range(topics.ROUNDS):
                theta = np.exp(topics._log_shares(gamma[None]))[0]
                before, gamma = gamma, alpha + theta * (beta @ (x / (theta @ beta)))
                if np.abs(gamma - before).mean() < topics.LEAST_MOVE:
                    break
            theta = np.exp(topics._log_shares(gamma[None]))[0]
            sums += np.outer(theta, x / (theta @ beta)) * beta
        rate = (cfg.learning_offset + step) ** -cfg.learning_decay
        weights = (1 - rate) * weights + rate * (alpha + n / len(own) * sums)
    return weights


@pytest.mark.parametrize("per_job, per_task", [(20_000, 1_500), (21, 1_500), (20_000, 3)])
def test_lda_batches_follow_one_another(spark, corpus, monkeypatch, per_job, per_task):
    """All batches in one job, a few in each, or every batch dealt out to tasks: the updates are the same."""
    monkeypatch.setattr(topics, "DOCUMENTS_PER_JOB", per_job)
    monkeypatch.setattr(topics, "DOCUMENTS_PER_TASK", per_task)
    vectors = text.term_vectors(corpus, text.vocabulary_list(text.document_freq(corpus)))
    cfg = FeatureConfig(topics=3, passes=2, batch_size=7)
    assert topics.lda_fit(vectors, cfg).weights == pytest.approx(_plain_lda(vectors, cfg), rel=1e-6)


def test_lda_takes_fewer_jobs_than_updates(spark, corpus):
    vectors = text.term_vectors(corpus, text.vocabulary_list(text.document_freq(corpus)))
    cfg = FeatureConfig(topics=2, passes=2, batch_size=1)
    spark.sparkContext.setJobGroup("lda", "lda")
    try:
        topics.lda_fit(vectors, cfg)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("lda"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert topics.updates(41, cfg) == 82 and 0 < jobs < 41


def test_inference_over_tables_and_lists_is_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    model = topics.TopicModel(rng.gamma(2.0, 3.0, (3, 30)), 1 / 3)
    sizes = np.array([4, 0, 30, 1, 9])
    terms = np.concatenate([rng.permutation(30)[:n] for n in sizes])
    counts = rng.integers(1, 9, len(terms)).astype(float)
    found = topics.infer(model, terms, counts, sizes)
    monkeypatch.setattr(topics, "CELLS_PER_TERM", 0)
    lists = topics.infer(model, terms, counts, sizes)
    assert found[0] == pytest.approx(lists[0]) and found[1] == pytest.approx(lists[1])
    assert found[0].sum(axis=1) == pytest.approx([counts[:4].sum() + 1, 1, counts[4:34].sum() + 1, counts[34] + 1, counts[35:].sum() + 1])
    alone = topics.infer(model, terms[4:34], counts[4:34], sizes[2:3])
    assert found[0][2] == pytest.approx(alone[0][0])


def test_lda_distributions(spark, corpus):
    vocabulary = text.vocabulary_list(text.document_freq(corpus))
    vectors = text.term_vectors(corpus, vocabulary)
    cfg = FeatureConfig(topics=2, passes=10)
    model = topics.lda_fit(vectors, cfg)
    found = {r["user_id"]: r["p"] for r in topics.dt_dist(model, vectors).collect()}
    assert len(found) == 41
    assert all(sum(p) == pytest.approx(1) for p in found.values())
    assert found[99] == [0.5, 0.5]
    fruit = {int(np.argmax(p)) for u, p in found.items() if u % 2 and u != 99}
    traffic = {int(np.argmax(p)) for u, p in found.items() if u % 2 == 0}
    assert len(fruit) == len(traffic) == 1 and fruit != traffic
    again = {r["user_id"]: r["p"] for r in topics.dt_dist(topics.lda_fit(vectors, cfg), vectors).collect()}
    assert again == found
    weights = topics.topic_weights(model, vocabulary)
    for row in topics.tw_dist(weights).groupBy("topic").agg(F.sum("weight").alias("s")).collect():
        assert row["s"] == pytest.approx(1)
    top = topics.top_words(weights, 2).collect()
    assert sorted((r["topic"], r["rank"]) for r in top) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_nmf_objective_falls_and_is_correct(spark, corpus):
    n = text.document_count(corpus)
    frequencies = text.document_freq(corpus)
    weights = text.tfidf(text.term_freq(corpus), frequencies, n).persist()
    vocabulary = text.vocabulary_list(frequencies)
    model = nmf.nmf_fit(weights, vocabulary, topics=2, alpha=0.01)
    steps = model.objective
    assert model.settled and not nmf.nmf_fit(weights, vocabulary, topics=2, alpha=0.01, max_iter=1).settled
    assert all(b <= a + 1e-9 for a, b in zip(steps, steps[1:]))
    assert (model.components >= 0).all()
    w = {r["user_id"]: np.array(r["w"]) for r in nmf.nmf_transform(model, weights).collect()}
    assert set(w) == set(range(40)) and all((v >= 0).all() for v in w.values())
    x = {(r["user_id"], r["term"]): r["weight"] for r in weights.collect()}
    fit = sum(
        (x.get((u, t), 0.0) - w[u] @ model.components[:, i]) ** 2 for u in w for i, t in enumerate(vocabulary)
    )
    everything = np.array(list(w.values()))
    penalty = model.l1 * (everything.sum() + model.components.sum())
    penalty += 0.5 * model.l2 * ((everything**2).sum() + (model.components**2).sum())
    assert steps[-1] == pytest.approx(0.5 * fit + penalty, rel=1e-3)


def test_grids_have_all_points():
    sizes = [len(make()[1]) for make in (tuning.grid_dt, tuning.grid_rf, tuning.grid_ada, tuning.grid_svc)]
    assert sizes == [56, 504, 81, 42]


def test_grid_search_refits_best(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2))
    df = labelled(spark, x, (x[:, 0] > 0).astype(int))
    found = tuning.grid_search(df, *tuning.grid_ada(rounds=[1, 4], rates=[1e-6, 1.0]), folds=3)
    assert len(found.scores) == 4 and max(s[1] for s in found.scores) > 0.9
    assert found.best.transform(df).where("prediction = label").count() > 80
    assert found.table(df).count() == 4


def test_grid_report(spark, folder):
    accounts = bindings.account_features(spark, folder)
    data = classify.assemble(accounts, classify.xy_split_cols(accounts)).select("user_id", "features", "label").persist()
    _, report = tuning.grid_report(data, *tuning.grid_svc(penalties=[1.0], iterations=[300]), folds=2)
    found = {(r["metric"], r["class"]): r["value"] for r in report.collect()}
    test_rows = -(-data.count() * 4 // 10)
    assert found[("weighted_support", None)] == test_rows
    hits = found.get(("predicted_as_0", 0), 0) + found.get(("predicted_as_1", 1), 0)
    assert found[("test_accuracy", None)] == pytest.approx(hits / test_rows)
    assert 0 <= found[("train_accuracy", None)] <= 1


def test_features_are_matched_by_cluster_id(spark, folder):
    accounts = bindings.account_features(spark, folder)
    cfg = ClassifyConfig(models=("linear_svc",), folds=2, features={0: ("user_type", "num_words"), 1: ("num_lines", "num_digits")})
    report = classify.per_cluster_models(accounts, cfg)
    assert {r[0] for r in report.select("cluster").distinct().collect()} == {0, 1}
    with pytest.raises(ValueError, match="nope"):
        classify.per_cluster_models(accounts, ClassifyConfig(models=("linear_svc",), features=("nope",)))


def test_whole_run(spark, folder):
    cfg = RunConfig(
        features=FeatureConfig(min_df=0.1, passes=1, topics=3),
        cluster=ClusterConfig(clusters=2, n_init=2),
        classify=ClassifyConfig(models=("decision_tree", "linear_svc"), folds=2, max_depth=4),
    )
    raw = (bindings.static_raw(spark, folder), *bindings.cohorts_raw(spark, folder))
    out = stages.run_pipeline(cfg, raw=raw)
    assert out.static.count() == out.documents.count()
    sizes = {r["cluster"]: (r["size"], r["n_0"] + r["n_1"]) for r in out.composition.collect()}
    assert all(a == b for a, b in sizes.values()) and sizes[None][0] == out.clustered.count() == out.dynamic.count()
    report = out.report.collect()
    supports = {(r["cluster"], r["model"]): r["value"] for r in report if r["metric"] == "weighted_support"}
    assert supports == {(c, m): -(-sizes[c][0] * 4 // 10) for c in (0, 1) for m in cfg.classify.models}


def test_settings_are_checked():
    for make in (
        lambda: FeatureConfig(ngram_range=(2, 1)), lambda: ClusterConfig(clusters=1), lambda: ClassifyConfig(models=("x",)),
        lambda: RunConfig(stages=("nope",)), lambda: ClassifyConfig(train=1.0), lambda: ClusterConfig(features=()),
    ):
        with pytest.raises(ValueError):
            make()


def dense_start(x, topics):
    """The start by a dense decomposition: of each pair of vectors the side with the larger product of lengths."""
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    h = np.zeros((topics, x.shape[1]))
    h[0] = np.sqrt(s[0]) * np.abs(vt[0])
    for j in range(1, topics):
        sides = [(np.linalg.norm(np.maximum(sign * u[:, j], 0)), np.maximum(sign * vt[j], 0)) for sign in (1, -1)]
        length, side = max(sides, key=lambda e: e[0] * np.linalg.norm(e[1]))
        norm = np.linalg.norm(side)
        h[j] = np.sqrt(s[j] * length * norm) * side / norm
    return s, np.where(h < 1e-6, 0, h)


@pytest.mark.parametrize("terms", [12, 90])
def test_nmf_starts_from_the_singular_vectors(spark, terms):
    rng = np.random.default_rng(5)
    x = rng.random((150, 6)) @ rng.random((6, terms)) ** 3 + 0.05 * rng.random((150, terms))
    x[rng.random(x.shape) < 0.4] = 0
    rows = [(i, [int(t) for t in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)]
    data = spark.createDataFrame(rows, "user_id INT, terms ARRAY<INT>, values ARRAY<DOUBLE>").repartition(3)
    values, expected = dense_start(x, 5)
    found, vectors = nmf.leading_directions(data, terms, 5, passes=60)
    np.testing.assert_allclose(found, values[:5], rtol=1e-7)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(5), atol=1e-9)
    np.testing.assert_allclose(nmf.svd_start(data, terms, 5, passes=60), expected, atol=1e-4)
    # Another random basis leads to the same start.
    np.testing.assert_allclose(nmf.svd_start(data, terms, 5, passes=60, seed=9), expected, atol=1e-4)


def test_nmf_start_of_fewer_directions_than_topics(spark):
    rows = [(i, [0, 2], [float(i), 2.0 * i]) for i in range(1, 9)]
    data = spark.createDataFrame(rows, "user_id INT, terms ARRAY<INT>, values ARRAY<DOUBLE>")
    h = nmf.svd_start(data, 3, 3)
    assert (h[0] > 0).tolist() == [True, False, True] and not h[1:].any()
