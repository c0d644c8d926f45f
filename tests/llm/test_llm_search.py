"""Ranked search, centroid clustering and language labels."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from accountscope.llm import centroids, language, search

# ---------------------------------------------------------------- ranked search


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranking(docs, items, top=10):
    held = [(i, plain_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in held if t), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        own = set(plain_terms(text))
        df = {t: sum(1 for _, ts in held if t in ts) for t in own}
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in own}
        scores = []
        for i, ts in held:
            if ts:
                m = 100 - 90 + 90 * len(ts) * n_docs // n_terms
                s = sum(w[t] * (1000000000 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in own)
                if s > 0:
                    scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("cfg", [search.SearchConfig(), search.SearchConfig(block_bytes=90, mined=2, cells=40), search.SearchConfig(top=3, mined=1)])
def test_search_equals_plain_ranking(spark, cfg):
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "élan", "漢字", "x1", "co-op", "a_b", "ÉLAN"] + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(90)]
    docs += [(200 + i, docs[3][1]) for i in range(20)] + [(None, docs[3][1]), (None, None), (7, ""), (300, "... !?")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(50, items[0][1]), (51, None), (52, ""), (53, "nowhere at all")]
    found = search.rank(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
                        spark.createDataFrame(items, "item_id bigint, text string"), cfg)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_ranking(docs, items, cfg.top), key=str)


def test_search_sums_beyond_doubles(spark, monkeypatch):
    docs, items = [(1, "a b c"), (2, "a b"), (3, "c c")], [(1, "a b c"), (2, "a b")]
    want = plain_ranking(docs, items)
    monkeypatch.setattr(search, "EXACT", 0)
    found = search.rank(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("mined", [0, 3, 100])
def test_every_item_is_the_sum_of_its_nodes(mined):
    rng = random.Random(mined)
    items = [set(rng.sample(range(25), rng.randint(0, 12))) for _ in range(30)]
    graph = search.share(items, 25, mined)
    parts = [set(np.flatnonzero(graph.leaf_of == k)) for k in range(graph.leaves)]
    for a, b in graph.pairs:
        assert not parts[a] & parts[b]
        parts.append(parts[a] | parts[b])
    for own, cover in zip(items, graph.cover):
        assert sum(len(parts[c]) for c in cover) == len(own) and set().union(*(parts[c] for c in cover)) == own
    direct = sum(len({tuple(i for i, o in enumerate(items) if t in o) for t in own}) for own in items)
    shared = sum(map(len, graph.cover)) + len(graph.pairs)
    assert shared < direct if mined else shared <= direct


def test_search_of_awkward_tables(messy, nothing, spark):
    items = spark.createDataFrame([(1, "one plain document 漢字"), (None, "text")], "item_id bigint, text string").select("*", F.lit(1).alias("id"))
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    found = sorted(map(tuple, search.rank(messy, items).collect()), key=str)
    assert found == sorted(plain_ranking(rows, [(1, "one plain document 漢字"), (None, "text")]), key=str)
    assert search.rank(nothing, items).count() == 0 and search.rank(messy, items.where("false")).count() == 0


def test_search_over_all_documents(docs, spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    some = [(r["item_id"], r["text"]) for r in items.collect()][:6]
    found = [tuple(r) for r in search.rank(docs, items).collect() if r["item_id"] in {i for i, _ in some}]
    assert sorted(found) == plain_ranking(rows, some)


# ---------------------------------------------------------------- centroid clustering


def plain_kmeans(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [q for _, q in order[:k]]

    def place():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres)) for _, q in kept]

    for _ in range(rounds):
        own = place()
        for j in range(len(centres)):
            mine = [q for (_, q), (_, o) in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = place()
    total = sum(d for d, _ in own)
    return [(i, j, d, sum(e for e, o in own if o == j), total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest())
            for (i, _), (d, j) in zip(kept, own)]


def vectors(n=150):
    rng = random.Random(11)
    middles = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, list(rows[0][1])) for i in range(40)]  # a large group of equal vectors
    rows += [(5, list(rows[1][1])), (5, list(rows[2][1])), (None, list(rows[3][1])), (2000, [0.0] * 64), (2001, [0.0] * 64)]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [1.0] * 63 + [None]), (3004, [1.0] * 63 + [float("nan")]),
             (3005, [float("inf")] + [1.0] * 63)]
    return rows


@pytest.mark.parametrize("lead", [1, 8, 64])
def test_clusters_equal_plain_integers(spark, lead):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", F.lit(1).alias("id"), F.lit(2).alias("q")).repartition(4)
    found, _ = centroids.cluster(df, centroids.CentroidConfig(lead=lead))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_kmeans(rows), key=str)


def test_the_filter_saves_exact_distances_and_loses_none():
    rng = np.random.default_rng(3)
    c = rng.integers(-2000, 2000, (8, 64))
    q = c[rng.integers(0, 8, 4000)] + rng.integers(-300, 300, (4000, 64))
    x = np.hstack([np.ones((len(q), 1)), q])
    mean = q.mean(axis=0)
    _, basis = np.linalg.eigh(x[:, 1:].T @ x[:, 1:] / len(q) - np.outer(mean, mean))
    turn = centroids.Rotation(mean, np.ascontiguousarray(basis[:, ::-1][:, :8]))
    own, best, exact = centroids.nearest(q, *turn(q), c, turn)
    d = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (own == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert exact < 2 * len(q)


def test_few_no_and_huge_vectors(spark):
    rows = vectors()[:3]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, centroids.cluster(df)[0].collect())) == sorted(plain_kmeans(rows))
    assert centroids.cluster(df.where("false"))[0].count() == 0
    same = spark.createDataFrame([(i, [1.5] * 64) for i in range(30)], "vec_id bigint, embedding array<float>")
    assert {(r["cluster"], r["distance"]) for r in centroids.cluster(same)[0].collect()} == {(0, 0)}
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)))


# ---------------------------------------------------------------- language labels


def plain_chain(scores, transitions):
    """Probabilities and expected transitions of one chain, in logarithms, word by word."""
    n, k = scores.shape

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    f, b, pairs = scores.copy(), np.zeros((n, k)), np.zeros((k, k))
    for t in range(1, n):
        f[t] = lse(f[t - 1][:, None] + transitions, 0) + scores[t]
    for t in range(n - 2, -1, -1):
        b[t] = lse(transitions + scores[t + 1] + b[t + 1], 1)
    for t in range(1, n):
        x = f[t - 1][:, None] + transitions + scores[t] + b[t]
        pairs += np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    p = np.exp(f + b - (f + b).max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), pairs


@pytest.mark.parametrize("block", [1, 2, 7, 64, 500])
def test_forward_backward_equals_a_plain_chain(block):
    rng = np.random.default_rng(block)
    lengths = np.array([1, 5, 130, 64, 65, 2, 200])
    scores, transitions = 3 * rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    p, pairs = language.forward_backward(scores, lengths, transitions, block)
    each = [plain_chain(x, transitions) for x in np.split(scores, np.cumsum(lengths)[:-1])]
    assert np.allclose(p, np.concatenate([x for x, _ in each]), atol=1e-10) and np.allclose(pairs, sum(y for _, y in each))


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    ws = ["a", "ab", "straße", "漢字", "abcdef", "x" * 300]
    bucket, word = language.form_features(ws, 1 << 15)
    for i, w in enumerate(ws):
        alone, _ = language.form_features([w], 1 << 15)
        assert sorted(alone) == sorted(bucket[word == i])
        n = len(w)
        assert len(alone) == (n + 2) + (n + 1) + n + 2 * sum(n >= k for k in (2, 3, 4))


@pytest.fixture(scope="module")
def model(docs):
    known = docs.where(~language.held_out(F.col("doc_id"))).select("text", F.col("lang").alias("label"))
    cfg = language.LanguageConfig()
    return language.learn(language.labelled_sample(known, cfg, "text", "label"), cfg)


def test_switches_inside_a_text_are_found(spark, model, docs):
    rows = docs.where(language.held_out(F.col("doc_id")) & (F.col("n_chars") > 900)).orderBy("doc_id").collect()
    of = {y: language.words(next(r["text"] for r in rows if r["lang"] == y))[:40] for y in ("en", "de")}
    text = " ".join(of["en"] + of["de"])
    found = language.label(spark.createDataFrame([(1, text)], "id int, text string"), model).first()["language"]
    truth = ["en"] * 40 + ["de"] * 40
    got = [s["label"] for s in found["spans"] for _ in range(s["end"] - s["start"])]
    assert len(got) == 80 and sum(a == b for a, b in zip(got, truth)) >= 74
    assert (np.diag(model.transitions) > model.transitions.max(axis=1) - 1e-9).all()


def test_held_out_documents(docs):
    found = {(r["doc_id"]): r for r in language.predict(docs).collect()}
    truth = {r["doc_id"]: r for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [(r["lang_pred"], truth[i]["lang"]) for i, r in found.items() if r["held_out"] and truth[i]["lang"]]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_learning_leaves_held_out_labels_alone(docs):
    wrong = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(d).collect()) for d in (docs, wrong))
    assert a == b


def test_awkward_texts(messy, nothing, spark):
    found = language.predict(messy)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"und"} and all(r["held_out"] is not None for r in rows)
    assert language.predict(nothing).count() == 0
    unlabelled = language.predict(messy.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    digits = spark.createDataFrame([(1, "12 ² _ 3.5 !", "en"), (2, "ein Wort", "de"), (4, "a word", "en")], "doc_id bigint, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(digits).collect()}[1] == "und"


def test_equal_texts_count_once_in_the_sample(spark):
    rows = [("en", "the same text again") for _ in range(400)] + [("de", f"ein wort und nummer {chr(97 + i % 26) * (1 + i // 26)}") for i in range(300)]
    got = language.labelled_sample(spark.createDataFrame(rows, "label string, text string"), language.LanguageConfig(per_label=50), "text", "label").collect()
    assert sum(r["label"] == "en" for r in got) <= 1 and sum(r["label"] == "de" for r in got) == 50
