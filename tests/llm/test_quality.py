import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import quality as q


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(60)) + "."
    bad = lambda: rng.choice([" ".join([word()] * 50), " ".join(w + "***" for w in good().split()), good().upper() + "!!"])
    labels = [rng.random() < 0.7 for _ in range(n)]
    return [good() if y else bad() for y in labels], [int(y) for y in labels]


def test_tables_learn_single_features_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.AdditiveModel(pairs=2).fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.93
    y = (x[:, 2] > 0.3).astype(float)
    assert ((q.AdditiveModel().fit(x, y).score(x) > 0.5) == y).mean() > 0.97


def test_held_out_accuracy(spark, make_docs):
    texts, labels = corpus()
    docs = make_docs(texts)
    labelled = spark.createDataFrame(list(enumerate(labels)), "doc_id BIGINT, quality INT")
    model = q.train(docs, labelled.where(~q.held_out(labelled["doc_id"], 5, 0)))
    rows = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    held = {r.doc_id for r in labelled.where(q.held_out(labelled["doc_id"], 5, 0)).collect()}
    assert len(held) > 30 and np.mean([(rows[i] >= 0.5) == labels[i] for i in held]) > 0.95
    assert q.keep_good(docs, model).count() == sum(s >= q.THRESHOLD for s in rows.values())


def test_other_columns_are_no_inputs(spark, make_docs):
    texts, labels = corpus(120)
    labelled = spark.createDataFrame(list(enumerate(labels)), "doc_id BIGINT, quality INT")
    model = q.train(make_docs(texts), labelled)
    one = sorted(r.score for r in q.score(make_docs([(900 + i, t) for i, t in enumerate(texts)], ["de"] * 120), model).collect())
    assert one == sorted(r.score for r in q.score(make_docs(texts), model).collect())


def test_without_labels_and_odd_rows(spark, odd_docs, make_docs):
    for rows in ([], [(4, None), (None, 1), (99, 1)], [(4, 1), (5, 1)]):
        model = q.train(odd_docs, spark.createDataFrame(rows, "doc_id BIGINT, quality INT"))
        found = q.score(odd_docs, model).collect()
        assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    assert q.score(make_docs([]), model).count() == 0
    assert q.keep_good(odd_docs, model).columns == odd_docs.columns


def test_labels_are_bounded(spark, make_docs):
    texts, labels = corpus(50)
    labelled = spark.createDataFrame(list(enumerate(labels)), "doc_id BIGINT, quality INT")
    assert q.train(make_docs(texts), labelled, max_labels=10).start is not None


def test_documents_and_labels_under_one_id(spark, make_docs):
    """One document of an id teaches, however many there are; labels count as often as they stand."""
    texts, labels = corpus(60)
    once = make_docs(texts)
    again = make_docs([(i, t) for i, t in enumerate(texts)] + [(3, "other text ***")] * 50 + [(3, texts[3])] * 50)
    labelled = spark.createDataFrame([*enumerate(labels), (5, labels[5]), (5, 1 - labels[5])], "doc_id BIGINT, quality INT")
    model = q.train(again, labelled)
    smallest = min(q.features(t.encode()) for t in (texts[3], "other text ***"))
    plain = q.train(once, labelled) if smallest == q.features(texts[3].encode()) else q.train(make_docs([*texts[:3], "other text ***", *texts[4:]]), labelled)
    assert all((a == b).all() for a, b in zip(model.tables, plain.tables, strict=True))


def leaf(g, h):
    return sum(g) / (sum(h) + 1.0)


def gain(g, h):
    return sum(g) ** 2 / (sum(h) + 1.0)


def slow_tree(column, g, h, edges):
    """A tree of at most three leaves on one feature, grown leaf by leaf over all cuts: [(low, high, value)]."""
    leaves = [(-math.inf, math.inf)]
    inside = lambda a, b: [i for i, x in enumerate(column) if a <= x < b]
    of = lambda rows: (sum(g[i] for i in rows) ** 2) / (sum(h[i] for i in rows) + 1.0)
    for _ in range(2):
        best = (1e-9, None, None)
        for a, b in sorted(leaves):
            for cut in edges:
                if a < cut < b:
                    left, right = inside(a, cut), inside(cut, b)
                    better = of(left) + of(right) - of(left + right)
                    if better > best[0] + 1e-12:
                        best = (better, (a, b), cut)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    return [(a, b, sum(g[i] for i in inside(a, b)) / (sum(h[i] for i in inside(a, b)) + 1.0)) for a, b in leaves]


def test_tables_are_sums_of_trees():
    """Cyclic boosting of plain trees, row by row, gives the scores of the lookup tables."""
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(60, 3)).round(3)
    y = (x[:, 0] + 0.3 * x[:, 1] + 0.1 * rng.normal(size=60) > 0.7).astype(float)
    model = q.AdditiveModel(bins=6, rounds=5, pair_rounds=0).fit(x, y)
    start = math.log((y.sum() + 0.5) / (60 + 1) / (1 - (y.sum() + 0.5) / (60 + 1)))
    scores = [start] * 60
    for _ in range(5):
        for f in range(3):
            edges = sorted(set(np.quantile(x[:, f], np.arange(1, 6) / 6)))
            p = [1 / (1 + math.exp(-s)) for s in scores]
            tree = slow_tree(x[:, f].tolist(), [b - a for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], edges)
            scores = [s + 0.1 * next(v for a, b, v in tree if a <= x[i, f] < b) for i, s in enumerate(scores)]
    want = [1 / (1 + math.exp(-s)) for s in scores]
    assert np.abs(model.score(x) - want).max() < 1e-9


def test_pair_tables_are_sums_of_trees():
    """With pairs: each step is the best tree with one cut on each feature, found by trying all."""
    rng = np.random.default_rng(7)
    x = rng.uniform(size=(80, 2)).round(3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    model = q.AdditiveModel(rounds=0, pair_bins=4, pair_rounds=6, pairs=1).fit(x, y)
    start = math.log((y.sum() + 0.5) / 81 / (1 - (y.sum() + 0.5) / 81))
    scores = np.full(80, start)
    edges = [sorted(set(np.quantile(x[:, f], np.arange(1, 4) / 4))) for f in (0, 1)]
    for _ in range(6):
        p = 1 / (1 + np.exp(-scores))
        g, h = y - p, p * (1 - p)
        best = None
        for c in edges[0]:
            for d in edges[1]:
                parts = [(x[:, 0] < c) & (x[:, 1] < d), (x[:, 0] < c) & (x[:, 1] >= d), (x[:, 0] >= c) & (x[:, 1] < d), (x[:, 0] >= c) & (x[:, 1] >= d)]
                total = sum(gain(g[m], h[m]) for m in parts)
                if best is None or total > best[0] + 1e-12:
                    best = (total, parts)
        for m in best[1]:
            scores[m] += 0.1 * leaf(g[m], h[m])
    assert model.pairs == [(0, 1)] and np.abs(model.score(x) - 1 / (1 + np.exp(-scores))).max() < 1e-9


def test_query_scores_by_the_model(spark, tmp_path, make_docs):
    """op2 against features and tables looked up one row at a time."""
    texts, labels = corpus(150)
    texts += ["", None, "x" * 1_000_000, "word " * 100_000]
    make_docs(texts).withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in enumerate(labels)] + [(1, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in q.op2_quality(spark, str(tmp_path)).collect()}
    taught = [i for i in range(150) if zlib.crc32(str(i).encode()) % 5]
    model = q.AdditiveModel().fit(np.array([q.features(texts[i].encode()) for i in taught]), np.array([labels[i] for i in taught], float))
    for i, t in enumerate(texts):
        f = q.features((t or "").encode())
        total = model.start + sum(model.tables[k][sum(e <= f[k] for e in model.edges[k])] for k in range(len(f)))
        total += sum(m[sum(e <= f[a] for e in model.coarse[a]), sum(e <= f[b] for e in model.coarse[b])] for (a, b), m in zip(model.pairs, model.pair_tables, strict=True))
        assert abs(rows[i].score - 1 / (1 + math.exp(-total))) < 1e-9
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and rows[i].predicted == int(rows[i].score >= 0.3)
