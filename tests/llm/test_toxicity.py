import random

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import toxicity as X

from .conftest import CLASHING, documents


def corpus(n, seed=1):
    random.seed(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{random.randrange(400)}" for _ in range(random.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(random.randint(1, 3)):
                words.insert(random.randrange(len(words)), random.choice(["vile", "rotten", f"nasty{random.randrange(99)}"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_index_finds_what_a_full_scan_finds():
    rng = np.random.default_rng(1)
    model = X.Model([f"t{i}" for i in range(50)], np.ones(50), 500, 0.2)
    dense = rng.random((500, 50)) * (rng.random((500, 50)) < 0.1)
    dense = dense[dense.any(axis=1)]
    dense[:40] = dense[0]  # equal vectors are one entry
    dense[60:80, :] = 0
    dense[60:80, :2] = np.random.default_rng(2).permutation(20)[:, None] % 4 + [[1, 2]]  # and near ones tie
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    vectors = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense]
    model.build([f"{i:03}" for i in range(len(dense))], [i % 2 for i in range(len(dense))], vectors)
    assert model.counts.sum() == len(dense) and model.counts.max() == 40 and len(model.keys) < len(dense) - 38
    dense = np.array([dense[int(k)] for k in model.keys])
    for row in [*(rng.random((60, 50)) * (rng.random((60, 50)) < 0.15)), *np.eye(50)[:5], np.ones(50)]:
        if not row.any():
            continue
        row /= np.linalg.norm(row)
        near = model.neighbours(np.flatnonzero(row), row[np.flatnonzero(row)])
        full = dense @ row
        best = sorted(full[full > 0], reverse=True)[: X.K]
        assert np.allclose([s for s, _ in near], best, atol=1e-12)
        assert np.allclose([full[p] for _, p in near], best, atol=1e-12)
        without = near[0][1]
        assert without not in [p for _, p in model.neighbours(np.flatnonzero(row), row[np.flatnonzero(row)], without=without)]


def test_isotonic_fit_pools_violators():
    model = X.Model([], np.zeros(0), 4, 0.5)
    model.calibrate(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert model.probabilities.tolist() == [0.0, 0.5, 1.0]


def test_held_out_accuracy(spark, scratch):
    rows, labels = corpus(900)
    docs = documents(spark, rows, CLASHING)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = X.learn(docs, table, ~X.held_out(F.col("doc_id")), scratch)
    scored = X.score_documents(docs, model).select("doc_id", X.held_out(F.col("doc_id")).alias("out"), "_scored.*").collect()
    truth = dict(labels)
    wrong = [r.doc_id for r in scored if r.out and (r.score >= 0.5) != bool(truth[r.doc_id])]
    held = [r for r in scored if r.out]
    assert len(held) > 100 and len(wrong) <= 0.02 * len(held)
    assert all(0 <= r.score <= 1 for r in scored)
    assert all(r.evidence for r in scored if r.score >= 0.5)


def test_held_out_labels_change_nothing(spark, scratch):
    rows, labels = corpus(300)
    docs = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = table.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (X.learn(docs, t, ~X.held_out(F.col("doc_id")), scratch) for t in (table, flipped))
    assert a.ids == b.ids and a.keys == b.keys and (a.probabilities == b.probabilities).all()


def test_odd_rows_and_labels(spark, scratch, odd_rows, empty):
    rows, labels = corpus(200)
    labels += [(None, 1), (1, None), (7, 1), (7, 0), (10_000, 1)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash")).withColumn("score", F.lit(1))
    docs = documents(spark, [*odd_rows, *((i + 10, t) for i, t in rows)], CLASHING)
    model = X.learn(docs, table, ~X.held_out(F.col("doc_id")), scratch)
    scored = X.score_documents(docs, model)
    assert scored.count() == len(odd_rows) + len(rows)
    assert scored.where("_scored.score IS NULL OR _scored.score < 0 OR _scored.score > 1").count() == 0
    assert X.score_documents(empty, model).count() == 0
    for nothing in (table.limit(0), table.where("toxic = 0")):
        model = X.learn(docs, nothing, F.lit(True), scratch)
        assert X.score_documents(docs, model).where("_scored.score <> 0").count() == 0
    assert X.learn(empty, table, F.lit(True), scratch).vote([]) == 0
