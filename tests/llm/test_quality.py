import math

import numpy as np
from pyspark.sql import functions as F

from lumentrack.llm import quality


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    most = max(sum(labels[r.doc_id] for r in out), sum(1 - labels[r.doc_id] for r in out))  # what naming one class always gets
    assert sum(r.predicted == labels[r.doc_id] for r in out) > max(most + 0.05 * len(out), 0.97 * len(out))
    good, bad = ([r.score for r in out if labels[r.doc_id] == q] for q in (1, 0))
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_held_out_of_few_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.85 * len(out)


def test_fit_equals_scalar_loop():
    """The risk and its steps against plain loops: derivatives by differences of the risk as it is written."""
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (12, 2)), np.concatenate([rng.normal(1, 1, (8, 2)), rng.normal(-1, 1, (6, 2))])
    both, prior, decay, rate = np.concatenate([p, u]), 0.6, 3.0, 0.05
    mean, scale = both.mean(0), both.std(0) + 1e-2
    ps, us = ((p - mean) / scale).tolist(), ((u - mean) / scale).tolist()
    loss = lambda x, w, y: math.log(1 + math.exp(-y * (sum(a * b for a, b in zip(x, w)) + w[2])))
    mean_loss = lambda rows, w, y: sum(loss(x, w, y) for x in rows) / len(rows)

    def risk(w):
        positive, negative = prior * mean_loss(ps, w, 1), mean_loss(us, w, -1) - prior * mean_loss(ps, w, -1)
        return (positive + negative if negative >= 0 else -negative) + decay / len(ps) * sum(x * x for x in w[:2]) / 2

    w, m, v = [0.0] * 3, [0.0] * 3, [0.0] * 3
    for t in range(1, 61):
        g = [(risk([x + 1e-5 * (i == k) for i, x in enumerate(w)]) - risk([x - 1e-5 * (i == k) for i, x in enumerate(w)])) / 2e-5 for k in range(3)]
        for k in range(3):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            w[k] -= rate * m[k] / (1 - 0.9**t) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    model = quality.fit_pu(p, u, prior, rounds=60, rate=rate, decay=decay)
    assert np.allclose([*model.weights, model.bias], w, atol=1e-3)


def test_long_rows_are_learned_from(spark):
    docs = spark.createDataFrame([(4 * k + 1, "plain words of a text " * 20000) for k in range(12)], "doc_id long, text string")
    assert len(quality._sampled(docs, 100, 12)) == 12


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a", "x"), (4, "long text " * 30000, "x"), (4, "long text " * 30000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels.limit(0)).count() == 0


def test_risk_finds_the_prior():
    rng = np.random.default_rng(3)
    p, n = rng.normal(1.5, 1, (2000, 4)), rng.normal(-1.5, 1, (600, 4))
    model = quality.fit_pu(p[:1000], np.concatenate([p[1000:], n]))
    assert 0.55 < model.prior < 0.75
    assert (model.score(p) > 0.5).mean() > 0.95 and (model.score(n) < 0.5).mean() > 0.9


def test_labels_of_all_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    every = docs.select("doc_id").distinct().join(labels.select("doc_id", "quality"), "doc_id", "left")
    rows = quality.quality_scores(docs, every.fillna(0)).collect()
    assert {r.predicted for r in rows} == {0, 1}
    kept = quality.keep_good(docs, every.fillna(0)).count()
    assert 0 < kept < docs.count()
