"""The classifier chain: held-out accuracy, edge cases, and the parts against plain versions."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tonelake.llm import linear, queries, toxicity

SCHEMA = "capture_id long, message_utf8 string, p_toxic string, features string"


def build(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_unseen_documents(spark):
    """Labels of a third of the rows are hidden from the fit."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (queries.table(spark, folder, t) for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    scored = queries.toxic_scores(docs, labels.where(~held)).withColumnRenamed("capture_id", "doc_id")
    pdf = scored.join(labels.where(held), "doc_id").toPandas()
    caught = pdf["p_toxic"] >= 0.5
    assert caught[pdf["toxic"] == 1].mean() > 0.85  # some toxic labels are on plain texts
    assert caught[pdf["toxic"] == 0].mean() < 0.005


def test_edge_cases(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices("calm river stone light path".split(), k=20)) + (" nastyword" if k % 4 == 0 else "")) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 0) for k in range(150)] + [(7, None, None), (None, 1, 1), (9999, 1, 0)],
                                   "capture_id long, bad int, worse int")
    extra = [(300, None), (301, ""), (302, "x" * 300_000 + " nastywords"), (3, rows[3][1]), (None, "calm nastyword")]
    got = toxicity.score_toxicity(build(spark, rows + extra), labels, ["bad", "worse"]).collect()
    assert len(got) == len(rows) + len(extra)
    score = {r["capture_id"]: r["p_bad"] for r in got}
    assert all((score[k] > 0.5) == (k % 4 == 0) for k in range(200))
    assert score[300] == score[301] < 0.5 and score[302] > 0.5 and score[None] > 0.5
    assert all(0 <= r["p_worse"] < 0.1 for r in got)


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "capture_id long, bad int")
    got = toxicity.score_toxicity(build(spark, [(1, "a text")]), none, ["bad"]).collect()
    assert [r["p_bad"] for r in got] == [0.5]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "capture_id long, bad int")
    assert toxicity.score_toxicity(build(spark, []), labels, ["bad"]).collect() == []


def test_later_models_read_earlier_probabilities():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, 600)
    rows = linear.Sparse.of([np.array([1 + b, 10 + k % 3]) for k, b in enumerate(base)])
    second = np.where(rng.random(600) < 0.05, 1 - base, base)
    chain = toxicity.fit_chain(rows, np.stack([base, second], axis=1).astype(float), np.arange(600) % 3)
    assert chain[0].dense.shape == (0,) and chain[1].dense.shape == (1,) and chain[1].dense[0] > 0
    scores = toxicity.score_chain(chain, rows)
    assert ((scores[:, 1] > 0.5) == (base == 1)).all()


def test_logistic_against_a_plain_gradient():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 2, (300, 6))
    label = (table[:, 0] | table[:, 3]).astype(float)
    rows = linear.Sparse.of([np.flatnonzero(r) for r in table])
    model = linear.fit(rows, np.zeros((300, 0)), label, np.arange(6), penalty=1e-3, steps=3000)
    w, b = np.zeros(6), 0.0
    for _ in range(60_000):
        off = 1 / (1 + np.exp(-(table @ w + b))) - label
        w -= 0.5 * (table.T @ off / 300 + 1e-3 * w)
        b -= 0.5 * off.mean()
    assert np.allclose(model.weights, w, atol=0.05) and abs(model.bias - b) < 0.05


def test_telling_features_and_selection():
    rows = linear.Sparse.of([np.array([7, 9] if k % 2 else [9, 11]) for k in range(100)])
    label = (np.arange(100) % 2).astype(float)
    assert linear.telling_features(rows, label, 10).tolist() == [7, 11]
    assert linear.telling_features(rows, label, 1).tolist() == [7]
    assert linear.telling_features(rows, np.ones(100), 10).tolist() == []
    assert rows.restricted(np.array([9])).features.tolist() == [0] * 100
