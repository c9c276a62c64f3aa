"""Hard negatives against all pairs, in Python and in SQL."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import hard_negatives as hn
from tonelake.operators.models import FEATURES

NAMES = [f"f{k}" for k in range(6)]
SCHEMA = "capture_id long, label string, slab string, vector string, " + ", ".join(f"{n} double" for n in NAMES)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(r[0], r[1], "clash", None, *map(float, r[2])) for r in rows], SCHEMA)
    found = hn.mine_hard_negatives(table, F.col("capture_id") % 10 == 0, NAMES, **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def brute(rows, scale=256, low=80):
    items = [(i, label, [int(np.floor(scale * c)) for c in v]) for i, label, v in rows]
    found = []
    for n, (a, label, x) in enumerate(items):
        if a % 10:
            continue
        others = [(-sum(p * q for p, q in zip(x, y)), b, other == label) for m, (b, other, y) in enumerate(items) if m != n]
        for score, positive, _ in sorted(o for o in others if o[2])[:5]:
            near = sorted(o for o in others if not o[2] and low * -score <= 100 * -o[0] <= 100 * -score)[:5]
            found += [(a, positive, k + 1, b, -score, -s) for k, (s, b, _) in enumerate(near)]
    return sorted(found)


@pytest.fixture(params=["default", "small slabs"])
def sizes(request, monkeypatch):
    if request.param != "default":
        monkeypatch.setattr(hn, "SLAB", 40)
        monkeypatch.setattr(hn, "BUCKET", 16)
        monkeypatch.setattr(hn, "ANCHORS", 7)


def test_vectors_of_very_different_lengths(spark, sizes):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * np.exp(rng.normal(size=(400, 1)) * 1.5)
    rows = [(k, "abc"[k % 3], v) for k, v in enumerate(x)]
    assert mined(spark, rows) == brute(rows)


def test_clustered_vectors(spark, sizes):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6)) * 5
    rows = [(k, f"m{rng.integers(4)}", centres[k % 4] + rng.normal(size=6) * 0.3) for k in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_ties_and_copies(spark, sizes):
    rng = np.random.default_rng(3)
    same = rng.normal(size=6)
    rows = [(k, "xy"[k % 2], same if k % 3 else rng.normal(size=6)) for k in range(200)]
    rows += [(10, "x", same), (10, "x", same), (20, "y", same)]
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "xy"[k % 2], rng.normal(size=6)) for k in range(60)]
    bad = [(None, "x", np.ones(6)), (70, None, np.ones(6)), (80, "x", [1, np.nan, 1, 1, 1, 1]), (90, "y", [1, np.inf, 1, 1, 1, 1]), (100, "y", [1e9] * 6)]
    assert mined(spark, rows + bad) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(3, "x", np.ones(6))] * 3) == []


def test_few_rows_zero_vectors_and_long_ones(spark):
    rows = [(0, "x", np.zeros(6)), (1, "x", np.ones(6)), (2, "y", np.zeros(6)), (3, "y", -np.ones(6)), (10, "x", [60000.0] * 6), (4, "y", [60000.0] * 6)]
    assert mined(spark, rows) == brute(rows)


def test_pruning_leaves_out_only_what_cannot_qualify():
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(1000, 16)) * 4000 + rng.integers(0, 2, (1000, 16)) * 9000).astype(np.int64)
    ids = np.arange(1000)
    (bucket,) = hn.buckets_of(ids, ids, ids, vectors[:1000])
    anchors = vectors[:50] / np.linalg.norm(vectors[:50], axis=1)[:, None]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    focus = np.argsort(-np.abs(anchors), axis=1)[:, :4]
    least = np.full(50, 0.97)
    whole, chosen = hn.candidates(bucket, anchors, focus, least)
    assert not whole.all()
    total = 0
    for a, rows in chosen:
        near = set(np.flatnonzero(unit @ anchors[a] >= 0.97).tolist())
        assert near <= set(bucket.ids[rows].tolist())
        total += len(rows)
    assert total < 0.4 * 1000 * len(chosen)


def test_features_of_captures_are_the_default(spark):
    rng = np.random.default_rng(6)
    schema = "capture_id long, label string, " + ", ".join(f"{n} double" for n in FEATURES)
    x = rng.normal(size=(80, len(FEATURES)))
    rows = [(k, "ab"[k % 2], v) for k, v in enumerate(x)]
    table = spark.createDataFrame([(k, label, *map(float, v)) for k, label, v in rows], schema)
    found = hn.mine_hard_negatives(table, F.col("capture_id") % 10 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.select(*names).collect()) == brute(rows)


def test_query_equals_its_sql(check_sql):
    check_sql("op12_hard_negatives")
