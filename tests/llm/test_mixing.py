"""The mix against its targets, its bounds and SQL."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tonelake.llm import mixing, queries

SCHEMA = "capture_id long, modulation string, message_utf8 string, size string, target string, block string"


def captures(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def brute_targets(sizes, weights, cap):
    """Share by weight, stop at the cap, share what is above again."""
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    fixed = {}
    while True:
        free = [n for n in names if n not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if share[n] > cap * sizes[n]]
        if not over:
            return {**fixed, **share}
        fixed.update({n: cap * sizes[n] for n in over})


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        modulation = rng.choice(["BPSK"] * 6 + ["QPSK", "16-QAM", "é", None])
        rows.append((k, modulation, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 200)))))
    rows += [(5000, "rare", "only five words in here"), (5001, "void", None), (5002, "void", " \n"), (None, "QPSK", "no id " * 50)]
    rows += [(1, "twice", "same row " * 90)] * 2 + [(2, "big", "long text " * 100_000)]
    return captures(spark, rows)


def test_targets_bounds_and_reruns(table):
    got = mixing.plan_mix(table).taken().toPandas()
    again = mixing.plan_mix(table.repartition(5)).taken().toPandas()
    key = ["modulation", "capture_id"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    assert len(got) == len(table.select("capture_id", "modulation").distinct().collect())
    assert (got["taken"] <= 3 * got["size"]).all()
    sums = got.groupby("modulation", dropna=False).agg(
        size=("size", "sum"), source=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")
    )
    want = brute_targets({(None if n != n else n): int(s) for n, s in sums["size"].items()}, (1, 2, 3), 3)
    for name, row in sums.iterrows():
        assert row["size"] == row["source"]
        assert row["target"] == pytest.approx(want[None if name != name else name])
        assert abs(row["taken"] - row["target"]) <= 64 + 0.01 * row["target"]


def test_spans_are_blocks_of_the_stream(table):
    mix = mixing.plan_mix(table, block_words=10, seed=3)
    spans = mix.spans()
    slots = spans.groupBy("modulation", "slot").agg(
        F.sum("n_words").alias("n"), F.countDistinct("block").alias("blocks"), F.countDistinct("shard").alias("shards")
    )
    assert slots.where("blocks <> 1 OR shards <> 1 OR n > 10").count() == 0
    repeated = spans.groupBy("modulation", "turn", "capture_id", "from_word").count().where("count > 1")
    assert repeated.count() == 0  # within one pass no block is read twice
    sizes = mix.captures.select(F.col("capture_id").alias("c"), F.col("modulation").alias("m"), "size")
    outside = spans.join(sizes, F.col("c").eqNullSafe(F.col("capture_id")) & F.col("m").eqNullSafe(F.col("modulation")))
    assert outside.where("from_word < 0 OR from_word + n_words > size").count() == 0


def test_slots_are_not_broadcast(table):
    """There are as many slots as blocks, so they never go through the driver as one table."""
    plan = mixing.plan_mix(table).spans()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_permutations_reach_every_block(spark, table):
    for size in (1, 2, 63, 64, 997, 8388593):
        at = {(8388587 * i + 5) % size for i in range(size)} if size < 10**4 else None
        assert at is None or at == set(range(size))
    full = mixing.plan_mix(captures(spark, [(k, "one", "a b c " * 40) for k in range(30)]), block_words=7)
    assert full.taken().where("taken <> size").count() == 0  # a single modulation is taken exactly once


def test_shard_counts_follow_the_weights(table):
    mixing_draws = mixing.plan_mix(table, block_words=4).draws
    assert mixing_draws.select("shard").distinct().count() >= 1
    counts = mixing_draws.groupBy("source_no", "turn", "block").count()
    assert counts.where("count > 1").count() == 0


def test_empty_table(spark):
    mix = mixing.plan_mix(captures(spark, []))
    assert mix.taken().collect() == [] and mix.spans().collect() == []


def test_query_against_sql(check_sql):
    check_sql("op7_mixing")


def test_query_has_every_document(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").select("doc_id")
    assert queries.op7_mixing(spark, sf_dir).select("doc_id").exceptAll(docs).count() == 0
