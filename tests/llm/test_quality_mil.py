"""The attention network: gradients by differences, held-out accuracy, edge cases."""

from __future__ import annotations

import numpy as np

from tonelake.llm import queries
from tonelake.llm import quality_mil as mil

SCHEMA = "capture_id long, message_utf8 string, score string, passages string"


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    passages = rng.normal(size=(9, mil.MEASURES))
    starts, label, weight = np.array([0, 2, 3, 7]), np.array([1.0, 0, 0, 1]), np.array([1.0, 2, 1, 0.5])

    def loss(net):
        p = net.forward(passages, starts)["score"]
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()

    net = mil.Network.fresh(7)
    for name, slope in net.gradient(passages, starts, label, weight).items():
        for place in list(np.ndindex(slope.shape))[:: max(1, slope.size // 5)]:
            moved = []
            for step in (1e-5, -1e-5):
                other = mil.Network({k: v.copy() for k, v in net.w.items()})
                other.w[name][place] += step
                moved.append(loss(other))
            assert abs((moved[0] - moved[1]) / 2e-5 - slope[place]) < 1e-6


def test_attention_sums_to_one():
    rng = np.random.default_rng(1)
    out = mil.Network.fresh().forward(rng.normal(size=(6, mil.MEASURES)), np.array([0, 1, 4]))
    assert np.allclose(np.add.reduceat(out["a"], [0, 1, 4]), 1)


def test_passages():
    rows = mil.encode_passages("A b! 12 | " * 40)
    assert rows.shape == (3, mil.MEASURES)
    assert mil.encode_passages(None).tolist() == mil.encode_passages(" \n").tolist() == [[0.0] * mil.MEASURES]
    assert len(mil.encode_passages("w " * 100_000)) == -(-100_000 // 64)


def test_most_frequent_word_of_every_passage():
    for others in (0, 6, 7, 40):
        part = ["again"] * (64 - others) + [f"w{k}" for k in range(others)]
        row = mil.encode_passages(" ".join(part))[0]
        assert np.isclose(row[-2], (64 - others) / 64)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    out = queries.op9_quality_mil(spark, folder).join(queries.table(spark, folder, "labels"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(held) > 500 and out["score"].between(0, 1).all()
    assert (held["predicted"] == held["quality"])[held["quality"] == 1].mean() > 0.98
    assert (held["predicted"] == held["quality"])[held["quality"] == 0].mean() > 0.85


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "w " * 5000), (4, "🙂" * 9000)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, None), (None, 1), (77, 0)], "capture_id long, quality int")
    got = mil.score_quality(table, labels).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        assert 0 <= r["score"] <= 1
        assert by_id.setdefault(r["capture_id"], r["score"]) == r["score"]
    assert by_id[1] == by_id[2]
    assert {r["score"] for r in mil.score_quality(table, labels.limit(0)).collect()} == {0.5}
    assert mil.score_quality(table.limit(0), labels).collect() == []
