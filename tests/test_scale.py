"""What a step hands on must not grow with what it need not tell."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.functions import bits as bits_of
from tonelake.operators import acquire, frames, framesums, interleave, models, rates, state, stats, sync
from tonelake.sources import captures
from tonelake.sources.series import to_blocks


def blocks_of(spark, length, block_len):
    z = np.random.default_rng(5).normal(size=(length, 2))
    rows = pd.DataFrame({"capture_id": "x", "n": np.arange(length), "i": z[:, 0], "q": z[:, 1]})
    return to_blocks(spark.createDataFrame(rows), block_len), z[:, 0] + 1j * z[:, 1]


def test_steps_of_one_block_are_not_sent_one_by_one(spark):
    blocks, x = blocks_of(spark, 3000, 4096)
    keys = np.sort(state.ordered_keys(state.phase_steps(x)[1]))
    ask = [(0, state.VALUES, None, None, int(keys[0]), int(keys[-1]), len(keys), 29)]
    asks = spark.createDataFrame([("x", 0, 3000, ask)], f"capture_id string, lo long, hi long, asks {state._ASK}")
    none = spark.createDataFrame([], "capture_id string, cross double")
    rows = sorted((r.low, r.high, r.hits) for r in state.step_counts(blocks, none, asks).collect())
    assert rows == [(int(keys[0]), int(keys[29]) - 1, 29), (int(keys[29]), int(keys[29]), 1)]


def test_coherence_of_a_short_capture_needs_no_products(spark):
    values = {}
    for block_len in (512, 4096):
        blocks, _ = blocks_of(spark, 3000, block_len)
        plan = spark.createDataFrame([("x", 3000, 128)], "capture_id string, num_samples long, nfft int")
        found = framesums.cyclic_coherence(blocks, plan, block_len, 128, 1.0, 2)
        values[block_len] = found.toPandas().sort_values("d")["coherence"].to_numpy()
    assert len(values[512]) == len(values[4096]) > 50 and np.allclose(values[512], values[4096], rtol=1e-12)


def test_blocks_of_many_files_leave_a_reader_together(spark):
    sizes = (0, 1, 2, 5000, 262_200)
    files = spark.createDataFrame(
        [(k, "iq", "int8", "little", bytearray((b"\x01\xff" * n)[:n])) for k, n in enumerate(sizes)],
        "capture_id int, kind string, iq_format string, endian string, content binary",
    )
    got = captures.read_blocks(files, 1000).groupBy("capture_id").agg(
        F.count("*").alias("blocks"), F.sum(F.size("i")).alias("n"), F.max("reason").alias("reason"), F.sum(F.aggregate("q", F.lit(0.0), lambda a, v: a + v)).alias("q")
    )
    rows = {r.capture_id: (r.blocks, r.n, r.reason, r.q) for r in got.collect()}
    assert rows == {
        k: (max(1, -(-(n // 2) // 1000)), n // 2, None if n > 1 else "no samples", -(n // 2) / 128) for k, n in enumerate(sizes)
    }


def _positions(name, n_bits):
    return frames.source_positions(name, n_bits)


@pytest.mark.parametrize("name", frames.INTERLEAVERS)
@pytest.mark.parametrize("size", [1, 2, 12, 13, 32, 33, 500, 9001])
def test_streams_are_mapped_without_their_positions(name, size):
    data = np.random.default_rng(size).integers(0, 256, size, np.uint8)
    source = _positions(name, 8 * size)
    bits = np.zeros(source.size, np.uint8)
    bits[: 8 * size] = np.unpackbits(data)
    assert frames.remap_bytes(name, data.tobytes()) == np.packbits(bits[source]).tobytes()


def test_syndromes_of_streams_together_equal_those_of_each_bit():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 2, n, np.uint8) for n in (8, 0, 16, 64, 128, 1000, 8, 192, 384, 24, 4096)]
    found = frames.syndromes(streams)
    for bits, row in zip(streams, found.tolist()):
        for (_, length, generators), (tested, weight) in zip(frames.CODES, row):
            rate = len(generators)
            columns = bits[: bits.size // rate * rate].reshape(-1, rate)
            want = [0, 0]
            if len(columns) >= 4:
                for relation in frames.code_relations(length, generators):
                    for g in range(length - 1, len(columns)):
                        want[0] += 1
                        want[1] += sum(int(columns[g - d, c]) for c, d in relation) % 2
            assert [tested, weight] == want
    assert not frames.syndromes([]).size


def test_a_task_sends_no_more_scores_than_a_capture_keeps(spark):
    rows = [(k, bytearray(np.random.default_rng(k).integers(0, 256, 50, np.uint8))) for k in (1, 2, 2, 3)] + [(4, bytearray())]
    got = frames.code_screen(spark.createDataFrame(rows, "capture_id int, data binary"))
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert {r.capture_id: r["count"] for r in got.groupBy("capture_id").count().collect()} == {1: 4, 2: 4, 3: 4}
    assert got.where("capture_id = 2 AND rank = 1").count() == 1


def test_rate_candidates_are_ranked_in_their_row(spark):
    rows = [(1, 48000.0, 12000.0), (1, 48000.0, 12000.0), (1, 100.0, None), (2, 0.0, 5.0), (3, 20000.0, 0.0), (None, 1000.0, 1000.0)]
    measures = spark.createDataFrame(rows, "capture_id int, bandwidth_hz double, symbol_rate_hz double")
    found = rates.rate_candidates(measures)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("Generate") < plan.index("Aggregate")  # rows are multiplied last
    got = {(r.capture_id, r["rank"]): (r.rate_hz, r.score) for r in found.collect()}
    assert sorted(got, key=str) == sorted([(c, k) for c in (1, 3, None) for k in range(1, 6)], key=str)
    # Twice 48 000 Hz is also eight times the symbol rate and a standard rate.
    top = found.where("capture_id = 1 AND rate_hz = 96000").collect()
    assert [r.rationale for r in top] == [
        "Nyquist x2 of occupied bandwidth; 8x oversampling of estimated symbol rate; standard capture rate inside the plausible band"
    ]


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_groups_of_long_payloads_leave_in_bounded_arrays(spark):
    rng = np.random.default_rng(8)
    rows = [(k, bytearray(rng.integers(0, 256, n, np.uint8).tobytes())) for k, n in enumerate((0, 1, 2, 7, 100, 70_001))]
    payloads = spark.createDataFrame([*rows, (None, bytearray(b"\xf0")), (9, None)], "capture_id long, data binary")
    for width in (1, 3, 6, 9):
        want = {}
        for k, data in [*rows, (None, b"\xf0")]:
            bits = np.unpackbits(np.frombuffer(bytes(data), np.uint8))
            count = bits.size // width
            values = bits[: count * width].reshape(count, width) @ (1 << np.arange(width)[::-1])
            if count:
                want[k] = (count, int(values.sum()), int((values * (np.arange(count) % 1009)).sum()))
        sums = bits_of.bit_groups(payloads, width).groupBy("capture_id").agg(
            F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("g") % 1009)).alias("mark")
        )
        assert {r.capture_id: (r.n, r.total, r.mark) for r in sums.collect()} == want
    assert "transform(" not in _plan(bits_of.bit_groups(payloads, 3))


def test_brackets_of_quantiles_are_stored_before_values_meet_them(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("capture_id"), (F.col("id") % 7).cast("double").alias("v"))
    found = stats.exact_quantiles(rows, "v", [0.5])
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.capture_id: r.q0 for r in found.collect()} == {0: 3.0, 1: 3.0}


def test_samples_of_few_captures_are_not_sorted_for_their_ranges(spark):
    samples = spark.range(3_000_000).select((F.col("id") % 2).alias("capture_id"), F.floor(F.col("id") / 2).alias("n"), F.lit(1.0).alias("i"), F.lit(0.0).alias("q"))
    regions = samples.groupBy("capture_id").agg(F.count("*").alias("n_samples")).select(
        "*", F.lit(True).alias("found"), F.lit(100).cast("long").alias("start_sample"), F.lit(200).cast("long").alias("end_sample")
    )
    focused = models.focus_burst(samples, regions)
    assert "SortMergeJoin" not in _plan(focused)
    assert focused.count() == 200


def test_chips_are_sent_to_the_samples(spark):
    samples = spark.range(4096).select(F.lit("x").alias("capture_id"), F.col("id").alias("n"), F.lit(1.0).alias("i"), F.lit(0.0).alias("q"))
    acquired = spark.createDataFrame([("x", 7, True, 0.0, 3, 2)], "capture_id string, code int, acquired boolean, doppler_hz double, code_phase long, n_blocks long")
    plan = _plan(acquire.despread(samples, acquired, 2_048_000.0))
    assert "BroadcastHashJoin [code" in plan and "SortMergeJoin [code" not in plan


def test_steps_over_whole_texts_run_with_few_rows_in_a_batch(spark):
    payloads = spark.createDataFrame([(k, bytearray(b"the text %d" % k)) for k in range(5)], "capture_id int, data binary")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    chunks = interleave.to_chunks(payloads, interleave.UNIT_BITS)
    for done in (
        frames.crc_scan(payloads),
        sync.correlate(sync.whole_frames(payloads), ["0x74686520"]),
        captures.infer_format(payloads.withColumnRenamed("data", "content")),
        interleave.search_chunks(chunks, ("none",), interleave.UNIT_BITS),
    ):
        plan = done._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
        assert done.groupBy("capture_id").count().count() == 5
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == usual
