"""Hypotheses scored in packed blocks against one row per bit and hypothesis."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.operators import hypotheses, stats, symbols, sync
from tonelake.sources.series import to_blocks

WORD = "0x1ACF"


@pytest.fixture(scope="module", params=[32, 1000])
def captures(spark, request):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(5):
        bits = rng.integers(0, 2, 3000)
        bits[400:416] = [int(b) for b in f"{0x1ACF:016b}"]
        z = (2 * bits[0::2] - 1 + 1j * (2 * bits[1::2] - 1)) / np.sqrt(2) * np.exp(1j * np.pi / 2 * k)
        z = z + 0.05 * (rng.normal(size=len(z)) + 1j * rng.normal(size=len(z)))
        rows.append(pd.DataFrame({"capture_id": k, "n": np.arange(len(z)), "i": z.real, "q": z.imag}))
    samples = spark.createDataFrame(pd.concat(rows)).cache()
    return to_blocks(samples, request.param).cache(), samples, request.param


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rotations(captures):
    blocks, samples, block_len = captures
    got = rows_of(hypotheses.resolve_rotation(blocks, block_len, "QPSK", WORD))
    assert got == rows_of(sync.resolve_rotation(samples, "QPSK", WORD, frame_bits=512))
    assert [r[1] for r in got] == [0, 3, 2, 1, 0] and all(r[4] and r[3] == 400 for r in got)


@pytest.mark.parametrize("scheme", ["16-QAM", "64-QAM", "8PSK", "BPSK"])
def test_rotations_of_other_schemes(captures, scheme):
    blocks, samples, block_len = captures
    assert rows_of(hypotheses.resolve_rotation(blocks, block_len, scheme, WORD)) == rows_of(sync.resolve_rotation(samples, scheme, WORD, frame_bits=512))


def test_corroboration(captures):
    blocks, samples, block_len = captures
    freqs = stats.instant_frequency(blocks, block_len).cache()
    periods = symbols.tone_periods(freqs).cache()
    names = F.array(*[F.lit(s) for s in ("BPSK", "8PSK", "QPSK", "AM", "64-QAM")])
    labels = blocks.select("capture_id").distinct().select(
        "capture_id", F.get(names, F.col("capture_id").cast("int")).alias("scheme"), (F.col("capture_id") != 4).alias("estimated")
    )
    bits = symbols.slice_candidates(samples)
    for scheme, order in (("2-FSK", 2), ("4-FSK", 4)):
        bits = bits.unionByName(symbols.slice_tones(freqs, periods, order).withColumn("scheme", F.lit(scheme)))
    want = rows_of(sync.corroborate(bits, labels, WORD, frame_bits=512))
    assert rows_of(hypotheses.corroborate(blocks, block_len, freqs, periods, labels, WORD)) == want
    assert any(r[2] is not None for r in want)


@pytest.mark.parametrize("lags", [(-2, 12), (0, 0), (3, 5)])
@pytest.mark.parametrize("block_len", [16, 1 << 16])
def test_lagged_errors(spark, lags, block_len):
    rng = np.random.default_rng(9)
    tx, rx = [], []
    for k in range(3):
        sent = rng.integers(0, 4, 500 + k)
        got = np.where(rng.random(len(sent)) < 0.1, rng.integers(0, 4, len(sent)), sent)
        tx += [(k, n, int(v)) for n, v in enumerate(sent)]
        rx += [(k, n + 4, int(v)) for n, v in enumerate(got) if n % 37]
    schema = "capture_id long, n long, label int"
    a, b = spark.createDataFrame(tx, schema), spark.createDataFrame(rx, schema)
    got = {r[0]: r[1] for r in hypotheses.best_bit_error_rate(a, b, "QPSK", lags, block_len).collect()}
    want = {r[0]: r[1] for r in symbols.best_bit_error_rate(a, b, "QPSK", lags).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
