"""Numbering, blocks, halos, quantiles, runs: small fixtures against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.operators import bursts, spectrum, stats, symbols
from tonelake.sources.series import number_rows, to_blocks, to_samples, with_lookahead


def frame(spark, x, capture="a"):
    x = np.asarray(x, dtype=np.complex128)
    return spark.createDataFrame(
        pd.DataFrame({"capture_id": capture, "n": np.arange(x.size), "i": x.real, "q": x.imag})
    )


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(3)
    return rng.normal(size=1000) + 1j * rng.normal(size=1000)


def test_number_rows_with_a_hot_key(spark):
    keys = ["hot"] * 700 + ["b"] * 200 + ["c"] * 100
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": keys, "t": rng.permutation(1000)})
    got = number_rows(spark.createDataFrame(pdf).repartition(7), "k", ["t"]).toPandas()
    want = pdf.sort_values("t").groupby("k").cumcount()
    pdf["want"] = want
    merged = got.merge(pdf, on=["k", "t"])
    assert len(merged) == 1000 and (merged["n"] == merged["want"]).all()


@pytest.mark.parametrize("block_len", [7, 64, 2000])
def test_blocks_round_trip_and_lookahead(spark, noise, block_len):
    samples = frame(spark, noise)
    blocks = to_blocks(samples, block_len)
    back = to_samples(blocks).orderBy("n").toPandas()
    assert np.allclose(back["i"] + 1j * back["q"], noise)
    for ahead in (1, 20):
        for row in with_lookahead(blocks, ahead, block_len).collect():
            end = min(noise.size, row.start_n + block_len + ahead)
            assert np.allclose(np.array(row.i) + 1j * np.array(row.q), noise[row.start_n : end])


@pytest.mark.parametrize("block_len", [7, 64])
def test_phase_series_match_numpy(spark, noise, block_len):
    blocks = to_blocks(frame(spark, noise), block_len)
    want = np.unwrap(np.angle(noise))
    got = stats.unwrapped_phase(blocks, block_len).orderBy("n").toPandas()
    assert len(got) == noise.size and np.allclose(got["phase"], want)
    freq = stats.instant_frequency(blocks, block_len).orderBy("n").toPandas()
    assert np.allclose(freq["f"], np.diff(want))
    cfo = stats.frequency_offset(stats.unwrapped_phase(blocks, block_len), 100_000.0).first().cfo_hz
    assert cfo == pytest.approx(np.polyfit(np.arange(1000), want, 1)[0] * 100_000 / (2 * np.pi))


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=4000), np.zeros(1500)])
    df = spark.createDataFrame(pd.DataFrame({"capture_id": "x", "v": values})).repartition(5)
    probs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    row = stats.exact_quantiles(df, "v", probs, accuracy).first()
    assert [row[f"q{k}"] for k in range(len(probs))] == pytest.approx(list(np.quantile(values, probs)))


@pytest.mark.parametrize("segment", [4, 16, 1000])
def test_longest_run_over_segments(spark, segment):
    rng = np.random.default_rng(9)
    for trial in range(4):
        mask = rng.random(120) < (0.5 + 0.12 * trial)
        if not mask.any():
            continue
        best, at, k = -1, None, 0
        while k < mask.size:
            if mask[k]:
                j = k
                while j + 1 < mask.size and mask[j + 1]:
                    j += 1
                if j - k > best:
                    best, at = j - k, (k, j)
                k = j
            k += 1
        pdf = pd.DataFrame({"capture_id": "m", "block": np.flatnonzero(mask)})
        row = bursts.longest_runs(spark.createDataFrame(pdf), segment=segment).first()
        assert (row.first_pos, row.last_pos) == at


def test_burst_in_noise(spark):
    rng = np.random.default_rng(2)
    x = 0.05 * (rng.normal(size=6400) + 1j * rng.normal(size=6400))
    x[2048:4096] += np.exp(1j * rng.uniform(0, 6, 2048))
    row = bursts.burst_regions(frame(spark, x)).first()
    assert row.found and (row.start_sample, row.end_sample) == (2048, 4096)
    short = bursts.burst_regions(frame(spark, x[:100])).first()
    assert not short.found and "shorter" in short.reason
    flat = bursts.burst_regions(frame(spark, np.ones(640))).first()
    assert not flat.found and "dynamic range" in flat.reason


def test_tone_spectrum_and_filter(spark, noise):
    n = np.arange(4096)
    tone = np.exp(2j * np.pi * 10_000 * n / 100_000)
    samples = frame(spark, tone)
    measures = spectrum.spectrum_measures(spectrum.psd(samples, 100_000.0)).first()
    assert abs(measures.center_hz - 10_000) < 100_000 / 4096
    taps = spectrum.rrc_taps(4, 0.35, 8)
    assert sum(t * t for t in taps) == pytest.approx(1.0)
    blocks = to_blocks(frame(spark, noise), 128)
    got = to_samples(spectrum.fir_filter(blocks, taps, 128)).orderBy("n").toPandas()
    delay = (len(taps) - 1) // 2
    want = np.convolve(noise, taps)[delay : delay + noise.size]
    assert np.allclose(got["i"] + 1j * got["q"], want)


def test_tone_periods_and_slicing(spark):
    rng = np.random.default_rng(11)
    for period in (8, 20):
        bits = rng.integers(0, 2, 80)
        steps = np.repeat(np.where(bits > 0, 0.3, -0.3), period)
        phase = np.concatenate([[0.0], np.cumsum(steps)])[:-1]
        blocks = to_blocks(frame(spark, np.exp(1j * phase)), 256)
        freqs = stats.instant_frequency(blocks, 256)
        periods = symbols.tone_periods(freqs)
        assert periods.first().period == period
        # Block borders inside the series, and blocks shorter than the period.
        for block_len in (64, 5):
            again = symbols.tone_periods(freqs, block_len=block_len).first()
            assert again.period == period and again.residual == pytest.approx(periods.first().residual)
        got = symbols.slice_tones(freqs, periods, 2).orderBy("pos").toPandas()["bit"].to_numpy()
        assert (got[: bits.size] == bits[: got.size]).all() and got.size >= bits.size - 1


def test_four_tones_and_levels(spark):
    rng = np.random.default_rng(12)
    labels = rng.integers(0, 4, 200)
    steps = np.repeat((labels * 2 - 3) * 0.2, 10) + rng.normal(0, 0.001, 2000)
    phase = np.concatenate([[0.0], np.cumsum(steps)])[:-1]
    freqs = stats.instant_frequency(to_blocks(frame(spark, np.exp(1j * phase)), 512), 512)
    periods = spark.createDataFrame([("a", 10)], "capture_id string, period long")
    levels = symbols.tone_levels(symbols.tone_symbols(freqs, periods), 4).first()
    assert [levels[f"level{k}"] for k in range(4)] == pytest.approx([-0.6, -0.2, 0.2, 0.6], abs=0.01)
    assert levels.residual < 0.05
    got = symbols.slice_tones(freqs, periods, 4).orderBy("pos").toPandas()["bit"].to_numpy()
    assert (got.reshape(-1, 2) @ [2, 1] == labels[: got.size // 2]).mean() > 0.8


def test_clean_constellations_have_no_error(spark):
    from tonelake.functions.bits import byte_values

    assert byte_values is not None
    for scheme, width in (("BPSK", 1), ("QPSK", 2), ("8PSK", 3), ("16-QAM", 4), ("64-QAM", 6)):
        labels = spark.range(1 << width).select(F.col("id").cast("int").alias("label"))
        i, q = symbols.label_to_point(scheme, F.col("label"))
        points = labels.select("label", i.alias("i"), q.alias("q"))
        bits = symbols.symbol_bits(scheme, F.col("i"), F.col("q"), by_level=True)
        for row in points.select("label", "i", "q", bits.alias("bits")).collect():
            assert int("".join(map(str, row.bits)), 2) == row.label, scheme
        power = points.agg(F.avg(F.col("i") ** 2 + F.col("q") ** 2)).first()[0]
        assert power == pytest.approx(1.0)
