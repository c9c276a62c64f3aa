"""Sums per block against NumPy and against the operators that work sample by sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.functions.bits import pack_frames
from tonelake.operators import bursts, framesums, models, payload, spectrum, state, stats, symbols
from tonelake.sources.series import to_blocks
from tonelake.sources.sinks import packed_streams


@pytest.fixture(scope="module")
def captures():
    rng = np.random.default_rng(11)
    n = np.arange(5000)
    tone = np.exp(2j * np.pi * 0.031 * n)
    keyed = np.exp(1j * np.cumsum(np.repeat(np.where(rng.random(250) > 0.5, 0.3, -0.3), 20)))
    burst = 0.01 * (rng.normal(size=5000) + 1j * rng.normal(size=5000))
    burst[1500:3300] += np.sign(rng.normal(size=1800))
    return {
        "noise": rng.normal(size=5000) + 1j * rng.normal(size=5000),
        "tone": tone,
        "keyed": keyed,
        "burst": burst,
        "short": rng.normal(size=3) + 0j,
        "one": np.array([1.0 + 2.0j]),
        "flat": np.zeros(700, complex),
    }


@pytest.fixture(scope="module", params=[64, 1000, 8192])
def blocks(spark, captures, request):
    rows = pd.concat([pd.DataFrame({"capture_id": k, "n": np.arange(len(z)), "i": z.real, "q": z.imag}) for k, z in captures.items()])
    samples = spark.createDataFrame(rows).cache()
    return to_blocks(samples, request.param).cache(), samples, request.param


def table(df, *names):
    rows = df.toPandas().set_index("capture_id").sort_index()
    return rows[list(names)] if names else rows


def test_measures_equal_those_of_single_operators(blocks):
    cut, samples, block_len = blocks
    states = state.block_states(cut)
    m = state.merged(states)
    freqs = stats.instant_frequency(cut, block_len)
    shape = table(state.shape_features(m))
    cums = table(stats.cumulants(samples))
    assert np.allclose(shape["c40_abs"], np.hypot(cums["c40_re"], cums["c40_im"]), atol=1e-9)
    assert np.allclose(shape["c42_abs"], np.hypot(cums["c42_re"], cums["c42_im"]), atol=1e-9)
    for name in ("env_norm", "papr_db", "m4m2", "m6m2"):
        assert np.allclose(shape[name], table(stats.envelope_stats(samples))[name], atol=1e-7), name
    moments, want = table(state.step_moments(m)), table(stats.frequency_stats(freqs))
    assert np.allclose(moments["fvar"], want["fvar"], rtol=1e-9, atol=1e-15)
    assert np.allclose(moments["kurtosis"], want["kurtosis"], rtol=1e-6, atol=1e-6)
    last, before = table(models.last_resort(state.last_resort(m))), table(models.heuristic(samples, freqs))
    assert last.equals(before)
    ib, want = table(state.imbalance(m)), table(stats.branch_moments(samples))
    assert np.allclose(ib[["pi", "pq", "piq"]], want[["pi", "pq", "piq"]])
    cfo, want = table(state.frequency_offset(states)), table(stats.frequency_offset(stats.unwrapped_phase(cut, block_len), 1.0))
    assert np.allclose(cfo["cfo_hz"], want["cfo_hz"], atol=1e-12)


def test_burst_view_and_regions(blocks):
    cut, samples, block_len = blocks
    states = state.block_states(cut)
    m = state.merged(states)
    sizes = m.select("capture_id", F.col("num").alias("n_samples"))
    regions = bursts.regions(bursts.floored(state.envelope_windows(states)), sizes).cache()
    got, want = table(regions), table(bursts.burst_regions(samples))
    assert got.drop(columns="snr_db")[["found", "start_sample", "end_sample", "reason"]].equals(want[["found", "start_sample", "end_sample", "reason"]])
    focus = state.burst_focus(regions, models.FOCUS_MIN_SAMPLES, models.FOCUS_MIN_BURST)
    inner = state.merged(state.block_states(cut, focus))
    view = models.focus_burst(samples, regions)
    assert table(inner)["num"].astype(int).equals(view.groupBy("capture_id").count().toPandas().set_index("capture_id").sort_index()["count"].astype(int).rename("num"))
    assert np.allclose(table(state.shape_features(inner))["papr_db"], table(stats.envelope_stats(view))["papr_db"])


@pytest.mark.parametrize("ranked", [10_000, 50])
def test_radix_counts_find_exact_quantiles(blocks, captures, monkeypatch, ranked):
    monkeypatch.setattr(state, "RANKED", ranked)
    cut, samples, block_len = blocks
    states = state.block_states(cut).cache()
    m = state.merged(states).cache()
    focus = m.select("capture_id", F.lit(0).cast("long").alias("lo"), F.col("num").alias("hi"))
    probs = [0.01, 0.5, 0.99]
    got = table(state.step_distribution(cut, states, m, focus, probs))
    want = table(stats.frequency_stats(stats.instant_frequency(cut, block_len)))
    assert np.allclose(got["q2"] - got["q0"], want["prange"]) and (got["nsig"] == want["nsig"]).all()
    for name, z in captures.items():
        if len(z) > 1:
            f = state.phase_steps(z)[1]
            assert np.allclose(got.loc[name, ["q0", "q1", "q2"]].astype(float), np.quantile(f, probs), atol=0), name


def test_keys_keep_the_order_of_doubles():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324]])
    keys = state.ordered_keys(v)
    assert (np.argsort(keys, kind="stable") == np.argsort(v, kind="stable")).all()
    assert (state.values_of(keys) == v).all()
    low, high = int(keys.min()), int(keys.max())
    slots, counts, left = state.radix_counts(keys, low, high)
    assert counts.sum() == len(v) and len(slots) <= 1 << state.RADIX_BITS
    assert [((int(k) - low) >> left) for k in np.unique(keys)] == np.repeat(slots, [len(np.unique(keys[[(int(k) - low) >> left == s for k in keys]])) for s in slots]).tolist()


def test_tone_periods_fits_and_bits(blocks):
    cut, samples, block_len = blocks
    states = state.block_states(cut)
    m = state.merged(states)
    known = table(state.lagged(states, m))
    freqs = stats.instant_frequency(cut, block_len)
    for name, rows in freqs.toPandas().sort_values("n").groupby("capture_id"):
        f = rows["f"].to_numpy()
        d = f - f.mean()
        assert np.isclose(known.loc[name, "c1"], (d[:-1] * d[1:]).sum(), atol=1e-9), name
    powers = m.select("capture_id", ((F.col("s_ii") + F.col("s_qq")) / F.col("num")).alias("p"))
    got = state.fit_sums(cut, powers).toPandas().sort_values(["capture_id", "scheme"]).reset_index(drop=True)
    want = symbols.fit_table(samples).toPandas().sort_values(["capture_id", "scheme"]).reset_index(drop=True)
    assert (got["scheme"] == want["scheme"]).all() and np.allclose(got["evm_percent"], want["evm_percent"])
    joined, size = state.coalesced(cut, block_len, 2048)
    for scheme in symbols.LINEAR_SCHEMES:
        labels = m.select("capture_id", F.lit(scheme).alias("scheme"), "peak")
        packed = state.packed_bits(joined, labels).cache()
        bits = symbols.slice_linear(samples, scheme).cache()
        starts = m.select("capture_id", F.when(F.col("capture_id") == "tone", 13).otherwise(F.lit(0)).alias("start"))
        mine = table(state.payload_streams(packed, starts))
        assert mine["data"].map(bytes).to_dict() == table(packed_streams(payload.slice_bits(bits, starts)))["data"].map(bytes).to_dict()
        whole = pack_frames(bits, 1 << 30, 0).toPandas().set_index("capture_id")
        for row in state.packed_frames(packed, 32).collect():
            every = np.unpackbits(np.frombuffer(bytes(whole.loc[row["capture_id"], "data"]), np.uint8))[: whole.loc[row["capture_id"], "n_bits"]]
            own = np.unpackbits(np.frombuffer(bytes(row["data"]), np.uint8))[: row["n_bits"]]
            assert (own == every[row["start"] : row["start"] + row["n_bits"]]).all()


def test_frame_sizes_follow_the_length_of_a_capture(spark, captures, blocks):
    cut, _, block_len = blocks
    plan = {r["capture_id"]: r["nfft"] for r in framesums.frame_plan(stats.sizes(cut), 4096, 16).collect()}
    assert plan == {"noise": 2048, "tone": 2048, "keyed": 2048, "burst": 2048, "flat": 256}
    got = framesums.averaged_power(cut, framesums.frame_plan(stats.sizes(cut), 4096, 16), block_len, 4096).toPandas()
    for name, nfft in plan.items():
        z = captures[name]
        rows = np.stack([z[k : k + nfft] for k in range(0, len(z) - nfft + 1, nfft // 2)])
        want = np.fft.fftshift((np.abs(np.fft.fft(rows * spectrum.hann(nfft), axis=1)) ** 2).mean(axis=0))
        mine = got[got["capture_id"] == name].sort_values("bin")
        assert np.allclose(mine["p"], want) and (mine["frames"] == len(rows)).all()


def test_reasons_and_thinning(spark, blocks):
    cut, _, block_len = blocks
    lines = table(spectrum.envelope_line_rate(cut, stats.sizes(cut), 1.0, 1024, block_len, least_nfft=16))
    assert lines.loc["short", "reason"] == "too short" and lines.loc["flat", "reason"] == "few bins"
    assert set(lines.loc[["noise", "tone"], "reason"]) <= {"no line", "few bins"}
    assert framesums._thinned(64, 64) is None and framesums._thinned(500, None) is None
    kept = framesums._thinned(500, 64)
    assert len(kept) == 64 and kept[0] == 0 and kept[-1] == 499
