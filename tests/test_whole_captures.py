"""Every sample of a capture enters a measure, whatever its length and block size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tonelake.operators import payload, reports, spectrum, stats
from tonelake.sources import captures
from tonelake.sources.series import to_blocks, to_samples


def frame(spark, z):
    return spark.createDataFrame(pd.DataFrame({"capture_id": "c", "n": np.arange(z.size), "i": z.real, "q": z.imag}))


@pytest.mark.parametrize("block_len", [7, 16, 64])
def test_filter_with_blocks_shorter_than_its_reach(spark, block_len):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=300) + 1j * rng.normal(size=300)
    taps = spectrum.rrc_taps(8, 0.35, 8)
    got = to_samples(spectrum.fir_filter(to_blocks(frame(spark, noise), block_len), taps, block_len)).orderBy("n").toPandas()
    delay = (len(taps) - 1) // 2
    assert np.allclose(got["i"] + 1j * got["q"], np.convolve(noise, taps)[delay : delay + noise.size])


def test_spectra_of_a_long_capture_use_all_frames(spark):
    """The line sits in the second half only, beyond the first 64 frames."""
    rng = np.random.default_rng(4)
    nfft, count = 64, 64 * 300
    z = rng.normal(size=count) + 1j * rng.normal(size=count)
    blocks = to_blocks(frame(spark, z), 1000)
    means = blocks.groupBy("capture_id").agg((spectrum.F.lit(float(np.mean(np.abs(z) ** 2)))).alias("mean"))
    got = spectrum.welch_envelope(blocks, means, nfft, 1000).orderBy("bin").toPandas()["p"].to_numpy()
    env = np.abs(z) ** 2 - np.mean(np.abs(z) ** 2)
    window = spectrum.hann(nfft)
    rows = np.stack([env[k : k + nfft] for k in range(0, count - nfft + 1, nfft // 2)])
    want = np.fft.fftshift((np.abs(np.fft.fft(rows * window, axis=1)) ** 2).mean(axis=0)) / (nfft * np.mean(window**2))
    assert np.allclose(got, want)

    profile = spectrum.coherence_profile(blocks, stats.sizes(blocks), 1.0, nfft, 1000).orderBy("d").toPandas()
    rows = np.stack([z[k : k + nfft] for k in range(0, count - nfft + 1, nfft // 2)])
    x = np.fft.fft(rows * window, axis=1) / np.sqrt(nfft * np.mean(window**2))
    for d, value in zip(profile["d"], profile["coherence"], strict=True):
        a, b = np.roll(x, -d, axis=1), np.roll(x, d, axis=1)
        root = np.sqrt((np.abs(a) ** 2).mean(axis=0) * (np.abs(b) ** 2).mean(axis=0))
        cross = np.abs((a * b.conj()).mean(axis=0)) ** 2
        assert np.isclose(value, len(x) * (cross / root).sum() / root.sum())


def test_transform_of_whole_captures_is_split(spark, monkeypatch):
    """Any length, a prime too, and no row of a plan holds more than the cells of a group."""
    monkeypatch.setattr(spectrum, "TRANSFORM_CELLS", 1 << 9)
    rng = np.random.default_rng(8)
    parts = {num: rng.normal(size=num) + 1j * rng.normal(size=num) for num in (16, 4_093, 5_000)}
    rows = pd.concat([pd.DataFrame({"capture_id": k, "num": k, "n": np.arange(k), "i": z.real, "q": z.imag}) for k, z in parts.items()])
    assert spectrum._shape(4_093)[:3:2] == (64, 8)  # 128 columns in groups of 8
    got = spectrum.whole_power(spark.createDataFrame(rows), lambda bins, num: 3 * bins < num).toPandas()
    for num, z in parts.items():
        mine = got[got["capture_id"] == num].sort_values("bin")
        assert mine["bin"].tolist() == list(range(-(-num // 3)))
        assert np.allclose(mine["p"], np.abs(np.fft.fft(z))[: len(mine)] ** 2)


def test_no_operator_collects_a_capture_into_a_row(spark):
    from tonelake.operators import acquire

    z = np.exp(2j * np.pi * 0.01 * np.arange(40_000))
    samples = frame(spark, z)
    for out in (spectrum.carrier_line(samples, 4), acquire.line_rate(samples, 200_000.0)):
        assert "collect_list" not in out._jdf.queryExecution().toString()
    row = spectrum.carrier_line(samples, 4).first()
    assert abs(row.cycles_per_sample - 0.01) < 1e-9


def test_size_is_no_reason_without_a_cap(spark, tmp_path):
    (tmp_path / "a.iq").write_bytes(np.zeros(400, "<f4").tobytes())
    assert captures.load(spark, str(tmp_path)).where("reason IS NOT NULL").count() == 0
    assert captures.load(spark, str(tmp_path), cap=100).where("reason IS NOT NULL").count() == 1


def test_previews_tell_the_whole_size(spark):
    data = bytes(range(65, 91)) * 20
    row = payload.describe(spark.createDataFrame([(1, bytearray(data))], "capture_id int, data binary")).first()
    assert row.bytes == 520 and row.text_preview == data[:256].decode() + "..."
    assert row.hexdump[-1] == "... 264 more byte(s) not shown" and len(row.hexdump) == 17


def test_reports_use_the_rate_of_the_header(spark, tmp_path):
    from test_files import wav

    from tonelake.plans import capture_report

    t = np.arange(4096)
    z = 0.5 * np.exp(2j * np.pi * t / 16)
    (tmp_path / "tone.wav").write_bytes(wav(np.column_stack([z.real, z.imag]), 48_000))
    (tmp_path / "tone.iq").write_bytes(np.column_stack([z.real, z.imag]).astype("<f4").tobytes())
    listed = captures.gated(spark.read.format("binaryFile").load(str(tmp_path)))
    files = listed.selectExpr("path AS capture_id", "kind", "'complex64' AS iq_format", "'little' AS endian", "content", "error")
    full = capture_report.analyse_files(files, 100_000.0, 256, nfft=512)
    rows = {r.file: r for r in reports.summary_rows(full).collect()}
    assert set(rows) == {"tone.wav", "tone.iq"}
    of_wav, of_raw = rows["tone.wav"], rows["tone.iq"]
    assert (of_wav.sample_rate, of_wav.file_type, of_wav.iq_format_used) == (48_000, "wav", None)
    assert (of_raw.sample_rate, of_raw.file_type, of_raw.iq_format_used) == (100_000, "iq", "complex64")
    assert of_wav.duration_s == round(4096 / 48_000, 4) and of_raw.duration_s == round(4096 / 100_000, 4)
    assert abs(of_wav.center_freq_est - 3_000) < 100 and abs(of_raw.center_freq_est - 6_250) < 200


def test_quantiles_of_series_with_few_values(spark):
    rng = np.random.default_rng(6)
    parts = {"constant": np.full(30_000, 2.5), "few": rng.integers(0, 5, 25_000).astype(float), "many": rng.normal(size=25_000), "tiny": np.array([3.0, 1.0, 2.0])}
    rows = pd.concat([pd.DataFrame({"capture_id": k, "x": v}) for k, v in parts.items()])
    got = {r.capture_id: r for r in stats.exact_quantiles(spark.createDataFrame(rows), "x", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    for name, values in parts.items():
        assert np.allclose(list(got[name])[1:], np.quantile(values, [0.0, 0.1, 0.5, 0.9, 1.0]))


def test_line_of_an_envelope_is_found_in_one_row(spark):
    """No window, join or row of a spectrum once its bins are gathered, and the same peak as by hand."""
    rng = np.random.default_rng(5)
    values = {"a": rng.random(63), "b": rng.random(40), "one": rng.random(1), "flat": np.ones(20)}
    values["b"][[7, 30]] = 9.0
    rows = [(c, 64, k + 1, float(v)) for c, p in values.items() for k, v in enumerate(p)]
    band = spark.createDataFrame(rows, "capture_id string, nfft int, bin int, p double").repartition(3)
    peaks = spectrum._line_peaks(band, 64.0, 30.0)
    plan = peaks._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    got = {r["capture_id"]: r for r in peaks.collect()}
    for name, p in values.items():
        near = [np.median([p[min(max(k + d, 0), len(p) - 1)] for d in range(-15, 16)]) for k in range(len(p))]
        assert spectrum.background(p).tolist() == near
        rest = p - near
        k = int(np.argmax(rest[:30]))
        row = got[name]
        assert (row["bins"], row["searched"], row["bin"], row["rest"]) == (len(p), min(30, len(p)), k + 1, rest[k])
        assert row["mid"] == pytest.approx(np.median(rest)) and row["mad"] == pytest.approx(np.median(np.abs(rest - row["mid"])))
        lift = np.maximum(rest - row["mid"], 0)
        assert row["left"] == (lift[k - 1] if k else None) and row["right"] == (lift[k + 1] if k + 1 < len(p) else None)
    lifted = spectrum.running_median(band, "p", "bin").collect()
    assert {(r["capture_id"], r["bin"], r["nfft"]): r["background"] for r in lifted} == {
        (c, k + 1, 64): v for c, p in values.items() for k, v in enumerate(spectrum.background(p).tolist())
    }
    line = spectrum.envelope_line_rate(
        spark.createDataFrame([("a", 0, 0, [1.0] * 64, [0.5] * 64)], "capture_id string, block_no long, start_n long, i array<double>, q array<double>"),
        spark.createDataFrame([("a", 64)], "capture_id string, num_samples long"), 1.0, 32, 64,
    )
    assert "Window" not in line._jdf.queryExecution().optimizedPlan().toString()


def test_running_median_keeps_what_is_no_number(spark):
    rows = [("a", k, float("nan") if k < 20 else 1.0 * k) for k in range(40)]
    got = {r["bin"]: r["background"] for r in spectrum.running_median(spark.createDataFrame(rows, "capture_id string, bin int, p double"), "p", "bin").collect()}
    # A value that is no number ranks above all numbers, as in SQL.
    assert got[39] == 39.0 and got[20] == 35.0 and got[0] is not None and np.isnan(got[0])
