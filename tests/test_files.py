"""Readers, sidecars and sinks on generated files; acquisition and the line hint."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.operators import acquire, models
from tonelake.plans import capture_report
from tonelake.sources import captures, sinks
from tonelake.sources.series import to_blocks, to_samples


def wav(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    channels = samples.shape[1]
    if bits == 16:
        data, tag = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes(), 1
    else:
        data, tag = samples.astype("<f4").tobytes(), 3
    width = bits // 8
    fmt = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * width, channels * width, bits)
    body = b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("captures")
    t = np.arange(600)
    z = 0.5 * np.exp(2j * np.pi * t / 40)
    z.astype("<c8").tofile(root / "tone.iq")
    (root / "loud.WAV").write_bytes(wav(np.column_stack([z.real, z.imag]), 48_000))
    (root / "mono.wav").write_bytes(wav(z.real[:, None], 8_000, 32))
    (root / "bad.wav").write_bytes(b"not a wav file")
    (root / "notes.txt").write_text("no capture")
    (root / "sub").mkdir()
    z[:50].astype("<c8").tofile(root / "sub" / "deep.iq")
    (root / "tone.sigmf-meta").write_text(json.dumps({"global": {"core:sample_rate": 96000, "core:datatype": "cf32_le"}, "captures": [{"core:frequency": 1e6}]}))
    (root / "loud.sigmf-meta").write_text("{broken")
    return root, z


def test_catalogue_and_gate(spark, folder):
    root, _ = folder
    names = [r.path.rsplit("/", 1)[1] for r in captures.catalogue(captures.list_files(spark, str(root))).collect()]
    assert names == ["bad.wav", "loud.WAV", "mono.wav", "tone.iq"]
    deep = captures.catalogue(captures.list_files(spark, str(root), recursive=True)).count()
    assert deep == 5
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in captures.gated(captures.list_files(spark, str(root)), cap=3000).collect()}
    assert "exceeds" in errors["tone.iq"] and "Unsupported" in errors["notes.txt"] and errors["mono.wav"] is None


def test_load_folder(spark, folder):
    root, z = folder
    blocks = captures.load(spark, str(root)).cache()
    rows = {}
    for r in to_samples(blocks.where("reason is null")).orderBy("n").collect():
        rows.setdefault(r.capture_id.rsplit("/", 1)[1], []).append(complex(r.i, r.q))
    assert np.allclose(rows["tone.iq"], z, atol=1e-6)
    assert np.allclose(rows["loud.WAV"], z, atol=1e-4)
    assert np.allclose(rows["mono.wav"], z.real, atol=1e-6)
    rates = {r.capture_id.rsplit("/", 1)[1]: r.sample_rate for r in blocks.collect()}
    assert rates["loud.WAV"] == 48_000 and rates["mono.wav"] == 8_000 and rates["tone.iq"] is None
    bad = blocks.where("reason is not null").collect()
    assert [r.capture_id.rsplit("/", 1)[1] for r in bad] == ["bad.wav"]


@pytest.mark.parametrize("form", captures.FORMATS)
def test_format_inference_on_oversampled_captures(spark, form):
    t = np.arange(4000)
    z = 0.6 * np.exp(2j * np.pi * t / 37)
    flat = np.column_stack([z.real, z.imag]).ravel()
    raw = {
        "complex64": flat.astype("<f4"), "int16": (flat * 32767).astype("<i2"), "int8": (flat * 127).astype("i1"),
        "uint8": (flat * 127 + 128).astype("u1"),
    }[form].tobytes()
    df = spark.createDataFrame([("a", bytearray(raw))], "capture_id string, content binary")
    row = captures.infer_format(df).first()
    assert row.format == form and row.confidence > 0.5


def test_sidecars(spark, folder):
    root, _ = folder
    files = captures.catalogue(captures.list_files(spark, str(root)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in captures.with_sidecars(files, captures.read_sidecars(spark, str(root))).collect()}
    assert rows["tone.iq"].sidecar_rate == 96_000 and rows["tone.iq"].center_frequency == 1e6
    assert rows["loud.WAV"].sidecar_rate is None and rows["mono.wav"].datatype is None


def test_sinks(spark, tmp_path):
    bits = spark.createDataFrame(pd.DataFrame({"capture_id": "a", "pos": np.arange(11), "bit": [1, 0, 1, 1, 0, 0, 0, 1, 1, 1, 0]}))
    assert bytes(sinks.packed_streams(bits).first().data) == bytes([0b10110001, 0b11000000])
    assert sinks.text_streams(bits).first().text == "10110001110"
    sinks.write_bits(bits, str(tmp_path / "bits"))
    assert spark.read.parquet(str(tmp_path / "bits")).count() == 1
    sinks.write_bits(bits, str(tmp_path / "text"), as_text=True)
    assert [r.value for r in spark.read.text(str(tmp_path / "text" / "capture_id=a")).collect()] == ["10110001110"]
    entry = spark.createDataFrame([("a.iq", "https://x.example/a.iq", bytearray(b"abc"))], "name string, url string, content binary")
    sinks.write_manifest(entry, str(tmp_path / "manifest"))
    listed = spark.read.json(str(tmp_path / "manifest"))
    checked = captures.verify_manifest(entry.select("name", "content"), listed.select("name", "sha256")).first()
    assert checked.status == "ok" and listed.first().size_bytes == 3 and listed.first().url.endswith("a.iq")
    report = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")])], "id int, level double, list array<double>")
    sinks.write_reports(report, str(tmp_path / "json"))
    text = spark.read.text(str(tmp_path / "json")).first().value
    assert json.loads(text) == {"id": 1, "level": None, "list": [1.0, None]}
    rows = spark.createDataFrame([("=cmd", 3)], "file string, num_bits int")
    sinks.write_summary_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv")).first()
    assert back.file == "'=cmd" and back.num_bits == "3"


def test_reports_for_files_and_failures(spark, folder):
    root, z = folder
    files = captures.gated(spark.read.format("binaryFile").load(str(root))).select(
        F.col("path").alias("capture_id"), "kind", F.lit("complex64").alias("iq_format"), F.lit("little").alias("endian"), "content", "error"
    ).where(~F.col("capture_id").endswith("sigmf-meta"))
    out = {r.capture_id.rsplit("/", 1)[1]: r for r in capture_report.analyse_files(files, 100_000.0, 256, nfft=512).collect()}
    assert len(out) == 5
    assert out["tone.iq"].signal.num_samples == 600 and out["tone.iq"].errors == []
    assert out["tone.iq"].modulation.revised_from == "TONE" and out["tone.iq"].modulation.confidence == pytest.approx(0.35)
    assert abs(out["tone.iq"].signal.center_frequency_estimate - 2500) < 200
    assert out["bad.wav"].signal is None and "RIFF" in out["bad.wav"].errors[0]
    assert "Unsupported" in out["notes.txt"].errors[0]


def test_spreading_code_prefix():
    assert acquire.spreading_code(1)[:6].tolist() == [1, 1, 0, 0, 1, 0]
    assert all(acquire.spreading_code(k).sum() in (511, 512) for k in range(1, 33))


def test_acquisition_against_a_planted_code(spark):
    rate, size = 2_048_000.0, 2048
    rng = np.random.default_rng(5)
    n = np.arange(size * 6)
    x = np.roll(acquire.replica(9, rate, size), 700)[n % size] * np.exp(2j * np.pi * 1500 * n / rate)
    x = x + 2.0 * (rng.normal(size=n.size) + 1j * rng.normal(size=n.size))
    df = spark.createDataFrame(pd.DataFrame({"capture_id": "s", "n": n, "i": x.real, "q": x.imag}))
    rows = {r.code: r for r in acquire.acquire(df, rate, codes=(4, 9)).collect()}
    assert rows[9].acquired and not rows[4].acquired
    assert rows[9].doppler_hz == 1500 and rows[9].code_phase == 700 and rows[9].n_blocks == 6
    acquired = acquire.acquire(df, rate, codes=(9,))
    prompts = acquire.despread(df, acquired, rate).orderBy("block").toPandas()
    wiped = (x * np.exp(-2j * np.pi * 1500 * n / rate)).reshape(6, size) @ np.roll(acquire.replica(9, rate, size), 700)
    assert np.allclose(prompts["re"] + 1j * prompts["im"], wiped)
    report = acquire.carrier_report(acquire.despread(df, acquired, rate), acquired).first()
    want = 10 * np.log10(abs(wiped.mean()) ** 2 / np.mean(abs(wiped - wiped.mean()) ** 2)) + 30
    assert report.cn0_dbhz == pytest.approx(want)
    declined = acquire.acquire(df, 1_000_000.0, codes=(9,)).first()
    assert not declined.acquired and "resolve" in declined.reason


def test_acquisition_uses_all_blocks(spark, monkeypatch):
    """The code starts after 25 blocks; chunks of 4 blocks meet again per code and Doppler."""
    monkeypatch.setattr(acquire, "BLOCK_CHUNK", 4)
    rate, size, count = 2_048_000.0, 2048, 45
    rng = np.random.default_rng(7)
    n = np.arange(size * count + 100)
    z = 0.5 * (rng.normal(size=n.size) + 1j * rng.normal(size=n.size))
    late = n >= 25 * size
    z[late] += np.roll(acquire.replica(9, rate, size), 700)[n[late] % size]
    df = spark.createDataFrame(pd.DataFrame({"capture_id": "s", "n": n, "i": z.real, "q": z.imag}))
    got = acquire.acquire(df, rate, codes=(9,), doppler_range=250.0).first()
    assert got.acquired and got.n_blocks == count and (got.doppler_hz, got.code_phase) == (0, 700)
    blocks = z[: size * count].reshape(count, size)
    code = np.conj(np.fft.fft(acquire.replica(9, rate, size)))
    acc = np.mean(np.abs(np.fft.ifft(np.fft.fft(blocks, axis=1) * code, axis=1)) ** 2, axis=0)
    rest = np.delete(acc, np.s_[700 - 3 : 700 + 4])
    assert got.metric == pytest.approx(acc[700] / rest.max()) and got.peak_over_mean == pytest.approx(acc[700] / acc.mean())
    acquired = acquire.acquire(df, rate, codes=(9,), doppler_range=250.0)
    assert acquire.despread(df, acquired, rate).count() == count
    first = acquire.acquire(df, rate, codes=(9,), max_blocks=20, doppler_range=250.0).first()
    assert not first.acquired and first.n_blocks == 20


def test_line_rate_hint(spark):
    rate = 200_000.0
    rng = np.random.default_rng(6)
    n = np.arange(30_000)
    turn = 2 * np.pi * acquire.LINE_RATE_HZ * n / rate
    noise = 0.01 * rng.normal(size=n.size)
    cases = {
        "video": 1 + 0.2 * np.cos(turn) + 0.1 * np.cos(2 * turn) + noise,
        "single": 1 + 0.2 * np.cos(turn) + noise,
        "noise": 1 + noise,
        "tone": np.ones(n.size),
    }
    pdf = pd.concat([pd.DataFrame({"capture_id": k, "n": n, "i": v, "q": 0.0}) for k, v in cases.items()])
    rows = {r.capture_id: r for r in acquire.line_rate(spark.createDataFrame(pdf), rate).collect()}
    assert rows["video"].found and abs(rows["video"].line_rate_hz - acquire.LINE_RATE_HZ) < 10
    assert rows["video"].confidence > 0.3 and rows["video"].harmonic_ratio == pytest.approx(0.5, abs=0.1)
    assert not rows["single"].found and rows["single"].reason == "no 2nd harmonic"
    assert not rows["noise"].found and rows["tone"].reason == "constant envelope"


def test_learned_classifier_separates_modulations(spark, tmp_path):
    rng = np.random.default_rng(10)
    frames_, labels = [], []
    for k in range(60):
        kind = ("BPSK", "QPSK", "TONE")[k % 3]
        m = 256
        if kind == "BPSK":
            x = rng.choice([-1.0, 1.0], m).astype(complex)
        elif kind == "QPSK":
            x = (rng.choice([-1, 1], m) + 1j * rng.choice([-1, 1], m)) / np.sqrt(2)
        else:
            x = np.exp(2j * np.pi * (0.01 + 0.002 * (k % 7)) * np.arange(m))
        x = x + 0.05 * (rng.normal(size=m) + 1j * rng.normal(size=m))
        frames_.append(pd.DataFrame({"capture_id": k, "n": np.arange(m), "i": x.real, "q": x.imag}))
        labels.append((k, kind))
    samples = spark.createDataFrame(pd.concat(frames_))
    rows = models.features(samples, 1e6, 256, 256).join(spark.createDataFrame(labels, "capture_id long, label string"), "capture_id").withColumn("period", F.lit(1)).cache()
    model = models.train(rows.where("capture_id < 42").select("label", *models.FEATURES), iterations=60)
    model.write().overwrite().save(str(tmp_path / "model"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "model"))
    held = rows.where("capture_id >= 42")
    out = models.classify_learned(again, held.drop("label")).join(held.select("capture_id", "label"), "capture_id").collect()
    assert np.mean([r.ml_label == r.label for r in out]) >= 0.9
    assert all(r.ml_confidence <= models.MAX_CONFIDENCE for r in out)


def test_blocks_bound_rows(spark, folder):
    _, z = folder
    df = spark.createDataFrame([("a", "iq", "complex64", "little", bytearray(z.astype("<c8").tobytes()))], "capture_id string, kind string, iq_format string, endian string, content binary")
    blocks = captures.read_blocks(df, 100)
    assert sorted(r.block_no for r in blocks.collect()) == list(range(6))
    assert to_blocks(to_samples(blocks), 600).count() == 1
