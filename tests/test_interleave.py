"""Streams in chunks against whole streams, and checksums of batches against the standard library."""

from __future__ import annotations

import binascii
import random

import numpy as np
import pandas as pd
import pytest

from tonelake.functions import bits as B
from tonelake.operators import frames, interleave, sync
from tonelake.plans.catalog import load

CHUNK = interleave.UNIT_BITS


@pytest.fixture(scope="module")
def streams(spark):
    rng = random.Random(3)
    rows = []
    for k, size in enumerate([1, 3, 4, 12, 31, 32, 95, 96, 97, 99, 100, 191, 192, 193, 384, 390, 1000, 4099]):
        data = bytes(rng.randrange(256) for _ in range(size))
        if k % 3 == 0:
            data += binascii.crc_hqx(data, 0xFFFF).to_bytes(2, "big")
        if k % 4 == 1:
            data += b"\0" * (k * 7)
        rows.append((k, bytearray(data)))
    rows += [(50, bytearray()), (51, bytearray(b"\0" * 300))]
    return spark.createDataFrame(rows, "capture_id long, data binary").cache()


@pytest.mark.parametrize("name", frames.INTERLEAVERS)
@pytest.mark.parametrize("chunk_bits", [CHUNK, 2 * CHUNK, 64 * CHUNK])
def test_chunks_give_what_whole_streams_give(streams, name, chunk_bits):
    chunks = interleave.to_chunks(streams, chunk_bits)
    got = interleave.from_chunks(interleave.deinterleave_chunks(chunks, name, chunk_bits)).collect()
    want = {r["capture_id"]: bytes(r["data"]) for r in frames.deinterleave(streams, (name,)).collect() if r["data"]}
    assert {r["capture_id"]: bytes(r["data"]) for r in got} == want


@pytest.mark.parametrize("chunk_bits", [CHUNK, 8 * CHUNK])
def test_checksums_of_chunks(streams, chunk_bits):
    chunks = interleave.to_chunks(streams, chunk_bits)
    for name in ("none", "block", "convolutional"):
        got = {r[0]: (r[1], r[2]) for r in interleave.crc_scan_chunks(interleave.deinterleave_chunks(chunks, name, chunk_bits), chunk_bits).collect()}
        whole = frames.crc_scan(frames.deinterleave(streams, (name,)), 1, frames.SEARCH_WINDOW).collect()
        want = {r["capture_id"]: (len(r["payload"]) if r["crc_pass"] else None, r["trials"]) for r in whole if r["capture_id"] != 50}
        assert got == want, name


def framed_under(name, payload):
    """A stream whose de-interleaved form starts with ``payload`` and its checksum."""
    framed = payload + binascii.crc_hqx(payload, 0xFFFF).to_bytes(2, "big")
    bits = np.unpackbits(np.frombuffer(framed, np.uint8))
    source = frames.source_positions(name, len(bits))
    padded = np.zeros(len(source), np.uint8)
    padded[: len(bits)] = bits
    stream = np.zeros(len(source), np.uint8)
    stream[source] = padded
    return np.packbits(stream).tobytes()


def test_search_stops_at_the_first_hypothesis_that_holds(spark):
    rng = random.Random(8)
    rows = []
    for k, name in enumerate(frames.INTERLEAVERS):
        payload = bytes(rng.randrange(1, 256) for _ in range(382))  # with its checksum four whole chunks
        rows.append((k, bytearray(framed_under(name, payload))))
    rows += [(20, bytearray(b"noise without a frame" * 20)), (21, bytearray(b"abc")), (22, bytearray(b"\1" * 100))]
    streams = spark.createDataFrame(rows, "capture_id long, data binary")
    got = {r["capture_id"]: r for r in interleave.search_chunks(interleave.to_chunks(streams, CHUNK), chunk_bits=CHUNK).collect()}
    whole = {r["capture_id"]: r for r in frames.search(streams).collect()}
    for k, name in enumerate(frames.INTERLEAVERS):
        assert (got[k]["interleaver"], got[k]["payload_len"], got[k]["n_attempts"]) == (name, 382, k + 1)
    for k, row in whole.items():
        assert (got[k]["validated"], got[k]["interleaver"], got[k]["n_attempts"], got[k]["crc_trials"]) == (
            row["validated"], row["interleaver"], row["n_attempts"], row["crc_trials"])
        assert got[k]["payload_len"] == (len(row["payload"]) if row["payload"] is not None else None)


def test_a_stream_of_many_chunks(spark):
    """About two million bits in chunks of 768: no row holds more than a chunk."""
    rng = np.random.default_rng(2)
    payload = rng.integers(0, 256, 250_000, dtype=np.uint8).tobytes()
    stream = spark.createDataFrame([(1, bytearray(framed_under("convolutional", payload)))], "capture_id long, data binary")
    chunks = interleave.to_chunks(stream, 64 * CHUNK).cache()
    assert chunks.count() == -(-8 * 250_002 // (64 * CHUNK))
    (row,) = interleave.search_chunks(chunks, chunk_bits=64 * CHUNK).collect()
    assert (row["interleaver"], row["payload_len"], row["n_attempts"]) == ("convolutional", 250_000, 3)


def test_checksums_of_batches():
    rng = random.Random(1)
    buffers = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 255, 256, 257, 511, 512, 513, 5000, *range(20)]]
    assert B.crc16_many(buffers).tolist() == [binascii.crc_hqx(b, 0xFFFF) for b in buffers]
    assert B.crc16_many([b"123456789"]).tolist() == [0x29B1] and B.crc16_many([]).tolist() == []
    state = binascii.crc_hqx(b"head", 0xFFFF)
    assert interleave.moved_on(state, 1000) == binascii.crc_hqx(b"head" + b"\0" * 1000, 0xFFFF)


def test_words_across_slices(spark, monkeypatch):
    monkeypatch.setattr(sync, "SLICE_BITS", 64)
    rng = random.Random(7)
    data = bytearray(rng.randrange(256) for _ in range(400))
    data[200:204] = bytes.fromhex("1ACFFC1D")
    shifted = bytes((int.from_bytes(data, "big") >> 3).to_bytes(400, "big"))
    rows = [(1, bytearray(data)), (2, bytearray(shifted)), (3, bytearray(b"\x1a\xcf")), (4, bytearray(data[:204]))]
    found = sync.find_header(sync.whole_frames(spark.createDataFrame(rows, "capture_id long, data binary")), "0x1ACFFC1D")
    got = {r["capture_id"]: (r["offset"], r["detected"]) for r in found.collect()}
    assert got == {1: (1600, True), 2: (1603, True), 3: (-1, False), 4: (1600, True)}


def test_bytes_are_summed_in_their_row(spark, sf_dir, monkeypatch):
    for name in ("A24_deinterleave_in_chunks", "J11_deinterleave_hypotheses"):
        plan = load()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan, name
    monkeypatch.setattr(B, "_SUMMED", 7)
    parts = [None, b"", b"\0", b"\xff" * 30, bytes(range(256))]
    want = [(len(d), sum(d), sum((k + 1) * v for k, v in enumerate(d))) for d in (p or b"" for p in parts)]
    assert list(B.byte_sums.func(pd.Series(parts)).itertuples(index=False, name=None)) == want


def test_heads_of_chunks_leave_with_their_chunks(streams):
    """The chunks are made once for the convolutional map, not once more for the bytes their neighbours need."""
    chunks = interleave.to_chunks(streams, CHUNK)
    plan = interleave.deinterleave_chunks(chunks, "convolutional", CHUNK)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Union" not in plan
