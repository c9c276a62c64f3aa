"""Bits, checksums, interleavers, sync search: known answers and brute force."""

from __future__ import annotations

import binascii

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonelake.functions import bits as B
from tonelake.operators import frames, payload, sync


def payload_frame(spark, rows):
    return spark.createDataFrame(rows, "capture_id string, data binary")


def test_byte_values_cover_every_byte(spark):
    data = bytes(range(256))
    rows = payload_frame(spark, [("a", bytearray(data)), ("e", bytearray(b""))])
    out = {r.capture_id: r.v for r in rows.select("capture_id", B.byte_values(F.col("data")).alias("v")).collect()}
    assert out["a"] == list(data) and out["e"] == []


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 3000])
def test_prefix_checksums(size):
    buf = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    got = B.crc16_prefixes([buf, b"123456789"])
    assert [int(v) for v in got[0]] == [binascii.crc_hqx(buf[:k], 0xFFFF) for k in range(size + 1)]
    assert int(got[1][-1]) == 0x29B1


def test_scan_prefers_the_shortest_frame(spark):
    body = b"a framed message"
    framed = body + binascii.crc_hqx(body, 0xFFFF).to_bytes(2, "big")
    rows = [("plain", framed), ("padded", framed + b"\0" * 20), ("tail", framed + b"\x01\x02\x03"), ("none", body)]
    out = frames.crc_scan(payload_frame(spark, [(k, bytearray(v)) for k, v in rows]), min_payload=4, window=32)
    found = {r.capture_id: (r.crc_pass, bytes(r.payload) if r.payload else None) for r in out.collect()}
    for key in ("plain", "padded", "tail"):
        assert found[key] == (True, body)
    assert found["none"][0] is False


@pytest.mark.parametrize("name", frames.INTERLEAVERS)
def test_source_positions_are_permutations(name):
    for n_bits in (8, 96, 1000, 4096):
        source = frames.source_positions(name, n_bits)
        assert sorted(source) == list(range(source.size)) and source.size >= n_bits


def test_search_recovers_every_interleaver(spark):
    rng = np.random.default_rng(15)
    rows, want = [], {}
    for name in frames.INTERLEAVERS:
        size = {"pseudo-random": 62, "pseudo-random-block": 62}.get(name, 94)
        body = rng.integers(32, 127, size, dtype=np.uint8).tobytes()
        framed = body + binascii.crc_hqx(body, 0xFFFF).to_bytes(2, "big")
        bits = np.unpackbits(np.frombuffer(framed, dtype=np.uint8))
        sent = np.zeros_like(bits)
        source = frames.source_positions(name, bits.size)
        assert source.size == bits.size
        sent[source] = bits
        rows.append((name, bytearray(np.packbits(sent).tobytes())))
        want[name] = body
    rows.append(("short", bytearray(b"ab")))
    out = {r.capture_id: r for r in frames.search(payload_frame(spark, rows)).collect()}
    for name, body in want.items():
        assert out[name].validated and out[name].interleaver == name and bytes(out[name].payload) == body
        assert out[name].n_attempts == frames.INTERLEAVERS.index(name) + 1
    assert not out["short"].validated and out["short"].n_attempts == 0


def test_code_screen_finds_the_encoder(spark):
    rng = np.random.default_rng(8)
    rows = []
    for name, length, generators in frames.CODES:
        source = np.concatenate([rng.integers(0, 2, 400), np.zeros(length - 1, dtype=int)])
        outs = []
        for g in generators:
            taps = [d for d in range(length) if int(g, 8) >> (length - 1 - d) & 1]
            outs.append(sum(np.concatenate([np.zeros(d, dtype=int), source[: source.size - d]]) for d in taps) % 2)
        coded = np.stack(outs, axis=1).ravel().astype(np.uint8)
        coded = coded[: coded.size // 8 * 8]
        rows.append((name, bytearray(np.packbits(coded).tobytes())))
    out = frames.code_screen(payload_frame(spark, rows), names=("none",), top_k=1).collect()
    assert {r.capture_id: r.code for r in out} == {name: name for name, _, _ in frames.CODES}
    assert all(r.syndrome == 0.0 and r.plausible for r in out)


@pytest.mark.parametrize(
    ("length", "positions", "want"), [(32, 1_001, 28), (32, 499_969, 31), (16, 50_000, 16), (8, 94, 8), (32, 0, 32)]
)
def test_match_floor(spark, length, positions, want):
    row = spark.range(1).select(sync.min_matches(length, F.lit(positions)).alias("k")).first()
    assert row.k == want


@pytest.mark.parametrize("frame_bits", [64, 1 << 12])
def test_planted_header_across_frames(spark, frame_bits):
    rng = np.random.default_rng(6)
    word = sync.parse_word("0x1ACFFC1D")
    for at in (0, 50, 100, 777):
        bits = rng.integers(0, 2, 1000)
        bits[at : at + 32] = word
        df = spark.createDataFrame(pd.DataFrame({"capture_id": "a", "pos": np.arange(1000), "bit": bits}))
        row = sync.find_header(B.pack_frames(df, frame_bits, 32), "0x1ACFFC1D").first()
        assert (row.offset, row.score, row.detected, row.positions) == (at, 1.0, True, 969)


def test_long_words_and_bad_words(spark):
    rng = np.random.default_rng(7)
    word = "0x" + "".join(f"{v:x}" for v in rng.integers(0, 16, 25))
    bits = rng.integers(0, 2, 4000)
    bits[1234 : 1234 + 100] = sync.parse_word(word)
    data = bytearray(np.packbits(bits).tobytes())
    row = sync.find_header(sync.whole_frames(payload_frame(spark, [("a", data)])), word).first()
    assert (row.offset, row.sync_length, row.detected) == (1234, 100, True)
    tried = {r.sync_word: r for r in sync.correlate(sync.whole_frames(payload_frame(spark, [("b", bytearray(b"ab"))])), [word, "zz"]).collect()}
    assert "shorter" in tried[word].error and tried[word].offset == -1
    assert "unparseable" in tried["zz"].error


def test_hexdump_format(spark):
    row = payload.describe(payload_frame(spark, [("a", bytearray(b"Hello\tWorld\x00\xff0123456789"))])).first()
    assert row.hexdump[0] == "00000000  48 65 6c 6c 6f 09 57 6f 72 6c 64 00 ff 30 31 32  |Hello.World..012|"
    assert row.hexdump[1].startswith("00000010  33 34 35 36 37 38 39") and row.hexdump[1].endswith("  |3456789|")
    assert row.text_preview == "Hello\tWorld..0123456789" and row.bytes == 23
    long = payload.describe(payload_frame(spark, [("a", bytearray(b"x" * 300))])).first()
    assert long.hexdump[-1] == "... 44 more byte(s) not shown" and long.text_preview.endswith("...")
