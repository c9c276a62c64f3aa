"""Byte-level BPE against the tiktoken library, and exact round trips."""

from __future__ import annotations

import hashlib
import sys

import pytest
from pyspark.sql import functions as F

from tonelake.llm import byte_bpe, queries

SCHEMA = "capture_id long, message_utf8 string, n_tokens string"

TEXTS = [
    "",
    None,
    "  two  spaces\tand\n\n lines \r\n",
    "naïve café 北京 12345 x² ½ ٣ 🙂🙂 👩‍👩‍👧 ​ end",
    "<|endoftext|> isn't special, they'll we've I'd",
    "a" * 5000,
    "ab" * 3000 + " " * 3000,
    "\x00\x01\x1c\x1d\x1e\x1f\x7f\x85  ﻿",
    "a\x1cb\x1d c\x1e\x1ed\x85e᠎f",
]


@pytest.fixture(scope="module")
def vocabulary():
    return queries.vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    ranks, pattern = vocabulary
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})


def packed(library, text):
    return b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text or ""))


def test_edge_texts_match_the_library(spark, vocabulary, library):
    ranks, pattern = vocabulary
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(2, TEXTS[2], "clash"), (None, "no id", None)]
    encoded = byte_bpe.encode_payloads(spark.createDataFrame(rows, SCHEMA), ranks, pattern)
    got = byte_bpe.decode_payloads(encoded, ranks).collect()
    assert len(got) == len(rows)
    for row, (key, text, _) in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert row["capture_id"] == key
        assert bytes(row["token_ids"]) == packed(library, text)
        assert row["n_tokens"] == len(row["token_ids"]) // 4
        assert bytes(row["message_bytes"]) == (text or "").encode()
    at_once = byte_bpe.encode_payloads(spark.createDataFrame(rows, SCHEMA), ranks, pattern, decoded=True).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, got))


def test_every_character_is_cut_as_the_library_cuts_it(vocabulary, library):
    import regex

    ranks, pattern = vocabulary
    encoder, cut = byte_bpe.PretokenEncoder(byte_bpe.read_ranks(ranks)), regex.compile(pattern)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for start in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}{chr(c)}\n" for c in points[start : start + 64])
        if encoder.encode(cut.findall(text)) != packed(library, text):
            wrong += [
                c for c in points[start : start + 64]
                if encoder.encode(cut.findall(f"a{chr(c)}1 {chr(c)}{chr(c)}\n")) != packed(library, f"a{chr(c)}1 {chr(c)}{chr(c)}\n")
            ]
    assert [hex(c) for c in wrong] == []


def test_long_texts_in_parts(vocabulary, library, monkeypatch):
    import regex

    ranks, pattern = vocabulary
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 64)
    text = "".join(TEXTS[k] or "" for k in (2, 3, 4)) * 5
    encoder, cut = byte_bpe.PretokenEncoder(byte_bpe.read_ranks(ranks)), regex.compile(pattern)
    assert b"".join(encoder.encode(p) for p in byte_bpe._pretokens(cut, text)) == packed(library, text)


def test_missing_byte_is_an_error():
    with pytest.raises(ValueError):
        byte_bpe.PretokenEncoder({b"a": 0})


def test_empty_table(spark, vocabulary):
    ranks, pattern = vocabulary
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.decode_payloads(byte_bpe.encode_payloads(empty, ranks, pattern), ranks).collect() == []


def test_query_against_the_library(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    got = queries.op1_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for row in got:
        ids = packed(library, docs[row["doc_id"]])
        assert row["n_tokens"] == len(ids) // 4
        assert row["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((docs[row["doc_id"]] or "").encode()).hexdigest()


def test_frequent_pretokens_outlive_the_bound(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 4)
    encoder = byte_bpe.PretokenEncoder({bytes([b]): b for b in range(256)} | {b"ab": 256})
    asked = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda tokens: asked.extend(tokens) or learn(tokens))
    want = b"".join(n.to_bytes(4, "little") for n in (256, 99))
    for k in range(20):
        assert encoder.encode(["abc", f"x{k}"])[:8] == want
    assert asked.count("abc") == 1 and len(encoder.known) + len(encoder.older) <= 8
