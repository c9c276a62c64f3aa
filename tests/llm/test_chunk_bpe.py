"""Byte-level BPE with shared chunks against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import chunk_bpe, queries

SCHEMA = "capture_id long, message_utf8 string, n_tokens string, packed string"

PASSAGE = "The receiver locks on the carrier, then slices bits. Ünïcode 北京 it's they'll   wait\n" * 40
TEXTS = [
    "",
    None,
    "  two  spaces\tand\n\n lines \r\n",
    "naïve café 北京 12345 x² ½ ٣ 🙂🙂 👩‍👩‍👧 ​ end",
    "<|endoftext|> isn't special, they'll <|endoftext|><|endoftext|>  <|endof text|>",
    "a" * 40_000,
    "ab" * 3000 + " " * 30_000 + "x",
    "\x00\x01\x1c\x1d\x1e\x1f\x7f\x85  ﻿",
    PASSAGE,
    "head " + PASSAGE + " tail",
    PASSAGE + "<|endoftext|>" + PASSAGE,
    "字" * 30_000,
]


@pytest.fixture(scope="module")
def definition():
    return queries.tokenizer_file()


@pytest.fixture(scope="module")
def library(definition):
    import tokenizers

    own = tokenizers.Tokenizer.from_str(definition)
    own.no_truncation()
    own.no_padding()
    return own


def packed(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def encoded(spark, rows, definition):
    return chunk_bpe.decode_payloads(chunk_bpe.encode_payloads(spark.createDataFrame(rows, SCHEMA), definition), definition)


def test_edge_texts_match_the_library(spark, definition, library):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(TEXTS)]
    rows += [(8, PASSAGE, "clash", None), (None, PASSAGE, None, None), (None, None, None, None)]
    got = encoded(spark, rows, definition).collect()
    want = sorted((-1 if k is None else k, packed(library, t), (t or "").encode()) for k, t, *_ in rows)
    assert sorted((-1 if r[0] is None else r[0], bytes(r[2]), bytes(r[3])) for r in got) == want
    assert all(r["n_tokens"] == len(r["token_ids"]) // 4 for r in got)
    at_once = chunk_bpe.encode_payloads(spark.createDataFrame(rows, SCHEMA), definition, decoded=True).collect()
    assert sorted((-1 if r[0] is None else r[0], bytes(r[2]), bytes(r[3])) for r in at_once) == want


def test_joins_are_exact_wherever_a_text_is_cut(definition, library):
    tokenizer = chunk_bpe.Tokenizer(definition)
    letters = ["a", "b", "'", "r", "e", "s", " ", "  ", "\n", "1", "é", "字", "🙂", "<|endoftext|>", "<|", "endof", "text|>", "the", " the", "!"]
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randint(1, 60)))
        places = sorted({0, *(rng.randrange(len(text)) for _ in range(rng.randint(0, 5)))})
        pieces = [text[a:b].encode() for a, b in zip(places, [*places[1:], len(text)])]
        starts = np.cumsum([0, *map(len, pieces[:-1])]).tolist()
        parts = [(s, *e) for s, e in zip(starts, tokenizer.encode(pieces))]
        ids = chunk_bpe.join_stretches(tokenizer, text.encode(), parts)
        assert ids.astype("<u4").tobytes() == packed(library, text), (text, places)


def test_broken_bytes_decode_as_the_library_decodes_them(definition, library):
    spelled = chunk_bpe.token_bytes(json.loads(definition))
    rng = np.random.default_rng(3)
    for _ in range(300):
        ids = rng.integers(0, len(spelled), rng.integers(0, 12))
        assert chunk_bpe.decode(spelled, ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_every_character_is_encoded_as_the_library_does(definition, library):
    tokenizer = chunk_bpe.Tokenizer(definition)
    codes = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(codes), 2048):
        text = "".join("a{0}1{0}{0} {0}.{0}\n".format(chr(c)) for c in codes[k : k + 2048])
        ids, first = tokenizer.encode([text.encode()])[0]
        encoding = library.encode(text, add_special_tokens=False)
        assert ids.tolist() == encoding.ids
        words = encoding.word_ids
        assert first.tolist() == [i == 0 or w != words[i - 1] for i, w in enumerate(words)]


def test_chunks_follow_content_and_cover_the_text():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}ä" for _ in range(20_000)]
    data = " ".join(words).encode()
    ends = chunk_bpe.cuts(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert all(data[e : e + 1] == b"" or data[e] & 0xC0 != 0x80 for e in ends)
    chunks = {data[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"something before " + data
    also = [moved[a:b] for a, b in zip([0, *chunk_bpe.cuts(moved)], chunk_bpe.cuts(moved))]
    assert sum(c in chunks for c in also) > 0.95 * len(also)
    # Long texts are hashed in slices; the slices leave no trace.
    assert chunk_bpe.cuts(data * 20)[: len(ends) - 2] == ends[:-2]
    assert max(np.diff(chunk_bpe.cuts(b"x" * 100_000))) <= chunk_bpe.MOST


def test_shared_chunks_are_encoded_once(spark, definition):
    rng = random.Random(2)
    common = " ".join(f"v{rng.randrange(10**6)}" for _ in range(3000))
    rows = [(k, f"{k} {common} {k}", None, None) for k in range(30)]
    source = spark.createDataFrame(rows, SCHEMA).select("capture_id", "message_utf8")
    refs = chunk_bpe._chunk_refs(source)
    per_text = refs.count() / 30
    shared = refs.groupBy("d1", "d2").agg(F.countDistinct("k1").alias("texts")).where("texts = 30").count()
    assert shared >= per_text - 3


def test_empty_table_and_other_vocabularies(spark, definition):
    assert encoded(spark, [], definition).count() == 0
    with pytest.raises(ValueError):
        chunk_bpe.Tokenizer(definition.replace('"normalizer":null', '"normalizer":{"type":"NFC"}').replace('"normalizer": null', '"normalizer": {"type":"NFC"}'))


def test_query_on_the_small_tables(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in queries.op13_chunk_bpe(spark, sf_dir).collect()}
    rows = queries.table(spark, sf_dir, "documents").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = packed(library, row["text"])
        text = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        mine = got[row["doc_id"]]
        assert (mine["n_tokens"], mine["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert mine["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_frequent_pretokens_outlive_the_bound(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as definition:
        tokenizer = chunk_bpe.Tokenizer(definition.read())
    monkeypatch.setattr(chunk_bpe, "REMEMBERED", 6)
    whole = [tokenizer.library.encode(f"often x{k}", add_special_tokens=False).ids for k in range(12)]
    found, older = [], 0
    for k in range(12):
        found.append(tokenizer.encode([f"often x{k}".encode()])[0][0].tolist())
        older += "often" in tokenizer.older
    assert found == whole and older and len(tokenizer.known) + len(tokenizer.older) <= 6


def test_ascii_texts_are_cut_as_the_library_does(definition, library):
    tokenizer = chunk_bpe.Tokenizer(definition)
    rng = random.Random(7)
    letters = [*map(chr, range(128)), *"  \n'", "'re", "it's", " the"]
    texts = ["a{0}1{0}{0} {0}.{0}\n".format(chr(c)) for c in range(128)]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(1500)]
    for text, (ids, first) in zip(texts, tokenizer.encode([t.encode() for t in texts])):
        encoding = library.encode(text, add_special_tokens=False)
        words = encoding.word_ids
        assert ids.tolist() == encoding.ids, text
        assert first.tolist() == [i == 0 or w != words[i - 1] for i, w in enumerate(words)], text


def test_pretokens_met_again_are_not_encoded_again(definition):
    tokenizer = chunk_bpe.Tokenizer(definition)
    asked = []

    class Counted:
        def __init__(self, model):
            self.tokenize = lambda spelled: asked.append(spelled) or model.tokenize(spelled)

    tokenizer.model = Counted(tokenizer.model)
    texts = [" ".join(f"{'abcdefghij'[k % 10]}{k}" for k in range(start, start + 1000)).encode() for start in range(0, 70_000, 1000)]
    once = tokenizer.encode(texts)
    distinct = len(asked)
    again = tokenizer.encode(texts)
    assert len(asked) == distinct == len(set(asked))
    assert all(np.array_equal(a[0], b[0]) for a, b in zip(once, again))


def test_long_pretokens_are_encoded_but_not_remembered(definition, library):
    tokenizer = chunk_bpe.Tokenizer(definition)
    text = "short " + "xyzzy" * 1000 + " " * 500 + "end"
    assert tokenizer.encode([text.encode()])[0][0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert set(tokenizer.known) == {"short", " end"}


def test_tasks_of_a_worker_share_a_tokenizer(definition):
    assert chunk_bpe._tokenizer(definition) is chunk_bpe._tokenizer(str(definition.encode(), "utf-8"))
