"""Merkle fingerprints against direct comparison of the texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from tonelake.llm import fingerprints as fp
from tonelake.llm import queries

SCHEMA = "capture_id long, message_utf8 string, root string, part string"


def check(rows, got):
    ordered = sorted(rows, key=lambda r: -r[0])
    for k, (key, text) in enumerate(ordered):
        text, other = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + other[:half]
        r = got[key]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["root"] == r["edited_root"]) == (new == text)
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["near_edited"] == 1.0) == (new == text)
        for near, second in ((r["near_edited"], new), (r["near_next"], other)):
            assert abs(near - plain_likeness(text, second)) < 1e-12
        data, lacking = text.encode(), b"".join(text.encode()[c["start"] : c["end"]] for c in r["changes"])
        want = pieces_of(text)
        want.subtract(pieces_of(new))
        assert len(lacking) == sum(len(p) * n for p, n in want.items() if n > 0)
        assert all(0 <= c["start"] < c["end"] <= len(data) for c in r["changes"])


def pieces_of(text):
    """The leaves of a text as plain substrings."""
    data, at, found = text.encode(), 0, Counter()
    for length in fp.build(text).lengths.tolist():
        found[data[at : at + length]] += 1
        at += length
    assert at == len(data)
    return found


def plain_likeness(one, two):
    if one == two:
        return 1.0
    both = pieces_of(one) & pieces_of(two)
    return 2 * sum(len(p) * n for p, n in both.items()) / len(one.encode() + two.encode())


def test_query_against_texts(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    out = queries.op10_fingerprints(spark, sf_dir).collect()
    assert len(out) == len(rows)
    full = fp.fingerprint_edits(queries.payloads(queries.table(spark, sf_dir, "documents"))).collect()
    check(rows, {r["capture_id"]: r for r in full})
    long = [r for r in out if r["n_chars"] > 1000]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.35
    root, text = {}, dict(rows)
    for r in out:
        assert root.setdefault(r["fingerprint"], text[r["doc_id"]]) == text[r["doc_id"]]


def test_edge_rows(spark):
    rows = [(5, None), (4, ""), (3, "a"), (2, "é\n\nü 🙂" * 9), (1, "one line without an end " * 20_000), (0, "\n\n\n")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = {r["capture_id"]: r for r in fp.fingerprint_edits(table).collect()}
    check(rows, got)
    assert got[5]["root"] == got[4]["root"] and got[5]["near_next"] == 1.0
    one = spark.createDataFrame([(9, "a text of its own", "", "")], SCHEMA)
    assert [r["near_next"] for r in fp.fingerprint_edits(one).collect()] == [1.0]
    same = [(1, "same"), (1, "same"), (None, "x"), (None, "y")]
    repeated = fp.fingerprint_edits(spark.createDataFrame([(*r, "", "") for r in same], SCHEMA)).collect()
    assert sorted(r["capture_id"] or 0 for r in repeated) == [0, 0, 1, 1]
    assert fp.fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_edits_stay_local():
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(12)) for _ in range(200)]
    a = fp.build("\n".join(lines))
    lines[120] = "changed " + lines[120]
    b = fp.build("\n".join(lines))
    assert a.root != b.root
    assert sum(x != y for x, y in zip(a.paragraphs, b.paragraphs, strict=True)) == 1
    assert len(set(a.sections) - set(b.sections)) <= 2
    assert fp.likeness(a, b) > 0.99
    _, other = fp.differing(a, b)
    start = len("\n".join(lines[:120])) + 1
    assert fp.changed_ranges(b, other)[0][0] == start
    lines[20] += " more"
    del lines[60:63]
    both = fp.changed_ranges(a, fp.differing(a, fp.build("\n".join(lines)))[0])
    assert len(both) >= 2  # all edits are told, not the first only
    assert fp.likeness(a, fp.build("nothing of the kind")) == 0.0


def test_slices_of_long_texts_leave_no_trace(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \né🙂") for _ in range(n)) for n in (1, 7, 63, 64, 65, 500, 3000)]
    texts += ["x" * 1000, "one long line " * 300, "\n" * 200]
    whole = [fp.build(t) for t in texts]
    monkeypatch.setattr(fp, "SLICE", 64)
    for tree, text in zip(whole, texts, strict=True):
        sliced = fp.build(text)
        assert sliced.root == tree.root and np.array_equal(sliced.pieces, tree.pieces) and np.array_equal(sliced.lengths, tree.lengths)
        assert sliced.section_ends == tree.section_ends and np.array_equal(sliced.paragraph_ends, tree.paragraph_ends)


def test_matches_by_counts():
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(12))]
        b = [rng.randrange(6) for _ in range(rng.randrange(12))]
        assert fp._unmatched_hashes(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == fp._unmatched(a, b)
