"""The conditional random field: recursions against all label sequences, accuracy, edge cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tonelake.llm import language_crf as crf
from tonelake.llm import queries

SCHEMA = "capture_id long, message_utf8 string, language string, score string"


def test_marginals_against_all_sequences():
    rng = np.random.default_rng(5)
    lengths = np.array([4, 4, 2, 1])
    emissions, move, start = rng.normal(size=(4, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    place, pairs, total = crf.marginals(emissions, move, start, lengths)
    want, want_pairs, logs = np.zeros_like(place), np.zeros((3, 3)), 0.0
    for b, n in enumerate(lengths):
        paths = list(itertools.product(range(3), repeat=int(n)))
        weight = np.exp([
            start[p[0]] + sum(emissions[t, b, p[t]] for t in range(n)) + sum(move[p[t], p[t + 1]] for t in range(n - 1)) for p in paths
        ])
        logs += np.log(weight.sum())
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for t in range(n):
                want[t, b, p[t]] += w
            for t in range(n - 1):
                want_pairs[p[t], p[t + 1]] += w
    assert np.allclose(place, want) and np.allclose(pairs, want_pairs) and np.isclose(total, logs)


@pytest.fixture(scope="module")
def field():
    a, b = "das haus und der garten ist schön".split() * 3, "the house and the garden was lovely".split() * 3
    return crf.fit_field([a, b] * 10, ["de", "en"] * 10)


def test_words_of_a_mixed_text(field):
    words = "the garden was schön und der haus ist the house".split()
    table = field.scores(words)
    place, _, _ = crf.marginals(table[:, None, :].astype(float), field.transitions, field.start, np.array([len(words)]))
    assert place[:, 0].argmax(axis=1).tolist() == [1, 1, 1, 0, 0, 0, 0, 0, 1, 1]


@pytest.mark.parametrize("length", [2, 3, 10, 97, 1000, 4000])
def test_stretches_of_a_long_text_agree_with_the_whole(monkeypatch, length):
    rng = np.random.default_rng(length)
    table = rng.normal(size=(50, 3)) * 3
    words = rng.integers(0, 50, length)
    field = crf.Field(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), {})
    place, _, _ = crf.marginals(table[words][:, None, :], field.transitions, field.start, np.array([length]))
    for group in (1, 100, 400_000):
        monkeypatch.setattr(crf, "GROUP_WORDS", group)
        assert np.allclose(crf.long_shares(field, words, table), place.sum(axis=(0, 1)) / length, atol=1e-10)
    monkeypatch.setattr(crf, "LONG_WORDS", 1)
    assert np.allclose(crf.label_texts(field, [words, words[:1]], table)[0], place.sum(axis=(0, 1)) / length)


def test_slices_of_long_texts(monkeypatch):
    text = "Eins zwei ΣΑΣ " * 50 + "x" * 300
    monkeypatch.setattr(crf, "SLICE", 20)
    parts = list(crf._slices(text))
    assert "".join(parts) == text.lower() and len(parts) > 20


def test_groups_of_any_size_agree(field, monkeypatch):
    table = field.scores(["the", "haus", "garten", "was"])
    texts = [[0, 1, 2], [], [3] * 50, [1], [2, 2, 0, 0, 3]]
    whole = crf.label_texts(field, texts, table)
    monkeypatch.setattr(crf, "GROUP_WORDS", 1)
    assert np.allclose(whole, crf.label_texts(field, texts, table))


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op4_language_crf(spark, folder).join(queries.table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    pdf = out.where("lang_pred <> 'und'").toPandas()
    held = pdf[pdf["held_out"]]
    assert len(held) > 200 and pdf["score"].between(0, 1).all()
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97


def test_fit_reads_whole_texts(spark, monkeypatch):
    fit, seen = crf.fit_field, []

    def watched(texts, labels):
        seen.append(dict(zip(labels, texts, strict=True)))
        return fit(texts, labels)

    monkeypatch.setattr(crf, "fit_field", watched)
    late = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ar", "el", "in", "ot", "un")]
    rows = [(1, "haus garten " * 1000 + " ".join(late)), (2, "the house " * 1000)]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    crf.label_languages(table, spark.createDataFrame([(1, "de"), (2, "en")], "capture_id long, language string"))
    assert seen[0]["de"] == rows[0][1].split() and len(seen[0]["en"]) == 2000


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "12 -- 34"), (4, "the house"), (4, "the house"), (None, "haus und garten"), (5, "x" * 50_000), (6, "½ ²")]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(4, "en"), (5, "xx"), (1, "fr"), (2, None), (None, "de"), (99, "de")], "capture_id long, language string")
    got = crf.label_languages(table, labels).collect()
    assert len(got) == len(rows)
    by_id = {r["capture_id"]: r for r in got}
    assert all(by_id[k]["language"] == "und" and by_id[k]["score"] == 0.0 for k in (1, 2, 3, 6))
    assert by_id[4]["language"] == "en" and by_id[4]["n_words"] == 2 and by_id[5]["language"] == "xx"
    assert {r["language"] for r in crf.label_languages(table, labels.limit(0)).collect()} == {"und"}
    assert crf.label_languages(table.limit(0), labels).collect() == []
