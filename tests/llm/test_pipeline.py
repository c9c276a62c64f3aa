"""The pipeline stage by stage against plain Python, and on awkward rows."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline as cp
import pytest

from tonelake.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, record string, capture_id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [tuple(r) for r in df.select(*cp.COLUMNS).collect()]


def test_stages_on_given_tables(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    before = {r[0]: r for r in rows_of(docs)}

    kept = cp.pin(cp.drop_toxic(spark, docs, sf_dir))
    toxic = {r["doc_id"] for r in queries.op5_toxicity(spark, sf_dir).where("toxic").collect()}
    assert sorted(rows_of(kept)) == sorted(r for r in before.values() if r[0] not in toxic)

    good = cp.pin(cp.drop_low_quality(spark, kept, sf_dir))
    judged = cp.quality_rules.judge_payloads(queries.payloads(kept)).where("kept")
    assert sorted(rows_of(good)) == sorted(before[r["capture_id"]] for r in judged.collect())

    single = cp.pin(cp.drop_near_duplicates(spark, good, sf_dir))
    texts = sorted((r[0], r[1]) for r in rows_of(good))
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in texts if (w := t.encode().lower().split())}
    root = {k: k for k in before}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(rows_of(single)) == sorted(before[k] for k, _ in texts if find(k) == k)

    mixed = cp.pin(cp.mix_sources(spark, single, sf_dir))
    captures = single.selectExpr("doc_id AS capture_id", "source AS modulation", "text AS message_utf8")
    total = sum(len(WORD.findall(t)) for _, t, *_ in rows_of(mixed))
    size = sum(len(WORD.findall(t)) for _, t, *_ in rows_of(single))
    assert abs(total - size) <= 0.02 * size + 64 * captures.select("modulation").distinct().count()
    for doc_id, text, _, source, n_chars in rows_of(mixed):
        origin = WORD.findall(before[doc_id][1])
        words = WORD.findall(text)
        assert n_chars == len(text) and source == before[doc_id][3] and len(words) <= len(origin)
        if len(words) == len(origin):
            assert before[doc_id][1].startswith(text)

    out = cp.encode(spark, mixed, sf_dir).collect()
    assert sorted(r["decoded_sha256"] for r in out) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t, *_ in rows_of(mixed))
    assert len(cp.run(spark, sf_dir).collect()) == len(out)


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_awkward_rows(spark, sf_dir, name, stage):
    text = "plain words of a calm text that goes on for a while and then some more of it to the end. "
    rows = [
        (1, text, "en", "a", 10), (1, text, "en", "a", 10), (1, "other " + text, None, None, None), (None, text[::-1], "en", "a", 1),
        (None, None, None, None, None), (2, "", "en", "b", 0), (3, " \n ", "en", "b", 3), (4, "x" * 100_000, "en", "b", 5),
    ]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    out = stage(spark, docs, sf_dir)
    assert out.columns == cp.COLUMNS or name == "byte_bpe"
    got = out.collect()
    if name == "toxicity":
        assert len(got) == len(rows)
    if name == "jaccard_join":
        assert len(got) == len(rows) - 2  # the repeated row and one of two near copies
    if name == "byte_bpe":
        assert len(got) == len(rows)
    assert stage(spark, docs.limit(0), sf_dir).collect() == []
