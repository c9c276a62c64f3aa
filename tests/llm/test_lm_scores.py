"""Stupid backoff against plain Python and SQL."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tonelake.llm import lm_scores

SCHEMA = "capture_id long, message_utf8 string, score string, chunk string"


def brute(texts):
    rows = [(t or "").encode().lower().split() for t in texts]
    ones = Counter(w for r in rows for w in r)
    twos = Counter(p for r in rows for p in zip(r, r[1:], strict=False))
    total = sum(ones.values())
    out = []
    for r in rows:
        value, backed = 0.0, 0
        for k, w in enumerate(r):
            if k and twos[r[k - 1], w] >= lm_scores.LEAST:
                value += math.log(twos[r[k - 1], w] / ones[r[k - 1]])
            else:
                backed += 1
                value += math.log(ones[w] / total) + (math.log(lm_scores.BACKOFF) if k else 0)
        out.append((len(r), backed, value / len(r) if r else None))
    return out


@pytest.mark.parametrize("chunk_rows", [2048, 7])
def test_against_plain_counts(spark, chunk_rows, monkeypatch):
    monkeypatch.setattr(lm_scores, "CHUNK_ROWS", chunk_rows)
    rng = random.Random(8)
    words = ["a", "B", "b", "the", "THE", "é", "É", "rain", "stone"] + [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += [None, "", " \t\n", "single", "single", "x " * 30_000, texts[0]]
    rows = [(k, t, "clash", "clash") for k, t in enumerate(texts)]
    rows[-1] = (0, texts[0], None, None)
    rows.append((None, "no id here", None, None))
    got = lm_scores.score_payloads(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter()
    for (key, *_), (n, backed, score) in zip(rows, brute([r[1] for r in rows]), strict=True):
        want[key, n, backed, None if score is None else round(score, 9)] += 1
    assert Counter((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in got) == want


def test_empty_table(spark):
    assert lm_scores.score_payloads(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_against_sql(check_sql):
    check_sql("op6_lm_scores")
