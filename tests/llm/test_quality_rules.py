"""Quality rules against plain Python and SQL, and against the labels."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tonelake.llm import quality_rules as rules
from tonelake.llm import queries

SCHEMA = "capture_id long, message_utf8 string, n_words string, kept string"

PROSE = "the quick wave of the morning and a slow tide to the shore is what that harbour knows of rain. "
TEXTS = [
    None,
    "",
    " \n\t ",
    "nine words are one too few for the base",
    PROSE + "\n" + PROSE.upper() + "\nother line.",
    "a b c d e " * 40,
    "x\x0by\x0cz\r\nq r s　t u v w x y z",
    "é漢字 🙂 # $ % & | < > * " * 3,
    "line\nline\n\n \nline\nother",
    "one two three four five six one two three four five six seven eight nine ten eleven",
]


def counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_match_plain_python(spark):
    rows = [(k, t, "clash", "clash") for k, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], None, None), (None, PROSE * 2, "", ""), (99, "word " * 30_000 + PROSE * 3000, "", "")]
    got = rules.judge_payloads(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    of = {r[0]: r[1] for r in rows}
    for r in got:
        n, chars, symbols, dup, repeated = want = counts(of[r["capture_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)


def test_empty_table(spark):
    assert rules.judge_payloads(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_match_plain_python(spark, sf_dir):
    """The array expression against the same estimation in a loop."""
    got = rules.judge_payloads(queries.payloads(queries.table(spark, sf_dir, "documents"))).toPandas()
    names = [c for c in got.columns if c.startswith("vote_")]
    votes = [tuple(v) for v in got[names].itertuples(index=False)]
    train = Counter(v for v, failed in zip(votes, got["base_failed"], strict=True) if not failed)
    share, bad, good = 0.1, [0.4] * len(names), [0.02] * len(names)

    def posterior(v):
        x = math.log(share / (1 - share))
        for j, vote in enumerate(v):
            x += math.log(bad[j] / good[j]) if vote < 0 else math.log((1 - bad[j]) / (1 - good[j])) if vote > 0 else 0
        return 1 / (1 + math.exp(-x))

    for _ in range(rules.ROUNDS):
        p = {v: posterior(v) for v in train}
        total, wrong = sum(train.values()), sum(n * p[v] for v, n in train.items())

        def fit(j, weight, extra, bounds, p=p):
            against = sum(n * weight(p[v]) for v, n in train.items() if v[j] == -1)
            either = sum(n * weight(p[v]) for v, n in train.items() if v[j])
            return min(max((against + extra) / (either + 10), bounds[0]), bounds[1])

        share = min(max((wrong + 1) / (total + 10), rules.BAD_SHARE[0]), rules.BAD_SHARE[1])
        bad = [fit(j, lambda r: r, 4.0, rules.ON_BAD) for j in range(len(names))]
        good = [fit(j, lambda r: 1 - r, 0.2, rules.ON_GOOD) for j in range(len(names))]
    for v, p_good in zip(votes, got["p_good"], strict=True):
        assert p_good == pytest.approx(1 - posterior(v), abs=1e-9)


def test_verdicts_agree_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = queries.op2_quality_rules(spark, folder).where("NOT base_failed")
    seen = judged.join(queries.table(spark, folder, "labels"), "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("double")).alias("kept")
    )
    kept = {r["quality"]: r["kept"] for r in seen.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_query_against_sql(check_sql):
    check_sql("op2_quality_rules")
