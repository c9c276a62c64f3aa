"""Quality of payload texts by weak supervision.

Rules vote on each text: 1 for good, -1 for bad, 0 to abstain. Which votes are worth how much
is not fixed by hand: over all texts, expectation-maximisation estimates for every rule how
often it votes "bad" on bad and on good texts, and the share of bad texts. The posterior
probability of "good" under these estimates is the verdict.

Votes of R rules form at most ``3 ** R`` patterns. Expectation-maximisation needs only the
number of texts of each pattern, so the texts are counted by pattern once and the estimation
runs on that small table as one array expression. All steps are DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.scalars import clamp, let
from tonelake.session import pin

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
ROUNDS = 40
#: Where estimates may lie. A rule's "bad" must be rare on good texts and not rare on bad ones:
#: this keeps the two classes what they mean when one kind of bad text is far more frequent.
ON_BAD, ON_GOOD, BAD_SHARE = (0.2, 0.95), (0.001, 0.02), (0.01, 0.5)

#: Frequent function words of the corpus languages.
FUNCTION_WORDS = (
    "the of and to in a is that de la le les et en des der die und das den von el los que y una".split()
)


def _count(text: Column, kept: str) -> Column:
    """Characters of a class, ``kept`` being the expression for runs of all others."""
    return F.length(F.regexp_replace(text, kept, "")).cast("long")


def _repeated(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(WINDOW)]))

    def covered(at: Column) -> Column:
        following = F.slice(at, 2, F.size(at))
        gaps = F.zip_with(at, following, lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def twice(ordered: Column) -> Column:
        again = F.filter(
            ordered,
            lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]),
        )
        return F.sort_array(F.transform(again, lambda x: x["k"]))

    def places(found: Column) -> Column:
        paired = F.transform(found, lambda h, k: F.struct(h.alias("h"), k.alias("k")))
        return let(let(F.sort_array(paired), twice), covered)

    counted = let(
        hashes,
        lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(
            places(found)
        ),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(counted)


def measures(payloads: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every text; ``capture_id``, the ``carried`` columns and one column per count."""
    text = F.coalesce("message_utf8", F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct"),
            F.size(F.filter(words, lambda w: w.isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
            _repeated(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    with_words = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = payloads.select(
        "capture_id",
        *carried,
        let(F.array_remove(F.split(text, SPACE), ""), of_words).alias("w"),
        let(with_words, of_lines).alias("l"),
        _count(text, r"[^#*$%&|<>]+").alias("n_symbols"),
        _count(text, r"[^A-Z]+").alias("n_upper"),
        _count(text, r"[^!]+").alias("n_exclaim"),
        _count(text, r"[^.?!]+").alias("n_ends"),
    )
    return counted.select(
        "capture_id", *carried, "w.*", "n_symbols", "l.n_lines", "l.n_dup_lines", "n_upper", "n_exclaim", "n_ends"
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """The rules over the columns of ``measures``. Bounds are whole numbers, so that votes are exact."""
    c = F.col
    many = c("n_words") >= 20
    return {
        "symbols": _vote(c("n_symbols") * 10 > c("n_words"), c("n_symbols") * 50 <= c("n_words")),
        "symbol_density": _vote(c("n_symbols") * 20 > c("word_chars"), c("n_symbols") * 200 <= c("word_chars")),
        "repeated_lines": _vote(c("n_dup_lines") * 10 > c("n_lines") * 3, (c("n_lines") > 1) & (c("n_dup_lines") == 0)),
        "repeated_windows": _vote(c("n_repeat_words") * 5 > c("n_words"), many & (c("n_repeat_words") * 20 <= c("n_words"))),
        "word_length": _vote(
            (c("word_chars") > c("n_words") * 12) | (c("word_chars") < c("n_words") * 2),
            c("word_chars").between(c("n_words") * 3, c("n_words") * 9),
        ),
        "variety": _vote(many & (c("n_distinct") * 8 < c("n_words")), many & (c("n_distinct") * 4 >= c("n_words"))),
        "capitals": _vote(c("n_upper") * 3 > c("word_chars"), c("n_upper") * 10 <= c("word_chars")),
        "exclamations": _vote(c("n_exclaim") * 5 > c("n_words"), c("n_exclaim") * 50 <= c("n_words")),
        "sentences": _vote(
            many & (c("n_ends") * 100 < c("n_words")),
            many & (c("n_ends") * 50 >= c("n_words")) & (c("n_ends") * 2 <= c("n_words")),
        ),
        "function_words": _vote(many & (c("n_function") == 0), c("n_function") * 20 >= c("n_words")),
    }


def _posterior_bad(votes: Column, model: Column, rules: int) -> Column:
    """Probability of "bad" given the votes: naive Bayes over the rules that voted."""
    evidence = F.log(model["bad_share"] / (1 - model["bad_share"]))
    for j in range(rules):
        on_bad, on_good = F.get(model["on_bad"], F.lit(j)), F.get(model["on_good"], F.lit(j))
        vote = F.get(votes, F.lit(j))
        evidence = evidence + F.when(vote == -1, F.log(on_bad / on_good)).when(
            vote == 1, F.log((1 - on_bad) / (1 - on_good))
        ).otherwise(0.0)
    return 1 / (1 + F.exp(-evidence))


def _estimate(patterns: Column, rules: int) -> Column:
    """Expectation-maximisation over ``array<struct<votes, n>>``.

    Each estimate carries the weight of a few imagined texts that agree with the start, so
    that rules without votes, and tables without texts, keep defined values.
    """

    def model(share: Column, on_bad: list[Column], on_good: list[Column]) -> Column:
        return F.struct(share.alias("bad_share"), F.array(*on_bad).alias("on_bad"), F.array(*on_good).alias("on_good"))

    start = model(F.lit(0.1), [F.lit(0.4)] * rules, [F.lit(0.02)] * rules)

    def step(state: Column) -> Column:
        weighed = F.transform(
            patterns,
            lambda p: F.struct(
                p["votes"].alias("votes"),
                p["n"].cast("double").alias("n"),
                (p["n"] * _posterior_bad(p["votes"], state, rules)).alias("bad"),
            ),
        )

        def total(rows: Column, value) -> Column:
            return F.aggregate(rows, F.lit(0.0), lambda acc, p: acc + value(p))

        def maximised(rows: Column) -> Column:
            share = (total(rows, lambda p: p["bad"]) + 1.0) / (total(rows, lambda p: p["n"]) + 10.0)
            on_bad, on_good = [], []
            for j in range(rules):
                def votes(p, kind, j=j):
                    return F.when(F.get(p["votes"], F.lit(j)) == kind, 1.0).otherwise(0.0)

                bad_bad = total(rows, lambda p: p["bad"] * votes(p, -1))
                bad_good = total(rows, lambda p: p["bad"] * votes(p, 1))
                good_bad = total(rows, lambda p: (p["n"] - p["bad"]) * votes(p, -1))
                good_good = total(rows, lambda p: (p["n"] - p["bad"]) * votes(p, 1))
                on_bad.append(clamp((bad_bad + 4.0) / (bad_bad + bad_good + 10.0), *ON_BAD))
                on_good.append(clamp((good_bad + 0.2) / (good_bad + good_good + 10.0), *ON_GOOD))
            return model(clamp(share, *BAD_SHARE), on_bad, on_good)

        return let(weighed, maximised)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: step(state))


def judge_payloads(payloads: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``payloads(capture_id, message_utf8)`` -> counts, votes, ``p_good`` and ``kept`` per row.

    Columns: ``capture_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``
    (long), ``base_failed`` (fewer than 10 words, or more than a fifth of the words in repeated
    windows), ``p_good`` double, ``kept`` (not ``base_failed`` and ``p_good >= 0.5``) and one
    ``vote_<rule>`` each; also the ``carried`` columns, which spares a caller the join back.

    Rows that fail the base take no part in the estimation. Every input row gives one row, repeated rows included. A null, empty or blank text has no
    words and is not kept. Equal texts get equal verdicts. A null ``capture_id`` stays null. An
    empty table gives an empty table. Texts are counted whole, at any length.
    """
    rules = rule_votes()
    code = reduce(lambda a, b: a * 3 + b, [vote + 1 for vote in rules.values()])
    measured = pin(measures(payloads, carried).withColumn("pattern", code.cast("long")))
    decoded = F.array(
        *[(F.floor(F.col("pattern") / 3**k) % 3 - 1).cast("int") for k in reversed(range(len(rules)))]
    )
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    undecided = F.sum(F.when(base_failed, 0).otherwise(1)).alias("n")
    patterns = measured.groupBy("pattern").agg(undecided).select("pattern", "n", decoded.alias("votes"))
    gathered = patterns.agg(F.sort_array(F.collect_list(F.struct("pattern", "n", "votes"))).alias("patterns"))
    fitted = gathered.select("patterns", _estimate(F.col("patterns"), len(rules)).alias("model"))
    verdicts = fitted.select("model", F.explode("patterns").alias("p")).select(
        "p.pattern", "p.votes", (1 - _posterior_bad(F.col("p.votes"), F.col("model"), len(rules))).alias("p_good")
    )
    # At most 3 ** 10 = 59 049 patterns, whatever the input: small enough to send everywhere.
    return measured.join(F.broadcast(verdicts), "pattern").select(
        "capture_id",
        *carried,
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        base_failed.alias("base_failed"),
        (~base_failed & (F.col("p_good") >= 0.5)).alias("kept"),
        "p_good",
        *[F.get("votes", F.lit(j)).alias(f"vote_{name}") for j, name in enumerate(rules)],
    )
