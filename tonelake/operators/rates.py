"""Rate hypotheses: candidates, fusion of detectors, oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the methods.
STANDARD_RATES = (
    8_000, 16_000, 22_050, 32_000, 44_100, 48_000, 96_000, 192_000, 250_000, 500_000, 1_000_000, 1_228_800,
    2_000_000, 2_400_000, 5_000_000, 10_000_000, 20_000_000, 40_000_000, 61_440_000, 122_880_000,
)
GUARD_FACTORS = (2.0, 2.2, 2.5, 4.0)
OVERSAMPLING = (2, 4, 8, 16)
TOP_N = 5
_REASONS = (
    *[f"Nyquist x{f:g} of occupied bandwidth" for f in GUARD_FACTORS],
    *[f"{m}x oversampling of estimated symbol rate" for m in OVERSAMPLING],
    "standard capture rate inside the plausible band",
)
AGREEMENT = 0.05
CORROBORATED = 0.8
DIRECT = 0.7
PATH_WEIGHTS = {"fsk_period": 1.0, "cyclostationary": 0.9, "envelope": 0.7}
PHYSICAL_MARGIN = 1.15
INTEGER_TOLERANCE = 0.12
NYQUIST_GUARD = 2.2


def standard_rates_between(lo: Column, hi: Column) -> Column:
    """Standard capture rates inside ``[lo, hi]``; the list is fixed, so no join is needed."""
    rates = F.array(*[F.lit(float(v)) for v in STANDARD_RATES])
    return F.filter(rates, lambda s: (s >= lo) & (s <= hi))


def _top_rates(measures: DataFrame, top_n: int) -> DataFrame:
    """(capture_id, top): up to ``top_n`` structs (falling score, rate_hz, whys) of every capture, best first.

    The entries of a row of measures are merged and ranked inside the row, so that the shuffle by
    capture carries rows of measures. Bit k of ``whys`` stands for the k-th of ``_REASONS``.
    """
    bw, rs = F.col("bandwidth_hz"), F.coalesce("symbol_rate_hz", F.lit(0.0))

    def entry(rate: Column, reason: int) -> Column:
        return F.struct(F.bround(rate).alias("key"), rate.cast("double").alias("rate"), F.lit(1 << reason).alias("why"))

    entries = [entry(F.col("bw") * f, k) for k, f in enumerate(GUARD_FACTORS)]
    entries += [entry(F.col("rs") * m, len(GUARD_FACTORS) + k) for k, m in enumerate(OVERSAMPLING)]
    standard = F.transform(standard_rates_between(2.0 * F.col("bw"), 6.0 * F.col("bw")), lambda s: entry(s, len(_REASONS) - 1))
    listed = F.filter(F.concat(F.array(*entries), standard), lambda e: e["rate"] > 0)

    def merge(found: Column, e: Column) -> Column:
        known = F.exists(found, lambda x: x["key"] == e["key"])
        more = F.transform(
            found, lambda x: F.struct(x["key"].alias("key"), x["rate"].alias("rate"), F.when(x["key"] == e["key"], x["why"].bitwiseOR(e["why"])).otherwise(x["why"]).alias("why"))
        )
        return F.when(known, more).otherwise(F.concat(found, F.array(e)))

    def score(rate: Column) -> Column:
        target = 2.2 * F.col("bw")
        ratio = rate / F.col("rs")
        off = F.abs(ratio - F.bround(ratio))
        integer_bonus = F.when(
            (F.col("rs") > 0) & (ratio >= 1.5), F.when(off <= 0.02, 0.20).when(off <= 0.10, 0.08).otherwise(0.0)
        ).otherwise(0.0)
        near_standard = F.exists(F.array(*[F.lit(float(v)) for v in STANDARD_RATES]), lambda s: F.abs(rate - s) / s < 0.01)
        raw = (
            F.when(rate >= 2.0 * F.col("bw") - 1e-9, 0.40).otherwise(-0.25)
            + 0.25 * F.greatest(F.lit(0.0), 1.0 - F.abs(rate - target) / target)
            + integer_bonus
            + F.when(near_standard, 0.15).otherwise(0.0)
        )
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)

    rows = measures.where(bw > 0).select("capture_id", bw.alias("bw"), rs.alias("rs"))
    none = F.array().cast("array<struct<key: double, rate: double, why: int>>")
    ranked = F.transform(
        F.aggregate(listed, none, merge), lambda e: F.struct((-score(e["rate"])).alias("order"), e["rate"].alias("rate_hz"), e["why"].alias("whys"))
    )
    own = rows.select("capture_id", "bw", "rs", F.slice(F.sort_array(ranked), 1, top_n).alias("own"))
    # Rows that come twice are one; a capture with several measures ranks the candidates of all.
    lists = F.array_distinct(F.collect_list(F.struct("bw", "rs", "own")))
    return own.groupBy("capture_id").agg(lists.alias("l")).select(
        "capture_id", F.slice(F.sort_array(F.flatten(F.transform("l", lambda x: x["own"]))), 1, top_n).alias("top")
    )


def rate_candidates(measures: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """Ranked sampling-rate hypotheses from bandwidth, symbol rate and standard rates.

    ``measures`` holds (capture_id, bandwidth_hz, symbol_rate_hz). Equal rates (to the
    nearest Hz) are merged and keep all their reasons.
    """
    whys = F.array(*[F.when(F.col("c.whys").bitwiseAND(F.lit(1 << k)) > 0, F.lit(why)) for k, why in enumerate(_REASONS)])
    return _top_rates(measures, top_n).select("capture_id", F.posexplode("top").alias("at", "c")).select(
        "capture_id", (F.col("at") + 1).alias("rank"), F.col("c.rate_hz").alias("rate_hz"), (-F.col("c.order")).alias("score"),
        F.array_join(F.array_compact(whys), "; ").alias("rationale"),
    )


def fused_sampling_rate(measures: DataFrame) -> DataFrame:
    """One working hint per capture with its confidence; 0 = not measurable."""
    at = lambda k: F.get("top", F.lit(k))
    ranked = _top_rates(measures, TOP_N).where(F.size("top") > 0).select(
        "capture_id", F.size("top").alias("num"), at(0)["rate_hz"].alias("best"),
        (-at(0)["order"]).alias("top"), (-at(1)["order"]).alias("second"),
    )
    bw, rs = F.coalesce("bandwidth_hz", F.lit(0.0)), F.coalesce("symbol_rate_hz", F.lit(0.0))
    floor = F.greatest(F.lit(0.0), 2.0 * bw, 2.0 * rs)
    base = F.when((bw > 0) & (rs > 0), 0.7).otherwise(0.5)
    clear = (F.coalesce("num", F.lit(0)) >= 3) & (F.col("top") - F.col("second") >= 0.15)
    return measures.join(ranked, "capture_id", "left").select(
        "capture_id",
        F.when(floor > 0, F.greatest(floor, F.coalesce("best", floor))).otherwise(F.lit(0.0)).alias("sampling_rate_hz"),
        F.when(floor <= 0, F.lit(0.0))
        .when(clear, F.least(F.lit(0.85), base + 0.15))
        .otherwise(base)
        .alias("confidence"),
        F.when(floor <= 0, F.lit("not measurable"))
        .when((bw <= 0) | (rs <= 0), F.lit("rests on a single constraint"))
        .alias("warning"),
    )


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Smallest value at which the cumulative weight reaches half of the total."""
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    return (
        rows.withColumn("_cum", F.sum(weight).over(order))
        .withColumn("_all", F.sum(weight).over(whole))
        .where(F.col("_cum") >= 0.5 * F.col("_all"))
        .groupBy(*keys)
        .agg(F.min(value).alias(out))
    )


def fuse_symbol_rate(parts: DataFrame) -> DataFrame:
    """Fuse detector results into one rate, or 0 with the reason.

    ``parts``: (capture_id, bandwidth_hz, envelope_hz, cycle_hz, period_hz), NULL where a
    path abstained. A direct period wins; otherwise two detectors must agree within 5 %.
    """
    paths = F.array(
        F.struct(F.lit("envelope").alias("path"), F.col("envelope_hz").alias("v"), F.lit(PATH_WEIGHTS["envelope"]).alias("w")),
        F.struct(F.lit("cyclostationary").alias("path"), F.col("cycle_hz").alias("v"), F.lit(PATH_WEIGHTS["cyclostationary"]).alias("w")),
    )
    rows = parts.select("capture_id", F.explode(paths).alias("p")).select("capture_id", "p.*").where(F.col("v").isNotNull())
    first = weighted_median(rows, ["capture_id"], "v", "w", "centre")
    agreeing = rows.join(first, "capture_id").where(
        F.abs(F.col("v") - F.col("centre")) <= AGREEMENT * F.greatest("v", "centre")
    )
    fused = weighted_median(agreeing, ["capture_id"], "v", "w", "fused")
    counts = rows.groupBy("capture_id").agg(
        F.count("*").alias("points"), F.try_divide(F.max("v") - F.min("v"), F.max("v")).alias("spread")
    ).join(agreeing.groupBy("capture_id").agg(F.count("*").alias("agree")), "capture_id").join(fused, "capture_id")
    direct = F.coalesce("period_hz", F.lit(0.0)) > 0
    points, agree = F.coalesce("points", F.lit(0)), F.coalesce("agree", F.lit(0))
    method = (
        F.when(direct, F.lit("direct"))
        .when(points == 0, F.lit("none"))
        .when(points == 1, F.lit("single"))
        .when(agree < 2, F.lit("disagreement"))
        .otherwise(F.lit("corroborated"))
    )
    joined = parts.join(counts, "capture_id", "left").withColumn("method", method)
    rate = F.when(F.col("method") == "direct", F.col("period_hz")).when(F.col("method") == "corroborated", F.col("fused")).otherwise(F.lit(0.0))
    apart = lambda c: F.abs(F.col(c) - F.col("period_hz")) > AGREEMENT * F.greatest(F.col(c), F.col("period_hz"))
    return joined.select(
        "capture_id",
        rate.alias("symbol_rate_hz"),
        F.when(F.col("method") == "direct", F.lit(DIRECT)).when(F.col("method") == "corroborated", F.lit(CORROBORATED)).otherwise(F.lit(0.0)).alias("confidence"),
        "method",
        F.when(F.col("method") == "corroborated", F.col("spread")).alias("agreement"),
        F.array_compact(
            F.array(
                F.when(
                    (F.col("method") == "direct") & (F.coalesce(apart("envelope_hz"), F.lit(False)) | F.coalesce(apart("cycle_hz"), F.lit(False))),
                    F.lit("detectors disagree with the measured period"),
                ),
                F.when((F.coalesce("bandwidth_hz", F.lit(0.0)) > 0) & (rate > F.col("bandwidth_hz") * PHYSICAL_MARGIN), F.lit("rate exceeds the occupied bandwidth")),
                F.when(F.col("method").isin("none", "single", "disagreement"), F.concat(F.lit("not measurable: "), F.col("method"))),
            )
        ).alias("warnings"),
    )


def sampling_rate_hint(bandwidth: Column, symbol_rate: Column | None = None, factor: float = NYQUIST_GUARD) -> Column:
    """Coarse sampling rate: guard factor times the larger of bandwidth and symbol rate, 0 without a bandwidth.

    A missing or non-positive symbol rate is left out.
    """
    wide = F.coalesce(bandwidth, F.lit(0.0))
    fast = F.lit(0.0) if symbol_rate is None else F.coalesce(symbol_rate, F.lit(0.0))
    return F.when(wide <= 0, F.lit(0.0)).otherwise(F.greatest(wide, fast) * factor)


def oversampling(parts: DataFrame) -> DataFrame:
    """Integer samples per symbol from a recovered period or a rate in cycles per sample.

    ``parts``: (capture_id, num_samples, scheme, period, rate_cycles); scheme may be NULL.
    """
    fsk = F.col("scheme").isin("2-FSK", "4-FSK")
    by_period = (F.col("scheme").isNull() | fsk) & (F.col("period") > 1)
    rate = F.coalesce("rate_cycles", F.lit(0.0))
    sps = 1.0 / F.when(rate > 0, rate)
    near = F.bround(sps)
    reason = (
        F.when(F.col("num_samples") < 64, F.lit("capture shorter than 64 samples"))
        .when(by_period, F.lit("piecewise-constant instantaneous frequency"))
        .when(fsk, F.lit("no piecewise-constant symbol structure to measure"))
        .when(rate <= 0, F.lit("no symbol-rate line above the detection threshold"))
        .when(near < 1, F.lit("below one sample per symbol"))
        .when(F.abs(sps - near) / near > INTEGER_TOLERANCE, F.lit("not an integer number of samples per symbol"))
        .otherwise(F.lit("cyclostationary symbol-rate line"))
    )
    found = reason.isin("piecewise-constant instantaneous frequency", "cyclostationary symbol-rate line")
    return parts.select(
        "capture_id",
        F.when(found, F.when(by_period, F.col("period").cast("long")).otherwise(near.cast("long"))).alias("sps"),
        found.alias("found"),
        reason.alias("reason"),
    )
