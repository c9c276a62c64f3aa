"""Confidence routing and typed verdicts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the method.
ACT = 0.80
CONFIRM = 0.50
NOUL_ACT = 0.9
LEVELS = ("excellent", "good", "poor", "unusable")
LEVEL_CENTRES = (2.5, 10.0, 22.5, 45.0)
LEVEL_WIDTH = 7.5
MAX_CONFIDENCE = 0.90


def route(confidence: Column, high: float = ACT, low: float = CONFIRM) -> Column:
    return F.when(confidence >= high, F.lit("act")).when(confidence >= low, F.lit("confirm")).otherwise(F.lit("escalate"))


def confidence_from_probs(probs: Column) -> Column:
    """``(k pmax - 1) / (k - 1)`` of the normalised distribution, clamped to [0, 1]."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    k = F.size(probs)
    peak = F.array_max(probs) / total
    usable = (k >= 2) & (total > 0) & ~F.isnan(total) & (total < float("inf"))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k * peak - 1.0) / (k - 1)))).otherwise(F.lit(0.0))


def quality(evm_percent: Column) -> Column:
    """Struct (score, confidence, probabilities, method) over the four quality levels."""
    measured = evm_percent.isNotNull() & ~F.isnan(evm_percent) & (F.abs(evm_percent) < float("inf"))
    weights = F.array(*[1.0 / (1.0 + F.abs(F.lit(c) - evm_percent) / LEVEL_WIDTH) for c in LEVEL_CENTRES])
    total = sum(1.0 / (1.0 + F.abs(F.lit(c) - evm_percent) / LEVEL_WIDTH) for c in LEVEL_CENTRES)
    probs = F.transform(weights, lambda w: w / total)
    place = sum(probs[k] * F.lit(float(k)) for k in range(len(LEVELS)))
    names = F.array(*[F.lit(v) for v in LEVELS])
    return F.struct(
        F.when(measured, place).otherwise(F.lit(3.0)).alias("score"),
        F.when(measured, confidence_from_probs(probs)).otherwise(F.lit(0.0)).alias("confidence"),
        F.map_from_arrays(names, F.when(measured, probs).otherwise(F.array(*[F.lit(0.25)] * 4))).alias("probabilities"),
        F.when(measured, F.lit("evm-levels")).otherwise(F.lit("not-applicable")).alias("method"),
    )


def header_trust(detected: Column, score: Column, min_score: Column) -> Column:
    """Struct (noul, method): how likely the header is really there."""
    chance = (score >= 0.85) & (score < min_score)
    return F.struct(
        F.when(detected, F.lit(0.99)).when(chance, F.lit(0.15)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(0.49), score * 0.5))).alias("noul"),
        F.when(detected, F.lit("cfar-significant"))
        .when(chance, F.lit("chance-match-below-cfar"))
        .otherwise(F.lit("raw-score-downweighted"))
        .alias("method"),
    )


def decode_trust(validated: Column, crc_pass: Column) -> Column:
    ok = validated & F.coalesce(crc_pass, F.lit(False))
    return F.struct(
        F.when(ok, F.lit(0.99)).otherwise(F.lit(0.01)).alias("noul"),
        F.when(ok, F.lit("crc-16-validated")).otherwise(F.lit("no-crc-pass")).alias("method"),
    )


def es_n0(eb_n0_db: Column, bits_per_symbol: Column) -> Column:
    return F.when(bits_per_symbol >= 1, eb_n0_db + 10.0 * F.log10(bits_per_symbol.cast("double")))


def repeaked(distribution: Column, label: Column, target: Column) -> Column:
    """A measured distribution whose peak on ``label`` is lowered to ``target``, the rest spread as measured.

    A peak that is not higher than ``target`` stays: nothing is made surer than it was measured.
    """
    mass = F.element_at(distribution, label)
    rest = 1.0 - mass
    even = (1.0 - target) / (F.size(distribution) - 1)

    def moved(name: Column, p: Column) -> Column:
        return F.when(name == label, target).when(rest > 0, p / rest * (1.0 - target)).otherwise(even)

    return F.when(mass > target, F.transform_values(distribution, moved)).otherwise(distribution)


def fan_out(state: DataFrame) -> DataFrame:
    """Independent verdicts over the same capture with their routes.

    ``state``: (capture_id, label, label_confidence, alternatives, detected, score,
    min_score, evm_percent, validated[, distribution]). A capture without samples has a NULL
    label and gets ``available = false``. Where a ``distribution`` (class -> probability) of a
    learned model is given and names the label, it is the verdict's, with its peak lowered to
    the label's confidence; else a peak on the label is spread over its alternatives.
    """
    if "distribution" in state.columns:
        named = F.when(F.map_contains_key("distribution", F.coalesce("label", F.lit(""))), F.col("distribution"))
        state = state.withColumn("_measured", repeaked(named, F.col("label"), F.col("label_confidence")))
    else:
        state = state.withColumn("_measured", F.lit(None).cast("map<string, double>"))
    peak = F.least(F.greatest("label_confidence", F.lit(0.0)), F.lit(MAX_CONFIDENCE))
    others = F.slice(F.filter("alternatives", lambda a: F.col("label").isNull() | (a != F.col("label"))), 1, 3)
    count = F.size(others)
    rest = F.when(count > 0, (1.0 - peak) / count).otherwise(F.lit(0.0))
    probs = F.concat(F.array(peak), F.array_repeat(rest, count))
    available = F.col("label").isNotNull()
    return (
        state.withColumn("header", header_trust(F.col("detected"), F.col("score"), F.col("min_score")))
        .withColumn("quality", quality(F.col("evm_percent")))
        .withColumn("decode", decode_trust(F.col("validated"), F.col("validated")))
        .withColumn("spread", F.map_from_arrays(F.concat(F.array(F.coalesce("label", F.lit(""))), others), probs))
        .withColumn("probabilities", F.coalesce("_measured", "spread"))
        .withColumn(
            "confidence",
            F.when(
                F.col("_measured").isNotNull(), F.least(confidence_from_probs(F.map_values("_measured")), F.lit(MAX_CONFIDENCE))
            ).otherwise(confidence_from_probs(probs)),
        )
        .select(
            "capture_id",
            available.alias("available"),
            F.when(
                available,
                F.struct(
                    F.col("label").alias("choice"),
                    F.col("confidence").alias("confidence"),
                    F.col("probabilities").alias("probabilities"),
                    route(F.col("confidence")).alias("route"),
                ),
            ).alias("modulation"),
            F.when(
                available,
                F.struct("header.noul", "header.method", route(F.col("header.noul"), NOUL_ACT).alias("route")),
            ).alias("header_present"),
            F.when(available, F.col("quality")).alias("signal_quality"),
            F.when(
                available,
                F.struct(
                    "decode.noul",
                    "decode.method",
                    F.when(F.col("decode.noul") >= NOUL_ACT, F.lit("act")).otherwise(F.lit("escalate")).alias("route"),
                ),
            ).alias("decode_trust"),
        )
    )


def wide_band_hint(bandwidth_hz: Column, symbol_rate_hz: Column, bpsk_evm: Column) -> Column:
    """Warning where a wide band has no symbol rate and no constellation fits."""
    suspicious = (bandwidth_hz > 1_000_000.0) & (symbol_rate_hz <= 0) & (bpsk_evm.isNull() | (bpsk_evm > 30.0))
    return F.when(suspicious, F.lit("possible spread-spectrum"))


