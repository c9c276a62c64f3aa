"""Where does the signal burst lie inside each capture?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.scalars import decibel, power
from tonelake.session import pin

# Fixed values of the method.
ENVELOPE_WINDOW = 64
MIN_SNR_DB = 6.0
ENVELOPE_FLOOR = 1e-12
OTSU_BINS = 256

#: Envelope blocks looked at by one task when runs are searched.
RUN_SEGMENT = 8192


def envelope(samples: DataFrame, window: int = ENVELOPE_WINDOW) -> DataFrame:
    """Mean power of every full block of ``window`` samples, in dB, floored per capture.

    The samples of one block come from one input row, so the partial aggregation
    already collapses them before the shuffle. ``lo`` and ``hi`` carry the range of the
    capture: the floored minimum and the maximum follow from one small aggregate.
    """
    blocks = (
        samples.groupBy("capture_id", F.floor(F.col("n") / window).alias("block"))
        .agg(F.avg(power(F.col("i"), F.col("q"))).alias("p"), F.count("*").alias("members"))
        .where(F.col("members") == window)
        .drop("members")
    )
    return floored(blocks)


def floored(blocks: DataFrame) -> DataFrame:
    """Mean powers ``(capture_id, block, p)`` of envelope windows in dB, with the range of their capture."""
    # Stored, so that its size is known: the blocks of few captures are not sorted by capture for the join.
    spans = pin(
        blocks.groupBy("capture_id")
        .agg(F.max("p").alias("peak"), F.min("p").alias("least"))
        .where(F.col("peak") > 0)
        .select(
            "capture_id",
            (F.col("peak") * ENVELOPE_FLOOR).alias("floor"),
            decibel(F.greatest(F.col("least"), F.col("peak") * ENVELOPE_FLOOR)).alias("lo"),
            decibel(F.col("peak")).alias("hi"),
        )
    )
    return blocks.join(spans, "capture_id").select(
        "capture_id", "block", decibel(F.greatest(F.col("p"), F.col("floor"))).alias("env_db"), "lo", "hi"
    )


def otsu_thresholds(env: DataFrame, bins: int = OTSU_BINS) -> DataFrame:
    """Per capture the bin centre that maximises the between-class variance.

    Only bin counts are shuffled; the cumulative window sees at most ``bins`` rows per
    capture. A capture without range gets no threshold (NULL).
    """
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.least(F.floor(F.try_divide(F.col("env_db") - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counts = (
        env.groupBy("capture_id", F.coalesce(slot, F.lit(0)).alias("slot"))
        .agg(F.count("*").alias("h"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .withColumn("centre", F.col("lo") + (F.col("slot") + 0.5) * width)
    )
    upto = Window.partitionBy("capture_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("capture_id")
    split = counts.select(
        "capture_id",
        "slot",
        "centre",
        (F.col("hi") > F.col("lo")).alias("ranged"),
        F.sum("h").over(upto).alias("w0"),
        F.sum("h").over(whole).alias("total"),
        F.sum(F.col("h") * F.col("centre")).over(upto).alias("c0"),
        F.sum(F.col("h") * F.col("centre")).over(whole).alias("csum"),
    ).withColumn("w1", F.col("total") - F.col("w0"))
    mean_gap = F.try_divide(F.col("c0"), F.col("w0")) - F.try_divide(F.col("csum") - F.col("c0"), F.col("w1"))
    between = F.when((F.col("w1") > 0) & F.col("ranged"), F.col("w0") * F.col("w1") * mean_gap * mean_gap)
    return (
        split.withColumn("between", between)
        .groupBy("capture_id")
        .agg(
            F.max_by(
                F.when(F.col("between").isNotNull(), F.col("centre")),
                F.struct(F.coalesce("between", F.lit(-1.0)), -F.col("slot")),
            ).alias("threshold_db")
        )
    )


def _islands(rows: DataFrame, keys: list[str], starts_new: Column) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("first_pos")
    return (
        rows.withColumn("_new", starts_new)
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))
        .drop("_island")
    )


def longest_runs(marked: DataFrame, pos: str = "block", segment: int = RUN_SEGMENT) -> DataFrame:
    """Longest run of consecutive positions per capture (the first one on ties).

    ``marked`` holds only the positions where the condition is true. Runs are found
    inside segments of the position axis first; of each segment only the runs that
    touch its edges and its longest run go on, so the per-capture step that glues
    runs across segment borders sees at most three rows per segment.
    """
    keyed = marked.select(
        "capture_id",
        F.floor(F.col(pos) / segment).alias("seg"),
        F.col(pos).alias("first_pos"),
        F.col(pos).alias("last_pos"),
    )
    inner = Window.partitionBy("capture_id", "seg").orderBy("first_pos")
    gap = F.coalesce((F.col("first_pos") != F.lag("last_pos").over(inner) + 1).cast("int"), F.lit(1))
    runs = _islands(keyed, ["capture_id", "seg"], gap)
    by_len = Window.partitionBy("capture_id", "seg").orderBy(
        (F.col("last_pos") - F.col("first_pos")).desc(), "first_pos"
    )
    edge = (F.col("first_pos") % segment == 0) | (F.col("last_pos") % segment == segment - 1)
    kept = runs.withColumn("_rank", F.row_number().over(by_len)).where(edge | (F.col("_rank") == 1))
    outer = Window.partitionBy("capture_id").orderBy("first_pos")
    gap2 = F.coalesce((F.col("first_pos") != F.lag("last_pos").over(outer) + 1).cast("int"), F.lit(1))
    glued = _islands(kept.select("capture_id", "first_pos", "last_pos"), ["capture_id"], gap2)
    return glued.groupBy("capture_id").agg(
        F.max_by(
            F.struct("first_pos", "last_pos"),
            F.struct(F.col("last_pos") - F.col("first_pos"), -F.col("first_pos")),
        ).alias("run")
    ).select("capture_id", "run.first_pos", "run.last_pos")


def burst_regions(
    samples: DataFrame, window: int = ENVELOPE_WINDOW, min_snr_db: float = MIN_SNR_DB
) -> DataFrame:
    """One row per capture: burst range, levels, and the reason where none is reported."""
    sizes = samples.groupBy("capture_id").agg(F.count("*").alias("n_samples"))
    return regions(envelope(samples, window), sizes, window, min_snr_db)


def regions(env: DataFrame, sizes: DataFrame, window: int = ENVELOPE_WINDOW, min_snr_db: float = MIN_SNR_DB) -> DataFrame:
    """Burst regions from the envelope in dB and ``sizes(capture_id, n_samples)``."""
    env = pin(env)
    thresholds = pin(otsu_thresholds(env))
    marked = env.join(thresholds, "capture_id").withColumn("above", F.col("env_db") > F.col("threshold_db"))
    levels = marked.groupBy("capture_id").agg(
        F.first("threshold_db").alias("threshold_db"),
        F.avg(F.when(~F.col("above"), F.col("env_db"))).alias("noise_floor_db"),
        F.avg(F.when(F.col("above"), F.col("env_db"))).alias("burst_level_db"),
    )
    runs = longest_runs(marked.where("above"))
    snr = F.col("burst_level_db") - F.col("noise_floor_db")
    joined = (
        sizes.join(levels, "capture_id", "left")
        .join(runs, "capture_id", "left")
        .withColumn("snr_db", snr)
        .withColumn(
            "reason",
            F.when(F.col("n_samples") < 2 * window, F.lit("capture shorter than two envelope windows"))
            .when(F.col("threshold_db").isNull(), F.lit("envelope has no usable dynamic range"))
            .when(F.col("snr_db").isNull(), F.lit("envelope is unimodal: no burst to separate"))
            .when(F.col("snr_db") < min_snr_db, F.lit("no burst above the noise floor"))
            .otherwise(F.lit("")),
        )
        .withColumn("found", F.col("reason") == "")
    )
    short = F.col("n_samples") < 2 * window

    def unless_short(name: str) -> Column:
        return F.when(~short, F.col(name)).alias(name)

    return joined.select(
        "capture_id",
        "found",
        F.when(F.col("found"), F.col("first_pos") * window).alias("start_sample"),
        F.when(F.col("found"), F.least((F.col("last_pos") + 1) * window, F.col("n_samples"))).alias("end_sample"),
        "n_samples",
        unless_short("threshold_db"),
        F.when(~short & F.col("snr_db").isNotNull(), F.col("noise_floor_db")).alias("noise_floor_db"),
        F.when(~short & F.col("snr_db").isNotNull(), F.col("burst_level_db")).alias("burst_level_db"),
        unless_short("snr_db"),
        "reason",
    )
