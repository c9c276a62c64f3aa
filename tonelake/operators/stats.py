"""Per-sample transforms and per-capture statistics of sample series.

Every statistic is a set of mergeable sums, so partial aggregation on the map side
reduces a capture to one row per task before anything is shuffled.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.scalars import (
    TWO_PI,
    clamp,
    csquare,
    decibel,
    magnitude,
    phase,
    power,
    rotate,
    wrap_phase,
)
from tonelake.session import pin
from tonelake.sources.series import with_lookahead

# Fixed values of the method.
IQ_CORRECTION_MIN_MAGNITUDE = 0.12
IQ_CORRECTION_MIN_GAIN = 0.95
IQ_CORRECTION_MIN_SAMPLES = 32
FREQUENCY_BINS = 30
FREQUENCY_PEAK_SHARE = 0.2
MAX_KURTOSIS = 30.0


# -- per-sample transforms ----------------------------------------------------


def kinematics(samples: DataFrame, sample_rate: float) -> DataFrame:
    """Time in ms, magnitude, power and phase of every sample."""
    return samples.select(
        "capture_id",
        "n",
        (F.col("n") / sample_rate * 1000.0).alias("t_ms"),
        "i",
        "q",
        magnitude(F.col("i"), F.col("q")).alias("magnitude"),
        power(F.col("i"), F.col("q")).alias("power"),
        phase(F.col("i"), F.col("q")).alias("phase"),
    )


def sizes(blocks: DataFrame) -> DataFrame:
    """Sample count per capture, from the array sizes alone."""
    return blocks.groupBy("capture_id").agg(F.sum(F.size("i")).alias("num_samples"))


def basics(blocks: DataFrame, sample_rate: float) -> DataFrame:
    return sizes(blocks).withColumn("duration_s", F.col("num_samples") / sample_rate)


def decimate(samples: DataFrame, counts: DataFrame, max_points: int) -> DataFrame:
    """Every ``ceil(N / k)``-th sample of a capture, at most ``k`` of them."""
    step = F.greatest(F.ceil(F.col("num_samples") / max_points), F.lit(1))
    return (
        samples.join(counts.select("capture_id", step.alias("step")), "capture_id")
        .where((F.col("n") % F.col("step") == 0) & (F.col("n") / F.col("step") < max_points))
        .drop("step")
    )


def correct_offset(samples: DataFrame, sample_rate: float, offset_hz: Column) -> DataFrame:
    """Counter-rotate by a frequency offset given in Hz."""
    i, q = rotate((F.col("i"), F.col("q")), -TWO_PI * offset_hz * F.col("n") / sample_rate)
    return samples.select("capture_id", "n", i.alias("i"), q.alias("q"))


def normalise_peak(samples: DataFrame) -> DataFrame:
    """Divide by the largest magnitude of the capture; an all-zero capture is unchanged."""
    peaks = samples.groupBy("capture_id").agg(F.max(power(F.col("i"), F.col("q"))).alias("peak_power"))
    scale = F.when(F.col("peak_power") > 0, F.sqrt("peak_power")).otherwise(F.lit(1.0))
    return samples.join(peaks, "capture_id").select("capture_id", "n", (F.col("i") / scale).alias("i"), (F.col("q") / scale).alias("q"))


def normalise_power(samples: DataFrame) -> DataFrame:
    """Scale every capture to unit mean power."""
    means = samples.groupBy("capture_id").agg(F.avg(power(F.col("i"), F.col("q"))).alias("mean_power"))
    scale = F.when(F.col("mean_power") > 0, F.sqrt("mean_power")).otherwise(F.lit(1.0))
    return samples.join(means, "capture_id").select("capture_id", "n", (F.col("i") / scale).alias("i"), (F.col("q") / scale).alias("q"))


# -- phase series -------------------------------------------------------------


def frequency_arrays(blocks: DataFrame, block_len: int | None, *carried: str) -> DataFrame:
    """Wrapped phase steps per block; the step to the next block's head is included."""
    haloed = blocks if block_len is None else with_lookahead(blocks, 1, block_len)
    phases = F.zip_with("i", "q", lambda i, q: F.atan2(q, i))
    steps = F.zip_with(
        F.slice("ph", 2, F.greatest(F.size("ph") - 1, F.lit(0))),
        F.slice("ph", 1, F.greatest(F.size("ph") - 1, F.lit(0))),
        lambda later, earlier: wrap_phase(later - earlier),
    )
    return haloed.select("capture_id", "block_no", "start_n", *carried, phases.alias("ph")).select(
        "capture_id", "block_no", "start_n", *carried, F.get("ph", F.lit(0)).alias("head"), steps.alias("steps")
    )


def instant_frequency(blocks: DataFrame, block_len: int | None = None) -> DataFrame:
    """First difference of the unwrapped phase: (capture_id, n, f), n of the earlier sample.

    ``block_len=None`` states that every capture fits into one block.
    """
    return (
        frequency_arrays(blocks, block_len)
        .select("capture_id", "start_n", F.posexplode("steps").alias("k", "f"))
        .select("capture_id", (F.col("start_n") + F.col("k")).alias("n"), "f")
    )


def unwrapped_phase(blocks: DataFrame, block_len: int | None = None) -> DataFrame:
    """Unwrapped phase of every sample, as a two-level prefix sum.

    Inside a block the steps are summed in the row; across blocks only one total per
    block enters the per-capture window.
    """
    arrays = pin(frequency_arrays(blocks, block_len))
    totals = arrays.select(
        "capture_id", "block_no", "head", F.aggregate("steps", F.lit(0.0), lambda a, x: a + x).alias("total")
    )
    before = Window.partitionBy("capture_id").orderBy("block_no")
    starts = totals.select(
        "capture_id",
        "block_no",
        (
            F.first("head").over(before)
            + F.coalesce(F.sum("total").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        ).alias("base"),
    )
    inside = arrays.select(
        "capture_id", "block_no", "start_n", F.posexplode(F.concat(F.array(F.lit(0.0)), "steps")).alias("k", "step")
    )
    upto = Window.partitionBy("capture_id", "block_no").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    # With a look-ahead the last step of a block leads to the next block's head: drop it there.
    last = Window.partitionBy("capture_id").orderBy("block_no")
    ends = totals.select("capture_id", "block_no", F.lead("block_no").over(last).isNotNull().alias("more"))
    counts = arrays.select("capture_id", "block_no", F.size("steps").alias("steps_len")).join(
        ends, ["capture_id", "block_no"]
    )
    return (
        inside.withColumn("run", F.sum("step").over(upto))
        .join(starts.join(counts, ["capture_id", "block_no"]), ["capture_id", "block_no"])
        .where(~F.col("more") | (F.col("k") < F.col("steps_len")))
        .select("capture_id", (F.col("start_n") + F.col("k")).alias("n"), (F.col("base") + F.col("run")).alias("phase"))
    )


def frequency_offset(phases: DataFrame, sample_rate: float) -> DataFrame:
    """Least-squares slope of the unwrapped phase in Hz; 0 below four samples."""
    slope = F.regr_slope(F.col("phase"), F.col("n").cast("double"))
    return phases.groupBy("capture_id").agg(
        F.when(F.count("*") < 4, F.lit(0.0)).otherwise(slope * sample_rate / TWO_PI).alias("cfo_hz")
    )


# -- exact quantiles without collecting a group -------------------------------


def exact_quantiles(df: DataFrame, value: str, probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated quantiles per capture, exact for captures of any size.

    A mergeable sketch brackets each quantile; the values below a bracket are only
    counted and just the few inside it are ranked. Returns one column ``q0, q1, ...``
    per probability.
    """
    margin = 3.0 / accuracy
    edges: list[float] = []
    for p in probs:
        edges += [max(0.0, p - margin), min(1.0, p + margin)]
    sketch = df.groupBy("capture_id").agg(
        F.percentile_approx(value, edges, accuracy).alias("edges"),
        F.count(value).alias("total"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
    )
    small = F.col("total") <= accuracy
    # Stored, so that its size is known: values of few captures are not sorted by capture for the join.
    plan = pin(sketch.select(
        "capture_id",
        "total",
        *[F.when(small, F.col("least")).otherwise(F.col("edges")[2 * k]).alias(f"lo{k}") for k in range(len(probs))],
        *[F.when(small, F.col("most")).otherwise(F.col("edges")[2 * k + 1]).alias(f"hi{k}") for k in range(len(probs))],
    ))
    tagged = df.select("capture_id", F.col(value).alias("v")).join(plan, "capture_id")
    # Values below a bracket are counted by conditional sums; only those inside go on.
    counts = tagged.groupBy("capture_id").agg(
        F.array(*[F.sum((F.col("v") < F.col(f"lo{k}")).cast("long")) for k in range(len(probs))]).alias("below")
    )
    hits = F.filter(
        F.array(
            *[
                F.when(
                    (F.col("v") >= F.col(f"lo{k}")) & (F.col("v") <= F.col(f"hi{k}")),
                    F.struct(F.lit(k).alias("k"), (F.lit(p) * (F.col("total") - 1)).alias("place")),
                )
                for k, p in enumerate(probs)
            ]
        ),
        lambda h: h.isNotNull(),
    )
    # Equal values are one row before they are ranked, so a constant series is no load either.
    upto = Window.partitionBy("capture_id", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        tagged.select("capture_id", "v", F.explode(hits).alias("h"))
        .groupBy("capture_id", "h.k", "h.place", "v")
        .agg(F.count("*").alias("same"))
        .withColumn("upto", F.sum("same").over(upto))
        .join(counts, "capture_id")
        .withColumn("last", F.get("below", F.col("k")) + F.col("upto") - 1)
        .withColumn("first", F.col("last") - F.col("same") + 1)
    )
    floor = F.floor("place")
    picked = inside.groupBy("capture_id", "k").agg(
        F.max(F.when(floor.between(F.col("first"), F.col("last")), F.col("v"))).alias("a"),
        F.max(F.when((floor + 1).between(F.col("first"), F.col("last")), F.col("v"))).alias("b"),
        F.first(F.col("place") - floor).alias("part"),
    )
    result = picked.select("capture_id", "k", (F.col("a") + F.col("part") * (F.coalesce("b", "a") - F.col("a"))).alias("v"))
    return result.groupBy("capture_id").agg(
        *[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"q{k}") for k in range(len(probs))]
    )


# -- statistics ---------------------------------------------------------------


def cumulants(samples: DataFrame) -> DataFrame:
    """Second- and fourth-order cumulants of the unit-power series, in one pass.

    Scaling to unit power only divides the moments by powers of the mean power.
    """
    x2 = csquare((F.col("i"), F.col("q")))
    x4 = csquare(x2)
    p = power(F.col("i"), F.col("q"))
    sums = samples.groupBy("capture_id").agg(
        F.count("*").alias("num"),
        F.avg(p).alias("p"),
        F.avg(x2[0]).alias("m20r"),
        F.avg(x2[1]).alias("m20i"),
        F.avg(x4[0]).alias("m40r"),
        F.avg(x4[1]).alias("m40i"),
        F.avg(p * x2[0]).alias("m42r"),
        F.avg(p * x2[1]).alias("m42i"),
    )
    usable = (F.col("num") >= 4) & (F.col("p") >= 1e-12)
    m20 = (F.col("m20r") / F.col("p"), F.col("m20i") / F.col("p"))
    p2 = F.col("p") * F.col("p")
    m20sq = csquare(m20)
    # The fourth-order mixed term keeps the complex mean of |x|^2 x^2 as its moment.
    parts = {
        "c20_re": m20[0],
        "c20_im": m20[1],
        "c21": F.lit(1.0),
        "c40_re": F.col("m40r") / p2 - 3.0 * m20sq[0],
        "c40_im": F.col("m40i") / p2 - 3.0 * m20sq[1],
        "c42_re": F.col("m42r") / p2 - power(*m20) - 2.0,
        "c42_im": F.col("m42i") / p2,
    }
    return sums.select(
        "capture_id", *[F.when(usable, v).otherwise(F.lit(0.0)).alias(k) for k, v in parts.items()]
    )


def frequency_stats(freqs: DataFrame) -> DataFrame:
    """Variance, kurtosis, 1-99 percentile span and significant bins of a frequency series."""
    moments = freqs.groupBy("capture_id").agg(
        F.var_pop("f").alias("fvar"),
        F.kurtosis("f").alias("excess"),
        F.min("f").alias("lo"),
        F.max("f").alias("hi"),
    )
    slot = F.when(F.col("hi") > F.col("lo"), F.least(
        F.floor((F.col("f") - F.col("lo")) / (F.col("hi") - F.col("lo")) * FREQUENCY_BINS), F.lit(FREQUENCY_BINS - 1)
    )).otherwise(F.lit(FREQUENCY_BINS // 2))
    bins = (
        freqs.join(moments.select("capture_id", "lo", "hi"), "capture_id")
        .groupBy("capture_id", slot.alias("slot"))
        .agg(F.count("*").alias("h"))
    )
    significant = bins.withColumn("peak", F.max("h").over(Window.partitionBy("capture_id"))).groupBy("capture_id").agg(
        F.sum((F.col("h") > FREQUENCY_PEAK_SHARE * F.col("peak")).cast("long")).alias("nsig")
    )
    span = exact_quantiles(freqs, "f", [0.01, 0.99])
    return (
        moments.join(significant, "capture_id")
        .join(span, "capture_id")
        .select(
            "capture_id",
            "fvar",
            F.when(F.col("fvar") > 1e-18, clamp(F.col("excess") + 3.0, 0.0, MAX_KURTOSIS)).otherwise(F.lit(0.0)).alias("kurtosis"),
            F.greatest(F.col("q1") - F.col("q0"), F.lit(0.0)).alias("prange"),
            "nsig",
        )
    )


def envelope_stats(samples: DataFrame) -> DataFrame:
    """Spread of the envelope, peak-to-average ratio and higher amplitude moments."""
    p = power(F.col("i"), F.col("q"))
    sums = samples.groupBy("capture_id").agg(
        F.avg(F.sqrt(p)).alias("mean_env"),
        F.stddev_pop(F.sqrt(p)).alias("std_env"),
        F.avg(p).alias("m2"),
        F.avg(p * p).alias("m4"),
        F.avg(p * p * p).alias("m6"),
        F.max(p).alias("peak"),
    )
    loud = F.col("m2") > 1e-30
    return sums.select(
        "capture_id",
        F.when(F.col("mean_env") > 1e-12, F.col("std_env") / F.col("mean_env")).otherwise(F.lit(0.0)).alias("env_norm"),
        F.when(loud, decibel(F.col("peak") / F.col("m2"))).otherwise(F.lit(0.0)).alias("papr_db"),
        F.when(loud, F.col("m4") / (F.col("m2") * F.col("m2"))).otherwise(F.lit(0.0)).alias("m4m2"),
        F.when(loud, F.col("m6") / (F.col("m2") * F.col("m2") * F.col("m2"))).otherwise(F.lit(0.0)).alias("m6m2"),
    )


# -- I/Q imbalance ------------------------------------------------------------


def _imbalance_exprs(pi: Column, pq: Column, piq: Column) -> tuple[Column, Column, Column]:
    total = pi + pq
    gain = F.when(total > 0, (pi - pq) / total)
    quad = F.when((pi > 0) & (pq > 0), piq / F.sqrt(pi * pq))
    size = F.when(quad.isNotNull(), F.sqrt(gain * gain + quad * quad)).otherwise(F.abs(gain))
    return gain, quad, size


def branch_moments(samples: DataFrame) -> DataFrame:
    return samples.groupBy("capture_id").agg(
        F.count("*").alias("num"), F.avg(F.col("i") * F.col("i")).alias("pi"), F.avg(F.col("q") * F.col("q")).alias("pq"), F.avg(F.col("i") * F.col("q")).alias("piq")
    )


def imbalance(samples: DataFrame) -> DataFrame:
    """Gain and quadrature metrics and the gain / phase estimates they imply."""
    pi, pq, piq = F.col("pi"), F.col("pq"), F.col("piq")
    gain, quad, size = _imbalance_exprs(pi, pq, piq)
    both = (pi > 0) & (pq > 0)
    ratio = F.sqrt(pi / pq)
    return branch_moments(samples).select(
        "capture_id",
        gain.alias("gain_metric"),
        quad.alias("quad_metric"),
        size.alias("magnitude"),
        F.when(both, 2.0 * (ratio - 1.0) / (ratio + 1.0)).alias("gain_imbalance"),
        F.when(both, F.degrees(F.asin(clamp(piq / pi, -1.0, 1.0)))).alias("phase_imbalance_deg"),
    )


def correct_imbalance(samples: DataFrame, gain: Column, phase_deg: Column) -> DataFrame:
    """Invert a known gain / phase imbalance; non-invertible parameters give NULL and a reason."""
    phi = F.radians(phase_deg)
    si, sq = 1.0 + gain / 2.0, 1.0 - gain / 2.0
    reason = (
        F.when(gain.isNull() | phase_deg.isNull() | F.isnan(gain) | F.isnan(phase_deg), F.lit("parameters must be finite"))
        .when((F.abs(si) < 1e-12) | (F.abs(sq) < 1e-12), F.lit("gain zeroes a branch"))
        .when(F.abs(F.cos(phi)) < 1e-12, F.lit("phase is not invertible"))
        .otherwise(F.lit(""))
    )
    ok = reason == ""
    return samples.select(
        "capture_id",
        "n",
        F.when(ok, F.col("i") / si).alias("i"),
        F.when(ok, (F.col("q") - F.col("i") * F.sin(phi)) / (F.cos(phi) * sq)).alias("q"),
        reason.alias("reason"),
    )


def imbalance_decision(samples: DataFrame, bpsk: Column) -> DataFrame:
    """Should the estimated imbalance be removed? One pass over the samples.

    The metrics after correction follow from the same three moments, so the corrected
    series need not be scanned to decide.
    """
    metrics = imbalance(samples).join(branch_moments(samples), "capture_id")
    pi, pq, piq = F.col("pi"), F.col("pq"), F.col("piq")
    g, phi = F.col("gain_imbalance"), F.radians("phase_imbalance_deg")
    si, sq = 1.0 + g / 2.0, 1.0 - g / 2.0
    after = _imbalance_exprs(
        pi / (si * si),
        (pq - 2.0 * F.sin(phi) * piq + F.sin(phi) * F.sin(phi) * pi) / (F.cos(phi) * F.cos(phi) * sq * sq),
        (piq - F.sin(phi) * pi) / (si * F.cos(phi) * sq),
    )[2]
    reason = (
        F.when(bpsk | (F.col("num") < IQ_CORRECTION_MIN_SAMPLES), F.lit("not estimable for this constellation"))
        .when(
            F.col("magnitude").isNull() | (F.col("magnitude") < IQ_CORRECTION_MIN_MAGNITUDE),
            F.lit("estimate below correction threshold"),
        )
        .when(g.isNull() | phi.isNull(), F.lit("estimate was not finite"))
        .when(
            F.col("magnitude_after").isNull() | (F.col("magnitude_after") >= F.col("magnitude") * IQ_CORRECTION_MIN_GAIN),
            F.lit("correction did not materially reduce the metric"),
        )
        .otherwise(F.lit(""))
    )
    return (
        metrics.withColumn("magnitude_after", after)
        .withColumn("reason", reason)
        .select(
            "capture_id",
            (F.col("reason") == "").alias("applied"),
            "magnitude",
            F.when(F.col("reason") == "", F.col("magnitude_after")).alias("magnitude_after"),
            F.when(F.col("reason") == "", g).alias("gain_imbalance"),
            F.when(F.col("reason") == "", F.col("phase_imbalance_deg")).alias("phase_imbalance_deg"),
            "reason",
        )
    )


# -- timing -------------------------------------------------------------------


def timing(samples: DataFrame, sps: int) -> DataFrame:
    """Timing phase and coherence of the symbol-rate line of the squared envelope.

    Mean removal is folded into the sums: sum((p - mean) e) = sum(p e) - mean sum(e).
    """
    p = power(F.col("i"), F.col("q"))
    turn = F.col("n") % sps * (-TWO_PI / sps)
    sums = samples.groupBy("capture_id").agg(
        F.count("*").alias("num"),
        F.avg(p).alias("mean"),
        F.var_pop(p).alias("var"),
        F.sum(p * F.cos(turn)).alias("pc"),
        F.sum(p * F.sin(turn)).alias("ps"),
        F.sum(F.cos(turn)).alias("c"),
        F.sum(F.sin(turn)).alias("s"),
    )
    re = F.col("pc") - F.col("mean") * F.col("c")
    im = F.col("ps") - F.col("mean") * F.col("s")
    tau = F.pmod(F.atan2(im, re) / TWO_PI * sps, F.lit(float(sps)))
    energy = F.col("var") * F.col("num")
    return sums.select(
        "capture_id",
        tau.alias("tau"),
        F.when(tau > sps / 2.0, tau - sps).otherwise(tau).alias("offset"),
        F.when(energy > 0, magnitude(re, im) / energy).otherwise(F.lit(0.0)).alias("coherence"),
    )


