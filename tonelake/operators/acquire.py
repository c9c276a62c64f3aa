"""Spreading-code acquisition, despreading, and the video line-rate hint."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.scalars import TWO_PI, power
from tonelake.operators.spectrum import hann_at, whole_power
from tonelake.operators.stats import exact_quantiles
from tonelake.session import pin

# Chip rate, code length and the two selector taps of codes 1 to 32.
CHIP_RATE = 1_023_000.0
CODE_CHIPS = 1023
CODE_TAPS = (
    (2, 6), (3, 7), (4, 8), (5, 9), (1, 9), (2, 10), (1, 8), (2, 9), (3, 10), (2, 3), (3, 4), (5, 6), (6, 7), (7, 8),
    (8, 9), (9, 10), (1, 4), (2, 5), (3, 6), (4, 7), (5, 8), (6, 9), (1, 3), (4, 6), (5, 7), (6, 8), (7, 9), (8, 10),
    (1, 6), (2, 7), (3, 8), (4, 9),
)
FEEDBACK_1 = (3, 10)
FEEDBACK_2 = (2, 3, 6, 8, 9, 10)

# Fixed values of the method.
THRESHOLD = 2.5
MARGINAL = 1.5
PLAUSIBLE_CN0 = (25.0, 60.0)
DOPPLER_RANGE = 5000.0
DOPPLER_STEP = 250.0
#: Blocks of 1 ms whose correlation power a task adds up before it is shuffled.
BLOCK_CHUNK = 256


def spreading_code(number: int) -> np.ndarray:
    """Chips (0/1) of code 1..32: two ten-stage registers, the second read at two taps."""
    a, b = CODE_TAPS[number - 1]
    one, two = [1] * 10, [1] * 10
    chips = []
    for _ in range(CODE_CHIPS):
        chips.append(one[9] ^ two[a - 1] ^ two[b - 1])
        one.insert(0, sum(one[s - 1] for s in FEEDBACK_1) & 1)
        two.insert(0, sum(two[s - 1] for s in FEEDBACK_2) & 1)
        one.pop()
        two.pop()
    return np.array(chips, dtype=np.int8)


def replica(number: int, sample_rate: float, size: int) -> np.ndarray:
    """The code as +-1 at the sample rate."""
    at = (np.arange(size) * CHIP_RATE / sample_rate).astype(np.int64) % CODE_CHIPS
    return np.where(spreading_code(number)[at] > 0, 1.0, -1.0)


def _block_count(num: Column, size: int, max_blocks: int | None) -> Column:
    whole = F.floor(num / size)
    return whole if max_blocks is None else F.least(whole, F.lit(max_blocks))


def acquire(samples: DataFrame, sample_rate: float, codes: tuple[int, ...] = tuple(range(1, 33)), max_blocks: int | None = None,
            doppler_range: float = DOPPLER_RANGE, doppler_step: float = DOPPLER_STEP, threshold: float = THRESHOLD) -> DataFrame:
    """Best Doppler, code phase and peak metric of every capture and code.

    All whole blocks of 1 ms enter, or the first ``max_blocks`` where the caller sets it.
    Correlation power is added up over chunks of BLOCK_CHUNK blocks, then per code and
    Doppler, so a long capture is spread over tasks; the best Doppler is picked in SQL.
    """
    size = int(round(sample_rate * 0.001))
    counts = samples.groupBy("capture_id").agg(F.count("*").alias("num"), F.avg(power(F.col("i"), F.col("q"))).alias("p"))
    reason = (
        F.when(~(F.col("p") > 0), F.lit("no usable samples"))
        .when(F.lit(sample_rate < 2.0 * CHIP_RATE), F.lit("sample rate cannot resolve the code"))
        .when(F.col("num") < size, F.lit("capture shorter than one code period"))
        .otherwise(F.lit(""))
    )
    plans = counts.select("capture_id", reason.alias("reason"), _block_count(F.col("num"), size, max_blocks).alias("n_blocks"), "p")
    # Stored, so that its size is known: the samples of a long capture are not sent to one task for the join.
    plans = pin(plans)
    usable = plans.where(F.col("reason") == "")
    block = F.floor(F.col("n") / size)
    # One shuffle: blocks are gathered where their chunk is.
    blocks = (
        samples.join(usable, "capture_id")
        .where(block < F.col("n_blocks"))
        .select(
            "capture_id", F.floor(block / BLOCK_CHUNK).alias("chunk"), block.alias("block"), "n",
            (F.col("i") / F.sqrt("p")).alias("i"), (F.col("q") / F.sqrt("p")).alias("q"),
        )
        .repartition("capture_id", "chunk")
        .groupBy("capture_id", "chunk", "block")
        .agg(F.sort_array(F.collect_list(F.struct("n", "i", "q"))).alias("c"))
        .select("capture_id", "chunk", F.col("c.i").alias("i"), F.col("c.q").alias("q"))
    )
    half = int(round(doppler_range / doppler_step))
    id_type = samples.schema["capture_id"].dataType.simpleString()
    lobe = max(1, math.ceil(size / CODE_CHIPS))

    def correlate(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["i"].to_numpy()) + 1j * np.stack(rows["q"].to_numpy())
        spectra = {c: np.conj(np.fft.fft(replica(c, sample_rate, size))) for c in codes}
        out = []
        for k in range(-half, half + 1):
            # The phase at the start of a block does not change its power.
            spec = np.fft.fft(x * np.exp(-2j * np.pi * k * doppler_step * np.arange(size) / sample_rate), axis=1)
            for c in codes:
                y = np.fft.ifft(spec * spectra[c], axis=1)
                out.append((key[0], c, k, (y.real**2 + y.imag**2).sum(axis=0).tobytes()))
        return pd.DataFrame(out, columns=["capture_id", "code", "bin", "acc"])

    def settle(batches):
        held, acc = None, None

        def row() -> tuple:
            at = int(np.argmax(acc))
            rest = np.delete(acc, np.s_[max(0, at - lobe) : at + lobe + 1])
            second = float(rest.max()) if rest.size else 0.0
            peak = float(acc[at])
            metric = min(peak / second, 1e12) if second > 0 else (1e12 if peak > 0 else 0.0)
            return (*held[:2], held[2] * doppler_step, at, peak, metric, peak / float(acc.mean()))

        names = ["capture_id", "code", "doppler_hz", "code_phase", "peak", "metric", "peak_over_mean"]
        for batch in batches:
            out = []
            for capture, code, k, data in batch.itertuples(index=False, name=None):
                part = np.frombuffer(data)
                if held == (capture, code, k):
                    acc = acc + part
                    continue
                if held is not None:
                    out.append(row())
                held, acc = (capture, code, k), part
            yield pd.DataFrame(out, columns=names)
        if held is not None:
            yield pd.DataFrame([row()], columns=names)

    cells = (
        blocks.groupBy("capture_id", "chunk")
        .applyInPandas(correlate, f"capture_id {id_type}, code int, bin int, acc binary")
        .repartition("capture_id", "code", "bin")
        .sortWithinPartitions("capture_id", "code", "bin")
        .mapInPandas(
            settle,
            f"capture_id {id_type}, code int, doppler_hz double, code_phase long, peak double, metric double, peak_over_mean double",
        )
    )
    best = cells.groupBy("capture_id", "code").agg(
        F.max_by(F.struct("doppler_hz", "code_phase", "metric", "peak_over_mean"), F.struct("peak", -F.col("doppler_hz"))).alias("b")
    )
    all_codes = plans.select("capture_id", "reason", "n_blocks", F.explode(F.array(*[F.lit(c) for c in codes])).alias("code"))
    return all_codes.join(best, ["capture_id", "code"], "left").select(
        "capture_id",
        "code",
        F.coalesce(F.col("b.metric") >= threshold, F.lit(False)).alias("acquired"),
        F.coalesce("b.doppler_hz", F.lit(0.0)).alias("doppler_hz"),
        F.coalesce("b.code_phase", F.lit(0)).cast("long").alias("code_phase"),
        (F.coalesce("b.code_phase", F.lit(0)) * (CODE_CHIPS / size)).alias("code_phase_chips"),
        F.coalesce("b.metric", F.lit(0.0)).alias("metric"),
        F.coalesce("b.peak_over_mean", F.lit(0.0)).alias("peak_over_mean"),
        F.when(F.col("reason") == "", F.col("n_blocks")).otherwise(F.lit(0)).alias("n_blocks"),
        "reason",
    )


def code_chips(df: DataFrame, sample_rate: float, codes: tuple[int, ...]) -> DataFrame:
    """Dimension (code, at, chip): one code period at the sample rate, a bounded table."""
    size = int(round(sample_rate * 0.001))
    rows = [(c, replica(c, sample_rate, size).tolist()) for c in codes]
    table = df.sparkSession.createDataFrame(rows, "code int, chips array<double>")
    return table.select("code", F.posexplode("chips").alias("at", "chip"))


def despread(samples: DataFrame, acquired: DataFrame, sample_rate: float, max_blocks: int | None = None) -> DataFrame:
    """Prompt value of every 1 ms block that was acquired, at the acquired Doppler and code phase.

    ``max_blocks`` cuts to the first blocks where the caller sets it.
    """
    size = int(round(sample_rate * 0.001))
    chips = code_chips(samples, sample_rate, tuple(range(1, 33)))
    hits = acquired.where("acquired").select("capture_id", "code", "doppler_hz", "code_phase", "n_blocks")
    turn = -TWO_PI * F.col("doppler_hz") * F.col("n") / sample_rate
    aligned = (
        (samples if max_blocks is None else samples.where(F.col("n") < size * max_blocks))
        .join(hits, "capture_id")
        .where(F.col("n") < F.col("n_blocks") * size)
        .withColumn("at", F.pmod(F.col("n") - F.col("code_phase"), F.lit(size)).cast("int"))
        .join(F.broadcast(chips), ["code", "at"])
    )
    return aligned.groupBy("capture_id", "code", F.floor(F.col("n") / size).alias("block")).agg(
        F.sum(F.col("chip") * (F.col("i") * F.cos(turn) - F.col("q") * F.sin(turn))).alias("re"),
        F.sum(F.col("chip") * (F.col("i") * F.sin(turn) + F.col("q") * F.cos(turn))).alias("im"),
    )


def carrier_report(prompts: DataFrame, acquired: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Signs, carrier-to-noise density and flags of every acquired code."""
    moments = prompts.groupBy("capture_id", "code").agg(
        F.count("*").alias("blocks"),
        F.avg("re").alias("re"),
        F.avg("im").alias("im"),
        (F.var_pop("re") + F.var_pop("im")).alias("var"),
        F.sort_array(F.collect_list(F.struct("block", (F.col("re") >= 0).cast("int").alias("sign")))).alias("s"),
    )
    signal = power(F.col("re"), F.col("im"))
    cn0 = F.when((F.col("blocks") >= 2) & (F.col("var") > 0) & (signal > 0), 10.0 * F.log10(signal / F.col("var")) + 30.0)
    return acquired.where("acquired").join(moments, ["capture_id", "code"]).select(
        "capture_id",
        "code",
        "metric",
        cn0.alias("cn0_dbhz"),
        F.col("s.sign").alias("prompt_signs"),
        (F.col("metric") < MARGINAL * threshold).alias("marginal"),
        F.coalesce((cn0 < PLAUSIBLE_CN0[0]) | (cn0 > PLAUSIBLE_CN0[1]), F.lit(False)).alias("implausible"),
    )


# -- line-rate hint -----------------------------------------------------------

# Fixed values of the method.
LINE_RATE_HZ = 15_734.25
LINE_SEARCH = 0.015
LINE_MIN_PROMINENCE = 8.0
HARMONIC_MIN_PROMINENCE = 6.0
LINE_MAX_CONFIDENCE = 0.8
ENVELOPE_MIN_VARIATION = 1e-4
EXCLUDED_BINS = 2
MEDIAN_HALF_WIDTH_HZ = 2000.0
MIN_WINDOW_BINS = 8


def line_rate(samples: DataFrame, sample_rate: float) -> DataFrame:
    """Does the envelope show the video line rate and its second harmonic?

    The line needs the resolution of the whole capture: its transform is split over tasks,
    and only the bins around the line and its harmonic leave it.
    """
    env = F.sqrt(power(F.col("i"), F.col("q")))
    sums = samples.groupBy("capture_id").agg(F.count("*").alias("num"), F.avg(env).alias("mean"), F.stddev_pop(env).alias("std"))
    top = LINE_RATE_HZ * (1 + LINE_SEARCH)
    flat = F.col("std") / F.col("mean") < ENVELOPE_MIN_VARIATION
    early = (
        F.when(F.col("num") < 64, F.lit("too few samples for a line-sync test"))
        .when(F.lit(sample_rate / 2.0 < 2.0 * top), F.lit("sample rate cannot show the 2nd harmonic"))
        .when(~(F.col("mean") > 0), F.lit("envelope has no usable dynamic range"))
        .when(flat, F.lit("constant envelope"))
    )
    plans = sums.withColumn("early", early).withColumn("width", sample_rate / F.col("num"))
    window = hann_at(F.col("n"), F.col("num"))
    centred = samples.join(plans.where(F.col("early").isNull()), "capture_id").select(
        "capture_id", "num", "n", ((env - F.col("mean")) * window).alias("i"), F.lit(0.0).alias("q")
    )

    def near_lines(bins: np.ndarray, num: int) -> np.ndarray:
        width = sample_rate / num
        # One bin more than the background of any peak can reach.
        reach = max(MIN_WINDOW_BINS, MEDIAN_HALF_WIDTH_HZ / width) + EXCLUDED_BINS + 2
        low, high = LINE_RATE_HZ * (1 - LINE_SEARCH) / width, LINE_RATE_HZ * (1 + LINE_SEARCH) / width
        return (2 * bins <= num) & (
            ((bins >= low - reach) & (bins <= high + reach)) | ((bins >= 2 * low - reach) & (bins <= 2 * high + reach))
        )

    spectrum = pin(
        whole_power(centred, near_lines).select(
            "capture_id", "bin", F.sqrt("p").alias("mag"), (F.col("bin") * sample_rate / F.col("num")).alias("freq"),
            (F.lit(sample_rate) / F.col("num")).alias("width"),
        )
    )
    inside = F.col("freq").between(LINE_RATE_HZ * (1 - LINE_SEARCH), LINE_RATE_HZ * (1 + LINE_SEARCH))
    fund = spectrum.where(inside).groupBy("capture_id").agg(
        F.count("*").alias("window"), F.max_by(F.struct("bin", "mag", "freq"), F.struct("mag", -F.col("bin"))).alias("f"), F.first("width").alias("w")
    )
    half = F.greatest(F.lit(MIN_WINDOW_BINS).cast("double"), F.bround(MEDIAN_HALF_WIDTH_HZ / F.col("w")))

    tied = spectrum.join(fund, "capture_id")
    harm = tied.where(F.abs(F.col("bin") - 2 * F.col("f.bin")) <= EXCLUDED_BINS).groupBy("capture_id").agg(
        F.max_by(F.struct("bin", "mag"), F.struct("mag", -F.col("bin"))).alias("h")
    )
    peaks = pin(fund.join(harm, "capture_id", "left"))

    def background(peak: str, median: str, count: str) -> DataFrame:
        gap = F.abs(F.col("bin") - F.col(peak))
        near = spectrum.join(peaks, "capture_id").where((gap > EXCLUDED_BINS) & (gap <= half)).select("capture_id", "mag")
        medians = exact_quantiles(near, "mag", [0.5]).withColumnRenamed("q0", median)
        return near.groupBy("capture_id").agg(F.count("*").alias(count)).join(medians, "capture_id")

    scored = peaks.select("capture_id", "window", "f", "h").join(background("f.bin", "fmed", "fcnt"), "capture_id", "left").join(
        background("h.bin", "hmed", "hcnt"), "capture_id", "left"
    )
    prom, hprom = F.col("f.mag") / F.col("fmed"), F.col("h.mag") / F.col("hmed")
    reason = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.coalesce("window", F.lit(0)) < MIN_WINDOW_BINS, F.lit("insufficient frequency resolution"))
        .when((F.coalesce("fcnt", F.lit(0)) < 4) | ~(F.col("f.mag") > 0), F.lit("no measurable envelope line"))
        .when(~(F.col("fmed") > 0), F.lit("no measurable envelope background"))
        .when(prom < LINE_MIN_PROMINENCE, F.lit("no line at the video rate"))
        .when((F.coalesce("hcnt", F.lit(0)) < 8) | ~(F.col("h.mag") > 0), F.lit("2nd harmonic is not measurable"))
        .when(~(F.col("hmed") > 0), F.lit("2nd harmonic background is not measurable"))
        .when(hprom < HARMONIC_MIN_PROMINENCE, F.lit("no 2nd harmonic"))
        .otherwise(F.lit("envelope line with 2nd harmonic"))
    )
    found = F.col("reason") == "envelope line with 2nd harmonic"
    confidence = F.least(F.lit(LINE_MAX_CONFIDENCE), F.greatest(F.lit(0.0), 10.0 * F.log10(F.least(prom, hprom)) / 25.0))
    return plans.select("capture_id", "early").join(scored, "capture_id", "left").withColumn("reason", reason).select(
        "capture_id",
        found.alias("found"),
        F.when(found, F.col("f.freq")).alias("line_rate_hz"),
        F.when(found, confidence).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(found | (F.col("reason") == "no 2nd harmonic"), F.col("h.mag") / F.col("f.mag")).otherwise(F.lit(0.0)).alias("harmonic_ratio"),
        "reason",
    )
