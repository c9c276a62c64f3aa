"""Constellations, slicing into bits, tone decisions and constellation quality.

Nearest points are found by arithmetic (sign, level or sector), not by joining every
sample with every point, so the decisions stay in generated code.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tonelake.functions.bits import from_gray, to_gray
from tonelake.functions.scalars import TWO_PI, clamp, power, rotate
from tonelake.operators.stats import exact_quantiles, normalise_peak, normalise_power
from tonelake.session import pin
from tonelake.sources.series import DEFAULT_BLOCK, to_blocks, with_lookahead

# Bits per symbol, rotational symmetry, and aliases of the schemes.
BITS_PER_SYMBOL = {"BPSK": 1, "QPSK": 2, "8PSK": 3, "16-QAM": 4, "64-QAM": 6, "2-FSK": 1, "4-FSK": 2}
ROTATION_ORDER = {"BPSK": 2, "QPSK": 4, "8PSK": 8, "16-QAM": 4, "64-QAM": 4}
LINEAR_SCHEMES = ("BPSK", "QPSK", "8PSK", "16-QAM", "64-QAM")
SCHEME_ALIASES = {
    "BPSK": "BPSK",
    "QPSK": "QPSK",
    "4-QAM": "QPSK",
    "4QAM": "QPSK",
    "8PSK": "8PSK",
    "8-PSK": "8PSK",
    "16-QAM": "16-QAM",
    "QAM16": "16-QAM",
    "16QAM": "16-QAM",
    "64-QAM": "64-QAM",
    "QAM64": "64-QAM",
    "64QAM": "64-QAM",
    "2-FSK": "2-FSK",
    "2FSK": "2-FSK",
    "FSK": "2-FSK",
    "4-FSK": "4-FSK",
    "4FSK": "4-FSK",
}

# Fixed values of the methods.
QAM16_OUTER = 0.6
FSK_MIN_PERIOD = 3
FSK_MAX_RESIDUAL = 0.15
FSK_NEAR_TIE = 1.6
FIT_EVM_WARN = 30.0

_AXIS_LEVELS = {"QPSK": 2, "16-QAM": 4, "64-QAM": 8}
_SCALE = {"QPSK": math.sqrt(2.0), "16-QAM": math.sqrt(10.0), "64-QAM": math.sqrt(42.0)}


# -- labels -------------------------------------------------------------------


def canonical_scheme(label: Column) -> Column:
    """Canonical spelling of a modulation label, NULL for an unknown one."""
    key = F.trim(F.regexp_replace(F.upper(label), "_", "-"))
    pairs = [F.lit(v) for item in SCHEME_ALIASES.items() for v in item]
    return F.element_at(F.create_map(*pairs), key)


def requested_scheme(label: Column) -> tuple[Column, Column]:
    """(scheme, warning): unknown labels fall back to BPSK and say so."""
    known = canonical_scheme(label)
    warning = F.concat(F.lit("Unsupported modulation '"), F.upper(label), F.lit("'. Used BPSK fallback."))
    return F.coalesce(known, F.lit("BPSK")), F.when(known.isNull(), warning)


# -- points -------------------------------------------------------------------


def _level(x: Column, levels: int) -> Column:
    """Index of the nearest of the odd levels -(L-1)..(L-1); the lower one on ties."""
    return clamp(F.ceil((x + (levels - 1)) / 2.0 - 0.5), 0, levels - 1).cast("int")


def _sector(i: Column, q: Column) -> Column:
    return F.pmod(F.bround(F.atan2(q, i) * 8.0 / TWO_PI).cast("int"), F.lit(8))


def nearest_point(scheme: str, i: Column, q: Column) -> tuple[Column, Column, Column]:
    """(index, i, q) of the nearest point of the unit-power constellation.

    Points are numbered row by row over F.col("i") then F.col("q"); ties go to the lowest index.
    """
    if scheme == "BPSK":
        index = (i > 0).cast("int")
        return index, (2 * index - 1).cast("double"), F.lit(0.0)
    if scheme == "8PSK":
        k = _sector(i, q)
        return k, F.cos(k * (TWO_PI / 8.0)), F.sin(k * (TWO_PI / 8.0))
    levels, scale = _AXIS_LEVELS[scheme], _SCALE[scheme]
    a, b = _level(i * scale, levels), _level(q * scale, levels)
    return a * levels + b, (2 * a - (levels - 1)) / scale, (2 * b - (levels - 1)) / scale


def ideal_points(scheme: str) -> list[tuple[float, float]]:
    """The constellation as a list, in index order."""
    if scheme == "BPSK":
        return [(-1.0, 0.0), (1.0, 0.0)]
    if scheme == "8PSK":
        return [(math.cos(TWO_PI * k / 8), math.sin(TWO_PI * k / 8)) for k in range(8)]
    if scheme not in _AXIS_LEVELS:
        return []
    levels, scale = _AXIS_LEVELS[scheme], _SCALE[scheme]
    axis = [(2 * k - (levels - 1)) / scale for k in range(levels)]
    return [(a, b) for a in axis for b in axis]


def label_to_point(scheme: str, label: Column) -> tuple[Column, Column]:
    """Bit group (most significant bit first) to its Gray-labelled constellation point."""
    if scheme == "BPSK":
        return (2 * label - 1).cast("double"), F.lit(0.0)
    if scheme == "8PSK":
        angle = from_gray(label, 3) * (TWO_PI / 8.0)
        return F.cos(angle), F.sin(angle)
    levels, scale = _AXIS_LEVELS[scheme], _SCALE[scheme]
    width = levels.bit_length() - 1
    i_bits = F.shiftright(label, width)
    q_bits = label.bitwiseAND(F.lit(levels - 1))
    return (
        (2 * from_gray(i_bits, width) - (levels - 1)) / scale,
        (2 * from_gray(q_bits, width) - (levels - 1)) / scale,
    )


def _levels(x: np.ndarray, levels: int) -> np.ndarray:
    return np.clip(np.ceil((x + (levels - 1)) / 2.0 - 0.5), 0, levels - 1).astype(np.int64)


def _sectors(x: np.ndarray) -> np.ndarray:
    return np.round(np.arctan2(x.imag, x.real) * 8.0 / TWO_PI).astype(np.int64) % 8


def nearest_points(scheme: str, x: np.ndarray) -> np.ndarray:
    """``nearest_point`` for an array of samples: the constellation points themselves."""
    if scheme == "BPSK":
        return np.where(x.real > 0, 1.0, -1.0).astype(np.complex128)
    if scheme == "8PSK":
        return np.exp(1j * (_sectors(x) * (TWO_PI / 8.0)))
    levels, scale = _AXIS_LEVELS[scheme], _SCALE[scheme]
    a, b = _levels(x.real * scale, levels), _levels(x.imag * scale, levels)
    return ((2 * a - (levels - 1)) + 1j * (2 * b - (levels - 1))) / scale


def sliced_bits(scheme: str, x: np.ndarray, by_level: bool = False) -> np.ndarray:
    """``symbol_bits`` for an array of samples: a row of bits for each."""
    i, q = x.real, x.imag
    if scheme == "BPSK":
        columns = [i > 0]
    elif scheme == "QPSK":
        columns = [i > 0, q > 0]
    elif scheme == "16-QAM" and not by_level:
        columns = [c for v in (i, q) for c in (v > 0, np.abs(v) <= QAM16_OUTER)]
    else:
        per_axis = 3 if scheme == "8PSK" else _AXIS_LEVELS[scheme].bit_length() - 1
        groups = [(_sectors(x), 3)] if scheme == "8PSK" else [(_levels(v * _SCALE[scheme], _AXIS_LEVELS[scheme]), per_axis) for v in (i, q)]
        columns = [(g ^ (g >> 1)) >> (width - 1 - j) & 1 for g, width in groups for j in range(width)]
    return np.stack(columns, axis=1).astype(np.uint8)


# -- slicing ------------------------------------------------------------------


def _spread(value: Column, width: int) -> list[Column]:
    return [F.shiftright(value, width - 1 - j).bitwiseAND(F.lit(1)) for j in range(width)]


def symbol_bits(scheme: str, i: Column, q: Column, by_level: bool = False) -> Column:
    """Array of the bits of one symbol.

    ``by_level`` decides 16-QAM by the nearest level of a unit-power symbol; otherwise by
    the sign and the 0.6 threshold of a peak-normalised one.
    """

    def sign(x: Column) -> Column:
        return (x > 0).cast("int")

    if scheme == "BPSK":
        bits = [sign(i)]
    elif scheme == "QPSK":
        bits = [sign(i), sign(q)]
    elif scheme == "8PSK":
        bits = _spread(to_gray(_sector(i, q)), 3)
    elif scheme == "16-QAM" and not by_level:
        bits = [b for x in (i, q) for b in (sign(x), (F.abs(x) <= QAM16_OUTER).cast("int"))]
    else:
        levels, scale = _AXIS_LEVELS[scheme], _SCALE[scheme]
        width = levels.bit_length() - 1
        bits = [b for x in (i, q) for b in _spread(to_gray(_level(x * scale, levels)), width)]
    return F.array(*bits)


def _explode_bits(df: DataFrame, bits: Column, keys: list[str]) -> DataFrame:
    return (
        df.select(*keys, "n", bits.alias("bits"))
        .select(*keys, "n", F.size("bits").alias("width"), F.posexplode("bits").alias("j", "bit"))
        .select(*keys, (F.col("n") * F.col("width") + F.col("j")).alias("pos"), "bit")
    )


def slice_linear(samples: DataFrame, scheme: str) -> DataFrame:
    """Bits of a phase-aligned, symbol-spaced capture: (capture_id, pos, bit)."""
    signed_only = scheme in ("BPSK", "QPSK", "8PSK")  # scale does not change these decisions
    scaled = samples if signed_only else normalise_peak(samples)
    return _explode_bits(scaled, symbol_bits(scheme, F.col("i"), F.col("q")), ["capture_id"])


def slice_candidates(samples: DataFrame, schemes: tuple[str, ...] = LINEAR_SCHEMES) -> DataFrame:
    """Bits under several schemes at once: (capture_id, scheme, pos, bit)."""
    options = F.array(*[F.struct(F.lit(s).alias("scheme"), symbol_bits(s, F.col("i"), F.col("q")).alias("bits")) for s in schemes])
    return (
        normalise_peak(samples)
        .select("capture_id", "n", F.explode(options).alias("o"))
        .select("capture_id", "n", "o.scheme", F.size("o.bits").alias("width"), F.posexplode("o.bits").alias("j", "bit"))
        .select("capture_id", "scheme", (F.col("n") * F.col("width") + F.col("j")).alias("pos"), "bit")
    )


def slice_by_scheme(samples: DataFrame, freqs: DataFrame, labels: DataFrame, periods: DataFrame) -> DataFrame:
    """Slice every capture as its ``labels.scheme`` says, tone schemes by their ``period``."""
    tagged = normalise_peak(samples).join(labels, "capture_id")
    chosen = None
    for s in LINEAR_SCHEMES:
        bits = symbol_bits(s, F.col("i"), F.col("q"))
        chosen = F.when(F.col("scheme") == s, bits) if chosen is None else chosen.when(F.col("scheme") == s, bits)
    linear = _explode_bits(tagged.where(F.col("scheme").isin(*LINEAR_SCHEMES)), chosen, ["capture_id"])
    result = linear
    for s, order in (("2-FSK", 2), ("4-FSK", 4)):
        mine = labels.where(F.col("scheme") == s).select("capture_id")
        result = result.unionByName(slice_tones(freqs.join(mine, "capture_id", "left_semi"), periods, order))
    return result


# -- tone captures ------------------------------------------------------------


def array_median(values: Column) -> Column:
    """Median of a non-empty array of doubles."""
    ordered = F.array_sort(values)
    half = F.floor((F.size(values) - 1) / 2).cast("int")
    upper = F.floor(F.size(values) / 2).cast("int")
    return (F.get(ordered, half) + F.get(ordered, upper)) / 2.0


_SCORES = T.ArrayType(T.StructType([T.StructField("period", T.LongType()), T.StructField("dev", T.DoubleType())]))


@pandas_udf(_SCORES)
def _median_deviation(
    f: pd.Series, start: pd.Series, own: pd.Series, m: pd.Series, lo: pd.Series, hi: pd.Series
) -> pd.Series:
    """Per candidate period: summed distance to the median of every symbol that starts in the block."""
    out = []
    for values, s, o, total, first, last in zip(f, start, own, m, lo, hi):
        x = np.asarray(values, dtype=np.float64)
        rows = []
        for p in range(first, last + 1):
            begin = -(-s // p)
            end = min(-(-(s + o) // p), total // p)
            if end > begin:
                part = x[begin * p - s : end * p - s].reshape(-1, p)
                rows.append({"period": p, "dev": float(np.abs(part - np.median(part, axis=1, keepdims=True)).sum())})
        out.append(rows)
    return pd.Series(out)


def _long_period_deviation(freqs: DataFrame, plans: DataFrame) -> DataFrame:
    """The same sums by grouping rows, for periods longer than a block."""
    symbol = F.floor(F.col("n") / F.col("period"))
    each = plans.select("capture_id", "m", F.explode(F.sequence("lo", "hi")).alias("period"))
    return (
        freqs.join(each, "capture_id")
        .where(symbol < F.floor(F.col("m") / F.col("period")))
        .groupBy("capture_id", "period", symbol.alias("symbol"))
        .agg(F.collect_list("f").alias("fs"))
        .withColumn("med", array_median(F.col("fs")))
        .select("capture_id", "period", F.aggregate("fs", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("med"))).alias("dev"))
    )


def tone_periods(
    freqs: DataFrame,
    min_period: int = FSK_MIN_PERIOD,
    max_residual: float = FSK_MAX_RESIDUAL,
    block_len: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Symbol period of a tone-keyed capture from its instantaneous frequency; 1 = unresolved.

    The lag-1 autocorrelation centres the search; each candidate period is scored by how
    well per-symbol medians reproduce the series. The series is cut into blocks that also
    hold the block after them, so all candidates are scored on one shuffled copy of the
    data and only one sum per block and candidate goes on.
    """
    means = freqs.groupBy("capture_id").agg(
        F.count("*").alias("m"), F.avg("f").alias("mean"), F.avg(F.abs("f")).alias("scale")
    )
    rows = freqs.select("capture_id", "n", F.col("f").alias("i"), F.lit(0.0).alias("q"))
    haloed = with_lookahead(to_blocks(rows, block_len), block_len, block_len)
    blocks = pin(haloed.select("capture_id", "start_n", F.col("i").alias("f"), "own_len"))
    known = pin(means)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    mean = F.col("mean")
    own, later = F.slice("f", F.lit(1), F.col("own_len")), F.slice("f", F.lit(2), F.col("own_len"))
    lagged = (
        blocks.join(known, "capture_id")
        .groupBy("capture_id")
        .agg(
            F.sum(total(F.zip_with(own, later, lambda x, y: (x - mean) * (y - mean)))).alias("c1"),
            F.sum(total(F.transform(own, lambda x: (x - mean) * (x - mean)))).alias("c0"),
            F.first("m").alias("m"),
            F.first("scale").alias("scale"),
        )
    )
    plans = pin(tone_plans(lagged, min_period))
    return tone_scores(blocks, freqs, plans, known, block_len, max_residual)


def tone_plans(lagged: DataFrame, min_period: int = FSK_MIN_PERIOD) -> DataFrame:
    """(capture_id, m, scale, lo, hi): candidate periods around the centre that the lag-1 autocorrelation names.

    ``lagged(capture_id, m, scale, c0, c1)``: number and mean size of the steps, and their sums of
    squares and lag-1 products about the mean.
    """
    r1 = F.when(F.col("c0") > 0, F.col("c1") / F.col("c0"))
    centre = F.try_divide(F.lit(1.0), 1.0 - F.col("r1"))
    reach = F.greatest(F.lit(4), F.ceil(0.06 * F.col("centre")))
    return (
        lagged.withColumn("r1", r1)
        .where((F.col("m") >= 63) & (F.col("r1") > 0) & (F.col("r1") < 1) & (F.col("scale") > 0))
        .withColumn("centre", centre)
        .where(F.col("centre") >= min_period)
        .select(
            "capture_id",
            "m",
            "scale",
            F.greatest(F.lit(min_period), F.floor("centre") - reach).cast("long").alias("lo"),
            # Fewer than four symbols are no evidence.
            F.least(F.ceil("centre") + reach, F.floor(F.col("m") / 4)).cast("long").alias("hi"),
        )
        .where(F.col("lo") <= F.col("hi"))
    )


def tone_scores(
    blocks: DataFrame, freqs: DataFrame, plans: DataFrame, known: DataFrame, block_len: int, max_residual: float = FSK_MAX_RESIDUAL
) -> DataFrame:
    """(capture_id, period, residual) of all of ``known``; ``blocks(capture_id, start_n, f, own_len)`` hold one more block of steps each."""
    short = (
        blocks.join(plans.where(F.col("hi") <= block_len), "capture_id")
        .select("capture_id", F.explode(_median_deviation("f", "start_n", "own_len", "m", "lo", "hi")).alias("s"))
        .select("capture_id", "s.period", "s.dev")
    )
    long = _long_period_deviation(freqs, plans.where(F.col("hi") > block_len))
    used = F.floor(F.first("m") / F.col("period")) * F.col("period")
    scored = (
        short.unionByName(long)
        .join(plans.select("capture_id", "m", "scale"), "capture_id")
        .groupBy("capture_id", "period")
        .agg((F.sum("dev") / used / F.first("scale")).alias("residual"))
    )
    best = scored.groupBy("capture_id").agg(
        F.min("residual").alias("best"),
        F.max_by("period", F.struct(-F.col("residual"), F.col("period"))).alias("best_period"),
        F.collect_list(F.struct("period", "residual")).alias("all"),
    )
    near = F.array_max(F.transform(F.filter("all", lambda s: s["residual"] <= F.col("best") * FSK_NEAR_TIE), lambda s: s["period"]))
    answer = F.when(F.col("best") <= F.greatest(F.lit(max_residual), 2.0 / F.col("best_period")), near)
    return known.select("capture_id").join(best, "capture_id", "left").select(
        "capture_id", F.coalesce(answer, F.lit(1)).alias("period"), F.col("best").alias("residual")
    )


def tone_symbols(freqs: DataFrame, periods: DataFrame) -> DataFrame:
    """(capture_id, n, f): median frequency per symbol; per sample where the period is 1.

    The last frequency is repeated once, so that N samples give N frequencies.
    """
    ends = freqs.groupBy("capture_id").agg(F.max("n").alias("n"), F.max_by("f", "n").alias("f"))
    full = freqs.unionByName(ends.select("capture_id", (F.col("n") + 1).alias("n"), "f"))
    lengths = ends.select("capture_id", (F.col("n") + 2).alias("num"))
    joined = full.join(periods.select("capture_id", "period").join(lengths, "capture_id"), "capture_id")
    step = F.when(F.col("num") >= F.col("period"), F.greatest(F.col("period"), F.lit(1))).otherwise(F.lit(1))
    return (
        joined.withColumn("step", step)
        .groupBy("capture_id", F.floor(F.col("n") / F.col("step")).alias("n"))
        .agg(F.collect_list("f").alias("fs"), F.first("step").alias("step"))
        .where(F.size("fs") == F.col("step"))
        .select("capture_id", "n", array_median(F.col("fs")).alias("f"))
    )


def slice_tones(freqs: DataFrame, periods: DataFrame, order: int) -> DataFrame:
    """2- or 4-tone decisions: the sign, or the midpoints of four quantiles."""
    symbols = tone_symbols(freqs, periods)
    if order == 4:
        symbols = pin(symbols)  # read by the quantiles and by the decision
    if order == 2:
        return _explode_bits(symbols, F.array((F.col("f") > 0).cast("int")), ["capture_id"])
    marks = exact_quantiles(symbols, "f", [0.125, 0.375, 0.625, 0.875])
    label = sum((F.col("f") >= (F.col(f"q{k}") + F.col(f"q{k + 1}")) / 2.0).cast("int") for k in range(3))
    return _explode_bits(symbols.join(marks, "capture_id"), F.array(*_spread(label, 2)), ["capture_id"])


def tone_levels(symbols: DataFrame, order: int, iterations: int = 100) -> DataFrame:
    """1-D k-means of symbol frequencies: sorted centres and the separation residual.

    Lloyd steps are aggregations over all captures at once; a step moves ``order`` rows
    per capture, and the loop ends when no centre moves any more.
    """
    values = pin(symbols.select("capture_id", "f"))
    spans = values.groupBy("capture_id").agg(
        F.count("*").alias("num"), (F.max("f") - F.min("f")).alias("spread")
    ).where((F.col("num") >= order) & (F.col("spread") > 0))
    start = exact_quantiles(values, "f", [(k + 0.5) / order for k in range(order)])
    cols = [f"q{k}" for k in range(order)]
    centres = pin(start.join(spans, "capture_id").select("capture_id", "spread", F.array_sort(F.array(*cols)).alias("c")))

    def assigned(cs: DataFrame) -> DataFrame:
        ranked = F.array_min(
            F.transform("c", lambda c, k: F.struct(F.abs(F.col("f") - c).alias("d"), k.alias("k")))
        )
        return values.join(cs, "capture_id").withColumn("near", ranked)

    for _ in range(iterations):
        means = assigned(centres).groupBy("capture_id").agg(
            F.first("c").alias("c"),
            F.first("spread").alias("spread"),
            *[F.avg(F.when(F.col("near.k") == k, F.col("f"))).alias(f"m{k}") for k in range(order)],
        )
        moved = means.select(
            "capture_id",
            "spread",
            F.col("c").alias("old"),
            F.array(*[F.coalesce(F.col(f"m{k}"), F.col("c")[k]) for k in range(order)]).alias("c"),
        )
        stored = pin(moved)
        shift = F.array_max(F.zip_with("c", "old", lambda a, b: F.abs(a - b)))
        centres = stored.drop("old")
        if stored.where(shift > 1e-12 * F.col("spread")).isEmpty():
            break
    gap = (F.array_max("c") - F.array_min("c")) / (order - 1)
    final = centres.withColumn("c", F.array_sort("c"))
    return assigned(final).groupBy("capture_id").agg(
        *[F.first(F.col("c")[k]).alias(f"level{k}") for k in range(order)],
        (F.avg(F.col("near.d")) / F.first(gap)).alias("residual"),
    )


# -- quality ------------------------------------------------------------------


def symbol_means(samples: DataFrame, sps: int) -> DataFrame:
    """Average of every full symbol of ``sps`` samples."""
    if sps <= 1:
        return samples
    return (
        samples.groupBy("capture_id", F.floor(F.col("n") / sps).alias("n"))
        .agg(F.avg("i").alias("i"), F.avg("q").alias("q"), F.count("*").alias("members"))
        .where(F.col("members") == sps)
        .drop("members")
    )


def fit_table(samples: DataFrame, schemes: tuple[str, ...] = LINEAR_SCHEMES, sps: int = 1) -> DataFrame:
    """Error-vector magnitude of every capture under every scheme, in one pass.

    The sums of all schemes are columns of one aggregation and are turned into rows
    afterwards: (capture_id, scheme, n_symbols, evm_percent, mer_db).
    """
    symbols = symbol_means(samples, sps)
    means = symbols.groupBy("capture_id").agg(F.avg(power(F.col("i"), F.col("q"))).alias("p")).where(F.col("p") > 1e-20)
    unit = symbols.join(means, "capture_id").select(
        "capture_id", (F.col("i") / F.sqrt("p")).alias("i"), (F.col("q") / F.sqrt("p")).alias("q")
    )
    sums = []
    for k, scheme in enumerate(schemes):
        _, pi, pq = nearest_point(scheme, F.col("i"), F.col("q"))
        sums += [
            F.avg(power(F.col("i") - pi, F.col("q") - pq)).alias(f"e{k}"),
            F.avg(power(pi, pq)).alias(f"p{k}"),
        ]
    wide = unit.groupBy("capture_id").agg(F.count("*").alias("n_symbols"), *sums)
    ratio = F.sqrt(F.col("s.e") / F.col("s.p"))
    rows = F.array(*[
        F.struct(F.lit(s).alias("scheme"), F.col(f"e{k}").alias("e"), F.col(f"p{k}").alias("p")) for k, s in enumerate(schemes)
    ])
    return wide.select("capture_id", "n_symbols", F.explode(rows).alias("s")).select(
        "capture_id",
        F.col("s.scheme").alias("scheme"),
        "n_symbols",
        (ratio * 100.0).alias("evm_percent"),
        F.when(ratio > 0, -20.0 * F.log10(ratio)).alias("mer_db"),
    )


def fit_check(samples: DataFrame, labels: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Does the chosen scheme explain the samples? Other schemes are listed as context."""
    table = fit_table(samples)
    return fit_verdict(table, table if max_samples is None else fit_table(samples.where(F.col("n") < max_samples)), labels)


def fit_verdict(table: DataFrame, context: DataFrame, labels: DataFrame) -> DataFrame:
    """``fit_check`` from fit tables of the samples and of those that context is taken from."""
    own = table.join(labels, ["capture_id", "scheme"])
    others = (
        context
        .join(labels.withColumnRenamed("scheme", "chosen"), "capture_id")
        .where(F.col("scheme") != F.col("chosen"))
        .groupBy("capture_id")
        .agg(F.sort_array(F.collect_list(F.struct("evm_percent", "scheme"))).alias("table"))
    )
    fit_ok = F.col("evm_percent") <= FIT_EVM_WARN
    return own.join(others, "capture_id", "left").select(
        "capture_id",
        "scheme",
        "evm_percent",
        "mer_db",
        "n_symbols",
        fit_ok.alias("fit_ok"),
        F.when(~fit_ok, F.col("table")).alias("candidates"),
    )


def carrier_lock(samples: DataFrame, scheme: str) -> DataFrame:
    """Mean resultant length of ``order`` times the angle to the nearest point."""
    order = ROTATION_ORDER[scheme]
    _, pi, pq = nearest_point(scheme, F.col("i"), F.col("q"))
    turn = order * (F.atan2(F.col("q"), F.col("i")) - F.atan2(pq, pi))
    return (
        normalise_power(samples)
        .groupBy("capture_id")
        .agg(F.avg(F.cos(turn)).alias("c"), F.avg(F.sin(turn)).alias("s"))
        .select("capture_id", F.sqrt(power(F.col("c"), F.col("s"))).alias("lock"))
    )


# -- rotations ----------------------------------------------------------------


def rotation_bits(samples: DataFrame, scheme: str) -> DataFrame:
    """Bits of the capture under each symmetry rotation: (capture_id, rotation, pos, bit)."""
    order = ROTATION_ORDER[scheme]
    options = []
    for k in range(order):
        i, q = rotate((F.col("i"), F.col("q")), F.lit(TWO_PI * k / order))
        options.append(F.struct(F.lit(k).alias("rotation"), symbol_bits(scheme, i, q, by_level=True).alias("bits")))
    return (
        samples.select("capture_id", "n", F.explode(F.array(*options)).alias("o"))
        .select("capture_id", "n", "o.rotation", F.size("o.bits").alias("width"), F.posexplode("o.bits").alias("j", "bit"))
        .select("capture_id", "rotation", (F.col("n") * F.col("width") + F.col("j")).alias("pos"), "bit")
    )


def rotated_labels(scheme: str) -> list[tuple[int, int, int]]:
    """(rotation, label, label after rotating its ideal point), a small fixed dimension."""
    width = BITS_PER_SYMBOL[scheme]
    order = ROTATION_ORDER[scheme]
    points = ideal_points(scheme)

    def gray_inverse(v: int) -> int:
        out = v
        while v := v >> 1:
            out ^= v
        return out

    def point_of(label: int) -> int:
        if scheme in ("BPSK", "8PSK"):
            return gray_inverse(label)
        axis = width // 2
        return gray_inverse(label >> axis) * (1 << axis) + gray_inverse(label & ((1 << axis) - 1))

    home = {point_of(label): label for label in range(1 << width)}
    rows = []
    for k in range(order):
        c, s = math.cos(TWO_PI * k / order), math.sin(TWO_PI * k / order)
        for label in range(1 << width):
            a, b = points[point_of(label)]
            x, y = a * c - b * s, a * s + b * c
            nearest = min(range(len(points)), key=lambda p: (points[p][0] - x) ** 2 + (points[p][1] - y) ** 2)
            rows.append((k, label, home[nearest]))
    return rows


def best_bit_error_rate(tx: DataFrame, rx: DataFrame, scheme: str, lags: tuple[int, int] = (-2, 12)) -> DataFrame:
    """Lowest mismatch rate over symbol lags and symmetry rotations.

    ``tx`` and ``rx`` hold (capture_id, n, label). Only label pairs are counted per lag;
    the rotations are then applied to that small table of counts.
    """
    width = BITS_PER_SYMBOL[scheme]
    spread = tx.select(
        "capture_id", F.explode(F.sequence(F.lit(lags[0]), F.lit(lags[1]))).alias("lag"), "n", F.col("label").alias("sent")
    ).withColumn("n", F.col("n") + F.col("lag"))
    counts = (
        spread.join(rx.select("capture_id", "n", F.col("label").alias("got")), ["capture_id", "n"])
        .groupBy("capture_id", "lag", "sent", "got")
        .agg(F.count("*").alias("num"))
    )
    return rate_of_pairs(counts, scheme)


def rate_of_pairs(counts: DataFrame, scheme: str) -> DataFrame:
    """Lowest bit error rate over lags and rotations from counts of label pairs ``(capture_id, lag, sent, got, num)``."""
    width = BITS_PER_SYMBOL[scheme]
    turns = F.broadcast(counts.sparkSession.createDataFrame(rotated_labels(scheme), "rotation int, sent int, turned int"))
    wrong = F.bit_count(F.col("turned").bitwiseXOR(F.col("got")))
    rates = (
        counts.join(turns, "sent")
        .groupBy("capture_id", "lag", "rotation")
        .agg((F.sum(F.col("num") * wrong) / (F.sum("num") * width)).alias("ber"))
    )
    return rates.groupBy("capture_id").agg(F.least(F.min("ber"), F.lit(1.0)).alias("ber"))


def error_rates(pairs: DataFrame, by: str) -> DataFrame:
    """Bit error rate per group of paired bits ``tx`` and ``rx``."""
    return pairs.groupBy(by).agg(
        F.count("*").alias("n_bits"), F.avg((F.col("tx") != F.col("rx")).cast("double")).alias("ber")
    )


