"""Spectra, waterfalls, line detectors and filters.

The FFT has no Spark expression, so it runs in Arrow batches over rows that hold one
bounded frame each; everything after it (argmax, medians, averages, gates) is SQL over
small spectra. Frames, not captures, are the unit of parallel work.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tonelake.functions.scalars import TWO_PI, cpow, power
from tonelake.operators import framesums, stats
from tonelake.sources.series import to_blocks, with_lookahead

# Fixed values of the methods.
PSD_NFFT = 4096
PSD_FLOOR = 1e-12
BANDWIDTH_DB = 10.0
SQUARED_NFFT = 8192
SQUARED_LINE_DB = 6.0
ENVELOPE_NFFT = 1024
MEDIAN_BINS = 31
ENVELOPE_SIGMAS = 8.0
ENVELOPE_MIN_FRACTION = 0.002
CYCLE_NFFT = 2048
CYCLE_MIN_BIN = 4
CYCLE_MIN_PEAK = 1.4
CYCLE_SIGMAS = 10.0
CYCLE_HARMONIC = 0.6
CYCLE_MAX_FRACTION = 0.45
MAD_SIGMA = 1.4826
CARRIER_MAX_CYCLES = 0.25

_DOUBLES = T.ArrayType(T.DoubleType())


def hann(size: int) -> np.ndarray:
    """Symmetric Hann window."""
    if size < 2:
        return np.ones(size)
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(size) / (size - 1))


def _complex(i: pd.Series, q: pd.Series) -> Iterator[np.ndarray]:
    for a, b in zip(i, q):
        yield np.asarray(a, dtype=np.float64) + 1j * np.asarray(b, dtype=np.float64)


@pandas_udf(_DOUBLES)
def windowed_power(i: pd.Series, q: pd.Series) -> pd.Series:
    """|FFT|^2 of every Hann-windowed frame, zero frequency in the middle."""
    return pd.Series(
        [np.fft.fftshift(np.abs(np.fft.fft(x * hann(x.size))) ** 2).tolist() for x in _complex(i, q)]
    )


def head_frames(samples: DataFrame, nfft: int) -> DataFrame:
    """The first ``nfft`` samples of every capture as one frame (bounded by ``nfft``)."""
    return to_blocks(samples.where(F.col("n") < nfft), nfft).select(
        "capture_id", F.lit(0).cast("long").alias("frame_no"), "i", "q"
    )


def frames(blocks: DataFrame, size: int, step: int, block_len: int) -> DataFrame:
    """Overlapping frames; the tail that does not fill a frame is dropped.

    A frame belongs to the block in which it starts and is cut out of that block and its
    look-ahead, so the data are shuffled once and not once per overlapping frame.
    """
    haloed = with_lookahead(blocks, size - 1, block_len) if size > 1 else blocks
    first = F.ceil(F.col("start_n") / step)
    last = F.floor(F.least(F.col("start_n") + block_len - 1, F.col("start_n") + F.size("i") - size) / step)
    return (
        haloed.select("capture_id", "start_n", "i", "q", first.alias("lo"), last.alias("hi"))
        .where(F.col("hi") >= F.col("lo"))
        .select("capture_id", "start_n", "i", "q", F.explode(F.sequence("lo", "hi")).alias("frame_no"))
        .select(
            "capture_id",
            "frame_no",
            (F.col("frame_no") * step).alias("start"),
            F.slice("i", (F.col("frame_no") * step - F.col("start_n") + 1).cast("int"), F.lit(size)).alias("i"),
            F.slice("q", (F.col("frame_no") * step - F.col("start_n") + 1).cast("int"), F.lit(size)).alias("q"),
        )
    )


def bin_frequency(bin_: Column, nfft: Column, sample_rate: float) -> Column:
    """Frequency of bin ``bin_`` of a centred spectrum of ``nfft`` bins."""
    return (bin_ - F.floor(nfft / 2)) * sample_rate / nfft


def spectra(framed: DataFrame, sample_rate: float) -> DataFrame:
    """(capture_id, frame_no, bin, freq_hz, power_db) of every frame."""
    return (
        framed.select("capture_id", "frame_no", F.size("i").alias("nfft"), windowed_power("i", "q").alias("p"))
        .select("capture_id", "frame_no", "nfft", F.posexplode("p").alias("bin", "p"))
        .select(
            "capture_id",
            "frame_no",
            "bin",
            bin_frequency(F.col("bin"), F.col("nfft"), sample_rate).alias("freq_hz"),
            (10.0 * F.log10(F.col("p") + PSD_FLOOR)).alias("power_db"),
        )
    )


def psd(samples: DataFrame, sample_rate: float, nfft: int = PSD_NFFT) -> DataFrame:
    """Periodogram of the first ``nfft`` samples."""
    return spectra(head_frames(samples, nfft), sample_rate)


def averaged_psd(
    blocks: DataFrame, sizes: DataFrame, sample_rate: float, nfft: int, block_len: int, least_nfft: int = 16
) -> DataFrame:
    """Spectrum of every capture averaged over all of its half-overlapping frames.

    The frame size is ``nfft`` halved until two frames fit, so a signal counts wherever it lies;
    captures shorter than one and a half of ``least_nfft`` have none.
    """
    plan = framesums.frame_plan(sizes, nfft, least_nfft)
    return framesums.averaged_spectrum(blocks, plan, block_len, nfft, sample_rate, PSD_FLOOR)


def spectrum_measures(spectrum: DataFrame, threshold_db: float = BANDWIDTH_DB) -> DataFrame:
    """Peak frequency, SNR and occupied bandwidth; a spectrum is bounded by the FFT size.

    Bandwidth 0 means not measurable: fewer than two bins clear the floor.
    """
    tops = spectrum.groupBy("capture_id").agg(
        F.max_by("freq_hz", F.struct("power_db", -F.col("bin"))).alias("peak_hz"),
        F.max("power_db").alias("peak_db"),
        F.median("power_db").alias("floor_db"),
    )
    above = F.when(F.col("power_db") > F.col("floor_db") + threshold_db, F.col("freq_hz"))
    spans = (
        spectrum.join(tops, "capture_id")
        .groupBy("capture_id")
        .agg(F.count(above).alias("bins"), F.min(above).alias("lo"), F.max(above).alias("hi"))
    )
    return tops.join(spans, "capture_id").select(
        "capture_id",
        F.col("peak_hz").alias("center_hz"),
        (F.col("peak_db") - F.col("floor_db")).alias("snr_db"),
        F.when(F.col("bins") < 2, F.lit(0.0)).otherwise(F.col("hi") - F.col("lo")).alias("bandwidth_hz"),
    )


def waterfall(blocks: DataFrame, sample_rate: float, nfft: int, block_len: int, overlap: float = 0.5) -> DataFrame:
    """Short-time spectra of whole captures with frame times."""
    step = max(1, int(nfft * (1.0 - overlap)))
    return spectra(frames(blocks, nfft, step, block_len), sample_rate).withColumn(
        "time_s", F.col("frame_no") * (step / sample_rate)
    )


def bin_down(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Average a waterfall into at most rows x cols cells and scale them to 0..255.

    Cell edges are the truncated points of an even division; averaging happens per cell,
    so only cells are shuffled.
    """
    shape = cells.groupBy("capture_id").agg(
        (F.max("frame_no") + 1).alias("frames"), (F.max("bin") + 1).cast("long").alias("bins")
    )

    def cell(pos: str, count: str, limit: int) -> Column:
        # Largest c with floor(c * count / limit) <= pos; all positions map to themselves when few.
        c = F.col(pos)
        return F.when(F.col(count) > limit, F.ceil((c + 1) * limit / F.col(count)) - 1).otherwise(c)

    first = (
        cells.join(shape, "capture_id")
        .groupBy("capture_id", cell("frame_no", "frames", rows).alias("row"), "bin")
        .agg(F.avg("power_db").alias("v"), F.first("bins").alias("bins"))
    )
    small = first.groupBy("capture_id", "row", cell("bin", "bins", cols).alias("col")).agg(F.avg("v").alias("v"))
    span = small.groupBy("capture_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scale = F.when(F.col("hi") > F.col("lo"), 255.0 / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return small.join(span, "capture_id").select(
        "capture_id", "row", "col", F.col("v").alias("mean_db"), F.floor(F.round((F.col("v") - F.col("lo")) * scale, 9)).cast("int").alias("level")
    )


# -- symbol-rate lines --------------------------------------------------------


def squared_line_rate(samples: DataFrame, sample_rate: float, nfft: int = SQUARED_NFFT) -> DataFrame:
    """Rate of the line in the spectrum of the squared envelope; 0 without a clear line."""
    p = power(F.col("i"), F.col("q"))
    means = samples.groupBy("capture_id").agg(F.avg(p).alias("mean"), F.count("*").alias("num"))
    envelope = samples.where(F.col("n") < nfft).join(means, "capture_id").where(F.col("num") >= 64).select(
        "capture_id", "n", (p - F.col("mean")).cast("float").cast("double").alias("i"), F.lit(0.0).alias("q")
    )
    positive = psd(envelope, sample_rate, nfft).where(F.col("freq_hz") > 0.01 * sample_rate)
    lines = positive.groupBy("capture_id").agg(
        F.max("power_db").alias("peak"),
        F.max_by("freq_hz", F.struct("power_db", -F.col("bin"))).alias("freq"),
        F.median("power_db").alias("floor"),
    )
    found = F.col("peak") >= F.col("floor") + SQUARED_LINE_DB
    return means.select("capture_id").join(lines, "capture_id", "left").select(
        "capture_id", F.when(found, F.abs("freq")).otherwise(F.lit(0.0)).alias("symbol_rate_hz")
    )


def squared_line_rate_averaged(
    blocks: DataFrame, sizes: DataFrame, sample_rate: float, nfft: int, block_len: int, least_nfft: int = 16
) -> DataFrame:
    """The rate of ``squared_line_rate`` from spectra averaged over all frames, and by how much it clears the floor."""
    means = blocks.groupBy("capture_id").agg(framesums.mean_power(blocks).alias("mean"))
    plan = framesums.frame_plan(sizes, nfft, least_nfft).join(means, "capture_id")
    p = framesums.averaged_power(blocks, plan, block_len, nfft, envelope=True)
    freq = (F.col("bin") - F.floor(F.col("nfft") / 2)) * sample_rate / F.col("nfft")
    levels = p.select("capture_id", "bin", freq.alias("freq_hz"), (10.0 * F.log10(F.col("p") + PSD_FLOOR)).alias("power_db"))
    lines = levels.where(F.col("freq_hz") > 0.01 * sample_rate).groupBy("capture_id").agg(
        F.max("power_db").alias("peak"),
        F.max_by("freq_hz", F.struct("power_db", -F.col("bin"))).alias("freq"),
        F.median("power_db").alias("floor"),
    )
    margin = F.col("peak") - F.col("floor")
    return sizes.select("capture_id").join(lines, "capture_id", "left").select(
        "capture_id",
        F.coalesce(F.when(margin >= SQUARED_LINE_DB, F.col("freq")), F.lit(0.0)).alias("symbol_rate_hz"),
        F.coalesce(margin, F.lit(0.0)).alias("margin_db"),
    )


def background(values: np.ndarray, bins: int = MEDIAN_BINS) -> np.ndarray:
    """Median over ``bins`` neighbours of each value, the edge value repeated beyond the ends."""
    half = bins // 2
    near = np.lib.stride_tricks.sliding_window_view(np.pad(values, half, mode="edge"), 2 * half + 1)
    return np.partition(near, half, axis=1)[:, half]


def _middle(values: np.ndarray) -> float:
    """Median as SQL has it: half of each of the two middle values."""
    ordered, place = np.sort(values), (len(values) - 1) // 2
    low, high = ordered[place], ordered[len(values) // 2]
    return float(low if low == high else 0.5 * low + 0.5 * high)


def _line_peaks(band: DataFrame, sample_rate: float, max_rate_hz: float | None) -> DataFrame:
    """(capture_id, nfft, bins, searched, mid, mad, bin, rest, lift, left, right): the highest bin above its background.

    ``mid`` and ``mad`` are the median of the rests and of their distances to it. A spectrum is one
    row, bounded by its FFT size; captures without a bin up to ``max_rate_hz`` have none.
    """
    kind, above, middle = band.schema["capture_id"].dataType.simpleString(), background, _middle
    doubles = ("mid", "mad", "rest", "lift", "left", "right")
    names = ["capture_id", "nfft", "bins", "searched", "bin", *doubles]
    packed = band.groupBy("capture_id").agg(F.first("nfft").alias("nfft"), F.sort_array(F.collect_list(F.struct("bin", "p"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, nfft, bins, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.array(p)
                rest = values - above(values)
                mid = middle(rest)
                mad = middle(np.abs(rest - mid))
                lift = np.maximum(rest - mid, 0.0)
                searched = len(bins) if max_rate_hz is None else int((np.array(bins) * (sample_rate / nfft) <= max_rate_hz).sum())
                if not searched:
                    continue
                k = int(np.argmax(rest[:searched]))  # the first of equal ones
                left, right = float(lift[k - 1]) if k else None, float(lift[k + 1]) if k + 1 < len(lift) else None
                found.append((key, nfft, len(bins), searched, bins[k], mid, mad, float(rest[k]), float(lift[k]), left, right))
            if found:
                types = [batch.schema.field("capture_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    return packed.select("capture_id", "nfft", "s.bin", "s.p").mapInArrow(
        run, f"capture_id {kind}, nfft int, bins long, searched long, bin int, " + ", ".join(f"{c} double" for c in doubles)
    )


def running_median(spectrum: DataFrame, value: str, order: str, bins: int = MEDIAN_BINS) -> DataFrame:
    """Median over ``bins`` neighbours, the edge value repeated beyond the ends.

    A spectrum has a bounded number of bins, so its window fits one task.
    """
    names = spectrum.columns
    rest = [c for c in names if c not in ("capture_id", order, value)]

    @pandas_udf(_DOUBLES)
    def lifted(values: pd.Series) -> pd.Series:
        return pd.Series([background(np.asarray(v, np.float64), bins) for v in values])

    packed = spectrum.groupBy("capture_id").agg(F.sort_array(F.collect_list(F.struct(order, value, *rest))).alias("s"))
    both = packed.select("capture_id", "s", lifted(F.col(f"s.{value}")).alias("background"))
    rows = both.select("capture_id", F.explode(F.arrays_zip("s", "background")).alias("z"))
    columns = [F.col("capture_id") if c == "capture_id" else F.col(f"z.s.{c}").alias(c) for c in names]
    # On its way back from Python a median that is no number arrives as NULL.
    return rows.select(*columns, F.coalesce("z.background", F.lit(float("nan"))).alias("background"))


def refined(left: Column, mid: Column, right: Column) -> Column:
    """Sub-bin shift of a peak: parabola through the logs of three neighbours, 0 at the edges."""
    a, b, c = (F.log(v + 1e-12) for v in (left, mid, right))
    bend = a - 2.0 * b + c
    shift = F.try_divide(0.5 * (a - c), bend)
    usable = left.isNotNull() & right.isNotNull() & (F.abs(bend) >= 1e-12)
    return F.coalesce(F.when(usable & (F.abs(shift) <= 1.0), shift), F.lit(0.0))


def welch_envelope(
    blocks: DataFrame, means: DataFrame, nfft: int, block_len: int, max_frames: int | None = None, plan: DataFrame | None = None
) -> DataFrame:
    """(capture_id, bin, p[, nfft]): averaged spectrum of the mean-removed squared envelope.

    All frames of a capture enter unless ``max_frames`` thins them evenly. ``plan`` gives every
    capture its own frame size (then ``nfft`` is the largest) and adds it to the rows.
    """
    sized = framesums.fixed_plan(stats.sizes(blocks), nfft) if plan is None else plan
    p = framesums.averaged_power(blocks, sized.join(means, "capture_id"), block_len, nfft, envelope=True, max_frames=max_frames)
    # n times the mean square of the symmetric Hann window is 3 (n - 1) / 8.
    norm = 3.0 * (F.col("nfft") - 1) / 8.0
    kept = ["capture_id", (F.col("bin") - F.floor(F.col("nfft") / 2)).cast("int").alias("bin"), (F.col("p") / norm).alias("p")]
    return p.select(*kept, *([] if plan is None else ["nfft"]))


def envelope_line_rate(
    blocks: DataFrame,
    sizes: DataFrame,
    sample_rate: float,
    nfft: int,
    block_len: int,
    max_rate_hz: float | None = None,
    max_frames: int | None = None,
    least_nfft: int | None = None,
) -> DataFrame:
    """Symbol rate from the averaged squared envelope against its local background.

    With ``least_nfft`` the frames of a capture shrink from ``nfft`` to that size until two fit,
    and ``reason`` tells apart captures too short, spectra of too few bins, and no line.
    """
    means = blocks.groupBy("capture_id").agg(framesums.mean_power(blocks).alias("mean"))
    plan = framesums.frame_plan(sizes, nfft, least_nfft) if least_nfft else framesums.fixed_plan(sizes, nfft)
    width = sample_rate / F.col("nfft")
    band = welch_envelope(blocks, means, nfft, block_len, max_frames, plan).where(
        F.col("bin") * width > ENVELOPE_MIN_FRACTION * sample_rate
    )
    peak = _line_peaks(band, sample_rate, max_rate_hz)
    sigma = MAD_SIGMA * F.col("mad")
    prominence = F.try_divide(F.col("rest") - F.col("mid"), sigma)
    usable = (F.col("bins") >= 8) & (F.col("mad") > 0) & (F.col("searched") >= 4)
    found = usable & (prominence >= ENVELOPE_SIGMAS)
    rate = (F.col("bin") + refined(F.col("left"), F.col("lift"), F.col("right"))) * width
    reason = (
        F.when(F.col("bins").isNull(), F.lit("too short"))
        .when(~usable, F.lit("few bins"))
        .when(~found, F.lit("no line"))
        .otherwise(F.lit("line"))
    )
    return sizes.select("capture_id").join(peak, "capture_id", "left").select(
        "capture_id",
        F.coalesce(F.when(found, rate), F.lit(0.0)).alias("symbol_rate_hz"),
        F.coalesce(F.when(usable, prominence), F.lit(0.0)).alias("prominence"),
        F.coalesce(found, F.lit(False)).alias("found"),
        *([reason.alias("reason")] if least_nfft else []),
    )


# -- cyclic coherence ---------------------------------------------------------

def coherence_profile(
    blocks: DataFrame,
    sizes: DataFrame,
    sample_rate: float,
    nfft: int,
    block_len: int,
    max_alpha_hz: float | None = None,
    max_frames: int | None = None,
    least_nfft: int | None = None,
) -> DataFrame:
    """(capture_id, d, alpha_hz, coherence): power-weighted cyclic coherence per bin shift.

    All frames of a capture enter unless ``max_frames`` thins them evenly. With ``least_nfft``
    the frames of a capture shrink from ``nfft`` to that size until two fit.
    """
    plan = framesums.frame_plan(sizes, nfft, least_nfft) if least_nfft else framesums.fixed_plan(sizes, nfft)
    fraction = max_alpha_hz / sample_rate if max_alpha_hz else CYCLE_MAX_FRACTION
    profile = framesums.cyclic_coherence(blocks, plan, block_len, nfft, fraction, CYCLE_MIN_BIN, max_frames)
    return profile.select("capture_id", "d", (2.0 * F.col("d") * sample_rate / F.col("nfft")).alias("alpha_hz"), "coherence")


def cycle_rate(profile: DataFrame, sizes: DataFrame) -> DataFrame:
    """Symbol rate from the coherence peak, walked down to its smallest strong sub-harmonic."""
    order = Window.partitionBy("capture_id").orderBy("d")
    rows = profile.withColumn("left", F.lag("coherence").over(order)).withColumn("right", F.lead("coherence").over(order))
    mids = rows.groupBy("capture_id").agg(
        F.median("coherence").alias("mid"),
        F.min("alpha_hz").alias("first"),
        F.count("*").alias("bins"),
        F.max("alpha_hz").alias("last"),
        F.max_by(F.struct("d", "coherence", "left", "right", "alpha_hz"), F.struct("coherence", -F.col("d"))).alias("k"),
    )
    spread = rows.join(mids.select("capture_id", "mid"), "capture_id").groupBy("capture_id").agg(
        F.median(F.abs(F.col("coherence") - F.col("mid"))).alias("mad")
    )
    width = F.when(F.col("bins") > 1, (F.col("last") - F.col("first")) / (F.col("bins") - 1)).otherwise(F.lit(0.0))
    peaks = (
        mids.join(spread, "capture_id")
        .withColumn("width", width)
        .withColumn("sigma", MAD_SIGMA * F.col("mad"))
        .withColumn("prominence", F.try_divide(F.col("k.coherence") - F.col("mid"), F.col("sigma")))
        .withColumn(
            "rate", F.col("k.alpha_hz") + refined(F.col("k.left"), F.col("k.coherence"), F.col("k.right")) * F.col("width")
        )
    )
    # Nearest profile row to rate / divisor: bounded rows per capture, four divisors.
    subs = peaks.select("capture_id", "rate", "mid", "sigma", "prominence", "width", F.explode(F.array(*map(F.lit, (2, 3, 4, 5)))).alias("divisor"))
    near = (
        rows.join(subs, "capture_id")
        .withColumn("gap", F.abs(F.col("alpha_hz") - F.col("rate") / F.col("divisor")))
        .groupBy("capture_id", "divisor")
        .agg(
            F.min_by(F.struct("alpha_hz", "coherence", "left", "right"), F.struct("gap", "d")).alias("s"),
            F.min("gap").alias("gap"),
            F.first("mid").alias("mid"),
            F.first("sigma").alias("sigma"),
            F.first("prominence").alias("prominence"),
            F.first("width").alias("width"),
        )
        .where(
            (F.col("gap") <= 1.5 * F.abs("width"))
            & (F.try_divide(F.col("s.coherence") - F.col("mid"), F.col("sigma")) >= CYCLE_HARMONIC * F.col("prominence"))
        )
        .withColumn("sub", F.col("s.alpha_hz") + refined(F.col("s.left"), F.col("s.coherence"), F.col("s.right")) * F.col("width"))
        .groupBy("capture_id")
        .agg(F.min_by("sub", "divisor").alias("sub"))
    )
    found = (F.col("sigma") > 0) & (F.col("k.coherence") >= CYCLE_MIN_PEAK) & (F.col("prominence") >= CYCLE_SIGMAS)
    reason = (
        F.when(F.col("mid").isNull(), F.lit("capture too short to segment for a cyclic periodogram"))
        .when(~(F.col("sigma") > 0), F.lit("profile is flat"))
        .when(~found, F.lit("peak did not clear the detection threshold"))
        .otherwise(F.lit("spectral-coherence peak"))
    )
    return sizes.select("capture_id").join(peaks, "capture_id", "left").join(near, "capture_id", "left").select(
        "capture_id",
        F.coalesce(F.when(found, F.coalesce("sub", "rate")), F.lit(0.0)).alias("symbol_rate_hz"),
        F.coalesce(F.col("k.coherence"), F.lit(0.0)).alias("coherence"),
        F.coalesce(found, F.lit(False)).alias("found"),
        reason.alias("reason"),
    )


# -- transform over a whole capture -------------------------------------------

#: Cells of the transform that a task holds at once.
TRANSFORM_CELLS = 1 << 20


def _shape(num: int) -> tuple[int, int, int, int]:
    """Rows and columns of the padded transform, and how many of either a group holds."""
    bits = (2 * num - 2).bit_length()
    rows, cols = 1 << bits // 2, 1 << bits - bits // 2
    return rows, cols, max(1, min(cols, TRANSFORM_CELLS // rows)), max(1, min(rows, TRANSFORM_CELLS // cols))


def _chirp(at: np.ndarray, num: int) -> np.ndarray:
    """exp(-j pi at^2 / num); the square is reduced in whole numbers."""
    return np.exp(-1j * np.pi * (at * at % (2 * num)) / num)


def whole_power(samples: DataFrame, keep: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(capture_id, num, bin, p): |DFT|^2 over all ``num`` samples of every capture.

    ``samples`` (capture_id, num, n, i, q), ``num`` from 16 to 2^31. Bins run from 0 to num - 1;
    ``keep(bins, num)`` marks those that leave the transform.

    The sum for any ``num`` is a convolution with a chirp (Bluestein), which takes transforms of
    a power of two M. Those are split in four steps: M = rows x cols, one step over columns and
    one over rows with twiddle factors between, so that a group holds TRANSFORM_CELLS cells or
    about the square root of M and no row holds a capture.
    """
    id_type = samples.schema["capture_id"].dataType.simpleString()
    tiles = f"capture_id {id_type}, num long, tile int, at int, data binary"
    names = ["capture_id", "num", "tile", "at", "data"]

    @pandas_udf("int")
    def column_tile(n: pd.Series, num: pd.Series) -> pd.Series:
        at = np.zeros(len(n), np.int32)
        for size in np.unique(num):
            mine = (num == size).to_numpy()
            _, cols, wide, _ = _shape(int(size))
            at[mine] = n.to_numpy()[mine] % cols // wide
        return pd.Series(at)

    def gathered(part: pd.DataFrame, width: int) -> np.ndarray:
        part = part.sort_values("at")
        return np.concatenate([np.frombuffer(d, np.complex128).reshape(-1, width) for d in part["data"]])

    def turned(rows_: np.ndarray, cols_: np.ndarray, size: int) -> np.ndarray:
        return np.exp(2j * np.pi * (rows_[:, None] * cols_ % size) / size)

    def columns(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        num, tile = int(part["num"].iloc[0]), int(key[1])
        rows, cols, wide, high = _shape(num)
        n = part["n"].to_numpy()
        x = np.zeros((rows, wide), np.complex128)
        x[n // cols, n % cols - tile * wide] = (part["i"].to_numpy() + 1j * part["q"].to_numpy()) * _chirp(n, num)
        at = tile * wide + np.arange(wide)
        place = np.arange(rows)[:, None] * cols + at
        far = np.minimum(place, rows * cols - place)
        chirp = np.where(far < num, np.conj(_chirp(far, num)), 0)
        turn = np.conj(turned(np.arange(rows), at, rows * cols))
        both = np.stack([np.fft.fft(x, axis=0) * turn, np.fft.fft(chirp, axis=0) * turn])
        # A tile is laid out by column, so that tiles follow one another in the next step.
        out = [(key[0], num, h, tile, both[:, h * high : (h + 1) * high].transpose(2, 0, 1).tobytes()) for h in range(rows // high)]
        return pd.DataFrame(out, columns=names)

    def across(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        num, tile = int(part["num"].iloc[0]), int(key[1])
        rows, cols, wide, high = _shape(num)
        x, chirp = gathered(part, 2 * high).reshape(cols, 2, high).transpose(1, 0, 2)
        y = np.fft.ifft(np.fft.fft(x, axis=0) * np.fft.fft(chirp, axis=0), axis=0)
        y = (y * turned(np.arange(cols), tile * high + np.arange(high), rows * cols)).T
        out = [(key[0], num, w, tile, y[:, w * wide : (w + 1) * wide].tobytes()) for w in range(cols // wide)]
        return pd.DataFrame(out, columns=names)

    def back(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        num, tile = int(part["num"].iloc[0]), int(key[1])
        rows, cols, wide, _ = _shape(num)
        y = np.fft.ifft(gathered(part, wide), axis=0)
        bins = np.arange(rows)[:, None] * cols + tile * wide + np.arange(wide)
        wanted = bins < num
        wanted[wanted] = keep(bins[wanted], num)
        # The chirp that is left has modulus 1.
        return pd.DataFrame({"capture_id": [key[0]] * int(wanted.sum()), "num": num, "bin": bins[wanted], "p": np.abs(y[wanted]) ** 2})

    return (
        samples.select("capture_id", "num", "n", "i", "q", column_tile("n", "num").alias("tile"))
        .groupBy("capture_id", "tile")
        .applyInPandas(columns, tiles)
        .groupBy("capture_id", "tile")
        .applyInPandas(across, tiles)
        .groupBy("capture_id", "tile")
        .applyInPandas(back, f"capture_id {id_type}, num long, bin long, p double")
    )


def hann_at(n: Column, num: Column) -> Column:
    """Symmetric Hann window of ``num`` samples at ``n``."""
    return 0.5 - 0.5 * F.cos(TWO_PI * n / (num - 1))


# -- carrier line, filters, eye ----------------------------------------------


def carrier_line(samples: DataFrame, order: int) -> DataFrame:
    """Carrier offset (cycles/sample) and phase from the ``order``-th power line.

    The line needs one transform over the whole capture, which is split over tasks.
    """
    p = power(F.col("i"), F.col("q"))
    means = samples.groupBy("capture_id").agg(F.avg(p).alias("p"), F.count("*").alias("num")).where(
        (F.col("num") >= 16) & (F.col("p") > 0)
    )
    zi, zq = cpow((F.col("i") / F.sqrt("p"), F.col("q") / F.sqrt("p")), order)
    raised = samples.join(means, "capture_id").select("capture_id", "num", "n", zi.alias("i"), zq.alias("q"))
    window = hann_at(F.col("n"), F.col("num"))
    windowed = raised.select("capture_id", "num", "n", (F.col("i") * window).alias("i"), (F.col("q") * window).alias("q"))
    signed = F.when(2 * F.col("bin") >= F.col("num"), F.col("bin") - F.col("num")).otherwise(F.col("bin"))
    lines = (
        whole_power(windowed, lambda bins, num: np.minimum(bins, num - bins) <= CARRIER_MAX_CYCLES * num)
        .select("capture_id", "num", signed.alias("bin"), "p")
        .groupBy("capture_id")
        .agg(F.max_by(F.col("bin") / F.col("num"), F.struct("p", -F.col("bin"))).alias("cycles"))
    )
    turn = -TWO_PI * F.col("cycles") * F.col("n")
    sums = (
        raised.join(lines, "capture_id")
        .groupBy("capture_id")
        .agg(
            F.first("cycles").alias("cycles"),
            F.sum(F.col("i") * F.cos(turn) - F.col("q") * F.sin(turn)).alias("re"),
            F.sum(F.col("i") * F.sin(turn) + F.col("q") * F.cos(turn)).alias("im"),
        )
    )
    return samples.select("capture_id").distinct().join(sums, "capture_id", "left").select(
        "capture_id",
        F.coalesce(F.col("cycles") / order, F.lit(0.0)).alias("cycles_per_sample"),
        F.coalesce(F.atan2("im", "re") / order, F.lit(0.0)).alias("phase"),
    )


def rrc_taps(sps: int, beta: float, span: int) -> list[float]:
    """Unit-energy root-raised-cosine taps; its removable singularities take their limits."""
    t = np.arange(-span * sps, span * sps + 1) / sps
    if beta == 0:
        h = np.sinc(t)
    else:
        x = 4.0 * beta * t
        edge = np.isclose(np.abs(x), 1.0)
        zero = t == 0.0
        safe = np.where(edge | zero, 0.5, t)
        xs = 4.0 * beta * safe
        h = (np.sin(np.pi * safe * (1 - beta)) + xs * np.cos(np.pi * safe * (1 + beta))) / (
            np.pi * safe * (1 - xs * xs)
        )
        h[zero] = 1.0 - beta + 4.0 * beta / np.pi
        quarter = np.pi / (4.0 * beta)
        h[edge] = beta / math.sqrt(2.0) * ((1 + 2 / np.pi) * math.sin(quarter) - (1 - 2 / np.pi) * math.cos(quarter))
    return (h / math.sqrt(float(np.sum(h * h)))).tolist()


def fir_filter(blocks: DataFrame, taps: list[float], block_len: int) -> DataFrame:
    """Filter whole captures with symmetric delay removed: same length, same positions.

    Output ``n`` is ``sum_k taps[k] x[n + delay - k]``. Each block gets the samples its
    edges need from its neighbours, then every row is filtered on its own.
    """
    delay = (len(taps) - 1) // 2
    weights = np.asarray(taps)
    reach = len(taps) - 1

    @pandas_udf(T.StructType([T.StructField("i", _DOUBLES), T.StructField("q", _DOUBLES)]))
    def convolve(i: pd.Series, q: pd.Series, skip: pd.Series, own: pd.Series) -> pd.DataFrame:
        out_i, out_q = [], []
        for a, b, s, m in zip(i, q, skip, own):
            for part, out in ((a, out_i), (b, out_q)):
                full = np.convolve(np.asarray(part, dtype=np.float64), weights)
                out.append(full[s + delay : s + delay + m].tolist())
        return pd.DataFrame({"i": out_i, "q": out_q})

    ahead = with_lookahead(blocks, max(delay, 1), block_len)
    # Short blocks: the samples behind a block lie in several blocks before it.
    tails = [
        F.struct(
            (F.col("block_no") + k).alias("block_no"),
            F.lit(-k).alias("turn"),
            F.slice("i", F.greatest(F.size("i") - need + 1, F.lit(1)), F.lit(need)).alias("i"),
            F.slice("q", F.greatest(F.size("q") - need + 1, F.lit(1)), F.lit(need)).alias("q"),
        )
        for k in range(1, -(-reach // block_len) + 1)
        if (need := min(block_len, reach - (k - 1) * block_len)) > 0
    ] or [F.struct((F.col("block_no") + 1).alias("block_no"), F.lit(-1).alias("turn"), F.slice("i", 1, 0).alias("i"), F.slice("q", 1, 0).alias("q"))]
    behind = (
        blocks.select("capture_id", F.explode(F.array(*tails)).alias("t"))
        .select("capture_id", "t.*")
        .groupBy("capture_id", "block_no")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "i", "q"))).alias("parts"))
        .select("capture_id", "block_no", F.flatten("parts.i").alias("bi"), F.flatten("parts.q").alias("bq"))
    )
    joined = ahead.join(behind, ["capture_id", "block_no"], "left")
    none = F.array().cast("array<double>")
    ready = joined.select(
        "capture_id",
        "block_no",
        "start_n",
        F.concat(F.coalesce("bi", none), "i").alias("xi"),
        F.concat(F.coalesce("bq", none), "q").alias("xq"),
        F.size(F.coalesce("bi", none)).alias("skip"),
        "own_len",
    )
    return ready.select("capture_id", "block_no", "start_n", convolve("xi", "xq", "skip", "own_len").alias("y")).select(
        "capture_id", "block_no", "start_n", "y.i", "y.q"
    )


def eye_traces(blocks: DataFrame, sps: int, block_len: int, limit: int = 200) -> DataFrame:
    """Traces of two symbols, one symbol apart; the first ``limit`` are shown."""
    cut = frames(blocks, 2 * sps, sps, block_len).where(F.col("frame_no") < limit)
    return cut.select("capture_id", F.col("frame_no").alias("trace"), F.posexplode("i").alias("at", "v"))
