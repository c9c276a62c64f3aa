"""Sums over all frames of a capture, added up where the frames are cut.

A task cuts the frames of its blocks, transforms them together and keeps one running sum per
capture; only these sums are shuffled, however many frames a capture has. Every capture has
its own frame size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.scalars import power
from tonelake.sources.series import with_lookahead

#: Values of running sums that a task keeps before it sends them on.
HELD = 1 << 21
#: Values of a strip of shifts, the unit in which cross products are shuffled.
STRIP = 1 << 16


def frame_plan(sizes: DataFrame, nfft: int, least: int = 16) -> DataFrame:
    """(capture_id, num_samples, nfft): the frame size of every capture.

    ``nfft`` (a power of two) halved until two half-overlapping frames fit; captures too short
    for ``least`` are left out.
    """
    size, chosen = nfft, None
    while size >= least:
        fits = F.col("num_samples") >= size + size // 2
        chosen = F.when(fits, F.lit(size)) if chosen is None else chosen.when(fits, F.lit(size))
        size //= 2
    return sizes.select("capture_id", "num_samples", chosen.cast("int").alias("nfft")).where("nfft IS NOT NULL")


def fixed_plan(sizes: DataFrame, nfft: int) -> DataFrame:
    """The same frame size for all captures that hold a frame."""
    return sizes.where(F.col("num_samples") >= nfft).select("capture_id", "num_samples", F.lit(nfft).alias("nfft"))


def _thinned(count: int, most: int | None) -> np.ndarray | None:
    """Numbers of ``most`` frames spread evenly over ``count``, or None for all."""
    if most is None or count <= most:
        return None
    spread = np.floor(np.arange(most) * ((count - 1) / (most - 1))).astype(np.int64)
    spread[-1] = count - 1
    return np.unique(spread)


def _cut(x: np.ndarray, start: int, own: int, total: int, nfft: int, most: int | None) -> np.ndarray:
    """Frames (rows) that begin among the first ``own`` samples of a block with its look-ahead."""
    step = max(1, nfft // 2)
    count = (total - nfft) // step + 1
    numbers = np.arange(-(-start // step), min(-(-(start + own) // step), count))
    kept = _thinned(count, most)
    if kept is not None:
        numbers = np.intersect1d(numbers, kept)
    at = numbers * step - start
    at = at[at + nfft <= len(x)]
    return x[at[:, None] + np.arange(nfft)]


def _block_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(capture_id, start_n, own_len, num_samples, nfft, mean, samples) of each row."""
    i, q = batch.column("i"), batch.column("q")
    a, b = i.offsets.to_numpy(), q.offsets.to_numpy()
    real, imag = i.values.to_numpy(zero_copy_only=False), q.values.to_numpy(zero_copy_only=False)
    plain = [batch.column(c).to_pylist() for c in ("capture_id", "start_n", "own_len", "num_samples", "nfft", "mean")]
    for k, row in enumerate(zip(*plain, strict=True)):
        yield *row, real[a[k] : a[k + 1]] + 1j * imag[b[k] : b[k + 1]]


def _planned(blocks: DataFrame, plan: DataFrame, block_len: int, largest: int) -> DataFrame:
    haloed = with_lookahead(blocks, largest - 1, block_len) if largest > 1 else blocks.withColumn("own_len", F.size("i"))
    if "mean" not in plan.columns:
        plan = plan.withColumn("mean", F.lit(None).cast("double"))
    rows = haloed.join(plan.select("capture_id", "num_samples", "nfft", "mean"), "capture_id")
    return rows.select("capture_id", "start_n", "own_len", "num_samples", "nfft", "mean", "i", "q")


def averaged_power(
    blocks: DataFrame, plan: DataFrame, block_len: int, largest: int, envelope: bool = False, max_frames: int | None = None
) -> DataFrame:
    """(capture_id, nfft, bin, p, frames): |FFT|^2 averaged over the Hann-windowed frames of every capture.

    Bins are centred (0 is the lowest frequency). ``envelope`` transforms ``|x|^2 - mean`` with
    the plan's ``mean`` instead of the samples. ``max_frames`` thins the frames of longer
    captures evenly; without it all frames enter.
    """
    rows = _planned(blocks, plan, block_len, largest)
    kind = blocks.schema["capture_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        id_type, held = None, 0

        def packed() -> pa.RecordBatch:
            keys = list(sums)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, id_type),
                    pa.array([len(sums[k][1]) for k in keys], pa.int32()),
                    pa.array([sums[k][0] for k in keys], pa.int64()),
                    pa.array([np.fft.fftshift(sums[k][1]) for k in keys], pa.list_(pa.float64())),
                ],
                ["capture_id", "nfft", "frames", "power"],
            )

        for batch in batches:
            id_type = batch.schema.field("capture_id").type
            for key, start, own, total, nfft, mean, x in _block_rows(batch):
                if envelope:
                    x = x.real**2 + x.imag**2 - mean
                cut = _cut(x, start, own, total, nfft, max_frames)
                if not len(cut):
                    continue
                # The window is symmetric; real input needs no more than the general transform.
                add = (np.abs(np.fft.fft(cut * np.hanning(nfft), axis=1)) ** 2).sum(axis=0)
                if key in sums:
                    sums[key] = sums[key][0] + len(cut), sums[key][1] + add
                else:
                    sums[key] = len(cut), add
                    held += nfft
                if held > HELD:
                    yield packed()
                    sums, held = {}, 0
        if sums:
            yield packed()

    parts = rows.mapInArrow(run, f"capture_id {kind}, nfft int, frames long, power array<double>")
    each = parts.select("capture_id", "nfft", "frames", F.posexplode("power").alias("bin", "power"))
    return each.groupBy("capture_id", "nfft", "bin").agg((F.sum("power") / F.sum("frames")).alias("p"), F.sum("frames").alias("frames"))


def averaged_spectrum(blocks: DataFrame, plan: DataFrame, block_len: int, largest: int, sample_rate: float, floor: float) -> DataFrame:
    """(capture_id, bin, freq_hz, power_db) of the spectrum averaged over all frames."""
    p = averaged_power(blocks, plan, block_len, largest)
    freq = (F.col("bin") - F.floor(F.col("nfft") / 2)) * sample_rate / F.col("nfft")
    return p.select("capture_id", "bin", freq.alias("freq_hz"), (10.0 * F.log10(F.col("p") + floor)).alias("power_db"))


def shift_range(nfft: int, fraction: float, low: int) -> tuple[int, int]:
    """Bin shifts ``low .. top - 1`` for cycle frequencies up to ``fraction`` of the rate."""
    return low, max(1, min(int(fraction * nfft / 2.0), nfft // 2 - 1))


def cyclic_coherence(
    blocks: DataFrame, plan: DataFrame, block_len: int, largest: int, fraction: float, low: int, max_frames: int | None = None
) -> DataFrame:
    """(capture_id, nfft, d, coherence): power-weighted coherence of bins 2d apart, over all frames.

    Sums over frames of ``X(f + d) conj X(f - d)`` are entries of the Gram matrix of the frames'
    spectra, which one matrix product per portion of frames adds up. A task sends the diagonals
    that are asked for, in strips of some shifts each, and each strip is summed by itself. A capture
    whose frames all lie in one block is finished in place and sends its values.
    """
    rows = _planned(blocks, plan, block_len, largest).sortWithinPartitions("capture_id")
    kind = blocks.schema["capture_id"].dataType.simpleString()

    def values(spectrum: np.ndarray, cross: np.ndarray, begin: int, frames: int) -> np.ndarray:
        """Coherence of the shifts from ``begin`` on, from sums over ``frames`` frames."""
        nfft = len(spectrum)
        f = np.arange(nfft)
        shifts = begin + np.arange(len(cross) // nfft)
        p = np.sqrt(spectrum / frames)
        root = p[(f + shifts[:, None]) % nfft] * p[(f - shifts[:, None]) % nfft]
        size = np.abs(cross.reshape(len(shifts), nfft) / frames) ** 2
        total = root.sum(axis=1)
        share = np.divide(size, root, out=np.zeros_like(size), where=root > 0).sum(axis=1)
        return np.divide(frames * share, total, out=np.zeros_like(total), where=(total > 0) & (frames >= 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gram, frames, id_type, whole = None, None, 0, None, False

        def strips() -> Iterator[pa.RecordBatch]:
            nfft = len(gram)
            first, top = shift_range(nfft, fraction, low)
            f = np.arange(nfft)
            width = max(1, STRIP // nfft)
            for begin in range(first, top, width):
                shifts = np.arange(begin, min(begin + width, top))
                cross = gram[(f + shifts[:, None]) % nfft, (f - shifts[:, None]) % nfft]
                power = gram.diagonal().real
                done = values(power, cross.reshape(-1), begin, frames) if whole else None
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([current], id_type), pa.array([begin], pa.int32()), pa.array([nfft], pa.int32()),
                        pa.array([frames], pa.int64()), pa.array([None if whole else power.tobytes()], pa.binary()),
                        pa.array([done.tobytes() if whole else cross.tobytes()], pa.binary()),
                    ],
                    ["capture_id", "strip", "nfft", "frames", "power", "products"],
                )

        for batch in batches:
            id_type = batch.schema.field("capture_id").type
            for key, start, own, total, nfft, _, x in _block_rows(batch):
                cut = _cut(x, start, own, total, nfft, max_frames)
                if not len(cut):
                    continue
                if gram is None or key != current:
                    if gram is not None:
                        yield from strips()
                    current, gram, frames = key, np.zeros((nfft, nfft), np.complex128), 0
                whole = start == 0 and own >= total
                s = np.fft.fft(cut * np.hanning(nfft), axis=1)
                gram += s.T @ s.conj()
                frames += len(cut)
        if gram is not None:
            yield from strips()

    sums = rows.mapInArrow(run, f"capture_id {kind}, strip int, nfft int, frames long, power binary, products binary")
    ordered = sums.repartition("capture_id", "strip").sortWithinPartitions("capture_id", "strip")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nfft, frames, spectrum, cross, id_type = None, 0, 0, None, None, None

        def row_of(capture_id, begin: int, size: int, value: np.ndarray) -> pa.RecordBatch:
            count = len(value)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([capture_id] * count, id_type), pa.array([size] * count, pa.int32()),
                    pa.array(begin + np.arange(count), pa.int64()), pa.array(value, pa.float64()),
                ],
                ["capture_id", "nfft", "d", "coherence"],
            )

        def finished() -> pa.RecordBatch:
            return row_of(*current, nfft, values(spectrum, cross, current[1], frames))

        for batch in batches:
            id_type = batch.schema.field("capture_id").type
            for capture_id, strip, size, count, p, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if p is None:
                    yield row_of(capture_id, strip, size, np.frombuffer(c, np.float64))
                    continue
                if (capture_id, strip) != current:
                    if current is not None:
                        yield finished()
                    current, nfft, frames = (capture_id, strip), size, 0
                    spectrum, cross = np.zeros(size), np.zeros(len(c) // 16, np.complex128)
                frames += count
                spectrum = spectrum + np.frombuffer(p, np.float64)
                cross = cross + np.frombuffer(c, np.complex128)
        if current is not None:
            yield finished()

    return ordered.mapInArrow(fold, f"capture_id {kind}, nfft int, d long, coherence double")


def mean_power(blocks: DataFrame) -> Column:
    """Aggregate: mean power of the samples of block rows."""
    squares = F.zip_with("i", "q", power)
    return F.sum(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size("i"))
