"""One mergeable state per block of a capture, from which the measures of the capture follow.

A block is read once and leaves one row of sums: moments of the samples, of the envelope and
of the phase steps inside the block, its first and last phase, and the mean power of its
envelope windows. Rows of blocks are merged per capture by SQL, the step from one block to the
next comes from their end phases. So a report needs a few passes over the samples, each a
single Arrow stage, and shuffles rows of blocks, never of samples.

Central moments are taken about the mean of the block and merged exactly (Chan's formulas), so
a tone with hardly any spread keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tonelake.functions.scalars import TWO_PI, clamp, csquare, decibel, power, wrap_phase
from tonelake.operators import bursts, stats, symbols
from tonelake.session import pin

#: Leading bits by which values are counted at once when a quantile is looked for.
RADIX_BITS = 12
#: Values that are ranked by themselves; a range that holds more is counted again by further bits.
RANKED = 10_000

_SUMS = ("i", "q", "ii", "qq", "iq", "p2", "p3", "x4re", "x4im", "px2re", "px2im", "env", "abs_f", "lag")
_FIELDS = (
    "block_no long, start_n long, num long, " + ", ".join(f"s_{name} double" for name in _SUMS)
    + ", peak double, env_mean double, env_m2 double"
    + ", f_num long, f_mean double, f_m2 double, f_m3 double, f_m4 double, f_lo double, f_hi double"
    + ", head double, tail double, first_f double, last_f double, total double, run double, krun double"
    + ", window_no long, windows array<double>, members array<int>"
)


def samples_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Complex samples of each block row with list columns ``i`` and ``q``."""
    i, q = batch.column("i"), batch.column("q")
    a, b = i.offsets.to_numpy(), q.offsets.to_numpy()
    real = i.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    imag = q.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    for k in range(batch.num_rows):
        yield real[a[k] : a[k + 1]] + 1j * imag[b[k] : b[k + 1]]


def phase_steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phases of the samples, and the steps between them folded into [-pi, pi]."""
    phase = np.arctan2(x.imag, x.real)
    step = np.diff(phase)
    return phase, np.where(step > np.pi, step - TWO_PI, np.where(step < -np.pi, step + TWO_PI, step))


def _central(v: np.ndarray) -> tuple[float, float, float, float]:
    mean = float(v.mean()) if len(v) else 0.0
    d = v - mean
    d2 = d * d
    return mean, float(d2.sum()), float((d2 * d).sum()), float((d2 * d2).sum())


def _state(x: np.ndarray, start: int, window: int) -> list:
    """The fields after ``block_no`` for samples that begin at ``start``."""
    i, q = x.real, x.imag
    ii, qq, iq = i * i, q * q, i * q
    p = ii + qq
    env = np.sqrt(p)
    re2, im2 = ii - qq, 2.0 * iq
    phase, f = phase_steps(x)
    env_mean, env_m2, _, _ = _central(env)
    f_mean, f_m2, f_m3, f_m4 = _central(f)
    run = np.concatenate([[0.0], np.cumsum(f)])
    sums = (
        i.sum(), q.sum(), ii.sum(), qq.sum(), iq.sum(), (p * p).sum(), (p * p * p).sum(),
        (re2 * re2 - im2 * im2).sum(), (2.0 * re2 * im2).sum(), (p * re2).sum(), (p * im2).sum(), env.sum(), np.abs(f).sum(),
        ((f[:-1] - f_mean) * (f[1:] - f_mean)).sum(),
    )
    numbers = (start + np.arange(len(x))) // window
    first = start // window
    place = (numbers - first).astype(np.int64)
    members = np.bincount(place)
    return [
        start, len(x), *map(float, sums), float(p.max()), env_mean, env_m2,
        len(f), f_mean, f_m2, f_m3, f_m4, float(f.min()) if len(f) else None, float(f.max()) if len(f) else None,
        float(phase[0]), float(phase[-1]), float(f[0]) if len(f) else None, float(f[-1]) if len(f) else None,
        float(run[-1]), float(run.sum()), float((run * np.arange(len(run))).sum()),
        first, np.bincount(place, weights=p) , members,
    ]


def block_states(blocks: DataFrame, focus: DataFrame | None = None, window: int = bursts.ENVELOPE_WINDOW) -> DataFrame:
    """One row of sums per block; with ``focus(capture_id, lo, hi)`` of its samples in ``[lo, hi)``.

    Samples in focus are numbered from ``lo``; blocks without any leave no row.
    """
    kind = blocks.schema["capture_id"].dataType.simpleString()
    rows = blocks.select("capture_id", "block_no", "start_n", "i", "q")
    cut = focus is not None
    if cut:
        rows = rows.join(focus.select("capture_id", "lo", "hi"), "capture_id").where(
            (F.col("start_n") < F.col("hi")) & (F.col("start_n") + F.size("i") > F.col("lo"))
        )
    schema = f"capture_id {kind}, {_FIELDS}"
    fields = [field.split() for field in _FIELDS.split(", ")]
    arrow = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            spans = zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist()) if cut else None
            plain = zip(batch.column("capture_id").to_pylist(), batch.column("block_no").to_pylist(), batch.column("start_n").to_pylist())
            for (capture_id, block_no, start), x in zip(plain, samples_of(batch), strict=True):
                if spans is not None:
                    lo, hi = next(spans)
                    x = x[max(lo - start, 0) : max(hi - start, 0)]
                    start = max(start, lo) - lo
                if len(x):
                    ids.append(capture_id)
                    found.append([block_no, *_state(x, start, window)])
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field("capture_id").type)]
                    + [pa.array(list(c), arrow[t]) for c, (_, t) in zip(columns, fields, strict=True)],
                    ["capture_id", *[name for name, _ in fields]],
                )

    return rows.mapInArrow(run, schema)


def crossings(states: DataFrame) -> DataFrame:
    """(capture_id, block_no, cross, next_f): the phase step to the next block, and the first step in that one."""
    order = Window.partitionBy("capture_id").orderBy("block_no")
    step = wrap_phase(F.lead("head").over(order) - F.col("tail"))
    return states.select(
        "capture_id", "block_no", "last_f", step.alias("cross"), F.lead("first_f").over(order).alias("next_f")
    ).where("cross IS NOT NULL")


def merged(states: DataFrame) -> DataFrame:
    """One row per capture: sums, merged central moments of envelope (``e_``) and steps (``f_``)."""
    steps = crossings(states)
    crossed = steps.groupBy("capture_id").agg(
        F.count("*").alias("c_num"), F.sum("cross").alias("c_sum"), F.sum(F.abs("cross")).alias("c_abs"),
        F.min("cross").alias("c_lo"), F.max("cross").alias("c_hi"),
    )
    whole = states.groupBy("capture_id").agg(
        F.sum("num").alias("num"), *[F.sum(f"s_{n}").alias(f"s_{n}") for n in _SUMS], F.max("peak").alias("peak"),
        F.sum("f_num").alias("f_num0"), F.sum(F.col("f_num") * F.col("f_mean")).alias("f_sum0"),
        F.min("f_lo").alias("f_lo0"), F.max("f_hi").alias("f_hi0"),
    )
    none = F.lit(0.0)
    means = whole.join(crossed, "capture_id", "left").select(
        "capture_id", "num", *[f"s_{n}" for n in _SUMS if n != "abs_f"], "peak",
        (F.col("s_abs_f") + F.coalesce("c_abs", none)).alias("s_abs_f"),
        (F.col("f_num0") + F.coalesce("c_num", F.lit(0))).alias("f_num"),
        F.try_divide(F.col("f_sum0") + F.coalesce("c_sum", none), F.col("f_num0") + F.coalesce("c_num", F.lit(0))).alias("f_mean"),
        F.least("f_lo0", "c_lo").alias("f_lo"), F.greatest("f_hi0", "c_hi").alias("f_hi"),
        (F.col("s_env") / F.col("num")).alias("e_mean"),
    )
    d = F.col("b_mean") - F.col("f_mean")
    e = F.col("env_mean") - F.col("e_mean")
    # A step between blocks counts as a block of one step.
    parts = states.select(
        "capture_id", "num", "env_mean", "env_m2", "f_num", F.col("f_mean").alias("b_mean"), "f_m2", "f_m3", "f_m4"
    ).unionByName(
        steps.select(
            "capture_id", F.lit(0).cast("long").alias("num"), none.alias("env_mean"), none.alias("env_m2"),
            F.lit(1).cast("long").alias("f_num"), F.col("cross").alias("b_mean"), none.alias("f_m2"), none.alias("f_m3"), none.alias("f_m4"),
        )
    )
    n = F.col("f_num")
    central = parts.join(means.select("capture_id", "f_mean", "e_mean"), "capture_id").groupBy("capture_id").agg(
        F.sum(F.when(n > 0, F.col("f_m2") + n * d * d)).alias("f_m2"),
        F.sum(F.when(n > 0, F.col("f_m4") + 4.0 * d * F.col("f_m3") + 6.0 * d * d * F.col("f_m2") + n * d * d * d * d)).alias("f_m4"),
        F.sum(F.when(F.col("num") > 0, F.col("env_m2") + F.col("num") * e * e)).alias("e_m2"),
    )
    return means.join(central, "capture_id")


def shape_features(m: DataFrame) -> DataFrame:
    """Cumulant sizes and envelope measures of merged states, as ``stats.cumulants`` and ``stats.envelope_stats`` define them."""
    num = F.col("num")
    p = (F.col("s_ii") + F.col("s_qq")) / num
    usable = (num >= 4) & (p >= 1e-12)
    m20 = ((F.col("s_ii") - F.col("s_qq")) / num / p, 2.0 * F.col("s_iq") / num / p)
    m20sq = csquare(m20)
    p2 = p * p
    c40 = (F.col("s_x4re") / num / p2 - 3.0 * m20sq[0], F.col("s_x4im") / num / p2 - 3.0 * m20sq[1])
    c42 = (F.col("s_px2re") / num / p2 - power(*m20) - 2.0, F.col("s_px2im") / num / p2)
    loud = p > 1e-30
    m4, m6 = F.col("s_p2") / num, F.col("s_p3") / num

    def gated(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(F.lit(0.0))

    return m.select(
        "capture_id",
        gated(usable, F.sqrt(power(*c40))).alias("c40_abs"),
        gated(usable, F.sqrt(power(*c42))).alias("c42_abs"),
        gated(usable, F.sqrt(power(*m20))).alias("c20_abs"),
        gated(F.col("e_mean") > 1e-12, F.sqrt(F.greatest(F.col("e_m2"), F.lit(0.0)) / num) / F.col("e_mean")).alias("env_norm"),
        gated(loud, decibel(F.col("peak") / p)).alias("papr_db"),
        gated(loud, m4 / (p * p)).alias("m4m2"),
        gated(loud, m6 / (p * p * p)).alias("m6m2"),
    )


def step_moments(m: DataFrame) -> DataFrame:
    """(capture_id, fvar, kurtosis) of the phase steps, as ``stats.frequency_stats`` defines them."""
    var = F.col("f_m2") / F.col("f_num")
    kurtosis = F.try_divide(F.col("f_m4") / F.col("f_num"), var * var)
    return m.where("f_num > 0").select(
        "capture_id",
        var.alias("fvar"),
        F.when(var > 1e-18, clamp(kurtosis, 0.0, stats.MAX_KURTOSIS)).otherwise(F.lit(0.0)).alias("kurtosis"),
    )


def last_resort(m: DataFrame) -> DataFrame:
    """(capture_id, vi, vq, vm, vf): the variances that the last-resort label looks at."""
    num = F.col("num")

    def var(square: str, plain: str) -> Column:
        mean = F.col(plain) / num
        return F.greatest(F.col(square) / num - mean * mean, F.lit(0.0))

    return m.select(
        "capture_id", var("s_ii", "s_i").alias("vi"), var("s_qq", "s_q").alias("vq"),
        (F.col("e_m2") / num).alias("vm"), F.try_divide(F.col("f_m2"), F.col("f_num")).alias("vf"),
    )


def imbalance(m: DataFrame) -> DataFrame:
    """Branch moments of merged states: (capture_id, num, pi, pq, piq)."""
    num = F.col("num")
    return m.select(
        "capture_id", "num", (F.col("s_ii") / num).alias("pi"), (F.col("s_qq") / num).alias("pq"), (F.col("s_iq") / num).alias("piq")
    )


def frequency_offset(states: DataFrame) -> DataFrame:
    """(capture_id, cfo_hz) in cycles per sample: slope of the unwrapped phase; 0 below four samples.

    A block's phase is its first one, unwrapped over the blocks before it, plus its running sum
    of steps; with centred sample numbers the slope is one sum over the blocks.
    """
    order = Window.partitionBy("capture_id").orderBy("block_no")
    step = F.coalesce(wrap_phase(F.lead("head").over(order) - F.col("tail")), F.lit(0.0))
    totals = states.select("capture_id", "block_no", "start_n", "num", "head", "run", "krun", (F.col("total") + step).alias("moved"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    based = totals.select(
        "*",
        (F.first("head").over(order) + F.coalesce(F.sum("moved").over(before), F.lit(0.0))).alias("base"),
        F.sum("num").over(Window.partitionBy("capture_id")).alias("n"),
    )
    off = F.col("start_n") - (F.col("n") - 1) / 2.0
    inside = F.col("num") * (F.col("num") - 1) / 2.0
    product = F.sum(off * (F.col("num") * F.col("base") + F.col("run")) + F.col("base") * inside + F.col("krun"))
    n = F.first("n")
    slope = product / (n.cast("double") * (n.cast("double") * n - 1.0) / 12.0)
    return based.groupBy("capture_id").agg(F.when(n < 4, F.lit(0.0)).otherwise(slope / TWO_PI).alias("cfo_hz"))


def envelope_windows(states: DataFrame, window: int = bursts.ENVELOPE_WINDOW) -> DataFrame:
    """(capture_id, block, p): mean power of every full envelope window, also of those on block borders."""
    each = states.select("capture_id", "window_no", F.posexplode(F.arrays_zip("windows", "members")).alias("k", "w"))
    return (
        each.groupBy("capture_id", (F.col("window_no") + F.col("k")).alias("block"))
        .agg(F.sum("w.windows").alias("total"), F.sum("w.members").alias("held"))
        .where(F.col("held") == window)
        .select("capture_id", "block", (F.col("total") / window).alias("p"))
    )


def burst_focus(regions: DataFrame, least: int, least_burst: int) -> DataFrame:
    """(capture_id, lo, hi, whole): the burst of a capture, or all of it where none is usable."""
    usable = F.col("found") & (F.col("n_samples") >= least) & (F.col("end_sample") - F.col("start_sample") >= least_burst)
    return regions.select(
        "capture_id",
        F.when(usable, F.col("start_sample")).otherwise(F.lit(0)).alias("lo"),
        F.when(usable, F.col("end_sample")).otherwise(F.col("n_samples")).alias("hi"),
        (~usable).alias("whole"),
    )


# -- second look: values are known by now that a measure depends on -----------------


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles, zeros of both signs alike."""
    bits = np.ascontiguousarray(values, np.float64).view(np.int64)
    return np.where(bits < 0, -(bits & np.int64(0x7FFFFFFFFFFFFFFF)), bits)


def values_of(keys: np.ndarray) -> np.ndarray:
    """The doubles of ``ordered_keys``."""
    size = np.abs(np.ascontiguousarray(keys, np.int64)).view(np.float64)
    return np.where(keys < 0, -size, size)


def radix_counts(keys: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Slots of keys in ``[low, high]`` by the leading bits of their distance to ``low``: (slots, counts, bits left)."""
    inside = keys[(keys >= low) & (keys <= high)]
    left = max(0, (high - low + 1).bit_length() - RADIX_BITS)
    slots, counts = np.unique((inside.view(np.uint64) - np.uint64(low % (1 << 64))) >> np.uint64(left), return_counts=True)
    return slots.astype(np.int64), counts, left


_ASK = "array<struct<part: int, mode: int, low: double, high: double, klow: bigint, khigh: bigint, held: bigint, place: bigint>>"
#: What a step is counted by: equal parts of its range, leading bits, or the value itself.
EQUAL_PARTS, BITS, VALUES = 0, 1, 2
#: Counts that a task keeps before it sends them on.
SENT = 1 << 16


def _at_place(keys: np.ndarray, low: int, place: int) -> Iterator[tuple[int, int, int]]:
    """Counts of all keys below that at ``place`` of the sorted ones, as one range from ``low`` on, and of those equal to it."""
    ordered = np.partition(keys, place)
    key = int(ordered[place])
    below = int((keys < key).sum())
    if below:
        yield low, key - 1, below
    yield key, key, int((keys == key).sum())


def step_counts(blocks: DataFrame, crossed: DataFrame, asks: DataFrame) -> DataFrame:
    """(capture_id, part, low, high, hits): how many phase steps fall where.

    ``asks(capture_id, lo, hi, asks)`` lists for a capture what to count among the samples in
    ``[lo, hi)``: ``EQUAL_PARTS`` gives the number of the part of ``[low, high]`` as ``low``, ``BITS`` and
    ``VALUES`` give ranges of ordered keys. ``crossed(capture_id, cross)`` are the steps between blocks.
    ``held`` is the number of steps of the capture in a range of values, ``place`` the rank that is looked
    for among them: a block that holds them all, as that of a short capture, sends what lies below
    that place and at it, instead of every value.
    """
    kind = blocks.schema["capture_id"].dataType.simpleString()
    inside = blocks.select("capture_id", "start_n", "i", "q").join(asks, "capture_id").where(
        (F.col("start_n") < F.col("hi")) & (F.col("start_n") + F.size("i") > F.col("lo"))
    )
    none = F.array().cast("array<double>")
    rows = inside.select("capture_id", "start_n", "lo", "hi", "asks", "i", "q", none.alias("steps")).unionByName(
        crossed.join(asks, "capture_id").select(
            "capture_id", F.lit(0).cast("long").alias("start_n"), "lo", "hi", "asks", none.alias("i"), none.alias("q"),
            F.array("cross").alias("steps"),
        )
    )
    parts = stats.FREQUENCY_BINS

    def counted(f: np.ndarray, ask: dict) -> Iterator[tuple[int, int, int]]:
        if ask["mode"] == EQUAL_PARTS:
            low, high = ask["low"], ask["high"]
            slot = np.minimum(np.floor((f - low) / (high - low) * parts), parts - 1).astype(np.int64)
            yield from ((int(s), 0, int(c)) for s, c in zip(*np.unique(slot, return_counts=True), strict=True))
            return
        keys = ordered_keys(f)
        if ask["mode"] == VALUES:
            keys = keys[(keys >= ask["klow"]) & (keys <= ask["khigh"])]
            if len(keys) and len(keys) == ask["held"]:
                yield from _at_place(keys, ask["klow"], ask["place"])
                return
            yield from ((int(k), int(k), int(c)) for k, c in zip(*np.unique(keys, return_counts=True), strict=True))
            return
        slots, counts, left = radix_counts(keys, ask["klow"], ask["khigh"])
        for s, c in zip(slots.tolist(), counts.tolist(), strict=True):
            low = ask["klow"] + (s << left)
            yield low, min(ask["khigh"], low + (1 << left) - 1), c

    def sent(found: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        ids, *numbers = zip(*found, strict=True)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), *[pa.array(c, t) for c, t in zip(numbers, types, strict=True)]],
            ["capture_id", "part", "low", "high", "hits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, id_type = [], batch.schema.field("capture_id").type
            names = ("capture_id", "start_n", "lo", "hi", "asks", "steps")
            plain = zip(*(batch.column(c).to_pylist() for c in names), strict=True)
            for (capture_id, start, lo, hi, asked, steps), x in zip(plain, samples_of(batch), strict=True):
                f = np.array(steps) if steps else phase_steps(x[max(lo - start, 0) : max(hi - start, 0)])[1]
                if len(f):
                    found += [(capture_id, ask["part"], *row) for ask in asked for row in counted(f, ask)]
                if len(found) >= SENT:
                    yield sent(found, id_type)
                    found = []
            if found:
                yield sent(found, id_type)

    each = rows.mapInArrow(run, f"capture_id {kind}, part int, low long, high long, hits long")
    return each.groupBy("capture_id", "part", "low", "high").agg(F.sum("hits").alias("hits"))


@pandas_udf(T.LongType())
def _key(v: pd.Series) -> pd.Series:
    return pd.Series(ordered_keys(v.to_numpy()))


@pandas_udf(T.DoubleType())
def _value(k: pd.Series) -> pd.Series:
    return pd.Series(values_of(k.to_numpy()))


def step_distribution(blocks: DataFrame, states: DataFrame, m: DataFrame, focus: DataFrame, probs: list[float]) -> DataFrame:
    """(capture_id, nsig, q0, q1, ...): significant parts of the steps' histogram, and exact quantiles of theirs.

    A quantile lies between two ranks. While the range of values that holds a rank has more than
    ``RANKED`` steps, these are counted by the leading bits of their ordered keys and the slot
    with the rank goes on; the few that are left are counted value by value. A capture of any
    length is so decided by counts, in one pass over the samples for each ``RADIX_BITS`` bits.
    """
    crossed = crossings(states).select("capture_id", "cross")
    spans = m.where("f_num > 0").join(focus.select("capture_id", "lo", "hi"), "capture_id")
    place = [F.lit(p) * (F.col("f_num") - 1) for p in probs]
    ranks = [rank for p in place for rank in (F.floor(p), F.least(F.floor(p) + 1, F.col("f_num") - 1))]
    listed = F.array(*[F.struct(F.lit(k).alias("part"), rank.alias("rank")) for k, rank in enumerate(ranks)])
    spans = pin(spans.select("capture_id", "lo", "hi", "f_num", "f_lo", "f_hi", _key("f_lo").alias("klow"), _key("f_hi").alias("khigh"), listed.alias("r")))
    open_ = spans.select("capture_id", "lo", "hi", "klow", "khigh", F.col("f_num").alias("held"), F.lit(0).cast("long").alias("below"), F.explode("r").alias("r"))
    open_ = open_.select("capture_id", "lo", "hi", "klow", "khigh", "held", "below", "r.part", "r.rank")

    def asked(rows: DataFrame, extra: DataFrame | None = None) -> DataFrame:
        mode = F.when((F.col("held") > RANKED) & (F.col("khigh") > F.col("klow")), F.lit(BITS)).otherwise(F.lit(VALUES))
        void = F.lit(None).cast("double")
        place = (F.col("rank") - F.col("below")).alias("place")
        ask = F.struct("part", mode.alias("mode"), void.alias("low"), void.alias("high"), "klow", "khigh", "held", place)
        each = rows.select("capture_id", "lo", "hi", ask.alias("ask"))
        each = each if extra is None else each.unionByName(extra)
        return each.groupBy("capture_id", "lo", "hi").agg(F.collect_list("ask").cast(_ASK).alias("asks"))

    null = F.lit(None).cast("long")
    equal = spans.where("f_hi > f_lo").select(
        "capture_id", "lo", "hi",
        F.struct(F.lit(-1).alias("part"), F.lit(EQUAL_PARTS).alias("mode"), F.col("f_lo").alias("low"), F.col("f_hi").alias("high"), null.alias("klow"), null.alias("khigh"), null.alias("held"), null.alias("place")).alias("ask"),
    )
    counts = pin(step_counts(blocks, crossed, asked(open_, equal)))
    bins = counts.where("part = -1")
    tops = bins.groupBy("capture_id").agg(F.max("hits").alias("top"))
    nsig = bins.join(tops, "capture_id").groupBy("capture_id").agg(
        F.sum((F.col("hits") > stats.FREQUENCY_PEAK_SHARE * F.col("top")).cast("long")).alias("nsig")
    )
    found = None
    while True:
        order = Window.partitionBy("capture_id", "part").orderBy("low")
        upto = counts.where("part >= 0").withColumn("upto", F.sum("hits").over(order))
        here = upto.join(open_.select("capture_id", "part", "lo", "hi", "rank", "below"), ["capture_id", "part"]).where(
            (F.col("rank") < F.col("below") + F.col("upto")) & (F.col("rank") >= F.col("below") + F.col("upto") - F.col("hits"))
        )
        chosen = pin(
            here.select(
                "capture_id", "lo", "hi", F.col("low").alias("klow"), F.col("high").alias("khigh"), F.col("hits").alias("held"),
                (F.col("below") + F.col("upto") - F.col("hits")).alias("below"), "part", "rank",
            )
        )
        done = chosen.where("klow = khigh").select("capture_id", "part", "klow")
        found = done if found is None else found.unionByName(done)
        open_ = chosen.where("klow < khigh")
        if open_.isEmpty():
            break
        counts = pin(step_counts(blocks, crossed, asked(open_)))
    values = found.groupBy("capture_id").agg(
        *[F.max(F.when(F.col("part") == k, F.col("klow"))).alias(f"k{k}") for k in range(2 * len(probs))]
    )
    values = values.select("capture_id", *[_value(f"k{k}").alias(f"v{k}") for k in range(2 * len(probs))])
    share = [p - F.floor(p) for p in place]
    quantiles = [
        (F.col(f"v{2 * k}") + share[k] * (F.col(f"v{2 * k + 1}") - F.col(f"v{2 * k}"))).alias(f"q{k}") for k in range(len(probs))
    ]
    return spans.join(values, "capture_id").join(nsig, "capture_id", "left").select(
        "capture_id", F.coalesce("nsig", F.lit(1)).cast("long").alias("nsig"), *quantiles
    )


def fit_sums(blocks: DataFrame, mean_power: DataFrame, schemes: tuple[str, ...] = symbols.LINEAR_SCHEMES) -> DataFrame:
    """Error-vector magnitude under every scheme, as ``symbols.fit_table`` gives it, from sums per block."""
    kind = blocks.schema["capture_id"].dataType.simpleString()
    nearest = symbols.nearest_points
    rows = blocks.select("capture_id", "i", "q").join(mean_power.where("p > 1e-20").select("capture_id", "p"), "capture_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sums = batch.column("capture_id"), []
            for p, x in zip(batch.column("p").to_pylist(), samples_of(batch), strict=True):
                unit = x / np.sqrt(p)
                row = [float(len(x))]
                for scheme in schemes:
                    near = nearest(scheme, unit)
                    off = unit - near
                    row += [float((off.real**2 + off.imag**2).sum()), float((near.real**2 + near.imag**2).sum())]
                sums.append(row)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sums, pa.list_(pa.float64()))], ["capture_id", "sums"])

    each = rows.mapInArrow(run, f"capture_id {kind}, sums array<double>")
    total = each.groupBy("capture_id").agg(*[F.sum(F.col("sums")[k]).alias(f"t{k}") for k in range(1 + 2 * len(schemes))])
    listed = F.array(*[
        F.struct(F.lit(s).alias("scheme"), F.col(f"t{2 * k + 1}").alias("e"), F.col(f"t{2 * k + 2}").alias("p")) for k, s in enumerate(schemes)
    ])
    ratio = F.sqrt(F.col("s.e") / F.col("s.p"))
    return total.select("capture_id", F.col("t0").cast("long").alias("n_symbols"), F.explode(listed).alias("s")).select(
        "capture_id", "s.scheme", "n_symbols", (ratio * 100.0).alias("evm_percent"), F.when(ratio > 0, -20.0 * F.log10(ratio)).alias("mer_db")
    )


def packed_bits(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """(capture_id, block_no, start_bit, n_bits, data): bits of each block under the capture's linear scheme.

    ``plan(capture_id, scheme, peak)``, ``peak`` the largest power of the capture. First bit of a
    block highest in its first byte, zero bits at the end of the last.
    """
    kind, sliced = blocks.schema["capture_id"].dataType.simpleString(), symbols.sliced_bits
    rows = blocks.select("capture_id", "block_no", "start_n", "i", "q").join(
        plan.where(F.col("scheme").isin(*symbols.LINEAR_SCHEMES)).select("capture_id", "scheme", "peak"), "capture_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, counts, data = [], [], []
            plain = zip(*(batch.column(c).to_pylist() for c in ("start_n", "scheme", "peak")), strict=True)
            for (start, scheme, peak), x in zip(plain, samples_of(batch), strict=True):
                bits = sliced(scheme, x / np.sqrt(peak) if peak > 0 else x)
                starts.append(start * bits.shape[1])
                counts.append(bits.size)
                data.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("capture_id"), batch.column("block_no"), pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(data, pa.binary()),
                ],
                ["capture_id", "block_no", "start_bit", "n_bits", "data"],
            )

    return rows.mapInArrow(run, f"capture_id {kind}, block_no long, start_bit long, n_bits long, data binary")


def lagged(states: DataFrame, m: DataFrame) -> DataFrame:
    """(capture_id, m, scale, c0, c1): number and mean size of the steps, their squares and lag-1 products about the mean."""
    mean = F.col("mean")
    d = F.col("f_mean") - mean
    inside = F.col("s_lag") - d * (F.col("first_f") + F.col("last_f") - 2.0 * F.col("f_mean")) + (F.col("f_num") - 1) * d * d
    known = m.where("f_num > 0").select("capture_id", F.col("f_mean").alias("mean"), F.col("f_num").alias("m"), (F.col("s_abs_f") / F.col("f_num")).alias("scale"), F.col("f_m2").alias("c0"))
    own = states.where("f_num > 0").join(known.select("capture_id", "mean"), "capture_id").select("capture_id", inside.alias("c1"))
    step = F.col("cross") - mean
    border = crossings(states).join(known.select("capture_id", "mean"), "capture_id").select(
        "capture_id", (F.coalesce(F.col("last_f") - mean, F.lit(0.0)) * step + step * F.coalesce(F.col("next_f") - mean, F.lit(0.0))).alias("c1")
    )
    total = own.unionByName(border).groupBy("capture_id").agg(F.sum("c1").alias("c1"))
    return known.join(total, "capture_id").select("capture_id", "m", "scale", "c0", "c1")


def coalesced(blocks: DataFrame, block_len: int, wanted: int = 1 << 16) -> tuple[DataFrame, int]:
    """Blocks of about ``wanted`` samples, a multiple of 8, made of whole given ones; long blocks stay as they are."""
    unit = block_len if block_len % 8 == 0 else 8 * block_len
    size = unit * max(1, wanted // unit)
    if size == block_len:
        return blocks, block_len
    parts = F.sort_array(F.collect_list(F.struct("start_n", "i", "q")))
    joined = blocks.groupBy("capture_id", F.floor(F.col("start_n") / size).alias("block_no")).agg(parts.alias("parts"))
    return joined.select(
        "capture_id", "block_no", (F.col("block_no") * size).alias("start_n"), F.flatten("parts.i").alias("i"), F.flatten("parts.q").alias("q")
    ), size


def packed_frames(bits: DataFrame, halo_bits: int) -> DataFrame:
    """(capture_id, frame_no, start, n_bits, data): packed block rows, each with the first bits of the next."""
    head = F.expr(f"substring(data, 1, {halo_bits // 8})")
    sent = bits.select("capture_id", "block_no", F.lit(0).alias("turn"), "start_bit", "n_bits", "data").unionByName(
        bits.where("block_no > 0").select(
            "capture_id", F.col("block_no") - 1, F.lit(1).alias("turn"), "start_bit", F.least("n_bits", F.lit(halo_bits).cast("long")).alias("n_bits"), head.alias("data")
        ).toDF("capture_id", "block_no", "turn", "start_bit", "n_bits", "data")
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "start_bit", "n_bits", "data")))
    both = sent.groupBy("capture_id", F.col("block_no").alias("frame_no")).agg(ordered.alias("c")).where(F.col("c")[0]["turn"] == 0)
    second = F.coalesce(F.get("c", F.lit(1))["data"], F.lit(b""))
    return both.select(
        "capture_id", "frame_no", F.col("c")[0]["start_bit"].alias("start"),
        F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["n_bits"]).alias("n_bits"), F.concat(F.col("c")[0]["data"], second).alias("data"),
    )


@pandas_udf(T.BinaryType())
def _from_bit(data: pd.Series, n_bits: pd.Series, start: pd.Series) -> pd.Series:
    """Packed bits from ``start`` on, moved to the first byte."""
    out = []
    for d, n, s in zip(data, n_bits, start):
        octets = np.frombuffer(d, np.uint8)[s // 8 :]
        out.append(np.packbits(np.unpackbits(octets, count=max(0, int(n) - 8 * (int(s) // 8)))[int(s) % 8 :]).tobytes())
    return pd.Series(out)


def payload_streams(bits: DataFrame, starts: DataFrame) -> DataFrame:
    """(capture_id, data): the packed payload of every capture from its ``start``; none where that lies beyond the end."""
    ordered = F.sort_array(F.collect_list(F.struct("block_no", "n_bits", "data")))
    whole = bits.groupBy("capture_id").agg(ordered.alias("c"), F.sum("n_bits").alias("n_bits"))
    data = F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["data"])), ""))
    start = F.greatest(F.coalesce(F.col("start"), F.lit(0)), F.lit(0)).cast("long")
    joined = whole.select("capture_id", "n_bits", data.alias("data")).join(starts.select("capture_id", "start"), "capture_id", "left")
    return joined.withColumn("start", start).where("start < n_bits").select("capture_id", _from_bit("data", "n_bits", "start").alias("data"))
