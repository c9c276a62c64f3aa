"""Many hypotheses about one stream, scored where its samples lie.

Schemes, rotations and lags are tried inside a block: a block leaves packed bits or counts of
label pairs for each of them. What is shuffled is of the size of the data, not of the data
times the number of hypotheses, and no bit is a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions.bits import pack_frames
from tonelake.functions.scalars import TWO_PI
from tonelake.operators import state, symbols, sync
from tonelake.session import pin
from tonelake.sources.series import to_blocks, with_lookahead


def _id_type(df: DataFrame) -> str:
    return df.schema["capture_id"].dataType.simpleString()


def _packed(rows: DataFrame, name: str, kind: str, hypotheses: list, slicer) -> DataFrame:
    """(capture_id, <name>, block_no, start_bit, n_bits, data): ``slicer(hypothesis, samples, row)`` for each block and hypothesis."""
    samples_of = state.samples_of
    types = {"string": pa.string(), "int": pa.int32()}
    extra = [c for c in rows.columns if c not in ("capture_id", "block_no", "start_n", "i", "q")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            plain = zip(*(batch.column(c).to_pylist() for c in ("capture_id", "block_no", "start_n", *extra)), strict=True)
            for (capture_id, block_no, start, *more), x in zip(plain, samples_of(batch), strict=True):
                for h in hypotheses:
                    bits = slicer(h, x, *more)
                    found.append((capture_id, h, block_no, start * bits.shape[1], bits.size, np.packbits(bits).tobytes()))
            if found:
                columns = list(zip(*found, strict=True))
                kinds = [batch.schema.field("capture_id").type, types[kind], pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    ["capture_id", name, "block_no", "start_bit", "n_bits", "data"],
                )

    return rows.mapInArrow(run, f"capture_id {_id_type(rows)}, {name} {kind}, block_no long, start_bit long, n_bits long, data binary")


def _heads(bits: DataFrame, name: str, word: str) -> DataFrame:
    """Header verdicts of packed blocks under each hypothesis."""
    halo = -(-len(sync.parse_word(word)) // 8) * 8
    keyed = bits.withColumn("capture_id", F.struct("capture_id", name)).drop(name)
    found = sync.find_header(state.packed_frames(keyed, halo), word)
    return found.select(F.col("capture_id.capture_id").alias("capture_id"), F.col(f"capture_id.{name}").alias(name), "detected", "score", "offset")


def scheme_bits(blocks: DataFrame, schemes: tuple[str, ...] = symbols.LINEAR_SCHEMES) -> DataFrame:
    """Packed bits of every block under every linear scheme, after peak normalisation."""
    peaks = state.merged(state.block_states(blocks)).select("capture_id", "peak")
    sliced = symbols.sliced_bits

    def slicer(scheme: str, x: np.ndarray, peak: float) -> np.ndarray:
        return sliced(scheme, x / np.sqrt(peak) if peak > 0 else x)

    rows = blocks.select("capture_id", "block_no", "start_n", "i", "q").join(peaks, "capture_id")
    return _packed(rows, "scheme", "string", list(schemes), slicer)


def corroborate(
    blocks: DataFrame, block_len: int, freqs: DataFrame, periods: DataFrame, labels: DataFrame, word: str
) -> DataFrame:
    """``sync.corroborate`` over block tables: first other scheme, in cost order, whose bits show the header.

    Linear schemes are sliced block by block; tone schemes symbol by symbol from the phase steps.
    """
    joined, _ = state.coalesced(blocks, block_len)
    bits = scheme_bits(joined)
    for scheme, order in (("2-FSK", 2), ("4-FSK", 4)):
        tones = pack_frames(symbols.slice_tones(freqs, periods, order), sync.FRAME_BITS, 0)
        bits = bits.unionByName(
            tones.select(
                "capture_id", F.lit(scheme).alias("scheme"), F.col("frame_no").alias("block_no"), F.col("start").alias("start_bit"),
                F.col("n_bits").cast("long").alias("n_bits"), "data",
            )
        )
    heads = pin(_heads(bits, "scheme", word).withColumnRenamed("scheme", "candidate"))
    return sync.revised(heads, labels)


def resolve_rotation(blocks: DataFrame, block_len: int, scheme: str, word: str) -> DataFrame:
    """``sync.resolve_rotation`` over block tables: the symmetry rotation whose bits match the word best, the smallest on ties."""
    order = symbols.ROTATION_ORDER[scheme]
    sliced = symbols.sliced_bits
    turns = [(float(np.cos(TWO_PI * k / order)), float(np.sin(TWO_PI * k / order))) for k in range(order)]

    def slicer(k: int, x: np.ndarray) -> np.ndarray:
        c, s = turns[k]
        return sliced(scheme, (x.real * c - x.imag * s) + 1j * (x.real * s + x.imag * c), by_level=True)

    joined, _ = state.coalesced(blocks, block_len)
    bits = _packed(joined.select("capture_id", "block_no", "start_n", "i", "q"), "rotation", "int", list(range(order)), slicer)
    best = _heads(bits, "rotation", word).groupBy("capture_id").agg(
        F.max_by(F.struct("rotation", "score", "offset", "detected"), F.struct("score", -F.col("rotation"))).alias("b")
    )
    return best.select("capture_id", "b.rotation", "b.score", "b.offset", "b.detected")


def lagged_pairs(tx: DataFrame, rx: DataFrame, lags: tuple[int, int], block_len: int = 1 << 16) -> DataFrame:
    """(capture_id, lag, sent, got, num): label pairs of ``tx`` at n and ``rx`` at n + lag, for every lag at once.

    Both series are dealt out once, in blocks; a block of ``rx`` also holds what the largest lag
    reaches. Positions that a series does not have pair with nothing; a gap is shorter than a block.
    """
    def laid(df: DataFrame, shift: int) -> DataFrame:
        return df.select("capture_id", (F.col("n") + shift).alias("n"), F.col("label").cast("double").alias("i"), (F.col("n") + shift).cast("double").alias("q"))

    reach = lags[1] - lags[0]
    sent = to_blocks(laid(tx, 0), block_len).select("capture_id", "block_no", F.col("i").alias("sent"), F.col("q").alias("sent_at"))
    got = with_lookahead(to_blocks(laid(rx, -lags[0]).where("n >= 0"), block_len), max(reach, 1), block_len)
    got = got.select("capture_id", "block_no", F.col("i").alias("got"), F.col("q").alias("got_at"))
    both = sent.join(got, ["capture_id", "block_no"])
    kind = _id_type(tx)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for capture_id, block_no, s, s_at, g, g_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = block_no * block_len
                there = np.full(block_len + reach + 1, -1, np.int64)
                at = np.array(g_at, np.int64) - start
                inside = at < len(there)
                there[at[inside]] = np.array(g, np.int64)[inside]
                label, own = np.array(s, np.int64), np.array(s_at, np.int64) - start
                width = int(max(label.max(), there.max())) + 1
                for k in range(reach + 1):
                    other = there[own + k]
                    hit = other >= 0
                    counts = np.bincount(label[hit] * width + other[hit])
                    for pair in np.flatnonzero(counts).tolist():
                        found.append((capture_id, lags[0] + k, pair // width, pair % width, int(counts[pair])))
            if found:
                columns = list(zip(*found, strict=True))
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["capture_id", "lag", "sent", "got", "num"]
                )

    counted = both.mapInArrow(run, f"capture_id {kind}, lag int, sent int, got int, num long")
    return counted.groupBy("capture_id", "lag", "sent", "got").agg(F.sum("num").alias("num"))


def best_bit_error_rate(tx: DataFrame, rx: DataFrame, scheme: str, lags: tuple[int, int] = (-2, 12), block_len: int = 1 << 16) -> DataFrame:
    """``symbols.best_bit_error_rate`` with one copy of each series."""
    return symbols.rate_of_pairs(lagged_pairs(tx, rx, lags, block_len), scheme)
