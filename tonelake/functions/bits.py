"""Bits, bytes and checksums: column expressions and small Arrow UDFs.

A bit stream is either long, ``(capture_id, pos, bit)``, or packed, a BINARY column with
the first bit in the highest place of the first byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Fixed values of CRC-16/CCITT-FALSE.
CRC16_POLY = 0x1021
CRC16_INIT = 0xFFFF


# -- column expressions -------------------------------------------------------


def hex_nibbles(text: Column) -> Column:
    """Array of 4-bit values of a hex text with or without the 0x prefix."""
    digits = F.regexp_replace(F.lower(F.trim(text)), "^0x", "")
    return F.transform(F.regexp_extract_all(digits, F.lit("([0-9a-f])")), lambda c: F.conv(c, 16, 10).cast("int"))


def hex_bits(text: Column) -> Column:
    """Array of the bits of a hex text, most significant first."""
    return F.flatten(
        F.transform(
            hex_nibbles(text),
            lambda v: F.array(*[F.shiftright(v, s).bitwiseAND(F.lit(1)) for s in (3, 2, 1, 0)]),
        )
    )


def to_gray(value: Column) -> Column:
    return value.bitwiseXOR(F.shiftright(value, 1))


def from_gray(value: Column, width: int = 63) -> Column:
    """Prefix XOR by doubling shifts."""
    out = value
    shift = 1
    while shift < width:
        out = out.bitwiseXOR(F.shiftright(out, shift))
        shift *= 2
    return out


def byte_values(data: Column) -> Column:
    """Array of 0..255 of a BINARY column, inside the JVM: one Latin-1 character per byte."""
    letters = F.split(F.decode(data, "ISO-8859-1"), "")
    return F.when(F.length(data) > 0, F.transform(letters, lambda c: F.ascii(c))).otherwise(
        F.array().cast("array<int>")
    )


#: Bytes that are summed together, so that neither their places nor the sum outgrow 64 bits.
_SUMMED = 1 << 20


_SUMS = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "plain", "placed")])


@pandas_udf(_SUMS)
def byte_sums(data: pd.Series) -> pd.DataFrame:
    """Number of bytes of a BINARY column, their sum, and their sum weighted by place (from 1 on); 0 for none."""
    places = np.arange(1, _SUMMED + 1, dtype=np.int64)
    rows = []
    for d in data:
        octets = np.frombuffer(d or b"", np.uint8)
        plain = placed = 0
        for at in range(0, octets.size, _SUMMED):
            part = octets[at : at + _SUMMED].astype(np.int64)
            own = int(part.sum())
            plain += own
            placed += at * own + int(part @ places[: part.size])
        rows.append((octets.size, plain, placed))
    n, plain, placed = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame({"n": pd.Series(n, dtype="int64"), "plain": pd.Series(plain, dtype="int64"), "placed": pd.Series(placed, dtype="int64")})


#: Bytes of a payload that are cut into groups together, for each bit of their width.
_PIECE = 1 << 13
#: Groups that leave the cutting together.
_GROUPS = 1 << 18


def bit_groups(payloads: DataFrame, width: int) -> DataFrame:
    """(capture_id, g, v): all full ``width``-bit groups (at most 16) of every payload; the partial tail is dropped.

    Payloads are cut in pieces of whole groups, many in an array, so that no array grows with a payload.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _PIECE * width
        # In ``width`` bytes the eight groups start at the same places.
        first = np.arange(8) * width
        free = (24 - width - first % 8).astype(np.int32)
        for batch in batches:
            rows, starts, values, held = [], [], [], 0
            for k, data in enumerate(batch.column(1)):
                octets = np.frombuffer(data.as_buffer() if data.is_valid else b"", np.uint8)
                for at in range(0, octets.size, size):
                    count = min(size, octets.size - at) * 8 // width
                    part = np.zeros(-(-count // 8) * width + 2, np.int32)
                    there = octets[at : at + part.size]
                    part[: there.size] = there
                    windows = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
                    values.append((windows.reshape(-1, width)[:, first // 8] >> free & ((1 << width) - 1)).reshape(-1)[:count])
                    rows.append(k)
                    starts.append(at * 8 // width)
                    held += count
                    if held >= _GROUPS:
                        yield _arrays(batch, rows, starts, values)
                        rows, starts, values, held = [], [], [], 0
            if rows:
                yield _arrays(batch, rows, starts, values)

    kind = payloads.schema["capture_id"].dataType.simpleString()
    pieces = payloads.select("capture_id", "data").mapInArrow(cut, f"capture_id {kind}, start long, groups array<int>")
    return pieces.select("capture_id", "start", F.posexplode("groups").alias("k", "v")).select(
        "capture_id", (F.col("start") + F.col("k")).alias("g"), "v"
    )


def _arrays(batch: pa.RecordBatch, rows: list[int], starts: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(v) for v in values)], dtype=np.int32)
    groups = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), groups], ["capture_id", "start", "groups"]
    )


def bytes_to_bits(values: DataFrame, bytes_col: str = "byte") -> DataFrame:
    """(capture_id, k, byte) rows to (capture_id, pos, bit) rows."""
    bits = F.array(*[F.shiftright(bytes_col, 7 - j).bitwiseAND(F.lit(1)).cast("tinyint") for j in range(8)])
    return values.select("capture_id", "k", F.posexplode(bits).alias("j", "bit")).select(
        "capture_id", (F.col("k") * 8 + F.col("j")).alias("pos"), "bit"
    )


def bits_to_bytes(bits: DataFrame) -> DataFrame:
    """(capture_id, pos, bit) rows to (capture_id, k, byte) rows, zero-padded at the end."""
    place = F.call_function("shiftleft", F.col("bit").cast("int"), (F.lit(7) - F.col("pos") % 8).cast("int"))
    return bits.groupBy("capture_id", F.floor(F.col("pos") / 8).alias("k")).agg(F.sum(place).cast("int").alias("byte"))


def byte_rows(payloads: DataFrame) -> DataFrame:
    """(capture_id, k, byte): one row per byte of every payload."""
    return payloads.select("capture_id", F.posexplode(byte_values(F.col("data"))).alias("k", "byte"))


def pack_frames(bits: DataFrame, frame_bits: int, halo_bits: int) -> DataFrame:
    """Long bits to packed frames ``(capture_id, frame_no, start, n_bits, data)``.

    A frame owns ``frame_bits`` positions and carries ``halo_bits`` of the next frame, so
    a search over windows of up to ``halo_bits + 1`` bits needs no other frame. Both
    sizes are multiples of 8.
    """
    own = F.floor(F.col("pos") / frame_bits)
    homes = F.when(
        (F.col("pos") % frame_bits < halo_bits) & (own > 0), F.array(own, own - 1)
    ).otherwise(F.array(own))
    placed = bits.select("capture_id", "pos", "bit", F.explode(homes).alias("frame_no"))
    offset = F.col("pos") - F.col("frame_no") * frame_bits
    octets = placed.groupBy("capture_id", "frame_no", F.floor(offset / 8).alias("k")).agg(
        F.sum(
            F.call_function("shiftleft", F.col("bit").cast("int"), (F.lit(7) - offset % 8).cast("int"))
        ).cast("int").alias("byte"),
        F.count("*").alias("held"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("k", "byte")))
    return octets.groupBy("capture_id", "frame_no").agg(ordered.alias("cells"), F.sum("held").cast("int").alias("n_bits")).select(
        "capture_id",
        "frame_no",
        (F.col("frame_no") * frame_bits).alias("start"),
        "n_bits",
        F.unhex(F.array_join(F.transform("cells.byte", lambda b: F.lpad(F.hex(b), 2, "0")), "")).alias("data"),
    )


# -- checksums ----------------------------------------------------------------


@pandas_udf(T.IntegerType())
def crc16(data: pd.Series) -> pd.Series:
    """CRC-16/CCITT-FALSE of every value; NULL for NULL."""
    known = data.notna().to_numpy()
    out = pd.array([None] * len(data), dtype="Int32")
    out[known] = crc16_many(data[known].tolist()).astype(np.int32)
    return pd.Series(out)


def with_crc16(data: Column) -> Column:
    """The data followed by its CRC-16, high byte first."""
    return F.concat(data, F.unhex(F.lpad(F.hex(crc16(data)), 4, "0")))


def crc16_holds(data: Column) -> Column:
    """Does the trailing CRC-16 match what precedes it? FALSE below three bytes."""
    size = F.length(data)
    body = F.substring(data, F.lit(1), F.greatest(size - 2, F.lit(0)))
    tail = F.conv(F.hex(F.substring(data, F.greatest(size - 1, F.lit(1)), F.lit(2))), 16, 10).cast("int")
    return (size >= 3) & (crc16(body) == tail)


def _byte_step() -> np.ndarray:
    state = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        state = np.where(state & 0x8000, (state << 1) ^ CRC16_POLY, state << 1) & 0xFFFF
    return state.astype(np.uint16)


_SEGMENT = 256
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        step = _byte_step()
        leap = np.arange(65536, dtype=np.uint16)
        for _ in range(_SEGMENT):
            leap = step[leap >> 8] ^ (leap << np.uint16(8))
        _TABLES.update(step=step, leap=leap)
    return _TABLES["step"], _TABLES["leap"]


#: Bytes whose checksums are advanced together.
_TOGETHER = 1 << 22


def crc16_many(buffers: list[bytes], init: int = CRC16_INIT) -> np.ndarray:
    """CRC-16 of every buffer from the state ``init``.

    A buffer is one short head and whole 256-byte segments. All heads advance together byte by
    byte, and so do all segments, from state 0; then the states of a buffer's segments are chained
    with the table that advances a state over a segment of zeros.
    """
    out = np.zeros(len(buffers), np.uint16)
    begin, held = 0, 0
    for k, b in enumerate(buffers):
        held += len(b) + _SEGMENT
        if held >= _TOGETHER or k + 1 == len(buffers):
            out[begin : k + 1] = _crc16_together(buffers[begin : k + 1], init)
            begin, held = k + 1, 0
    return out


def _crc16_together(buffers: list[bytes], init: int) -> np.ndarray:
    step, leap = _tables()
    sizes = np.array([len(b) for b in buffers], np.int64)
    short = sizes % _SEGMENT
    heads = np.zeros((len(buffers), _SEGMENT), np.uint8)  # right-aligned
    for k, b in enumerate(buffers):
        if short[k]:
            heads[k, _SEGMENT - short[k] :] = np.frombuffer(b, np.uint8, short[k])
    state = np.full(len(buffers), init, np.uint16)
    columns = np.ascontiguousarray(heads.T)
    for j in range(_SEGMENT - int(short.max(initial=0)), _SEGMENT):
        moved = step[(state >> 8) ^ columns[j]] ^ (state << np.uint16(8))
        state = np.where(j >= _SEGMENT - short, moved, state)
    counts = sizes // _SEGMENT
    body = b"".join(b[s:] for b, s in zip(buffers, short.tolist()))
    columns = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(-1, _SEGMENT).T)
    alone = np.zeros(columns.shape[1], np.uint16)
    for column in columns:
        alone = step[(alone >> 8) ^ column] ^ (alone << np.uint16(8))
    first = np.cumsum(counts) - counts
    for s in range(int(counts.max(initial=0))):
        on = np.flatnonzero(counts > s)
        state[on] = leap[state[on]] ^ alone[first[on] + s]
    return state


def crc16_prefixes(buffers: list[bytes]) -> list[np.ndarray]:
    """For every buffer the CRC-16 of each of its prefixes, lengths 0..len.

    The CRC is linear in state and data: all 256-byte segments of all buffers advance
    together from state 0, their entry states are chained with a zero-advance table,
    and a second pass from those states yields every prefix.
    """
    step, leap = _tables()
    counts = [-(-len(b) // _SEGMENT) for b in buffers]
    total = sum(counts)
    grid = np.zeros((total, _SEGMENT), dtype=np.uint8)
    row = 0
    firsts = []
    for b, c in zip(buffers, counts):
        firsts.append(row)
        grid[row : row + c].reshape(-1)[: len(b)] = np.frombuffer(b, dtype=np.uint8)
        row += c
    columns = np.ascontiguousarray(grid.T)

    def advance(state: np.ndarray, column: np.ndarray) -> np.ndarray:
        return step[(state >> 8) ^ column] ^ (state << np.uint16(8))

    alone = np.zeros(total, dtype=np.uint16)
    for column in columns:
        alone = advance(alone, column)
    entry = np.full(total, CRC16_INIT, dtype=np.uint16)
    for first, c in zip(firsts, counts):
        for s in range(first + 1, first + c):
            entry[s] = leap[entry[s - 1]] ^ alone[s - 1]
    states = np.empty((_SEGMENT, total), dtype=np.uint16)
    running = entry
    for j, column in enumerate(columns):
        running = advance(running, column)
        states[j] = running
    by_segment = np.ascontiguousarray(states.T)
    return [
        np.concatenate([[np.uint16(CRC16_INIT)], by_segment[first : first + c].reshape(-1)[: len(b)]])
        for b, c, first in zip(buffers, counts, firsts)
    ]


SCAN_TYPE = T.StructType(
    [T.StructField("payload_len", T.IntegerType()), T.StructField("trials", T.IntegerType())]
)


def scan_udf(min_payload: int, window: int | None):
    """UDF: shortest end whose last two bytes are the CRC-16 of what precedes them.

    ``window=None`` tries every end; otherwise only ends within ``window`` bytes of the
    end of the data (and one more), plus the end with trailing zeros stripped.
    Gives ``payload_len`` (NULL without a match) and the number of ``trials``.
    """

    @pandas_udf(SCAN_TYPE)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in parts:
            lens, trials = [], []
            values = series.tolist()
            for at in range(0, len(values), 256):
                chunk = values[at : at + 256]
                for buf, prefix in zip(chunk, crc16_prefixes(chunk)):
                    n = len(buf)
                    lo = min_payload + 2
                    if n < lo:
                        lens.append(None)
                        trials.append(0)
                        continue
                    octets = np.frombuffer(buf, dtype=np.uint8).astype(np.uint16)
                    first = lo if window is None else max(lo, n - window - 1)
                    ends = np.arange(first, n + 1)
                    used = np.flatnonzero(octets)
                    bare = int(used[-1]) + 1 if used.size else 0
                    if lo <= bare < first:
                        ends = np.concatenate([[bare], ends])
                    stated = (octets[ends - 2] << np.uint16(8)) | octets[ends - 1]
                    hits = ends[prefix[ends - 2] == stated]
                    lens.append(int(hits[0]) - 2 if hits.size else None)
                    trials.append(int(ends.size))
            yield pd.DataFrame({"payload_len": pd.array(lens, dtype="Int32"), "trials": trials})

    return scan
