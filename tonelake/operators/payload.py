"""Payload bytes after the header: class, previews, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.bits import byte_values
from tonelake.functions.scalars import let

# Fixed values of the method.
PREVIEW_BYTES = 256
HEXDUMP_WIDTH = 16
TEXT_SHARE = 0.9
MIXED_SHARE = 0.5
UNPRINTABLE = r"[^\x20-\x7e\t\n\r]+"


def payload_start(detected: Column, offset: Column, sync_length: Column) -> Column:
    """First payload bit: behind a detected header, else the start of the stream."""
    return F.when(detected & (offset >= 0), offset + sync_length).otherwise(F.lit(0))


def slice_bits(bits: DataFrame, starts: DataFrame) -> DataFrame:
    """Bits from ``start`` on, re-based to 0; a start beyond the stream leaves no rows."""
    start = F.greatest(F.coalesce(F.col("start"), F.lit(0)), F.lit(0))
    return (
        bits.join(starts.select("capture_id", "start"), "capture_id", "left")
        .where(F.col("pos") >= start)
        .select("capture_id", (F.col("pos") - start).alias("pos"), "bit")
    )


def content_class(data: Column) -> Column:
    """empty / text / mixed / binary by the share of printable bytes."""
    kept = F.length(F.regexp_replace(F.decode(data, "ISO-8859-1"), UNPRINTABLE, ""))
    share = kept / F.length(data)
    return (
        F.when(F.length(data) == 0, F.lit("empty"))
        .when(share >= TEXT_SHARE, F.lit("text"))
        .when(share >= MIXED_SHARE, F.lit("mixed"))
        .otherwise(F.lit("binary"))
    )


def _glyph(byte: Column, keep_blank_controls: bool) -> Column:
    shown = (byte >= 32) & (byte < 127)
    if keep_blank_controls:
        shown = shown | byte.isin(9, 10, 13)
    return F.when(shown, F.char(byte)).otherwise(F.lit("."))


def text_preview(values: Column, max_bytes: int = PREVIEW_BYTES, total: Column | None = None) -> Column:
    """``values`` may be only the bytes shown; ``total`` is then the size of the payload."""
    head = F.slice(values, 1, max_bytes)
    text = F.array_join(F.transform(head, lambda b: _glyph(b, True)), "")
    size = F.size(values) if total is None else total
    return F.when(size > max_bytes, F.concat(text, F.lit("..."))).otherwise(text)


def hexdump(
    values: Column, width: int = HEXDUMP_WIDTH, max_bytes: int = PREVIEW_BYTES, total: Column | None = None
) -> Column:
    """Lines of ``offset  hex  |ascii|`` and a note on the bytes not shown."""
    rows = F.ceil(F.least(F.size(values), F.lit(max_bytes)) / width).cast("int")

    def line(row: Column) -> Column:
        room = F.least(F.lit(width), max_bytes - row * width)
        return let(F.slice(values, row * width + 1, room), lambda part: render(part, row))

    def render(part: Column, row: Column) -> Column:
        octets = F.array_join(F.transform(part, lambda b: F.lpad(F.lower(F.hex(b)), 2, "0")), " ")
        glyphs = F.array_join(F.transform(part, lambda b: _glyph(b, False)), "")
        at = F.lpad(F.lower(F.hex(row * width)), 8, "0")
        return F.concat(at, F.lit("  "), F.rpad(octets, width * 3 - 1, " "), F.lit("  |"), glyphs, F.lit("|"))

    lines = F.when(rows > 0, F.transform(F.sequence(F.lit(0), rows - 1), line)).otherwise(
        F.array().cast("array<string>")
    )
    size = F.size(values) if total is None else total
    more = F.concat(F.lit("... "), (size - max_bytes).cast("string"), F.lit(" more byte(s) not shown"))
    return F.when(size > max_bytes, F.concat(lines, F.array(more))).otherwise(lines)


def describe(payloads: DataFrame, max_bytes: int = PREVIEW_BYTES) -> DataFrame:
    """One row per payload: size, class, hex and text previews, hexdump lines."""

    def described(v: Column) -> Column:
        return F.struct(
            text_preview(v, max_bytes, F.length("data")).alias("text_preview"),
            hexdump(v, max_bytes=max_bytes, total=F.length("data")).alias("hexdump"),
        )

    return payloads.select(
        "capture_id",
        F.length("data").alias("bytes"),
        content_class(F.col("data")).alias("content_type"),
        F.lower(F.hex(F.substring("data", 1, max_bytes))).alias("hex_preview"),
        let(byte_values(F.substring("data", 1, max_bytes)), described).alias("d"),
    ).select("capture_id", "bytes", "content_type", "hex_preview", "d.text_preview", "d.hexdump")
