"""Writers: strict JSON reports, spreadsheet-safe CSV, bit streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.bits import bits_to_bytes
from tonelake.operators.reports import SUMMARY_COLUMNS, json_safe

# First characters a spreadsheet would take for a formula.
FORMULA_START = r"^\s*[=+\-@|%]"


def safe_cell(value: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote."""
    return F.when(value.rlike(FORMULA_START), F.concat(F.lit("'"), value)).otherwise(value)


def write_reports(reports: DataFrame, path: str) -> None:
    json_safe(reports).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_summary_csv(rows: DataFrame, path: str) -> None:
    kinds = dict(rows.dtypes)
    cols = [
        (safe_cell(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(c) if c in kinds else F.lit(None).cast("string").alias(c)
        for c in SUMMARY_COLUMNS
    ]
    rows.select(*cols).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def packed_streams(bits: DataFrame) -> DataFrame:
    """One packed BINARY per capture, first bit highest, zero-padded; bounded by the size rule."""
    ordered = F.sort_array(F.collect_list(F.struct("k", "byte")))
    return bits_to_bytes(bits).groupBy("capture_id").agg(ordered.alias("c")).select(
        "capture_id", F.unhex(F.array_join(F.transform("c.byte", lambda b: F.lpad(F.hex(b), 2, "0")), "")).alias("data")
    )


def text_streams(bits: DataFrame) -> DataFrame:
    """One text of 0 and 1 per capture."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "bit")))
    return bits.groupBy("capture_id").agg(ordered.alias("c")).select(
        "capture_id", F.array_join(F.transform("c.bit", lambda b: b.cast("string")), "").alias("text")
    )


def write_manifest(entries: DataFrame, path: str) -> None:
    """One JSON object per downloaded file: what is known of it, its size and its checksum.

    ``entries``: (name, content) and any descriptive columns, which are kept.
    """
    rest = [c for c in entries.columns if c not in ("name", "content", "size_bytes", "sha256")]
    rows = entries.select("name", *rest, F.length("content").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    json_safe(rows).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_bits(bits: DataFrame, path: str, as_text: bool = False) -> None:
    """Packed streams as a table, or plain text files of 0 and 1 in a folder per capture."""
    if as_text:
        text_streams(bits).write.mode("overwrite").partitionBy("capture_id").text(path)
    else:
        packed_streams(bits).write.mode("overwrite").parquet(path)
