"""From ordered rows to numbered samples and block tables.

``samples``  (capture_id, n, i, q)                 one row per sample
``blocks``   (capture_id, block_no, start_n, i, q) arrays of up to ``block_len`` samples
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.session import pin

#: Block length for long captures: 65 536 samples are 1 MiB of doubles per row.
DEFAULT_BLOCK = 65_536

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in 33 bits


def number_rows(df: DataFrame, key: str, order: list[str | Column], out: str = "n") -> DataFrame:
    """Add the 0-based position of every row inside its key, for keys of any size.

    A window with ``row_number`` would sort one key in one task. Here the rows are
    range-partitioned on (key, order), so a hot key is spread over many tasks; the
    position is the place inside the partition plus the rows of the key that lie in
    earlier partitions. Rows that tie on the whole order must be interchangeable.
    """
    ordered = df.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    placed = pin(
        ordered.select(
            "*",
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
        )
    )
    runs = placed.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_len"))
    earlier = Window.partitionBy(key).orderBy("_part")
    shifts = runs.select(
        key, "_part", (F.sum("_len").over(earlier) - F.col("_len") - F.col("_first")).alias("_shift")
    )
    return (
        placed.join(shifts, [key, "_part"])
        .withColumn(out, F.col("_row") + F.col("_shift"))
        .drop("_part", "_row", "_shift")
    )


def to_blocks(samples: DataFrame, block_len: int = DEFAULT_BLOCK) -> DataFrame:
    """Gather numbered samples into bounded blocks; a long capture becomes many rows."""
    cells = F.sort_array(F.collect_list(F.struct("n", "i", "q")))
    return (
        samples.groupBy("capture_id", F.floor(F.col("n") / block_len).alias("block_no"))
        .agg(cells.alias("cells"))
        .select(
            "capture_id",
            "block_no",
            (F.col("block_no") * block_len).alias("start_n"),
            F.col("cells.i").alias("i"),
            F.col("cells.q").alias("q"),
        )
    )


def to_samples(blocks: DataFrame) -> DataFrame:
    """One row per sample; keeps the partitioning of the blocks (no shuffle)."""
    return blocks.select(
        "capture_id", "start_n", F.posexplode(F.arrays_zip("i", "q")).alias("k", "c")
    ).select(
        "capture_id",
        (F.col("start_n") + F.col("k")).alias("n"),
        F.col("c.i").alias("i"),
        F.col("c.q").alias("q"),
    )


def with_lookahead(blocks: DataFrame, ahead: int, block_len: int) -> DataFrame:
    """Extend every block by up to ``ahead`` samples of the blocks that follow it.

    Each block is sent to its own place and its head to the blocks before it, so the
    shuffle carries ``1 + ahead / block_len`` times the data and no task ever holds
    more than one block and its halo. Adds ``own_len``, the size without the halo.
    """
    reach = max(1, -(-ahead // block_len))
    copies = [
        F.struct(
            (F.col("block_no") - k).alias("block_no"),
            F.lit(k).alias("turn"),
            (F.slice("i", 1, max(0, min(block_len, ahead - (k - 1) * block_len))) if k else F.col("i")).alias("i"),
            (F.slice("q", 1, max(0, min(block_len, ahead - (k - 1) * block_len))) if k else F.col("q")).alias("q"),
        )
        for k in range(reach + 1)
    ]
    sent = blocks.select("capture_id", F.explode(F.array(*copies)).alias("c")).select(
        "capture_id", "c.block_no", "c.turn", "c.i", "c.q"
    )
    parts = F.sort_array(F.collect_list(F.struct("turn", "i", "q")))
    joined = (
        sent.where(F.col("block_no") >= 0)
        .groupBy("capture_id", "block_no")
        .agg(parts.alias("parts"))
        .where(F.col("parts")[0]["turn"] == 0)
    )
    return joined.select(
        "capture_id",
        "block_no",
        (F.col("block_no") * block_len).alias("start_n"),
        F.flatten("parts.i").alias("i"),
        F.flatten("parts.q").alias("q"),
        F.size(F.col("parts")[0]["i"]).alias("own_len"),
    )
