"""Bounded samples of labelled rows, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 30


def bounded_sample(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of ``key``; all rows if there are no more.

    A first cut by the hash leaves little more than ``most`` rows in all, so the exact limit
    that follows sorts a bounded number of rows.
    """
    total = rows.count()
    mixed = F.pmod(F.xxhash64(key), F.lit(_PARTS))
    marked = rows.withColumn("_mixed", mixed)
    if total > most:
        share = min(1.0, (most + 6 * most**0.5) / total)
        marked = marked.where(F.col("_mixed") < int(share * _PARTS) + 1)
    return marked.orderBy("_mixed", key).limit(most).drop("_mixed")
