"""Schemas of operator results: columns of the input, then new ones, all nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def extended(df: DataFrame, kept: list[str], fields: str) -> StructType:
    """The types of the ``kept`` columns of ``df`` followed by ``fields``, given as DDL."""
    own = [StructField(name, df.schema[name].dataType, True) for name in kept]
    return StructType(own + StructType.fromDDL(fields).fields)
