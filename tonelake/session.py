"""Session helpers: where intermediate tables are stored."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str | None:
    """The folder the cluster names for checkpoints.

    Where none is named, a new temporary folder in local mode, in which all tasks run on one
    machine; on a cluster none.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        return None
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="tonelake-")
    return _FALLBACK[app]


def pin(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the shared folder and go on from the stored rows.

    Used where a result is read more than once: the work above it is done a single
    time, survives lost executors, and later reads prune columns. On a cluster without a
    named folder the rows are kept on the executors' disks instead, and lost ones are
    computed again.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        kept = df.persist(StorageLevel.DISK_ONLY)
        kept.count()
        return kept
    path = f"{folder.rstrip('/')}/tonelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch for steps over whole texts or files.
TEXT_ROWS = 512


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows in an Arrow batch of the jobs that run inside.

    For rows as heavy as whole texts, of which the usual 10 000 would be held at once by the JVM
    and by Python. Only jobs that are run inside see it, see ``pin``.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, usual)


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of a scan that has fewer splits than the session has cores.

    Meant for inputs of CPU-heavy steps. A large table has more splits than cores and is
    left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
