"""Allow or block download addresses: rules first, a linear model for the rest.

The manifest of captures to fetch names a file and its address. A rule is a host and the start
of a path, and speaks for its host and all subdomains; the longest rule that fits decides. All
other addresses are judged by logistic regression on hashed character n-grams of host and
path, fitted on a small table of labelled addresses.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.linear import Logistic, Sparse, fit
from tonelake.llm.records import extended
from tonelake.llm.sampling import bounded_sample

#: Labelled addresses that the model is fitted on, at most.
SAMPLE_ROWS = 5_000
GRAMS = (3, 4, 5)
#: Buckets of the feature hash.
BUCKETS = 1 << 18

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (like ``example.net/en/`` -> verdict) that fits, or null.

    ``rules`` is a short fixed list: it becomes a part of the expression.
    """
    fitting = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        fitting = F.when(fits, rule).otherwise(fitting)
    return fitting


def grams(host: str, path: str) -> np.ndarray:
    """Distinct bucket numbers of the n-grams of host and path, ends marked, each told from the other."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for k in range(len(text) - n + 1):
                found.add(zlib.crc32(f"{mark}{text[k : k + n]}".encode()) % BUCKETS)
    return np.array(sorted(found), np.int64)


def fit_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Logistic:
    """Fit on at most ``sample_rows`` rows of ``labelled(url, blocked 0/1)``; null labels are passed over.

    Equal pairs of host and path count once. The rows are few by definition, so they are
    fitted on the driver.
    """
    parts = labelled.where("blocked IS NOT NULL").select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("blocked").cast("double")
    )
    known = parts.groupBy("host", "path").agg(F.max("blocked").alias("blocked"))
    table = bounded_sample(known, F.concat_ws("\n", "host", "path"), sample_rows).toPandas()
    rows = Sparse.of([grams(h, p) for h, p in zip(table["host"], table["path"], strict=True)])
    label = table["blocked"].to_numpy(float)
    return fit(rows, np.zeros((len(rows), 0)), label, np.unique(rows.features), penalty=1e-3, steps=200)


def judge_urls(manifest: DataFrame, rules: dict[str, str], labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``manifest(name, url)`` -> ``(name, host, path, rule, p_block, verdict)``.

    ``rule`` is the deciding rule or null, ``p_block`` the model's probability, ``verdict``
    ``allow`` or ``block``: the rule's, else ``block`` if ``p_block > 0.5``.

    Every input row gives one row, repeated rows included; equal addresses get equal results.
    A null address, or one without ``://``, has an empty host and path and is judged by the
    model. Without labelled rows the model gives 0.5 and allows. A null ``name`` stays null.
    An empty table gives an empty table.
    """
    model = fit_model(labelled, sample_rows)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    source = manifest.select("name", host.alias("host"), path.alias("path"))
    source = source.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = Sparse.of([grams(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)])
            score = model.probability(rows, np.zeros((len(rows), 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "p_block"])

    judged = source.mapInArrow(run, extended(source, source.columns, "p_block double"))
    verdict = F.when(F.col("p_block") > 0.5, "block").otherwise("allow")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return judged.withColumn("verdict", verdict)
