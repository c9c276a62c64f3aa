"""Compare registered queries with their SQL in DuckDB: python tests/check.py SF [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def make_spark(cpus: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(pdf):
    """Rows as sorted tuples of plain values, columns in name order."""
    import math

    import pandas as pd

    cols = sorted(pdf.columns)

    def plain(v):
        if v is pd.NA:
            return None
        if v is None:
            return None
        if isinstance(v, (bytes, bytearray)):
            return bytes(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            if math.isnan(v):
                return None
            return v + 0.0
        return v

    rows = [tuple(plain(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=repr)


def compare(spark_pdf, sql_pdf) -> str:
    a_cols, a = canonical(spark_pdf)
    b_cols, b = canonical(sql_pdf)
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}"
    for col in a_cols:
        ks, kd = spark_pdf[col].dtype.kind, sql_pdf[col].dtype.kind
        if ks != kd and {ks, kd} not in ({"i", "f"}, {"b", "O"}):
            return f"column {col}: {spark_pdf[col].dtype} vs {sql_pdf[col].dtype}"
    return ""


def main() -> int:
    sf = sys.argv[1]
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    from tonelake.plans.catalog import load

    spark = make_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, q in load().items():
        if prefixes and not any(name == p or name.startswith(p + "_") for p in prefixes):
            continue
        t0 = time.time()
        try:
            got = q(spark, sf_dir).toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"rows {name}: {len(got)} rows, {t1 - t0:.2f}s", flush=True)
                continue
            want = con.execute(q.sql).df()
            t2 = time.time()
            problem = compare(got, want)
            status = "FAIL" if problem else "ok  "
            print(f"{status} {name}: {len(got)} rows, spark {t1 - t0:.2f}s, sql {t2 - t1:.2f}s {problem}", flush=True)
            bad += bool(problem)
        except Exception as exc:
            bad += 1
            print(f"ERR  {name}: {str(exc)[:1500]}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
