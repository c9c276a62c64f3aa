"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Block tables are ingested once and timed as ``ingest_*``; the queries then read them, as
they would read a stored table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from tonelake.operators import bursts, spectrum, stats  # noqa: E402
from tonelake.plans.catalog import load  # noqa: E402
from tonelake.plans.inputs import Inputs  # noqa: E402
from tonelake.sources.series import to_samples  # noqa: E402

RATE = 100_000.0
LINE_BLOCK = 4096

REGISTERED = (
    "A4_burst_region",
    "A6_cumulants_long_series",
    "A8_envelope_stats",
    "A18_squared_line_rate",
    "A31_timing",
    "A25_rate_candidates",
    "A49_sweep_cells",
    "A50_outcome_tally",
    "A51_worst_seed_gate",
    "P16_content_class",
    "J2_sliding_correlation",
    "A37_checksums",
    "A38_crc_scan_free",
    "A41_frame_search_all_hypotheses",
    "A40_code_screen",
    "J5_corroborate_scheme",
    "J9_lagged_bit_errors",
    "J10_resolve_rotation",
    "A24_deinterleave_in_chunks",
    "A20_coherence_profile_all_frames",
    "S15_capture_reports",
    "U2_folder_summary",
)


def make_session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tonelake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def run(df: DataFrame) -> None:
    """Execute the whole plan without moving its rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = make_session()
    spark.sparkContext.setLogLevel("ERROR")
    inp = Inputs(spark, sf_dir)
    queries = load()

    def series(fn):
        return lambda: fn(inp.line_series())

    work = {
        "ingest_events": lambda: inp.event_blocks(),
        "ingest_lineitem": lambda: inp.line_series(),
        # All line items as one long capture: the hot-key case.
        "line_burst": series(lambda b: bursts.burst_regions(to_samples(b))),
        "line_cumulants": series(lambda b: stats.cumulants(to_samples(b))),
        "line_imbalance": series(lambda b: stats.imbalance(to_samples(b))),
        "line_frequency_stats": series(lambda b: stats.frequency_stats(stats.instant_frequency(b, LINE_BLOCK))),
        "line_waterfall": series(lambda b: spectrum.waterfall(b, RATE, 1024, LINE_BLOCK)),
        "line_matched_filter": series(lambda b: spectrum.fir_filter(b, spectrum.rrc_taps(8, 0.35, 8), LINE_BLOCK)),
        "line_envelope_rate": series(
            lambda b: spectrum.envelope_line_rate(b, stats.sizes(b), RATE, 1024, LINE_BLOCK)
        ),
        "line_coherence": series(
            lambda b: spectrum.cycle_rate(spectrum.coherence_profile(b, stats.sizes(b), RATE, 1024, LINE_BLOCK), stats.sizes(b))
        ),
    }
    for name in REGISTERED:
        work[name] = lambda q=queries[name]: q(spark, sf_dir)

    seconds = {}
    for name, build in work.items():
        start = time.time()
        run(build())
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
