"""Roll-ups over reports, sweeps and scorecards, and the report record itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.operators.stats import exact_quantiles

# Fixed values of the report format.
REQUIRED_KEYS = (
    "meta", "input", "signal", "modulation", "demodulation", "correlation", "fec", "interleaving", "warnings", "errors",
)
SUMMARY_COLUMNS = (
    "file", "file_type", "iq_format_used", "sample_rate", "num_samples", "duration_s", "center_freq_est", "bandwidth_est",
    "snr_db", "symbol_rate_est", "modulation", "mod_confidence", "demod_mode", "num_bits", "header_offset", "corr_score",
    "payload_bits", "payload_bytes_raw", "decode_attempts", "decode_validated", "fec_candidate", "interleaver",
    "decoded_bytes", "decoded_text", "elapsed_s", "warnings", "errors",
)


def missing_keys(report_json: Column) -> Column:
    """Required top-level keys a report lacks."""
    return F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), F.json_object_keys(report_json))


def _clean(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        bad = F.isnan(value) | (value == float("inf")) | (value == float("-inf"))
        return F.when(~bad, value)
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _clean(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _clean(v, kind.valueType))
    return value


def json_safe(df: DataFrame) -> DataFrame:
    """Every NaN or infinity, at any depth, becomes NULL."""
    return df.select(*[_clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def summary_rows(reports: DataFrame) -> DataFrame:
    """Nested reports to the flat summary row; numbers to four digits, half to even."""

    def r4(c: str) -> Column:
        return F.bround(F.col(c), 4)

    decoded = F.col("payload.decoded.available")
    return reports.select(
        F.element_at(F.split("input.file_name", "/"), -1).alias("file"),
        F.col("input.file_type").alias("file_type"),
        F.col("input.iq_format_used").alias("iq_format_used"),
        F.col("input.sample_rate").alias("sample_rate"),
        F.col("signal.num_samples").alias("num_samples"),
        r4("signal.duration_seconds").alias("duration_s"),
        r4("signal.center_frequency_estimate").alias("center_freq_est"),
        r4("signal.bandwidth_estimate").alias("bandwidth_est"),
        r4("signal.snr_db").alias("snr_db"),
        r4("signal.symbol_rate_estimate").alias("symbol_rate_est"),
        F.col("modulation.estimated_type").alias("modulation"),
        r4("modulation.confidence").alias("mod_confidence"),
        F.col("demodulation.mode").alias("demod_mode"),
        F.col("demodulation.num_bits").alias("num_bits"),
        F.col("correlation.header_offset").alias("header_offset"),
        r4("correlation.score").alias("corr_score"),
        F.col("payload.payload_bits").alias("payload_bits"),
        F.col("payload.raw_bytes").alias("payload_bytes_raw"),
        F.coalesce("payload.search.attempts", F.lit(0)).alias("decode_attempts"),
        F.when(F.col("payload.search.validated"), F.lit("yes")).otherwise(F.lit("no")).alias("decode_validated"),
        F.col("fec.candidate").alias("fec_candidate"),
        F.col("interleaving.candidate").alias("interleaver"),
        F.when(decoded, F.col("payload.decoded.bytes")).alias("decoded_bytes"),
        F.when(decoded, F.col("payload.decoded.text")).alias("decoded_text"),
        r4("meta.elapsed_s").alias("elapsed_s"),
        F.array_join("warnings", "; ").alias("warnings"),
        F.array_join("errors", "; ").alias("errors"),
    )


def batch_rollup(rows: DataFrame) -> DataFrame:
    """Captures, verified payloads, bits and failures over all summary rows.

    ``num_bits`` may be text; what is no integer counts as zero.
    """
    return rows.agg(
        F.count("*").alias("captures"),
        F.count_if(F.col("decode_validated") == "yes").alias("verified"),
        F.coalesce(F.sum(F.expr("try_cast(num_bits AS BIGINT)")), F.lit(0)).alias("bits"),
        F.count_if(F.coalesce(F.length("errors"), F.lit(0)) > 0).alias("failures"),
    )


def scorecard(rows: DataFrame, truth: str = "label", guess: str = "prediction") -> DataFrame:
    """Accuracy and count per class and in total, in one pass (class NULL = total)."""
    hit = (F.col(truth) == F.col(guess)).cast("double")
    return rows.rollup(truth).agg(
        F.avg(F.coalesce(hit, F.lit(0.0))).alias("accuracy"), F.count("*").alias("n"), F.grouping_id().alias("level")
    )


def sweep_cells(trials: DataFrame) -> DataFrame:
    """Trials (mod, cell, ber NULL = abstained, seconds) to one row per cell."""
    sums = trials.groupBy("mod", "cell").agg(
        F.min("ber").alias("ber_min"),
        F.max("ber").alias("ber_max"),
        F.avg("ber").alias("ber_mean"),
        F.count_if(F.col("ber").isNull()).alias("n_abstained"),
        F.min("seconds").alias("t_min_s"),
        F.max("seconds").alias("t_max_s"),
    )
    keyed = trials.select(F.struct("mod", "cell").alias("capture_id"), "seconds")
    middle = exact_quantiles(keyed, "seconds", [0.5]).select("capture_id.mod", "capture_id.cell", F.col("q0").alias("t_median_s"))
    return sums.join(middle, ["mod", "cell"], "left")


def sweep_summary(cells: DataFrame) -> DataFrame:
    """Cells to one row per modulation and one for all (mod NULL)."""
    times = F.array("t_min_s", "t_median_s", "t_max_s")
    per_mod = cells.rollup("mod").agg(
        F.min("ber_min").alias("ber_min"),
        F.max("ber_max").alias("ber_max"),
        F.avg("ber_mean").alias("ber_mean"),
        F.count("*").alias("n_cells"),
        F.sum("n_abstained").alias("n_abstained"),
        F.grouping_id().alias("level"),
    )
    spread = cells.select("mod", F.explode(times).alias("t")).rollup("mod").agg(
        F.median("t").alias("t_median_s"), F.grouping_id().alias("level")
    )
    return per_mod.join(spread, per_mod["mod"].eqNullSafe(spread["mod"]) & (per_mod["level"] == spread["level"])).select(
        per_mod["mod"], "ber_min", "ber_max", "ber_mean", "n_cells", "n_abstained", "t_median_s", per_mod["level"]
    )


def outcome_tally(cases: DataFrame, outcomes: tuple[str, ...] = ("exact", "declined", "WRONG", "error")) -> DataFrame:
    """Outcome counts per modulation and in total (mod NULL)."""
    return cases.rollup("mod").agg(
        F.count("*").alias("cases"),
        *[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in outcomes],
        F.count_if(F.coalesce("budget_exhausted", F.lit(False))).alias("budget_exhausted"),
        F.grouping_id().alias("level"),
    )


def worst_seed_gate(trials: DataFrame, bars: DataFrame, known_gaps: DataFrame, strict: bool = False) -> DataFrame:
    """Every cell passes only if its worst seed stays below the bar.

    ``bars``: (cell, bar); ``known_gaps``: (mod, cell) exceptions that are reported as such.
    """
    cells = trials.groupBy("mod", "cell").agg(
        F.max("ber").alias("ber_max"),
        F.avg("ber").alias("ber_mean"),
        (F.count("ber") < F.count("*")).alias("abstained"),
    )
    gaps = known_gaps.withColumn("gap", F.lit(not strict))
    ok = F.coalesce(F.col("ber_max") < F.col("bar"), F.lit(False))
    return (
        cells.join(bars, "cell")
        .join(gaps, ["mod", "cell"], "left")
        .withColumn(
            "status",
            F.when(ok, F.lit("PASS")).when(F.coalesce("gap", F.lit(False)), F.lit("KNOWN_GAP")).otherwise(F.lit("FAIL")),
        )
        .drop("gap")
    )


def gate_overall(gated: DataFrame) -> DataFrame:
    return gated.agg(
        F.count_if(F.col("status") == "PASS").alias("n_pass"),
        F.count_if(F.col("status") == "KNOWN_GAP").alias("n_known_gap"),
        F.count_if(F.col("status") == "FAIL").alias("n_fail"),
        F.when(F.bool_and(F.col("status") != "FAIL"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("overall"),
    )
