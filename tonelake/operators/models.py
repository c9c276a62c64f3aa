"""Features, the rule ladder, the learned classifier and the final label."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions.scalars import power
from tonelake.operators import spectrum, stats, symbols
from tonelake.session import pin
from tonelake.sources.series import to_blocks

# Fixed values of the method.
FEATURES = (
    "c40_abs", "c42_abs", "c20_abs", "log_fvar", "freq_kurt", "freq_nsig", "env_norm", "papr_db", "m4m2", "m6m2",
    "freq_prange", "psd_snr", "psd_bw_norm",
)
MAX_CONFIDENCE = 0.90
UNKNOWN_BELOW = 0.40
UNCORROBORATED = 0.35
CORROBORATED = 0.80
FOCUS_MIN_SAMPLES = 128
FOCUS_MIN_BURST = 32
HIDDEN = 64
ANALOG = ("AM", "FM", "TONE", "AUDIO")
FSK = ("2-FSK", "4-FSK")


def focus_burst(samples: DataFrame, regions: DataFrame) -> DataFrame:
    """Samples inside the burst, re-numbered from 0; the whole capture where none is usable."""
    usable = (
        F.col("found")
        & (F.col("n_samples") >= FOCUS_MIN_SAMPLES)
        & (F.col("end_sample") - F.col("start_sample") >= FOCUS_MIN_BURST)
    )
    # Stored, so that its size is known: the samples of few captures are not sorted by capture for the join.
    ranges = pin(regions.select(
        "capture_id",
        F.when(usable, F.col("start_sample")).otherwise(F.lit(0)).alias("lo"),
        F.when(usable, F.col("end_sample")).otherwise(F.col("n_samples")).alias("hi"),
    ))
    return (
        samples.join(ranges, "capture_id")
        .where((F.col("n") >= F.col("lo")) & (F.col("n") < F.col("hi")))
        .select("capture_id", (F.col("n") - F.col("lo")).alias("n"), "i", "q")
    )


def frame_length_hint(rows: DataFrame, slack: int = 128) -> DataFrame:
    """Bits past the header that the burst covers, only where shorter than the stream.

    ``rows``: (capture_id, found, end_sample, num_samples, num_bits, detected,
    payload_start).
    """
    end_bits = F.bround(F.try_divide((F.col("end_sample") * F.greatest("num_bits", F.lit(1))).cast("double"), F.col("num_samples")))
    hint = end_bits - F.col("payload_start") + slack
    usable = F.col("found") & F.col("detected") & (end_bits > F.col("payload_start")) & (hint < F.col("num_bits"))
    return rows.select("capture_id", F.when(usable, hint.cast("long")).alias("frame_bits"))


def features(samples: DataFrame, sample_rate: float, block_len: int, nfft: int = spectrum.PSD_NFFT) -> DataFrame:
    """The 13 features of every capture, always finite."""
    blocks = to_blocks(samples, block_len)
    cums = stats.cumulants(samples).select(
        "capture_id",
        F.sqrt(power(F.col("c40_re"), F.col("c40_im"))).alias("c40_abs"),
        F.sqrt(power(F.col("c42_re"), F.col("c42_im"))).alias("c42_abs"),
        F.sqrt(power(F.col("c20_re"), F.col("c20_im"))).alias("c20_abs"),
    )
    freq = stats.frequency_stats(stats.instant_frequency(blocks, block_len)).select(
        "capture_id",
        F.log10(F.col("fvar") + 1e-12).alias("log_fvar"),
        F.col("kurtosis").alias("freq_kurt"),
        F.col("nsig").cast("double").alias("freq_nsig"),
        F.col("prange").alias("freq_prange"),
    )
    shape = spectrum.spectrum_measures(spectrum.psd(samples, sample_rate, nfft)).select(
        "capture_id", F.col("snr_db").alias("psd_snr"), (F.col("bandwidth_hz") / sample_rate).alias("psd_bw_norm")
    )
    joined = cums
    for part in (freq, stats.envelope_stats(samples), shape):
        joined = joined.join(part, "capture_id", "left")
    return finite_features(joined)


def finite_features(joined: DataFrame) -> DataFrame:
    """(capture_id, the 13 features); what is missing, NaN or infinite is 0."""

    def finite(c: str) -> Column:
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.coalesce(F.when(~bad, F.col(c)), F.lit(0.0)).alias(c)

    return joined.select("capture_id", *[finite(c) for c in FEATURES])


def _tone_order(nsig: Column, fvar: Column) -> Column:
    return (
        F.when(fvar < 0.11, F.lit("2-FSK")).when(nsig <= 8, F.lit("4-FSK")).when(nsig >= 16, F.lit("4-FSK")).otherwise(F.lit("2-FSK"))
    )


def classify_rules(rows: DataFrame) -> DataFrame:
    """Rule ladder over features and the recovered tone period; the first match wins."""
    c40, c20 = F.col("c40_abs"), F.col("c20_abs")
    fvar = F.pow(F.lit(10.0), F.col("log_fvar")) - 1e-12
    kurt, env = F.col("freq_kurt"), F.col("env_norm")
    tone = _tone_order(F.col("freq_nsig"), fvar)

    def verdict(label: Column | str, confidence: float) -> Column:
        return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(confidence).alias("confidence"))

    ladder = [
        ((fvar < 1e-9) & (env > 0.2), verdict("AM", 0.70)),
        (fvar < 1e-9, verdict("TONE", 0.90)),
        ((env > 0.45) & (fvar < 1e-6), verdict("AM", 0.70)),
        ((env < 0.12) & (fvar < 0.02) & (F.col("freq_prange") < 0.25), verdict("FM", 0.65)),
        ((c40 < 0.35) & (kurt < 10) & (F.col("period") > 1), verdict(tone, CORROBORATED)),
        ((c40 < 0.25) & (kurt < 8), verdict(tone, UNCORROBORATED)),
        ((c20 > 0.4) | (c40 > 1.5), verdict("BPSK", 0.85)),
        (c40 > 0.70, verdict("QPSK", 0.80)),
        (c40 > 0.60, verdict("16-QAM", 0.65)),
        ((c40 >= 0.30) & (c40 < 0.42), verdict("64-QAM", 0.60)),
        ((c40 >= 0.30) & ((F.col("papr_db") > 6.42) | (F.col("m4m2") > 1.49)), verdict("64-QAM", 0.60)),
        (c40 >= 0.30, verdict("16-QAM", 0.65)),
        (c40 < 0.30, verdict("8PSK", 0.70)),
    ]
    chosen = None
    for condition, result in ladder:
        chosen = F.when(condition, result) if chosen is None else chosen.when(condition, result)
    return rows.select("capture_id", chosen.otherwise(verdict("UNKNOWN", 0.50)).alias("v")).select(
        "capture_id", F.col("v.label").alias("rule_label"), F.col("v.confidence").alias("rule_confidence")
    )


# -- learned classifier -------------------------------------------------------


def train(rows: DataFrame, label: str = "label", iterations: int = 100, seed: int = 7) -> PipelineModel:
    """Standardise, then a perceptron with one hidden layer of 64 units.

    ``rows`` may carry an integer ``weight``; a row then counts that often.
    """
    if "weight" in rows.columns:
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("_copy", "weight")
    classes = rows.select(label).distinct().count()
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep"),
            VectorAssembler(inputCols=list(FEATURES), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            MultilayerPerceptronClassifier(
                featuresCol="_scaled", labelCol="_label", layers=[len(FEATURES), HIDDEN, classes], maxIter=iterations, seed=seed
            ),
        ]
    ).fit(rows)


def classify_learned(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Label, confidence and the next three classes, with the gates on top.

    ``rows`` needs the features and ``period``; tone labels without a recovered period
    are capped, and a period overrules other labels on non-linear signals.
    """
    names = F.array(*[F.lit(v) for v in model.stages[0].labels])
    probs = vector_to_array(F.col("probability"))
    scored = model.transform(rows if "label" in rows.columns else rows.withColumn("label", F.lit("")))
    ranked = F.reverse(
        F.array_sort(F.transform(probs, lambda p, k: F.struct(p.alias("p"), (-k).alias("turn"), F.get(names, k).alias("label"))))
    )
    fvar = F.pow(F.lit(10.0), F.col("log_fvar")) - 1e-12
    top = F.col("ranked")[0]
    capped = F.least(top["p"], F.lit(MAX_CONFIDENCE))
    overruled = ~top["label"].isin(*FSK) & (F.col("period") > 1) & (F.col("c40_abs") < UNCORROBORATED)
    unknown = top["p"] < UNKNOWN_BELOW
    return scored.withColumn("ranked", ranked).select(
        "capture_id",
        F.when(unknown, F.lit("UNKNOWN")).when(overruled, _tone_order(F.col("freq_nsig"), fvar)).otherwise(top["label"]).alias("ml_label"),
        F.when(unknown, F.lit(0.50))
        .when(overruled, F.lit(CORROBORATED))
        .when(top["label"].isin(*FSK) & (F.col("period") <= 1), F.least(capped, F.lit(UNCORROBORATED)))
        .otherwise(capped)
        .alias("ml_confidence"),
        F.transform(F.slice("ranked", 2, 3), lambda x: x["label"]).alias("alternatives"),
        F.map_from_entries(F.transform("ranked", lambda x: F.struct(x["label"], x["p"]))).alias("probabilities"),
    )


# -- last resort and decision -------------------------------------------------


def heuristic(samples: DataFrame, freqs: DataFrame) -> DataFrame:
    """Variance ratios as the last resort."""
    spread = samples.groupBy("capture_id").agg(
        F.var_pop("i").alias("vi"), F.var_pop("q").alias("vq"), F.var_pop(F.sqrt(power(F.col("i"), F.col("q")))).alias("vm")
    )
    moves = freqs.groupBy("capture_id").agg(F.var_pop("f").alias("vf"))
    return last_resort(spread.join(moves, "capture_id", "left"))


def last_resort(spread: DataFrame) -> DataFrame:
    """The last resort's label from the variances ``vi, vq, vm, vf``."""
    top = F.greatest("vi", "vq")
    ratio = F.when(top > 0, F.least("vi", "vq") / top).otherwise(F.lit(1.0))
    return spread.select(
        "capture_id",
        F.when(ratio < 0.5, "BPSK").when(F.col("vm") > 0.04, "16-QAM").when(F.col("vf") < 1.0, "2-FSK").otherwise("QPSK").alias("last_label"),
        F.when(ratio < 0.5, 0.8).when(F.col("vm") > 0.04, 0.6).when(F.col("vf") < 1.0, 0.65).otherwise(0.7).alias("last_confidence"),
    )


def decide(rows: DataFrame) -> DataFrame:
    """Learned label, else rules, else the heuristic; analog labels become a capped placeholder.

    ``rows``: (capture_id, ml_label, ml_confidence, rule_label, rule_confidence,
    last_label, last_confidence), NULL where a classifier did not run.
    """
    def known(c: str) -> Column:
        return F.when(F.col(c) != "UNKNOWN", F.col(c))

    # One classifier answers; UNKNOWN from it falls through to the heuristic.
    first = F.coalesce("ml_label", "rule_label")
    confidence = F.when(F.col("ml_label").isNotNull(), F.col("ml_confidence")).otherwise(F.col("rule_confidence"))
    label = F.when(first != "UNKNOWN", first)
    staged = rows.select(
        "capture_id",
        F.coalesce(label, known("last_label"), F.lit("BPSK")).alias("estimated"),
        F.when(label.isNotNull(), confidence).otherwise(F.coalesce("last_confidence", F.lit(0.5))).alias("confidence"),
    )
    analog = F.col("estimated").isin(*ANALOG)
    return staged.select(
        "capture_id",
        F.when(analog, F.lit("BPSK")).otherwise(F.col("estimated")).alias("label"),
        F.when(analog, F.least("confidence", F.lit(UNCORROBORATED))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(analog, F.col("estimated")).alias("revised_from"),
        F.when(analog, F.concat(F.lit("The capture looks like "), "estimated", F.lit(" rather than a digital modulation"))).alias("warning"),
    )


def classification_rows(samples: DataFrame, focused: DataFrame, sample_rate: float, block_len: int, nfft: int) -> DataFrame:
    """Features of the burst view together with the tone period of the whole capture."""
    blocks = to_blocks(samples, block_len)
    periods = symbols.tone_periods(stats.instant_frequency(blocks, block_len)).select("capture_id", "period")
    return features(focused, sample_rate, block_len, nfft).join(periods, "capture_id", "left").fillna({"period": 1})
