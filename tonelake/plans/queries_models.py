"""Registered queries: burst view, features, classifiers, acquisition, reports."""

from __future__ import annotations

from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from tonelake.functions.scalars import rounded
from tonelake.operators import acquire, bursts, models, reports, stats
from tonelake.plans import capture_report
from tonelake.plans.inputs import VECTOR_SAMPLES, Inputs
from tonelake.plans.queries_bursts import region_steps
from tonelake.plans.queries_series import cumulant_steps, envelope_stat_steps, frequency_stat_steps
from tonelake.plans.queries_spectrum import RATE, head_dft, measure_steps, sized_dft
from tonelake.plans.queries_symbols import period_steps
from tonelake.plans.registry import query
from tonelake.plans.statements import r, sql
from tonelake.session import pin, spread
from tonelake.sources import captures

FEATURE_NFFT = 256


def focus_steps(view: str, window: int) -> list[str]:
    """``FO``: samples of the burst, or of the whole capture where none is usable."""
    return [
        *region_steps(view, window),
        "us AS (SELECT *, coalesce(found AND n_samples >= 128 AND end_sample - start_sample >= 32, false) AS use_it FROM reg)",
        f"FO AS (SELECT v.capture_id, CASE WHEN use_it THEN n - start_sample ELSE n END AS n, i, q FROM {view} v JOIN us USING (capture_id) WHERE NOT use_it OR (n >= start_sample AND n < end_sample))",
    ]


@query("J7_burst_view", sql("V", *focus_steps("V", 4), f"SELECT capture_id, n::BIGINT AS n, {r('i', 6, 'i')}, {r('q', 6, 'q')} FROM FO"))
def j7(inp: Inputs):
    samples = inp.event_samples()
    return rounded(models.focus_burst(samples, bursts.burst_regions(samples, window=4)))


@query(
    "A5_frame_length_hint",
    """WITH x AS (SELECT o_orderkey AS capture_id, o_orderkey % 2 = 0 AS found, (o_orderkey % 997) AS e, 1000 AS ns, 2000 AS nb, o_orderkey % 3 <> 0 AS det, o_orderkey % 500 AS st FROM orders),
y AS (SELECT *, round_even(e*2000.0/1000, 0)::BIGINT AS eb FROM x)
SELECT capture_id, CASE WHEN found AND det AND eb > st AND eb - st + 128 < nb THEN eb - st + 128 END AS frame_bits FROM y""",
)
def a5(inp: Inputs):
    key = F.col("o_orderkey")
    rows = inp.table("orders").select(
        key.alias("capture_id"), (key % 2 == 0).alias("found"), (key % 997).alias("end_sample"), F.lit(1000).alias("num_samples"),
        F.lit(2000).alias("num_bits"), (key % 3 != 0).alias("detected"), (key % 500).alias("payload_start"),
    )
    return models.frame_length_hint(rows)


def feature_steps(view: str) -> list[str]:
    """``fe``: the 13 features of ``view``."""
    return [
        *cumulant_steps(view),
        *frequency_stat_steps(view),
        *envelope_stat_steps(view),
        *head_dft(view, FEATURE_NFFT),
        *measure_steps(),
        f"""fe AS (SELECT cu.capture_id, sqrt(c40_re*c40_re+c40_im*c40_im) AS c40_abs, sqrt(c42_re*c42_re+c42_im*c42_im) AS c42_abs, sqrt(c20_re*c20_re+c20_im*c20_im) AS c20_abs,
   log10(fvar+1e-12) AS log_fvar, kurtosis AS freq_kurt, nsig::DOUBLE AS freq_nsig, env_norm, papr_db, m4m2, m6m2, prange AS freq_prange, snr_db AS psd_snr, bandwidth_hz/{RATE} AS psd_bw_norm
   FROM cu JOIN ft USING (capture_id) JOIN es USING (capture_id) JOIN ms USING (capture_id))""",
    ]


def _feature_rows(inp: Inputs):
    samples = inp.label_samples()
    focused = models.focus_burst(samples, bursts.burst_regions(samples))
    return models.classification_rows(samples, focused, RATE, VECTOR_SAMPLES, FEATURE_NFFT)


@query(
    "A9_features",
    sql("E10", *focus_steps("E10", 64), *feature_steps("FO"), f"SELECT capture_id, {', '.join(r(c, 5, c) for c in models.FEATURES)} FROM fe"),
)
def a9(inp: Inputs):
    samples = inp.label_samples()
    focused = models.focus_burst(samples, bursts.burst_regions(samples))
    return rounded(models.features(focused, RATE, VECTOR_SAMPLES, FEATURE_NFFT), 5)


def _renamed(steps: list[str], suffix: str, names: tuple[str, ...]) -> list[str]:
    """The same steps under other names, so that two views can use them in one statement."""
    import re

    out = []
    for step in steps:
        for name in names:
            step = re.sub(rf"\b{name}\b", name + suffix, step)
        out.append(step)
    return out


_LADDER = """ru AS (SELECT *, power(10, log_fvar) - 1e-12 AS fv FROM fe JOIN (SELECT capture_id, period FROM per_t) USING (capture_id)),
rt AS (SELECT *, CASE WHEN fv < 0.11 THEN '2-FSK' WHEN freq_nsig <= 8 THEN '4-FSK' WHEN freq_nsig >= 16 THEN '4-FSK' ELSE '2-FSK' END AS tone FROM ru),
rl AS (SELECT capture_id, CASE WHEN fv < 1e-9 THEN CASE WHEN env_norm > 0.2 THEN ['AM', '0.7'] ELSE ['TONE', '0.9'] END WHEN env_norm > 0.45 AND fv < 1e-6 THEN ['AM', '0.7']
  WHEN env_norm < 0.12 AND fv < 0.02 AND freq_prange < 0.25 THEN ['FM', '0.65'] WHEN c40_abs < 0.35 AND freq_kurt < 10 AND period > 1 THEN [tone, '0.8'] WHEN c40_abs < 0.25 AND freq_kurt < 8 THEN [tone, '0.35']
  WHEN c20_abs > 0.4 OR c40_abs > 1.5 THEN ['BPSK', '0.85'] WHEN c40_abs > 0.70 THEN ['QPSK', '0.8'] WHEN c40_abs > 0.60 THEN ['16-QAM', '0.65'] WHEN c40_abs >= 0.30 AND c40_abs < 0.42 THEN ['64-QAM', '0.6']
  WHEN c40_abs >= 0.30 AND (papr_db > 6.42 OR m4m2 > 1.49) THEN ['64-QAM', '0.6'] WHEN c40_abs >= 0.30 THEN ['16-QAM', '0.65'] WHEN c40_abs < 0.30 THEN ['8PSK', '0.7'] ELSE ['UNKNOWN', '0.5'] END AS v FROM rt)"""

# The period comes from the whole capture, the features from its burst view.
_RULES = [
    *focus_steps("E10", 64),
    *_renamed(period_steps("E10"), "_t", ("ph", "fq", "fa", "ac", "ce", "ca", "dv", "rs", "bs", "pr", "per")),
    *feature_steps("FO"),
    _LADDER,
]


@query("M1_rule_classifier", sql("E10", *_RULES, "SELECT capture_id, v[1] AS rule_label, v[2]::DOUBLE AS rule_confidence FROM rl"))
def m1(inp: Inputs):
    return models.classify_rules(_feature_rows(inp))


@query(
    "M4_label_decision",
    sql(
        "E10",
        *_RULES,
        "vs AS (SELECT capture_id, var_pop(i) AS vi, var_pop(q) AS vq, var_pop(sqrt(i*i+q*q)) AS vm FROM E10 GROUP BY 1)",
        "vf AS (SELECT capture_id, var_pop(f) AS vf FROM fq_t GROUP BY 1)",
        "hx AS (SELECT capture_id, CASE WHEN least(vi,vq)/greatest(vi,vq) < 0.5 THEN ['BPSK', '0.8'] WHEN vm > 0.04 THEN ['16-QAM', '0.6'] WHEN vf < 1 THEN ['2-FSK', '0.65'] ELSE ['QPSK', '0.7'] END AS h FROM vs JOIN vf USING (capture_id))",
        # Every fourth capture counts as unknown and every fourth as audio, to reach all branches.
        "in4 AS (SELECT capture_id, CASE capture_id % 4 WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'AUDIO' ELSE v[1] END AS lab, v[2]::DOUBLE AS c, h FROM rl JOIN hx USING (capture_id))",
        "es4 AS (SELECT capture_id, CASE WHEN lab = 'UNKNOWN' THEN h[1] ELSE lab END AS lab, CASE WHEN lab = 'UNKNOWN' THEN h[2]::DOUBLE ELSE c END AS c FROM in4)",
        "SELECT capture_id, CASE WHEN lab IN ('AM', 'FM', 'TONE', 'AUDIO') THEN 'BPSK' ELSE lab END AS label, CASE WHEN lab IN ('AM', 'FM', 'TONE', 'AUDIO') THEN least(c, 0.35) ELSE c END::DOUBLE AS confidence, CASE WHEN lab IN ('AM', 'FM', 'TONE', 'AUDIO') THEN lab END AS revised_from FROM es4",
    ),
)
def m4(inp: Inputs):
    ruled = models.classify_rules(_feature_rows(inp))
    last = models.heuristic(inp.label_samples(), stats.instant_frequency(inp.label_blocks(), VECTOR_SAMPLES))
    cid = F.col("capture_id")
    rows = ruled.join(last, "capture_id").select(
        "capture_id",
        F.lit(None).cast("string").alias("ml_label"),
        F.lit(None).cast("double").alias("ml_confidence"),
        F.when(cid % 4 == 0, "UNKNOWN").when(cid % 4 == 1, "AUDIO").otherwise(F.col("rule_label")).alias("rule_label"),
        "rule_confidence", "last_label", "last_confidence",
    )
    return models.decide(rows).drop("warning")


def _vector_features(inp: Inputs):
    """Features of the vector captures with their label as the class."""
    rows = models.features(inp.vector_samples(), RATE, VECTOR_SAMPLES, 32)
    labels = inp.table("embeddings").select(F.col("vec_id").alias("capture_id"), F.col("label").cast("string").alias("label"))
    return rows.join(labels, "capture_id")


@query("M2_learned_classifier")
def m2(inp: Inputs):
    rows = pin(_vector_features(inp).withColumn("period", F.lit(1)))
    model = models.train(rows.select("label", *models.FEATURES), iterations=40)
    return rounded(models.classify_learned(model, rows).select("capture_id", "ml_label", "ml_confidence", F.array_join("alternatives", ",").alias("alternatives")))


@query("M3_train_and_evaluate")
def m3(inp: Inputs):
    rows = pin(_vector_features(inp).withColumn("period", F.lit(1)))
    seen = F.col("capture_id") % 5 != 0  # held-out captures are disjoint from the training ones
    weighted = rows.where(seen).withColumn("weight", F.when(F.col("capture_id") % 2 == 0, 2).otherwise(1))
    model = models.train(weighted.select("label", "weight", *models.FEATURES), iterations=40)
    held = rows.where(~seen)
    accuracy = MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy").evaluate(model.transform(held))
    table = reports.scorecard(
        models.classify_learned(model, held).join(held.select("capture_id", "label"), "capture_id"), guess="ml_label"
    )
    return rounded(table.withColumn("model_accuracy", F.lit(accuracy)))


# -- acquisition ---------------------------------------------------------------

CODE_RATE = 2_048_000.0
PLANTED = (7, 300)


def _code_capture(inp: Inputs):
    """Line items as noise over one planted spreading code."""
    from tonelake.sources.series import to_samples

    rows = to_samples(inp.line_series())
    chips = acquire.code_chips(rows, CODE_RATE, (PLANTED[0],))
    return rows.withColumn("at", F.pmod(F.col("n") - PLANTED[1], F.lit(2048)).cast("int")).join(F.broadcast(chips), "at").select(
        "capture_id", "n", (F.col("chip") * 20 + F.col("q") - 25).alias("i"), F.lit(0.0).alias("q")
    )


@query("A43_code_acquisition")
def a43(inp: Inputs):
    return rounded(acquire.acquire(_code_capture(inp), CODE_RATE))


@query("A44_despread_report")
def a44(inp: Inputs):
    samples = pin(_code_capture(inp))
    acquired = pin(acquire.acquire(samples, CODE_RATE, codes=(3, 7, 11)))
    report = acquire.carrier_report(acquire.despread(samples, acquired, CODE_RATE), acquired)
    return rounded(report.withColumn("prompt_signs", F.array_join("prompt_signs", "")))


_LINE_SQL = f"""WITH ln AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS n, l_quantity AS noise FROM lineitem),
x AS (SELECT n, abs(1.0 + 0.2*cos(n*w) + 0.1*cos(2*n*w) + 0.0004*(noise-25)) AS e FROM ln, (SELECT 2*pi()*{acquire.LINE_RATE_HZ}/200000.0 AS w)),
y AS (SELECT n, count(*) OVER () AS m, (e - avg(e) OVER ()) AS e FROM x),
z AS (SELECT n, m, e*(0.5-0.5*cos(2*pi()*n/(m-1))) AS e FROM y),
bn AS MATERIALIZED (SELECT b, m FROM (SELECT DISTINCT m FROM z), range(0, 400000) t(b) WHERE b*200000.0/m BETWEEN 12900 AND 18500 OR b*200000.0/m BETWEEN 28400 AND 34600),
sp AS (SELECT b, any_value(z.m) AS m, sqrt(power(sum(e*cos(2*pi()*(b*n % z.m)/z.m)), 2) + power(sum(e*sin(2*pi()*(b*n % z.m)/z.m)), 2)) AS mag FROM z, bn GROUP BY b),
fu AS (SELECT b AS fb, mag AS fm, m, greatest(8, round_even(2000/(200000.0/m), 0)) AS half FROM sp WHERE b*200000.0/m BETWEEN {acquire.LINE_RATE_HZ}*0.985 AND {acquire.LINE_RATE_HZ}*1.015 ORDER BY mag DESC, b LIMIT 1),
ha AS (SELECT b AS hb, mag AS hm FROM sp, fu WHERE abs(b-2*fb) <= 2 ORDER BY mag DESC, b LIMIT 1),
md AS (SELECT median(mag) FILTER (abs(b-fb) > 2 AND abs(b-fb) <= half) AS fmed, median(mag) FILTER (abs(b-hb) > 2 AND abs(b-hb) <= half) AS hmed FROM sp, fu, ha),
vd AS (SELECT *, fm/fmed AS prom, hm/hmed AS hprom FROM fu, ha, md)
SELECT 'L' AS capture_id, prom >= 8 AND hprom >= 6 AS found, {r('CASE WHEN prom >= 8 AND hprom >= 6 THEN fb*200000.0/m END', 5, 'line_rate_hz')},
  {r('CASE WHEN prom >= 8 AND hprom >= 6 THEN least(0.8, greatest(0, 10*log10(least(prom, hprom))/25)) ELSE 0 END', 5, 'confidence')}, {r('CASE WHEN prom >= 8 THEN hm/fm ELSE 0 END', 5, 'harmonic_ratio')},
  CASE WHEN prom < 8 THEN 'no line at the video rate' WHEN hprom < 6 THEN 'no 2nd harmonic' ELSE 'envelope line with 2nd harmonic' END AS reason FROM vd"""


@query("A45_line_rate_hint", _LINE_SQL)
def a45(inp: Inputs):
    from tonelake.sources.series import to_samples

    turn = F.col("n") * (2 * 3.141592653589793 * acquire.LINE_RATE_HZ / 200_000.0)
    rows = to_samples(inp.line_series()).select(
        "capture_id", "n", (1.0 + 0.2 * F.cos(turn) + 0.1 * F.cos(2 * turn) + 0.0004 * (F.col("q") - 25)).alias("i"), F.lit(0.0).alias("q")
    )
    return rounded(acquire.line_rate(rows, 200_000.0), 5)


# -- reports -------------------------------------------------------------------

_REPORT = [
    *_RULES,
    *_renamed([*head_dft("E10", FEATURE_NFFT), *measure_steps()], "_w", ("hd", "hw", "hs", "sp", "tp", "ct", "ms")),
    "re0 AS (SELECT capture_id, v[1] AS lab, v[2]::DOUBLE AS c FROM rl)",
]


@query(
    "S15_capture_reports",
    sql(
        "E10",
        *_REPORT,
        f"""SELECT w.capture_id, n_samples AS num_samples, {r(f'n_samples/{RATE}', 4, 'duration_s')}, {r('center_hz', 4, 'center_hz')}, {r('snr_db', 4, 'snr_db')}, {r('bandwidth_hz', 4, 'bandwidth_hz')}, reg.found AS burst_found,
   lab AS label, c AS confidence, (n_samples * CASE lab WHEN 'BPSK' THEN 1 WHEN 'QPSK' THEN 2 WHEN '8PSK' THEN 3 WHEN '16-QAM' THEN 4 WHEN '64-QAM' THEN 6 WHEN '2-FSK' THEN 1 ELSE 2 END)::BIGINT AS num_bits
   FROM (SELECT capture_id, center_hz, snr_db, bandwidth_hz FROM ms_w) w JOIN (SELECT capture_id, found, n_samples FROM reg) reg USING (capture_id) JOIN re0 USING (capture_id)""",
    ),
)
def s15(inp: Inputs):
    full = capture_report.analyse(inp.label_blocks(), RATE, VECTOR_SAMPLES, nfft=FEATURE_NFFT)
    return rounded(
        full.select(
            "capture_id",
            F.col("signal.num_samples").alias("num_samples"),
            F.col("signal.duration_seconds").alias("duration_s"),
            F.col("signal.center_frequency_estimate").alias("center_hz"),
            F.col("signal.snr_db").alias("snr_db"),
            F.col("signal.bandwidth_estimate").alias("bandwidth_hz"),
            F.col("signal.burst.found").alias("burst_found"),
            F.col("modulation.estimated_type").alias("label"),
            F.col("modulation.confidence").alias("confidence"),
            F.col("demodulation.num_bits").alias("num_bits"),
        ),
        4,
    )


#: Smallest frames of the averaged spectra in the folder queries.
LEAST_NFFT = 16


def _document_files(inp: Inputs):
    """Every document as a raw file of int8 pairs; each fifth has a name of unknown kind."""
    table = spread(inp.table("documents").select("doc_id", "text"))
    ends = F.get(F.array(*[F.lit(s) for s in (".iq", ".iq", ".iq", ".iq", ".txt")]), (F.col("doc_id") % 5).cast("int"))
    return captures.gated(
        table.select(
            F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), ends).alias("path"),
            F.octet_length("text").cast("long").alias("length"),
            F.encode("text", "UTF-8").alias("content"),
        )
    ).select(F.col("path").alias("capture_id"), "kind", F.lit("int8").alias("iq_format"), F.lit("little").alias("endian"), "content", "error")


def _folder(inp: Inputs):
    full = capture_report.analyse_files(_document_files(inp), RATE, 1024, nfft=FEATURE_NFFT, averaged=True, least_line_nfft=LEAST_NFFT)
    return rounded(reports.summary_rows(full), 4)


@query("U2_folder_summary")
def u2(inp: Inputs):
    """Every document as a raw file: read, analysed, and summarised, also where it fails."""
    return _folder(inp)


# The samples of the readable files: bytes in pairs, as signed numbers over 128.
_FILES = [
    "OCT AS (SELECT capture_id, k, (CASE WHEN b >= 128 THEN b - 256 ELSE b END)/128.0 AS v FROM D WHERE capture_id % 5 <> 4)",
    "FD AS MATERIALIZED (SELECT a.capture_id, (a.k//2)::BIGINT AS n, a.v::DOUBLE AS i, b.v::DOUBLE AS q FROM OCT a JOIN OCT b ON b.capture_id = a.capture_id AND b.k = a.k + 1 WHERE a.k % 2 = 0)",
]
_AVERAGED = ("pl", "fw", "fs", "sp", "tp", "ct", "ms")


@query(
    "U2_folder_core",
    sql(
        "D",
        *_FILES,
        *[step.replace("E10", "FD") for step in _RULES],
        *_renamed([*sized_dft("FD", FEATURE_NFFT, LEAST_NFFT), *measure_steps()], "_w", _AVERAGED),
        "re0 AS (SELECT capture_id, v[1] AS lab, v[2]::DOUBLE AS c FROM rl)",
        f"""SELECT capture_id || '.iq' AS file, n_samples::BIGINT AS num_samples, round_even(n_samples/10.0, 0)/10000 AS duration_s, {r('center_hz', 4, 'center_freq_est')}, {r('snr_db', 4, 'snr_db')}, {r('bandwidth_hz', 4, 'bandwidth_est')},
   CASE WHEN lab IN ('AM', 'FM', 'TONE', 'AUDIO') THEN 'BPSK' ELSE lab END AS modulation, {r("CASE WHEN lab IN ('AM', 'FM', 'TONE', 'AUDIO') THEN least(c, 0.35) ELSE c END", 4, 'mod_confidence')}, false AS failed
   FROM (SELECT capture_id, n_samples FROM reg) reg LEFT JOIN (SELECT capture_id, center_hz, snr_db, bandwidth_hz FROM ms_w) w USING (capture_id) JOIN re0 USING (capture_id)
   UNION ALL SELECT doc_id || '.txt', 0, NULL, NULL, NULL, NULL, NULL, NULL, true FROM documents WHERE doc_id % 5 = 4""",
    ),
)
def u2_core(inp: Inputs):
    """What the folder summary says of size, spectrum and label of each file, and which files failed."""
    rows = _folder(inp)
    names = ("duration_s", "center_freq_est", "snr_db", "bandwidth_est", "modulation", "mod_confidence")
    size = F.coalesce("num_samples", F.lit(0).cast("long")).alias("num_samples")
    return rows.select("file", size, *names, F.col("num_samples").isNull().alias("failed"))
