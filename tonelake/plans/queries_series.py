"""Registered queries: sample series and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions.scalars import rounded
from tonelake.operators import stats
from tonelake.plans.inputs import VECTOR_SAMPLES, Inputs
from tonelake.plans.registry import query
from tonelake.plans.statements import r, sql

RATE = 100_000.0

SIZES = "szs AS (SELECT capture_id, count(*) AS num FROM {v} GROUP BY 1)"


def freq_steps(view: str) -> list[str]:
    """Steps that end in ``fq`` (capture_id, n, f)."""
    return [
        f"ph AS (SELECT capture_id, n, atan2(q, i) AS ph, lead(atan2(q, i)) OVER (PARTITION BY capture_id ORDER BY n) - atan2(q, i) AS d FROM {view})",
        "fq AS (SELECT capture_id, n, CASE WHEN d > pi() THEN d - 2*pi() WHEN d < -pi() THEN d + 2*pi() ELSE d END AS f FROM ph WHERE d IS NOT NULL)",
    ]


@query(
    "P1_kinematics",
    sql("E", f"""SELECT capture_id, n, {r('n/100000.0*1000', 6, 't_ms')}, {r('i', 6, 'i')}, {r('q', 6, 'q')},
  {r('sqrt(i*i+q*q)', 6, 'magnitude')}, {r('i*i+q*q', 6, 'power')}, {r('atan2(q,i)', 6, 'phase')} FROM E"""),
)
def p1(inp: Inputs):
    return rounded(stats.kinematics(inp.vector_samples(), RATE))


@query(
    "P2_decimate",
    sql("V", SIZES.format(v="V"), f"""SELECT capture_id, n, {r('i', 6, 'i')}, {r('q', 6, 'q')}
  FROM V JOIN (SELECT capture_id, ceil(num/300.0)::BIGINT AS step FROM szs) USING (capture_id) WHERE n % step = 0 AND n/step < 300"""),
)
def p2(inp: Inputs):
    return rounded(stats.decimate(inp.event_samples(), stats.sizes(inp.event_blocks()), 300))


@query(
    "P3_correct_offset",
    sql("E", f"""SELECT capture_id, n, {r('i*cos(-w)-q*sin(-w)', 6, 'i')}, {r('i*sin(-w)+q*cos(-w)', 6, 'q')}
  FROM (SELECT *, 2*pi()*1250.0*n/100000.0 AS w FROM E)"""),
)
def p3(inp: Inputs):
    return rounded(stats.correct_offset(inp.vector_samples(), RATE, F.lit(1250.0)))


@query(
    "P4_correct_imbalance",
    sql("E", f"""SELECT capture_id, n, {r('CASE WHEN ok THEN i/(1+g/2) END', 6, 'i')},
  {r('CASE WHEN ok THEN (q-i*sin(radians(4.0)))/(cos(radians(4.0))*(1-g/2)) END', 6, 'q')},
  CASE WHEN ok THEN '' ELSE 'gain zeroes a branch' END AS reason
  FROM (SELECT *, (capture_id % 3)::DOUBLE AS g, capture_id % 3 <> 2 AS ok FROM E)"""),
)
def p4(inp: Inputs):
    return rounded(
        stats.correct_imbalance(inp.vector_samples(), (F.col("capture_id") % 3).cast("double"), F.lit(4.0))
    )


@query(
    "P5_normalise_peak",
    sql("E", f"""SELECT capture_id, n, {r('i/m', 6, 'i')}, {r('q/m', 6, 'q')}
  FROM (SELECT *, sqrt(max(i*i+q*q) OVER (PARTITION BY capture_id)) AS m FROM E)"""),
)
def p5a(inp: Inputs):
    return rounded(stats.normalise_peak(inp.vector_samples()))


@query(
    "P5_normalise_power",
    sql("E10", f"""SELECT capture_id, n, {r('i/m', 6, 'i')}, {r('q/m', 6, 'q')}
  FROM (SELECT *, sqrt(avg(i*i+q*q) OVER (PARTITION BY capture_id)) AS m FROM E10)"""),
)
def p5b(inp: Inputs):
    return rounded(stats.normalise_power(inp.label_samples()))


@query("A1_basics", sql("V", "SELECT capture_id, count(*) AS num_samples, count(*)/100000.0::DOUBLE AS duration_s FROM V GROUP BY 1"))
def a1(inp: Inputs):
    return stats.basics(inp.event_blocks(), RATE)


@query("W1_instant_frequency", sql("E10", *freq_steps("E10"), f"SELECT capture_id, n, {r('f', 6, 'f')} FROM fq"))
def w1(inp: Inputs):
    return rounded(stats.instant_frequency(inp.label_blocks(), VECTOR_SAMPLES))


_UNWRAP = [
    *freq_steps("E10"),
    "un AS (SELECT p.capture_id, p.n, first_value(p.ph) OVER w + coalesce(sum(f) OVER (PARTITION BY p.capture_id ORDER BY p.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM ph p LEFT JOIN fq USING (capture_id, n) WINDOW w AS (PARTITION BY p.capture_id ORDER BY p.n))",
]


@query("W2_unwrapped_phase", sql("E10", *_UNWRAP, f"SELECT capture_id, n, {r('u', 6, 'phase')} FROM un"))
def w2(inp: Inputs):
    return rounded(stats.unwrapped_phase(inp.label_blocks(), VECTOR_SAMPLES))


@query(
    "A17_frequency_offset",
    sql("E10", *_UNWRAP, f"SELECT capture_id, {r('regr_slope(u, n)*100000.0/(2*pi())', 4, 'cfo_hz')} FROM un GROUP BY 1"),
)
def a17(inp: Inputs):
    return rounded(stats.frequency_offset(stats.unwrapped_phase(inp.label_blocks(), VECTOR_SAMPLES), RATE), 4)


def cumulant_steps(view: str) -> list[str]:
    return [
        f"m0 AS (SELECT capture_id, avg(i*i+q*q) AS p FROM {view} GROUP BY 1)",
        f"un0 AS (SELECT capture_id, i/sqrt(p) AS i, q/sqrt(p) AS q FROM {view} JOIN m0 USING (capture_id))",
        """mm AS (SELECT capture_id, avg(i*i-q*q) AS a, avg(2*i*q) AS b, avg(i*i*i*i-6*i*i*q*q+q*q*q*q) AS c, avg(4*i*q*(i*i-q*q)) AS d,
         avg((i*i+q*q)*(i*i-q*q)) AS e, avg((i*i+q*q)*2*i*q) AS f, avg(i*i+q*q) AS m21 FROM un0 GROUP BY 1)""",
        """cu AS (SELECT capture_id, a AS c20_re, b AS c20_im, m21 AS c21, c-3*(a*a-b*b) AS c40_re, d-6*a*b AS c40_im,
         e-(a*a+b*b)-2*m21*m21 AS c42_re, f AS c42_im FROM mm)""",
    ]


_CU = ["c20_re", "c20_im", "c21", "c40_re", "c40_im", "c42_re", "c42_im"]


@query("A6_cumulants", sql("E", *cumulant_steps("E"), f"SELECT capture_id, {', '.join(r(c, 6, c) for c in _CU)} FROM cu"))
def a6(inp: Inputs):
    return rounded(stats.cumulants(inp.vector_samples()))


@query(
    "A6_cumulants_long_series",
    sql("V", *cumulant_steps("V"), f"SELECT capture_id, {', '.join(r(c, 6, c) for c in _CU)} FROM cu"),
)
def a6_long(inp: Inputs):
    return rounded(stats.cumulants(inp.event_samples()))


def frequency_stat_steps(view: str) -> list[str]:
    return [
        *freq_steps(view),
        """fm AS (SELECT capture_id, var_pop(f) AS fvar, min(f) AS lo, max(f) AS hi, quantile_cont(f, 0.99)-quantile_cont(f, 0.01) AS prange, avg(f) AS mu FROM fq GROUP BY 1)""",
        "fk AS (SELECT capture_id, avg(power(f-mu, 4))/any_value(fvar*fvar) AS kurt FROM fq JOIN fm USING (capture_id) WHERE fvar > 1e-18 GROUP BY 1)",
        """fb AS (SELECT capture_id, slot, count(*) AS h FROM (SELECT f.capture_id, CASE WHEN hi > lo THEN least(floor((f-lo)/(hi-lo)*30)::BIGINT, 29) ELSE 15 END AS slot
   FROM fq f JOIN fm USING (capture_id)) GROUP BY 1, 2)""",
        "fs AS (SELECT capture_id, count(*) FILTER (h > 0.2*mx) AS nsig FROM (SELECT *, max(h) OVER (PARTITION BY capture_id) AS mx FROM fb) GROUP BY 1)",
        """ft AS (SELECT capture_id, fvar, coalesce(least(greatest(kurt, 0), 30), 0.0) AS kurtosis, greatest(prange, 0.0) AS prange, nsig
   FROM fm LEFT JOIN fk USING (capture_id) JOIN fs USING (capture_id))""",
    ]


@query(
    "A7_frequency_stats",
    sql("E10", *frequency_stat_steps("E10"), f"SELECT capture_id, {r('fvar', 6, 'fvar')}, {r('kurtosis', 6, 'kurtosis')}, {r('prange', 6, 'prange')}, nsig FROM ft"),
)
def a7(inp: Inputs):
    return rounded(stats.frequency_stats(stats.instant_frequency(inp.label_blocks(), VECTOR_SAMPLES)))


def envelope_stat_steps(view: str) -> list[str]:
    return [
        f"""es AS (SELECT capture_id, stddev_pop(sqrt(p))/avg(sqrt(p)) AS env_norm, 10*log10(max(p)/avg(p)) AS papr_db,
   avg(p*p)/power(avg(p), 2) AS m4m2, avg(p*p*p)/power(avg(p), 3) AS m6m2 FROM (SELECT capture_id, i*i+q*q AS p FROM {view}) GROUP BY 1)"""
    ]


@query(
    "A8_envelope_stats",
    sql("V", *envelope_stat_steps("V"), f"SELECT capture_id, {', '.join(r(c, 5, c) for c in ['env_norm', 'papr_db', 'm4m2', 'm6m2'])} FROM es"),
)
def a8(inp: Inputs):
    return rounded(stats.envelope_stats(inp.event_samples()), 5)


_IMB = [
    "mo AS (SELECT capture_id, count(*) AS num, avg(i*i) AS pi, avg(q*q) AS pq, avg(i*q) AS piq FROM {v} GROUP BY 1)",
    """im AS (SELECT *, (pi-pq)/(pi+pq) AS gain_metric, CASE WHEN pi > 0 AND pq > 0 THEN piq/sqrt(pi*pq) END AS quad_metric,
   CASE WHEN pi > 0 AND pq > 0 THEN 2*(sqrt(pi/pq)-1)/(sqrt(pi/pq)+1) END AS gain_imbalance,
   CASE WHEN pi > 0 AND pq > 0 THEN degrees(asin(greatest(-1.0, least(1.0, piq/pi)))) END AS phase_imbalance_deg FROM mo)""",
    "ims AS (SELECT *, CASE WHEN quad_metric IS NULL THEN abs(gain_metric) ELSE sqrt(gain_metric*gain_metric+quad_metric*quad_metric) END AS magnitude FROM im)",
]


def _imb(view: str) -> list[str]:
    return [_IMB[0].format(v=view), *_IMB[1:]]


@query(
    "A10_imbalance",
    sql("E", *_imb("E"), "SELECT capture_id, " + ", ".join(r(c, 6, c) for c in ["gain_metric", "quad_metric", "magnitude", "gain_imbalance", "phase_imbalance_deg"]) + " FROM ims"),
)
def a10(inp: Inputs):
    return rounded(stats.imbalance(inp.vector_samples()))


@query(
    "A11_imbalance_decision",
    sql(
        "E",
        *_imb("E"),
        "corr AS (SELECT e.capture_id, e.i/(1+gain_imbalance/2) AS i, (e.q-e.i*sin(radians(phase_imbalance_deg)))/(cos(radians(phase_imbalance_deg))*(1-gain_imbalance/2)) AS q FROM E e JOIN ims USING (capture_id))",
        "mo2 AS (SELECT capture_id, avg(i*i) AS a, avg(q*q) AS b, avg(i*q) AS c FROM corr GROUP BY 1)",
        "af AS (SELECT capture_id, sqrt(power((a-b)/(a+b), 2)+power(c/sqrt(a*b), 2)) AS magnitude_after FROM mo2)",
        """de AS (SELECT *, CASE WHEN capture_id % 5 = 0 OR num < 32 THEN 'not estimable for this constellation'
   WHEN magnitude < 0.12 THEN 'estimate below correction threshold'
   WHEN magnitude_after >= magnitude*0.95 THEN 'correction did not materially reduce the metric' ELSE '' END AS reason FROM ims JOIN af USING (capture_id))""",
        f"""SELECT capture_id, reason = '' AS applied, {r('magnitude', 6, 'magnitude')}, {r("CASE WHEN reason='' THEN magnitude_after END", 6, 'magnitude_after')},
   {r("CASE WHEN reason='' THEN gain_imbalance END", 6, 'gain_imbalance')}, {r("CASE WHEN reason='' THEN phase_imbalance_deg END", 6, 'phase_imbalance_deg')}, reason FROM de""",
    ),
)
def a11(inp: Inputs):
    return rounded(stats.imbalance_decision(inp.vector_samples(), F.col("capture_id") % 5 == 0))


@query(
    "A31_timing",
    sql(
        "V",
        "cp AS (SELECT capture_id, n, i*i+q*q - avg(i*i+q*q) OVER (PARTITION BY capture_id) AS p FROM V)",
        "co AS (SELECT capture_id, sum(p*cos(-2*pi()*(n%8)/8)) AS re, sum(p*sin(-2*pi()*(n%8)/8)) AS im, sum(p*p) AS en FROM cp GROUP BY 1)",
        "ta AS (SELECT *, CASE WHEN atan2(im,re) < 0 THEN atan2(im,re)/(2*pi())*8+8 ELSE atan2(im,re)/(2*pi())*8 END AS tau FROM co)",
        f"SELECT capture_id, {r('tau', 6, 'tau')}, {r('CASE WHEN tau > 4 THEN tau-8 ELSE tau END', 6, 'offset')}, {r('sqrt(re*re+im*im)/en*1000', 6, 'coherence')} FROM ta",
    ),
)
def a31(inp: Inputs):
    return rounded(stats.timing(inp.event_samples(), 8).withColumn("coherence", F.col("coherence") * 1000))


