"""Registered queries: rate hypotheses, verdicts, roll-ups over reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions.scalars import rounded
from tonelake.operators import rates, reports, verdicts
from tonelake.plans.inputs import Inputs
from tonelake.plans.registry import query
from tonelake.plans.statements import r
from tonelake.session import spread

# -- rates ---------------------------------------------------------------------

_STD = "[" + ", ".join(f"{v}.0::DOUBLE" for v in rates.STANDARD_RATES) + "]"
_MEAS = "me AS (SELECT o_orderkey AS capture_id, o_totalprice AS bw, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE o_totalprice/(1+o_orderkey%4) END AS rs FROM orders)"


def _measures(inp: Inputs):
    key = F.col("o_orderkey")
    return spread(inp.table("orders").select("o_orderkey", "o_totalprice")).select(
        key.alias("capture_id"),
        F.col("o_totalprice").alias("bandwidth_hz"),
        F.when(key % 9 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / (1 + key % 4)).alias("symbol_rate_hz"),
    )


@query(
    "J8_standard_rates",
    f"WITH {_MEAS} SELECT capture_id, s::DOUBLE AS rate_hz FROM me, (SELECT unnest({_STD}) AS s) WHERE s BETWEEN 2*bw AND 6*bw",
)
def j8(inp: Inputs):
    return _measures(inp).select(
        "capture_id",
        F.explode(rates.standard_rates_between(2.0 * F.col("bandwidth_hz"), 6.0 * F.col("bandwidth_hz"))).alias("rate_hz"),
    )


_CAND = f"""{_MEAS},
en AS (SELECT capture_id, bw, rs, t AS turn, bw*f AS rate, 'Nyquist x' || lbl || ' of occupied bandwidth' AS why FROM me, (VALUES (0, 2.0::DOUBLE, '2'), (1, 2.2::DOUBLE, '2.2'), (2, 2.5::DOUBLE, '2.5'), (3, 4.0::DOUBLE, '4')) v(t, f, lbl)
  UNION ALL SELECT capture_id, bw, rs, 10 + t, rs*m, m::VARCHAR || 'x oversampling of estimated symbol rate' FROM me, (VALUES (0, 2), (1, 4), (2, 8), (3, 16)) v(t, m) WHERE rs > 0
  UNION ALL SELECT capture_id, bw, rs, 20, s::DOUBLE, 'standard capture rate inside the plausible band' FROM me, (SELECT unnest({_STD}) AS s) WHERE s BETWEEN 2*bw AND 6*bw),
mg AS (SELECT capture_id, bw, rs, round_even(rate, 0) AS k, arg_min(rate, turn) AS rate, string_agg(why, '; ' ORDER BY turn) AS rationale FROM en GROUP BY 1, 2, 3, 4),
sc AS (SELECT *, CASE WHEN rate >= 2*bw-1e-9 THEN 0.40 ELSE -0.25 END + 0.25*greatest(0, 1-abs(rate-2.2*bw)/(2.2*bw))
  + CASE WHEN rs > 0 AND rate/rs >= 1.5 THEN CASE WHEN abs(rate/rs-round_even(rate/rs, 0)) <= 0.02 THEN 0.20 WHEN abs(rate/rs-round_even(rate/rs, 0)) <= 0.10 THEN 0.08 ELSE 0 END ELSE 0 END
  + CASE WHEN len(list_filter({_STD}, lambda s: abs(rate-s)/s < 0.01)) > 0 THEN 0.15 ELSE 0 END AS raw FROM mg),
rk AS (SELECT *, round(greatest(0.0, least(1.0, raw)), 4) AS score FROM sc),
tp AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, rate) AS rank FROM rk)"""


@query(
    "A25_rate_candidates",
    f"WITH {_CAND} SELECT capture_id, rank::INT AS rank, {r('rate', 5, 'rate_hz')}, {r('score', 4, 'score')}, rationale FROM tp WHERE rank <= 5",
)
def a25(inp: Inputs):
    return rounded(rates.rate_candidates(_measures(inp)), 5, score=4)


@query(
    "A25_fused_sampling_rate",
    f"""WITH {_CAND},
tt AS (SELECT capture_id, count(*) AS num, max(rate) FILTER (rank = 1) AS best, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2 FROM tp WHERE rank <= 5 GROUP BY 1)
SELECT capture_id, {r('greatest(2*bw, 2*rs, best)', 5, 'sampling_rate_hz')},
  {r('CASE WHEN num >= 3 AND s1-s2 >= 0.15 THEN least(0.85, CASE WHEN rs > 0 THEN 0.7 ELSE 0.5 END + 0.15) ELSE CASE WHEN rs > 0 THEN 0.7 ELSE 0.5 END END', 4, 'confidence')},
  CASE WHEN rs <= 0 THEN 'rests on a single constraint' END AS warning FROM me JOIN tt USING (capture_id)""",
)
def a25_fused(inp: Inputs):
    return rounded(rates.fused_sampling_rate(_measures(inp)), 5, confidence=4)


_PARTS = """pt AS (SELECT o_orderkey AS capture_id, o_totalprice AS bw, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice/(1+o_orderkey%4) END AS env,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice/(1+o_orderkey%4)*(1+(o_orderkey%7)*0.015) END AS cyc, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice*1.2 END AS per FROM orders)"""


@query(
    "A22_fused_symbol_rate",
    f"""WITH {_PARTS},
md AS (SELECT *, CASE WHEN env IS NOT NULL AND cyc IS NOT NULL THEN 2 WHEN env IS NOT NULL OR cyc IS NOT NULL THEN 1 ELSE 0 END AS pts,
  abs(env-cyc) <= 0.05*greatest(env, cyc) AS near FROM pt),
mt AS (SELECT *, CASE WHEN per > 0 THEN 'direct' WHEN pts = 0 THEN 'none' WHEN pts = 1 THEN 'single' WHEN NOT near THEN 'disagreement' ELSE 'corroborated' END AS method FROM md),
rt AS (SELECT *, CASE method WHEN 'direct' THEN per WHEN 'corroborated' THEN cyc ELSE 0 END AS rate FROM mt)
SELECT capture_id, {r('rate', 8, 'symbol_rate_hz')}, CASE method WHEN 'direct' THEN 0.7 WHEN 'corroborated' THEN 0.8 ELSE 0 END::DOUBLE AS confidence, method,
  {r("CASE WHEN method = 'corroborated' THEN (greatest(env,cyc)-least(env,cyc))/greatest(env,cyc) END", 6, 'agreement')},
  concat_ws('; ', CASE WHEN method = 'direct' AND (coalesce(abs(env-per) > 0.05*greatest(env,per), false) OR coalesce(abs(cyc-per) > 0.05*greatest(cyc,per), false)) THEN 'detectors disagree with the measured period' END,
    CASE WHEN bw > 0 AND rate > bw*1.15 THEN 'rate exceeds the occupied bandwidth' END, CASE WHEN method IN ('none', 'single', 'disagreement') THEN 'not measurable: ' || method END) AS warnings FROM rt""",
)
def a22(inp: Inputs):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    base = price / (1 + key % 4)
    parts = inp.table("orders").select(
        key.alias("capture_id"),
        price.alias("bandwidth_hz"),
        F.when(key % 5 != 0, base).alias("envelope_hz"),
        F.when(key % 6 != 0, base * (1 + (key % 7) * 0.015)).alias("cycle_hz"),
        F.when(key % 11 == 0, price * 1.2).alias("period_hz"),
    )
    return rounded(rates.fuse_symbol_rate(parts).withColumn("warnings", F.array_join("warnings", "; ")), 8, agreement=6)


@query(
    "W7_weighted_median",
    f"""WITH rw AS (SELECT l_orderkey AS capture_id, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
cu AS (SELECT *, sum(w) OVER (PARTITION BY capture_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY capture_id) AS t FROM rw)
SELECT capture_id, {r('min(v)', 2, 'median_price')} FROM cu WHERE c >= 0.5*t GROUP BY 1""",
)
def w7(inp: Inputs):
    rows = (
        inp.table("lineitem")
        .groupBy(F.col("l_orderkey").alias("capture_id"), F.col("l_extendedprice").alias("v"))
        .agg(F.sum("l_quantity").alias("w"))
    )
    return rounded(rates.weighted_median(rows, ["capture_id"], "v", "w", "median_price"), 2)


@query(
    "W8_top_candidates",
    f"WITH {_CAND} SELECT capture_id, rank::INT AS rank, {r('rate', 5, 'rate_hz')} FROM tp WHERE rank <= 3",
)
def w8(inp: Inputs):
    return rounded(rates.rate_candidates(_measures(inp), top_n=3).select("capture_id", "rank", "rate_hz"), 5)


@query(
    "A25_simple_hints",
    """SELECT o_orderkey AS capture_id, round(CASE WHEN bw > 0 THEN bw * 2.2 ELSE 0 END, 6) AS narrow_hz,
  round(CASE WHEN bw > 0 THEN greatest(bw, coalesce(rs, 0)) * 2.2 ELSE 0 END, 6) AS wide_hz
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice::DOUBLE ELSE 0 END AS bw,
  CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice::DOUBLE * (o_orderkey % 4) / 2 END AS rs FROM orders)""",
)
def a25_simple(inp: Inputs):
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    bandwidth = F.when(key % 5 > 0, price).otherwise(F.lit(0.0))
    symbol_rate = F.when(key % 3 > 0, price * (key % 4) / 2)
    return rounded(
        inp.table("orders").select(
            key.alias("capture_id"),
            rates.sampling_rate_hint(bandwidth).alias("narrow_hz"),
            rates.sampling_rate_hint(bandwidth, symbol_rate).alias("wide_hz"),
        )
    )


@query(
    "A23_oversampling",
    """WITH pt AS (SELECT o_orderkey AS capture_id, o_orderkey % 200 AS num, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '2-FSK' ELSE 'QPSK' END AS scheme,
  o_orderkey % 5 AS period, (o_orderkey % 13)/40.0 AS rate FROM orders),
sp AS (SELECT *, CASE WHEN rate > 0 THEN 1/rate END AS s, (scheme IS NULL OR scheme = '2-FSK') AND period > 1 AS byp FROM pt),
re AS (SELECT *, CASE WHEN num < 64 THEN 'capture shorter than 64 samples' WHEN byp THEN 'piecewise-constant instantaneous frequency' WHEN scheme = '2-FSK' THEN 'no piecewise-constant symbol structure to measure'
  WHEN rate <= 0 THEN 'no symbol-rate line above the detection threshold' WHEN round_even(s, 0) < 1 THEN 'below one sample per symbol'
  WHEN abs(s-round_even(s, 0))/round_even(s, 0) > 0.12 THEN 'not an integer number of samples per symbol' ELSE 'cyclostationary symbol-rate line' END AS reason FROM sp)
SELECT capture_id, CASE WHEN reason = 'piecewise-constant instantaneous frequency' THEN period WHEN reason = 'cyclostationary symbol-rate line' THEN round_even(s, 0)::BIGINT END AS sps,
  reason IN ('piecewise-constant instantaneous frequency', 'cyclostationary symbol-rate line') AS found, reason FROM re""",
)
def a23(inp: Inputs):
    key = F.col("o_orderkey")
    parts = inp.table("orders").select(
        key.alias("capture_id"),
        (key % 200).alias("num_samples"),
        F.when(key % 3 == 1, "2-FSK").when(key % 3 == 2, "QPSK").alias("scheme"),
        (key % 5).alias("period"),
        ((key % 13) / 40.0).alias("rate_cycles"),
    )
    return rates.oversampling(parts)


# -- verdicts ------------------------------------------------------------------


@query(
    "P19_route",
    "SELECT l_orderkey AS key, l_linenumber AS line, CASE WHEN l_discount*10 >= 0.8 THEN 'act' WHEN l_discount*10 >= 0.5 THEN 'confirm' ELSE 'escalate' END AS route FROM lineitem",
)
def p19(inp: Inputs):
    return inp.table("lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), verdicts.route(F.col("l_discount") * 10).alias("route")
    )


@query(
    "P20_confidence",
    f"""WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)
SELECT user_id, {r('CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, least(1, (count(*)*max(n)/sum(n)-1)/(count(*)-1))) END', 6, 'confidence')} FROM c GROUP BY 1""",
)
def p20(inp: Inputs):
    shares = (
        inp.table("events")
        .groupBy("user_id", "event_type")
        .agg(F.count("*").cast("double").alias("n"))
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list("n")).alias("probs"))
    )
    return rounded(shares.select("user_id", verdicts.confidence_from_probs(F.col("probs")).alias("confidence")))


@query(
    "P21_quality",
    f"""WITH e AS (SELECT l_orderkey AS key, l_linenumber AS line, l_partkey AS part, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS evm FROM lineitem),
w AS (SELECT *, 1/(1+abs(2.5-evm)/7.5) AS a, 1/(1+abs(10-evm)/7.5) AS b, 1/(1+abs(22.5-evm)/7.5) AS c, 1/(1+abs(45-evm)/7.5) AS d FROM e)
SELECT key, line, part, {r('coalesce((b+2*c+3*d)/(a+b+c+d), 3.0)', 6, 'score')}, {r('CASE WHEN evm IS NULL THEN 0 ELSE greatest(0, least(1, (4*greatest(a,b,c,d)/(a+b+c+d)-1)/3)) END', 6, 'confidence')},
  {r('coalesce(b/(a+b+c+d), 0.25)', 6, 'p_good')}, CASE WHEN evm IS NULL THEN 'not-applicable' ELSE 'evm-levels' END AS method FROM w""",
)
def p21(inp: Inputs):
    evm = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    rows = inp.table("lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), verdicts.quality(evm).alias("v")
    )
    return rounded(rows.select("key", "line", "part", "v.score", "v.confidence", F.col("v.probabilities")["good"].alias("p_good"), "v.method"))


@query(
    "P22_trust",
    f"""WITH s AS (SELECT l_orderkey AS key, l_partkey AS part, l_linenumber AS line, l_quantity/50 AS score, 0.8 + l_tax*2 AS ms, l_returnflag = 'R' AS val FROM lineitem),
d AS (SELECT *, score >= greatest(0.85, ms) AS det FROM s)
SELECT key, part, line, {r('CASE WHEN det THEN 0.99 WHEN score >= 0.85 AND score < ms THEN 0.15 ELSE greatest(0, least(0.49, score*0.5)) END', 6, 'header')},
  CASE WHEN det THEN 'cfar-significant' WHEN score >= 0.85 AND score < ms THEN 'chance-match-below-cfar' ELSE 'raw-score-downweighted' END AS header_method,
  CASE WHEN val THEN 0.99 ELSE 0.01 END::DOUBLE AS decode FROM d""",
)
def p22(inp: Inputs):
    score, floor = F.col("l_quantity") / 50, F.lit(0.8) + F.col("l_tax") * 2
    header = verdicts.header_trust(score >= F.greatest(F.lit(0.85), floor), score, floor)
    valid = F.col("l_returnflag") == "R"
    rows = inp.table("lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
        header.alias("h"), verdicts.decode_trust(valid, valid).alias("d"),
    )
    return rounded(rows.select("key", "part", "line", F.col("h.noul").alias("header"), F.col("h.method").alias("header_method"), F.col("d.noul").alias("decode")))


@query(
    "P23_learned_distribution",
    f"""WITH c AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2),
d AS (SELECT user_id, event_type, k/sum(k) OVER (PARTITION BY user_id) AS p, count(*) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_type) AS rk FROM c),
t AS (SELECT user_id, event_type AS label, p AS mass, m, (user_id % 10)/10.0 AS target FROM d WHERE rk = 1),
q AS (SELECT d.user_id, d.event_type, t.label, t.m, CASE WHEN mass <= target THEN p WHEN d.event_type = label THEN target WHEN mass < 1 THEN p/(1-mass)*(1-target) ELSE (1-target)/(t.m-1) END AS p FROM d JOIN t USING (user_id))
SELECT user_id AS capture_id, any_value(label) AS choice, {r('least(0.9, CASE WHEN any_value(m) < 2 THEN 0 ELSE greatest(0, least(1, (any_value(m)*max(p)/sum(p)-1)/(any_value(m)-1))) END)', 6, 'confidence')},
  {r('max(p) FILTER (event_type = label)', 6, 'peak')}, {r('sum(p)', 6, 'mass')} FROM q GROUP BY 1""",
)
def p23_learned(inp: Inputs):
    """Shares of a user's event types as the distribution of a learned model, with a cap on the top one."""
    counts = inp.table("events").groupBy("user_id", "event_type").agg(F.count("*").alias("k"))
    listed = F.collect_list(F.struct("event_type", "k"))
    each = counts.groupBy("user_id").agg(listed.alias("c"), F.sum("k").alias("total"))
    best = F.array_min(F.transform("c", lambda x: F.struct((-x["k"]).alias("k"), x["event_type"].alias("t"))))["t"]
    state = each.select(
        F.col("user_id").alias("capture_id"),
        best.alias("label"),
        ((F.col("user_id") % 10) / 10.0).alias("label_confidence"),
        F.array().cast("array<string>").alias("alternatives"),
        F.lit(False).alias("detected"), F.lit(0.0).alias("score"), F.lit(1.0).alias("min_score"),
        F.lit(None).cast("double").alias("evm_percent"), F.lit(False).alias("validated"),
        F.map_from_entries(F.transform("c", lambda x: F.struct(x["event_type"], x["k"] / F.col("total")))).alias("distribution"),
    )
    v = verdicts.fan_out(state)
    shares = F.col("modulation.probabilities")
    return rounded(
        v.select(
            "capture_id", F.col("modulation.choice").alias("choice"), F.col("modulation.confidence").alias("confidence"),
            F.element_at(shares, F.col("modulation.choice")).alias("peak"),
            F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, x: a + x).alias("mass"),
        )
    )


@query(
    "P23_verdicts",
    f"""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN ['BPSK', 'QPSK', '16-QAM'][(o_orderkey % 3)::INT+1] END AS label, (o_orderkey % 101)/100.0 AS lc, o_orderstatus = 'F' AS det, (o_orderkey % 7)/6.0 AS score,
  (o_orderkey % 41)*1.5 AS evm, o_orderstatus = 'O' AS val FROM orders),
c AS (SELECT *, least(lc, 0.9) AS pk FROM s),
p AS (SELECT *, CASE WHEN label IS NOT NULL THEN greatest(0, least(1, (4*greatest(pk, (1-pk)/3)/1-1)/3)) END AS conf, CASE WHEN det THEN 0.99 WHEN score >= 0.85 AND score < 0.9 THEN 0.15 ELSE greatest(0, least(0.49, score*0.5)) END AS hn FROM c)
SELECT id AS capture_id, label IS NOT NULL AS available, label AS choice, {r('conf', 6, 'confidence')}, CASE WHEN conf >= 0.8 THEN 'act' WHEN conf >= 0.5 THEN 'confirm' WHEN conf IS NOT NULL THEN 'escalate' END AS modulation_route,
  {r('CASE WHEN label IS NOT NULL THEN hn END', 6, 'header')}, CASE WHEN label IS NULL THEN NULL WHEN hn >= 0.9 THEN 'act' WHEN hn >= 0.5 THEN 'confirm' ELSE 'escalate' END AS header_route,
  CASE WHEN label IS NULL THEN NULL WHEN val THEN 'act' ELSE 'escalate' END AS decode_route FROM p""",
)
def p23(inp: Inputs):
    key = F.col("o_orderkey")
    names = F.array(F.lit("BPSK"), F.lit("QPSK"), F.lit("16-QAM"))
    state = inp.table("orders").select(
        key.alias("capture_id"),
        F.when(key % 10 != 0, F.get(names, (key % 3).cast("int"))).alias("label"),
        ((key % 101) / 100.0).alias("label_confidence"),
        F.array(F.lit("8PSK"), F.lit("64-QAM"), F.lit("2-FSK")).alias("alternatives"),
        (F.col("o_orderstatus") == "F").alias("detected"),
        ((key % 7) / 6.0).alias("score"),
        F.lit(0.9).alias("min_score"),
        ((key % 41) * 1.5).alias("evm_percent"),
        (F.col("o_orderstatus") == "O").alias("validated"),
    )
    v = verdicts.fan_out(state)
    return rounded(
        v.select(
            "capture_id", "available", F.col("modulation.choice").alias("choice"), F.col("modulation.confidence").alias("confidence"),
            F.col("modulation.route").alias("modulation_route"), F.col("header_present.noul").alias("header"),
            F.col("header_present.route").alias("header_route"), F.col("decode_trust.route").alias("decode_route"),
        )
    )


@query(
    "P24_es_n0",
    f"SELECT l_orderkey AS key, l_partkey AS part, l_linenumber AS line, {r('l_quantity + 10*log10(l_linenumber)', 6, 'es_n0_db')} FROM lineitem",
)
def p24(inp: Inputs):
    return rounded(
        inp.table("lineitem").select(
            F.col("l_orderkey").alias("key"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"),
            verdicts.es_n0(F.col("l_quantity"), F.col("l_linenumber")).alias("es_n0_db"),
        )
    )


@query(
    "A46_wide_band_hint",
    """SELECT o_orderkey AS capture_id, CASE WHEN o_totalprice*10 > 1000000 AND (CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 5 END) <= 0 AND (o_orderkey % 5 = 0 OR (o_orderkey % 61) > 30) THEN 'possible spread-spectrum' END AS warning FROM orders""",
)
def a46(inp: Inputs):
    key = F.col("o_orderkey")
    evm = F.when(key % 5 != 0, (key % 61).cast("double"))
    return inp.table("orders").select(
        key.alias("capture_id"),
        verdicts.wide_band_hint(F.col("o_totalprice") * 10, F.when(key % 2 == 0, 0.0).otherwise(5.0), evm).alias("warning"),
    )


# -- roll-ups ------------------------------------------------------------------


@query(
    "A47_batch_rollup",
    """SELECT count(*) AS captures, count(*) FILTER (o_orderstatus = 'F') AS verified,
  sum(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey ELSE 0 END)::BIGINT AS bits, count(*) FILTER (o_orderpriority = '1-URGENT') AS failures FROM orders""",
)
def a47(inp: Inputs):
    key = F.col("o_orderkey")
    rows = inp.table("orders").select(
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("decode_validated"),
        F.when(key % 4 != 0, key.cast("string")).when(key % 8 == 0, "n/a").alias("num_bits"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "failed to load").alias("errors"),
    )
    return reports.batch_rollup(rows)


@query(
    "A48_scorecard",
    f"""SELECT label, {r('avg((label = (CASE WHEN embedding[1] > 0 THEN label ELSE (label+1) % 10 END))::INT)', 6, 'accuracy')}, count(*) AS n, grouping(label)::BIGINT AS level FROM embeddings GROUP BY ROLLUP (label)""",
)
def a48(inp: Inputs):
    guess = F.when(F.get("embedding", F.lit(0)) > 0, F.col("label")).otherwise((F.col("label") + 1) % 10)
    return rounded(reports.scorecard(inp.table("embeddings").select("label", guess.alias("prediction"))))


_TRIALS = "tr AS (SELECT l_returnflag AS mod, l_linestatus AS cell, CASE WHEN l_tax > 0 THEN l_discount END AS ber, l_quantity AS seconds FROM lineitem)"


def _trials(inp: Inputs):
    return inp.table("lineitem").select(
        F.col("l_returnflag").alias("mod"),
        F.col("l_linestatus").alias("cell"),
        F.when(F.col("l_tax") > 0, F.col("l_discount")).alias("ber"),
        F.col("l_quantity").alias("seconds"),
    )


_CELLS = "ce AS (SELECT mod, cell, min(ber) AS ber_min, max(ber) AS ber_max, avg(ber) AS ber_mean, count(*) FILTER (ber IS NULL) AS n_abstained, min(seconds) AS t_min_s, median(seconds) AS t_median_s, max(seconds) AS t_max_s FROM tr GROUP BY 1, 2)"


@query(
    "A49_sweep_cells",
    f"WITH {_TRIALS}, {_CELLS} SELECT mod, cell, ber_min, ber_max, {r('ber_mean', 6, 'ber_mean')}, n_abstained, t_min_s, t_median_s, t_max_s FROM ce",
)
def a49_cells(inp: Inputs):
    return rounded(reports.sweep_cells(_trials(inp)))


@query(
    "A49_sweep_summary",
    f"""WITH {_TRIALS}, {_CELLS},
a AS (SELECT mod, min(ber_min) AS ber_min, max(ber_max) AS ber_max, avg(ber_mean) AS ber_mean, count(*) AS n_cells, sum(n_abstained)::BIGINT AS n_abstained, grouping(mod)::BIGINT AS level FROM ce GROUP BY ROLLUP (mod)),
t AS (SELECT mod, median(t) AS t_median_s, grouping(mod)::BIGINT AS level FROM (SELECT mod, unnest([t_min_s, t_median_s, t_max_s]) AS t FROM ce) GROUP BY ROLLUP (mod))
SELECT a.mod, ber_min, ber_max, {r('ber_mean', 6, 'ber_mean')}, n_cells, n_abstained, t_median_s, a.level FROM a JOIN t ON a.mod IS NOT DISTINCT FROM t.mod AND a.level = t.level""",
)
def a49_summary(inp: Inputs):
    return rounded(reports.sweep_summary(reports.sweep_cells(_trials(inp))))


@query(
    "A50_outcome_tally",
    """SELECT mod, count(*) AS cases, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click,
  count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (value > 100) AS budget_exhausted, grouping(mod)::BIGINT AS level
  FROM (SELECT user_id % 4 AS mod, event_type, value FROM events) GROUP BY ROLLUP (mod)""",
)
def a50(inp: Inputs):
    cases = inp.table("events").select(
        (F.col("user_id") % 4).alias("mod"), F.col("event_type").alias("outcome"), (F.col("value") > 100).alias("budget_exhausted")
    )
    return reports.outcome_tally(cases, ("purchase", "view", "click", "error"))


_GATE = f"""{_TRIALS},
gc AS (SELECT mod, cell, max(ber) AS ber_max, avg(ber) AS ber_mean, count(ber) < count(*) AS abstained, CASE cell WHEN 'F' THEN 0.05 ELSE 0.2 END AS bar FROM tr GROUP BY 1, 2),
ga AS (SELECT *, CASE WHEN ber_max < bar THEN 'PASS' WHEN mod = 'R' AND cell = 'F' THEN 'KNOWN_GAP' ELSE 'FAIL' END AS status FROM gc)"""


def _gate(inp: Inputs):
    spark = inp.spark
    bars = spark.createDataFrame([("F", 0.05), ("O", 0.2)], "cell string, bar double")
    gaps = spark.createDataFrame([("R", "F")], "mod string, cell string")
    return reports.worst_seed_gate(_trials(inp), bars, gaps)


@query(
    "A51_worst_seed_gate",
    f"WITH {_GATE} SELECT mod, cell, ber_max, {r('ber_mean', 6, 'ber_mean')}, abstained, bar::DOUBLE AS bar, status FROM ga",
)
def a51(inp: Inputs):
    return rounded(_gate(inp))


@query(
    "A51_gate_overall",
    f"""WITH {_GATE} SELECT count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'KNOWN_GAP') AS n_known_gap, count(*) FILTER (status = 'FAIL') AS n_fail,
  CASE WHEN bool_and(status <> 'FAIL') THEN 'PASS' ELSE 'FAIL' END AS overall FROM ga""",
)
def a51_overall(inp: Inputs):
    return reports.gate_overall(_gate(inp))


# -- report format -------------------------------------------------------------


def _table_reports(inp: Inputs):
    """Orders in the shape of nested reports."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    ok = F.col("o_orderstatus") == "F"
    return inp.table("orders").select(
        F.struct((F.log10(price) * 3).alias("elapsed_s")).alias("meta"),
        F.struct(
            F.concat(F.lit("cap"), key.cast("string"), F.lit(".iq")).alias("file_name"), F.lit("iq").alias("file_type"),
            F.lit("int16").alias("iq_format_used"), F.lit(100000.0).alias("sample_rate"),
        ).alias("input"),
        F.struct(
            F.col("o_custkey").alias("num_samples"), (price / 7).alias("duration_seconds"), (price / 3).alias("center_frequency_estimate"),
            price.alias("bandwidth_estimate"), F.log10(price).alias("snr_db"), F.lit(0.0).alias("symbol_rate_estimate"),
        ).alias("signal"),
        F.struct(F.lit("BPSK").alias("estimated_type"), ((key % 90) / 97.0).alias("confidence")).alias("modulation"),
        F.struct(F.lit("BPSK").alias("mode"), key.alias("num_bits")).alias("demodulation"),
        F.struct((key % 64).alias("header_offset"), ((key % 32) / 31.0).alias("score")).alias("correlation"),
        F.struct(
            (key * 8).alias("payload_bits"), key.alias("raw_bytes"),
            F.struct(ok.alias("available"), (key % 100).alias("bytes"), F.col("o_orderpriority").alias("text")).alias("decoded"),
            F.struct((key % 6).alias("attempts"), ok.alias("validated")).alias("search"),
        ).alias("payload"),
        F.struct(F.lit("LDPC").alias("candidate")).alias("fec"),
        F.struct(F.lit("Block").alias("candidate")).alias("interleaving"),
        F.array_compact(F.array(F.lit("assumed rate"), F.when(key % 2 == 0, F.lit("no header")))).alias("warnings"),
        F.array_compact(F.array(F.when(key % 50 == 0, F.lit("failed")))).alias("errors"),
    )


@query(
    "P18_summary_row",
    f"""SELECT 'cap' || o_orderkey || '.iq' AS file, 'iq' AS file_type, 'int16' AS iq_format_used, 100000.0::DOUBLE AS sample_rate, o_custkey AS num_samples, {r('o_totalprice/7', 4, 'duration_s')},
  {r('o_totalprice/3', 4, 'center_freq_est')}, {r('o_totalprice', 4, 'bandwidth_est')}, {r('log10(o_totalprice)', 4, 'snr_db')}, 0.0::DOUBLE AS symbol_rate_est, 'BPSK' AS modulation,
  {r('(o_orderkey % 90)/97.0', 4, 'mod_confidence')}, 'BPSK' AS demod_mode, o_orderkey AS num_bits, o_orderkey % 64 AS header_offset, {r('(o_orderkey % 32)/31.0', 4, 'corr_score')},
  o_orderkey*8 AS payload_bits, o_orderkey AS payload_bytes_raw, o_orderkey % 6 AS decode_attempts, CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS decode_validated, 'LDPC' AS fec_candidate, 'Block' AS interleaver,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 100 END AS decoded_bytes, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS decoded_text, {r('log10(o_totalprice)*3', 4, 'elapsed_s')},
  'assumed rate' || CASE WHEN o_orderkey % 2 = 0 THEN '; no header' ELSE '' END AS warnings, CASE WHEN o_orderkey % 50 = 0 THEN 'failed' ELSE '' END AS errors FROM orders""",
)
def p18(inp: Inputs):
    return rounded(reports.summary_rows(_table_reports(inp)), 4)


@query(
    "S14_missing_keys",
    """SELECT o_orderkey AS capture_id, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'fec,interleaving' ELSE 'meta,warnings' END AS missing FROM orders""",
)
def s14(inp: Inputs):
    key = F.col("o_orderkey")
    names = list(reports.REQUIRED_KEYS)

    def doc(without: set[str]):
        return F.to_json(F.struct(*[key.alias(n) for n in names if n not in without]))

    text = F.when(key % 3 == 0, doc(set())).when(key % 3 == 1, doc({"fec", "interleaving"})).otherwise(doc({"meta", "warnings"}))
    return inp.table("orders").select(key.alias("capture_id"), F.array_join(reports.missing_keys(text), ",").alias("missing"))


@query(
    "S11_json_safe",
    f"""SELECT o_orderkey AS capture_id, {r("CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 THEN NULL ELSE o_totalprice END", 2, 'level')}, {r("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1.5 END", 2, 'inner_level')},
  CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END::INT AS kept FROM orders""",
)
def s11(inp: Inputs):
    key = F.col("o_orderkey")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    level = F.when(key % 4 == 0, nan).when(key % 4 == 1, inf).otherwise(F.col("o_totalprice"))
    table = inp.table("orders").select(
        key.alias("capture_id"),
        level.alias("level"),
        F.struct(F.when(key % 3 == 0, nan).otherwise(F.lit(1.5)).alias("level")).alias("inner"),
        F.array(level, F.lit(2.0), F.when(key % 4 == 0, inf).otherwise(F.lit(3.0))).alias("list"),
    )
    text = reports.json_safe(table).select("capture_id", F.to_json(F.struct("level", "inner", "list")).alias("doc"))
    back = text.select("capture_id", F.from_json("doc", "level double, inner struct<level: double>, list array<double>").alias("d"))
    finite = F.filter("d.list", lambda v: v.isNotNull() & (v < 10))
    return rounded(back.select("capture_id", "d.level", F.col("d.inner.level").alias("inner_level"), F.size(finite).alias("kept")), 2)
