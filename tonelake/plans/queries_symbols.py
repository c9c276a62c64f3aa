"""Registered queries: constellations, slicing, tone decisions, sync words."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import bits as B
from tonelake.functions.scalars import rounded
from tonelake.operators import hypotheses, stats, symbols, sync
from tonelake.plans.inputs import VECTOR_SAMPLES, Inputs
from tonelake.plans.queries_series import freq_steps
from tonelake.plans.registry import query
from tonelake.plans.statements import r, sql
from tonelake.session import pin

# -- SQL pieces ----------------------------------------------------------------

PEAK = "{v}p AS (SELECT capture_id, n, i/m AS i, q/m AS q FROM (SELECT *, sqrt(max(i*i+q*q) OVER (PARTITION BY capture_id)) AS m FROM {v}))"
UNIT = "{v}u AS (SELECT capture_id, n, i/m AS i, q/m AS q FROM (SELECT *, sqrt(avg(i*i+q*q) OVER (PARTITION BY capture_id)) AS m FROM {v}))"


def point_rows(schemes=symbols.LINEAR_SCHEMES) -> str:
    """Constellation points by their defining rule: levels row by row, or angles."""
    parts = []
    for s in schemes:
        if s == "BPSK":
            parts.append("SELECT 'BPSK' AS scheme, a AS idx, 2.0*a-1 AS pi, 0.0 AS pq FROM range(2) t(a)")
        elif s == "8PSK":
            parts.append("SELECT '8PSK' AS scheme, a AS idx, cos(2*pi()*a/8) AS pi, sin(2*pi()*a/8) AS pq FROM range(8) t(a)")
        else:
            levels, norm = {"QPSK": (2, 2), "16-QAM": (4, 10), "64-QAM": (8, 42)}[s]
            parts.append(
                f"SELECT '{s}' AS scheme, a*{levels}+b AS idx, (2.0*a-{levels - 1})/sqrt({norm}) AS pi, (2.0*b-{levels - 1})/sqrt({norm}) AS pq FROM range({levels}) t(a), range({levels}) u(b)"
            )
    return "pts AS (" + " UNION ALL ".join(parts) + ")"


def nearest_step(view: str) -> str:
    """``nn``: every sample with its nearest point per scheme, the lowest index on ties."""
    return f"""nn AS (SELECT capture_id, n, i, q, scheme, idx, pi, pq FROM (
   SELECT s.*, p.*, row_number() OVER (PARTITION BY capture_id, n, scheme ORDER BY round((i-pi)*(i-pi)+(q-pq)*(q-pq), 12), idx) AS rk FROM {view} s, pts p) WHERE rk = 1)"""


def slice_steps(view: str) -> list[str]:
    """``bl``: (capture_id, scheme, pos, bit) of the five linear schemes from peak-normalised samples."""
    gray = "list_transform(range(3), lambda j: (xor({p}, {p} >> 1) >> (2-j)) & 1)"
    lev = "list_position(list_transform(range(8), lambda a: abs({x}*sqrt(42)-(2*a-7))), list_min(list_transform(range(8), lambda a: abs({x}*sqrt(42)-(2*a-7))))) - 1"
    return [
        PEAK.format(v=view),
        f"""sl AS (SELECT capture_id, n, 'BPSK' AS scheme, [(i > 0)::BIGINT] AS bits FROM {view}p
   UNION ALL SELECT capture_id, n, 'QPSK', [(i > 0)::BIGINT, (q > 0)::BIGINT] FROM {view}p
   UNION ALL SELECT capture_id, n, '16-QAM', [(i > 0)::BIGINT, (abs(i) <= 0.6)::BIGINT, (q > 0)::BIGINT, (abs(q) <= 0.6)::BIGINT] FROM {view}p
   UNION ALL SELECT capture_id, n, '8PSK', {gray.format(p='sec')} FROM (SELECT *, ((round_even(atan2(q,i)*8/(2*pi()), 0)::BIGINT + 8) % 8) AS sec FROM {view}p)
   UNION ALL SELECT capture_id, n, '64-QAM', {gray.format(p='li')} || {gray.format(p='lq')} FROM (SELECT *, {lev.format(x='i')} AS li, {lev.format(x='q')} AS lq FROM {view}p))""",
        "bl AS (SELECT capture_id, scheme, (n*len(bits)+j)::BIGINT AS pos, bits[j+1]::INT AS bit FROM sl, range(6) t(j) WHERE j < len(bits))",
    ]


def period_steps(view: str) -> list[str]:
    """``per``: recovered tone period per capture (1 = unresolved)."""
    return [
        *freq_steps(view),
        "fa AS (SELECT capture_id, count(*) AS m, avg(f) AS mu, avg(abs(f)) AS scale FROM fq GROUP BY 1)",
        "ac AS (SELECT capture_id, sum((f-mu)*(f1-mu)) AS c1, sum((f-mu)*(f-mu)) AS c0 FROM (SELECT *, lead(f) OVER (PARTITION BY capture_id ORDER BY n) AS f1 FROM fq) JOIN fa USING (capture_id) GROUP BY 1)",
        "ce AS (SELECT capture_id, m, scale, 1/(1-c1/c0) AS c FROM ac JOIN fa USING (capture_id) WHERE m >= 63 AND c0 > 0 AND c1/c0 > 0 AND c1/c0 < 1 AND 1/(1-c1/c0) >= 3)",
        "ca AS (SELECT capture_id, m, scale, unnest(range(greatest(3, floor(c)::BIGINT - greatest(4, ceil(0.06*c)::BIGINT)), ceil(c)::BIGINT + greatest(4, ceil(0.06*c)::BIGINT) + 1)) AS period FROM ce)",
        """dv AS (SELECT capture_id, period, avg(abs(f-md)) AS mad FROM (
   SELECT ca.capture_id, period, f, median(f) OVER (PARTITION BY ca.capture_id, period, n//period) AS md FROM fq JOIN ca USING (capture_id) WHERE n//period < m//period AND m//period >= 4) GROUP BY 1, 2)""",
        "rs AS (SELECT dv.capture_id, dv.period, mad/scale AS residual FROM dv JOIN fa USING (capture_id))",
        "bs AS (SELECT capture_id, min(residual) AS best FROM rs GROUP BY 1)",
        """pr AS (SELECT capture_id, any_value(best) AS best, max(period) FILTER (residual <= best*1.6) AS near, max(period) FILTER (residual = best) AS bp FROM rs JOIN bs USING (capture_id) GROUP BY 1)""",
        "per AS (SELECT fa.capture_id, (CASE WHEN best <= greatest(0.15, 2.0/bp) THEN near ELSE 1 END)::BIGINT AS period, best AS residual FROM fa LEFT JOIN pr USING (capture_id))",
    ]


def tone_steps(view: str) -> list[str]:
    """``ts``: median frequency per symbol of ``per.period`` samples."""
    return [
        *period_steps(view),
        "fx AS (SELECT capture_id, n, f FROM fq UNION ALL SELECT capture_id, max(n)+1, max_by(f, n) FROM fq GROUP BY 1)",
        "ts AS (SELECT fx.capture_id, n//period AS n, median(f) AS f FROM fx JOIN per USING (capture_id) GROUP BY 1, 2, period HAVING count(*) = period)",
        "qs AS (SELECT capture_id, quantile_cont(f, [0.125, 0.375, 0.625, 0.875]) AS z FROM ts GROUP BY 1)",
        """tb AS (SELECT capture_id, '2-FSK' AS scheme, n::BIGINT AS pos, (f > 0)::INT AS bit FROM ts
   UNION ALL SELECT capture_id, '4-FSK', (2*n+j)::BIGINT, ((lab >> (1-j)) & 1)::INT FROM (
     SELECT capture_id, n, (f >= (z[1]+z[2])/2)::BIGINT + (f >= (z[2]+z[3])/2)::BIGINT + (f >= (z[3]+z[4])/2)::BIGINT AS lab FROM ts JOIN qs USING (capture_id)), range(2) t(j))""",
    ]


# -- labels and mapping --------------------------------------------------------

_LABELS = [*symbols.SCHEME_ALIASES, "16_qam", " qpsk ", "OFDM", "am"]


def _label_column():
    picks = F.array(*[F.lit(x) for x in _LABELS])
    return F.get(picks, (F.col("o_orderkey") % len(_LABELS)).cast("int"))


@query(
    "P6_canonical_scheme",
    f"""WITH lb AS (SELECT o_orderkey AS key, [{', '.join(f"'{x}'" for x in _LABELS)}][(o_orderkey % {len(_LABELS)})::INT + 1] AS label FROM orders),
al AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in symbols.SCHEME_ALIASES.items())}) v(alias, scheme))
SELECT key, label, al.scheme AS canonical, coalesce(al.scheme, 'BPSK') AS scheme,
  CASE WHEN al.scheme IS NULL THEN 'Unsupported modulation ''' || upper(label) || '''. Used BPSK fallback.' END AS warning
FROM lb LEFT JOIN al ON trim(replace(upper(label), '_', '-')) = alias""",
)
def p6(inp: Inputs):
    labelled = inp.table("orders").select(F.col("o_orderkey").alias("key"), _label_column().alias("label"))
    scheme, warning = symbols.requested_scheme(F.col("label"))
    return labelled.select(
        "key", "label", symbols.canonical_scheme(F.col("label")).alias("canonical"), scheme.alias("scheme"), warning.alias("warning")
    )


def _mapping_sql() -> str:
    inv = "list_reduce(list_transform(range(6), lambda s: ({v} >> s)), lambda a, b: xor(a, b))"
    parts = [
        "SELECT capture_id, 'BPSK' AS scheme, 2.0*v-1 AS i, 0.0 AS q FROM g WHERE w = 1",
        "SELECT capture_id, 'QPSK', (2.0*(v >> 1)-1)/sqrt(2), (2.0*(v & 1)-1)/sqrt(2) FROM g WHERE w = 2",
        f"SELECT capture_id, '8PSK', cos(2*pi()*{inv.format(v='v')}/8), sin(2*pi()*{inv.format(v='v')}/8) FROM g WHERE w = 3",
        f"SELECT capture_id, '16-QAM', (2.0*{inv.format(v='(v >> 2)')}-3)/sqrt(10), (2.0*{inv.format(v='(v & 3)')}-3)/sqrt(10) FROM g WHERE w = 4",
        f"SELECT capture_id, '64-QAM', (2.0*{inv.format(v='(v >> 3)')}-7)/sqrt(42), (2.0*{inv.format(v='(v & 7)')}-7)/sqrt(42) FROM g WHERE w = 6",
    ]
    return sql(
        "D",
        "ws AS (SELECT capture_id, k, b::BIGINT AS b, coalesce(lead(b::BIGINT) OVER (PARTITION BY capture_id ORDER BY k), 0) AS b2, count(*) OVER (PARTITION BY capture_id) AS nb, [1, 2, 3, 4, 6][(capture_id % 5)::INT + 1] AS w FROM D)",
        "gr AS (SELECT capture_id, w, (((b << 8) + b2) >> (16-w-j)) & ((1 << w) - 1) AS v FROM ws, range(8) t(j) WHERE (8*k+j) % w = 0 AND 8*k+j+w <= 8*nb)",
        "g AS (SELECT capture_id, w, v, count(*) AS num FROM gr GROUP BY 1, 2, 3)",
        "mp AS (" + " UNION ALL ".join(p.replace("FROM g", ", num FROM g") for p in parts) + ")",
        f"SELECT capture_id, scheme, sum(num)::BIGINT AS n_symbols, {r('sum(i*num)/sum(num)', 6, 'mean_i')}, {r('sum(q*num)/sum(num)', 6, 'mean_q')}, {r('sum((i*i+q*q)*num)/sum(num)', 6, 'mean_power')} FROM mp GROUP BY 1, 2",
    )


@query("P10_bits_to_symbols", _mapping_sql())
def p10(inp: Inputs):
    mapped = None
    payloads = inp.payloads()
    for k, scheme in enumerate(symbols.LINEAR_SCHEMES):
        i, q = symbols.label_to_point(scheme, F.col("v"))
        part = B.bit_groups(payloads.where(F.col("capture_id") % 5 == k), symbols.BITS_PER_SYMBOL[scheme]).select(
            "capture_id", F.lit(scheme).alias("scheme"), i.alias("i"), q.alias("q")
        )
        mapped = part if mapped is None else mapped.unionByName(part)
    i, q = F.col("i"), F.col("q")
    return rounded(
        mapped.groupBy("capture_id", "scheme").agg(
            F.count("*").alias("n_symbols"),
            F.avg(i).alias("mean_i"),
            F.avg(q).alias("mean_q"),
            F.avg(i * i + q * q).alias("mean_power"),
        )
    )


# -- slicing -------------------------------------------------------------------


def _slice_query(name: str, scheme: str) -> None:
    @query(name, sql("E", *slice_steps("E"), f"SELECT capture_id, pos, bit FROM bl WHERE scheme = '{scheme}'"))
    def run(inp: Inputs):
        return symbols.slice_linear(inp.vector_samples(), scheme)


for _name, _scheme in (
    ("P11_slice_bpsk", "BPSK"),
    ("P11_slice_qpsk", "QPSK"),
    ("P12_slice_16qam", "16-QAM"),
    ("P13_slice_8psk", "8PSK"),
    ("P13_slice_64qam", "64-QAM"),
):
    _slice_query(_name, _scheme)


def _schemes_by_capture():
    names = F.array(*[F.lit(s) for s in _DISPATCHED])
    return F.get(names, (F.col("capture_id") % len(_DISPATCHED)).cast("int"))


# Two-tone captures put all four quantiles of a 4-tone slicer on ties, so it is not among them.
_DISPATCHED = (*symbols.LINEAR_SCHEMES, "2-FSK")
_NAMES = "[" + ", ".join(f"'{s}'" for s in _DISPATCHED) + "]"


@query(
    "P14_slice_by_scheme",
    sql(
        "TONE",
        *slice_steps("TONE"),
        *tone_steps("TONE"),
        f"lb AS (SELECT DISTINCT capture_id, {_NAMES}[(capture_id % 6)::INT + 1] AS scheme FROM TONE)",
        "al AS (SELECT capture_id, scheme, pos, bit FROM bl UNION ALL SELECT capture_id, scheme, pos, bit FROM tb)",
        """SELECT capture_id, scheme, count(*) AS n_bits, sum(bit)::BIGINT AS ones, sum(bit*(pos % 1009))::BIGINT AS mark, max(pos) AS last_pos
   FROM al JOIN lb USING (capture_id, scheme) GROUP BY 1, 2""",
    ),
)
def p14(inp: Inputs):
    blocks = inp.tone_blocks()
    freqs = stats.instant_frequency(blocks)
    labels = blocks.select("capture_id", _schemes_by_capture().alias("scheme"))
    freqs = pin(freqs)
    sliced = symbols.slice_by_scheme(inp.tone_samples(), freqs, labels, pin(symbols.tone_periods(freqs)))
    # Bits are added up before they meet the labels; a label that comes twice counts twice.
    sums = sliced.groupBy("capture_id").agg(
        F.count("*").alias("n_bits"),
        F.sum("bit").alias("ones"),
        F.sum(F.col("bit") * (F.col("pos") % 1009)).alias("mark"),
        F.max("pos").alias("last_pos"),
    )
    tags = labels.groupBy("capture_id", "scheme").agg(F.count("*").alias("times"))
    times = F.col("times")
    return sums.join(tags, "capture_id").select(
        "capture_id", "scheme", (F.col("n_bits") * times).alias("n_bits"), (F.col("ones") * times).alias("ones"),
        (F.col("mark") * times).alias("mark"), "last_pos",
    )


@query(
    "A26_tone_period",
    sql("TONE", *period_steps("TONE"), f"SELECT capture_id, period, {r('residual', 5, 'residual')} FROM per"),
)
def a26(inp: Inputs):
    return rounded(symbols.tone_periods(stats.instant_frequency(inp.tone_blocks())), 5)


@query(
    "A26_tone_period_no_tones",
    sql("E10", *period_steps("E10"), f"SELECT capture_id, period, {r('residual', 5, 'residual')} FROM per"),
)
def a26_none(inp: Inputs):
    return rounded(symbols.tone_periods(stats.instant_frequency(inp.label_blocks(), VECTOR_SAMPLES)), 5)


def _tone_bits(inp: Inputs, order: int):
    freqs = stats.instant_frequency(inp.tone_blocks())
    return symbols.slice_tones(freqs, symbols.tone_periods(freqs), order)


@query("A27_slice_2fsk", sql("TONE", *tone_steps("TONE"), "SELECT capture_id, pos, bit FROM tb WHERE scheme = '2-FSK'"))
def a27_two(inp: Inputs):
    return _tone_bits(inp, 2)


@query(
    "A27_slice_4fsk",
    sql("E10", *tone_steps("E10"), "SELECT capture_id, pos, bit FROM tb WHERE scheme = '4-FSK'"),
)
def a27_four(inp: Inputs):
    freqs = stats.instant_frequency(inp.label_blocks(), VECTOR_SAMPLES)
    return symbols.slice_tones(freqs, symbols.tone_periods(freqs), 4)


@query("A28_tone_levels")
def a28(inp: Inputs):
    freqs = stats.instant_frequency(inp.label_blocks(), VECTOR_SAMPLES)
    return rounded(symbols.tone_levels(symbols.tone_symbols(freqs, symbols.tone_periods(freqs)), 4))


# -- quality -------------------------------------------------------------------


@query(
    "J1_nearest_point",
    sql("E", UNIT.format(v="E"), point_rows(["16-QAM"]), nearest_step("Eu"), f"SELECT capture_id, n, idx::INT AS point, {r('pi', 6, 'pi')}, {r('pq', 6, 'pq')} FROM nn"),
)
def j1(inp: Inputs):
    index, pi, pq = symbols.nearest_point("16-QAM", F.col("i"), F.col("q"))
    return rounded(
        stats.normalise_power(inp.vector_samples()).select(
            "capture_id", "n", index.cast("int").alias("point"), pi.alias("pi"), pq.alias("pq")
        )
    )


_EVM = [
    "ev AS (SELECT capture_id, scheme, count(*) AS n_symbols, sqrt(avg((i-pi)*(i-pi)+(q-pq)*(q-pq))/avg(pi*pi+pq*pq)) AS ratio FROM nn GROUP BY 1, 2)",
    "evm AS (SELECT capture_id, scheme, n_symbols, ratio*100 AS evm_percent, CASE WHEN ratio > 0 THEN -20*log10(ratio) END AS mer_db FROM ev)",
]


@query(
    "A29_evm",
    sql("E", UNIT.format(v="E"), point_rows(), nearest_step("Eu"), *_EVM, f"SELECT capture_id, scheme, n_symbols, {r('evm_percent', 5, 'evm_percent')}, {r('mer_db', 5, 'mer_db')} FROM evm"),
)
def a29(inp: Inputs):
    return rounded(symbols.fit_table(inp.vector_samples()), 5)


@query(
    "A29_evm_oversampled",
    sql(
        "E10",
        "S4 AS (SELECT capture_id, n//4 AS n, avg(i) AS i, avg(q) AS q FROM E10 GROUP BY 1, 2 HAVING count(*) = 4)",
        UNIT.format(v="S4"), point_rows(["QPSK"]), nearest_step("S4u"), *_EVM,
        f"SELECT capture_id, scheme, n_symbols, {r('evm_percent', 5, 'evm_percent')}, {r('mer_db', 5, 'mer_db')} FROM evm",
    ),
)
def a29_sps(inp: Inputs):
    return rounded(symbols.fit_table(inp.label_samples(), ("QPSK",), sps=4), 5)


@query(
    "A30_fit_check",
    sql(
        "E10", UNIT.format(v="E10"), point_rows(), nearest_step("E10u"), *_EVM,
        "lb AS (SELECT DISTINCT capture_id, ['BPSK', 'QPSK', '8PSK', '16-QAM', '64-QAM'][(capture_id % 5)::INT + 1] AS chosen FROM E10)",
        "ot AS (SELECT capture_id, string_agg(scheme, ',' ORDER BY evm_percent) AS context FROM evm JOIN lb USING (capture_id) WHERE scheme <> chosen GROUP BY 1)",
        f"SELECT capture_id, scheme, {r('evm_percent', 5, 'evm_percent')}, evm_percent <= 30 AS fit_ok, CASE WHEN evm_percent > 30 THEN context END AS context FROM evm JOIN lb USING (capture_id) JOIN ot USING (capture_id) WHERE scheme = chosen",
    ),
)
def a30(inp: Inputs):
    names = F.array(*[F.lit(s) for s in symbols.LINEAR_SCHEMES])
    labels = inp.label_blocks().select("capture_id").distinct().withColumn(
        "scheme", F.get(names, (F.col("capture_id") % 5).cast("int"))
    )
    checked = symbols.fit_check(inp.label_samples(), labels)
    return rounded(
        checked.select(
            "capture_id", "scheme", "evm_percent", "fit_ok",
            F.array_join(F.transform("candidates", lambda c: c["scheme"]), ",").alias("context"),
        ),
        5,
    )


@query(
    "A32_carrier_lock",
    sql(
        "E10", UNIT.format(v="E10"), point_rows(["QPSK"]), nearest_step("E10u"),
        "ps AS (SELECT capture_id, 4*(atan2(q,i)-atan2(pq,pi)) AS t FROM nn)",
        f"SELECT capture_id, {r('sqrt(power(avg(cos(t)),2)+power(avg(sin(t)),2))', 6, 'lock')} FROM ps GROUP BY 1",
    ),
)
def a32(inp: Inputs):
    return rounded(symbols.carrier_lock(inp.label_samples(), "QPSK"))


# -- sync words ----------------------------------------------------------------

TEXT_WORD = "0x74686520"  # "the "


def tail_step(length: int) -> str:
    return f"""tl{length} AS (SELECT k, (SELECT sum(factorial({length}::INT)/(factorial(j::INT)*factorial(({length}-j)::INT))) FROM range({length + 1}) u(j) WHERE j >= k)::DOUBLE/power(2.0, {length}) AS tail FROM range(1, {length + 1}) t(k))"""


def _words_values(words) -> str:
    rows = []
    for turn, w in enumerate(words):
        bits = sync.parse_word(w)
        value = "NULL" if bits is None else str(int("".join(map(str, bits)), 2))
        rows.append(f"({turn}, '{w}', {value})")
    return "wd AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(turn, word, val))"


def header_steps(words) -> list[str]:
    """``hd``: best offset and score of every 32-bit word over the whole payload bits."""
    return [
        _words_values(words),
        """wn AS (SELECT capture_id, k, count(*) OVER (PARTITION BY capture_id)*8 AS nbits, (b::BIGINT << 32) + (coalesce(lead(b,1) OVER o, 0)::BIGINT << 24) + (coalesce(lead(b,2) OVER o, 0)::BIGINT << 16)
   + (coalesce(lead(b,3) OVER o, 0)::BIGINT << 8) + coalesce(lead(b,4) OVER o, 0)::BIGINT AS win FROM D WINDOW o AS (PARTITION BY capture_id ORDER BY k))""",
        "sc AS (SELECT capture_id, turn, max((32 - bit_count(xor((win >> (8-j)) & 4294967295, val)))*1000000000000 - (8*k+j)) AS top FROM wn, range(8) t(j), wd WHERE val IS NOT NULL AND 8*k+j+32 <= nbits GROUP BY 1, 2)",
        "nb AS (SELECT doc_id AS capture_id, octet_length(encode(text))*8 AS nbits FROM documents)",
        tail_step(32),
        """hd0 AS (SELECT nb.capture_id, wd.turn, word, val, nbits, ceil(top/1000000000000.0)::BIGINT AS matches, (ceil(top/1000000000000.0)*1000000000000 - top)::BIGINT AS offs,
   greatest(nbits-31, 0) AS positions FROM nb CROSS JOIN wd LEFT JOIN sc ON sc.capture_id = nb.capture_id AND sc.turn = wd.turn)""",
        "mm AS (SELECT positions, coalesce((SELECT min(k) FROM tl32 WHERE tail*positions <= 0.01), 32) AS mk FROM (SELECT DISTINCT positions FROM hd0))",
        """hd AS (SELECT capture_id, turn, word AS sync_word, CASE WHEN val IS NOT NULL THEN 32 END AS sync_length, coalesce(offs, -1)::BIGINT AS "offset", coalesce(matches/32.0, 0.0)::DOUBLE AS score,
   CASE WHEN val IS NOT NULL THEN (CASE WHEN hd0.positions <= 0 THEN 32 ELSE mk END)::INT END AS min_matches, hd0.positions::BIGINT AS positions,
   CASE WHEN val IS NULL THEN 'unparseable hex sync word' WHEN nbits < 32 THEN 'bit stream shorter than sync word' END AS error FROM hd0 JOIN mm ON hd0.positions = mm.positions)""",
        "hx AS (SELECT *, min_matches/32.0 AS min_score, coalesce(error IS NULL AND score >= greatest(0.85, min_matches/32.0), false) AS detected FROM hd)",
    ]


@query(
    "J2_sliding_correlation",
    sql("D", *header_steps([TEXT_WORD]), f'SELECT capture_id, "offset", {r("score", 6, "score")} FROM hx'),
)
def j2(inp: Inputs):
    return rounded(sync.find_header(sync.whole_frames(inp.payloads()), TEXT_WORD).select("capture_id", "offset", "score"))


@query(
    "J3_header_detection",
    sql("D", *header_steps([TEXT_WORD]), f'SELECT capture_id, sync_word, sync_length::INT AS sync_length, "offset", {r("score", 6, "score")}, min_matches, {r("min_score", 6, "min_score")}, positions, detected FROM hx'),
)
def j3(inp: Inputs):
    return rounded(sync.find_header(sync.whole_frames(inp.payloads()), TEXT_WORD))


_TRY = (*sync.DISCOVERY_WORDS, TEXT_WORD, "0xZZ")


@query(
    "J4_sync_discovery",
    sql(
        "D",
        *header_steps(_TRY),
        "rk AS (SELECT *, score-min_score AS margin, row_number() OVER (PARTITION BY capture_id ORDER BY detected DESC, error IS NOT NULL, score-min_score DESC, CASE WHEN detected THEN score END DESC NULLS LAST, turn) AS rk, count(*) OVER (PARTITION BY capture_id) AS tried, count(*) FILTER (error IS NOT NULL) OVER (PARTITION BY capture_id) AS failed FROM hx)",
        f"""SELECT capture_id, CASE WHEN detected THEN sync_word END AS sync_word, detected, CASE WHEN error IS NULL THEN "offset" ELSE -1 END AS "offset", {r('CASE WHEN error IS NULL THEN score ELSE 0 END', 6, 'score')},
   {r('CASE WHEN error IS NULL THEN margin ELSE 0 END', 6, 'margin')}, tried::INT AS tried, failed::INT AS failed FROM rk WHERE rk = 1""",
    ),
)
def j4(inp: Inputs):
    found = sync.discover(sync.whole_frames(inp.payloads()), _TRY)
    return rounded(
        found.select(
            "capture_id", "sync_word", "detected", "offset", "score", "margin",
            F.size("tried").alias("tried"),
            F.size(F.filter("tried", lambda t: t["error"].isNotNull())).alias("failed"),
        )
    )


SHORT_WORD = "0x1A"
_SHORT_BITS = sync.parse_word(SHORT_WORD)


def short_header_steps(view: str, key: str) -> list[str]:
    """``sh``: header search for the 8-bit word by an explicit bit join."""
    bits = ", ".join(f"({k}, {b})" for k, b in enumerate(_SHORT_BITS))
    return [
        f"sb AS (SELECT * FROM (VALUES {bits}) v(j, want))",
        f"mt AS (SELECT capture_id, {key}, pos - j AS offs, sum((bit = want)::INT) AS m FROM {view} JOIN sb ON pos >= j GROUP BY 1, 2, 3 HAVING count(*) = 8)",
        f"bm AS (SELECT capture_id, {key}, max(m*1000000 - offs) AS top, count(*) AS positions FROM mt GROUP BY 1, 2)",
        tail_step(8),
        f"""sh AS (SELECT capture_id, {key}, ceil(top/1000000.0)/8.0 AS score, (ceil(top/1000000.0)*1000000 - top)::BIGINT AS "offset",
   ceil(top/1000000.0)/8.0 >= greatest(0.85, coalesce((SELECT min(k) FROM tl8 WHERE tail*positions <= 0.01), 8)/8.0) AS detected FROM bm)""",
    ]


@query(
    "J5_corroborate_scheme",
    sql(
        "E10",
        *slice_steps("E10"),
        *tone_steps("E10"),
        "al AS (SELECT capture_id, scheme, pos, bit FROM bl UNION ALL SELECT capture_id, scheme, pos, bit FROM tb)",
        *short_header_steps("al", "scheme"),
        f"lb AS (SELECT DISTINCT capture_id, ['BPSK', 'QPSK', '8PSK', '16-QAM', '64-QAM', '2-FSK', '4-FSK', 'AM'][(capture_id % 8)::INT + 1] AS own, capture_id % 9 <> 8 AS est FROM E10)",
        f"od AS (SELECT *, list_position([{', '.join(repr(s) for s in sync.FALLBACK_SCHEMES)}], scheme) AS prio FROM sh)",
        "rv AS (SELECT capture_id, own, est, arg_min(scheme, prio) AS cand, arg_min(score, prio) AS score, arg_min(\"offset\", prio) AS offs FROM od JOIN lb USING (capture_id) WHERE detected AND scheme <> own GROUP BY 1, 2, 3)",
        "ow AS (SELECT lb.capture_id, own, est, coalesce(detected, false) AS od, coalesce(score, 0) AS os FROM lb LEFT JOIN sh ON sh.capture_id = lb.capture_id AND scheme = own)",
        "fi AS (SELECT ow.*, cand, rv.score, offs, (ow.est AND NOT od AND os > 0 AND ow.own NOT IN ('AM', 'FM', 'TONE', 'AUDIO') AND cand IS NOT NULL) AS rev FROM ow LEFT JOIN rv USING (capture_id))",
        f"""SELECT capture_id, CASE WHEN rev THEN cand ELSE own END AS scheme, CASE WHEN rev THEN own END AS revised_from, CASE WHEN rev THEN offs END AS "offset",
   {r('CASE WHEN rev THEN score END', 6, 'score')}, CASE WHEN rev THEN 0.8::DOUBLE END AS confidence FROM fi""",
    ),
)
def j5(inp: Inputs):
    freqs = pin(stats.instant_frequency(inp.label_blocks(), VECTOR_SAMPLES))
    periods = pin(symbols.tone_periods(freqs))
    names = F.array(*[F.lit(s) for s in (*symbols.LINEAR_SCHEMES, "2-FSK", "4-FSK", "AM")])
    labels = inp.label_blocks().select("capture_id").distinct().select(
        "capture_id", F.get(names, (F.col("capture_id") % 8).cast("int")).alias("scheme"), (F.col("capture_id") % 9 != 8).alias("estimated")
    )
    return rounded(hypotheses.corroborate(inp.label_blocks(), VECTOR_SAMPLES, freqs, periods, labels, SHORT_WORD))


@query(
    "J9_lagged_bit_errors",
    sql(
        "E10",
        "tx AS (SELECT capture_id, n, 2*(i > 0)::BIGINT + (q > 0)::BIGINT AS lab FROM E10)",
        "rx AS (SELECT capture_id, n+3 AS n, 2*(i*cos(1.7)-q*sin(1.7) > 0)::BIGINT + (i*sin(1.7)+q*cos(1.7) > 0)::BIGINT AS lab FROM E10)",
        # Rotating a quadrant by k quarter turns: 3 -> 1 -> 0 -> 2 -> 3.
        "rt AS (SELECT k, sent, list_element([3, 1, 0, 2], (list_position([3, 1, 0, 2], sent) - 1 + k)::INT % 4 + 1) AS turned FROM range(4) t(k), range(4) u(sent))",
        "er AS (SELECT capture_id, lag, k, sum(bit_count(xor(turned, rx.lab)))/(2.0*count(*)) AS ber FROM tx JOIN rt ON tx.lab = sent, range(-2, 13) l(lag), rx WHERE rx.capture_id = tx.capture_id AND rx.n = tx.n + lag GROUP BY 1, 2, 3)"
        .replace("SELECT capture_id, lag", "SELECT tx.capture_id, lag"),
        f"SELECT capture_id, {r('min(ber)', 6, 'ber')} FROM er GROUP BY 1",
    ),
)
def j9(inp: Inputs):
    i, q = F.col("i"), F.col("q")
    samples = inp.label_samples()
    label = lambda a, b: 2 * (a > 0).cast("int") + (b > 0).cast("int")
    turn = F.lit(1.7)
    tx = samples.select("capture_id", "n", label(i, q).alias("label"))
    rx = samples.select(
        "capture_id",
        (F.col("n") + 3).alias("n"),
        label(i * F.cos(turn) - q * F.sin(turn), i * F.sin(turn) + q * F.cos(turn)).alias("label"),
    )
    return rounded(hypotheses.best_bit_error_rate(tx, rx, "QPSK"))


@query(
    "J10_resolve_rotation",
    sql(
        "E10",
        "ro AS (SELECT capture_id, k AS rotation, n, i*cos(pi()/2*k)-q*sin(pi()/2*k) AS i, i*sin(pi()/2*k)+q*cos(pi()/2*k) AS q FROM E10, range(4) t(k))",
        "al AS (SELECT capture_id, rotation, 2*n AS pos, (i > 0)::INT AS bit FROM ro UNION ALL SELECT capture_id, rotation, 2*n+1, (q > 0)::INT FROM ro)",
        *short_header_steps("al", "rotation"),
        "rk AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY score DESC, rotation) AS rk FROM sh)",
        f'SELECT capture_id, rotation::INT AS rotation, {r("score", 6, "score")}, "offset", detected FROM rk WHERE rk = 1',
    ),
)
def j10(inp: Inputs):
    return rounded(hypotheses.resolve_rotation(inp.label_blocks(), VECTOR_SAMPLES, "QPSK", SHORT_WORD))


@query(
    "A52_error_rate_table",
    sql(
        "E10",
        "pb AS (SELECT capture_id, (i > 0) AS tx, (i*cos(0.3)-q*sin(0.3) > 0) AS rx FROM E10)",
        f"SELECT capture_id AS snr_db, count(*) AS n_bits, {r('avg((tx <> rx)::INT)', 6, 'ber')} FROM pb GROUP BY 1",
    ),
)
def a52(inp: Inputs):
    i, q = F.col("i"), F.col("q")
    pairs = inp.label_samples().select(
        F.col("capture_id").alias("snr_db"), (i > 0).alias("tx"), (i * F.cos(F.lit(0.3)) - q * F.sin(F.lit(0.3)) > 0).alias("rx")
    )
    return rounded(symbols.error_rates(pairs, "snr_db"))
