"""Registered queries: spectra, waterfalls, rate lines, filters, plot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions.scalars import rounded
from tonelake.operators import spectrum, stats, symbols
from tonelake.plans.inputs import EVENT_BLOCK, VECTOR_SAMPLES, Inputs
from tonelake.plans.registry import query
from tonelake.plans.statements import r, sql

RATE = 100_000.0


def hann_sql(n: str, size: str) -> str:
    return f"(0.5-0.5*cos(2*pi()*({n})/(({size})-1)))"


def head_dft(view: str, nfft: int) -> list[str]:
    """``sp``: periodogram of the first min(nfft, N) samples by its defining sum."""
    return [
        f"hd AS (SELECT capture_id, n, i, q, count(*) OVER (PARTITION BY capture_id) AS m FROM {view} WHERE n < {nfft})",
        f"hw AS (SELECT capture_id, n, m, i*{hann_sql('n', 'm')} AS i, q*{hann_sql('n', 'm')} AS q FROM hd)",
        "hs AS (SELECT capture_id, b, any_value(m) AS m, sum(i*cos(a)-q*sin(a)) AS re, sum(i*sin(a)+q*cos(a)) AS im FROM (SELECT *, -2*pi()*((b-m//2)*n % m)/m AS a FROM hw, range("
        + str(nfft) + ") t(b) WHERE b < m) GROUP BY 1, 2)",
        f"sp AS (SELECT capture_id, b AS bin, (b-m//2)*{RATE}/m AS freq_hz, 10*log10(re*re+im*im+1e-12) AS power_db FROM hs)",
    ]


def frame_dft(view: str, nfft: int, step: int) -> list[str]:
    """``fr``: power of every bin of every full frame, bins centred."""
    return [
        f"sz AS (SELECT capture_id, count(*) AS num FROM {view} GROUP BY 1)",
        f"""fw AS (SELECT s.capture_id, f AS frame_no, n - f*{step} AS k, i*{hann_sql(f'n - f*{step}', str(nfft))} AS i, q*{hann_sql(f'n - f*{step}', str(nfft))} AS q
   FROM (SELECT capture_id, n, i, q, unnest(range(greatest(0, ceil((n-{nfft}+1)/{step}.0)::BIGINT), n//{step} + 1)) AS f FROM {view}) s JOIN sz USING (capture_id) WHERE f*{step} + {nfft} <= num)""",
        f"fs AS (SELECT capture_id, frame_no, b, sum(i*cos(a)-q*sin(a)) AS re, sum(i*sin(a)+q*cos(a)) AS im FROM (SELECT *, -2*pi()*((b-{nfft // 2})*k % {nfft})/{nfft} AS a FROM fw, range({nfft}) t(b)) GROUP BY 1, 2, 3)",
        "fr AS (SELECT capture_id, frame_no, b AS bin, re, im, re*re+im*im AS p FROM fs)",
    ]


@query(
    "A12_psd_short",
    sql("E", *head_dft("E", 32), f"SELECT capture_id, bin::INT AS bin, {r('freq_hz', 6, 'freq_hz')}, {r('power_db', 5, 'power_db')} FROM sp"),
)
def a12(inp: Inputs):
    return rounded(spectrum.psd(inp.vector_samples(), RATE, 32).drop("frame_no"), 5, freq_hz=6)


@query(
    "A12_psd_long",
    sql("E10", *head_dft("E10", 256), f"SELECT capture_id, bin::INT AS bin, {r('freq_hz', 6, 'freq_hz')}, {r('power_db', 5, 'power_db')} FROM sp"),
)
def a12_long(inp: Inputs):
    return rounded(spectrum.psd(inp.label_samples(), RATE, 256).drop("frame_no"), 5, freq_hz=6)


def measure_steps() -> list[str]:
    """``ms``: centre, SNR and bandwidth from ``sp``."""
    return [
        "tp AS (SELECT capture_id, max(power_db) AS top, median(power_db) AS flo FROM sp GROUP BY 1)",
        "ct AS (SELECT capture_id, freq_hz AS center_hz FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY power_db DESC, bin) AS rk FROM sp) WHERE rk = 1)",
        """ms AS (SELECT s.capture_id, any_value(center_hz) AS center_hz, any_value(top-flo) AS snr_db,
   CASE WHEN count(*) FILTER (power_db > flo+10) < 2 THEN 0 ELSE max(freq_hz) FILTER (power_db > flo+10) - min(freq_hz) FILTER (power_db > flo+10) END AS bandwidth_hz
   FROM sp s JOIN tp USING (capture_id) JOIN ct USING (capture_id) GROUP BY 1)""",
    ]


@query(
    "A13_center_and_snr",
    sql("E10", *head_dft("E10", 256), *measure_steps(), f"SELECT capture_id, {r('center_hz', 6, 'center_hz')}, {r('snr_db', 5, 'snr_db')} FROM ms"),
)
def a13(inp: Inputs):
    measures = spectrum.spectrum_measures(spectrum.psd(inp.label_samples(), RATE, 256))
    return rounded(measures.select("capture_id", "center_hz", "snr_db"), 5, center_hz=6)


@query(
    "A14_occupied_bandwidth",
    sql("E", *head_dft("E", 32), *measure_steps(), f"SELECT capture_id, {r('bandwidth_hz', 6, 'bandwidth_hz')} FROM ms"),
)
def a14(inp: Inputs):
    measures = spectrum.spectrum_measures(spectrum.psd(inp.vector_samples(), RATE, 32))
    return rounded(measures.select("capture_id", "bandwidth_hz"))


# Captures of two lengths: vectors by themselves (32 samples) and the vectors of a label in a row.
_MIXED = [
    "MX AS (SELECT 'v' || capture_id AS capture_id, n, i, q FROM E UNION ALL SELECT 'l' || capture_id, n, i, q FROM E10)",
]


def sized_dft(view: str, largest: int, least: int) -> list[str]:
    """``sp``: spectrum averaged over all frames, the frame size halved until two half-overlapping frames fit."""
    sizes, size = [], largest
    while size >= least:
        sizes.append(f"WHEN num >= {size + size // 2} THEN {size}")
        size //= 2
    return [
        f"pl AS (SELECT capture_id, num, CASE {' '.join(sizes)} END AS m FROM (SELECT capture_id, count(*) AS num FROM {view} GROUP BY 1) WHERE num >= {least + least // 2})",
        f"""fw AS (SELECT capture_id, f, m, n - f*(m//2) AS k, i*{hann_sql('n - f*(m//2)', 'm')} AS i, q*{hann_sql('n - f*(m//2)', 'm')} AS q
   FROM (SELECT capture_id, num, m, n, i, q, unnest(range(greatest(0, ceil((n-m+1)/(m//2)::DOUBLE)::BIGINT), n//(m//2) + 1)) AS f FROM {view} JOIN pl USING (capture_id)) WHERE f*(m//2) + m <= num)""",
        f"fs AS (SELECT capture_id, f, b, any_value(m) AS m, sum(i*cos(a)-q*sin(a)) AS re, sum(i*sin(a)+q*cos(a)) AS im FROM (SELECT *, -2*pi()*((b-m//2)*k % m)/m AS a FROM fw, range({largest}) t(b) WHERE b < m) GROUP BY 1, 2, 3)",
        f"sp AS (SELECT capture_id, b AS bin, (b-any_value(m)//2)*{RATE}/any_value(m) AS freq_hz, 10*log10(avg(re*re+im*im)+1e-12) AS power_db FROM fs GROUP BY 1, 2)",
    ]


def _mixed_blocks(inp: Inputs):
    short, long = inp.vector_blocks(), inp.label_blocks()
    return short.withColumn("capture_id", F.concat(F.lit("v"), F.col("capture_id").cast("string"))).unionByName(
        long.withColumn("capture_id", F.concat(F.lit("l"), F.col("capture_id").cast("string")))
    )


@query(
    "A13_averaged_spectrum",
    sql(
        "E E10", *_MIXED, *sized_dft("MX", 128, 16), *measure_steps(),
        f"SELECT capture_id, {r('center_hz', 6, 'center_hz')}, {r('snr_db', 5, 'snr_db')}, {r('bandwidth_hz', 6, 'bandwidth_hz')} FROM ms",
    ),
)
def a13_averaged(inp: Inputs):
    blocks = _mixed_blocks(inp)
    averaged = spectrum.averaged_psd(blocks, stats.sizes(blocks), RATE, 128, VECTOR_SAMPLES)
    return rounded(spectrum.spectrum_measures(averaged), 5, center_hz=6, bandwidth_hz=6)


@query(
    "A18_squared_line_all_frames",
    sql(
        "V",
        "mn AS (SELECT capture_id, avg(i*i+q*q) AS mu FROM V GROUP BY 1)",
        "SQ AS (SELECT capture_id, n, i*i+q*q-mu AS i, 0.0 AS q FROM V JOIN mn USING (capture_id))",
        *sized_dft("SQ", 128, 16),
        f"ps AS (SELECT * FROM sp WHERE freq_hz > 0.01*{RATE})",
        "tp AS (SELECT capture_id, max(power_db) AS top, median(power_db) AS flo FROM ps GROUP BY 1)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY power_db DESC, bin) AS rk FROM ps)",
        f"SELECT capture_id, {r('CASE WHEN top >= flo+6 THEN freq_hz ELSE 0 END', 6, 'symbol_rate_hz')}, {r('top-flo', 5, 'margin_db')} FROM rk JOIN tp USING (capture_id) WHERE rk = 1",
    ),
)
def a18_all(inp: Inputs):
    blocks = inp.event_blocks()
    return rounded(spectrum.squared_line_rate_averaged(blocks, stats.sizes(blocks), RATE, 128, EVENT_BLOCK), 5, symbol_rate_hz=6)


@query(
    "W4_frames",
    sql(
        "V",
        "sz AS (SELECT capture_id, count(*) AS num FROM V GROUP BY 1)",
        "fw AS (SELECT s.capture_id, f, i FROM (SELECT capture_id, n, i, unnest(range(greatest(0, ceil((n-100+1)/30.0)::BIGINT), n//30 + 1)) AS f FROM V) s JOIN sz USING (capture_id) WHERE f*30 + 100 <= num)",
        f"SELECT capture_id, f::BIGINT AS frame_no, count(*)::INT AS size, {r('sum(i)', 4, 'total')} FROM fw GROUP BY 1, 2",
    ),
)
def w4(inp: Inputs):
    cut = spectrum.frames(inp.event_blocks(), 100, 30, EVENT_BLOCK)
    return rounded(
        cut.select(
            "capture_id", "frame_no", F.size("i").alias("size"),
            F.aggregate("i", F.lit(0.0), lambda a, x: a + x).alias("total"),
        ),
        4,
    )


_WF = [*frame_dft("E10", 64, 32), "wf AS (SELECT capture_id, frame_no, bin, 10*log10(p+1e-12) AS power_db FROM fr)"]


@query(
    "A15_waterfall",
    sql("E10", *_WF, f"SELECT capture_id, frame_no::BIGINT AS frame_no, bin::INT AS bin, {r(f'(bin-32)*{RATE}/64', 6, 'freq_hz')}, {r('power_db', 5, 'power_db')}, {r(f'frame_no*32/{RATE}', 6, 'time_s')} FROM wf"),
)
def a15(inp: Inputs):
    return rounded(spectrum.waterfall(inp.label_blocks(), RATE, 64, VECTOR_SAMPLES), 5, freq_hz=6, time_s=6)


@query(
    "A16_waterfall_cells",
    sql(
        "E10",
        *_WF,
        "sh AS (SELECT capture_id, max(frame_no)+1 AS nf FROM wf GROUP BY 1)",
        # Cell edges by their definition: floor(c * n / cells).
        "rw AS (SELECT capture_id, frame_no, max(c) AS row FROM (SELECT w.capture_id, frame_no, c FROM (SELECT DISTINCT capture_id, frame_no FROM wf) w JOIN sh USING (capture_id), range(20) t(c) WHERE floor(c*nf/20.0) <= frame_no) GROUP BY 1, 2)",
        "a1 AS (SELECT capture_id, row, bin, avg(power_db) AS v FROM wf JOIN rw USING (capture_id, frame_no) GROUP BY 1, 2, 3)",
        "a2 AS (SELECT capture_id, row, bin//4 AS col, avg(v) AS v FROM a1 GROUP BY 1, 2, 3)",
        "a3 AS (SELECT *, min(v) OVER (PARTITION BY capture_id) AS lo, max(v) OVER (PARTITION BY capture_id) AS hi FROM a2)",
        f"SELECT capture_id, row::BIGINT AS row, col::BIGINT AS col, {r('v', 5, 'mean_db')}, floor(round((v-lo)*(255/(hi-lo)), 9))::INT AS level FROM a3",
    ),
)
def a16(inp: Inputs):
    cells = spectrum.waterfall(inp.label_blocks(), RATE, 64, VECTOR_SAMPLES)
    return rounded(spectrum.bin_down(cells, 20, 16), 5)


@query(
    "A18_squared_line_rate",
    sql(
        "V",
        "mn AS (SELECT capture_id, avg(i*i+q*q) AS mu, count(*) AS num FROM V GROUP BY 1)",
        "SQ AS (SELECT capture_id, n, (i*i+q*q-mu)::FLOAT::DOUBLE AS i, 0.0 AS q FROM V JOIN mn USING (capture_id) WHERE num >= 64)",
        *head_dft("SQ", 512),
        f"ps AS (SELECT * FROM sp WHERE freq_hz > 0.01*{RATE})",
        "tp AS (SELECT capture_id, max(power_db) AS top, median(power_db) AS flo FROM ps GROUP BY 1)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY power_db DESC, bin) AS rk FROM ps)",
        f"SELECT capture_id, {r('CASE WHEN top >= flo+6 THEN freq_hz ELSE 0 END', 6, 'symbol_rate_hz')} FROM rk JOIN tp USING (capture_id) WHERE rk = 1",
    ),
)
def a18(inp: Inputs):
    return rounded(spectrum.squared_line_rate(inp.event_samples(), RATE, 512))


#: Frames that the five older line queries average at most: their statements thin longer captures evenly.
LINE_FRAMES = 64
_THIN = [
    "fc AS (SELECT capture_id, max(frame_no)+1 AS nf FROM fr GROUP BY 1)",
    "kp AS (SELECT DISTINCT capture_id, CASE WHEN nf <= 64 THEN k WHEN k = 63 THEN nf-1 ELSE floor(k*((nf-1)/63.0))::BIGINT END AS frame_no FROM fc, range(64) t(k) WHERE nf > 64 OR k < nf)",
]
_ALL = ["kp AS (SELECT DISTINCT capture_id, frame_no FROM fr)"]


def _welch(kept: list[str]) -> list[str]:
    return [
        "mn AS (SELECT capture_id, avg(i*i+q*q) AS mu FROM E10 GROUP BY 1)",
        "SQ AS (SELECT capture_id, n, i*i+q*q-mu AS i, 0.0 AS q FROM E10 JOIN mn USING (capture_id))",
        *frame_dft("SQ", 128, 64),
        *kept,
        f"wn AS (SELECT sum(power({hann_sql('n', '128')}, 2)) AS e FROM range(128) t(n))",
        f"wb AS (SELECT capture_id, bin-64 AS bin, avg(p)/any_value(e) AS p FROM fr JOIN kp USING (capture_id, frame_no), wn WHERE (bin-64)*{RATE}/128 > 0.002*{RATE} GROUP BY 1, 2)",
    ]


_MEDIAN = [
    "bl AS (SELECT a.capture_id, a.bin, a.p, median(b.p) AS background FROM wb a, range(-15, 16) t(d), wb b WHERE b.capture_id = a.capture_id AND b.bin = least(63, greatest(1, a.bin + d)) GROUP BY 1, 2, 3)",
]


def _median_sql(kept: list[str]) -> str:
    return sql("E10", *_welch(kept), *_MEDIAN, f"SELECT capture_id, bin::BIGINT AS bin, {r('p*1000', 6, 'p')}, {r('background*1000', 6, 'background')} FROM bl")


def _band(inp: Inputs, max_frames: int | None):
    p = F.col("i") * F.col("i") + F.col("q") * F.col("q")
    means = inp.label_samples().groupBy("capture_id").agg(F.avg(p).alias("mean"))
    return spectrum.welch_envelope(inp.label_blocks(), means, 128, VECTOR_SAMPLES, max_frames).where(F.col("bin") > 0)


def _running_median(inp: Inputs, max_frames: int | None = None):
    median = spectrum.running_median(_band(inp, max_frames), "p", "bin")
    return rounded(
        median.select("capture_id", F.col("bin").cast("long").alias("bin"), (F.col("p") * 1000).alias("p"), (F.col("background") * 1000).alias("background"))
    )


@query("W3_running_median", _median_sql(_THIN))
def w3(inp: Inputs):
    return _running_median(inp, LINE_FRAMES)


@query("W3_running_median_all_frames", _median_sql(_ALL))
def w3_all(inp: Inputs):
    return _running_median(inp)


_PEAK = [
    *_MEDIAN,
    "re AS (SELECT *, p-background AS rest, median(p-background) OVER (PARTITION BY capture_id) AS mid FROM bl)",
    "md AS (SELECT *, median(abs(rest-mid)) OVER (PARTITION BY capture_id) AS mad, greatest(rest-mid, 0) AS lift FROM re)",
    "nb AS (SELECT *, lag(lift) OVER o AS lf, lead(lift) OVER o AS rt FROM md WINDOW o AS (PARTITION BY capture_id ORDER BY bin))",
    "pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rest DESC, bin) AS rk FROM nb) WHERE rk = 1)",
    "rf AS (SELECT *, ln(lf+1e-12) AS a, ln(lift+1e-12) AS b, ln(rt+1e-12) AS c FROM pk)",
    "sh AS (SELECT *, CASE WHEN a IS NULL OR c IS NULL OR abs(a-2*b+c) < 1e-12 OR abs(0.5*(a-c)/(a-2*b+c)) > 1 THEN 0 ELSE 0.5*(a-c)/(a-2*b+c) END AS shift, (rest-mid)/(1.4826*mad) AS prom FROM rf)",
]


def _line_sql(kept: list[str]) -> str:
    return sql("E10", *_welch(kept), *_PEAK, f"SELECT capture_id, {r(f'CASE WHEN prom >= 8 THEN (bin+shift)*{RATE}/128 ELSE 0 END', 4, 'symbol_rate_hz')}, {r('prom', 5, 'prominence')}, prom >= 8 AS found FROM sh")


def _line_rate(inp: Inputs, max_frames: int | None = None):
    blocks = inp.label_blocks()
    line = spectrum.envelope_line_rate(blocks, stats.sizes(blocks), RATE, 128, VECTOR_SAMPLES, max_frames=max_frames)
    return rounded(line, 5, symbol_rate_hz=4)


@query("A19_envelope_line_rate", _line_sql(_THIN))
def a19(inp: Inputs):
    return _line_rate(inp, LINE_FRAMES)


@query("A19_envelope_line_rate_all_frames", _line_sql(_ALL))
def a19_all(inp: Inputs):
    return _line_rate(inp)


def _refined_sql(kept: list[str]) -> str:
    return sql("E10", *_welch(kept), *_PEAK, f"SELECT capture_id, bin::BIGINT AS bin, {r('shift', 5, 'shift')} FROM sh")


def _refined_peak(inp: Inputs, max_frames: int | None = None):
    from pyspark.sql import Window

    lifted = spectrum.running_median(_band(inp, max_frames), "p", "bin").withColumn("rest", F.col("p") - F.col("background"))
    mids = lifted.groupBy("capture_id").agg(F.median("rest").alias("mid"))
    order = Window.partitionBy("capture_id").orderBy("bin")
    lift = lifted.join(mids, "capture_id").withColumn("lift", F.greatest(F.col("rest") - F.col("mid"), F.lit(0.0)))
    near = lift.withColumn("left", F.lag("lift").over(order)).withColumn("right", F.lead("lift").over(order))
    peak = near.groupBy("capture_id").agg(
        F.max_by(F.struct("bin", "lift", "left", "right"), F.struct("rest", -F.col("bin"))).alias("k")
    )
    return rounded(
        peak.select(
            "capture_id",
            F.col("k.bin").cast("long").alias("bin"),
            spectrum.refined(F.col("k.left"), F.col("k.lift"), F.col("k.right")).alias("shift"),
        ),
        5,
    )


@query("W5_peak_refinement", _refined_sql(_THIN))
def w5(inp: Inputs):
    return _refined_peak(inp, LINE_FRAMES)


@query("W5_peak_refinement_all_frames", _refined_sql(_ALL))
def w5_all(inp: Inputs):
    return _refined_peak(inp)


# Circular shift by d: a(f) = X(f + d), b(f) = X(f - d); the sums run over kept frames.
_CYCLE = [
    f"wn AS (SELECT sqrt(sum(power({hann_sql('n', '128')}, 2))) AS e FROM range(128) t(n))",
    "xs AS (SELECT capture_id, frame_no, (bin+64) % 128 AS f, re/e AS re, im/e AS im FROM fr JOIN kp USING (capture_id, frame_no), wn)",
    "pw AS (SELECT capture_id, f, avg(re*re+im*im) AS p, count(*) AS k FROM xs GROUP BY 1, 2)",
    """cr AS (SELECT a.capture_id, d, f0, avg(a.re*b.re+a.im*b.im) AS cre, avg(a.im*b.re-a.re*b.im) AS cim FROM range(4, 28) t(d), range(128) u(f0), xs a, xs b
   WHERE a.f = (f0+d) % 128 AND b.f = (f0-d+128) % 128 AND b.capture_id = a.capture_id AND b.frame_no = a.frame_no GROUP BY 1, 2, 3)""",
    """pf AS (SELECT c.capture_id, d, any_value(x.k)*sum((cre*cre+cim*cim)/sqrt(x.p*y.p))/sum(sqrt(x.p*y.p)) AS coherence FROM cr c, pw x, pw y
   WHERE x.capture_id = c.capture_id AND y.capture_id = c.capture_id AND x.f = (f0+d) % 128 AND y.f = (f0-d+128) % 128 GROUP BY 1, 2)""",
]


def _profile(inp: Inputs, max_frames: int | None = None):
    blocks = inp.label_blocks()
    return spectrum.coherence_profile(blocks, stats.sizes(blocks), RATE, 128, VECTOR_SAMPLES, max_frames=max_frames)


def _profile_sql(kept: list[str]) -> str:
    return sql("E10", *frame_dft("E10", 128, 64), *kept, *_CYCLE, f"SELECT capture_id, d::BIGINT AS d, {r(f'2.0*d*{RATE}/128', 6, 'alpha_hz')}, {r('coherence', 6, 'coherence')} FROM pf")


@query("A20_coherence_profile", _profile_sql(_THIN))
def a20(inp: Inputs):
    return rounded(_profile(inp, LINE_FRAMES))


@query("A20_coherence_profile_all_frames", _profile_sql(_ALL))
def a20_all(inp: Inputs):
    return rounded(_profile(inp))


_CYCLE_PICK = [
    *_CYCLE,
    f"al AS (SELECT capture_id, d, 2.0*d*{RATE}/128 AS alpha, coherence AS c, lag(coherence) OVER o AS lf, lead(coherence) OVER o AS rt, median(coherence) OVER (PARTITION BY capture_id) AS mid FROM pf WINDOW o AS (PARTITION BY capture_id ORDER BY d))",
    "am AS (SELECT *, 1.4826*median(abs(c-mid)) OVER (PARTITION BY capture_id) AS sigma, ln(c+1e-12) AS y1, ln(lf+1e-12) AS y0, ln(rt+1e-12) AS y2 FROM al)",
    f"ar AS (SELECT *, alpha + 2.0*{RATE}/128*CASE WHEN y0 IS NULL OR y2 IS NULL OR abs(y0-2*y1+y2) < 1e-12 OR abs(0.5*(y0-y2)/(y0-2*y1+y2)) > 1 THEN 0 ELSE 0.5*(y0-y2)/(y0-2*y1+y2) END AS ref FROM am)",
    "pk AS (SELECT capture_id, c, ref AS rate, sigma, mid, (c-mid)/sigma AS prom FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY c DESC, d) AS rk FROM ar) WHERE rk = 1)",
    "sd AS (SELECT pk.capture_id, v, ar.c, ar.ref, abs(alpha-rate/v) AS gap, row_number() OVER (PARTITION BY pk.capture_id, v ORDER BY abs(alpha-rate/v), d) AS rk, pk.mid AS mid, pk.sigma AS sigma, prom FROM pk JOIN ar USING (capture_id), range(2, 6) t(v))",
    f"sb AS (SELECT capture_id, arg_min(ref, v) AS sub FROM sd WHERE rk = 1 AND gap <= 1.5*2.0*{RATE}/128 AND (c-mid)/sigma >= 0.6*prom GROUP BY 1)",
]


def _cycle_sql(kept: list[str]) -> str:
    return sql(
        "E10",
        *frame_dft("E10", 128, 64),
        *kept,
        *_CYCLE_PICK,
        f"SELECT capture_id, {r('CASE WHEN sigma > 0 AND c >= 1.4 AND prom >= 10 THEN coalesce(sub, rate) ELSE 0 END', 4, 'symbol_rate_hz')}, {r('c', 6, 'coherence')}, sigma > 0 AND c >= 1.4 AND prom >= 10 AS found FROM pk LEFT JOIN sb USING (capture_id)",
    )


def _picked(inp: Inputs, max_frames: int | None = None):
    picked = spectrum.cycle_rate(_profile(inp, max_frames), stats.sizes(inp.label_blocks()))
    return rounded(picked.drop("reason"), 6, symbol_rate_hz=4)


@query("A21_cycle_rate", _cycle_sql(_THIN))
def a21(inp: Inputs):
    return _picked(inp, LINE_FRAMES)


@query("A21_cycle_rate_all_frames", _cycle_sql(_ALL))
def a21_all(inp: Inputs):
    return _picked(inp)


@query(
    "A33_carrier_line",
    sql(
        "E10",
        "un AS (SELECT capture_id, n, i/sqrt(p) AS i, q/sqrt(p) AS q, m FROM (SELECT *, avg(i*i+q*q) OVER (PARTITION BY capture_id) AS p, count(*) OVER (PARTITION BY capture_id) AS m FROM E10))",
        "z AS (SELECT capture_id, n, m, i*i*i*i-6*i*i*q*q+q*q*q*q AS i, 4*i*q*(i*i-q*q) AS q FROM un)",
        f"zw AS (SELECT capture_id, n, m, i*{hann_sql('n', 'm')} AS i, q*{hann_sql('n', 'm')} AS q FROM z)",
        "df AS (SELECT capture_id, b, any_value(m) AS m, sum(i*cos(a)-q*sin(a)) AS re, sum(i*sin(a)+q*cos(a)) AS im FROM (SELECT capture_id, m, i, q, b, -2*pi()*(b*n % m)/m AS a FROM zw, range(-5000, 5001) t(b) WHERE abs(b) <= 0.25*m) GROUP BY 1, 2)",
        "pk AS (SELECT capture_id, b*1.0/m AS cyc FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY re*re+im*im DESC, b) AS rk FROM df) WHERE rk = 1)",
        "ph AS (SELECT z.capture_id, any_value(cyc) AS cyc, sum(i*cos(-2*pi()*cyc*n)-q*sin(-2*pi()*cyc*n)) AS re, sum(i*sin(-2*pi()*cyc*n)+q*cos(-2*pi()*cyc*n)) AS im FROM z JOIN pk USING (capture_id) GROUP BY 1)",
        f"SELECT capture_id, {r('cyc/4', 8, 'cycles_per_sample')}, {r('atan2(im,re)/4', 6, 'phase')} FROM ph",
    ),
)
def a33(inp: Inputs):
    return rounded(spectrum.carrier_line(inp.label_samples(), 4), 6, cycles_per_sample=8)


_TAPS = spectrum.rrc_taps(4, 0.35, 8)


@query(
    "A34_matched_filter",
    sql(
        "E10",
        f"tp AS (SELECT unnest({_TAPS}) AS h, generate_subscripts({_TAPS}, 1) - 1 AS k)",
        f"SELECT e.capture_id, m AS n, {r('sum(i*h)', 6, 'i')}, {r('sum(q*h)', 6, 'q')} FROM (SELECT capture_id, n, i, q, n + k - {(len(_TAPS) - 1) // 2} AS m, h, max(n) OVER (PARTITION BY capture_id) AS last FROM E10, tp) e WHERE m >= 0 AND m <= last GROUP BY 1, 2",
    ),
)
def a34(inp: Inputs):
    from tonelake.sources.series import to_blocks, to_samples

    blocks = to_blocks(inp.label_samples(), 128)
    return rounded(to_samples(spectrum.fir_filter(blocks, _TAPS, 128)))


@query(
    "A35_eye_traces",
    sql(
        "E10",
        "sz AS (SELECT capture_id, count(*) AS num FROM E10 GROUP BY 1)",
        f"SELECT capture_id, t::BIGINT AS trace, (n-8*t)::INT AS at, {r('i', 6, 'v')} FROM E10 JOIN sz USING (capture_id), range(200) u(t) WHERE n >= 8*t AND n < 8*t+16 AND 8*t+16 <= num",
    ),
)
def a35(inp: Inputs):
    return rounded(spectrum.eye_traces(inp.label_blocks(), 8, VECTOR_SAMPLES))


@query(
    "A36_constellation_plot",
    sql(
        "E10",
        "sz AS (SELECT capture_id, ceil(count(*)/400.0)::BIGINT AS step FROM E10 GROUP BY 1)",
        "id AS (SELECT (2.0*a-1)/sqrt(2) AS i, (2.0*b-1)/sqrt(2) AS q FROM range(2) t(a), range(2) u(b))",
        f"""SELECT capture_id, 'sample' AS kind, {r('i', 5, 'i')}, {r('q', 5, 'q')} FROM E10 JOIN sz USING (capture_id) WHERE n % step = 0 AND n/step < 400
   UNION ALL SELECT capture_id, 'ideal', {r('i', 5)}, {r('q', 5)} FROM sz, id""",
    ),
)
def a36(inp: Inputs):
    shown = stats.decimate(inp.label_samples(), stats.sizes(inp.label_blocks()), 400)
    points = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("q")) for a, b in symbols.ideal_points("QPSK")])
    ideal = inp.label_blocks().select("capture_id").distinct().select("capture_id", F.explode(points).alias("p"))
    return rounded(
        shown.select("capture_id", F.lit("sample").alias("kind"), "i", "q").unionByName(
            ideal.select("capture_id", F.lit("ideal").alias("kind"), "p.i", "p.q")
        ),
        5,
    )
