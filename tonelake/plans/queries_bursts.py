"""Registered queries: burst search."""

from __future__ import annotations

from tonelake.functions.scalars import rounded
from tonelake.operators import bursts
from tonelake.plans.inputs import Inputs
from tonelake.plans.registry import query
from tonelake.plans.statements import r, sql


def _env_steps(view: str, window: int) -> list[str]:
    return [
        f"blk AS (SELECT capture_id, n // {window} AS block, avg(i*i+q*q) AS p FROM {view} GROUP BY 1, 2 HAVING count(*) = {window})",
        """env AS (SELECT capture_id, block, 10*log10(greatest(p, peak*1e-12)) AS env_db
  FROM (SELECT *, max(p) OVER (PARTITION BY capture_id) AS peak FROM blk) WHERE peak > 0)""",
    ]


_OTSU = [
    "spans AS (SELECT capture_id, min(env_db) AS lo, max(env_db) AS hi FROM env GROUP BY 1)",
    """cnt AS (SELECT capture_id, slot, count(*) AS h, any_value(lo) + (slot + 0.5)*(any_value(hi)-any_value(lo))/256 AS centre
  FROM (SELECT e.capture_id, least(floor((env_db-lo)/(hi-lo)*256)::BIGINT, 255) AS slot, lo, hi
        FROM env e JOIN spans USING (capture_id) WHERE hi > lo) GROUP BY 1, 2)""",
    """spl AS (SELECT capture_id, slot, centre, sum(h) OVER u AS w0, sum(h) OVER p AS total,
         sum(h*centre) OVER u AS c0, sum(h*centre) OVER p AS cs
  FROM cnt WINDOW u AS (PARTITION BY capture_id ORDER BY slot ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY capture_id))""",
    """thr AS (SELECT s.capture_id, threshold_db FROM spans s LEFT JOIN (
  SELECT capture_id, centre AS threshold_db FROM (
    SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY w0*(total-w0)*power(c0/w0-(cs-c0)/(total-w0), 2) DESC, slot) AS rk
    FROM spl WHERE total > w0) WHERE rk = 1) b ON s.capture_id = b.capture_id)""",
]

_REGION = [
    "mk AS (SELECT env.*, threshold_db, env_db > threshold_db AS above FROM env JOIN thr USING (capture_id))",
    """lv AS (SELECT capture_id, any_value(threshold_db) AS threshold_db, avg(env_db) FILTER (NOT above) AS noise_floor_db,
         avg(env_db) FILTER (above) AS burst_level_db FROM mk GROUP BY 1)""",
    """isl AS (SELECT capture_id, min(block) AS a, max(block) AS z FROM (
    SELECT capture_id, block, block - row_number() OVER (PARTITION BY capture_id ORDER BY block) AS g FROM mk WHERE above)
  GROUP BY capture_id, g)""",
    "run AS (SELECT capture_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY z-a DESC, a) AS rk FROM isl) WHERE rk = 1)",
]


def region_steps(view: str, window: int) -> list[str]:
    """Steps that end in ``reg``, the burst table of ``view``."""
    return [
        *_env_steps(view, window),
        *_OTSU,
        *_REGION,
        f"sz AS (SELECT capture_id, count(*) AS n_samples FROM {view} GROUP BY 1)",
        f"""reg0 AS (SELECT sz.capture_id, n_samples, threshold_db, noise_floor_db, burst_level_db,
         burst_level_db - noise_floor_db AS snr_db, a, z,
         CASE WHEN n_samples < {2 * window} THEN 'capture shorter than two envelope windows'
              WHEN threshold_db IS NULL THEN 'envelope has no usable dynamic range'
              WHEN burst_level_db - noise_floor_db IS NULL THEN 'envelope is unimodal: no burst to separate'
              WHEN burst_level_db - noise_floor_db < 6.0 THEN 'no burst above the noise floor' ELSE '' END AS reason
  FROM sz LEFT JOIN lv USING (capture_id) LEFT JOIN run USING (capture_id))""",
        f"""reg AS (SELECT capture_id, reason = '' AS found, CASE WHEN reason = '' THEN a*{window} END AS start_sample,
         CASE WHEN reason = '' THEN least((z+1)*{window}, n_samples) END AS end_sample, n_samples,
         CASE WHEN n_samples >= {2 * window} THEN threshold_db END AS threshold_db,
         CASE WHEN n_samples >= {2 * window} AND snr_db IS NOT NULL THEN noise_floor_db END AS noise_floor_db,
         CASE WHEN n_samples >= {2 * window} AND snr_db IS NOT NULL THEN burst_level_db END AS burst_level_db,
         CASE WHEN n_samples >= {2 * window} THEN snr_db END AS snr_db, reason FROM reg0)""",
    ]


_REGION_SELECT = f"""SELECT capture_id, found, start_sample::BIGINT AS start_sample, end_sample::BIGINT AS end_sample, n_samples,
  {r('threshold_db', 6, 'threshold_db')}, {r('noise_floor_db', 6, 'noise_floor_db')},
  {r('burst_level_db', 6, 'burst_level_db')}, {r('snr_db', 6, 'snr_db')}, reason FROM reg"""


@query("A2_envelope", sql("V", *_env_steps("V", 64), f"SELECT capture_id, block::BIGINT AS block, {r('env_db', 6, 'env_db')} FROM env"))
def a2_envelope(inp: Inputs):
    return rounded(bursts.envelope(inp.event_samples()).drop("lo", "hi"))


@query(
    "A3_otsu_threshold",
    sql("V", *_env_steps("V", 4), *_OTSU, f"SELECT capture_id, {r('threshold_db', 6, 'threshold_db')} FROM thr"),
)
def a3_otsu(inp: Inputs):
    return rounded(bursts.otsu_thresholds(bursts.envelope(inp.event_samples(), 4)))


@query("A4_burst_region", sql("V", *region_steps("V", 4), _REGION_SELECT))
def a4_burst(inp: Inputs):
    return rounded(bursts.burst_regions(inp.event_samples(), window=4))


@query("A4_burst_region_wide_window", sql("V", *region_steps("V", 64), _REGION_SELECT))
def a4_burst_wide(inp: Inputs):
    return rounded(bursts.burst_regions(inp.event_samples()))


@query(
    "W6_longest_run",
    sql("V", *_env_steps("V", 4), *_OTSU, *_REGION, "SELECT capture_id, a::BIGINT AS first_pos, z::BIGINT AS last_pos FROM run"),
)
def w6_longest_run(inp: Inputs):
    env = bursts.envelope(inp.event_samples(), 4)
    marked = env.join(bursts.otsu_thresholds(env), "capture_id").where("env_db > threshold_db")
    return bursts.longest_runs(marked, segment=64)
