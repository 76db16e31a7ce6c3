"""Trajectory statistics and gates (delays taken at a 1 kHz sample clock)."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import trajectory as t
from . import query

RATE = 1000.0
GATE = {"mad_max_ms": 120.0, "max_ppm": 4.0, "drift_min_ms": 100.0}


def rounded(df, *skip):
    """Doubles to six places, as both engines are compared there."""
    return df.select(*[F.round(c, 6).alias(c) if k == "double" and c not in skip else F.col(c)
                       for c, k in df.dtypes])


STATS = """
g AS (SELECT * FROM v_frame WHERE delay_samples IS NOT NULL),
m AS (SELECT file_id, ref, tgt, count(*) AS n, median(delay_samples) AS med, min(delay_samples) AS d_min, max(delay_samples) AS d_max,
        quantile_cont(delay_samples, 0.05) AS p_lo, quantile_cont(delay_samples, 0.95) AS p_hi,
        regr_slope(delay_samples, center_sample) AS slope, max(center_sample) - min(center_sample) AS span
      FROM g GROUP BY ALL),
d AS (SELECT g.file_id, g.ref, g.tgt, median(abs(g.delay_samples - m.med)) AS mad
      FROM g JOIN m USING (file_id, ref, tgt) GROUP BY ALL),
s AS (SELECT file_id, ref, tgt, max(st) AS step FROM (
        SELECT *, abs(delay_samples - lag(delay_samples) OVER (PARTITION BY file_id, ref, tgt ORDER BY center_sample, frame_no)) AS st FROM g)
      GROUP BY ALL),
st AS (SELECT m.file_id, m.ref, m.tgt, m.n, m.med, d.mad AS mad_ms, m.d_max - m.d_min AS spread_samples,
        CASE WHEN m.n >= 20 THEN m.p_hi - m.p_lo ELSE m.d_max - m.d_min END AS displacement_ms,
        coalesce(s.step, 0.0) AS max_step_ms, CASE WHEN m.n >= 2 THEN m.slope * 1e6 ELSE 0.0 END AS drift_ppm,
        CASE WHEN m.n >= 2 THEN m.slope * m.span END AS drift_total_ms
      FROM m JOIN d USING (file_id, ref, tgt) JOIN s USING (file_id, ref, tgt))"""
CONST = """coalesce(mad_ms <= 120 AND displacement_ms <= 120 AND (n < 20 OR spread_samples <= 120)
  AND NOT (abs(drift_ppm) > 4 AND abs(coalesce(drift_total_ms, 0)) > 100 AND abs(displacement_ms) > 100), FALSE)"""
EST = """
e AS (SELECT file_id, ref, tgt, count(delay_samples) AS usable_frames, median(delay_samples) AS offset_samples,
        coalesce(median(confidence) FILTER (WHERE delay_samples IS NOT NULL), 0.0) AS confidence
      FROM v_frame GROUP BY ALL)"""


@query("sig_07", with_views(
    "SELECT file_id, ref, tgt, usable_frames, round(offset_samples, 6) AS delay_samples, round(offset_samples, 6) AS delay_ms, "
    "round(confidence, 6) AS confidence FROM e", EST))
def sig_07(spark, sf):
    return rounded(t.pair_estimate(view(spark, sf, "v_frame"), RATE))


@query("agg_01", with_views(
    "SELECT file_id, ref, tgt, n, round(mad_ms, 6) AS mad_ms, round(spread_samples, 6) AS spread_samples, round(max_step_ms, 6) AS max_step_ms, "
    "round(drift_ppm, 4) AS drift_ppm, round(drift_total_ms, 4) AS drift_total_ms FROM st", STATS))
def agg_01(spark, sf):
    df = t.trajectory_stats(view(spark, sf, "v_frame"), RATE)
    return rounded(df.select(*t.KEYS, "n", "mad_ms", "spread_samples", "max_step_ms",
                             F.round("drift_ppm", 4).alias("drift_ppm"),
                             F.round("drift_total_ms", 4).alias("drift_total_ms")))


@query("agg_02", with_views(
    "SELECT file_id, ref, tgt, n, round(displacement_ms, 6) AS displacement_ms FROM st", STATS))
def agg_02(spark, sf):
    return rounded(t.robust_spread(view(spark, sf, "v_frame"), RATE)
                   .select(*t.KEYS, "n", "displacement_ms"))


@query("agg_03", with_views(
    "SELECT file_id, ref, tgt, coalesce(round(avg(CASE WHEN abs(delay_samples) >= 399.5 THEN 1.0 ELSE 0.0 END) "
    "FILTER (WHERE delay_samples IS NOT NULL), 6), 0.0)::DOUBLE AS edge_share FROM v_frame GROUP BY ALL"))
def agg_03(spark, sf):
    return rounded(t.boundary_pileup(view(spark, sf, "v_frame"), 400))


@query("dec_01", with_views(
    f"SELECT file_id, ref, tgt, {CONST} AS constant FROM st", STATS))
def dec_01(spark, sf):
    stats = t.trajectory_stats(view(spark, sf, "v_frame"), RATE)
    return stats.select(*t.KEYS, t.is_constant(rate=RATE, **GATE).alias("constant"))


@query("flagship", with_views(f"""
SELECT file_id, ref, tgt, usable_frames, round(offset_samples, 6) AS offset_samples, round(offset_samples, 6) AS delay_ms,
  round(confidence, 6) AS confidence, round(mad_ms, 6) AS mad_ms, round(displacement_ms, 6) AS displacement_ms,
  round(drift_ppm, 4) AS drift_ppm, constant, outcome,
  CASE WHEN outcome = 'fixed' THEN CAST(round_even(offset_samples, 0) AS BIGINT) END AS shift_samples FROM (
 SELECT *, CASE WHEN offset_samples IS NULL THEN 'unmeasured' WHEN usable_frames < 5 THEN 'insufficient_frames'
   WHEN confidence < 0.3 THEN 'low_confidence' WHEN NOT constant THEN 'non_constant'
   WHEN abs(offset_samples) < 1 OR abs(round_even(offset_samples, 0)) <= 5 THEN 'already_aligned' ELSE 'fixed' END AS outcome
 FROM (SELECT e.*, mad_ms, displacement_ms, drift_ppm, {CONST} AS constant FROM e LEFT JOIN st USING (file_id, ref, tgt)))""",
    STATS, EST))
def flagship(spark, sf):
    df = t.constant_offsets(view(spark, sf, "v_frame"), RATE, min_usable=5, min_confidence=0.3,
                            aligned_max_ms=0.1, min_shift_samples=5, **GATE)
    return rounded(df.withColumn("drift_ppm", F.round("drift_ppm", 4)))
