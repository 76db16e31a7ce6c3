"""Experiment queries over track decisions of two runs."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import experiments as e
from ..operators.windows import pair_lengths
from . import query
from .trajectory import rounded
from .windows import HOP, N, WIN

EXTRA = {"delay_samples": "delay_ms * 0.1", "confidence": "(track_id % 10) / 10.0{d}", "drift_ppm": "(track_id % 9) * 1.0{d}",
         "displacement_ms": "(track_id % 19) / 10.0{d}"}
TR = "tr AS (SELECT *, " + ", ".join(f"{v.format(d='::DOUBLE')} AS {k}" for k, v in EXTRA.items()) + " FROM v_track_a)"


def tracks(spark, sf, name="v_track_a"):
    return view(spark, sf, name).withColumns({k: F.expr(v.format(d="D")) for k, v in EXTRA.items()})


@query("src_07", with_views("""SELECT concat('f', file_id) AS file, track_id AS stream, priority, decision, round(delay_ms, 6) AS delay_ms FROM (SELECT *, row_number() OVER (PARTITION BY file_id, track_id ORDER BY priority) AS rn FROM (
 SELECT file_id, track_id, decision, delay_ms, 0::BIGINT AS priority FROM v_track_a WHERE track_id % 3 <> 0 UNION ALL SELECT file_id, track_id, decision, delay_ms, 1 FROM v_track_b)) WHERE rn = 1"""))
def src_07(spark, sf):
    schema = "array<struct<stream: bigint, decision: string, delay_ms: double>>"
    docs = None
    for k, rows in enumerate((view(spark, sf, "v_track_a").where("track_id % 3 <> 0"), view(spark, sf, "v_track_b"))):
        channel = F.struct(F.col("track_id").alias("stream"), "decision", "delay_ms")
        later = F.struct(F.col("track_id").alias("stream"), F.lit("later").alias("decision"), F.lit(0.0).alias("delay_ms"))
        part = rows.select(F.lit(k).cast("bigint").alias("priority"), F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("file"),
                           F.to_json(F.array(channel, later)).alias("text"))
        docs = part if docs is None else docs.unionByName(part)
    arms = docs.select("priority", "file", F.from_json("text", schema).alias("channels"))
    return rounded(e.first_seen(arms).select("file", "stream", "priority", "decision", "delay_ms"))


FIELDS = ["decision", "reason", "usable_frames", "delay_ms"]
CH = """
com AS (SELECT DISTINCT file_id FROM v_track_a INTERSECT SELECT DISTINCT file_id FROM v_track_b),
fj AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, coalesce(a.track_id, b.track_id) AS track_id, a.decision AS xd, b.decision AS yd, a.reason AS xr, b.reason AS yr, a.usable_frames AS xu, b.usable_frames AS yu, a.delay_ms AS xm, b.delay_ms AS ym FROM v_track_a a FULL JOIN v_track_b b ON a.file_id = b.file_id AND a.track_id = b.track_id),
up AS (SELECT *, coalesce(xd = 'fixed', FALSE) AS was, coalesce(yd = 'fixed', FALSE) AS now FROM fj WHERE file_id IN (SELECT file_id FROM com)),
ch AS (SELECT file_id, track_id, 'decision' AS field, CASE WHEN xd = 'untouched' AND yd = 'anchor' THEN 'reclassified' WHEN was AND NOT now THEN 'lost_fix' WHEN now AND NOT was THEN 'added_fix' ELSE 'changed' END AS change FROM up WHERE xd IS DISTINCT FROM yd
 UNION ALL SELECT file_id, track_id, 'reason', 'changed' FROM up WHERE xr IS DISTINCT FROM yr UNION ALL SELECT file_id, track_id, 'usable_frames', 'changed' FROM up WHERE xu IS DISTINCT FROM yu
 UNION ALL SELECT file_id, track_id, 'delay_ms', CASE WHEN was AND now THEN 'changed_value' ELSE 'changed' END FROM up WHERE xm IS DISTINCT FROM ym)"""


@query("jon_02", with_views("SELECT file_id, track_id, field, change FROM ch", CH))
def jon_02(spark, sf):
    return e.run_changes(view(spark, sf, "v_track_a"), view(spark, sf, "v_track_b"), FIELDS).select("file_id", "track_id", "field", "change")


@query("jon_02_summary", with_views("SELECT field, change, count(*) AS n_changes FROM ch GROUP BY ALL", CH))
def jon_02_summary(spark, sf):
    return e.run_summary(e.run_changes(view(spark, sf, "v_track_a"), view(spark, sf, "v_track_b"), FIELDS))


def _redecide(frames, conf, mad, shift):
    by = f"CASE WHEN abs(delay_samples) <= {shift} THEN 'aligned' ELSE 'fixed' END"
    return f"""CASE WHEN decision = 'anchor' THEN 'anchor' WHEN decision IN ('fixed', 'already_aligned') THEN {by} WHEN reason IN ('silent_track', 'non_finite', 'no_valid_anchor', 'out_of_range') THEN 'unrecoverable' WHEN reason = 'recheck_residual' THEN 'recheck'
 WHEN usable_frames < {frames} OR confidence < {conf} THEN 'refused' WHEN mad_ms > {mad} THEN 'refused' WHEN usable_frames >= 20 AND spread_ms > {mad} THEN 'refused' WHEN usable_frames < 20 AND reason = 'non_constant' THEN 'needs_remeasure' WHEN drift_ppm > 5 AND spread_ms > 0.1 THEN 'refused' ELSE {by} END"""


@query("dec_11", with_views(f"SELECT track_id, decision, {_redecide(5, 0.3, 1.0, 5)} AS again FROM tr", TR))
def dec_11(spark, sf):
    return tracks(spark, sf).select("track_id", "decision", e.redecide(e.current_thresholds()).alias("again"))


@query("dec_11_parity", with_views(f"SELECT count(*) AS tracks, count(*) FILTER (d = 'fixed' AND decision <> 'fixed') AS only_replica, count(*) FILTER (d <> 'fixed' AND decision = 'fixed') AS only_stored FROM (SELECT *, {_redecide(5, 0.3, 1.0, 5)} AS d FROM tr)", TR))
def dec_11_parity(spark, sf):
    return e.parity(tracks(spark, sf))


GRID = ([("frames", v, v, 0.3, 1.0, 5) for v in (1, 3, 5, 9, 12)] + [("mad", v, 5, 0.3, v, 5) for v in (0.5, 1.0, 2.0)]
        + [("conf", v, 5, v, 1.0, 5) for v in (0.0, 0.5, 0.8)] + [("shift", v, 5, 0.3, 1.0, v) for v in (0, 3, 5)])
_G = ", ".join(f"('{p}', {float(v)}::DOUBLE, {fr}, {float(cf)}::DOUBLE, {float(md)}::DOUBLE, {sh})" for p, v, fr, cf, md, sh in GRID)


@query("dec_12", with_views(f"""SELECT param, value, g_frames AS frames, g_mad AS mad, g_shift AS shift, count(*) FILTER (d = 'fixed' AND decision <> 'fixed') AS new_fixed, count(*) FILTER (NOT (d = 'fixed' AND decision <> 'fixed') AND d IN ('fixed', 'aligned') AND decision IN ('fixed', 'already_aligned')) AS adopted,
 round(coalesce(sum(abs(delay_ms)) FILTER (d = 'fixed' AND decision <> 'fixed'), 0.0), 4) AS recover_ms, round(coalesce(sum(spread_ms) FILTER (d = 'fixed' AND decision <> 'fixed'), 0.0), 4) AS accept_ms,
 round(coalesce(sum(abs(delay_ms)) FILTER (d NOT IN ('fixed', 'aligned', 'anchor') AND abs(delay_samples) > 5), 0.0), 4) AS remain_ms, count(*) FILTER (d NOT IN ('fixed', 'aligned', 'anchor') AND abs(delay_samples) > 5) AS remain_tracks
 FROM (SELECT *, {_redecide('g_frames', 'g_conf', 'g_mad', 'g_shift')} AS d FROM tr CROSS JOIN (VALUES {_G}) g(param, value, g_frames, g_conf, g_mad, g_shift)) GROUP BY ALL""", TR))
def dec_12(spark, sf):
    out = e.sweep(tracks(spark, sf), GRID)
    return out.select("param", "value", "frames", "mad", "shift", "new_fixed", "adopted", *[F.round(c, 4).alias(c) for c in ("recover_ms", "accept_ms", "remain_ms")], "remain_tracks")


@query("dec_13", with_views("""SELECT gate, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(median(delay_ms), 6) AS delay_median, round(median(mad_ms), 6) AS mad_median, round(median(displacement_ms), 6) AS disp_median FROM (
 SELECT *, CASE WHEN mad_ms > 1.0 THEN 'gate1_mad' WHEN displacement_ms > 1.0 THEN 'gate2_disp' WHEN usable_frames >= 20 THEN 'gate3_range' ELSE 'other' END AS gate FROM tr WHERE decision = 'untouched' AND abs(delay_ms) >= 5000.0 / 48000) GROUP BY gate""", TR))
def dec_13(spark, sf):
    return rounded(e.gate_attribution(tracks(spark, sf), 1.0))


@query("dec_14", with_views("""SELECT CASE WHEN NOT exact THEN 'suspect' WHEN after IS NULL THEN 'unverified' WHEN abs(after) <= 1 THEN 'good' WHEN abs(after) <= displacement_ms * 48 THEN 'beneficial' ELSE 'suspect' END AS triage, count(*) AS n FROM (
 SELECT b.track_id, b.track_id % 4 <> 0 AS exact, CASE WHEN b.track_id % 6 = 0 THEN NULL ELSE (b.track_id % 30) / 2.0::DOUBLE END AS after, (b.track_id % 5) / 10.0::DOUBLE AS displacement_ms FROM v_track_b b WHERE b.decision = 'fixed' AND b.track_id NOT IN (SELECT track_id FROM v_track_a WHERE decision = 'fixed')) GROUP BY ALL"""))
def dec_14(spark, sf):
    b = view(spark, sf, "v_track_b")
    verified = b.selectExpr("track_id", "track_id % 4 <> 0 AS exact", "CASE WHEN track_id % 6 = 0 THEN NULL ELSE (track_id % 30) / 2.0D END AS after", "(track_id % 5) / 10.0D AS displacement_ms")
    return e.triage_fixes(view(spark, sf, "v_track_a"), b, verified, 48000.0)


@query("dec_15", with_views("""SELECT file_id, CASE WHEN f THEN 'fixed' ELSE 'refused_off' END AS kind FROM (SELECT file_id, bool_or(decision = 'fixed') AS f, bool_or(decision = 'untouched' AND coalesce(reason, '') IN ('non_constant', 'recheck_residual', 'low_confidence') AND abs(delay_ms) >= 5000.0 / 48000) AS r FROM v_track_b GROUP BY ALL) WHERE f OR r"""))
def dec_15(spark, sf):
    return e.validation_subset(view(spark, sf, "v_track_b"))


@query("agg_21", with_views(f"""SELECT file_id, tgt, max(k) AS best_single, count(*) AS n_sources, any_value(bf) AS best_family, any_value(ua) AS union_all FROM (SELECT file_id, tgt, source, count(*) AS k FROM h GROUP BY ALL)
 JOIN (SELECT file_id, tgt, max(k) AS bf FROM (SELECT file_id, tgt, family, count(DISTINCT w) AS k FROM h GROUP BY ALL) GROUP BY ALL) USING (file_id, tgt) JOIN (SELECT file_id, tgt, count(DISTINCT w) AS ua FROM h GROUP BY ALL) USING (file_id, tgt) GROUP BY file_id, tgt""",
    f"""h AS (SELECT file_id, tgt, family, source, w, count(*) AS n FROM (SELECT *, frame_no % 2 AS family, frame_no % 4 AS source, least(greatest(CAST(floor((center_sample - {WIN // 2} + {HOP // 2}) / {HOP}) AS BIGINT), 0), 14) AS w FROM v_frame WHERE delay_samples IS NOT NULL AND confidence >= 0.3) WHERE w < 12 GROUP BY ALL HAVING count(*) >= 2)"""))
def agg_21(spark, sf):
    f = view(spark, sf, "v_frame")
    labelled = f.withColumn("family", F.col("frame_no") % 2).withColumn("source", F.col("frame_no") % 4)
    return e.evidence_bound(labelled, pair_lengths(f, N), window=WIN, hop=HOP, min_frames=2)


@query("agg_26", with_views("""SELECT r AS reason, count(*) AS n, count(*) FILTER (ratio < 1) AS below_1, count(*) FILTER (ratio >= 1 AND ratio < 3) AS from_1_to_3, count(*) FILTER (ratio >= 3) AS from_3, count(*) FILTER (ratio IS NULL) AS zero_spread,
 round(min(ratio), 6) AS ratio_min, round(median(ratio), 6) AS ratio_median, round(max(ratio), 6) AS ratio_max FROM (SELECT unnest([coalesce(reason, '?'), 'total']) AS r, CASE WHEN spread_ms > 0 THEN abs(delay_ms) / spread_ms END AS ratio FROM v_track_a WHERE decision = 'untouched' AND abs(delay_ms) >= 5000.0 / 48000) GROUP BY ALL"""))
def agg_26(spark, sf):
    return rounded(e.improvement(view(spark, sf, "v_track_a")))
