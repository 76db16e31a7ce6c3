"""Window queries. Geometry: 15 hops of 1,440,000 samples, windows of three hops."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import windows as w
from ..operators.trajectory import KEYS
from . import query
from .trajectory import rounded

N, HOP, WIN, FLOOR = 20_736_000, 1_440_000, 4_320_000, 2
K = "file_id, ref, tgt"
PLAN = f"""
pl AS (SELECT {K}, window_no, count(delay_samples) AS n_frames, count(delay_samples) >= {FLOOR} AS valid,
   CASE WHEN count(delay_samples) >= {FLOOR} THEN median(delay_samples) END AS delay_samples
  FROM (SELECT DISTINCT {K}, i AS window_no FROM v_frame, range(15) r(i)) s
  LEFT JOIN (SELECT {K}, CAST(floor(center_sample / {HOP}) AS BIGINT) AS window_no, delay_samples FROM v_frame) f USING ({K}, window_no) GROUP BY ALL),
plan AS (SELECT *, CAST(round_even(delay_samples, 0) AS BIGINT) AS shift FROM pl)"""
NEAR = f"""
nr AS (SELECT {K}, least(greatest(CAST(floor((center_sample - {WIN // 2} + {HOP // 2}) / {HOP}) AS BIGINT), 0), 14) AS window_no, delay_samples FROM v_frame WHERE delay_samples IS NOT NULL AND confidence >= 0.3),
npl AS (SELECT {K}, window_no, count(delay_samples) AS n_frames, count(delay_samples) >= {FLOOR} AS valid, CASE WHEN count(delay_samples) >= {FLOOR} THEN median(delay_samples) END AS delay_samples
  FROM (SELECT DISTINCT {K}, i AS window_no FROM v_frame, range(12) r(i)) s LEFT JOIN nr USING ({K}, window_no) GROUP BY ALL),
nplan AS (SELECT *, CAST(round_even(delay_samples, 0) AS BIGINT) AS shift FROM npl)"""
STATE = f"""
states AS (SELECT *, CASE WHEN NOT valid THEN 'UNRESOLVED_GAP' WHEN NOT coalesce(lag(valid) OVER (PARTITION BY {K} ORDER BY window_no), TRUE) THEN 'REENTRY' ELSE 'TRUSTED' END AS state FROM plan)"""


def frames(spark, sf):
    return view(spark, sf, "v_frame")


def plan(spark, sf):
    f = frames(spark, sf)
    return w.aggregate_frames(f, w.pair_lengths(f, N), hop=HOP, min_frames=FLOOR)


@query("agg_04", with_views(f"SELECT {K}, window_no, n_frames, valid, round(delay_samples, 6) AS delay_samples, shift FROM plan", PLAN))
def agg_04(spark, sf):
    return rounded(plan(spark, sf))


@query("win_01", with_views(f"SELECT {K}, window_no, state FROM states", PLAN, STATE))
def win_01(spark, sf):
    return w.gap_states(plan(spark, sf)).select(*w.WINDOW, "state")


@query("win_02", with_views(f"""SELECT {K}, window_no, coalesce(ps, 0) AS hold, CASE WHEN valid THEN shift ELSE 0 END AS no_correction_gap, coalesce(ps, 0) AS explicit_state, coalesce(ps, ns, 0) AS "current",
 coalesce(CAST(round_even(ps + (ns - ps) * coalesce((window_no - pw)::DOUBLE / nullif(nw - pw, 0), 0.0), 0) AS BIGINT), ps, ns, 0) AS linear, coalesce(ns, 0) AS "next" FROM (
 SELECT *, last_value(CASE WHEN valid THEN shift END IGNORE NULLS) OVER a AS ps, last_value(CASE WHEN valid THEN window_no END IGNORE NULLS) OVER a AS pw,
  first_value(CASE WHEN valid THEN shift END IGNORE NULLS) OVER b AS ns, first_value(CASE WHEN valid THEN window_no END IGNORE NULLS) OVER b AS nw FROM plan
 WINDOW a AS (PARTITION BY {K} ORDER BY window_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY {K} ORDER BY window_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", PLAN))
def win_02(spark, sf):
    return w.fill_gaps(plan(spark, sf)).drop("valid", "shift")


@query("win_03", with_views(f"""SELECT {K}, valid AS flag, min(window_no) AS run_start, max(window_no) AS run_end, count(*) AS run_length FROM (
 SELECT *, window_no - row_number() OVER (PARTITION BY {K}, valid ORDER BY window_no) AS g FROM plan) GROUP BY {K}, valid, g""", PLAN))
def win_03(spark, sf):
    return w.runs(plan(spark, sf), KEYS, "window_no", F.col("valid"))


INTERVALS = "SELECT user_id AS file_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) - 1704067200 AS start, CAST(round(value * 300) AS BIGINT) * (event_id % 7) AS count FROM events"


@query("win_04", f"""SELECT file_id, min(start) AS start, max(start + count) - min(start) AS count FROM (
 SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 600 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start, count) AS g FROM (
 SELECT *, max(start + count) OVER (PARTITION BY file_id ORDER BY start, count ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({INTERVALS}) WHERE count > 0)) GROUP BY file_id, g""")
def win_04(spark, sf):
    rows = view(spark, sf, "events").selectExpr(
        "user_id AS file_id", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) - 1704067200 AS start",
        "CAST(round(value * 300) AS BIGINT) * (event_id % 7) AS count")
    return w.merge_intervals(rows, ["file_id"], gap=600)


@query("agg_07", with_views(f"""SELECT {K}, count(*) AS n_windows, count(*) FILTER (valid) AS n_measured, count(*) FILTER (NOT valid) AS n_unresolved, count(*) FILTER (coalesce(shift, 0) <> 0) AS n_with_value,
 max(abs(shift)) AS max_abs_shift, count(*) FILTER (state = 'TRUSTED') AS trusted, count(*) FILTER (state = 'REENTRY') AS reentry, count(*) FILTER (state = 'UNRESOLVED_GAP') AS unresolved_gap,
 round(median(abs(shift)), 6)::DOUBLE AS median_abs_shift, round(count(*) FILTER (valid) / count(*), 6)::DOUBLE AS coverage, count(*) FILTER (valid) / count(*) >= 0.4 AS coverage_ok FROM states GROUP BY ALL""", PLAN, STATE))
def agg_07(spark, sf):
    return rounded(w.evidence(plan(spark, sf), 0.4))


RES = "SELECT user_id AS file_id, CASE WHEN event_type = 'error' OR user_id % 10 = 0 THEN NULL ELSE (value - 245) / 50 END AS residual FROM events"


@query("agg_08", f"""SELECT file_id, count(*) AS n_windows, count(residual) AS n_measured, count(residual) AS n_valid, count(*) FILTER (abs(residual) <= 1) AS le1, count(*) FILTER (abs(residual) <= 2) AS le2, count(*) FILTER (abs(residual) <= 5) AS le5,
 round(median(abs(residual)), 6) AS median_abs, round(quantile_cont(abs(residual), 0.9), 6) AS p90_abs, round(quantile_cont(abs(residual), 0.95), 6) AS p95_abs, round(max(abs(residual)), 6) AS max_abs,
 CASE WHEN count(residual) = 0 THEN 'no_trusted_window' END AS verdict FROM ({RES}) GROUP BY ALL""")
def agg_08(spark, sf):
    rows = view(spark, sf, "events").selectExpr(
        "user_id AS file_id", "CASE WHEN event_type = 'error' OR user_id % 10 = 0 THEN NULL ELSE (value - 245) / 50 END AS residual")
    return rounded(w.residual_summary(rows, ["file_id"], "residual"))


@query("win_10", """SELECT event_id, n_samples, CAST(ceil(n_samples / 480) AS BIGINT) AS required, CASE WHEN n_samples < 1440 THEN 0 ELSE (n_samples - 1440) // 480 + 1 END AS measured,
 CAST(ceil(n_samples / 480) AS BIGINT) - CASE WHEN n_samples < 1440 THEN 0 ELSE (n_samples - 1440) // 480 + 1 END AS seam FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS n_samples FROM events)""")
def win_10(spark, sf):
    n = F.col("n_samples")
    rows = view(spark, sf, "events").selectExpr("event_id", "CAST(round(value * 100) AS BIGINT) AS n_samples")
    need, got = w.required_windows(n, 480), w.measured_windows(n, 1440, 480)
    return rows.select("event_id", "n_samples", need.alias("required"), got.alias("measured"), (need - got).alias("seam"))


@query("jon_05", with_views(f"""SELECT frame_no, latest, nearest, p.shift AS latest_shift, q.shift AS nearest_shift FROM (
 SELECT *, least(CAST(floor(center_sample / {HOP}) AS BIGINT), 14) AS latest, least(greatest(CAST(floor((center_sample - {WIN // 2} + {HOP // 2}) / {HOP}) AS BIGINT), 0), 14) AS nearest FROM v_frame) f
 LEFT JOIN plan p ON p.file_id = f.file_id AND p.tgt = f.tgt AND p.window_no = latest LEFT JOIN plan q ON q.file_id = f.file_id AND q.tgt = f.tgt AND q.window_no = nearest""", PLAN))
def jon_05(spark, sf):
    shifts = plan(spark, sf).select(*KEYS, "window_no", "shift")
    need, pos = F.lit(15), F.col("center_sample")
    f = frames(spark, sf).select(*KEYS, "frame_no", w.clip(w.latest_start(pos, HOP), need).alias("latest"),
                                 w.clip(w.nearest_centre(pos, WIN, HOP), need).alias("nearest"))
    for name in ("latest", "nearest"):
        f = f.join(shifts.withColumnRenamed("window_no", name).withColumnRenamed("shift", f"{name}_shift"), [*KEYS, name], "left")
    return f.select("frame_no", "latest", "nearest", "latest_shift", "nearest_shift")


@query("jon_06", with_views(f"""SELECT file_id, ref, tgt, t, round(coalesce(py + (ny - py) * coalesce((t - pt)::DOUBLE / nullif(nt - pt, 0), 0.0), py, ny), 6) AS y FROM (
 SELECT *, last_value(y IGNORE NULLS) OVER a AS py, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS pt, first_value(y IGNORE NULLS) OVER b AS ny, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS nt FROM (
  SELECT {K}, t, max(y) AS y, bool_or(g) AS g FROM (SELECT {K}, window_no * {HOP} AS t, delay_samples AS y, FALSE AS g FROM plan WHERE valid UNION ALL SELECT DISTINCT {K}, i * 480000, NULL, TRUE FROM v_frame, range(44) r(i)) GROUP BY ALL)
 WINDOW a AS (PARTITION BY {K} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY {K} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE g""", PLAN))
def jon_06(spark, sf):
    f = frames(spark, sf)
    points = plan(spark, sf).where("valid").select(*KEYS, (F.col("window_no") * HOP).alias("t"), F.col("delay_samples").alias("y"))
    grid = w.window_spine(w.pair_lengths(f, N), F.lit(44).cast("bigint")).select(*KEYS, (F.col("window_no") * 480000).alias("t"))
    return rounded(w.interpolate(points, grid, KEYS, size=64 * 65536))


@query("agg_22", with_views(f"""SELECT {K}, 15::BIGINT AS n_needed, count(*) AS n_measured, count(*) FILTER (valid) AS n_resolved, round(count(*) FILTER (valid) / count(*), 6) AS resolved_fraction, round(count(*) FILTER (valid) / 15, 6) AS coverage, 15 - count(*) AS seam,
 max(longest) AS longest_gap, round(quantile_cont(n_frames, 0.1), 6)::DOUBLE AS frames_p10, round(quantile_cont(n_frames, 0.5), 6)::DOUBLE AS frames_p50, round(quantile_cont(n_frames, 0.9), 6)::DOUBLE AS frames_p90,
 round(quantile_cont(step, 0.5), 6)::DOUBLE AS step_p50, round(quantile_cont(step, 0.9), 6)::DOUBLE AS step_p90, max(step) AS step_max, count(*) FILTER (step > 1) AS step_gt_1, count(*) FILTER (step > 5) AS step_gt_5, count(*) FILTER (step > 48) AS step_gt_48
 FROM (SELECT *, abs(shift - lag(shift) OVER (PARTITION BY {K} ORDER BY window_no)) AS step FROM nplan) JOIN
 (SELECT {K}, coalesce(max(n) FILTER (NOT valid), 0) AS longest FROM (SELECT {K}, valid, g, count(*) AS n FROM (SELECT *, window_no - row_number() OVER (PARTITION BY {K}, valid ORDER BY window_no) AS g FROM nplan) GROUP BY ALL) GROUP BY ALL) l USING ({K}) GROUP BY ALL""", NEAR))
def agg_22(spark, sf):
    f = frames(spark, sf)
    lengths = w.pair_lengths(f, N)
    p = w.aggregate_nearest(f, lengths, window=WIN, hop=HOP, min_frames=FLOOR)
    return rounded(w.feasibility(p, lengths, hop=HOP))


@query("agg_28", with_views(f"""SELECT * FROM (SELECT {K}, count(*) FILTER (valid) AS resolved, count(*) FILTER (NOT valid) AS unresolved FROM nplan GROUP BY ALL)
 LEFT JOIN (SELECT {K}, count(*) AS n_gaps, count(*) FILTER (err > 48) AS gaps_gt_48, round(median(err), 6) AS err_p50, round(quantile_cont(err, 0.9), 6) AS err_p90, round(max(err), 6) AS err_max, round(median(len), 6)::DOUBLE AS gap_len_p50, max(len)::DOUBLE AS gap_len_max
  FROM (SELECT *, abs(delay_samples - lag(delay_samples) OVER x) AS err, window_no - lag(window_no) OVER x - 1 AS len FROM nplan WHERE valid WINDOW x AS (PARTITION BY {K} ORDER BY window_no)) WHERE len > 0 GROUP BY ALL) USING ({K})
 LEFT JOIN (SELECT {K}, round(quantile_cont(fr, 0.9), 6) AS fractional_p90, round(quantile_cont(wh, 0.9), 6) AS integer_p90 FROM held GROUP BY ALL) USING ({K})
 LEFT JOIN (SELECT {K}, round(median(mad) + 1e-9, 6) AS window_mad_p50_ms, round(quantile_cont(mad, 0.9) + 1e-9, 6) AS window_mad_p90_ms FROM (SELECT {K}, window_no, median(fr) * 1.4826 AS mad FROM held GROUP BY ALL) GROUP BY ALL) USING ({K})""".replace("SELECT * FROM (SELECT", "SELECT * REPLACE (coalesce(n_gaps, 0) AS n_gaps, coalesce(gaps_gt_48, 0) AS gaps_gt_48) FROM (SELECT", 1),
    NEAR, f"held AS (SELECT nr.*, abs(nr.delay_samples - p.delay_samples) AS fr, abs(nr.delay_samples - round_even(p.delay_samples, 0)) AS wh FROM nr JOIN nplan p USING ({K}, window_no) WHERE valid)"))
def agg_28(spark, sf):
    f = frames(spark, sf)
    cost = w.gap_cost(f, w.pair_lengths(f, N), window=WIN, hop=HOP, min_frames=FLOOR, rate=1000.0)
    # four-digit factor times four-digit values lies on rounding ties; step off them
    nudged = {c: F.col(c) + 1e-9 for c in ("window_mad_p50_ms", "window_mad_p90_ms")}
    return rounded(cost.withColumns(nudged))


def _grid(k):
    off = k * HOP // 4
    n = N - off
    need, got = -(-n // HOP), (n - WIN) // HOP + 1
    return (f"g{k} AS (SELECT {K}, window_no, count(*) AS n{k} FROM (SELECT {K}, least(greatest(CAST(floor((center_sample - {off} - {WIN // 2} + {HOP // 2}) / {HOP}) AS BIGINT), 0), {need - 1}) AS window_no "
            f"FROM v_frame WHERE delay_samples IS NOT NULL AND confidence >= 0.3) WHERE window_no < {got} GROUP BY ALL)")


@query("agg_29", with_views(f"""SELECT {K}, count(*) FILTER (n0 >= 3) AS resolved_0, count(*) FILTER (n1 >= 3) AS resolved_1, count(*) FILTER (n2 >= 3) AS resolved_2, count(*) FILTER (n3 >= 3) AS resolved_3,
 count(*) FILTER (greatest(coalesce(n0, 0), coalesce(n1, 0), coalesce(n2, 0), coalesce(n3, 0)) >= 3) AS resolved_best,
 count(*) FILTER (need > 0) AS n_covered, max(need) AS need_max FROM (SELECT DISTINCT {K}, i AS window_no FROM v_frame, range(15) r(i)) s
 LEFT JOIN g0 USING ({K}, window_no) LEFT JOIN g1 USING ({K}, window_no) LEFT JOIN g2 USING ({K}, window_no) LEFT JOIN g3 USING ({K}, window_no) LEFT JOIN nd USING ({K}, window_no) GROUP BY ALL""",
    *[_grid(k) for k in range(4)],
    f"""ct AS (SELECT s.{K.replace(', ', ', s.')}, s.window_no, l.k, count(delay_samples) FILTER (confidence >= 0.3 AND center_sample >= s.window_no * {HOP} AND center_sample < (s.window_no + l.k) * {HOP}) AS n FROM (SELECT DISTINCT {K}, i AS window_no FROM v_frame, range(12) r(i)) s
 CROSS JOIN (VALUES (3), (6), (12)) l(k) LEFT JOIN v_frame f ON f.file_id = s.file_id AND f.tgt = s.tgt GROUP BY ALL),
nd AS (SELECT {K}, window_no, CASE WHEN coalesce(n0, 0) >= 3 THEN 3 ELSE coalesce(need, -1) END::BIGINT AS need FROM (SELECT {K}, window_no, min(k) FILTER (n >= 3) AS need FROM ct GROUP BY ALL) LEFT JOIN g0 USING ({K}, window_no))"""))
def agg_29(spark, sf):
    f = frames(spark, sf)
    lengths = w.pair_lengths(f, N)
    grids = w.grid_sensitivity(f, lengths, window=WIN, hop=HOP)
    need = w.smallest_window(f, lengths, window=WIN, hop=HOP, ladder=[3, 6, 12]).groupBy(*KEYS).agg(
        F.count_if(F.col("need_hops") > 0).alias("n_covered"), F.max("need_hops").alias("need_max"))
    return grids.join(need, KEYS)


@query("win_09", """SELECT file_id, n_times, n_times - nd AS duplicates, min_gap, max_gap, CASE WHEN n_times < 2 THEN 'too_few' WHEN n_times > nd THEN 'duplicated' WHEN max_gap > 0 AND min_gap < max_gap * 0.5 THEN 'irregular' ELSE 'ok' END AS verdict FROM (
 SELECT file_id, count(*) AS n_times, count(DISTINCT pts) AS nd, min(gap) AS min_gap, max(gap) AS max_gap FROM (SELECT file_id, pts, nullif(pts - lag(pts) OVER (PARTITION BY file_id ORDER BY pts), 0) AS gap FROM
 (SELECT user_id AS file_id, CAST(floor(epoch_us(ts) / 60000000) AS BIGINT) AS pts FROM events)) GROUP BY ALL)""")
def win_09(spark, sf):
    rows = view(spark, sf, "events").selectExpr("user_id AS file_id", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 60000000) AS BIGINT) AS pts")
    return w.cadence(rows)


@query("win_11", with_views("""SELECT file_id, track_id, delay_ms, mad_ms FROM (SELECT *, min(mad_ms) OVER (PARTITION BY file_id ORDER BY delay_ms DESC, mad_ms, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v_track_a)
 WHERE best IS NULL OR mad_ms < best - 1e-9"""))
def win_11(spark, sf):
    return w.pareto_front(view(spark, sf, "v_track_a"), ["file_id"], "delay_ms", "mad_ms", "track_id").select("file_id", "track_id", "delay_ms", "mad_ms")
