"""Curve queries. Windows come from frames at 48 kHz: 432 seconds, 15-second bins."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import curves as c
from ..operators.trajectory import KEYS
from ..session import cut_lineage
from . import query
from .trajectory import rounded

RATE, SECONDS, BIN = 48000, 432, 15
K = "file_id, ref, tgt"
WEAK = "confidence * CASE WHEN file_id % 5 = 0 THEN 0.05 ELSE 1 END"
WD = f"wd AS (SELECT {K}, frame_no, center_sample AS start_sample, delay_samples, {WEAK} AS confidence, (confidence + 0.1) / 2 AS coarse_cc, delay_samples IS NOT NULL AS valid FROM v_frame)"
AN = f"""
kept AS (SELECT * FROM (SELECT *, count(*) FILTER (confidence >= 0.08) OVER (PARTITION BY {K}) AS sure FROM wd WHERE valid) WHERE CASE WHEN sure >= 2 THEN confidence >= 0.08 ELSE coarse_cc >= 0.08 END),
bn AS (SELECT {K}, CAST(floor(start_sample / {RATE * BIN}) AS BIGINT) AS bin, delay_samples AS v, greatest(confidence, 1e-6) AS w FROM kept),
bc AS (SELECT *, sum(w) OVER (PARTITION BY {K}, bin ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(w) OVER (PARTITION BY {K}, bin) AS tot FROM bn),
an AS (SELECT {K}, bin, bin * {BIN} AS t_sec, min(v) FILTER (round(cum, 9) >= round(tot / 2, 9)) AS y, count(*) AS n_windows FROM bc GROUP BY ALL),
ai AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY bin) - 1 AS idx, count(*) OVER (PARTITION BY {K}) AS n FROM an)"""


def windows(spark, sf):
    return view(spark, sf, "v_frame").select(
        *KEYS, "frame_no", F.col("center_sample").alias("start_sample"), "delay_samples", F.expr(WEAK).cast("double").alias("confidence"),
        ((F.col("confidence") + 0.1) / 2).alias("coarse_cc"), F.col("delay_samples").isNotNull().alias("valid"))


def points(spark, sf):
    return c.anchor_points(windows(spark, sf), rate=RATE, bin_sec=BIN)


@query("agg_05", with_views(f"""SELECT file_id, tgt, round(coalesce(CASE WHEN any_value(tot) > 0 THEN min(v) FILTER (round(cum, 9) >= round(tot / 2, 9)) END, median(v)), 6) AS median FROM (SELECT *, sum(w) OVER (PARTITION BY file_id, tgt ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(w) OVER (PARTITION BY file_id, tgt) AS tot
 FROM (SELECT file_id, tgt, delay_samples AS v, CASE WHEN file_id % 11 = 0 THEN 0.0 ELSE confidence END AS w FROM v_frame WHERE delay_samples IS NOT NULL)) GROUP BY ALL"""))
def agg_05(spark, sf):
    rows = view(spark, sf, "v_frame").withColumn("w", F.when(F.col("file_id") % 11 == 0, 0.0).otherwise(F.col("confidence")))
    return rounded(c.weighted_median(rows, ["file_id", "tgt"], "delay_samples", "w"))


@query("agg_06", with_views(f"SELECT {K}, bin, t_sec, round(y, 6) AS y, n_windows FROM an", WD, AN))
def agg_06(spark, sf):
    return rounded(c.anchors(windows(spark, sf), rate=RATE, bin_sec=BIN))


MODE = "SELECT file_id, tgt, CAST(round(delay_samples / 8) AS BIGINT) AS delay, confidence AS quality FROM v_frame"


def mode_rows(spark, sf):
    return view(spark, sf, "v_frame").selectExpr("file_id", "tgt", "CAST(round(delay_samples / 8) AS BIGINT) AS delay", "confidence AS quality")


@query("agg_09", with_views(f"""SELECT t.file_id, t.tgt, min(i.delay) FILTER (round(cum, 9) >= round(tot / 2, 9)) AS delay, any_value(t.support)::BIGINT AS support, any_value(t.n)::BIGINT AS n, round(any_value(t.support / t.n), 6) AS support_frac, max(i.delay) - min(i.delay) AS inlier_spread
 FROM top t JOIN inl i ON i.file_id = t.file_id AND i.tgt = t.tgt GROUP BY ALL""",
    f"mr AS ({MODE})", "hs AS (SELECT file_id, tgt, delay, count(*) AS c FROM mr WHERE delay IS NOT NULL GROUP BY ALL)",
    "sm AS (SELECT *, sum(c) OVER (PARTITION BY file_id, tgt ORDER BY delay RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS support FROM hs)",
    "top AS (SELECT file_id, tgt, arg_max(delay, (support, -delay)) AS center, max(support) AS support, sum(c) AS n FROM sm GROUP BY ALL HAVING sum(c) >= 3)",
    "inl AS (SELECT m.*, sum(quality) OVER (PARTITION BY m.file_id, m.tgt ORDER BY delay RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(quality) OVER (PARTITION BY m.file_id, m.tgt) AS tot FROM mr m JOIN top USING (file_id, tgt) WHERE abs(delay - center) <= 2)"))
def agg_09(spark, sf):
    return rounded(c.dominant_mode(mode_rows(spark, sf), ["file_id", "tgt"]))


@query("agg_10", with_views("""SELECT file_id, tgt, place, delay, round(near_w, 2) AS weight FROM (SELECT *, 0::BIGINT AS place FROM m1 UNION ALL SELECT *, 1 FROM m2 UNION ALL SELECT *, 2 FROM m3)""",
    f"mr AS ({MODE})", "hs AS (SELECT file_id, tgt, delay, sum(quality) AS w FROM mr WHERE delay IS NOT NULL GROUP BY ALL)",
    "sm AS (SELECT *, sum(w) OVER (PARTITION BY file_id, tgt ORDER BY delay RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near_w FROM hs)",
    "m1 AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY file_id, tgt ORDER BY round(w, 9) DESC, delay) = 1)",
    "m2 AS (SELECT s.* FROM sm s JOIN m1 USING (file_id, tgt) WHERE abs(s.delay - m1.delay) >= 4 QUALIFY row_number() OVER (PARTITION BY s.file_id, s.tgt ORDER BY round(s.w, 9) DESC, s.delay) = 1)",
    "m3 AS (SELECT s.* FROM sm s JOIN m1 USING (file_id, tgt) JOIN m2 USING (file_id, tgt) WHERE abs(s.delay - m1.delay) >= 4 AND abs(s.delay - m2.delay) >= 4 QUALIFY row_number() OVER (PARTITION BY s.file_id, s.tgt ORDER BY round(s.w, 9) DESC, s.delay) = 1)"))
def agg_10(spark, sf):
    return c.separated_modes(mode_rows(spark, sf), ["file_id", "tgt"])


@query("jon_12", with_views(f"""SELECT {K}, round(coalesce(slope, 0.0), 6) AS slope FROM (SELECT DISTINCT {K} FROM ai) LEFT JOIN (SELECT a.file_id, a.ref, a.tgt, median((b.y - a.y) / (b.t_sec - a.t_sec)) AS slope FROM ai a JOIN ai b ON a.file_id = b.file_id AND a.tgt = b.tgt AND a.idx < b.idx GROUP BY ALL) USING ({K})""", WD, AN))
def jon_12(spark, sf):
    return rounded(c.theil_sen(points(spark, sf).withColumn("x", F.col("t_sec").cast("double")), KEYS))


R7 = f"""r7 AS (SELECT *, CASE WHEN n >= 7 THEN list_sort([y, l1, l2, l3, m1, m2, m3])[4] ELSE y END AS m FROM (SELECT *, coalesce(lag(y, 1) OVER o, y) AS l1, coalesce(lag(y, 2) OVER o, lag(y, 1) OVER o, y) AS l2, coalesce(lag(y, 3) OVER o, lag(y, 2) OVER o, lag(y, 1) OVER o, y) AS l3,
 coalesce(lead(y, 1) OVER o, y) AS m1, coalesce(lead(y, 2) OVER o, lead(y, 1) OVER o, y) AS m2, coalesce(lead(y, 3) OVER o, lead(y, 2) OVER o, lead(y, 1) OVER o, y) AS m3 FROM ai WINDOW o AS (PARTITION BY {K} ORDER BY idx)))"""


@query("win_05", with_views(f"SELECT {K}, idx, round(m, 6) AS y FROM r7", WD, AN, R7))
def win_05(spark, sf):
    return rounded(c.rolling_median(points(spark, sf).select(*KEYS, "idx", "n", "y"), KEYS).select(*KEYS, "idx", "y"))


def clamped(source, value):
    """Jump clamp as a recursion over idx, with the adaptive limit of each pair."""
    return f"""sl AS (SELECT a.file_id, a.ref, a.tgt, median((b.{value} - a.{value}) / (b.idx - a.idx)) AS slope FROM {source} a JOIN {source} b ON a.file_id = b.file_id AND a.tgt = b.tgt AND a.idx < b.idx GROUP BY ALL),
lm AS (SELECT s.*, CASE WHEN n >= 3 AND abs(coalesce(slope, 0)) > 30 THEN ceil(1.5 * abs(slope)) ELSE 30.0 END AS lim FROM {source} s LEFT JOIN sl USING ({K})),
cj({K.replace(', ', ', ')}, idx, t_sec, y) AS (SELECT {K}, idx, t_sec, {value} FROM lm WHERE idx = 0 UNION ALL SELECT l.file_id, l.ref, l.tgt, l.idx, l.t_sec, least(greatest(l.{value}, c.y - l.lim), c.y + l.lim) FROM cj c JOIN lm l ON l.file_id = c.file_id AND l.tgt = c.tgt AND l.idx = c.idx + 1)"""


def recursive(text):
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("win_06", recursive(with_views(f"SELECT {K}, idx, i.n, round(c.y, 6) AS y FROM cj c JOIN ai i USING ({K}, idx)", WD, AN, clamped("ai", "y"))))
def win_06(spark, sf):
    return rounded(c.clamp_jumps(points(spark, sf).select(*KEYS, "idx", "n", "y"), KEYS))


OUTL = f"""ou AS (SELECT * FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY {K}) AS lft FROM (SELECT *, abs(y - median(y) OVER (PARTITION BY {K} ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) <= 30 AS ok FROM ai)) WHERE ok OR lft < 5)"""


@query("win_07", with_views(f"SELECT {K}, idx, round(y, 6) AS y FROM ou", WD, AN, OUTL))
def win_07(spark, sf):
    return rounded(c.drop_outliers(points(spark, sf).select(*KEYS, "idx", "y"), KEYS))


SMOOTH = f"""
sm AS (SELECT {K}, m * 20 + 30.0::DOUBLE AS t_sec, median(y) AS y FROM ai JOIN range(22) r(m) ON abs(t_sec - (m * 20 + 30)) <= 60 GROUP BY ALL HAVING count(*) >= 3),
sc AS (SELECT {K} FROM sm GROUP BY ALL HAVING count(*) >= 2),
sp AS (SELECT {K}, t_sec, y FROM sm WHERE (file_id, tgt) IN (SELECT file_id, tgt FROM sc) UNION ALL SELECT {K}, t_sec::DOUBLE, y FROM ai WHERE (file_id, tgt) NOT IN (SELECT file_id, tgt FROM sc))"""


def grid_sql(points, seconds):
    return f"""SELECT {K}, t AS t_sec, coalesce(py + (ny - py) * coalesce((t - pt) / nullif(nt - pt, 0), 0.0), py, ny) AS y FROM (SELECT *, last_value(y IGNORE NULLS) OVER a AS py, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER a AS pt, first_value(y IGNORE NULLS) OVER b AS ny, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER b AS nt FROM (
 SELECT {K}, t, max(y) AS y, bool_or(g) AS g FROM (SELECT {K}, t_sec::DOUBLE AS t, y, FALSE AS g FROM {points} UNION ALL SELECT DISTINCT {K}, i::DOUBLE, NULL, TRUE FROM {points}, range({seconds}) r(i)) GROUP BY ALL)
 WINDOW a AS (PARTITION BY {K} ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY {K} ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE g"""


@query("win_08", with_views(f"SELECT {K}, t_sec, round(least(greatest(y, -100), 100) + 1e-9, 6) AS y FROM ({grid_sql('sp', SECONDS)})", WD, AN, SMOOTH))
def win_08(spark, sf):
    curve = c.residual_curve(points(spark, sf).select(*KEYS, "t_sec", "y"), KEYS, seconds=SECONDS, span=60.0, hop=20.0)
    return rounded(curve.withColumn("y", F.col("y") + 1e-9))  # off the rounding ties of short decimals


def _halves(level):
    """One level of halving over rows (a, b, idx, t, d), as SQL."""
    src, out = f"h{level}", f"h{level + 1}"
    return (f"c{level} AS (SELECT {K}, a, b, (a + b) // 2 AS mid, max(t) FILTER (idx = a) AS c0, max(t) FILTER (idx = (a + b) // 2) AS c1, max(t) FILTER (idx = b - 1) AS c2, median(d) FILTER (idx < (a + b) // 2) AS ml, median(d) FILTER (idx >= (a + b) // 2) AS mr FROM {src} WHERE b - a >= 8 GROUP BY ALL), "
            f"{out} AS (SELECT h.* REPLACE (CASE WHEN c.mid IS NOT NULL AND idx >= c.mid THEN c.mid ELSE h.a END AS a, CASE WHEN c.mid IS NOT NULL AND idx < c.mid THEN c.mid ELSE h.b END AS b) FROM {src} h LEFT JOIN (SELECT * FROM c{level} WHERE c1 - c0 >= 2000000 AND c2 - c1 >= 2000000 AND abs(ml - mr) > 48) c ON c.file_id = h.file_id AND c.tgt = h.tgt AND c.a = h.a AND c.b = h.b)")


SEGMENTS = 4  # levels of halving; rows of a trajectory stay below 8 * 2**4 in the test data


@query("win_12", with_views(f"""SELECT {K}, segments, seam_gt_1, seam_gt_48, round(residual_p50, 6) AS residual_p50, round(residual_p90, 6) AS residual_p90 FROM (SELECT {K}, count(*) AS segments, count(*) FILTER (seam > 1) AS seam_gt_1, count(*) FILTER (seam > 48) AS seam_gt_48 FROM (SELECT *, abs(m - lag(m) OVER (PARTITION BY {K} ORDER BY a)) AS seam FROM sg) GROUP BY ALL)
 JOIN (SELECT {K}, median(abs(d - m)) AS residual_p50, quantile_cont(abs(d - m), 0.9) AS residual_p90 FROM h{SEGMENTS} JOIN sg USING ({K}, a) GROUP BY ALL) USING ({K})""",
    f"h0 AS (SELECT * FROM (SELECT {K}, center_sample AS t, delay_samples AS d, row_number() OVER (PARTITION BY {K} ORDER BY center_sample, frame_no) - 1 AS idx, 0::BIGINT AS a, count(*) OVER (PARTITION BY {K}) AS b FROM v_frame WHERE delay_samples IS NOT NULL) WHERE b >= 8)",
    *[_halves(k) for k in range(SEGMENTS)], f"sg AS (SELECT {K}, a, median(d) AS m FROM h{SEGMENTS} GROUP BY ALL)"))
def win_12(spark, sf):
    return rounded(c.piecewise_segments(view(spark, sf, "v_frame"), min_seg=2_000_000, threshold=48.0))


@query("win_13", recursive(with_views(f"SELECT {K}, t_sec, round(y + 1e-9, 6) AS y FROM ({grid_sql('cj', SECONDS)}) WHERE (file_id, tgt) NOT IN (SELECT file_id, tgt FROM cj WHERE abs(y) > 4800)", WD, AN, R7, clamped("r7", "m"))))
def win_13(spark, sf):
    curve = c.build_curve(windows(spark, sf), rate=RATE, seconds=SECONDS, bin_sec=BIN)
    return rounded(curve.withColumn("y", F.col("y") + 1e-9))



@query("win_14", with_views(f"""SELECT {K}, t_sec, round(y + 1e-9, 6) AS y FROM (SELECT a.file_id, a.ref, a.tgt, a.t_sec, a.y * 10 + coalesce(b.y, 0) AS y FROM ga a LEFT JOIN gb b ON a.file_id = b.file_id AND a.tgt = b.tgt AND a.t_sec = b.t_sec) WHERE (file_id, tgt) NOT IN
 (SELECT a.file_id, a.tgt FROM ga a LEFT JOIN gb b ON a.file_id = b.file_id AND a.tgt = b.tgt AND a.t_sec = b.t_sec WHERE abs(a.y * 10 + coalesce(b.y, 0)) > 4800)""", WD, AN, SMOOTH, f"ga AS MATERIALIZED ({grid_sql('an', SECONDS)})", f"gb AS MATERIALIZED ({grid_sql('sp', SECONDS)})"))
def win_14(spark, sf):
    base = points(spark, sf).select(*KEYS, "t_sec", "y")
    smooth = cut_lineage(c.smooth_residual(base, KEYS, duration=SECONDS, span=60.0, hop=20.0))
    total = c.add_curves(base, smooth, KEYS, SECONDS, gain=10)
    return rounded(total.withColumn("y", F.col("y") + 1e-9))
