"""Signal queries. Channel 0 of a file is its base blocks; channels 1..3 are it
delayed by 5, 12 and -7 samples, the last inverted."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions import pcm
from ..operators import signal as g
from ..operators.trajectory import KEYS
from . import query
from .trajectory import rounded

SIZE, RATE = 64, 8000.0
DELAYS = [(0, 0, 1), (1, 5, 1), (2, 12, 1), (3, -7, -1)]
PCM = f"""
full_x AS (SELECT file_id, flatten(list(samples ORDER BY block_no)) AS x FROM v_base GROUP BY ALL),
pcm AS (SELECT v.file_id, c.channel::BIGINT AS channel, block_no, [CASE WHEN block_no * 64 + i - c.d BETWEEN 0 AND len(x) - 1 THEN c.sg * x[block_no * 64 + i - c.d + 1] ELSE 0.0 END::DOUBLE for i in range(64)] AS samples
 FROM v_base v JOIN full_x USING (file_id) CROSS JOIN (VALUES {', '.join(map(str, DELAYS))}) c(channel, d, sg))"""


def blocks(spark, sf):
    base = view(spark, sf, "v_base")
    plan = F.array(*[F.struct(F.lit(c).cast("bigint").alias("channel"), F.lit(d).alias("d"), F.lit(s).alias("s")) for c, d, s in DELAYS])
    ranges = base.select("file_id", F.col("block_no").alias("out"), F.explode(plan).alias("c")).select(
        "file_id", "out", "c.*", (F.col("out") * SIZE - F.col("c.d")).alias("start"), F.lit(SIZE).cast("bigint").alias("count"))
    read = pcm.read_ranges(base, ranges, ["file_id"], SIZE)
    return read.select("file_id", "channel", F.col("out").alias("block_no"),
                       F.transform("samples", lambda x: (x * F.col("s")).cast("float")).alias("samples"))


ELIG_FILES = "SELECT o_orderkey AS file_id FROM orders"


@query("sig_01", with_views("""SELECT o_orderkey AS file_id, r IS NULL AS eligible, r AS reason, coalesce(channels, 0)::BIGINT AS channels FROM (SELECT o_orderkey, channels, CASE WHEN n IS NULL THEN 'no_audio_streams' WHEN pcm = 0 THEN 'non_pcm_audio' WHEN pcm < n THEN 'mixed_pcm_compressed_not_aligned' WHEN lo <> hi THEN 'mixed_sample_rates'
 WHEN lo NOT IN (44100, 48000, 96000) THEN 'unsupported_sample_rate' WHEN channels NOT BETWEEN 3 AND 8 THEN 'channel_count_out_of_range' END AS r FROM orders LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (codec_name LIKE 'pcm_%') AS pcm, min(sample_rate) AS lo, max(sample_rate) AS hi, sum(channels) AS channels FROM v_stream WHERE codec_type = 'audio' GROUP BY ALL) ON file_id = o_orderkey)"""))
def sig_01(spark, sf):
    return g.eligibility(view(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id")), view(spark, sf, "v_stream"))


@query("sig_02", with_views("""SELECT file_id, channel, k AS frame_no, k * 96 AS start, round(list_sum([x[i + 1]::DOUBLE for i in range(k * 96, k * 96 + 256)]), 6) AS total, round(x[k * 96 + 256]::DOUBLE, 6) AS last FROM ax JOIN range(200) r(k) ON k * 96 + 256 <= len(x)""", PCM,
                            "ax AS (SELECT file_id, channel, flatten(list(samples ORDER BY block_no)) AS x FROM pcm GROUP BY ALL)"))
def sig_02(spark, sf):
    b = blocks(spark, sf)
    ranges = pcm.frame_ranges(pcm.channel_lengths(b, g.CH, SIZE), 256, 96)
    x = F.col("samples")
    return rounded(pcm.read_ranges(b, ranges, g.CH, SIZE).select(
        *g.CH, "frame_no", "start", pcm.total(x).alias("total"), F.element_at(x, -1).cast("double").alias("last")))


@query("sig_03", with_views("""SELECT file_id, channel, count(*) AS blocks, round(max(pk), 6) AS peak_db, count(*) FILTER (db < -18) AS silent_blocks, round(quantile_cont(db, 0.1), 6) AS db_p10, round(median(db), 6) AS db_p50, round(quantile_cont(db, 0.9), 6) AS db_p90, any_value(l) * 0.5 AS longest_silent_sec, round(count(*) FILTER (db < -18) / count(*), 6) AS silent_fraction FROM lv
 JOIN (SELECT file_id, channel, coalesce(max(n) FILTER (s), 0)::DOUBLE AS l FROM (SELECT file_id, channel, s, gg, count(*) AS n FROM (SELECT file_id, channel, db < -18 AS s, block_no - row_number() OVER (PARTITION BY file_id, channel, db < -18 ORDER BY block_no) AS gg FROM lv) GROUP BY ALL) GROUP BY ALL) USING (file_id, channel) GROUP BY ALL""".replace("any_value(l) * 0.5", "any_value(l * 0.5)"), PCM,
    "lv AS (SELECT file_id, channel, block_no, 20 * log10(greatest(sqrt(list_sum([v * v for v in samples]) / 64), 1e-12)) AS db, 20 * log10(greatest(list_max([abs(v) for v in samples]), 1e-12)) AS pk FROM pcm)"))
def sig_03(spark, sf):
    return rounded(g.loudness(blocks(spark, sf), 0.5, -18.0))


CHANNELS = "ch AS MATERIALIZED (SELECT file_id, channel, flatten(list(samples ORDER BY block_no)) AS x FROM pcm GROUP BY ALL)"
# windowed sinc of 81 taps for every fourth sample, unit gain at zero
TAPS = """tp AS (SELECT list_transform(h, lambda v: v / list_sum(h)) AS taps FROM (SELECT [(CASE WHEN i = 0 THEN 1 ELSE sin(pi() * i / 4) / (pi() * i / 4) END) * (0.54::DOUBLE + 0.46::DOUBLE * cos(2 * pi() * i / 80)) for i in range(-40, 41)] AS h)),
fl AS (SELECT file_id, channel, (range // 16)::BIGINT AS block_no, list_inner_product(taps, [CASE WHEN 4 * range + j >= 0 THEN coalesce(x[4 * range + j + 1], 0.0) ELSE 0.0 END for j in range(-40, 41)])::FLOAT::DOUBLE AS v
 FROM ch, tp, range(1600) WHERE 4 * range < len(x))"""


def correlated(window, hop, lag):
    """Means removed and one correlation per lag of each window of channel 0 against another."""
    n = f"{window} - abs(lag)"
    return f"""wn AS MATERIALIZED (SELECT file_id, 0::BIGINT AS ref, b.channel AS tgt, k::BIGINT AS window_no, a.x[k * {hop} + 1:k * {hop} + {window}] AS a, b.x[k * {hop} + 1:k * {hop} + {window}] AS b
 FROM ch a JOIN ch b USING (file_id), range(1000) r(k) WHERE a.channel = 0 AND b.channel > 0 AND k * {hop} + {window} <= least(len(a.x), len(b.x))),
wz AS MATERIALIZED (SELECT *, sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS norm FROM (SELECT file_id, ref, tgt, window_no, a AS a0, b AS b0, list_transform(a, lambda v: v - list_avg(a)) AS a, list_transform(b, lambda v: v - list_avg(b)) AS b FROM wn)),
cr AS MATERIALIZED (SELECT file_id, ref, tgt, window_no, lag, list_inner_product(a[1 + greatest(-lag, 0):greatest(-lag, 0) + {n}], b[1 + greatest(lag, 0):greatest(lag, 0) + {n}]) / norm AS c FROM wz, range(-{lag}, {lag} + 1) l(lag) WHERE norm > 1e-12)"""


@query("sig_04", with_views("SELECT file_id, channel, block_no, count(*) AS n, round(sum(v ORDER BY v), 6) AS total FROM fl GROUP BY ALL", PCM, CHANNELS, TAPS))
def sig_04(spark, sf):
    coarse = g.decimated(blocks(spark, sf), SIZE, 4)
    return rounded(coarse.select(*g.CH, "block_no", F.size("samples").cast("bigint").alias("n"), pcm.total(F.col("samples")).alias("total")))


@query("sig_05")
def sig_05(spark, sf):
    return rounded(g.frame_delays(blocks(spark, sf), SIZE, frame=512, hop=256, search=32).drop("snr"))


@query("sig_06")
def sig_06(spark, sf):
    return rounded(g.two_stage_delays(blocks(spark, sf), SIZE, frame=512, hop=256, search=32, factor=4, min_confidence=0.3))


@query("sig_08")
def sig_08(spark, sf):
    b = blocks(spark, sf)
    est = g.pair_lengths(b, SIZE).select(*KEYS, F.element_at(F.array(F.lit(5.0), F.lit(12.0), F.lit(-7.0)), F.col("tgt").cast("int")).alias("delay_samples"))
    return rounded(g.fine_delay(b, est, SIZE, rate=RATE, segment=4096))


@query("sig_09")
def sig_09(spark, sf):
    return rounded(g.pair_strength(blocks(spark, sf), SIZE, frame=512, hop=256, search=32))


# direct sums over the overlap of two windows, against the library's transforms
NCC = """
nw AS (SELECT t.file_id, t.channel, w, w * 512 AS start, r.x[w * 512 + 1:w * 512 + 1024] AS p, t.x[w * 512 + 1:w * 512 + 1024] AS q FROM ax t JOIN ax r ON r.file_id = t.file_id AND r.channel = 0 AND t.channel > 0 JOIN range(100) s(w) ON w * 512 + 1024 <= len(t.x)),
nm AS (SELECT * REPLACE ([v - list_avg(p) for v in p] AS p, [v - list_avg(q) for v in q] AS q) FROM nw),
nc AS (SELECT file_id, channel, w, start, lag, list_dot_product(p[greatest(1, 1 - lag):least(1024, 1024 - lag)], q[greatest(1, 1 + lag):least(1024, 1024 + lag)]) / sqrt(list_dot_product(p, p) * list_dot_product(q, q)) AS cc FROM nm, range(-40, 41) l(lag))"""


@query("sig_10", with_views("SELECT file_id, 0::BIGINT AS ref, channel AS tgt, w AS window_no, start, arg_max(lag, abs(cc)) AS lag, round(arg_max(cc, abs(cc)), 6) AS cc, round(max(abs(cc)), 6) AS abs_cc FROM nc GROUP BY ALL", PCM,
                            "ax AS (SELECT file_id, channel, flatten(list(samples ORDER BY block_no)) AS x FROM pcm GROUP BY ALL)", NCC))
def sig_10(spark, sf):
    return rounded(g.window_peaks(blocks(spark, sf), SIZE, window=1024, hop=512, search=40))


@query("sig_11", with_views("""SELECT file_id, 0::BIGINT AS ref, channel AS tgt, w AS window_no, coalesce(arg_max(lag, (round(abs(cc), 9), -lag)) FILTER (cc IS NOT NULL), w % 3 + 4) AS lag, round(coalesce(max(abs(cc)), 0.0), 6) AS quality FROM (
 SELECT *, CASE WHEN c0 + lag >= 0 AND c0 + lag + 128 <= s + 512 THEN (ab - sa * sb / 128) / sqrt((aa - sa * sa / 128) * (bb - sb * sb / 128)) END AS cc FROM (
 SELECT file_id, channel, w, s, c0, lag, list_sum(a) AS sa, list_sum(b) AS sb, list_sum([v * v for v in a]) AS aa, list_sum([v * v for v in b]) AS bb, list_sum([a[i] * b[i] for i in range(1, 129)]) AS ab FROM (
 SELECT t.file_id, t.channel, w, w * 512 AS s, w * 512 + 192 AS c0, lag, [r.x[w * 512 + 192 + i + 1] for i in range(128)] AS a, [CASE WHEN w * 512 + 192 + lag + i BETWEEN 0 AND len(t.x) - 1 THEN t.x[w * 512 + 192 + lag + i + 1] ELSE 0.0 END for i in range(128)] AS b
 FROM ax t JOIN ax r ON r.file_id = t.file_id AND r.channel = 0 AND t.channel > 0 JOIN range(100) q(w) ON w * 512 + 512 <= len(t.x) JOIN range(-10, 20) l(lag) ON abs(lag - (w % 3 + 4)) <= 3))) GROUP BY file_id, channel, w""", PCM,
    "ax AS (SELECT file_id, channel, flatten(list(samples ORDER BY block_no)) AS x FROM pcm GROUP BY ALL)"))
def sig_11(spark, sf):
    b = blocks(spark, sf)
    coarse = g.window_ranges(g.pair_lengths(b, SIZE), 512, 512).select(*KEYS, "window_no", "start", (F.col("window_no") % 3 + 4).alias("lag"))
    return rounded(g.refine(b, coarse, SIZE, window=512, segment=128, radius=3))


@query("sig_12")
def sig_12(spark, sf):
    found = g.follow_delays(blocks(spark, sf), SIZE, rate=RATE, window=1024, hop=512, search=40, factor=2, radius=6)
    return rounded(found)


@query("sig_13", with_views(f"""SELECT file_id, ref, tgt, window_no, round(lag + CASE WHEN lag > -64 AND lag < 64 AND y0 - 2 * c + y2 <> 0 THEN greatest(-0.5, least(0.5, 0.5 * (y0 - y2) / (y0 - 2 * c + y2))) ELSE 0 END, 6)::DOUBLE AS delay_samples, round(c, 6) AS cc, round(side, 6) AS peak_to_sidelobe,
 why IS NULL AS qualified, why AS reason FROM (SELECT *, CASE WHEN lag IS NULL THEN 'verifier_zero_variance' WHEN least(da, db) < -50 THEN 'verifier_no_signal' WHEN NOT coalesce(side >= 1.5, false) THEN 'verifier_ambiguous_peak' END AS why FROM (
 SELECT w.*, p.lag, p.c, (SELECT c FROM cr WHERE cr.file_id = p.file_id AND cr.tgt = p.tgt AND cr.window_no = p.window_no AND cr.lag = p.lag - 1) AS y0, (SELECT c FROM cr WHERE cr.file_id = p.file_id AND cr.tgt = p.tgt AND cr.window_no = p.window_no AND cr.lag = p.lag + 1) AS y2,
 p.c / (SELECT CASE WHEN max(c) > 0 THEN max(c) END FROM cr WHERE cr.file_id = p.file_id AND cr.tgt = p.tgt AND cr.window_no = p.window_no AND abs(cr.lag - p.lag) > 24) AS side
 FROM (SELECT file_id, ref, tgt, window_no, 10 * log10(list_inner_product(a0, a0) / {{n}}) AS da, 10 * log10(list_inner_product(b0, b0) / {{n}}) AS db FROM wz) w
 LEFT JOIN (SELECT file_id, tgt, window_no, arg_max(lag, (c, -lag)) AS lag, max(c) AS c FROM cr GROUP BY ALL) p ON p.file_id = w.file_id AND p.tgt = w.tgt AND p.window_no = w.window_no))""".format(n=1024), PCM, CHANNELS, correlated(1024, 1024, 64)))
def sig_13(spark, sf):
    return rounded(g.independent_delays(blocks(spark, sf), SIZE, window=1024, hop=1024, max_lag=64))


@query("sig_14", with_views("""SELECT file_id, channel, block_no, round(greatest(e - coalesce(lag(e) OVER (PARTITION BY file_id, channel ORDER BY block_no), e), 0.0), 6) AS onset FROM (SELECT file_id, channel, block_no, ln(sqrt(list_sum([v * v for v in samples]) / 64) + 1e-9) AS e FROM pcm)""", PCM))
def sig_14(spark, sf):
    return rounded(g.onsets(blocks(spark, sf)))


CAND = "SELECT user_id AS file_id, floor(event_id / 500)::BIGINT AS window_no, event_id AS method, round(value / 60)::BIGINT AS delay, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS quality FROM events"


@query("sig_15", f"""SELECT file_id, window_no, floor(median(delay))::BIGINT AS delay, max(quality) AS quality, count(*) AS n_methods, max(delay) - min(delay) AS spread FROM c JOIN b USING (file_id, window_no) WHERE abs(delay - center) <= 2 GROUP BY ALL""".replace("SELECT file_id, window_no, floor", f"WITH c AS ({CAND}), b AS (SELECT file_id, window_no, arg_max(delay, (k, q, -delay)) AS center FROM (SELECT *, count(*) OVER w AS k, round(sum(quality) OVER w, 9) AS q FROM c WINDOW w AS (PARTITION BY file_id, window_no ORDER BY delay RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) GROUP BY ALL) SELECT file_id, window_no, floor", 1))
def sig_15(spark, sf):
    rows = view(spark, sf, "events").selectExpr(
        "user_id AS file_id", "CAST(floor(event_id / 500) AS BIGINT) AS window_no", "event_id AS method", "CAST(round(value / 60) AS BIGINT) AS delay",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS quality")
    return g.agreement(rows, ["file_id", "window_no"])


@query("sig_16", with_views("""SELECT file_id, tgt, count(*) FILTER (confidence >= 0.3) AS correlated, count(*) FILTER (confidence >= 0.1 AND confidence < 0.3) AS weak, count(*) FILTER (confidence < 0.1) AS uncorrelated, max(lag) - min(lag) AS lag_spread, round(quantile_cont(confidence, 0.1), 6) AS ncc_p10, round(median(confidence), 6) AS ncc_p50, round(quantile_cont(confidence, 0.9), 6) AS ncc_p90,
 round(median(lag), 6)::DOUBLE AS lag_median FROM (SELECT *, CAST(floor(delay_samples) AS BIGINT) AS lag FROM v_frame WHERE delay_samples IS NOT NULL) GROUP BY ALL"""))
def sig_16(spark, sf):
    rows = view(spark, sf, "v_frame").where("delay_samples IS NOT NULL").select(
        "file_id", "tgt", F.col("confidence").alias("ncc"), F.floor("delay_samples").alias("lag"))
    return rounded(g.correlation_summary(rows, ["file_id", "tgt"]))


VOTE = """vt AS (SELECT file_id, ref, tgt, count(*) FILTER (abs(cc) >= 0.25) AS votes, count(*) FILTER (abs(cc) >= 0.25 AND cc < 0) AS negative, coalesce(median(abs(cc)) FILTER (abs(cc) >= 0.25), 0.0) AS median_abs_cc FROM (SELECT file_id, CASE WHEN tgt = 2 THEN 1 ELSE 0 END::BIGINT AS ref, CASE WHEN tgt = 1 THEN 1 ELSE 2 END::BIGINT AS tgt,
 (CASE WHEN file_id % 4 = 0 AND tgt < 3 THEN -1 ELSE 1 END) * (value + 40) / 530 AS cc FROM (SELECT user_id AS file_id, 1 + event_id % 3 AS tgt, value FROM events)) GROUP BY ALL),
vf AS (SELECT *, coalesce(negative / nullif(votes, 0), 0.0) AS negative_ratio, votes > 0 AND coalesce(negative / nullif(votes, 0), 0.0) >= 0.8 AND median_abs_cc >= 0.25 AS flip FROM vt)"""


def votes(spark, sf):
    rows = view(spark, sf, "events").selectExpr("user_id AS file_id", "1 + event_id % 3 AS t", "value").selectExpr(
        "file_id", "CAST(CASE WHEN t = 2 THEN 1 ELSE 0 END AS BIGINT) AS ref", "CAST(CASE WHEN t = 1 THEN 1 ELSE 2 END AS BIGINT) AS tgt",
        "(CASE WHEN file_id % 4 = 0 AND t < 3 THEN -1 ELSE 1 END) * (value + 40) / 530 AS cc")
    return g.polarity_votes(rows, KEYS)


@query("sig_17", f"WITH {VOTE} SELECT file_id, ref, tgt, votes, negative, round(median_abs_cc, 6) AS median_abs_cc, round(negative_ratio, 6) AS negative_ratio, flip FROM vf")
def sig_17(spark, sf):
    return rounded(votes(spark, sf))


@query("sig_17_triangles", f"WITH {VOTE} SELECT file_id, max(CASE WHEN ref = 0 AND tgt = 1 THEN CASE WHEN flip THEN -1 ELSE 1 END END) * max(CASE WHEN ref = 1 AND tgt = 2 THEN CASE WHEN flip THEN -1 ELSE 1 END END) * max(CASE WHEN ref = 0 AND tgt = 2 THEN CASE WHEN flip THEN -1 ELSE 1 END END) > 0 AS consistent FROM vf GROUP BY ALL")
def sig_17_triangles(spark, sf):
    return g.polarity_triangles(votes(spark, sf))


@query("sig_18")
def sig_18(spark, sf):
    return rounded(g.recheck(blocks(spark, sf), SIZE, windows=3, segment=4096, search=40, rate=RATE))


SCORED = """st AS (SELECT unnest([0, 1, 2, 3])::BIGINT AS set_id, unnest([[0, 5, 12, -7], [0, 5, 12, 7], [0, 0, 0, 0], [0, 6, 11, -5]]) AS shifts),
pw AS MATERIALIZED (SELECT file_id, a.channel AS ref, b.channel AS tgt, k AS window_no, a.x[s + 1:s + 1024] AS a, b.x[s + 1:s + 1024] AS b FROM ch a JOIN ch b USING (file_id), range(24) r(k), LATERAL (SELECT ((least(len(a.x), len(b.x)) - 1024) * k // 23)::BIGINT AS s) WHERE a.channel < b.channel),
lg AS (SELECT DISTINCT ref, tgt, shifts[tgt + 1] - shifts[ref + 1] + o AS lag FROM (SELECT DISTINCT ref, tgt FROM pw), st, range(-6, 7) q(o)),
cl AS (SELECT file_id, ref, tgt, window_no, lag, a[1 + greatest(-lag, 0):greatest(-lag, 0) + 1024 - abs(lag)] AS a, b[1 + greatest(lag, 0):greatest(lag, 0) + 1024 - abs(lag)] AS b FROM pw JOIN lg USING (ref, tgt)),
cc AS MATERIALIZED (SELECT file_id, ref, tgt, window_no, lag, CASE WHEN sqrt(va * vb) >= 1e-9 THEN ab / sqrt(va * vb) ELSE 0 END AS c FROM (SELECT file_id, ref, tgt, window_no, lag, list_inner_product(a, b) - list_sum(a) * list_sum(b) / len(a) AS ab,
 list_inner_product(a, a) - list_sum(a) * list_sum(a) / len(a) AS va, list_inner_product(b, b) - list_sum(b) * list_sum(b) / len(b) AS vb FROM cl)),
wd AS (SELECT file_id, ref, tgt, set_id, window_no, max(CASE WHEN o = 0 THEN c END) AS c, arg_max(c, (round(abs(c), 12), -o)) AS best, arg_max(o, (round(abs(c), 12), -o)) AS off
 FROM cc JOIN (SELECT set_id, ref, tgt, o, shifts[tgt + 1] - shifts[ref + 1] + o AS lag FROM st, range(-6, 7) q(o), (SELECT DISTINCT ref, tgt FROM pw)) USING (ref, tgt, lag) GROUP BY ALL),
pp AS (SELECT file_id, ref, tgt, set_id, median(abs(c)) AS at_lag, median(abs(best)) AS near_lag, avg((best > 0)::INT) AS pos, trunc(median(off))::BIGINT AS off FROM wd GROUP BY ALL)"""


@query("sig_19", with_views("SELECT file_id, set_id, round(sum(at_lag), 6) AS score, round(avg(near_lag), 6) AS near_score, round(avg(greatest(pos, 1 - pos)), 6) AS sign_consistency, string_agg(off::VARCHAR, ',' ORDER BY ref, tgt) AS offsets FROM pp GROUP BY ALL", PCM, CHANNELS, SCORED))
def sig_19(spark, sf):
    b = blocks(spark, sf)
    sets = F.array(*[F.struct(F.lit(i).cast("bigint").alias("set_id"), F.array(*[F.lit(v).cast("bigint") for v in s]).alias("shifts"))
                     for i, s in enumerate([(0, 5, 12, -7), (0, 5, 12, 7), (0, 0, 0, 0), (0, 6, 11, -5)])])
    candidates = b.select("file_id").distinct().select("file_id", F.explode(sets).alias("c")).select("file_id", "c.*")
    scored = g.score_offsets(b, candidates, SIZE, window=1024, n_windows=24, search=6)
    return rounded(scored.withColumn("offsets", F.array_join(F.transform("offsets", lambda v: v.cast("string")), ",")))
