"""Decision queries."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import decide as d
from ..operators.trajectory import is_aligned
from . import query
from .experiments import TR, tracks
from .preserve import table_sql
from .trajectory import rounded

GATE = {"min_usable_frames": 5, "min_confidence": 0.3, "min_usable_fraction": 0.5}


@query("dec_02", with_views("SELECT track_id, abs(delay_ms) < 30 OR abs(delay_ms * 0.1) < 1 OR abs(round_even(delay_ms * 0.1, 0)) <= 5 AS aligned FROM v_track_a"))
def dec_02(spark, sf):
    ms = F.col("delay_ms")
    return view(spark, sf, "v_track_a").select("track_id", is_aligned(ms, ms * 0.1, 30, 5).alias("aligned"))


@query("dec_03", with_views("""SELECT track_id, m AS material, round(CASE WHEN m THEN CASE WHEN displacement_ms > 0 THEN dm / displacement_ms ELSE 1e9 END END + 1e-9, 6) AS ratio FROM (SELECT *, dm >= 3 * displacement_ms AS m FROM (SELECT *, delay_samples * 1000 / 48000 AS dm FROM tr))""", TR))
def dec_03(spark, sf):
    m = d.materiality(F.col("delay_samples"), F.col("displacement_ms"), 48000.0, 3.0)
    return rounded(tracks(spark, sf).select("track_id", m["material"].alias("material"), F.when(m["ratio"] > 1e9, 1e9).otherwise(m["ratio"] + 1e-9).alias("ratio")))


AG_T = "SELECT o_orderkey AS track_id, CAST(o_orderkey % 900 AS DOUBLE) AS delay_samples, CAST(o_orderkey % 900 + o_custkey % 7 AS DOUBLE) AS shift_samples FROM orders"
AG_W = "SELECT l_orderkey AS track_id, l_linenumber AS window_no, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE (l_orderkey % 900 + l_quantity / 10) / 48 END AS value_ms FROM lineitem"


@query("dec_04", f"""SELECT track_id, round(ind, 6) AS independent, round(sd, 6) AS spread_ms, round(tol, 6) AS tolerance, CASE WHEN sig > greatest(2.0, rel) THEN 'sigma' WHEN rel > 2 THEN 'relative' ELSE 'absolute' END AS basis, round(abs(ind - shift_samples), 6) AS diff, coalesce(round(abs(ind - shift_samples), 9) <= tol, TRUE) AS accepted FROM (
 SELECT *, greatest(2.0::DOUBLE, rel, sig) AS tol FROM (SELECT *, v[len(v) // 2 + 1] * 48 AS ind, round(0.01::DOUBLE * abs(delay_samples), 9) AS rel, round(coalesce(3 * sd * 48, 0.0), 9) AS sig FROM ({AG_T}) LEFT JOIN (SELECT track_id, list(value_ms ORDER BY value_ms) AS v, stddev_samp(value_ms) AS sd FROM ({AG_W}) WHERE value_ms IS NOT NULL GROUP BY ALL) USING (track_id)))""")
def dec_04(spark, sf):
    return rounded(d.agreement(table_sql(spark, sf, AG_W, "lineitem"), table_sql(spark, sf, AG_T, "orders"), absolute=2, relative=0.01, sigma=3, rate=48000.0))


EL = """SELECT o_orderkey AS track_id, CASE o_orderkey % 8 WHEN 0 THEN 'low_confidence' WHEN 1 THEN 'failed' WHEN 2 THEN NULL WHEN 3 THEN 'odd' ELSE 'success' END AS status, CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 13 = 0 THEN o_totalprice * 1e7 ELSE o_totalprice / 1000 END AS offset_samples,
 o_orderkey % 12 AS usable_frames, CAST(12 AS BIGINT) AS total_frames, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE (o_custkey % 10) / 10.0{d} END AS coverage, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE (o_orderkey % 10) / 10.0{d} END AS confidence, CASE WHEN o_custkey % 7 = 0 THEN 'none' ELSE 'apply' END AS application FROM orders"""


@query("dec_05", f"""SELECT track_id, den IS NULL AS eligible, den AS denied, CASE WHEN den IS NULL THEN CAST(round_even(offset_samples, 0) AS BIGINT) END AS offset_samples FROM (SELECT *, CASE WHEN status IS NULL OR status = 'odd' THEN 'sync_status_unknown' WHEN status <> 'success' THEN concat('sync_', status) WHEN offset_samples IS NULL THEN 'sync_offset_missing' WHEN abs(offset_samples) >= 2147483648 THEN 'sync_offset_invalid'
 WHEN coalesce(usable_frames < 5, FALSE) OR coalesce(confidence < 0.3, FALSE) OR coalesce(coverage, usable_frames / total_frames) < 0.5 THEN 'sync_evidence_insufficient' WHEN application = 'none' THEN 'sync_application_none' END AS den FROM ({EL.replace('{d}', '::DOUBLE')}))""")
def dec_05(spark, sf):
    return d.eligibility(table_sql(spark, sf, EL.replace("{d}", "D"), "orders"), GATE).select("track_id", "eligible", "denied", "offset_samples")


ST = "SELECT file_id, track_id AS audio_position, decision, reason, usable_frames, (track_id % 10) / 10.0{d} AS confidence, CASE WHEN track_id % 3 = 0 THEN NULL ELSE (track_id % 7) / 7.0{d} END AS coverage FROM {v} WHERE track_id % 4 <> 0"


@query("jon_15", with_views(f"""SELECT t.file_id, t.track_id AS audio_position, coalesce(status, 'not_processed') AS status, coalesce(r.reason, r.decision) AS reason FROM v_track_a t LEFT JOIN (SELECT *, CASE WHEN base = 'success' AND coverage IS NOT NULL AND (usable_frames < 5 OR confidence < 0.3 OR coverage < 0.5) THEN 'low_confidence' ELSE base END AS status FROM (
 SELECT *, CASE WHEN reason = 'low_confidence' THEN 'low_confidence' WHEN reason = 'non_constant' THEN 'non_constant' WHEN reason = 'out_of_range' THEN 'out_of_range' WHEN reason = 'recheck_residual' THEN 'recheck_failed' WHEN decision = 'fixed' THEN 'success' WHEN decision IN ('already_aligned', 'anchor') THEN 'already_aligned' ELSE 'failed' END AS base
 FROM ({ST.format(d='::DOUBLE', v='v_track_b')}))) r ON r.file_id = t.file_id AND r.audio_position = t.track_id"""))
def jon_15(spark, sf):
    rows = view(spark, sf, "v_track_b").where("track_id % 4 <> 0").selectExpr(
        "file_id", "track_id AS audio_position", "decision", "reason", "usable_frames", "(track_id % 10) / 10.0D AS confidence",
        "CASE WHEN track_id % 3 = 0 THEN NULL ELSE (track_id % 7) / 7.0D END AS coverage")
    positions = view(spark, sf, "v_track_a").select("file_id", F.col("track_id").alias("audio_position"))
    return d.attach_status(positions, rows, GATE)


@query("jon_11", with_views("""SELECT t.file_id, t.track_id, r.track_id AS ref_id, round(CASE WHEN r.decision = 'fixed' THEN r.usable_frames ELSE 0 END + t.mad_ms, 6)::DOUBLE AS composed_samples FROM v_track_a t JOIN (SELECT file_id, min(track_id) AS rid FROM v_track_a GROUP BY ALL) m USING (file_id) JOIN v_track_a r ON r.track_id = m.rid
 WHERE t.decision = 'untouched' AND r.decision IN ('fixed', 'already_aligned') AND t.track_id % 9 <> 0 AND NOT (r.decision = 'fixed' AND r.track_id % 4 = 0)"""))
def jon_11(spark, sf):
    a = view(spark, sf, "v_track_a")
    shift = F.when(F.col("decision") == "fixed", F.when(F.col("track_id") % 4 == 0, F.col("usable_frames") + 0.5).otherwise(F.col("usable_frames").cast("double")))
    decisions = a.select("file_id", "track_id", "decision", shift.alias("shift_samples"))
    # every track was measured against the first one of its file
    refs = a.groupBy("file_id").agg(F.min("track_id").alias("ref_id"))
    pairs = a.join(refs, "file_id").select("file_id", "track_id", "ref_id", F.when(F.col("track_id") % 9 != 0, F.col("mad_ms")).alias("delay_samples"))
    return rounded(d.compose_reference(decisions, pairs))


# strength of channel pairs: node = file * 8 + channel
EDGES = "SELECT l_orderkey * 8 + l_linenumber AS a, l_orderkey * 8 + 1 + l_suppkey % 7 AS b, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 1.0 + l_discount * 6 END AS median, CAST(l_quantity AS BIGINT) AS samples FROM lineitem"
COMP = f"""
ed AS (SELECT DISTINCT a, b FROM ({EDGES}) WHERE median >= 1.3 AND samples >= 20 AND a <> b),
reach(node, label) AS (SELECT node, node FROM (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS node FROM lineitem UNION SELECT b FROM ed) UNION SELECT r.node, x.q FROM reach r JOIN (SELECT a AS p, b AS q FROM ed UNION SELECT b, a FROM ed) x ON x.p = r.label),
comp AS (SELECT node, min(label) AS label FROM reach GROUP BY node)"""


def groups(spark, sf, place):
    """Groups of every file; ``place`` orders the candidates for an anchor."""
    pairs = table_sql(spark, sf, EDGES, "lineitem")
    edges = d.pair_edges(pairs, 1.3, 20).select(F.floor(F.col("a") / 8).alias("file_id"), (F.col("a") % 8).alias("a"), (F.col("b") % 8).alias("b"))
    # a linked track that the stream list lacks may be an anchor too
    tracks = view(spark, sf, "v_stream").select("file_id", F.col("stream_index").alias("track")).unionByName(
        edges.select("file_id", F.col("b").alias("track"))).withColumn("place", place(F.col("file_id") * 8 + F.col("track")))
    found = d.file_groups(tracks, edges)
    return found.select("file_id", F.explode("groups").alias("g")).select("file_id", "g.*")


@query("dec_06", f"WITH RECURSIVE {COMP} SELECT node, label FROM comp")
def dec_06(spark, sf):
    """Label of every track, one aggregation per file."""
    found = groups(spark, sf, lambda node: F.lit(None)).withColumn("member", F.explode("members"))
    return found.select((F.col("file_id") * 8 + F.col("member")).alias("node"), (F.col("file_id") * 8 + F.col("label")).alias("label"))


@query("dec_06_global", f"WITH RECURSIVE {COMP} SELECT node, label FROM comp")
def dec_06_global(spark, sf):
    """The same over one graph of unbounded size, by contraction in written rounds."""
    edges = d.pair_edges(table_sql(spark, sf, EDGES, "lineitem"), 1.3, 20)
    return d.connected_groups(table_sql(spark, sf, "SELECT l_orderkey * 8 + l_linenumber AS node FROM lineitem", "lineitem"), edges)


@query("dec_07", f"WITH RECURSIVE {COMP} SELECT label, arg_min(node, (CASE WHEN node % 3 = 0 THEN (node * 5) % 8 ELSE 1000000 END, node)) AS anchor, count(*) AS n_members FROM comp GROUP BY label")
def dec_07(spark, sf):
    """Anchor of every group, by candidate order; same plan."""
    found = groups(spark, sf, lambda node: F.when(node % 3 == 0, (node * 5) % 8))
    named = lambda c: (F.col("file_id") * 8 + F.col(c)).alias(c)
    return found.select(named("label"), named("anchor"), F.size("members").cast("bigint").alias("n_members"))


@query("dec_08", """WITH RECURSIVE e AS (SELECT user_id AS file_id, event_id % 3 AS a, 3 + event_id % 2 AS b, event_type <> 'error' AS valid, CASE WHEN user_id % 2 = 0 THEN value / 200 ELSE value END AS d, 0.9::DOUBLE + (event_id % 10) / 100.0::DOUBLE AS cc FROM events),
g AS (SELECT file_id, a, b, 1.4::DOUBLE + (sum(a) % 5)::DOUBLE / 10 AS median, count(*) AS n, count(*) FILTER (valid) AS v, quantile_cont(d, 0.9) FILTER (valid) - quantile_cont(d, 0.1) FILTER (valid) AS span, median(abs(cc)) FILTER (valid) AS acc,
 avg((cc > 0)::INT) FILTER (valid) AS positive FROM e GROUP BY ALL),
c AS (SELECT file_id, a, b, row_number() OVER (PARTITION BY file_id ORDER BY median DESC, a DESC, b DESC) AS k FROM g WHERE median >= 1.5 AND n >= 8 AND v >= greatest(8, n // 2) AND acc >= 0.9 AND span <= 5
 AND greatest(positive, 1 - positive) >= 0.95 AND (file_id % 7 = a) = (file_id % 7 = b)),
w AS (SELECT DISTINCT file_id, 0::BIGINT AS k, 0::BIGINT AS used, NULL::BIGINT AS a, NULL::BIGINT AS b FROM c UNION ALL
 SELECT c.file_id, c.k, CASE WHEN (used & ((1::BIGINT << c.a) | (1::BIGINT << c.b))) = 0 THEN used | (1::BIGINT << c.a) | (1::BIGINT << c.b) ELSE used END, CASE WHEN (used & ((1::BIGINT << c.a) | (1::BIGINT << c.b))) = 0 THEN c.a END,
 CASE WHEN (used & ((1::BIGINT << c.a) | (1::BIGINT << c.b))) = 0 THEN c.b END FROM w JOIN c ON c.file_id = w.file_id AND c.k = w.k + 1)
SELECT file_id, a, b FROM w WHERE a IS NOT NULL""")
def dec_08(spark, sf):
    base = view(spark, sf, "events").selectExpr(
        "user_id AS file_id", "event_id % 3 AS a", "3 + event_id % 2 AS b", "event_type <> 'error' AS valid",
        "CASE WHEN user_id % 2 = 0 THEN value / 200 ELSE value END AS delay_samples", "0.9 + (event_id % 10) / 100.0D AS signed_cc")
    strengths = base.groupBy("file_id", "a", "b").agg(
        (1.4 + (F.sum("a") % 5) / 10).alias("median"), F.count(F.lit(1)).alias("samples"))
    storages = base.selectExpr("file_id", "explode(array(a, b)) AS channel").distinct().withColumn(
        "storage", F.when(F.col("file_id") % 7 == F.col("channel"), "s16").otherwise("s24"))
    return d.bind_pairs(d.rigid_pairs(base, strengths, min_samples=8, storages=storages))


@query("dec_09")
def dec_09(spark, sf):
    rows = view(spark, sf, "lineitem").selectExpr("l_partkey AS file_id", "l_suppkey % 4 AS x", "l_linenumber % 4 AS y", "l_quantity AS q")
    pairs = rows.where("x < y").groupBy("file_id", F.col("x").alias("a"), F.col("y").cast("bigint").alias("b")).agg(
        F.max((F.col("y") - F.col("x")) * 7.0 + F.when(F.col("q") > 49, 40.0).otherwise(0.0)).alias("delay"), F.count(F.lit(1)).cast("double").alias("weight"))
    return d.solve_offsets(pairs)


@query("dec_10")
def dec_10(spark, sf):
    f = view(spark, sf, "v_frame").where("delay_samples IS NOT NULL").selectExpr(
        "file_id", "tgt", "CAST(center_sample AS DOUBLE) AS t", "center_sample * 1e-6 + CASE WHEN frame_no % 4 = 0 THEN delay_samples ELSE delay_samples / 400 END AS y", "confidence + 0.01 AS w")
    lines = d.robust_lines(f, ["file_id", "tgt"])
    return rounded(lines.withColumn("slope_ppm", F.col("slope") * 1e6).drop("slope"))


XT = "SELECT o_custkey AS file_id, o_orderkey AS track_id, o_orderkey % 5 - 2 AS shift_samples, (o_orderkey % 11) / CASE WHEN o_custkey % 3 = 0 THEN 12.0{d} ELSE 5.0{d} END AS residual_samples FROM orders"


@query("dec_25", f"""SELECT file_id, track_id, tier, NOT none AND abs(shift_samples) > tier AS keep, CASE WHEN none THEN 'residual exceeds tier 2' WHEN abs(shift_samples) <= tier THEN concat('|shift| <= ', tier) END AS dropped FROM x JOIN (SELECT file_id, CASE WHEN NOT b1 THEN 1 WHEN NOT b2 THEN 2 ELSE 5 END::BIGINT AS tier, b1 AND b2 AS none FROM (
 SELECT file_id, bool_or(abs(shift_samples) > 1 AND residual_samples > 1) AS b1, bool_or(abs(shift_samples) > 2 AND residual_samples > 2) AS b2 FROM x GROUP BY ALL)) USING (file_id)""".replace("SELECT file_id, track_id, tier", f"WITH x AS ({XT.format(d='::DOUBLE')}) SELECT file_id, track_id, tier", 1))
def dec_25(spark, sf):
    return d.accurate_tier(table_sql(spark, sf, XT.format(d="D"), "orders"))


@query("dec_23", with_views("""SELECT file_id, count(*) AS n_off, string_agg(reason, ',' ORDER BY reason) AS reasons, CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT DISTINCT file_id, reason FROM v_track_a WHERE decision = 'untouched' AND abs(delay_ms) >= 5000.0 / 48000) GROUP BY ALL""")
    .replace("count(*) AS n_off, string_agg", "any_value(n) AS n_off, string_agg").replace("SELECT DISTINCT file_id, reason FROM v_track_a", "SELECT file_id, reason, sum(count(*)) OVER (PARTITION BY file_id)::BIGINT AS n FROM v_track_a")
    .replace("48000) GROUP BY ALL", "48000 GROUP BY file_id, reason) GROUP BY file_id"))
def dec_23(spark, sf):
    from ..operators.experiments import OFF_MS
    off = view(spark, sf, "v_track_a").where((F.col("decision") == "untouched") & (F.abs("delay_ms") >= OFF_MS))
    # reasons are a short list of codes; tracks of one file are only counted
    return off.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_off"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.lit("WARN").alias("verdict"))
