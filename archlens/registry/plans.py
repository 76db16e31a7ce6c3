"""Plan queries: selection, mapping, packets, formats, mixing, applied shifts."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions import pcm
from ..operators import signal as g, windows as w
from ..plans import apply as ap, audio as a, track_decision as td
from ..session import cut_lineage
from . import query
from .preserve import table_sql
from .signal import PCM, RATE, SIZE, blocks
from .trajectory import rounded

POL = "SELECT file_id AS plan_id, CASE file_id % 4 WHEN 0 THEN 'enabled' WHEN 1 THEN 'disabled' ELSE 'auto' END AS requested, CASE WHEN codec_type = 'audio' THEN CASE WHEN file_id % 5 < 2 THEN 'pcm_s24le' ELSE codec_name END END AS codec_name FROM v_stream"


def policy_rows(spark, sf):
    return view(spark, sf, "v_stream").selectExpr(
        "file_id AS plan_id", "CASE file_id % 4 WHEN 0 THEN 'enabled' WHEN 1 THEN 'disabled' ELSE 'auto' END AS requested",
        "CASE WHEN codec_type = 'audio' THEN CASE WHEN file_id % 5 < 2 THEN 'pcm_s24le' ELSE codec_name END END AS codec_name")


@query("dec_16", with_views("""SELECT plan_id, requested, reason, reason IN ('alignment_enabled_pcm', 'alignment_default_pcm') AS enabled, reason = 'alignment_enabled_rejected_non_pcm' AS refused FROM (SELECT plan_id, requested, CASE WHEN n = 0 THEN 'audio_alignment_no_channels' WHEN requested = 'disabled' THEN 'alignment_disabled_by_request'
 WHEN requested = 'enabled' THEN CASE WHEN pcm < n THEN 'alignment_enabled_rejected_non_pcm' ELSE 'alignment_enabled_pcm' END WHEN pcm = n THEN 'alignment_default_pcm' WHEN pcm > 0 THEN 'alignment_default_mixed' ELSE 'alignment_default_compressed' END AS reason
 FROM (SELECT plan_id, max(requested) AS requested, count(codec_name) AS n, count(*) FILTER (codec_name LIKE 'pcm%') AS pcm FROM p GROUP BY ALL))""", f"p AS ({POL})"))
def dec_16(spark, sf):
    return a.alignment_policy(policy_rows(spark, sf))


FST = "SELECT file_id AS plan_id, stream_index AS output_index, CASE stream_index % 5 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' WHEN 2 THEN 'flac' WHEN 3 THEN 'pcm_s16le' ELSE 'mp3' END AS codec_name, CASE WHEN file_id % 3 = 0 THEN 0 ELSE tag_key * 100 END AS bit_rate FROM v_stream"
FRQ = "SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 7 = 0 THEN 'aac' WHEN o_orderkey % 11 = 0 THEN 'flac' END AS format_request, CASE WHEN o_orderkey % 13 = 0 THEN '192k' WHEN o_orderkey % 2 = 0 THEN '' END AS bitrate_request FROM orders"


@query("dec_17", with_views("""SELECT plan_id, format, codec_origin, bitrate, CASE WHEN man IS NOT NULL THEN 'manual' WHEN bitrate <> '' THEN 'source' ELSE 'none' END AS bitrate_origin, CASE WHEN man IS NOT NULL AND format IN ('pcm', 'flac') THEN 'audio_format_bitrate_not_applicable' END AS error FROM (
 SELECT *, coalesce(man, CASE WHEN format NOT IN ('pcm', 'flac') AND codec_origin <> 'encoder_default' THEN (SELECT arg_min(CASE WHEN s.bit_rate % 1000 = 0 THEN concat(s.bit_rate // 1000, 'k') ELSE s.bit_rate::VARCHAR END, s.output_index) FROM s WHERE s.plan_id = q.plan_id AND s.codec_name = q.format AND s.bit_rate > 0) END, '') AS bitrate FROM (
 SELECT r.plan_id, nullif(bitrate_request, '') AS man, coalesce(format_request, inh, 'pcm') AS format, CASE WHEN format_request IS NOT NULL THEN 'manual' WHEN inh IS NOT NULL THEN 'source' ELSE 'encoder_default' END AS codec_origin
 FROM r LEFT JOIN (SELECT plan_id, CASE WHEN c IN ('aac', 'opus', 'flac') THEN c WHEN c LIKE 'pcm_%' THEN 'pcm' END AS inh FROM (SELECT plan_id, arg_min(codec_name, output_index) AS c FROM s GROUP BY ALL)) USING (plan_id)) q)""", f"s AS ({FST})", f"r AS ({FRQ})"))
def dec_17(spark, sf):
    streams = view(spark, sf, "v_stream").selectExpr(
        "file_id AS plan_id", "stream_index AS output_index", "CASE stream_index % 5 WHEN 0 THEN 'aac' WHEN 1 THEN 'opus' WHEN 2 THEN 'flac' WHEN 3 THEN 'pcm_s16le' ELSE 'mp3' END AS codec_name",
        "CASE WHEN file_id % 3 = 0 THEN 0 ELSE tag_key * 100 END AS bit_rate")
    return a.output_format(streams, table_sql(spark, sf, FRQ, "orders"))


SEL = "SELECT l_orderkey AS plan_id, CAST(l_linenumber AS BIGINT) AS pos, concat(CASE WHEN min(l_partkey) % 17 = 0 THEN 'mic' ELSE 'cam' END, ':s', CAST(min(l_suppkey) % 8 AS STRING), CASE WHEN min(l_partkey) % 13 = 0 THEN ':x' ELSE ':c' END, CAST(min(l_partkey) % 2 AS STRING)) AS channel_id FROM lineitem GROUP BY l_orderkey, l_linenumber"
KNOWN = "SELECT l_orderkey AS plan_id, 'cam' AS source_id, CAST(l_linenumber AS BIGINT) AS stream_index, CAST(1 + min(l_partkey) % 2 AS BIGINT) AS channels FROM lineitem GROUP BY l_orderkey, l_linenumber"
# most mappings repeat the selection in order; some are damaged
MAPP = "SELECT plan_id, pos - 1 - CASE WHEN plan_id % 5 = 0 AND pos > 2 THEN 1 ELSE 0 END AS output_index, CASE WHEN plan_id % 11 = 0 AND pos = 2 THEN 'cam:s1:c0' ELSE channel_id END AS channel_id FROM ({sel}) WHERE plan_id % 19 <> 0 AND NOT (plan_id % 7 = 0 AND pos = 1)"
CLEAN = "SELECT l_orderkey AS plan_id, CAST(l_linenumber AS BIGINT) AS pos, concat('cam:s', CAST(l_linenumber AS STRING), ':c0') AS channel_id FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _resolve(name, rows):
    return f"""{name} AS (SELECT x.*, src, st, ch, concat(src, ':s', st, ':c', ch) AS canonical, CASE WHEN src IS NULL THEN 'audio_channel_not_found' WHEN src <> 'cam' OR NOT EXISTS (SELECT 1 FROM kn k WHERE k.plan_id = x.plan_id) THEN 'audio_source_not_found' WHEN kk.channels IS NULL THEN 'audio_stream_not_found' WHEN ch >= kk.channels THEN 'audio_channel_not_found' END AS reason
 FROM (SELECT *, nullif(regexp_extract(channel_id, '^(.+):s(\\d+):?c(\\d+)$', 1), '') AS src, TRY_CAST(regexp_extract(channel_id, '^(.+):s(\\d+):?c(\\d+)$', 2) AS BIGINT) AS st, TRY_CAST(regexp_extract(channel_id, '^(.+):s(\\d+):?c(\\d+)$', 3) AS BIGINT) AS ch FROM ({rows})) x LEFT JOIN kn kk ON kk.plan_id = x.plan_id AND kk.source_id = x.src AND kk.stream_index = x.st)"""


@query("dec_18", f"WITH kn AS ({KNOWN}), {_resolve('rs', SEL)} SELECT plan_id, pos, channel_id, coalesce(reason, CASE WHEN pos > f THEN 'audio_source_duplicate' END) AS reason FROM (SELECT *, min(pos) FILTER (reason IS NULL) OVER (PARTITION BY plan_id, canonical) AS f FROM rs) WHERE reason IS NOT NULL OR pos > f")
def dec_18(spark, sf):
    return a.selection_issues(table_sql(spark, sf, SEL, "lineitem"), table_sql(spark, sf, KNOWN, "lineitem"))


MIXED = f"SELECT * FROM ({CLEAN}) WHERE plan_id % 3 <> 0 UNION ALL SELECT * FROM ({SEL}) WHERE plan_id % 3 = 0"


@query("dec_19", f"""WITH kn AS ({KNOWN}), {_resolve('rs', MIXED)}, ok AS (SELECT DISTINCT plan_id, canonical FROM rs WHERE reason IS NULL), {_resolve('re', MAPP.format(sel=MIXED))},
r2 AS (SELECT re.* REPLACE (coalesce(re.reason, CASE WHEN ok.canonical IS NULL THEN 'audio_mapping_not_selected' END) AS reason) FROM re LEFT JOIN ok ON ok.plan_id = re.plan_id AND ok.canonical = re.canonical), good AS (SELECT * FROM r2 WHERE plan_id NOT IN (SELECT plan_id FROM r2 WHERE reason IS NOT NULL)),
sh AS (SELECT plan_id, count(*) AS n, count(DISTINCT output_index) AS d, min(output_index) AS lo, max(output_index) AS hi FROM good GROUP BY ALL)
SELECT plan_id, reason, channel_id AS location FROM r2 WHERE reason IS NOT NULL UNION ALL SELECT plan_id, 'audio_mix_not_supported', CAST(output_index AS VARCHAR) FROM good GROUP BY plan_id, output_index HAVING count(DISTINCT canonical) > 1
UNION ALL SELECT plan_id, 'audio_mapping_output_order', 'indices' FROM sh WHERE NOT (d = n AND lo = 0 AND hi = n - 1) UNION ALL SELECT plan_id, 'audio_mapping_output_order', canonical FROM good GROUP BY plan_id, canonical HAVING count(*) > 1
UNION ALL SELECT plan_id, 'audio_mix_not_supported', 'collapse' FROM sh JOIN (SELECT plan_id, count(*) AS wanted FROM ok GROUP BY ALL) USING (plan_id) WHERE wanted > n UNION ALL SELECT DISTINCT plan_id, 'audio_mapping_incomplete', 'mapping' FROM ok WHERE plan_id NOT IN (SELECT plan_id FROM re)""")
def dec_19(spark, sf):
    mixed = cut_lineage(table_sql(spark, sf, MIXED, "lineitem"))
    return a.mapping_issues(spark.sql(MAPP.format(sel="SELECT * FROM {mixed}"), mixed=mixed), mixed, table_sql(spark, sf, KNOWN, "lineitem"))


ENT = "SELECT l_orderkey AS plan_id, CAST(l_linenumber - 1 AS BIGINT) AS output_index, CASE WHEN min(l_partkey) % 4 = 0 THEN 'ext' ELSE 'cam' END AS source_id, CASE WHEN min(l_partkey) % 4 = 0 THEN 'external' ELSE 'primary' END AS kind, CAST(min(l_suppkey) % 2 AS BIGINT) AS stream_index, CAST(max(l_partkey) % 2 AS BIGINT) AS channel_index FROM lineitem GROUP BY l_orderkey, l_linenumber"
EST = "SELECT DISTINCT o_orderkey AS plan_id, s.source_id, s.stream_index, CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 2 END AS channels FROM orders"


@query("dec_20", f"""WITH e AS ({ENT}) SELECT *, CASE WHEN note IS NULL THEN 'COPY' ELSE 'ROUTED' END AS kind FROM (SELECT plan_id, source_id, stream_index, lo AS first_output, n AS n_channels, total, CASE WHEN list_sort(c) <> range(total) THEN 'channel subset' WHEN c <> range(total) THEN 'channel reorder' WHEN hi - lo + 1 <> n THEN 'split across outputs' END AS note FROM (
 SELECT plan_id, source_id, stream_index, min(output_index) AS lo, max(output_index) AS hi, count(*) AS n, list(channel_index ORDER BY output_index) AS c, CASE WHEN plan_id % 6 = 0 THEN 1 ELSE 2 END::BIGINT AS total FROM e GROUP BY ALL))""")
def dec_20(spark, sf):
    e = table_sql(spark, sf, ENT, "lineitem")
    streams = e.select("plan_id", "source_id", "stream_index").distinct().withColumn(
        "channels", F.when(F.col("plan_id") % 6 == 0, 1).otherwise(2).cast("bigint"))
    return a.output_packets(e, streams)


@query("dec_21", f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY output_index) - 1 AS i FROM ({ENT})),
m AS (SELECT * REPLACE (i AS output_index), lag(kind) OVER w IS DISTINCT FROM kind AS run, lag(source_id) OVER w IS DISTINCT FROM source_id OR lag(stream_index) OVER w IS DISTINCT FROM stream_index AS oth FROM e WINDOW w AS (PARTITION BY plan_id ORDER BY i)),
p AS (SELECT *, last_value(CASE WHEN run THEN output_index END IGNORE NULLS) OVER (PARTITION BY plan_id ORDER BY output_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS frm FROM m),
g AS (SELECT *, sum(CASE WHEN run OR (kind = 'primary' AND oth) OR (kind = 'external' AND (output_index - frm) % 2 = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY output_index) AS group_no FROM p)
SELECT plan_id, group_no::BIGINT AS group_no, kind, count(*) AS n_channels, min(output_index) AS first_output, max(output_index) AS last_output FROM g GROUP BY ALL""")
def dec_21(spark, sf):
    e = table_sql(spark, sf, ENT, "lineitem")
    dense = w.running_sum(e, ["plan_id"], "output_index", F.lit(1), "_i").withColumn("output_index", F.col("_i") - 1).drop("_i")
    return a.output_groups(dense, 2)


SPAN = "SELECT l_orderkey AS plan_id, CAST(l_linenumber * 100 AS BIGINT) AS start_sample, CAST(CASE WHEN l_orderkey % 9 = 0 OR min(l_partkey) % 5 = 0 THEN NULL ELSE l_linenumber * 100 + max(l_quantity) * 10 END AS BIGINT) AS end_sample, CAST(CASE WHEN l_orderkey % 23 = 0 THEN 0 WHEN l_orderkey % 29 = 0 AND l_linenumber % 2 = 0 THEN 44100 ELSE 48000 END AS BIGINT) AS sample_rate FROM lineitem GROUP BY l_orderkey, l_linenumber"


def _window_sql(lo, hi):
    return f"""SELECT plan_id, channels, known, reason, CASE WHEN reason IS NULL THEN s END AS start_sample, CASE WHEN reason IS NULL THEN e END AS end_sample FROM (SELECT *, CASE WHEN none THEN 'audio_timeline_invalid' WHEN rl <> rh THEN 'audio_sample_rate_mismatch' WHEN known = 0 THEN 'audio_duration_unknown' WHEN e < s THEN 'audio_negative_render_duration' END AS reason
 FROM (SELECT plan_id, count(*) AS channels, count(end_sample) AS known, bool_or(sample_rate <= 0) AS none, min(sample_rate) AS rl, max(sample_rate) AS rh, {lo}(start_sample) AS s, {hi}(end_sample) AS e FROM ({SPAN}) GROUP BY ALL))"""


@query("agg_24", _window_sql("min", "max"))
def agg_24(spark, sf):
    return a.render_window(table_sql(spark, sf, SPAN, "lineitem"))


@query("agg_24_mix", _window_sql("max", "min"))
def agg_24_mix(spark, sf):
    return a.render_window(table_sql(spark, sf, SPAN, "lineitem"), intersection=True)


@query("agg_27", with_views("""SELECT file_id, stream_index, declared, actual, actual - declared AS delta FROM (SELECT file_id, stream_index, CASE WHEN tag_key % 3 = 0 THEN tag_key + 1 ELSE CAST(floor(duration_sec * sample_rate + 0.5) AS BIGINT) END AS declared, CASE WHEN tag_key % 7 <> 0 THEN CASE WHEN tag_key % 3 = 0 THEN tag_key + tag_key % 5 ELSE CAST(duration_sec AS BIGINT) * sample_rate + tag_key % 4 END END AS actual FROM v_stream) WHERE abs(actual - declared) > 1"""))
def agg_27(spark, sf):
    s = view(spark, sf, "v_stream")
    declared = s.selectExpr("file_id", "stream_index", "duration_sec", "sample_rate", "CASE WHEN tag_key % 3 = 0 THEN CAST(tag_key + 1 AS STRING) WHEN tag_key % 3 = 1 THEN 'N/A' END AS nb_frames")
    actual = s.where("tag_key % 7 <> 0").selectExpr("file_id", "stream_index", "CASE WHEN tag_key % 3 = 0 THEN tag_key + tag_key % 5 ELSE CAST(duration_sec AS BIGINT) * sample_rate + tag_key % 4 END AS actual")
    return a.declared_mismatches(declared, actual)


GAINS = [(0, 0, 1.0), (0, 1, 2.5), (1, 2, 0.5), (1, 3, 0.25), (1, 0, 3.0)]


def mixed(spark, sf, policy="detect"):
    b = blocks(spark, sf)
    table = F.array(*[F.struct(F.lit(s).cast("bigint").alias("sink"), F.lit(c).cast("bigint").alias("channel"), F.lit(g).alias("gain")) for s, c, g in GAINS])
    gains = b.select("file_id").distinct().select("file_id", F.explode(table).alias("g")).select("file_id", "g.*")
    return ap.mix(b, gains, policy=policy)


@query("agg_23", with_views(f"""SELECT file_id, sink, count(*) AS n_samples, round(max(abs(v)), 6) AS peak, arg_max(k, (abs(v), -k)) AS peak_at, count(*) FILTER (abs(v) > 1) AS clip_count, count(*) FILTER (abs(v) > 1) AS hard_clipped, NULL::VARCHAR AS reason FROM (
 SELECT file_id, sink, block_no * 64 + i AS k, sum(samples[i + 1] * gain) AS v FROM pcm JOIN range(64) r(i) ON TRUE JOIN (VALUES {', '.join(f'({s}::BIGINT, {c}, {x}::DOUBLE)' for s, c, x in GAINS)}) g(sink, channel, gain) USING (channel) GROUP BY ALL) GROUP BY file_id, sink""", PCM))
def agg_23(spark, sf):
    return rounded(ap.mix_statistics(mixed(spark, sf, "hard_clip"), size=SIZE, policy="hard_clip"))


HOP = 200


def shift_plan(spark, sf):
    b = blocks(spark, sf)
    keys = ["file_id", "channel"]
    n = w.required_windows(F.lit(6400), HOP)
    return b, w.window_spine(b.select(*keys).distinct(), n).withColumn("shift", (F.col("window_no") * 7) % 90 - 40)


@query("jon_07", with_views("""SELECT file_id, channel, block_no, round(list_sum([v * (i + 1) for v, i in out]), 6) AS weighted FROM (SELECT file_id, channel, block_no, [CASE WHEN k + ((k // 200) * 7) % 90 - 40 BETWEEN 0 AND len(x) - 1 THEN x[k + ((k // 200) * 7) % 90 - 40 + 1] ELSE 0.0 END for k in range(block_no * 64, block_no * 64 + 64)] AS out FROM pcm JOIN ax USING (file_id, channel))""", PCM,
    "ax AS (SELECT file_id, channel, flatten(list(samples ORDER BY block_no)) AS x FROM pcm GROUP BY ALL)").replace("list_sum([v * (i + 1) for v, i in out])", "list_sum([out[i] * i for i in range(1, 65)])"))
def jon_07(spark, sf):
    b, plan = shift_plan(spark, sf)
    out = ap.apply_shifts(b, plan, ["file_id", "channel"], size=SIZE, hop=HOP)
    weighted = F.aggregate(F.transform("samples", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rounded(out.select("file_id", "channel", "block_no", weighted.alias("weighted")))


@query("jon_08", with_views("""SELECT file_id, channel, count(*) AS n_samples, count(*) AS checked, count(*) FILTER (bad) AS mismatches, min(k) FILTER (bad) AS first_mismatch, TRUE AS complete FROM (SELECT p.file_id, p.channel, k, block_no % 30 = 11 AND k % 64 = 0 AS bad FROM pcm p, range(6400) r(k) WHERE k // 64 = block_no) GROUP BY ALL""", PCM))
def jon_08(spark, sf):
    keys = ["file_id", "channel"]
    b, plan = shift_plan(spark, sf)
    out = ap.apply_shifts(b, plan, keys, size=SIZE, hop=HOP)
    # damage the first sample of some blocks, to be found again
    broken = F.transform("samples", lambda x, i: F.when(i == 0, x + 1).otherwise(x).cast("float"))
    out = out.withColumn("samples", F.when(F.col("block_no") % 30 == 11, broken).otherwise(F.col("samples")))
    return ap.verify_shifts(b, out, plan, keys, size=SIZE, hop=HOP)


@query("jon_14", with_views("""SELECT s.file_id, output_index, s.block_no, round(coalesce(list_sum(samples), 0.0), 6) AS total, samples IS NOT NULL AS faithful FROM (SELECT file_id, o.output_index::BIGINT AS output_index, o.channel, b AS block_no FROM (SELECT DISTINCT file_id FROM pcm), (VALUES (0, 2), (1, 0), (2, 7)) o(output_index, channel), range(102) r(b)) s
 LEFT JOIN (SELECT * FROM pcm WHERE block_no % 9 <> 4) p ON p.file_id = s.file_id AND p.channel = s.channel AND p.block_no = s.block_no""", PCM))
def jon_14(spark, sf):
    b = blocks(spark, sf)
    table = F.array(*[F.struct(F.lit(o).cast("bigint").alias("output_index"), F.lit(c).cast("bigint").alias("channel")) for o, c in ((0, 2), (1, 0), (2, 7))])
    files = b.select("file_id").distinct()
    mapping = files.select("file_id", F.explode(table).alias("m")).select("file_id", "m.*")
    spans = files.withColumn("n_blocks", F.lit(102).cast("bigint"))
    out = ap.route(b.where("block_no % 9 <> 4"), mapping, spans, size=SIZE)
    return rounded(out.select("file_id", "output_index", "block_no", w.F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double")).alias("total"), "faithful"))


@query("dec_24")
def dec_24(spark, sf):
    return rounded(td.decide_tracks(cut_lineage(blocks(spark, sf)), SIZE, rate=RATE, frame=512, hop=256, search=32, mad_max_ms=1.0))


# the delays that the channels were made with, against those that the whole decision measures
@query("dec_24_files", """WITH f AS (SELECT DISTINCT floor(vec_id / 100)::BIGINT AS file_id FROM embeddings), c(channel, d) AS (VALUES (1, 5), (2, 12), (3, -7))
SELECT file_id, CASE WHEN file_id = 0 THEN 0 ELSE count(*) FILTER (abs(d) > 5) END AS fixed, CASE WHEN file_id = 0 THEN 0 ELSE count(*) FILTER (abs(d) <= 5) END AS aligned, CASE WHEN file_id = 0 THEN 4 ELSE 0 END::BIGINT AS untouched,
 CASE WHEN file_id = 0 THEN 'not_eligible' ELSE 'applied' END AS status FROM f, c GROUP BY file_id""")
def dec_24_files(spark, sf):
    """Verdicts of whole files, from eligibility of their streams to the outcome; file 0 stands for one out of scope."""
    b = cut_lineage(blocks(spark, sf))
    files = b.select("file_id").distinct()
    streams = files.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")).select(
        "file_id", F.lit("audio").alias("codec_type"), F.lit("pcm_s24le").alias("codec_name"), F.lit(1).cast("bigint").alias("channels"),
        F.when((F.col("file_id") == 0) & (F.col("n") == 3), 44100).otherwise(48000).cast("bigint").alias("sample_rate"))
    tracks = td.decide_tracks(b, SIZE, rate=RATE, frame=512, hop=256, search=32, mad_max_ms=1.0, eligible=g.eligibility(files, streams))
    return td.file_outcome(tracks)


# channels 2 and 3 carry a sound of their own besides that of channel 0; 0 and 1, and 2 and 3, are rigid
BOUND = [(0, False, 0), (1, False, 9), (2, True, 12), (3, True, 13)]


@query("dec_24_bound", """SELECT file_id, channel::BIGINT AS channel, decision, shift_samples::BIGINT AS shift_samples, bound_to::BIGINT AS bound_to FROM (SELECT DISTINCT floor(vec_id / 100)::BIGINT AS file_id FROM embeddings),
 (VALUES (0, 'anchor', NULL, 0), (1, 'already_aligned', NULL, 0), (2, 'fixed', 12, 2), (3, 'fixed', 12, 2)) v(channel, decision, shift_samples, bound_to)""")
def dec_24_bound(spark, sf):
    """The whole decision with rigid pairs that move together: a channel stays with the anchor, a pair takes one shift."""
    base = view(spark, sf, "v_base")
    own = F.transform("samples", lambda x, i: (x + F.col("samples")[SIZE - 1 - i]).cast("float"))
    both = base.select("file_id", "block_no", F.explode(F.array(
        F.struct(F.lit(False).alias("own"), F.col("samples")), F.struct(F.lit(True).alias("own"), own.alias("samples")))).alias("s")).select(
        "file_id", "block_no", "s.*")
    plan = F.array(*[F.struct(F.lit(c).cast("bigint").alias("channel"), F.lit(o).alias("own"), F.lit(n).alias("d")) for c, o, n in BOUND])
    ranges = base.select("file_id", F.col("block_no").alias("out"), F.explode(plan).alias("c")).select(
        "file_id", "c.own", "c.channel", "out", (F.col("out") * SIZE - F.col("c.d")).alias("start"), F.lit(SIZE).cast("bigint").alias("count"))
    takes = pcm.read_ranges(both, ranges, ["file_id", "own"], SIZE).select("file_id", "channel", F.col("out").alias("block_no"), "samples")
    tracks = td.decide_tracks(cut_lineage(takes), SIZE, rate=RATE, frame=512, hop=256, search=32, mad_max_ms=1.0, verify_max_ms=0.2,
                              bind={"window": 1024, "window_hop": 512, "factor": 1, "min_samples": 10})
    return tracks.select("file_id", "channel", "decision", "shift_samples", "bound_to")
