"""Preservation queries."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import preserve as p
from . import query
from .trajectory import rounded


def table_sql(spark, sf, text, *tables):
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM parquet.`{sf}/{t}.parquet`")
    return spark.sql(text)


DIFF = """
pv AS (SELECT file_id, item, max(value) FILTER (side = 'original') AS original_value, max(value) FILTER (side = 'final') AS final_value, bool_or(side = 'final') AS in_final, bool_or(side = 'original') AS in_original FROM v_fact GROUP BY ALL),
df AS (SELECT file_id, item, original_value, final_value, CASE WHEN NOT in_original THEN 'ADDED' WHEN NOT in_final THEN 'MISSING' WHEN original_value IS NULL AND final_value IS NULL THEN 'UNKNOWN' WHEN original_value IS NOT DISTINCT FROM final_value THEN 'PRESERVED' ELSE 'MODIFIED' END AS status FROM pv)"""


@query("jon_01", with_views("SELECT * FROM df", DIFF))
def jon_01(spark, sf):
    return p.fact_diff(view(spark, sf, "v_fact"))


@query("agg_20", with_views("""SELECT file_id, count(*) FILTER (status = 'PRESERVED') AS preserved, count(*) FILTER (status = 'MODIFIED') AS modified, count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'ADDED') AS added, count(*) FILTER (status = 'UNKNOWN') AS unknown,
 count(*) FILTER (status = 'MISSING' AND item LIKE 'video.%') AS critical_missing, count(*) FILTER (status = 'MODIFIED' AND item LIKE 'video.%') AS critical_modified, count(*) FILTER (status IN ('MISSING', 'MODIFIED') AND item LIKE 'video.%') = 0 AS structural_success FROM df GROUP BY ALL""", DIFF))
def agg_20(spark, sf):
    return p.diff_summary(p.fact_diff(view(spark, sf, "v_fact")))


INV = """SELECT doc_id % 50 AS file_id, 'original' AS side, lang AS ctx, source AS guid, {sha} AS sha, CASE WHEN doc_id % 3 = 0 THEN 'PROF' WHEN doc_id % 3 = 1 THEN 'USMT' ELSE '' END AS label FROM documents
UNION ALL SELECT doc_id % 50, 'final', CASE WHEN doc_id % 17 = 0 THEN 'moov' ELSE lang END, source, {sha}, CASE WHEN doc_id % 3 = 0 THEN 'PROF' WHEN doc_id % 3 = 1 THEN 'USMT' ELSE '' END FROM documents WHERE doc_id % 10 <> 0"""
DUCK_INV = INV.replace("{sha}", "sha256(text)")


def inventory(spark, sf):
    return table_sql(spark, sf, INV.replace("{sha}", "sha2(text, 256)"), "documents")


@query("set_01", f"""SELECT file_id, sum(a)::BIGINT AS n_original, sum(b)::BIGINT AS n_final, sum(greatest(a - b, 0))::BIGINT AS missing, sum(greatest(b - a, 0))::BIGINT AS added, sum(abs(a - b)) = 0 AS identical
 FROM (SELECT file_id, ctx, guid, sha, count(*) FILTER (side = 'original') AS a, count(*) FILTER (side = 'final') AS b FROM ({DUCK_INV}) GROUP BY ALL) GROUP BY ALL""")
def set_01(spark, sf):
    return p.inventory_compare(inventory(spark, sf))


@query("set_01_rows", f"""SELECT *, 'missing' AS change FROM (SELECT file_id, ctx, guid, sha FROM ({DUCK_INV}) WHERE side = 'original' EXCEPT ALL SELECT file_id, ctx, guid, sha FROM ({DUCK_INV}) WHERE side = 'final')
 UNION ALL SELECT *, 'added' FROM (SELECT file_id, ctx, guid, sha FROM ({DUCK_INV}) WHERE side = 'final' EXCEPT ALL SELECT file_id, ctx, guid, sha FROM ({DUCK_INV}) WHERE side = 'original')""")
def set_01_rows(spark, sf):
    return p.inventory_rows(inventory(spark, sf))


@query("set_02", f"""SELECT file_id, label, n_original, n_final, CASE WHEN n_final = 0 THEN 'MISSING' WHEN n_original <> n_final OR sa IS DISTINCT FROM sb OR ca IS DISTINCT FROM cb THEN 'MODIFIED' ELSE 'PRESERVED' END AS status FROM (
 SELECT file_id, label, count(*) FILTER (side = 'original') AS n_original, count(*) FILTER (side = 'final') AS n_final, string_agg(sha, ',' ORDER BY sha) FILTER (side = 'original') AS sa, string_agg(sha, ',' ORDER BY sha) FILTER (side = 'final') AS sb,
 string_agg(ctx, ',' ORDER BY ctx) FILTER (side = 'original') AS ca, string_agg(ctx, ',' ORDER BY ctx) FILTER (side = 'final') AS cb FROM ({DUCK_INV}) WHERE label <> '' GROUP BY ALL) WHERE n_original > 0
 UNION ALL SELECT file_id, concat('unlabelled:', sha, ':', ctx), count(*) FILTER (side = 'original'), count(*) FILTER (side = 'final'), CASE WHEN count(*) FILTER (side = 'final') > 0 THEN 'PRESERVED' ELSE 'MISSING' END
 FROM ({DUCK_INV}) WHERE label = '' GROUP BY file_id, sha, ctx HAVING count(*) FILTER (side = 'original') > 0""")
def set_02(spark, sf):
    inv = inventory(spark, sf)
    plain = inv.where("label = ''").groupBy("file_id", "sha", "ctx").agg(F.count_if(F.col("side") == "final").alias("n_final"))
    loose = p.unlabelled_inventory(inv).join(plain, ["file_id", "sha", "ctx"]).select(
        "file_id", F.concat_ws(":", F.lit("unlabelled"), "sha", "ctx").alias("label"), "n_original", "n_final", "status")
    return p.labelled_inventory(inv).unionByName(loose)


@query("set_03", with_views("""SELECT file_id, CASE WHEN a AND b THEN 'common' WHEN a THEN 'only_a' ELSE 'only_b' END AS membership FROM (SELECT file_id, bool_or(a) AS a, bool_or(NOT a) AS b FROM
 (SELECT file_id, TRUE AS a FROM v_track_a WHERE track_id % 5 <> 0 UNION ALL SELECT file_id, FALSE FROM v_track_b WHERE track_id % 3 = 0) GROUP BY ALL)"""))
def set_03(spark, sf):
    return p.set_membership(view(spark, sf, "v_track_a").where("track_id % 5 <> 0"), view(spark, sf, "v_track_b").where("track_id % 3 = 0"), "file_id")


@query("set_04", with_views("""SELECT decision, shard, count(*) AS n FROM (SELECT decision, 0::BIGINT AS shard FROM v_track_a WHERE track_id % 2 = 0 UNION ALL SELECT decision, 1 FROM v_track_a WHERE track_id % 2 = 1 UNION ALL SELECT decision, NULL FROM v_track_b) GROUP BY ALL"""))
def set_04(spark, sf):
    a = view(spark, sf, "v_track_a")
    shards = [a.where(F.col("track_id") % 2 == k).withColumn("shard", F.lit(k).cast("bigint")) for k in (0, 1)]
    return p.merge_runs(*shards, view(spark, sf, "v_track_b")).groupBy("decision", "shard").agg(F.count(F.lit(1)).alias("n"))


SIG_B = "file_id % 2 = 0 AND block_no = 99"
BUMP = "file_id % 3 = 1 AND block_no % 25 = 3"


@query("jon_09", with_views(f"""SELECT file_id, count(va) AS len_a, count(vb) AS len_b, min(frame_no) FILTER (va IS NOT NULL AND vb IS NOT NULL AND (va <> vb)) AS first_diff,
 round(coalesce(max(CASE WHEN va <> vb THEN list_max([abs(va[i] - vb[i]) for i in range(1, 7)]) END), 0.0), 6) AS max_deviation, count(va) = count(vb) AND count(*) FILTER (va IS NOT NULL AND vb IS NOT NULL AND va <> vb) = 0 AS identical FROM a FULL JOIN b USING (file_id, frame_no) GROUP BY ALL""",
    "a AS (SELECT file_id, block_no AS frame_no, [x::DOUBLE for x in samples[1:6]] AS va FROM v_base)",
    f"b AS (SELECT file_id, block_no AS frame_no, CASE WHEN {BUMP} THEN [x::DOUBLE + 0.5 for x in samples[1:6]] ELSE [x::DOUBLE for x in samples[1:6]] END AS vb FROM v_base WHERE NOT ({SIG_B}))"))
def jon_09(spark, sf):
    base = view(spark, sf, "v_base")
    values = F.transform(F.slice("samples", 1, 6), lambda x: x.cast("double"))
    digest = F.md5((F.col("block_no") % 7).cast("string"))
    a = base.select("file_id", F.col("block_no").alias("frame_no"), values.alias("values"), digest.alias("digest"))
    b = base.where(f"NOT ({SIG_B})").select("file_id", F.col("block_no").alias("frame_no"),
                                            F.when(F.expr(BUMP), F.transform(values, lambda x: x + 0.5)).otherwise(values).alias("values"), digest.alias("digest"))
    return rounded(p.compare_sequences(a, b))


@query("jon_10", with_views(f"""SELECT *, CASE WHEN n_a <> n_b THEN 'count_differs' WHEN unmatched > 0 THEN 'frames_differ' WHEN n_bad > 0 THEN 'samples_differ' ELSE 'identical' END AS verdict FROM (
 SELECT file_id, count(qa) AS n_a, count(qb) AS n_b, count(*) FILTER (qa IS NULL OR qb IS NULL) AS unmatched, count(*) FILTER (bad) AS n_bad, min(frame_no) FILTER (bad) AS first_bad FROM (
 SELECT *, list_max([abs(qa[i] - qb[i]) for i in range(1, 5)]) > 1e-4 AS bad FROM a FULL JOIN b USING (file_id, frame_no)) GROUP BY ALL)""",
    "a AS (SELECT file_id, block_no AS frame_no, [x::DOUBLE for x in samples[1:4]] AS qa FROM v_base)",
    f"b AS (SELECT file_id, block_no AS frame_no, [x::DOUBLE + CASE WHEN {BUMP} THEN 0.001 ELSE 0.00001 END for x in samples[1:4]] AS qb FROM v_base WHERE NOT ({SIG_B}))"))
def jon_10(spark, sf):
    base = view(spark, sf, "v_base")
    quat = F.transform(F.slice("samples", 1, 4), lambda x: x.cast("double"))
    a = base.select("file_id", F.col("block_no").alias("frame_no"), quat.alias("quat"))
    off = F.when(F.expr(BUMP), 0.001).otherwise(0.00001)
    b = base.where(f"NOT ({SIG_B})").withColumn("_o", off).select("file_id", F.col("block_no").alias("frame_no"),
                                                                  F.transform(quat, lambda x: x + F.col("_o")).alias("quat"))
    return p.compare_motion(a, b)


COUNTS = """SELECT o_orderkey AS file_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderkey % 100 + 50 END AS expected, o_orderkey % 100 + 50 + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS encoder_input,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey % 100 + 50 END AS output_stream, o_orderkey % 100 + 50 - CASE WHEN o_custkey % 23 = 0 THEN 2 ELSE 0 END AS independent_decoded, o_custkey AS reader_reported FROM orders"""


@query("agg_16", f"""SELECT *, CASE WHEN mismatch = '' THEN 'integrity_ok' ELSE 'count_mismatch' END AS verdict FROM (SELECT file_id, CASE WHEN expected IS NULL THEN 'no reference count' ELSE concat_ws(', ',
 CASE WHEN encoder_input <> expected THEN concat('encoder_input=', encoder_input) END, CASE WHEN output_stream IS NULL THEN 'output_stream=unavailable' WHEN output_stream <> expected THEN concat('output_stream=', output_stream) END,
 CASE WHEN independent_decoded <> expected THEN concat('independent_decoded=', independent_decoded) END) END AS mismatch FROM ({COUNTS}))""")
def agg_16(spark, sf):
    return p.reconcile_counts(table_sql(spark, sf, COUNTS, "orders"), ["encoder_input", "output_stream", "independent_decoded"])


QFILES = """SELECT p_partkey AS file_id, concat('clip', CAST(p_partkey AS STRING)) AS name, p_partkey % 31 <> 0 AS enabled, p_size * 2.5 AS duration_sec, p_size % 4 AS src_size, CASE WHEN p_partkey % 29 = 0 THEN -1 ELSE p_size % 4 END AS out_size,
 CAST(p_size * 60 AS BIGINT) AS src_frames, CAST(p_size * 60 + p_partkey % 4 AS BIGINT) AS out_frames, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 20 + p_size * 0.5 END AS psnr_avg, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 0.7 + p_size * 0.01 END AS ssim_all FROM part"""


@query("agg_17", f"""SELECT file_id, garbage, coalesce(skip, problems) AS reason, CASE WHEN skip IS NOT NULL THEN 'SKIP' WHEN problems = '' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT file_id, round(coalesce(g, 0.0), 6) AS garbage,
 CASE WHEN NOT enabled THEN 'disabled' WHEN duration_sec > 60 THEN 'long' WHEN CAST(concat('0x', substr(sha256(name), 1, 2)) AS INTEGER) % 10 <> 0 THEN 'unsampled' WHEN src_size <> out_size THEN 'size_mismatch' WHEN src_frames > 0 AND out_frames > 0 AND abs(src_frames - out_frames) > 2 THEN 'frame_mismatch' END AS skip,
 concat_ws(';', CASE WHEN psnr_avg IS NULL THEN 'psnr_missing' WHEN psnr_avg < 25 THEN 'psnr_low' END, CASE WHEN ssim_all IS NULL THEN 'ssim_missing' WHEN ssim_all < 0.8 THEN 'ssim_low' END, CASE WHEN coalesce(g, 0) > 0.02 THEN 'garbage' END) AS problems
 FROM ({QFILES}) f LEFT JOIN (SELECT l_partkey AS file_id, avg(CASE WHEN l_quantity + 9 < 12 THEN 1.0 ELSE 0.0 END)::DOUBLE AS g FROM lineitem GROUP BY ALL) USING (file_id))""")
def agg_17(spark, sf):
    frames = view(spark, sf, "lineitem").select(F.col("l_partkey").alias("file_id"), (F.col("l_quantity") + 9).alias("psnr"))
    return rounded(p.quality_verdicts(table_sql(spark, sf, QFILES, "part"), frames))


PACKETS = "SELECT user_id AS file_id, event_id AS packet_no, ({us} - 1704067200000000) / 3600000000.0 AS pts_sec, event_type = 'signup' AS is_key, CAST(round(value * 100) AS BIGINT) AS size FROM events"


@query("agg_18", f"""SELECT file_id, n_packets, round(size_mean, 6) AS size_mean, mbps_p10, mbps_p50, mbps_p90, mbps_max, coalesce(n_keyframes, 0) AS n_keyframes, keyint_mean, keyint_min, keyint_max FROM (SELECT file_id, count(*) AS n_packets, avg(size) AS size_mean FROM pk GROUP BY ALL)
 JOIN (SELECT file_id, round(quantile_cont(b, 0.1), 6) AS mbps_p10, round(quantile_cont(b, 0.5), 6) AS mbps_p50, round(quantile_cont(b, 0.9), 6) AS mbps_p90, round(max(b), 6) AS mbps_max FROM (SELECT file_id, floor(pts_sec) AS s, sum(size)::DOUBLE * 8 / 1e6 AS b FROM pk GROUP BY ALL) GROUP BY ALL) USING (file_id)
 LEFT JOIN (SELECT file_id, count(*) AS n_keyframes, round(avg(g), 6) AS keyint_mean, round(min(g), 6) AS keyint_min, round(max(g), 6) AS keyint_max FROM (SELECT *, pts_sec - lag(pts_sec) OVER (PARTITION BY file_id ORDER BY pts_sec, packet_no) AS g FROM pk WHERE is_key) GROUP BY ALL) USING (file_id)""".replace("SELECT file_id, n_packets", f"WITH pk AS ({PACKETS.replace('{us}', 'epoch_us(ts)').replace('3600000000.0', '3600000000.0::DOUBLE')}) SELECT file_id, n_packets", 1))
def agg_18(spark, sf):
    pk = table_sql(spark, sf, PACKETS.replace("{us}", "unix_micros(CAST(ts AS TIMESTAMP))").replace("3600000000.0", "3600000000.0D"), "events")
    return rounded(p.packet_statistics(pk)).fillna(0, ["n_keyframes"])


CONTAINER = """SELECT p_partkey AS file_id, CASE WHEN p_partkey % 37 = 0 THEN concat('a.part.', p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 'XAVC' END AS brand,
 CASE WHEN p_partkey % 3 = 0 THEN 'rtmd' WHEN p_partkey % 3 = 1 THEN 'djmd' END AS data_entry, p_partkey % 5 <> 0 AS has_cdsc, p_size % 3 AS meta_scopes, p_partkey % 4 <> 0 AS nrtm, CASE WHEN p_partkey % 43 = 0 THEN NULL ELSE p_partkey % 2 = 0 END AS moov_first,
 CASE WHEN p_partkey % 47 = 0 THEN NULL ELSE p_size + (p_partkey % 5) * 0.0009 END AS mvhd_sec, CAST(p_size AS DOUBLE) AS container_sec, CASE p_partkey % 6 WHEN 0 THEN 'in24' WHEN 1 THEN 'mp4a' WHEN 2 THEN NULL ELSE 'ipcm' END AS audio_entry,
 p_size % 7 <> 0 AS entry_consistent, CAST(p_size % 16 AS INT) AS track_flags, p_partkey % 9 AS alternate_group, p_partkey % 8 AS trak_count, CASE WHEN p_partkey % 10 = 0 THEN 9 ELSE p_partkey % 8 END AS stream_count FROM part"""
CONT_SEC = "SELECT l_orderkey AS file_id, CAST(avg(l_linenumber) * 7 AS DOUBLE) AS container_sec FROM lineitem GROUP BY l_orderkey"
STREAM_DUR = "CASE WHEN stream_index % 5 = 4 THEN NULL WHEN duration_sec = 7 THEN 0.0 ELSE duration_sec END"
FMT = f"""
sd AS (SELECT file_id, stream_index, codec_type, {STREAM_DUR} AS duration_sec FROM v_stream),
cs AS ({CONT_SEC}),
ws AS (SELECT file_id, arg_max(stream_index, (abs(duration_sec - container_sec), -stream_index)) AS worst_stream, max(abs(duration_sec - container_sec)) AS delta_sec FROM sd JOIN cs USING (file_id) WHERE duration_sec IS NOT NULL GROUP BY ALL),
so AS (SELECT file_id, list(r ORDER BY stream_index) = list_sort(list(r ORDER BY stream_index)) AS sorted FROM (SELECT *, CASE codec_type WHEN 'video' THEN 0 WHEN 'audio' THEN 1 WHEN 'data' THEN 2 ELSE 3 END AS r FROM sd) GROUP BY ALL)"""


def stream_parts(spark, sf):
    return (view(spark, sf, "v_stream").withColumn("duration_sec", F.expr(STREAM_DUR)),
            table_sql(spark, sf, CONT_SEC, "lineitem"))


@query("srt_04", with_views("SELECT file_id, CASE WHEN sorted THEN 'PASS' ELSE 'WARN' END AS verdict FROM so", FMT))
def srt_04(spark, sf):
    return p.stream_order(stream_parts(spark, sf)[0])


@query("srt_05", with_views("SELECT file_id, worst_stream, round(delta_sec, 6) AS delta_sec, CASE WHEN delta_sec <= 0.05 THEN 'PASS' ELSE 'WARN' END AS verdict FROM ws", FMT))
def srt_05(spark, sf):
    return rounded(p.worst_stream(*stream_parts(spark, sf)))


_CK = {"CTR-01": "CASE WHEN brand IS NULL THEN 'FAIL' ELSE 'PASS' END", "CTR-02": "CASE WHEN data_entry = 'rtmd' THEN CASE WHEN has_cdsc THEN 'PASS' ELSE 'FAIL' END ELSE 'SKIP' END",
       "CTR-03": "CASE WHEN meta_scopes > 0 THEN CASE WHEN nrtm THEN 'PASS' ELSE 'WARN' END ELSE 'SKIP' END", "CTR-04": "'PASS'",
       "CTR-05": "CASE WHEN contains(name, '.part.') THEN 'SKIP' WHEN moov_first IS NULL THEN 'FAIL' WHEN moov_first THEN 'PASS' ELSE 'WARN' END",
       "CTR-06": "CASE WHEN mvhd_sec IS NULL THEN 'SKIP' WHEN abs(mvhd_sec - container_sec) <= 0.002 THEN 'PASS' ELSE 'FAIL' END",
       "CTR-07": "CASE WHEN audio_entry IN ('in24', 'ipcm') THEN CASE WHEN audio_entry = 'in24' THEN 'WARN' ELSE 'PASS' END ELSE 'SKIP' END",
       "CTR-08": "CASE WHEN audio_entry IN ('in24', 'ipcm') THEN CASE WHEN entry_consistent THEN 'PASS' ELSE 'WARN' END ELSE 'SKIP' END",
       "CTR-09": "CASE WHEN track_flags & 7 = 7 AND alternate_group = 0 THEN 'PASS' ELSE 'WARN' END", "FMT-05": "CASE WHEN trak_count = stream_count THEN 'PASS' ELSE 'FAIL' END"}


@query("dec_22", with_views(" UNION ALL ".join(f"SELECT file_id, '{k}' AS check_id, {v} AS verdict FROM c" for k, v in _CK.items())
    + " UNION ALL SELECT file_id, 'FMT-01', CASE WHEN delta_sec <= 0.05 THEN 'PASS' ELSE 'WARN' END FROM ws UNION ALL SELECT file_id, 'FMT-02', CASE WHEN bool_or(coalesce(duration_sec, 0) = 0) THEN 'FAIL' ELSE 'PASS' END FROM sd GROUP BY file_id"
    + " UNION ALL SELECT file_id, 'FMT-03', CASE WHEN sorted THEN 'PASS' ELSE 'WARN' END FROM so", f"c AS ({CONTAINER})", FMT))
def dec_22(spark, sf):
    return p.container_checks(table_sql(spark, sf, CONTAINER, "part")).unionByName(p.format_checks(*stream_parts(spark, sf)))


ENTRIES = """SELECT p_partkey AS file_id, CASE p_partkey % 6 WHEN 0 THEN 'in24' WHEN 1 THEN 'sowt' WHEN 2 THEN 'fpcm' ELSE 'ipcm' END AS fourcc, CAST(CASE WHEN p_size % 3 = 0 THEN 16 ELSE 24 END AS BIGINT) AS samplesize_bits,
 CAST(CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 24 END AS BIGINT) AS pcmc_bits, CAST(CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 2 ELSE 3 END AS BIGINT) AS packet_bytes FROM part"""


@query("dec_26", f"""SELECT *, concat_ws(';', CASE WHEN fourcc NOT IN ('in24', 'sowt') AND pcmc_bits <> samplesize_bits THEN 'declared_bits_conflict' END, CASE WHEN packet_bytes * 8 <> expected_bits THEN 'packet_bytes_conflict' END) AS problems,
 NOT (coalesce(fourcc NOT IN ('in24', 'sowt') AND pcmc_bits <> samplesize_bits, FALSE) OR coalesce(packet_bytes * 8 <> expected_bits, FALSE)) AS consistent FROM (SELECT *, CASE fourcc WHEN 'in24' THEN 24 WHEN 'sowt' THEN 16 ELSE coalesce(pcmc_bits, samplesize_bits) END::BIGINT AS expected_bits FROM ({ENTRIES}))""")
def dec_26(spark, sf):
    return p.entry_consistency(table_sql(spark, sf, ENTRIES, "part"))
