"""Ledger, sink and sort queries."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..operators import ledger as g
from ..session import scratch_path
from . import query
from .preserve import table_sql
from .trajectory import rounded

FOLD = """
fo AS (SELECT file_id, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'WARN') THEN 'WARN' WHEN bool_or(verdict = 'UNMEASURABLE') AND NOT bool_or(verdict = 'PASS') THEN 'UNMEASURABLE' ELSE 'PASS' END AS overall FROM v_check GROUP BY ALL)"""


@query("agg_11", with_views("SELECT * FROM fo", FOLD))
def agg_11(spark, sf):
    return g.verdict_fold(view(spark, sf, "v_check"))


RECORDS = """SELECT doc_id AS file_id, CASE doc_id % 7 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'partial' WHEN 2 THEN 'metadata_mismatch' WHEN 3 THEN 'container_fixed' WHEN 4 THEN 'applied' ELSE 'checked' END AS status,
 CASE WHEN doc_id % 5 = 0 THEN 'boom' END AS error, doc_id % 3 = 0 AS no_fix_needed, doc_id % 4 <> 0 AS identical FROM documents"""


@query("agg_12", with_views(f"""SELECT file_id, CASE WHEN status = 'unreadable' THEN 'UNREADABLE' WHEN status = 'partial' THEN 'PARTIAL' WHEN error IS NOT NULL AND (status IN ('metadata_mismatch', 'sample_entry_mismatch') OR NOT no_fix_needed) THEN 'FAILED'
 WHEN coalesce(f, FALSE) THEN 'FAILED' WHEN status = 'container_fixed' THEN 'REPAIRED' WHEN status = 'applied' THEN CASE WHEN identical THEN 'REPAIRED' ELSE 'FAILED' END WHEN no_fix_needed OR error IS NULL THEN 'NOOP' ELSE 'FAILED' END AS outcome
 FROM ({RECORDS}) LEFT JOIN (SELECT file_id, bool_or(verdict = 'FAIL') AS f FROM v_check GROUP BY ALL) USING (file_id)"""))
def agg_12(spark, sf):
    return g.repair_outcome(table_sql(spark, sf, RECORDS, "documents"), view(spark, sf, "v_check"))


@query("agg_13", with_views("""SELECT CAST(grouping_id(dir, overall) AS BIGINT) AS level, dir, overall, count(*) AS n FROM (SELECT fo.*, source AS dir FROM fo JOIN documents ON doc_id = file_id) GROUP BY GROUPING SETS ((overall), (dir, overall), ())""", FOLD))
def agg_13(spark, sf):
    dirs = view(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("dir"))
    return g.batch_ledger(g.verdict_fold(view(spark, sf, "v_check")).join(dirs, "file_id"))


@query("agg_13_failed", with_views("SELECT file_id, string_agg(DISTINCT check_id, ',' ORDER BY check_id) AS checks FROM v_check WHERE verdict = 'FAIL' GROUP BY ALL"))
def agg_13_failed(spark, sf):
    return g.failed_files(view(spark, sf, "v_check"))


@query("agg_14", with_views("""SELECT coalesce(bucket, 'total') AS bucket, count(*) AS files, sum(targets)::BIGINT AS targets, sum(aligned)::BIGINT AS aligned, sum(still_off)::BIGINT AS still_off, count(*) FILTER (targets > 0 AND targets = aligned) AS full_files FROM (
 SELECT c_custkey, CASE WHEN d < 20 THEN '0-20s' WHEN d < 40 THEN '20-40s' WHEN d < 60 THEN '40-60s' WHEN d < 120 THEN '60-120s' WHEN d < 300 THEN '120-300s' ELSE '>300s' END AS bucket, coalesce(targets, 0) AS targets, coalesce(aligned, 0) AS aligned, coalesce(still_off, 0) AS still_off
 FROM (SELECT c_custkey, c_custkey % 400 AS d FROM customer WHERE c_custkey % 50 <> 0) LEFT JOIN (SELECT file_id, count(*) FILTER (t) AS targets, count(*) FILTER (t AND a) AS aligned, count(*) FILTER (t AND NOT a AND abs(delay_ms) >= 5000.0 / 48000) AS still_off
  FROM (SELECT *, NOT (decision = 'anchor' AND reason IS NULL) AS t, decision IN ('fixed', 'already_aligned') AS a FROM v_track_b) GROUP BY ALL) ON file_id = c_custkey) GROUP BY ROLLUP (bucket)"""))
def agg_14(spark, sf):
    files = view(spark, sf, "customer").selectExpr("c_custkey AS file_id", "CAST(CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey % 400 END AS DOUBLE) AS duration_sec")
    return g.outcome_by_duration(files, view(spark, sf, "v_track_b"))


@query("agg_15", with_views("""SELECT 'codec' AS stratum, concat_ws('/', codec, CAST(width AS VARCHAR)) AS key, count(*) AS n FROM v_file GROUP BY ALL UNION ALL SELECT 'dir', concat_ws('/', dir, codec), count(*) FROM v_file GROUP BY ALL"""))
def agg_15(spark, sf):
    return g.strata(view(spark, sf, "v_file"), {"codec": ["codec", "width"], "dir": ["dir", "codec"]})


@query("agg_25", with_views("""SELECT 'checks' AS tier, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'FAIL') AS failed FROM v_check
 UNION ALL SELECT 'tracks', count(*) FILTER (decision IN ('fixed', 'already_aligned')), count(*) FILTER (decision = 'untouched') FROM v_track_a UNION ALL SELECT 'facts', count(*) FILTER (value IS NOT NULL), count(*) FILTER (value IS NULL) FROM v_fact"""))
def agg_25(spark, sf):
    d, v, x = F.col("decision"), F.col("verdict"), F.col("value")
    return g.collate({"checks": (view(spark, sf, "v_check"), v == "PASS", v == "FAIL"),
                      "tracks": (view(spark, sf, "v_track_a"), d.isin("fixed", "already_aligned"), d == "untouched"),
                      "facts": (view(spark, sf, "v_fact"), x.isNotNull(), x.isNull())})


@query("snk_01", """SELECT conv_id, turn, 'encode' AS stage, role AS backend, CASE WHEN t IS NULL OR t = '' THEN '(no log available)' ELSE array_to_string(list_reverse(list_reverse(string_split(regexp_replace(t, '\\n$', ''), chr(10)))[1:8]), chr(10)) END AS summary, t AS log
 FROM (SELECT *, CASE WHEN turn = 7 THEN NULL ELSE text END AS t FROM conversations)""")
def snk_01(spark, sf):
    rows = view(spark, sf, "v_log").select("conv_id", "turn", F.lit("encode").alias("stage"), F.col("role").alias("backend"),
                                           F.when(F.col("turn") == 7, None).otherwise(F.col("log_text")).alias("log"))
    path = scratch_path(spark)
    for part in (0, 1):  # two runs append to one table
        g.append_failures(rows.where(F.col("conv_id") % 2 == part), path)
    return spark.read.parquet(path)


LISTS = """SELECT page_id AS list_id, CASE page_id % 4 WHEN 0 THEN concat('[{"source": "', url, '", "stage": "x"}, "', url, '?b"]') WHEN 1 THEN concat('# note', chr(10), url, chr(10), '//', url, chr(10), '  ', url, '?a  ') WHEN 2 THEN url ELSE '[]' END AS text FROM pages"""


@query("snk_02", """SELECT page_id AS list_id, url AS source FROM pages WHERE page_id % 4 IN (0, 1, 2) AND page_id % 3 <> 0 UNION ALL SELECT page_id, concat(url, '?a') FROM pages WHERE page_id % 4 = 1 AND EXISTS (SELECT 1 FROM pages q WHERE q.url = concat(pages.url, '?a') AND q.page_id % 3 <> 0)
 UNION ALL SELECT page_id, url FROM pages WHERE page_id % 4 IN (0, 1, 2) AND page_id % 3 = 0 AND EXISTS (SELECT 1 FROM pages q WHERE q.url = pages.url AND q.page_id % 3 <> 0)""")
def snk_02(spark, sf):
    sources = view(spark, sf, "v_path").where("path_id % 3 <> 0").select(F.col("path").alias("source"))
    return g.load_retry(table_sql(spark, sf, LISTS, "pages"), sources).select("list_id", "source")


@query("jon_04", with_views("""SELECT name FROM v_file WHERE file_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 AND p_size % 5 <> 0)"""))
def jon_04(spark, sf):
    files = view(spark, sf, "v_file").select("name", "file_id")
    outputs = table_sql(spark, sf, "SELECT p_partkey AS file_id, p_size % 5 AS size FROM part WHERE p_partkey % 4 = 0", "part")
    return g.pending(files, outputs, "file_id").select("name")


VIDEOS = "SELECT p_partkey AS video_id, p_brand AS dir, concat('Clip', CAST(p_partkey % 60 AS STRING), CASE WHEN p_partkey % 5 = 0 THEN '-b' ELSE '' END) AS stem FROM part WHERE p_partkey % 2 = 0"
AUDIOS = """SELECT p_brand AS dir, concat(CASE WHEN p_partkey % 2 = 0 THEN 'clip' ELSE 'CLIP' END, CAST(p_partkey % 60 AS STRING), CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN '-1' WHEN 2 THEN '_002' WHEN 3 THEN '_take' WHEN 4 THEN 'x' WHEN 5 THEN '-b_7' WHEN 6 THEN '--03' ELSE '_b-2' END,
 CASE WHEN p_partkey % 3 = 0 THEN '.WAV' WHEN p_partkey % 3 = 1 THEN '.flac' ELSE '.txt' END) AS name FROM part"""
MATCH = f"""
hits AS (SELECT video_id, min(name) AS name, min(tail) AS remainder FROM (SELECT v.video_id, a.name, substr(lower(regexp_replace(a.name, '\\.[^.]+$', '')), length(v.stem) + 1) AS tail FROM ({VIDEOS}) v JOIN ({AUDIOS}) a ON a.dir = v.dir AND starts_with(lower(a.name), lower(v.stem)) AND NOT ends_with(a.name, '.txt'))
  WHERE tail = '' OR substr(tail, 1, 1) IN ('-', '_') GROUP BY video_id, lower(name))"""


@query("jon_03", f"WITH {MATCH} SELECT video_id, name, remainder, CASE WHEN remainder = '' THEN 0 WHEN regexp_full_match(remainder, '[-_]+\\d+') THEN 1 ELSE 2 END::BIGINT AS rank, TRY_CAST(regexp_extract(remainder, '^[-_]+(\\d+)$', 1) AS BIGINT) AS index FROM hits")
def jon_03(spark, sf):
    return g.match_external(table_sql(spark, sf, VIDEOS, "part"), table_sql(spark, sf, AUDIOS, "part"))


@query("srt_02", f"WITH {MATCH} SELECT video_id, name FROM hits")
def srt_02(spark, sf):
    return g.candidate_order(jon_03(spark, sf)).select("video_id", "name")


@query("srt_01", with_views("SELECT file_id, name, size_bytes FROM v_file ORDER BY size_bytes DESC, name"))
def srt_01(spark, sf):
    return g.largest_first(view(spark, sf, "v_file").select("file_id", "name", "size_bytes"))


@query("srt_03", with_views("SELECT track_id, reason, round(delay_ms, 6) AS delay_ms FROM v_track_a WHERE decision = 'untouched' ORDER BY abs(delay_ms) DESC, track_id LIMIT 20"))
def srt_03(spark, sf):
    rows = view(spark, sf, "v_track_a").where("decision = 'untouched'").select("track_id", "reason", "delay_ms")
    return rounded(g.worst(rows, 20, F.abs("delay_ms").desc(), F.col("track_id")))
