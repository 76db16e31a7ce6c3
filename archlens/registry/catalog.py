"""Catalog queries: sources, scalar expressions, classification, parameters."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions import scalar as s
from ..operators import catalog as c
from ..sources import logs, probe
from . import query
from .trajectory import rounded

# texts with sentinels and malformed numbers, one per part
TEXTS = """SELECT p_partkey AS file_id, CASE p_partkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN NULL
 WHEN 3 THEN '12.5' WHEN 4 THEN 'x9' WHEN 5 THEN CAST(p_size AS STRING) ELSE CAST(p_retailprice AS STRING) END AS t,
 CASE p_partkey % 6 WHEN 0 THEN '30000/1001' WHEN 1 THEN '0/0' WHEN 2 THEN concat(CAST(p_size AS STRING), '/0')
 WHEN 3 THEN concat(CAST(p_size AS STRING), '/7') WHEN 4 THEN 'a/b' ELSE '25' END AS r,
 CASE p_size % 6 WHEN 0 THEN 'yuv420p10le' WHEN 1 THEN 'yuv422p' WHEN 2 THEN 'yuv444p12be' WHEN 3 THEN 'gray' WHEN 4 THEN '' ELSE 'nv12' END AS pix_fmt,
 CAST(CASE WHEN p_partkey % 7 = 0 THEN 10 ELSE 0 END AS BIGINT) AS raw_bits,
 CASE p_partkey % 4 WHEN 0 THEN 'DJI Osmo Action 4' WHEN 1 THEN 'osmo-pocket' WHEN 2 THEN NULL ELSE 'Osmo_Action_5' END AS tool,
 concat('cam', CASE WHEN p_partkey % 5 = 0 THEN ':left' ELSE '' END, ':s', CAST(p_size AS STRING),
   CASE WHEN p_partkey % 3 = 0 THEN 'c' WHEN p_partkey % 3 = 1 THEN ':c' ELSE ':x' END, CAST(p_partkey % 8 AS STRING)) AS channel_id
FROM part"""
CLASSED = """
r0 AS (SELECT *, CASE WHEN rate_text = '0/0' THEN 0.0 ELSE CAST(split_part(rate_text, '/', 1) AS DOUBLE) / CAST(split_part(rate_text, '/', 2) AS DOUBLE) END AS fps,
  coalesce(size_bytes * 8.0::DOUBLE / nullif(duration_sec, 0), 0.0) / 1000 AS ob_kbps FROM v_file),
r1 AS (SELECT *, CASE WHEN width > 0 AND height > 0 AND fps > 0 THEN ob_kbps * 1000 / (width * height * fps) ELSE 0.0 END AS norm FROM r0),
cl AS (SELECT *, CASE WHEN codec IN ('prores', 'dnxhd', 'dnxhr') THEN 'INTRA_LIKE' WHEN norm <= 0 THEN 'NORMAL_LONG_GOP' WHEN norm < 0.12 THEN 'LOW_BITRATE_LONG_GOP'
  WHEN norm >= 0.25 THEN 'HIGH_BITRATE_LONG_GOP' ELSE 'NORMAL_LONG_GOP' END AS source_class FROM r1)"""


def texts(spark, sf):
    return spark.sql(TEXTS.replace("FROM part", f"FROM parquet.`{sf}/part.parquet`"))


def classed(spark, sf):
    return c.classify(view(spark, sf, "v_file"))


@query("scl_01", f"""SELECT file_id, CASE WHEN t IN ('', 'N/A') THEN 0.0 ELSE coalesce(TRY_CAST(t AS DOUBLE), 0.0) END AS as_float,
 CASE WHEN regexp_full_match(t, '\\s*[+-]?\\d+\\s*') THEN CAST(t AS BIGINT) ELSE 0 END::BIGINT AS as_int FROM ({TEXTS})""")
def scl_01(spark, sf):
    t = F.col("t")
    return texts(spark, sf).select("file_id", s.lenient_float(t).alias("as_float"), s.lenient_int(t).alias("as_int"))


@query("scl_02", f"""SELECT file_id, round(coalesce(CASE WHEN r LIKE '%/%' THEN TRY_CAST(split_part(r, '/', 1) AS DOUBLE)
 / nullif(TRY_CAST(split_part(r, '/', 2) AS DOUBLE), 0) ELSE TRY_CAST(r AS DOUBLE) END, 0.0), 6) AS ratio FROM ({TEXTS})""")
def scl_02(spark, sf):
    return rounded(texts(spark, sf).select("file_id", s.ratio(F.col("r")).alias("ratio")))


@query("scl_03", f"""SELECT file_id, CASE WHEN raw_bits > 0 THEN raw_bits WHEN regexp_matches(pix_fmt, 'p(\\d+)(le|be)?$')
 THEN CAST(regexp_extract(pix_fmt, 'p(\\d+)(le|be)?$', 1) AS BIGINT) WHEN pix_fmt <> '' THEN 8 ELSE 0 END::BIGINT AS bits,
 CASE WHEN pix_fmt LIKE '%420%' THEN '4:2:0' WHEN pix_fmt LIKE '%422%' THEN '4:2:2' WHEN pix_fmt LIKE '%444%' THEN '4:4:4'
 WHEN pix_fmt LIKE 'gray%' THEN 'mono' ELSE '' END AS chroma FROM ({TEXTS})""")
def scl_03(spark, sf):
    p = F.col("pix_fmt")
    return texts(spark, sf).select("file_id", s.bit_depth(p, F.col("raw_bits")).alias("bits"), s.chroma(p).alias("chroma"))


AVG_RATE = "CASE WHEN file_id % 3 = 0 THEN '30000/1001' WHEN file_id % 3 = 1 THEN NULL ELSE rate_text END"


@query("scl_04", with_views(f"""SELECT file_id, coalesce(rate_text <> '0/0' AND avg NOT IN ('0/0', 'N/A', '') AND rate_text <> avg, FALSE) AS vfr
 FROM (SELECT file_id, rate_text, {AVG_RATE} AS avg FROM v_file)"""))
def scl_04(spark, sf):
    return view(spark, sf, "v_file").select("file_id", s.is_vfr(F.col("rate_text"), F.expr(AVG_RATE)).alias("vfr"))


@query("scl_05", with_views("""SELECT file_id, round(norm, 6) AS normalized_ob, source_class,
 CASE WHEN codec = 'prores' THEN 'codec ''prores'' matched intra_like_codecs' WHEN norm <= 0 THEN 'fallback: unknown width/height/fps or OB'
 WHEN norm < 0.12 THEN printf('normalized_ob %.6f < low_max 0.12', norm) WHEN norm >= 0.25 THEN printf('normalized_ob %.6f >= high_min 0.25', norm)
 ELSE printf('normalized_ob %.6f within [0.12, 0.25)', norm) END AS evidence FROM cl""", CLASSED))
def scl_05(spark, sf):
    return rounded(classed(spark, sf).select("file_id", "normalized_ob", "source_class", "evidence"))


@query("scl_06", with_views("""SELECT file_id, round(CASE WHEN width * height > 0 THEN sqrt(width * height / 8294400.0::DOUBLE) ELSE 1.0 END, 6) AS spatial,
 round((CASE WHEN fps > 0 THEN fps ELSE 59.94 END) / 59.94::DOUBLE, 6) AS temporal,
 round(CASE WHEN width * height > 0 THEN width * height * (CASE WHEN fps > 0 THEN fps ELSE 59.94 END) / (8294400.0::DOUBLE * 59.94) ELSE 1.0 END, 6) AS pixel_rate FROM cl""", CLASSED))
def scl_06(spark, sf):
    f = s.factors(F.col("width"), F.col("height"), F.col("fps"))
    return rounded(classed(spark, sf).select("file_id", *[x.alias(n) for n, x in f.items()]))


EXPR = "CASE file_id % 4 WHEN 0 THEN 'FR*3' WHEN 1 THEN 'fr * 0.5' WHEN 2 THEN '12.2' ELSE '0' END"


@query("scl_07", with_views(f"""SELECT file_id, greatest(1, least(200, CAST(ceil(CASE file_id % 4 WHEN 0 THEN fps * 3 WHEN 1 THEN fps * 0.5 WHEN 2 THEN 12.2 ELSE 0 END) AS BIGINT)))::BIGINT AS frames,
 greatest(1, CAST(floor(least(greatest(ob_kbps / 1000, 2), 50) + 0.5) AS BIGINT))::BIGINT AS clamped FROM cl""", CLASSED))
def scl_07(spark, sf):
    return classed(spark, sf).select(
        "file_id", s.frame_expression(F.expr(EXPR), F.col("fps"), F.lit(200)).alias("frames"),
        s.clamp_round(F.col("ob_kbps") / 1000, F.lit(2.0), F.lit(50.0)).alias("clamped"))


_RULES = ", ".join(f"('{p}', '{k}', {a}::DOUBLE, {b}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE)"
                   for (p, k), (a, b, d, e) in c.RATE_CAPS.items())
CAPS = f"""
rules AS (SELECT * FROM (VALUES {_RULES}) AS t(preset, source_class, lo, tg, hi, factor)),
cap AS (SELECT file_id, p.preset, CASE WHEN r.lo IS NOT NULL AND ob_kbps > 0 THEN greatest(1, CAST(floor(least(greatest(ob_kbps * tg, ob_kbps * lo), ob_kbps * hi) + 0.5) AS BIGINT)) END AS maxrate_kbps, factor
  FROM cl CROSS JOIN (VALUES ('HQ'), ('SMALL'), ('DRAFT')) AS p(preset) LEFT JOIN rules r ON r.preset = p.preset AND r.source_class = cl.source_class),
cap2 AS (SELECT *, greatest(1, CAST(floor(maxrate_kbps * factor + 0.5) AS BIGINT)) AS raw FROM cap)"""


@query("scl_08", with_views("""SELECT file_id, preset, maxrate_kbps, CASE WHEN maxrate_kbps IS NOT NULL THEN least(raw, 240000) END AS bufsize_kbps,
 CASE WHEN maxrate_kbps IS NULL THEN 'static' WHEN raw > 240000 THEN 'cpb_clamp' ELSE 'dynamic_vbv' END AS mode FROM cap2""", CLASSED, CAPS))
def scl_08(spark, sf):
    return c.rate_caps(classed(spark, sf), ["HQ", "SMALL", "DRAFT"]).select(
        "file_id", "preset", "maxrate_kbps", "bufsize_kbps", "mode")


PROFILE = {"rc_lookahead": "FR*4", "gop_lookahead": "FR*0.25", "min_keyint": "FR*1", "merange": "57", "crf": "18", "me": "star"}


@query("scl_09", with_views("""SELECT file_id, param, mode, round(calc, 6) AS calculated,
 CASE WHEN mode = 'fps' THEN CAST(CAST(least(calc, coalesce(cap, 1e9)) AS BIGINT) AS VARCHAR) WHEN mode = 'sqrt_pixels' THEN CAST(CAST(greatest(1, floor(least(greatest(calc, 16), 92) + 0.5)) AS BIGINT) AS VARCHAR)
 ELSE base END AS final FROM (
 SELECT file_id, p.*, CASE WHEN mode = 'fps' THEN greatest(1, ceil((CASE WHEN fps > 0 THEN fps ELSE 59.94 END) * k)) WHEN mode = 'sqrt_pixels' THEN 57 * (CASE WHEN width * height > 0 THEN sqrt(width * height / 8294400.0::DOUBLE) ELSE 1.0 END) END AS calc
 FROM cl CROSS JOIN (VALUES ('rc_lookahead', 'fps', 'FR*4', 4.0::DOUBLE, 200), ('gop_lookahead', 'fps', 'FR*0.25', 0.25, 200), ('min_keyint', 'fps', 'FR*1', 1.0, NULL),
  ('merange', 'sqrt_pixels', '57', NULL, NULL), ('crf', 'fixed', '18', NULL, NULL), ('me', 'fixed', 'star', NULL, NULL)) AS p(param, mode, base, k, cap))""", CLASSED))
def scl_09(spark, sf):
    return rounded(c.resolve_parameters(classed(spark, sf), PROFILE)
                   .select("file_id", "param", "mode", "calculated", "final"))


@query("scl_10", with_views("""SELECT file_id, CASE WHEN width > 0 AND height > 0 THEN CAST(tw AS BIGINT) END AS target_width, CASE WHEN width > 0 AND height > 0 THEN CAST(greatest(2, round_even(tw * height / width / 2, 0) * 2) AS BIGINT) END AS target_height
 FROM (SELECT *, greatest(2, round_even(width * 0.37 / 2, 0) * 2) AS tw FROM v_file)"""))
def scl_10(spark, sf):
    w, h = s.scaled_size(F.col("width"), F.col("height"), 0.37)
    return view(spark, sf, "v_file").select("file_id", w.alias("target_width"), h.alias("target_height"))


PATHS = "SELECT path_id, concat(path, CASE path_id % 4 WHEN 0 THEN '/Clip 1.mov' WHEN 1 THEN '/clip.a.MP4' WHEN 2 THEN '/.hidden' ELSE '' END) AS path FROM v_path"


def paths(spark, sf):
    return view(spark, sf, "v_path").select("path_id", F.expr(
        "concat(path, CASE path_id % 4 WHEN 0 THEN '/Clip 1.mov' WHEN 1 THEN '/clip.a.MP4' WHEN 2 THEN '/.hidden' ELSE '' END)").alias("path"))


@query("scl_11", with_views("""SELECT path_id, stem, suffix, concat('HQ/', dir, CASE WHEN dir = '' THEN '' ELSE '/' END, stem, CASE WHEN lower(suffix) = '.mov' THEN '.MOV' ELSE '.MP4' END) AS output,
 concat(regexp_replace(stem, '[^\\w.-]+', '_', 'g'), '-', substr(sha1(path), 1, 8)) AS job_id FROM (
 SELECT *, CASE WHEN suffix = '' THEN name ELSE regexp_extract(name, '^(.+)\\.[^.]+$', 1) END AS stem FROM (
 SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS suffix FROM (
 SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM p)))""", f"p AS ({PATHS})"))
def scl_11(spark, sf):
    p = F.col("path")
    return paths(spark, sf).select("path_id", s.stem(p).alias("stem"), s.suffix(p).alias("suffix"),
                                   s.output_path(p, "hq", True).alias("output"), s.job_id(p).alias("job_id"))


TAGGED = "SELECT *, CASE tag_key % 4 WHEN 0 THEN 'rtmd' WHEN 1 THEN 'djmd' ELSE 'tmcd' END AS codec_tag FROM v_stream"


def tagged(spark, sf):
    return view(spark, sf, "v_stream").withColumn("codec_tag", F.expr(
        "CASE tag_key % 4 WHEN 0 THEN 'rtmd' WHEN 1 THEN 'djmd' ELSE 'tmcd' END"))


@query("scl_12", with_views("""SELECT o_orderkey AS file_id, CASE WHEN a IS NULL THEN 'unknown' WHEN a THEN 'A' WHEN b THEN 'B' ELSE 'other' END AS kind
 FROM orders LEFT JOIN (SELECT file_id, bool_or(codec_type = 'data' AND codec_tag = 'rtmd') AS a, bool_or(codec_type = 'data' AND codec_tag = 'djmd') AS b FROM t GROUP BY ALL) k ON k.file_id = o_orderkey""",
                            f"t AS ({TAGGED})"))
def scl_12(spark, sf):
    files = view(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"))
    return c.source_kind(files, tagged(spark, sf))


LOG = ("concat(CASE conv_id % 4 WHEN 0 THEN concat('Input Info AvCuvid: x', chr(10)) WHEN 1 THEN concat('  avqsv: open', chr(10)) ELSE '' END, log_text, chr(10), "
       "CASE WHEN turn % 2 = 0 THEN concat('encoded ', CAST(turn * 100 AS STRING), ' frames, 3 fps', chr(10)) ELSE '' END, "
       "CASE conv_id % 9 WHEN 0 THEN concat('  ', CAST(conv_id AS STRING), ' frames, End of file') WHEN 1 THEN 'Unable to decode by hw' WHEN 2 THEN 'Invalid device id = 1' "
       "WHEN 3 THEN 'No space left on device' WHEN 4 THEN 'moov atom not found' WHEN 5 THEN 'Could not find stream' WHEN 6 THEN 'decoder x not supported' ELSE '  last line' END)")


def log_rows(spark, sf):
    return view(spark, sf, "v_log").select("conv_id", "turn", F.expr(LOG).alias("log"))


@query("scl_13", with_views("""SELECT conv_id, turn, nullif(lower(CASE WHEN regexp_matches(log, '(?i)Input\\s+Info\\s+[A-Za-z][A-Za-z0-9_]*\\s*:') THEN regexp_extract(log, '(?i)Input\\s+Info\\s+([A-Za-z][A-Za-z0-9_]*)\\s*:', 1)
 ELSE regexp_extract(log, '(?im)^\\s*(avcuvid|avqsv|avsw|avhw|d3d11va|d3d11|dxva2|cuda|vulkan):', 1) END), '') AS reader,
 TRY_CAST(regexp_extract(log, '(?i)encoded\\s+(\\d+)\\s+frames', 1) AS BIGINT) AS encoded, TRY_CAST(regexp_extract(log, '(?m)^\\s*(\\d+)\\s+frames,\\s*End of file', 1) AS BIGINT) AS reported
 FROM l""", f"l AS (SELECT conv_id, turn, {LOG} AS log FROM v_log)"))
def scl_13(spark, sf):
    log = F.col("log")
    return log_rows(spark, sf).select("conv_id", "turn", s.reader_name(log).alias("reader"),
                                      s.encoded_frames(log).alias("encoded"), s.reader_frames(log).alias("reported"))


def _any(words):
    return "(" + " OR ".join(f"contains(lower(log), '{w}')" for w in words) + ")"


@query("scl_14", with_views(f"""SELECT conv_id, turn, CASE WHEN {_any(s.ENVIRONMENT_TEXT)} THEN 'environment' WHEN {_any(s.READER_TEXT)} THEN 'reader' ELSE 'format' END AS failure FROM l""",
                            f"l AS (SELECT conv_id, turn, {LOG} AS log FROM v_log)"))
def scl_14(spark, sf):
    return log_rows(spark, sf).select("conv_id", "turn", s.failure_class(F.col("log")).alias("failure"))


def _line(needle):
    return (f"substr(CASE WHEN trim(regexp_extract(log, '(?im)^(.*{needle}.*)$', 1)) = '' THEN '{needle}' "
            f"ELSE trim(regexp_extract(log, '(?im)^(.*{needle}.*)$', 1)) END, 1, 300)")


_RF = [("startup_failed", "code = 3221225781", "'loader failure rc=0xC0000135'"),
       ("startup_failed", "trim(log) = ''", "'no tool output at all (rc=None); the process did not start'"),
       ("capability_refused", "contains(lo, 'unable to decode by')", _line("unable to decode")),
       ("device_unavailable", "(contains(lo, 'invalid device id') OR contains(lo, 'no device'))", _line("device")),
       ("decode_failed", "(contains(lo, 'failed to open') OR contains(lo, 'could not find'))", _line("open")),
       ("capability_refused", "(contains(lo, 'decoder') AND contains(lo, 'not supported'))", _line("not supported"))]


@query("scl_15", with_views(
    "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {t} THEN '{r}'" for r, t, _ in _RF) + " ELSE 'decode_failed' END AS reason, CASE "
    + " ".join(f"WHEN {t} THEN {d}" for _, t, d in _RF)
    + " ELSE substr(regexp_extract(regexp_replace(log, '\\s+$', ''), '([^\\n]*)$', 1), 1, 300) END AS detail, CASE "
    + " ".join(f"WHEN {t} THEN {d.replace(', 1, 300)', ', 1)')}" for _, t, d in _RF)
    + " ELSE regexp_extract(regexp_replace(log, '\\s+$', ''), '([^\\n]*)$', 1) END AS full_detail FROM l",
    f"l AS (SELECT *, lower(log) AS lo FROM (SELECT conv_id, turn, CASE WHEN turn = 5 THEN '  ' ELSE {LOG} END AS log, CASE WHEN conv_id % 11 = 0 THEN 3221225781 END AS code FROM v_log))"))
def scl_15(spark, sf):
    rows = log_rows(spark, sf).select(
        "conv_id", "turn", F.when(F.col("turn") == 5, "  ").otherwise(F.col("log")).alias("log"),
        F.when(F.col("conv_id") % 11 == 0, F.lit(0xC0000135)).alias("code"))
    reason, detail = s.reader_failure(F.col("log"), F.col("code"))
    return rows.select("conv_id", "turn", reason.alias("reason"), s.short_detail(detail).alias("detail"),
                       detail.alias("full_detail"))


@query("scl_16", with_views("""SELECT file_id, block_no, round(10 * log10(list_sum([x::DOUBLE * x::DOUBLE for x in samples]) / len(samples)), 6) AS rms_dbfs,
 round(power(10.0, -(block_no % 60) / 20.0), 6) AS gain, round(20 * log10(power(10.0, -(block_no % 60) / 20.0)), 6) AS db FROM v_base"""))
def scl_16(spark, sf):
    gain = s.db_to_linear(-(F.col("block_no") % 60))
    return rounded(view(spark, sf, "v_base").select(
        "file_id", "block_no", s.rms_dbfs(F.col("samples")).alias("rms_dbfs"), gain.alias("gain"),
        s.linear_to_db(gain).alias("db")))


@query("scl_17", """SELECT event_id, CAST(sign(v) * floor(abs(v * 48000) + 0.5) AS BIGINT) AS samples, CAST(sign(v) * floor(abs(v * 48000) + 0.5) AS BIGINT) / 48000.0::DOUBLE AS seconds,
 CAST(sign(v) * floor(abs(v * 48000) + 0.5) AS BIGINT) - user_id AS timeline FROM (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN value ELSE -value / 7 END AS v FROM events)""")
def scl_17(spark, sf):
    v = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value") / 7)
    n = s.samples_from_seconds(v, 48000)
    return rounded(view(spark, sf, "events").select("event_id", n.alias("samples"), (n / 48000.0).alias("seconds"),
                                                    (n - F.col("user_id")).alias("timeline")), "seconds")


@query("scl_18", """SELECT page_id AS path_id, array_to_string([CASE WHEN regexp_full_match(p, '\\d+') THEN concat('0:', lpad(ltrim(p, '0'), 20, '0')) ELSE concat('1:', p) END for p in regexp_extract_all(lower(url), '(\\d+|\\D+)')], '|') AS sort_key FROM pages""")
def scl_18(spark, sf):
    key = F.array_join(F.transform(s.natural_key(F.col("path")), lambda e: F.when(
        e["kind"] == 0, F.concat(F.lit("0:"), F.lpad(F.nullif(e["num"].cast("string"), F.lit("0")), 20, "0")))
        .otherwise(F.concat(F.lit("1:"), e["text"]))), "|")
    return view(spark, sf, "v_path").select("path_id", key.alias("sort_key"))


@query("scl_19", "SELECT page_id AS path_id, CAST(concat('0x', substr(sha256(url), 1, 2)) AS INTEGER) % 7 = 0 AS selected FROM pages")
def scl_19(spark, sf):
    return view(spark, sf, "v_path").select("path_id", s.one_in(F.col("path"), 7).alias("selected"))


OUTPUTS = "SELECT p_partkey AS file_id, CAST(round(p_retailprice * (p_size % 30) * 5000) AS BIGINT) AS output_bytes FROM part WHERE p_partkey % 9 <> 0"
SAVED = """SELECT file_id, size_bytes, output_bytes, round(size_bytes / 1048576.0::DOUBLE, 6) AS source_mb, round(size_bytes / 1073741824.0::DOUBLE, 6) AS source_gib, round(size_bytes / 1e9, 6) AS source_gb,
 round(output_bytes / 1048576.0::DOUBLE, 6) AS output_mb, round(CASE WHEN size_bytes > 0 THEN output_bytes / size_bytes::DOUBLE ELSE 0.0 END, 6) AS output_source_ratio,
 round(1 - CASE WHEN size_bytes > 0 THEN output_bytes / size_bytes::DOUBLE ELSE 0.0 END, 6) AS space_saved_ratio FROM """


def outputs(spark, sf):
    return spark.sql(OUTPUTS.replace("FROM part", f"FROM parquet.`{sf}/part.parquet`"))


@query("scl_20", SAVED + "(SELECT o_orderkey AS file_id, CAST(round(o_totalprice) AS BIGINT) * (o_orderkey % 5) AS size_bytes, CAST(round(o_totalprice / 3) AS BIGINT) AS output_bytes FROM orders)")
def scl_20(spark, sf):
    rows = view(spark, sf, "orders").selectExpr(
        "o_orderkey AS file_id", "CAST(round(o_totalprice) AS BIGINT) * (o_orderkey % 5) AS size_bytes", "CAST(round(o_totalprice / 3) AS BIGINT) AS output_bytes")
    m = c.saving_metrics(F.col("size_bytes"), F.col("output_bytes"))
    return rounded(rows.select("*", *[x.alias(n) for n, x in m.items()]))


@query("jon_13", with_views(SAVED + "(SELECT v_file.file_id, size_bytes, output_bytes FROM v_file JOIN o USING (file_id))", f"o AS ({OUTPUTS})"))
def jon_13(spark, sf):
    return rounded(c.savings(view(spark, sf, "v_file"), outputs(spark, sf)))


BITS = "CASE WHEN stream_index % 3 = 0 THEN 192000 WHEN stream_index % 3 = 1 THEN 127999 + stream_index ELSE 0 END"


@query("scl_21", with_views(f"""SELECT file_id, stream_index, CASE WHEN codec_name LIKE 'pcm_%' THEN 'pcm' ELSE 'compressed' END AS family,
 CASE WHEN b <= 0 THEN '' WHEN b % 1000 = 0 THEN concat(CAST(b // 1000 AS VARCHAR), 'k') ELSE CAST(b AS VARCHAR) END AS bitrate FROM (SELECT *, {BITS} AS b FROM v_stream)"""))
def scl_21(spark, sf):
    return view(spark, sf, "v_stream").select(
        "file_id", "stream_index", F.when(s.is_pcm(F.col("codec_name")), "pcm").otherwise("compressed").alias("family"),
        s.bitrate_text(F.expr(BITS)).alias("bitrate"))


@query("scl_22", f"SELECT file_id, coalesce(contains(replace(replace(replace(lower(tool), ' ', ''), '_', ''), '-', ''), 'action'), FALSE) AS keep_metadata FROM ({TEXTS})")
def scl_22(spark, sf):
    return texts(spark, sf).select("file_id", s.is_action_series(F.col("tool")).alias("keep_metadata"))


@query("scl_23", f"""SELECT file_id, nullif(regexp_extract(channel_id, '^(.+):s(\\d+):?c(\\d+)$', 1), '') AS source_id, TRY_CAST(regexp_extract(channel_id, '^(.+):s(\\d+):?c(\\d+)$', 2) AS BIGINT) AS stream_index,
 TRY_CAST(regexp_extract(channel_id, '^(.+):s(\\d+):?c(\\d+)$', 3) AS BIGINT) AS channel_index FROM ({TEXTS})""")
def scl_23(spark, sf):
    parts = s.channel_parts(F.col("channel_id"))
    return texts(spark, sf).select("file_id", *[x.alias(n) for n, x in parts.items()])


def probe_documents(spark, sf):
    """Probe JSON built from the file view: one document per file."""
    f = view(spark, sf, "v_file")
    none = F.lit(None).cast("string")
    stream = lambda i, kind, codec, **kw: F.struct(
        F.lit(i).alias("index"), F.lit(kind).alias("codec_type"), codec.alias("codec_name"),
        *[kw.get(n, none).alias(n) for n in ("width", "height", "r_frame_rate", "avg_frame_rate", "nb_frames", "duration", "channels", "sample_rate")])
    k = F.col("file_id")
    video = stream(0, "video", F.col("codec"), width=F.col("width").cast("string"), height=F.col("height").cast("string"),
                   r_frame_rate=F.col("rate_text"), avg_frame_rate=F.when(k % 2 == 0, F.col("rate_text")).otherwise(""),
                   nb_frames=F.when(k % 5 == 0, F.lit("777")).otherwise("N/A"), duration=F.col("duration_sec").cast("string"))
    audio = stream(1, "audio", F.lit("pcm_s24be"), channels=F.lit("2"), sample_rate=F.lit("48000"), duration=F.col("duration_sec").cast("string"))
    data = stream(2, "data", F.lit("rtmd"))
    streams = F.when(k % 3 == 0, F.array(video, audio, data)).when(k % 3 == 1, F.array(video, audio)).otherwise(F.array(audio, video))
    doc = F.struct(F.struct(F.when(k % 4 == 0, "N/A").otherwise(F.col("duration_sec").cast("string")).alias("duration"),
                            F.col("size_bytes").cast("string").alias("size"),
                            F.when(k % 6 == 0, F.lit("8000000")).alias("bit_rate")).alias("format"), streams.alias("streams"))
    return f.select("file_id", F.to_json(doc).alias("value"))


@query("src_02", with_views("""SELECT file_id, duration_sec, round(fps, 6) AS fps, size_bytes, CAST(CASE WHEN file_id % 5 = 0 THEN 777 WHEN duration_sec > 0 AND fps > 0 THEN ceil(duration_sec * fps) ELSE 0 END AS BIGINT) AS total_frames,
 round(CASE WHEN file_id % 6 = 0 THEN 8000000 WHEN size_bytes > 0 AND duration_sec > 0 THEN size_bytes * 8.0::DOUBLE / duration_sec ELSE 0.0 END, 4) AS bitrate_bps, width::BIGINT AS width, height::BIGINT AS height, codec,
 CASE WHEN file_id % 3 = 0 THEN 3 ELSE 2 END::BIGINT AS stream_count, 1::BIGINT AS video_streams, 1::BIGINT AS audio_streams, CASE WHEN file_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS data_streams FROM cl""", CLASSED))
def src_02(spark, sf):
    files = probe.media_files(probe.parse_probe(probe_documents(spark, sf)))
    return rounded(files.withColumn("bitrate_bps", F.round("bitrate_bps", 4)))


@query("src_04", """SELECT event_id, round(CAST(value AS DOUBLE), 6) AS psnr FROM events WHERE event_type <> 'view'""")
def src_04(spark, sf):
    lines = view(spark, sf, "events").select("event_id", F.when(
        F.col("event_type") == "view", "frame dropped").otherwise(
        F.concat(F.lit("n:1 mse_avg:0.3 psnr_avg:"), F.col("value").cast("string"), F.lit(" psnr_y:9"))).alias("value"))
    return rounded(logs.metric_values(lines))


@query("agg_19", with_views("""SELECT file_id, count(*) AS stream_count, count(*) FILTER (codec_type = 'video') AS video_streams, count(*) FILTER (codec_type = 'audio') AS audio_streams, count(*) FILTER (codec_type = 'data') AS data_streams,
 coalesce(string_agg(concat(CAST(stream_index AS VARCHAR), ':', codec_name), ';' ORDER BY stream_index) FILTER (codec_type = 'audio'), '') AS audio_codecs FROM v_stream GROUP BY ALL"""))
def agg_19(spark, sf):
    return c.stream_summary(view(spark, sf, "v_stream"))
