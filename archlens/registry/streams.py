"""Source and stream queries. Files and snapshots go to the cluster's shared folder."""
from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..session import configure, cut_lineage, scratch_path
from ..sources import files as disk, isobmff, ledgers, media, wav
from ..streaming import jobs
from . import query
from .catalog import PATHS, classed, paths
from .trajectory import rounded


def stream_of(spark, sf, table):
    configure(spark)
    schema = spark.read.parquet(f"{sf}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{table}*.parquet")


@query("src_01", with_views("SELECT path_id, path, lower(path) AS order_key FROM p WHERE lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) IN ('.mp4', '.mov') AND regexp_full_match(split_part(path, '/', 1), 'https?:')", f"p AS ({PATHS})"))
def src_01(spark, sf):
    return media.select_media(paths(spark, sf), dir_regex="https?:")


@query("src_03", with_views("""SELECT name AS source, 'HQ' AS preset, codec, width::BIGINT AS width, size_bytes AS source_size_bytes, round(CASE WHEN width = 0 THEN NULL ELSE ob_kbps END, 6) AS container_bitrate_kbps, NULL::VARCHAR AS profile FROM cl""",
    """cl AS (SELECT *, coalesce(size_bytes * 8.0::DOUBLE / nullif(duration_sec, 0), 0.0) / 1000 AS ob_kbps FROM v_file)"""))
def src_03(spark, sf):
    rows = classed(spark, sf).select(
        F.col("name").alias("source"), F.lit("HQ").alias("preset"), "codec", "width", F.col("size_bytes").alias("source_size_bytes"),
        F.when(F.col("width") != 0, F.col("ob_kbps")).alias("container_bitrate_kbps"), F.lit("").alias("profile"), F.lit(1).alias("not_a_column"))
    path = scratch_path(spark)
    ledgers.write_ledger(rows, "pre", path)
    return rounded(ledgers.read_ledger(spark, "pre", path).select("source", "preset", "codec", "width", "source_size_bytes", "container_bitrate_kbps", "profile"))


def little_endian(value, digits):
    """Hex text of a non-negative integer column, least byte first."""
    text = F.lpad(F.hex(value), digits, "0")
    return F.concat(*[F.substring(text, digits - 1 - 2 * i, 2) for i in range(digits // 2)])


def big_endian(value, digits=8):
    return F.lpad(F.hex(F.lit(value) if isinstance(value, int) else value), digits, "0")


def ascii_hex(text):
    return F.lit(text.encode("latin-1").hex().upper())


def spread(files):
    """Rows dealt over all tasks: tables of few bytes make many files, and come in one part."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_folders(files):
    """Paths below one of 256 folders each, so that no folder holds all files."""
    return files.withColumn("path", F.concat(F.lower(F.lpad(F.hex(F.pmod(F.xxhash64("path"), F.lit(256))), 2, "0")), F.lit("/"), "path"))


def wav_files(spark, sf):
    """A two-channel WAV file per block of the samples, as (path, content)."""
    ints = F.transform("samples", lambda v: F.pmod(F.rint(v.cast("double") * 32767.0).cast("bigint"), F.lit(65536)))
    data = F.array_join(F.transform(ints, lambda v: little_endian(v, 4)), "")
    n = F.size("samples") * 2
    le = lambda v, d: little_endian(F.lit(v), d)
    header = F.concat(ascii_hex("RIFF"), little_endian(n + 36, 8), ascii_hex("WAVEfmt "), le(16, 8), le(1, 4), le(2, 4), le(48000, 8), le(192000, 8), le(4, 4), le(16, 4), ascii_hex("data"), little_endian(n, 8))
    return view(spark, sf, "v_base").select(F.concat(F.lit("f"), "file_id", F.lit("-"), "block_no", F.lit(".wav")).alias("path"), F.unhex(F.concat(header, data)).alias("content"))


def wav_sums(rows):
    return rounded(rows.where("error IS NULL").select("path", "channel", "block_no", "start_sample", "sample_rate", F.size("samples").cast("bigint").alias("n"),
                                                      F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double")).alias("total")))


WAV_SQL = with_views("""SELECT concat('f', file_id, '-', block_no, '.wav') AS path, c::BIGINT AS channel, b::BIGINT AS block_no, b::BIGINT * 12 AS start_sample, 48000::BIGINT AS sample_rate, len(x)::BIGINT AS n, round(list_sum(x), 6) AS total FROM (SELECT file_id, block_no, c, b, [round_even(v * 32767.0::DOUBLE, 0) / 32768 for v in list_slice([samples[2 * i + 1 + c]::DOUBLE for i in range(32)], b * 12 + 1, b * 12 + 12)] AS x FROM v_base, range(2) q(c), range(3) r(b))""")


@query("src_05", WAV_SQL)
def src_05(spark, sf):
    return wav_sums(wav.blocks_from_content(spread(wav_files(spark, sf)), 12))


@query("src_05_files", WAV_SQL)
def src_05_files(spark, sf):
    """The same files on disk, read by the registered format."""
    path = scratch_path(spark)
    disk.write_files(spread(in_folders(wav_files(spark, sf))), path).write.format("noop").mode("overwrite").save()
    disk.register(spark, wav.WavBlocks)
    rows = spark.read.format("wav_blocks").option("path", path).option("blockSamples", 12).load()
    return wav_sums(rows).withColumn("path", F.substring_index("path", "/", -1))


def box(kind, body):
    return F.concat(big_endian((F.length(body) / 2 + 8).cast("bigint")), ascii_hex(kind), body)


def movie_files(spark, sf):
    """A small movie per file row, as (path, content)."""
    f = view(spark, sf, "v_file")
    zeros = lambda n: F.lit("00" * n)
    mvhd = box("mvhd", F.concat(zeros(12), big_endian(1000), big_endian((F.col("width") * 1000 + F.col("file_id") % 10).cast("bigint")), zeros(4)))
    hdlr = box("hdlr", F.concat(zeros(8), ascii_hex("meta"), zeros(12)))
    entry = F.when(F.col("file_id") % 3 == 0, ascii_hex("rtmd")).otherwise(ascii_hex("tmcd"))
    stsd = box("stsd", F.concat(zeros(4), big_endian(1), big_endian(16), entry, zeros(8)))
    uid = box("uuid", F.concat(F.lit("AB" * 16), F.hex(F.encode("name", "utf-8"))))
    tref = box("tref", box("cdsc", big_endian(1)))
    trak = box("trak", F.concat(tref, box("mdia", F.concat(hdlr, box("minf", box("stbl", stsd)))), uid))
    moov, mdat = box("moov", F.concat(mvhd, trak)), box("mdat", zeros(40))
    ftyp = F.when(F.col("file_id") % 7 == 0, "").otherwise(box("ftyp", F.concat(ascii_hex("XAVC"), zeros(4))))
    content = F.concat(ftyp, F.when(F.col("file_id") % 2 == 0, F.concat(moov, mdat)).otherwise(F.concat(mdat, moov)))
    return f.select(F.col("name").alias("path"), F.unhex(content).alias("content"))


def movie_facts(boxes):
    boxes = cut_lineage(boxes)  # facts, handlers and items all read them
    return isobmff.container_facts(boxes).join(isobmff.uuid_items(boxes).select("path", "ctx", "sha"), "path")


MOVIE_SQL = with_views("""SELECT name AS path, CASE WHEN file_id % 7 = 0 THEN NULL ELSE 'XAVC' END AS brand, file_id % 2 = 0 AS moov_first, width + file_id % 10 / 1000.0::DOUBLE AS mvhd_sec, 1::BIGINT AS trak_count, 1::BIGINT AS uuid_count, TRUE AS has_cdsc, CASE WHEN file_id % 3 = 0 THEN 'rtmd' END AS data_entry, 0::BIGINT AS meta_scopes, concat('trak:', 'meta') AS ctx, sha256(name) AS sha FROM v_file""")


@query("src_06", MOVIE_SQL)
def src_06(spark, sf):
    return movie_facts(isobmff.boxes_from_content(spread(movie_files(spark, sf))))


@query("src_06_files", MOVIE_SQL)
def src_06_files(spark, sf):
    """The same movies on disk, read by the registered format."""
    path = scratch_path(spark)
    disk.write_files(spread(in_folders(movie_files(spark, sf))), path).write.format("noop").mode("overwrite").save()
    disk.register(spark, isobmff.MediaBoxes)
    boxes = spark.read.format("isobmff_boxes").option("path", path).load()
    return movie_facts(boxes.withColumn("path", F.substring_index("path", "/", -1)))


@query("str_01", with_views("SELECT path_id, path FROM p WHERE regexp_matches(lower(path), '\\.(mp4|mov)$')", f"p AS ({PATHS})"))
def str_01(spark, sf):
    path = scratch_path(spark)
    pages = stream_of(spark, sf, "pages").select(F.col("page_id").alias("path_id"), F.expr(
        "concat(url, CASE page_id % 4 WHEN 0 THEN '/Clip 1.mov' WHEN 1 THEN '/clip.a.MP4' WHEN 2 THEN '/.hidden' ELSE '' END)").alias("path"))
    run = jobs.process_arrivals(media.select_media(pages), lambda df, n: df.write.mode("append").parquet(f"{path}/arrived"), f"{path}/checkpoint")
    run.awaitTermination()
    return spark.read.parquet(f"{path}/arrived").select("path_id", "path")


EV = """CAST(user_id AS STRING) AS source, event_id AS seq, CASE event_type WHEN 'view' THEN 'admit' WHEN 'click' THEN 'update' WHEN 'signup' THEN 'update' ELSE 'finish' END AS kind, concat('p', CAST(event_id % 3 AS STRING)) AS preset,
 CASE event_type WHEN 'click' THEN 'encoding' WHEN 'signup' THEN '' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE '' END AS status, CASE WHEN event_id % 4 = 0 THEN 'note' ELSE '' END AS detail, event_id % 50 AS frames, CASE WHEN event_id % 3 = 0 THEN 0.0{d} ELSE value END AS fps"""
STATUS_SQL = f"""WITH e AS (SELECT *, {EV.format(d='::DOUBLE').replace('event_id AS seq', 'event_id AS seq')} FROM events), a AS (SELECT source, min(seq) AS a0, arg_min(preset, seq) AS preset, arg_min(ts, seq) AS t0 FROM e WHERE kind = 'admit' GROUP BY ALL)
SELECT a.source, any_value(a.preset) AS preset, coalesce(arg_max(status, seq) FILTER (kind <> 'admit' AND status <> ''), 'queued') AS status, coalesce(arg_max(CASE WHEN kind = 'finish' THEN '' ELSE detail END, seq) FILTER (kind = 'finish' OR (kind = 'update' AND detail <> '')), '') AS detail,
 coalesce(arg_max(frames, seq) FILTER (kind = 'update' AND frames <> 0), 0) AS frames, coalesce(arg_max(fps, seq) FILTER (kind = 'update' AND fps <> 0), 0.0) AS fps, round((epoch_us(arg_max(ts, seq) FILTER (kind = 'finish')) - epoch_us(any_value(t0))) / 1e6, 1) AS elapsed
 FROM a LEFT JOIN (SELECT e.* FROM e JOIN a USING (source) WHERE seq > a0) e ON e.source = a.source GROUP BY a.source"""


def job_events(df):
    return df.selectExpr("CAST(ts AS TIMESTAMP) AS ts", *[x.strip() for x in _split(EV.format(d="D"))])


def _split(text):
    """Top-level comma split of a projection list."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


@query("str_02", STATUS_SQL)
def str_02(spark, sf):
    path = scratch_path(spark)
    jobs.status_snapshots(job_events(stream_of(spark, sf, "events")), f"{path}/status", f"{path}/checkpoint").awaitTermination()
    return jobs.status_rows(jobs.read_snapshot(spark, f"{path}/status"))


@query("str_02_batch", STATUS_SQL)
def str_02_batch(spark, sf):
    return jobs.latest_status(job_events(view(spark, sf, "events")))


@query("snk_03", STATUS_SQL.replace("SELECT a.source", "SELECT TRUE AS finished, 'alpha' AS run, a.source", 1))
def snk_03(spark, sf):
    path = scratch_path(spark)
    jobs.write_snapshot(jobs.latest_status(job_events(view(spark, sf, "events"))), path, finished=True, meta={"run": "alpha"})
    return jobs.read_snapshot(spark, path).withColumn("run", F.col("meta")["run"]).drop("meta", "written_at")


WINDOWS = {"window": "2 hours", "slide": "1 hour", "late": "1 hour"}


def completions(events):
    return events.selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS backend", "value AS fps")


def closed_windows(spark, sf):
    path = scratch_path(spark)
    windows = jobs.throughput(completions(stream_of(spark, sf, "events")), **WINDOWS)
    writer = windows.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").start(f"{path}/windows").awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{path}/windows")


def throughput_rows(windows):
    out = windows.withColumn("window_start", F.unix_seconds("window_start"))
    return rounded(out.withColumn("fps_sum", F.round("fps_sum", 4)))


@query("str_03", """SELECT window_start, backend, count(*) AS n, round(sum(value), 4) AS fps_sum, round(avg(value), 6) AS fps_mean FROM (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR) // 1000000 AS window_start, event_type AS backend, value FROM events, range(2) r(k))
 WHERE window_start + 7200 <= (SELECT epoch_us(max(ts)) / 1000000 - 3600 FROM events) GROUP BY ALL""")
def str_03(spark, sf):
    """Windows that the watermark has closed, each written once."""
    return throughput_rows(closed_windows(spark, sf))


# the same text without the filter on closed windows
@query("str_03_all", """SELECT window_start, backend, count(*) AS n, round(sum(value), 4) AS fps_sum, round(avg(value), 6) AS fps_mean FROM (SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR) // 1000000 AS window_start, event_type AS backend, value FROM events, range(2) r(k)) GROUP BY ALL""")
def str_03_all(spark, sf):
    """Closed windows as the stream wrote them and the windows still open, over all events."""
    still_open = jobs.open_windows(completions(view(spark, sf, "events")), **WINDOWS)
    return throughput_rows(closed_windows(spark, sf).unionByName(still_open))


@query("str_03_rolling", """SELECT event_type AS backend, event_id AS seq, row_number() OVER w AS idx, value AS fps, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS fps_window FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def str_03_rolling(spark, sf):
    rows = view(spark, sf, "events").selectExpr("event_type AS backend", "event_id AS seq", "value AS fps")
    return rounded(jobs.rolling_throughput(rows, block=65536), "fps")


@query("str_04", """SELECT url AS source, CASE WHEN bool_or(page_id % 3 = 0) THEN 'before' ELSE 'run' END AS origin, 1::BIGINT AS times FROM pages GROUP BY url""")
def str_04(spark, sf):
    path = scratch_path(spark)
    done = view(spark, sf, "pages").where("page_id % 3 = 0").select(F.col("url").alias("source"), F.lit("before").alias("origin")).distinct()
    done.write.parquet(f"{path}/finished")
    for _ in range(2):  # the second run is a restart: nothing is left to do
        sources = stream_of(spark, sf, "pages").select(F.col("url").alias("source"))
        jobs.resumable(sources, f"{path}/finished", f"{path}/checkpoint", lambda df: df.select("source", F.lit("run").alias("origin"))).awaitTermination()
    return spark.read.parquet(f"{path}/finished").groupBy("source", "origin").agg(F.count(F.lit(1)).alias("times"))
