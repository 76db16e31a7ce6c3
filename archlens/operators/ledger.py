"""Batch ledgers: verdict rollups, failures, retries, resume, matching files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as s

# Duration buckets in seconds, separators, audio extensions, tail length.
BUCKETS = [(0, 20), (20, 40), (40, 60), (60, 120), (120, 300)]
AUDIO_EXTENSIONS = [".wav", ".wave", ".bwf", ".flac", ".aac", ".m4a", ".m4b", ".mp4a", ".opus",
                    ".ogg", ".oga", ".spx", ".weba", ".mp3", ".mp2", ".mpga"]
SUMMARY_LINES = 8
MIN_OFF_MS = 1000.0 * 5 / 48000


def verdict_fold(checks: DataFrame) -> DataFrame:
    """FAIL over WARN over UNMEASURABLE (only where nothing passed) over PASS."""
    has = lambda v: F.bool_or(F.col("verdict") == v)
    return checks.groupBy("file_id").agg(
        F.when(has("FAIL"), "FAIL").when(has("WARN"), "WARN")
        .when(has("UNMEASURABLE") & ~has("PASS"), "UNMEASURABLE").otherwise("PASS").alias("overall"))


def repair_outcome(records: DataFrame, checks: DataFrame) -> DataFrame:
    """REPAIRED only where content changed and no final check fails."""
    failing = checks.groupBy("file_id").agg(F.bool_or(F.col("verdict") == "FAIL").alias("_fails"))
    status, error = F.col("status"), F.col("error").isNotNull()
    mismatch = status.isin("metadata_mismatch", "sample_entry_mismatch")
    outcome = (
        F.when(status == "unreadable", "UNREADABLE").when(status == "partial", "PARTIAL")
        .when(error & (mismatch | ~F.col("no_fix_needed")), "FAILED")
        .when(F.coalesce("_fails", F.lit(False)), "FAILED")
        .when(status == "container_fixed", "REPAIRED")
        .when(status == "applied", F.when(F.col("identical"), "REPAIRED").otherwise("FAILED"))
        .when(F.col("no_fix_needed") | ~error, "NOOP").otherwise("FAILED"))
    return records.join(failing, "file_id", "left").select("file_id", outcome.alias("outcome"))


def batch_ledger(files: DataFrame) -> DataFrame:
    """Counts by verdict, by first-level directory and verdict, and in total."""
    return (files.groupingSets([["overall"], ["dir", "overall"], []], "dir", "overall")
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))
            .select("level", "dir", "overall", "n"))


def failed_files(checks: DataFrame) -> DataFrame:
    """Files with a failing check and the ids of those checks, in order."""
    ids = F.array_join(F.array_sort(F.collect_set("check_id")), ",")
    return checks.where("verdict = 'FAIL'").groupBy("file_id").agg(ids.alias("checks"))


def duration_bucket(seconds: Column) -> Column:
    out = F.when(seconds.isNull(), None)
    for low, high in BUCKETS:
        out = out.when((seconds >= low) & (seconds < high), f"{low}-{high}s")
    return out.otherwise(f">{BUCKETS[-1][1]}s")


def outcome_by_duration(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Files, target tracks, aligned, still off and fully aligned, per bucket and in total."""
    decision = F.col("decision")
    target = ~((decision.isNull() | (decision == "anchor")) & F.col("reason").isNull())
    aligned = F.coalesce(decision.isin("fixed", "already_aligned"), F.lit(False))
    off = ~aligned & (F.abs("delay_ms") >= MIN_OFF_MS)
    per_file = tracks.groupBy("file_id").agg(
        F.count_if(target).alias("targets"), F.count_if(target & aligned).alias("aligned"),
        F.count_if(target & off).alias("still_off"))
    joined = files.where(F.col("duration_sec").isNotNull()).join(per_file, "file_id", "left").fillna(
        0, ["targets", "aligned", "still_off"])
    full = (F.col("targets") > 0) & (F.col("targets") == F.col("aligned"))
    return joined.withColumn("bucket", duration_bucket(F.col("duration_sec"))).rollup("bucket").agg(
        F.count(F.lit(1)).alias("files"), F.sum("targets").alias("targets"), F.sum("aligned").alias("aligned"),
        F.sum("still_off").alias("still_off"), F.count_if(full).alias("full_files")
    ).withColumn("bucket", F.coalesce("bucket", F.lit("total")))


def strata(files: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Counts per stratum of several groupings, keyed by the joined values."""
    out = None
    for name, columns in groups.items():
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
        part = files.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("stratum"), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


def collate(reports: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """Pass and fail totals of several kinds of report, one row each."""
    out = None
    for tier, (rows, passed, failed) in reports.items():
        part = rows.agg(F.count_if(passed).alias("passed"), F.count_if(failed).alias("failed")).select(
            F.lit(tier).alias("tier"), "passed", "failed")
        out = part if out is None else out.unionByName(part)
    return out


def failure_records(failures: DataFrame) -> DataFrame:
    """Failure rows with the last lines of the log as summary, beside the whole log."""
    lines = F.split(F.regexp_replace("log", r"\r?\n$", ""), r"\r?\n")
    tail = F.reverse(F.slice(F.reverse(lines), 1, SUMMARY_LINES))
    empty = F.col("log").isNull() | (F.col("log") == "")
    return failures.withColumn(
        "summary", F.when(empty, "(no log available)").otherwise(F.array_join(tail, "\n")))


def append_failures(failures: DataFrame, path: str) -> None:
    failure_records(failures).write.mode("append").partitionBy("stage").parquet(path)


def retry_sources(lists: DataFrame, text: str = "text") -> DataFrame:
    """Sources named by retry lists: JSON records or strings, else plain lines."""
    items = F.from_json(F.col(text), "array<string>")
    named = F.transform(items, lambda e: F.when(
        e.startswith("{"), F.get_json_object(e, "$.source")).otherwise(e))
    named = F.filter(named, lambda e: e.isNotNull() & (e != ""))
    lines = F.transform(F.split(F.col(text), r"\r?\n"), lambda e: F.trim(e))
    lines = F.filter(lines, lambda e: (e != "") & ~e.startswith("#") & ~e.startswith("//"))
    chosen = F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(lines)
    return lists.select(*[c for c in lists.columns if c != text], F.explode(chosen).alias("source"))


def load_retry(lists: DataFrame, sources: DataFrame) -> DataFrame:
    """Retry sources that still exist."""
    return retry_sources(lists).join(sources.select("source"), "source", "left_semi")


def pending(sources: DataFrame, outputs: DataFrame, key: str = "source") -> DataFrame:
    """Sources that have no output of positive size yet."""
    return sources.join(outputs.where("size > 0").select(key), key, "left_anti")


def match_external(videos: DataFrame, audios: DataFrame) -> DataFrame:
    """External audio of each video: same folder, name continues the video's stem.

    An audio name can only match a stem that ends where the name does or just
    before a separator, so each audio row names its few possible stems and the
    match is an equality join; no pairs within a folder are formed.
    """
    low = F.lower(F.trim(F.col("stem")))
    cuts = F.filter(F.sequence(F.lit(1), F.length("_low")), lambda i: F.substring(F.col("_low"), i, 1).isin("-", "_"))
    stems = F.array_append(F.transform(cuts, lambda i: F.substring(F.col("_low"), F.lit(1), i - 1)), F.col("_low"))
    named = (
        audios.withColumn("suffix", F.lower(s.suffix(F.col("name")))).where(F.col("suffix").isin(*AUDIO_EXTENSIONS))
        .withColumn("stem", s.stem(F.col("name"))).withColumn("_low", low)
        .select("dir", "name", "_low", F.explode(F.array_distinct(stems)).alias("_stem")).where("_stem <> ''"))
    wanted = videos.select("video_id", "dir", low.alias("_stem"))
    tail = F.substring(F.col("_low"), F.length("_stem") + 1, F.length("_low"))
    # equal names of a folder are one candidate, whatever their number, before a video meets them
    named = named.groupBy("dir", "_stem", F.lower("name").alias("_key")).agg(
        F.min("name").alias("name"), F.min(tail).alias("remainder"))
    hits = named.join(wanted, ["dir", "_stem"]).groupBy("video_id", "_key").agg(
        F.min("name").alias("name"), F.min("remainder").alias("remainder"))
    index = F.regexp_extract("remainder", r"^[-_]+(\d+)$", 1).try_cast("bigint")
    return hits.select("video_id", "name", "remainder",
                       F.when(F.col("remainder") == "", 0).when(index.isNotNull(), 1).otherwise(2).cast("bigint").alias("rank"),
                       index.alias("index"))


def candidate_order(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("video_id", "rank", F.coalesce("index", F.lit(0)), s.natural_key(F.col("name")), F.lower("name"))


def largest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("size_bytes"), "name")


def worst(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """Top-n listing (kept per task, then merged)."""
    return rows.orderBy(*order).limit(n)
