"""Streams worth having: arriving files, job status, throughput, resumable work."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import neighbours, running_sum
from ..sources.media import select_media


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def arriving_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Stream of new media files below ``root``: path, length, time; no contents."""
    files = (spark.readStream.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
             .schema("path string, modificationTime timestamp, length bigint, content binary").load(root))
    return select_media(files.select("path", "length", "modificationTime"))


def process_arrivals(arrivals: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
                     every: str | None = None) -> StreamingQuery:
    """Hand each batch of arrivals to ``work``: at an interval, or in one pass and stop."""
    return _trigger(arrivals.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint), every).start()


def status_parts(events: DataFrame) -> DataFrame:
    """What some events say of each source, in a form that :func:`merge_parts` can join.

    ``events``: source, seq (time order), ts, kind (admit, update, finish),
    preset, status, detail, frames, fps.
    """
    kind, seq = F.col("kind"), F.col("seq")
    finish = kind == "finish"

    def latest(value: Column, counts: Column) -> Column:
        return F.max_by(F.struct(seq.alias("s"), value.alias("v")), F.when(counts, seq))

    return events.groupBy("source").agg(
        F.min_by(F.struct(seq.alias("s"), "preset", "ts"), F.when(kind == "admit", seq)).alias("admitted"),
        latest(F.col("status"), (finish | (kind == "update")) & (F.col("status") != "")).alias("status"),
        latest(F.when(finish, "").otherwise(F.col("detail")), finish | ((kind == "update") & (F.col("detail") != ""))).alias("detail"),
        latest(F.col("frames"), (kind == "update") & (F.col("frames") != 0)).alias("frames"),
        latest(F.col("fps"), (kind == "update") & (F.col("fps") != 0)).alias("fps"),
        latest(F.col("ts"), finish).alias("ended"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row per source from any number of its parts: the first admission, the latest of everything else."""
    late = [F.max_by(c, F.col(f"{c}.s")).alias(c) for c in ("status", "detail", "frames", "fps", "ended")]
    return parts.groupBy("source").agg(F.min_by("admitted", F.col("admitted.s")).alias("admitted"), *late)


def status_rows(parts: DataFrame) -> DataFrame:
    """Current row of every admitted source; what came before its admission is ignored."""
    after = lambda c, default: F.when(F.col(f"{c}.s") > F.col("admitted.s"), F.col(f"{c}.v")).otherwise(default)
    ended = F.when(F.col("ended.s") > F.col("admitted.s"), F.col("ended.v"))
    return parts.where(F.col("admitted").isNotNull()).select(
        "source", F.col("admitted.preset").alias("preset"), after("status", "queued").alias("status"), after("detail", "").alias("detail"),
        after("frames", 0).alias("frames"), after("fps", 0.0).alias("fps"),
        F.round((F.unix_micros(ended) - F.unix_micros("admitted.ts")) / 1e6, 1).alias("elapsed"))


def latest_status(events: DataFrame) -> DataFrame:
    """Current row per source from job events (batch or stream), as plain aggregates.

    The first admission counts; blank or zero fields never overwrite; anything
    before the admission is ignored.
    """
    return status_rows(status_parts(events))


def _files(spark: SparkSession, path: str):
    """(Hadoop file context, path factory) for the filesystem of ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    return hadoop.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _published(spark: SparkSession, path: str) -> tuple[str, int] | None:
    """(folder name, batch) of the snapshot that readers see, or None before the first."""
    context, hadoop = _files(spark, path)
    pointer = hadoop.Path(f"{path}/CURRENT")
    if not context.util().exists(pointer):
        return None
    stream = context.open(pointer)
    try:
        name = bytes(stream.readNBytes(1 << 10)).decode()
    finally:
        stream.close()
    return name, int(name.split("-")[1])


def publish(rows: DataFrame, path: str, batch: int = 0) -> None:
    """Make ``rows`` the snapshot at ``path`` in one step.

    The rows go to a folder of their own; then a small file that names it is
    written aside and renamed over ``CURRENT``, which replaces it as one action.
    A reader finds the whole old snapshot or the whole new one. The one before
    stays for readers that have begun; older folders are deleted.
    """
    spark = rows.sparkSession
    before = _published(spark, path)
    name = f"snapshot-{batch}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{name}")
    context, hadoop = _files(spark, path)
    aside = hadoop.Path(f"{path}/next-{name}")
    flags = spark.sparkContext._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE, hadoop.CreateFlag.OVERWRITE)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.CreateOpts, 0)
    out = context.create(aside, flags, options)
    out.write(bytearray(name.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(aside, hadoop.Path(f"{path}/CURRENT"), over)
    keep = {name, before[0] if before else name}
    for entry in context.util().listStatus(hadoop.Path(path)):
        found = entry.getPath()
        if found.getName().startswith("snapshot-") and found.getName() not in keep:
            context.delete(found, True)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot that was current when this was called; an error before the first."""
    current = _published(spark, path)
    if current is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return spark.read.parquet(f"{path}/{current[0]}")


def write_snapshot(rows: DataFrame, path: str, finished: bool = False, meta: dict[str, str] | None = None) -> None:
    """Replace the status snapshot: one table, every row with the run's facts and the time of writing."""
    facts = F.create_map(*[F.lit(x) for kv in (meta or {}).items() for x in kv]) if meta else F.lit(None).cast("map<string,string>")
    publish(rows.withColumn("finished", F.lit(finished)).withColumn("meta", facts).withColumn("written_at", F.current_timestamp()), path)


def status_snapshots(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep a snapshot of what is known of every source, for :func:`status_rows` of :func:`read_snapshot`.

    The stream itself keeps no state: a batch reduces its events to one part per
    source and merges them with the snapshot before it. A batch that was
    published and runs again after a loss changes nothing.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark, before = batch.sparkSession, _published(batch.sparkSession, path)
        parts = status_parts(batch)
        if before:
            if before[1] >= number:
                return
            parts = parts.unionByName(spark.read.schema(parts.schema).parquet(f"{path}/{before[0]}"))
        publish(merge_parts(parts), path, number)

    return _trigger(events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint), every).start()


def throughput(completions: DataFrame, *, window: str, slide: str, late: str) -> DataFrame:
    """Completions, summed and mean rate per backend in sliding event-time windows."""
    return (completions.withWatermark("ts", late)
            .groupBy(F.window("ts", window, slide).alias("w"), "backend")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("fps").alias("fps_sum"), F.avg("fps").alias("fps_mean"))
            .select(F.col("w.start").alias("window_start"), "backend", "n", "fps_sum", "fps_mean"))


def open_windows(completions: DataFrame, *, window: str, slide: str, late: str) -> DataFrame:
    """The windows of :func:`throughput` that the watermark has not closed after all these completions (batch)."""
    length, delay = (F.expr(f"INTERVAL {x}") for x in (window, late))
    newest = completions.agg(F.max("ts").alias("ts")).first()["ts"]
    rows = throughput(completions, window=window, slide=slide, late=late)
    return rows.where(F.col("window_start") + length > F.lit(newest).cast("timestamp") - delay)


def rolling_throughput(completions: DataFrame, last: int = 8, block: int = 1 << 36) -> DataFrame:
    """Batch twin: summed rate of the last few completions of a backend.

    ``seq`` orders completions; the sum over a short frame is read inside
    blocks with a halo, so a backend with most of the rows is still split.
    """
    keys = ["backend"]
    numbered = running_sum(completions, keys, "seq", F.lit(1), "idx", size=block)
    wide, window, keep = neighbours(numbered, keys, "idx", last - 1)
    total = F.sum("fps").over(window.rowsBetween(-(last - 1), 0))
    return wide.withColumn("fps_window", total).where(keep).select("backend", "seq", "idx", "fps", "fps_window")


def resumable(sources: DataFrame, finished_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame],
              every: str | None = None) -> StreamingQuery:
    """Process each source once over restarts.

    The checkpoint remembers input, the finished table what was completed: a
    batch replayed after a loss finds its finished keys and skips them.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["source"])
        try:
            done = spark.read.schema("source string").parquet(finished_path)
            fresh = fresh.join(done, "source", "left_anti")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise  # only a table that does not exist yet means nothing is finished
        work(fresh).write.mode("append").parquet(finished_path)

    return _trigger(sources.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint), every).start()
