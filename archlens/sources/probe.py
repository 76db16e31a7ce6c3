"""Probe JSON into typed file and stream tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as s

STREAM = ("struct<index: bigint, codec_type: string, codec_name: string, codec_tag_string: string, "
          "width: string, height: string, pix_fmt: string, r_frame_rate: string, "
          "avg_frame_rate: string, nb_frames: string, duration: string, bit_rate: string, "
          "channels: string, sample_rate: string>")
PROBE = (f"struct<format: struct<duration: string, size: string, bit_rate: string, "
         f"format_name: string>, streams: array<{STREAM}>>")


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """One row per probe document: its path and parsed content."""
    return (spark.read.option("wholetext", True).text(path)
            .select(F.input_file_name().alias("source"), F.from_json("value", PROBE).alias("probe")))


def parse_probe(documents: DataFrame, text: str = "value") -> DataFrame:
    return documents.withColumn("probe", F.from_json(text, PROBE)).drop(text)


def media_files(probes: DataFrame) -> DataFrame:
    """File facts, with fallbacks for missing duration, frames and bitrate.

    The first video stream is the video; documents with none are dropped.
    """
    video = F.try_element_at(
        F.filter("probe.streams", lambda x: x["codec_type"] == "video"), F.lit(1))
    v, fmt = F.col("_v"), F.col("probe.format")
    declared = s.lenient_float(fmt["duration"])
    facts = (
        probes.withColumn("_v", video).where(F.col("_v").isNotNull())
        .withColumn("duration_sec", F.when(declared > 0, declared)
                    .otherwise(s.lenient_float(v["duration"])))
        .withColumn("fps", s.ratio(F.coalesce(F.nullif(v["avg_frame_rate"], F.lit("")),
                                              v["r_frame_rate"])))
        .withColumn("size_bytes", s.lenient_int(fmt["size"]))
    )
    counted, rate = s.lenient_int(v["nb_frames"]), s.lenient_float(fmt["bit_rate"])
    estimable = (F.col("duration_sec") > 0) & (F.col("fps") > 0)
    of_type = lambda kind: F.size(F.filter("probe.streams", lambda x: x["codec_type"] == kind)).cast("bigint")
    derived = F.when((F.col("size_bytes") > 0) & (F.col("duration_sec") > 0),
                     F.try_divide(F.col("size_bytes") * 8.0, F.col("duration_sec"))).otherwise(0.0)
    keep = [c for c in probes.columns if c != "probe"]
    return facts.select(
        *keep, "duration_sec", "fps", "size_bytes",
        F.when(counted > 0, counted).when(estimable, F.ceil(F.col("duration_sec") * F.col("fps")))
        .otherwise(0).cast("bigint").alias("total_frames"),
        F.when(rate > 0, rate).otherwise(derived).alias("bitrate_bps"),
        s.lenient_int(v["width"]).alias("width"), s.lenient_int(v["height"]).alias("height"),
        v["codec_name"].alias("codec"), F.size("probe.streams").cast("bigint").alias("stream_count"),
        *[of_type(k).alias(f"{k}_streams") for k in ("video", "audio", "data")])


def media_streams(probes: DataFrame) -> DataFrame:
    keep = [c for c in probes.columns if c != "probe"]
    st = F.col("st")
    return probes.select(*keep, F.explode_outer("probe.streams").alias("st")).select(
        *keep, st["index"].alias("stream_index"), st["codec_type"].alias("codec_type"),
        st["codec_name"].alias("codec_name"), st["codec_tag_string"].alias("codec_tag"),
        s.lenient_int(st["channels"]).alias("channels"),
        s.lenient_int(st["sample_rate"]).alias("sample_rate"),
        s.lenient_float(st["duration"]).alias("duration_sec"))
