"""Catalog operators: classification, rate caps, parameters, stream summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as s

# Rate-cap ratios per preset and class (min, target, max, buffer factor).
RATE_CAPS = {
    ("UHQ", "HIGH_BITRATE_LONG_GOP"): (0.55, 0.70, 0.85, 1.5),
    ("UHQ", "NORMAL_LONG_GOP"): (0.70, 0.85, 1.00, 1.5),
    ("UHQ", "LOW_BITRATE_LONG_GOP"): (0.90, 1.00, 1.25, 1.5),
    ("UHQ", "INTRA_LIKE"): (0.30, 0.40, 0.55, 1.5),
    ("HQ", "HIGH_BITRATE_LONG_GOP"): (0.35, 0.50, 0.65, 2.0),
    ("HQ", "NORMAL_LONG_GOP"): (0.60, 0.75, 0.90, 2.0),
    ("HQ", "LOW_BITRATE_LONG_GOP"): (0.85, 1.00, 1.15, 2.0),
    ("HQ", "INTRA_LIKE"): (0.25, 0.35, 0.45, 2.0),
    ("SMALL", "HIGH_BITRATE_LONG_GOP"): (0.20, 0.30, 0.40, 3.0),
    ("SMALL", "NORMAL_LONG_GOP"): (0.40, 0.55, 0.70, 3.0),
    ("SMALL", "LOW_BITRATE_LONG_GOP"): (0.75, 0.90, 1.05, 3.0),
    ("SMALL", "INTRA_LIKE"): (0.15, 0.25, 0.35, 3.0),
    ("FAST", "HIGH_BITRATE_LONG_GOP"): (0.30, 0.40, 0.50, 3.0),
    ("FAST", "NORMAL_LONG_GOP"): (0.50, 0.65, 0.80, 3.0),
    ("FAST", "LOW_BITRATE_LONG_GOP"): (0.80, 0.95, 1.10, 3.0),
    ("FAST", "INTRA_LIKE"): (0.20, 0.30, 0.40, 3.0),
}
# How each parameter follows the source (mode, cap, min, max).
PARAM_RULES = {
    "rc_lookahead": ("fps", 200, None, None),
    "gop_lookahead": ("fps", 200, None, None),
    "min_keyint": ("fps", None, None, None),
    "merange": ("sqrt_pixels", None, 16.0, 92.0),
}


def classify(files: DataFrame) -> DataFrame:
    """Adds fps, ob_kbps, normalized_ob, source_class and evidence."""
    kbps = F.coalesce(F.try_divide(F.col("size_bytes") * 8.0, F.col("duration_sec")),
                      F.lit(0.0)) / 1000
    rated = files.withColumn("fps", s.ratio(F.col("rate_text"))).withColumn("ob_kbps", kbps)
    norm = s.normalized_bitrate(F.col("ob_kbps"), F.col("width"), F.col("height"), F.col("fps"))
    rated = rated.withColumn("normalized_ob", norm)
    return (rated
            .withColumn("source_class", s.source_class(F.col("codec"), F.col("normalized_ob")))
            .withColumn("evidence", s.class_evidence(F.col("codec"), F.col("normalized_ob"))))


def rate_caps(files: DataFrame, presets: list[str], buffer_cap: int = s.BUFFER_CAP_KBPS) -> DataFrame:
    """Source-relative rate cap per file and preset; ``static`` where no rule applies.

    The rules are a literal of at most 16 rows, carried inside the projection.
    """
    rule = "struct<lo double, target double, hi double, factor double>"
    pairs = []
    for (preset, cls), values in RATE_CAPS.items():
        pairs += [F.lit(f"{preset}/{cls}"),
                  F.struct(*[F.lit(v) for v in values]).cast(rule)]
    table = F.create_map(*pairs)
    ob = F.col("ob_kbps")
    wide = (files.withColumn("preset", F.explode(F.array(*[F.lit(p) for p in presets])))
            .withColumn("_r", F.try_element_at(
                table, F.concat(F.col("preset"), F.lit("/"), F.col("source_class")))))
    rate = F.least(F.greatest(ob * F.col("_r.target"), ob * F.col("_r.lo")), ob * F.col("_r.hi"))
    known = F.col("_r").isNotNull() & (ob > 0)
    rate = F.when(known, F.greatest(F.lit(1), F.floor(rate + 0.5))).cast("bigint")
    wide = wide.withColumn("maxrate_kbps", rate)
    raw = F.greatest(F.lit(1), F.floor(F.col("maxrate_kbps") * F.col("_r.factor") + 0.5)).cast("bigint")
    return (wide.withColumn("raw_bufsize_kbps", F.when(known, raw))
            .withColumn("bufsize_kbps", F.when(F.col("raw_bufsize_kbps").isNotNull(),
                                               F.least("raw_bufsize_kbps", F.lit(buffer_cap))).cast("bigint"))
            .withColumn("mode", F.when(known & (F.col("raw_bufsize_kbps") > buffer_cap), "cpb_clamp")
                        .when(known, "dynamic_vbv").otherwise("static")).drop("_r"))


def resolve_parameters(files: DataFrame, profile: dict[str, str],
                       rules: dict[str, tuple] = PARAM_RULES) -> DataFrame:
    """One audit row per file and parameter: mode, calculated and final value.

    A fixed parameter keeps its base text; a scaled one with a non-numeric base
    is kept fixed too, with the error named.
    """
    rows = []
    for name, base in profile.items():
        mode, cap, low, high = rules.get(name, ("fixed", None, None, None))
        rows.append(F.struct(
            F.lit(name).alias("param"), F.lit(mode).alias("mode"), F.lit(base).alias("base"),
            F.lit(cap).cast("bigint").alias("cap"), F.lit(low).cast("double").alias("low"),
            F.lit(high).cast("double").alias("high")))
    f = s.factors(F.col("width"), F.col("height"), F.col("fps"))
    wide = files.withColumn("_f", F.struct(
        *[c.alias(n) for n, c in f.items()],
        F.when(F.col("fps") > 0, F.col("fps")).otherwise(s.REF_FPS).alias("fps")))
    wide = wide.withColumn("_p", F.explode(F.array(*rows))).select("*", "_p.*").drop("_p")
    number = F.col("base").try_cast("double")
    factor = F.when(F.col("mode") == "sqrt_pixels", F.col("_f.spatial")).otherwise(F.col("_f.pixel_rate"))
    scaled = F.col("mode").isin("sqrt_pixels", "pixel_rate")
    frames = F.when(F.col("mode") == "fps", s.frame_expression(F.col("base"), F.col("_f.fps")))
    calculated = F.when(F.col("mode") == "fps", frames.cast("double")).when(scaled, number * factor)
    final = (
        F.when(F.col("mode") == "fps", F.least(frames, F.col("cap")).cast("string"))
        .when(scaled & number.isNotNull(),
              s.clamp_round(number * factor, F.col("low"), F.col("high")).cast("string"))
        .otherwise(F.col("base")))
    return wide.select(
        "file_id", "param", "mode", "base", calculated.alias("calculated"), final.alias("final"),
        F.when(scaled & number.isNull(), "non-numeric base, kept fixed").alias("error"))


def effective_parameters(audit: DataFrame) -> DataFrame:
    """The audit rows of a file (one per parameter of the profile) as one map."""
    entries = F.collect_list(F.struct("param", "final"))
    return audit.groupBy("file_id").agg(F.map_from_entries(entries).alias("values"))


def source_kind(files: DataFrame, streams: DataFrame) -> DataFrame:
    """Camera kind of each file by the codec tag of its data streams."""
    data = F.col("codec_type") == "data"
    kinds = streams.groupBy("file_id").agg(
        F.bool_or(data & (F.col("codec_tag") == "rtmd")).alias("a"),
        F.bool_or(data & (F.col("codec_tag") == "djmd")).alias("b"))
    return files.select("file_id").join(kinds, "file_id", "left").select(
        "file_id",
        F.when(F.col("a").isNull(), "unknown").when(F.col("a"), "A").when(F.col("b"), "B")
        .otherwise("other").alias("kind"))


def stream_summary(streams: DataFrame) -> DataFrame:
    """Per file: streams by type, and audio codecs as ``index:codec;...``.

    The text lists every stream of one container header, in index order.
    """
    audio = F.col("codec_type") == "audio"
    entries = F.array_sort(F.collect_list(F.when(audio, F.struct("stream_index", "codec_name"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws(
        ":", e["stream_index"].cast("string"), e["codec_name"])), ";")
    return streams.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("stream_count"),
        *[F.count_if(F.col("codec_type") == k).alias(f"{k}_streams") for k in ("video", "audio", "data")],
        text.alias("audio_codecs"))


def saving_metrics(source_bytes: Column, output_bytes: Column) -> dict[str, Column]:
    share = F.when(source_bytes > 0, output_bytes / source_bytes).otherwise(0.0)
    return {"source_mb": source_bytes / float(1 << 20), "source_gib": source_bytes / float(1 << 30),
            "source_gb": source_bytes / 1e9, "output_mb": output_bytes / float(1 << 20),
            "output_source_ratio": share, "space_saved_ratio": 1 - share}


def savings(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """Source and output sizes of finished files, with their ratios."""
    joined = files.select("file_id", "size_bytes").join(outputs, "file_id")
    metrics = saving_metrics(F.col("size_bytes"), F.col("output_bytes"))
    return joined.select("file_id", "size_bytes", "output_bytes",
                         *[c.alias(n) for n, c in metrics.items()])
