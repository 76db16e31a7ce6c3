"""Original-against-final comparisons, inventories, packets and file rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as s
from .ordered import carry
from .quantiles import exact_quantiles

# Which facts are critical, check tolerances and thresholds.
CRITICAL_PREFIXES = ["rtmd", "nrtm", "uuid", "video", "audio"]
NOT_CRITICAL = ["rtmd.timecode_tag"]
CRITICAL_ITEMS = [
    "timeline.movie_timescale", "timeline.movie_duration", "video.timescale",
    "video.track_duration", "video.stts", "video.elst", "video.codec", "video.color_primaries",
    "video.color_transfer", "video.color_space", "video.color_range", "audio.streams",
    "audio.tracks", "audio.track_duration", "rtmd.timescale", "rtmd.duration",
    "rtmd.track_duration", "rtmd.stts", "rtmd.elst", "rtmd.payload_sha256"]
PCM_ENTRIES = ["ipcm", "fpcm", "in24", "in32", "fl32", "fl64", "sowt", "twos", "raw ", "lpcm"]
ENTRY_BITS = {"in24": 24, "in32": 32, "fl32": 32, "fl64": 64, "sowt": 16, "twos": 16, "raw ": 8}
CONTAINER_TOLERANCE_SEC, STREAM_TOLERANCE_SEC = 0.002, 0.05
QUALITY = {"sample_rate": 10, "max_duration_sec": 60.0, "psnr_min_db": 25.0, "ssim_min": 0.80,
           "garbage_psnr_db": 12.0, "max_garbage_frac": 0.02, "max_frame_diff": 2}
MOTION_EPS = 1e-4


def fact_diff(facts: DataFrame) -> DataFrame:
    """Status of every (file, item) of either side: one shuffle, no join of the two sides."""
    def side(name: str) -> tuple[Column, Column]:
        here = F.col("side") == name
        return (F.max(F.when(here, F.col("value"))).alias(f"{name}_value"),
                F.bool_or(here).alias(f"in_{name}"))

    pairs = facts.groupBy("file_id", "item").agg(*side("original"), *side("final"))
    a, b = F.col("original_value"), F.col("final_value")
    status = (F.when(~F.col("in_original"), "ADDED").when(~F.col("in_final"), "MISSING").when(a.isNull() & b.isNull(), "UNKNOWN")
              .when(a.eqNullSafe(b), "PRESERVED").otherwise("MODIFIED"))
    return pairs.select("file_id", "item", "original_value", "final_value", status.alias("status"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """Status counts and the critical losses of each file."""
    status, item = F.col("status"), F.col("item")
    missing = ((status == "MISSING") & F.substring_index(item, ".", 1).isin(*CRITICAL_PREFIXES)
               & ~item.isin(*NOT_CRITICAL))
    modified = (status == "MODIFIED") & item.isin(*CRITICAL_ITEMS)
    return diff.groupBy("file_id").agg(
        *[F.count_if(status == x).alias(x.lower()) for x in ("PRESERVED", "MODIFIED", "MISSING", "ADDED", "UNKNOWN")],
        F.count_if(missing).alias("critical_missing"), F.count_if(modified).alias("critical_modified"),
        (F.count_if(missing | modified) == 0).alias("structural_success"))


def inventory_compare(items: DataFrame) -> DataFrame:
    """Multiset comparison of (ctx, guid, sha) per file: missing and added counts."""
    first = F.col("side") == "original"
    net = items.groupBy("file_id", "ctx", "guid", "sha").agg(
        F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    zero = F.lit(0).cast("bigint")
    return net.groupBy("file_id").agg(
        F.sum("a").alias("n_original"), F.sum("b").alias("n_final"),
        F.sum(F.greatest(F.col("a") - F.col("b"), zero)).alias("missing"),
        F.sum(F.greatest(F.col("b") - F.col("a"), zero)).alias("added"),
    ).withColumn("identical", (F.col("missing") == 0) & (F.col("added") == 0))


def inventory_rows(items: DataFrame) -> DataFrame:
    """The rows behind the counts, each as often as it is missing or added."""
    keys = ["file_id", "ctx", "guid", "sha"]
    a = items.where("side = 'original'").select(*keys)
    b = items.where("side <> 'original'").select(*keys)
    return (a.exceptAll(b).withColumn("change", F.lit("missing"))
            .unionByName(b.exceptAll(a).withColumn("change", F.lit("added"))))


def labelled_inventory(items: DataFrame) -> DataFrame:
    """Per (file, label): count, then payloads, then contexts, as multisets.

    Both multisets are compared through net counts, so no list is collected.
    """
    first = F.col("side") == "original"
    labelled = items.where(F.col("label") != "")
    net = lambda c: F.count_if(first) - F.count_if(~first)
    def differs(column: str, name: str) -> DataFrame:
        return (labelled.groupBy("file_id", "label", column).agg(net(column).alias("d"))
                .groupBy("file_id", "label").agg(F.bool_or(F.col("d") != 0).alias(name)))
    counts = labelled.groupBy("file_id", "label").agg(
        F.count_if(first).alias("n_original"), F.count_if(~first).alias("n_final"))
    status = (F.when(F.col("n_final") == 0, "MISSING")
              .when(F.col("n_original") != F.col("n_final"), "MODIFIED")
              .when(F.col("payload_differs") | F.col("context_differs"), "MODIFIED").otherwise("PRESERVED"))
    return (counts.where("n_original > 0").join(differs("sha", "payload_differs"), ["file_id", "label"])
            .join(differs("ctx", "context_differs"), ["file_id", "label"])
            .select("file_id", "label", "n_original", "n_final", status.alias("status")))


def unlabelled_inventory(items: DataFrame) -> DataFrame:
    """Unlabelled originals are preserved where the final side has the same payload and context."""
    plain = items.where(F.col("label") == "")
    first = F.col("side") == "original"
    pairs = plain.groupBy("file_id", "sha", "ctx").agg(
        F.count_if(first).alias("n_original"), F.bool_or(~first).alias("_final"))
    return pairs.where("n_original > 0").select(
        "file_id", "sha", "ctx", "n_original",
        F.when(F.col("_final"), "PRESERVED").otherwise("MISSING").alias("status"))


def set_membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key with where it occurs: common, only_a or only_b."""
    tagged = (a.select(key, F.lit(True).alias("a"), F.lit(False).alias("b"))
              .unionByName(b.select(key, F.lit(False).alias("a"), F.lit(True).alias("b"))))
    flags = tagged.groupBy(key).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return flags.select(key, F.when(F.col("a") & F.col("b"), "common").when(F.col("a"), "only_a")
                        .otherwise("only_b").alias("membership"))


def merge_runs(*shards: DataFrame) -> DataFrame:
    """Shards of one run as one table; columns match by name."""
    merged = shards[0]
    for shard in shards[1:]:
        merged = merged.unionByName(shard, allowMissingColumns=True)
    return merged


def compare_sequences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frame signatures position by position: lengths, first difference, deviation."""
    x = a.select("file_id", "frame_no", F.col("values").alias("va"), F.col("digest").alias("da"), F.lit(True).alias("ina"))
    y = b.select("file_id", "frame_no", F.col("values").alias("vb"), F.col("digest").alias("db"), F.lit(True).alias("inb"))
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    same = (F.col("va") == F.col("vb")) & (F.col("da") == F.col("db"))
    deviation = F.array_max(F.zip_with("va", "vb", lambda p, q: F.abs(p - q)))
    return x.join(y, ["file_id", "frame_no"], "full").groupBy("file_id").agg(
        F.count("ina").alias("len_a"), F.count("inb").alias("len_b"),
        F.min(F.when(both & ~same, F.col("frame_no"))).alias("first_diff"),
        F.coalesce(F.max(F.when(both & ~same, deviation)), F.lit(0.0)).alias("max_deviation"),
    ).withColumn("identical", (F.col("len_a") == F.col("len_b")) & F.col("first_diff").isNull())


def compare_motion(a: DataFrame, b: DataFrame, eps: float = MOTION_EPS) -> DataFrame:
    """Per-frame motion vectors with a component tolerance: bad count and first."""
    x = a.select("file_id", "frame_no", F.col("quat").alias("qa"))
    y = b.select("file_id", "frame_no", F.col("quat").alias("qb"))
    far = F.exists(F.zip_with("qa", "qb", lambda p, q: F.abs(p - q) > eps), lambda t: t)
    bad = F.col("qa").isNotNull() & F.col("qb").isNotNull() & (
        (F.size("qa") != F.size("qb")) | F.coalesce(far, F.lit(True)))
    out = x.join(y, ["file_id", "frame_no"], "full").groupBy("file_id").agg(
        F.count("qa").alias("n_a"), F.count("qb").alias("n_b"),
        F.count_if(F.col("qa").isNull() | F.col("qb").isNull()).alias("unmatched"),
        F.count_if(bad).alias("n_bad"), F.min(F.when(bad, F.col("frame_no"))).alias("first_bad"))
    return out.withColumn("verdict", F.when(F.col("n_a") != F.col("n_b"), "count_differs")
                          .when(F.col("unmatched") > 0, "frames_differ")
                          .when(F.col("n_bad") > 0, "samples_differ").otherwise("identical"))


def reconcile_counts(counts: DataFrame, labels: list[str]) -> DataFrame:
    """Every count must equal the expected one; an absent count is a failure.

    A reader's own report is not among ``labels`` and never decides.
    """
    expected = F.col("expected")
    notes = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), f"{c}=unavailable")
        .when(F.col(c) != expected, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in labels]))
    return counts.select(
        "file_id", F.when(expected.isNull(), "no reference count").otherwise(F.concat_ws(", ", notes)).alias("mismatch"),
    ).withColumn("verdict", F.when(F.col("mismatch") == "", "integrity_ok").otherwise("count_mismatch"))


def quality_verdicts(files: DataFrame, frames: DataFrame, rules: dict = QUALITY) -> DataFrame:
    """PASS, FAIL or SKIP per file with the reasons, from metric tables."""
    shares = frames.groupBy("file_id").agg(
        F.avg((F.col("psnr") < rules["garbage_psnr_db"]).cast("double")).alias("garbage"))
    joined = files.join(shares, "file_id", "left").withColumn("garbage", F.coalesce("garbage", F.lit(0.0)))
    drift = F.abs(F.col("src_frames") - F.col("out_frames")) > rules["max_frame_diff"]
    skip = (F.when(~F.col("enabled"), "disabled")
            .when(F.col("duration_sec") > rules["max_duration_sec"], "long")
            .when(~s.one_in(F.col("name"), rules["sample_rate"]), "unsampled")
            .when((F.col("src_size") != F.col("out_size")), "size_mismatch")
            .when((F.col("src_frames") > 0) & (F.col("out_frames") > 0) & drift, "frame_mismatch"))
    problems = F.concat_ws(
        ";", F.when(F.col("psnr_avg").isNull(), "psnr_missing").when(F.col("psnr_avg") < rules["psnr_min_db"], "psnr_low"),
        F.when(F.col("ssim_all").isNull(), "ssim_missing").when(F.col("ssim_all") < rules["ssim_min"], "ssim_low"),
        F.when(F.col("garbage") > rules["max_garbage_frac"], "garbage"))
    return joined.withColumn("_skip", skip).select(
        "file_id", "garbage", F.coalesce("_skip", problems).alias("reason"),
        F.when(F.col("_skip").isNotNull(), "SKIP").when(problems == "", "PASS").otherwise("FAIL").alias("verdict"))


def packet_statistics(packets: DataFrame) -> DataFrame:
    """Key interval, per-second bitrate and packet size of each file.

    ``packets`` has file_id, packet_no, pts_sec, is_key and size.
    """
    keys = packets.where("is_key").select("file_id", "packet_no", "pts_sec")
    spaced = carry(keys, ["file_id"], "pts_sec", F.col("pts_sec"), "_prev", strict=True, ties=["packet_no"])
    gap = F.col("pts_sec") - F.col("_prev")
    key_stats = spaced.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_keyframes"), F.avg(gap).alias("keyint_mean"),
        F.min(gap).alias("keyint_min"), F.max(gap).alias("keyint_max"))
    seconds = packets.groupBy("file_id", F.floor("pts_sec").alias("second")).agg(F.sum("size").alias("bytes"))
    rate = exact_quantiles(seconds, ["file_id"], F.col("bytes") * 8 / 1e6,
                           {"mbps_p10": 0.1, "mbps_p50": 0.5, "mbps_p90": 0.9, "mbps_max": 1.0})
    totals = packets.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_packets"), F.avg("size").alias("size_mean"))
    return totals.join(rate, "file_id").join(key_stats, "file_id", "left")


def _check(check_id: str, verdict: Column) -> Column:
    return F.struct(F.lit(check_id).alias("check_id"), verdict.alias("verdict"))


def container_checks(facts: DataFrame) -> DataFrame:
    """Layout rules CTR-01..09 and FMT-05, one row per (file, check)."""
    ok = lambda good, other: F.when(good, "PASS").otherwise(other)
    c = F.col
    delta = F.abs(c("mvhd_sec") - c("container_sec"))
    pcm = c("audio_entry").isin(*PCM_ENTRIES)
    items = [
        _check("CTR-01", ok(c("brand").isNotNull(), "FAIL")),
        _check("CTR-02", F.when(c("data_entry") == "rtmd", ok(c("has_cdsc"), "FAIL")).otherwise("SKIP")),
        _check("CTR-03", F.when(c("meta_scopes") > 0, ok(c("nrtm"), "WARN")).otherwise("SKIP")),
        _check("CTR-04", F.lit("PASS")),
        _check("CTR-05", F.when(c("name").contains(".part."), "SKIP").when(c("moov_first").isNull(), "FAIL")
               .otherwise(ok(c("moov_first"), "WARN"))),
        _check("CTR-06", F.when(delta.isNull(), "SKIP").otherwise(ok(delta <= CONTAINER_TOLERANCE_SEC, "FAIL"))),
        _check("CTR-07", F.when(~F.coalesce(pcm, F.lit(False)), "SKIP").otherwise(ok(c("audio_entry") != "in24", "WARN"))),
        _check("CTR-08", F.when(~F.coalesce(pcm, F.lit(False)), "SKIP").otherwise(ok(c("entry_consistent"), "WARN"))),
        _check("CTR-09", ok((c("track_flags").bitwiseAND(F.lit(7)) == 7) & (c("alternate_group") == 0), "WARN")),
        _check("FMT-05", ok(c("trak_count") == c("stream_count"), "FAIL")),
    ]
    return facts.select("file_id", F.explode(F.array(*items)).alias("i")).select("file_id", "i.*")


def worst_stream(streams: DataFrame, containers: DataFrame) -> DataFrame:
    """The stream whose duration is farthest from its container's."""
    off = F.abs(F.col("duration_sec") - F.col("container_sec"))
    rank = F.struct(off.alias("delta"), (-F.col("stream_index")).alias("i"))
    out = streams.join(containers, "file_id").where(F.col("duration_sec").isNotNull()).groupBy("file_id").agg(
        F.max_by("stream_index", rank).alias("worst_stream"), F.max(off).alias("delta_sec"))
    return out.withColumn("verdict", F.when(F.col("delta_sec") <= STREAM_TOLERANCE_SEC, "PASS").otherwise("WARN"))


def stream_order(streams: DataFrame) -> DataFrame:
    """Whether stream types are in order video, audio, data, others.

    Sorted exactly when, for every rank, its last position precedes the next
    rank's first one; four bounded aggregates per file say so.
    """
    rank = (F.when(F.col("codec_type") == "video", 0).when(F.col("codec_type") == "audio", 1)
            .when(F.col("codec_type") == "data", 2).otherwise(3))
    at = F.col("stream_index")
    agg = streams.withColumn("_r", rank).groupBy("file_id").agg(
        *[F.max(F.when(F.col("_r") == r, at)).alias(f"last{r}") for r in range(4)],
        *[F.min(F.when(F.col("_r") > r, at)).alias(f"next{r}") for r in range(4)])
    fine = F.lit(True)
    for r in range(3):
        fine = fine & F.coalesce(F.col(f"last{r}") < F.col(f"next{r}"), F.lit(True))
    return agg.select("file_id", F.when(fine, "PASS").otherwise("WARN").alias("verdict"))


def format_checks(streams: DataFrame, containers: DataFrame) -> DataFrame:
    """Stream rules FMT-01 (durations), FMT-02 (zero length) and FMT-03 (order)."""
    first = worst_stream(streams, containers).select("file_id", F.lit("FMT-01").alias("check_id"), "verdict")
    empty = F.coalesce(F.col("duration_sec"), F.lit(0.0)) == 0
    second = streams.groupBy("file_id").agg(
        F.when(F.bool_or(empty), "FAIL").otherwise("PASS").alias("verdict"))
    third = stream_order(streams)
    out = first
    for check, part in (("FMT-02", second), ("FMT-03", third)):
        out = out.unionByName(part.select("file_id", F.lit(check).alias("check_id"), "verdict"))
    return out


def entry_consistency(entries: DataFrame) -> DataFrame:
    """Audio sample entries whose declared sizes contradict each other."""
    table = F.create_map(*[x for k, v in ENTRY_BITS.items() for x in (F.lit(k), F.lit(v))])
    fixed = F.try_element_at(table, F.col("fourcc"))
    pcmc, size, packet = F.col("pcmc_bits"), F.col("samplesize_bits"), F.col("packet_bytes")
    expected = F.coalesce(fixed, F.nullif(pcmc, F.lit(0)), size).cast("bigint")
    conflict = fixed.isNull() & pcmc.isNotNull() & (size > 0) & (pcmc != size)
    odd_packet = (packet > 0) & (expected > 0) & (packet * 8 != expected)
    problems = F.concat_ws(";", F.when(conflict, "declared_bits_conflict"), F.when(odd_packet, "packet_bytes_conflict"))
    return entries.select("*", expected.alias("expected_bits"), problems.alias("problems"),
                          (problems == "").alias("consistent"))
