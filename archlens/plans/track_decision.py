"""Track decisions of whole files: scope, health, anchor, measurement, wide re-search, gates, bound pairs, recheck, outcome."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import rms_dbfs
from ..operators import decide as d, signal as g, trajectory as t
from ..session import cut_lineage

# Reach of the second search, recheck around an applied shift, reasons of a measurement that failed.
WIDE_SEC, RECHECK_SEC, RECHECK_SEGMENT_SEC, RECHECK_MIN_SAMPLES = 0.25, 0.005, 30.0, 4096
FAILED = ["insufficient_frames", "low_confidence", "non_constant", "out_of_range", "recheck_residual", "evidence_insufficient"]
OUT_OF_SCOPE = ["no_audio_streams", "non_pcm_audio", "mixed_sample_rates", "unsupported_sample_rate", "unknown_channel_layout",
                "channel_count_out_of_range"]


def channel_health(blocks: DataFrame, silent_dbfs: float) -> DataFrame:
    """Level of each channel over all its blocks; a non-finite sample makes it unusable."""
    db = rms_dbfs(F.col("samples"))
    power = F.when(db.isNotNull(), F.pow(F.lit(10.0), db / 10) * F.size("samples"))
    per = blocks.groupBy(*g.CH).agg(F.bool_and(db.isNotNull()).alias("finite"), (F.sum(power) / F.sum(F.size("samples"))).alias("p"))
    level = F.when(F.col("finite"), 10 * F.log10(F.greatest("p", F.lit(1e-30))))
    return per.select(*g.CH, "finite", level.alias("rms_dbfs"), F.coalesce(level >= silent_dbfs, F.lit(False)).alias("healthy"))


def bound_pairs(blocks: DataFrame, health: DataFrame, size: int, *, rate: float, frame: int, hop: int, search: int,
                window: int, window_hop: int, factor: int = 4, samples: int = 200, min_samples: int = 30,
                storages: DataFrame | None = None, lengths: DataFrame | None = None, gates: dict = d.BINDING) -> DataFrame:
    """Disjoint rigid pairs (file_id, a, b) among the healthy channels of every file.

    Every pair of healthy channels is heard on sampled frames. The strong ones alone are followed
    window by window over the take, and those whose level, lag span and sign hold are
    bound, strongest first; a channel is bound once. ``min_samples`` sampled frames
    must be measurable, and eight windows at least. A file has at most 28 pairs.
    ``lengths`` (file_id, channel, n_samples) spares a scan of the samples.
    """
    known = g.pcm.channel_lengths(blocks, g.CH, size) if lengths is None else lengths
    healthy = known.join(health.where("healthy").select(*g.CH), g.CH)
    end = lambda name: healthy.select("file_id", F.col("channel").alias(name), F.col("n_samples").alias(f"_{name}"))
    every = cut_lineage(end("ref").join(end("tgt"), "file_id").where("ref < tgt").select(*t.KEYS, F.least("_ref", "_tgt").alias("n_samples")))
    strength = cut_lineage(g.pair_strength(blocks, size, frame=frame, hop=hop, search=search, samples=samples, lengths=every))
    strong = strength.where((F.col("median") >= gates["candidate_snr"]) & (F.col("samples") >= min_samples))
    followed = g.follow_delays(blocks, size, rate=rate, window=window, hop=window_hop, search=search, factor=factor,
                               lengths=every.join(strong.select(*t.KEYS), t.KEYS))
    pair = ["file_id", F.col("ref").alias("a"), F.col("tgt").alias("b")]
    windows = cut_lineage(followed.select(*pair, "valid", "delay_samples", (F.col("coarse_cc") * F.col("polarity")).alias("signed_cc")))
    return d.bind_pairs(d.rigid_pairs(windows, strong.select(*pair, "median", "samples"), min_samples=min_samples,
                                      storages=storages, gates=gates))


def decide_tracks(blocks: DataFrame, size: int, *, rate: float, frame: int, hop: int, search: int,
                  silent_dbfs: float = -60.0, min_usable: int = 5, min_confidence: float = 0.3, min_fraction: float = 0.0,
                  mad_max_ms: float = 1.0, max_ppm: float = 5.0, drift_min_ms: float = 0.1, aligned_max_ms: float = 0.1,
                  min_shift_samples: int = 5, wide: int | None = None, verify_max_ms: float = 0.05, recheck_windows: int = 1,
                  eligible: DataFrame | None = None, bind: dict | None = None) -> DataFrame:
    """One row per channel: anchor, fixed, already aligned, or untouched with the reason.

    ``eligible`` (of :func:`archlens.operators.signal.eligibility`) leaves files out of
    scope alone. The first healthy channel that some later healthy channel
    correlates with anchors its file; where there is none, the first healthy
    one. Files of three or more channels with just two healthy ones are left
    alone. A target with too little evidence is searched again within ``wide``
    samples (a quarter second, three times ``search`` at least) and taken if it then passes
    the same gates; one beyond ``search`` is out of range. A target piled up at the
    edge is out of range only if the wide search says so. A fix stays if the
    residual after its shift is measurable and below ``verify_max_ms``.

    ``blocks`` is read by every stage: pass a stored table, not a plan that is derived anew.

    ``bind`` (settings of :func:`bound_pairs`, window and window_hop at least) lets rigid pairs
    move together before that recheck, and adds the column ``bound_to``.
    """
    health = cut_lineage(channel_health(blocks, silent_dbfs))
    files = health.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("healthy").alias("n_healthy"),
        F.array_sort(F.collect_list(F.when(F.col("healthy"), F.col("channel")))).alias("candidates"))  # at most 8
    two_only = (F.col("n") >= 3) & (F.col("n_healthy") == 2)
    known = F.lit(None).cast("string")
    if eligible is not None:
        files = files.join(eligible.select("file_id", "eligible", F.col("reason").alias("why")), "file_id", "left")
        known = F.when(~F.coalesce("eligible", F.lit(False)), F.coalesce("why", F.lit("no_audio_streams")))
    scope = files.select("file_id", "candidates", F.when(known.isNotNull(), known).when(F.col("n_healthy") == 0, "no_valid_anchor")
                         .when(two_only, "two_channel_only").alias("skip"))
    lengths = cut_lineage(g.pcm.channel_lengths(blocks, g.CH, size))  # sizes of arrays: a scan of all samples
    n = lambda name: lengths.select("file_id", F.col("channel").alias(name), F.col("n_samples").alias(f"n_{name}"))
    usable = F.col("success") & (F.col("confidence") >= min_confidence)

    def measured(pairs: DataFrame, reach: int) -> DataFrame:
        """Frames of the pairs (file, ref, tgt, n_samples) within ``reach`` samples."""
        frames = g.frame_delays(blocks, size, frame=frame, hop=hop, search=reach, pairs=pairs)
        return cut_lineage(frames.select(*t.KEYS, "frame_no", "center_sample", F.when(usable, F.col("delay")).alias("delay_samples"), "confidence"))

    def with_length(pairs: DataFrame) -> DataFrame:
        return pairs.join(n("ref"), ["file_id", "ref"]).join(n("tgt"), ["file_id", "tgt"]).select(
            *[c for c in pairs.columns if c not in t.KEYS], *t.KEYS, F.least("n_ref", "n_tgt").alias("n_samples"))

    def measure(left: DataFrame, k: int) -> DataFrame:
        """Frames of the k-th candidate against every later one."""
        later = F.slice("candidates", k + 2, F.size("candidates"))
        pairs = left.where(F.size("candidates") > k + 1).select(
            "file_id", F.col("candidates")[k].alias("ref"), F.explode(later).alias("tgt"))
        return measured(with_length(pairs), search)

    left, k = scope.where(F.col("skip").isNull()).select("file_id", "candidates"), 0
    first = frames = measure(left, 0)
    while True:  # at most one round per channel, and only files without an anchor go on
        related = frames.groupBy(*t.KEYS).agg(F.count("delay_samples").alias("k")).where(F.col("k") >= min_usable).select("file_id").distinct()
        k += 1
        left = cut_lineage(left.join(related, "file_id", "left_anti"))
        if left.where(F.size("candidates") > k + 1).isEmpty():
            break
        frames = frames.join(left, "file_id", "left_anti").unionByName(measure(left, k))
    # a file that no candidate helps is reported from its first one
    frames = cut_lineage(frames.join(left, "file_id", "left_anti").unionByName(first.join(left, "file_id", "left_semi")))
    chosen = frames.groupBy("file_id").agg(F.min("ref").alias("chosen"))
    scope = scope.join(chosen, "file_id", "left").withColumn("anchor", F.coalesce("chosen", F.try_element_at("candidates", F.lit(1))))
    scope = cut_lineage(scope.drop("chosen"))

    # weak and edge-piled targets of anchored files, and those before the anchor, once more in a wider range
    reach = max(math.ceil(WIDE_SEC * rate), 3 * search) if wide is None else wide
    piled = t.boundary_pileup(frames, search)
    seen = frames.groupBy(*t.KEYS).agg(F.count("delay_samples").alias("n_usable"), F.count(F.lit(1)).alias("n_frames"),
                                       F.count_if(F.col("confidence") > 0).alias("n_heard")).join(piled, t.KEYS)
    few = F.coalesce(F.col("n_usable"), F.lit(0)) < min_usable
    thin = F.coalesce(F.col("n_usable") / F.col("n_frames"), F.lit(0.0)) < min_fraction
    pairs = scope.where("skip IS NULL").select("file_id", F.col("anchor").alias("ref"), F.explode("candidates").alias("tgt")).where("ref <> tgt")
    pairs = cut_lineage(pairs.join(seen, t.KEYS, "left").select(
        *t.KEYS, "n_heard", few.alias("few"), (few | thin).alias("weak"), (F.col("edge_share") > 0.5).alias("piled")))
    again = pairs.where(F.col("weak") | F.col("piled")).join(left.select("file_id"), "file_id", "left_anti")
    far = measured(with_length(again.select(*t.KEYS)), reach)
    total = far.groupBy(*t.KEYS).agg(F.count(F.lit(1)).alias("n_far"))
    est = t.pair_estimate(far, rate).withColumnRenamed("confidence", "far_confidence").join(total, t.KEYS)
    sure = (F.col("usable_frames") >= min_usable) & (F.col("far_confidence") >= min_confidence)
    away = F.abs("delay_samples")
    verdict = (F.when(F.col("weak"), F.when(away > search, "out_of_range").when(~sure, "low_confidence")
                      .when(F.col("usable_frames") / F.col("n_far") < min_fraction, "evidence_insufficient").otherwise("adopted"))
               .when(sure & (away > search + 0.5), "out_of_range"))
    pairs = cut_lineage(pairs.join(est, t.KEYS, "left").select(
        *t.KEYS, "weak", "few", "n_heard", F.when(F.col("n_far").isNotNull(), verdict).alias("verdict")))
    taken = pairs.where("verdict = 'adopted'").select(*t.KEYS)
    frames = cut_lineage(frames.join(taken, t.KEYS, "left_anti").unionByName(far.join(taken, t.KEYS, "left_semi")))

    tracks = health.join(scope.drop("candidates"), "file_id")
    found = t.constant_offsets(frames, rate, mad_max_ms=mad_max_ms, max_ppm=max_ppm, drift_min_ms=drift_min_ms, min_usable=min_usable,
                               min_confidence=min_confidence, aligned_max_ms=aligned_max_ms, min_shift_samples=min_shift_samples)
    total = frames.groupBy(*t.KEYS).agg(F.count(F.lit(1)).alias("total_frames"))
    found = found.join(total, t.KEYS).withColumn("coverage", F.col("usable_frames") / F.col("total_frames"))
    out = (tracks.join(found.withColumnRenamed("tgt", "channel").drop("ref"), g.CH, "left")
           .join(pairs.withColumnRenamed("tgt", "channel").drop("ref"), g.CH, "left"))
    lost = F.coalesce(F.col("weak"), F.lit(False)) & ~F.col("verdict").eqNullSafe("adopted")
    reason = (F.when(F.col("skip").isNotNull(), F.col("skip")).when(~F.col("finite"), "non_finite").when(~F.col("healthy"), "silent_track")
              .when(F.col("channel") == F.col("anchor"), None).when(F.col("verdict") == "out_of_range", "out_of_range")
              .when(lost & (F.col("channel") < F.col("anchor")), "uncorrelated")
              .when(lost & F.col("few"), F.when(F.col("n_heard") >= min_usable, "low_confidence").otherwise("insufficient_frames"))
              .when(lost, F.coalesce("verdict", F.lit("evidence_insufficient"))).when(F.col("outcome").isNull(), "insufficient_frames")
              .when(F.col("outcome").isin("fixed", "already_aligned"), F.when(F.abs("offset_samples") > search, "out_of_range"))
              .otherwise(F.col("outcome")))
    out = out.withColumn("reason", reason)
    if bind is not None:
        in_scope = scope.where("skip IS NULL").select("file_id")
        pairs = bound_pairs(blocks, health.join(in_scope, "file_id", "left_semi"), size,
                            **{"rate": rate, "frame": frame, "hop": hop, "search": search, "lengths": lengths} | bind)
        out = d.follow_bound(cut_lineage(out), cut_lineage(pairs))
    out = cut_lineage(out)

    # what a fix leaves behind, read at its shift
    near = math.ceil(RECHECK_SEC * rate)
    fixes = with_length(out.where("reason IS NULL AND outcome = 'fixed'").select(
        "file_id", F.col("anchor").alias("ref"), F.col("channel").alias("tgt"), F.col("shift_samples").alias("shift")))
    residual = g.recheck(blocks, size, windows=recheck_windows, segment=int(RECHECK_SEGMENT_SEC * rate), search=near, rate=rate,
                         pairs=cut_lineage(fixes.where(F.col("n_samples") >= 2 * near + RECHECK_MIN_SAMPLES)))
    out = out.join(residual.select("file_id", F.col("tgt").alias("channel"), "worst_ms"), g.CH, "left")
    left_over = (F.col("outcome") == "fixed") & ~F.coalesce(F.abs("worst_ms") < verify_max_ms, F.lit(False))
    out = out.withColumn("reason", F.when(F.col("reason").isNull() & left_over, "recheck_residual").otherwise(F.col("reason")))
    return out.select(
        *g.CH, "rms_dbfs", F.when(F.col("reason").isNotNull(), "untouched").when(F.col("channel") == F.col("anchor"), "anchor")
        .otherwise(F.col("outcome")).alias("decision"), "reason", "usable_frames", "coverage", "confidence", "offset_samples", "mad_ms",
        F.when(F.col("reason").isNull(), F.col("shift_samples")).alias("shift_samples"), *([] if bind is None else ["bound_to"]))


def file_outcome(tracks: DataFrame) -> DataFrame:
    """applied, already_aligned, or measure_failed, with the counts behind it.

    With a ``reason`` column a file fails only if a measurement failed and none
    found a target aligned, and files out of scope say so.
    """
    d = F.col("decision")
    reason = F.col("reason") if "reason" in tracks.columns else F.lit(None).cast("string")
    failed = reason.isin(*FAILED, "uncorrelated", "no_valid_anchor") if "reason" in tracks.columns else d == "untouched"
    scope = (F.when(reason == "two_channel_only", reason).when(reason.startswith("mixed_pcm_compressed"), "mixed_audio_skip")
             .when(reason.isin(*OUT_OF_SCOPE), "not_eligible"))
    per = tracks.groupBy("file_id").agg(
        F.count_if(d == "fixed").alias("fixed"), F.count_if(d == "already_aligned").alias("aligned"), F.count_if(d == "untouched").alias("untouched"),
        F.count_if(failed).alias("_failed"), F.count_if(d == "anchor").alias("_anchors"), F.max(scope).alias("_scope"))
    nothing = (F.col("_failed") > 0) | (F.col("_anchors") == 0)
    return per.withColumn("status", F.when(F.col("_scope").isNotNull(), F.col("_scope")).when(F.col("fixed") > 0, "applied")
                          .when(F.col("aligned") > 0, "already_aligned").when(nothing, "measure_failed").otherwise("already_aligned")).drop(
        "_failed", "_anchors", "_scope")
