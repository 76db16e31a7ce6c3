"""Statistics and gates over frame-delay trajectories (one row per frame)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import BLOCK, carry
from .quantiles import exact_quantiles, stacked_quantiles

KEYS = ["file_id", "ref", "tgt"]
SPAN = 64 * BLOCK  # samples per position block


def usable(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("delay_samples").isNotNull())


def pair_estimate(frames: DataFrame, rate: float) -> DataFrame:
    """Median delay, median confidence and usable count over usable frames."""
    pivoted = stacked_quantiles(usable(frames), KEYS, {"delay": ("delay_samples", {"delay_samples": 0.5}),
                                                       "confidence": ("confidence", {"confidence": 0.5})})
    counts = frames.groupBy(*KEYS).agg(F.count("delay_samples").alias("usable_frames"))
    return (
        counts.join(pivoted, KEYS, "left")
        .select(*KEYS, "usable_frames", "delay_samples",
                (F.col("delay_samples") * 1000 / rate).alias("delay_ms"),
                F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    )


def robust_spread(frames: DataFrame, rate: float, trim_pct: float = 5.0,
                  min_frames: int = 20) -> DataFrame:
    """Median, MAD and trimmed displacement from two quantile passes."""
    good = usable(frames).select(*KEYS, "delay_samples")
    tail = trim_pct / 100
    first = exact_quantiles(good, KEYS, "delay_samples",
                            {"med": 0.5, "p_lo": tail, "p_hi": 1 - tail,
                             "d_min": 0.0, "d_max": 1.0}, count="n")
    deviation = (
        good.join(first.select(*KEYS, "med"), KEYS)
        .select(*KEYS, F.abs(F.col("delay_samples") - F.col("med")).alias("dev"))
    )
    mad = exact_quantiles(deviation, KEYS, "dev", {"mad": 0.5})
    trimmed = (F.col("n") >= min_frames) & F.lit(0 < trim_pct < 50)
    return first.join(mad, KEYS).select(
        *KEYS, "n", "med",
        (F.col("mad") * 1000 / rate).alias("mad_ms"),
        (F.col("d_max") - F.col("d_min")).alias("spread_samples"),
        (F.when(trimmed, F.col("p_hi") - F.col("p_lo"))
         .otherwise(F.col("d_max") - F.col("d_min")) * 1000 / rate).alias("displacement_ms"))


def drift(frames: DataFrame, rate: float) -> DataFrame:
    """Largest step between neighbouring usable frames and the fitted drift."""
    good = usable(frames).select(*KEYS, "frame_no", "center_sample", "delay_samples")
    stepped = carry(good, KEYS, "center_sample", F.col("delay_samples"), "_prev",
                    size=SPAN, strict=True, ties=["frame_no"])
    slope = F.regr_slope("delay_samples", "center_sample")
    span = F.max("center_sample") - F.min("center_sample")
    return (
        stepped.groupBy(*KEYS)
        .agg(F.max(F.abs(F.col("delay_samples") - F.col("_prev"))).alias("step"),
             F.count(F.lit(1)).alias("_n"), slope.alias("_slope"), span.alias("_span"))
        .select(*KEYS,
                (F.coalesce("step", F.lit(0.0)) * 1000 / rate).alias("max_step_ms"),
                F.when(F.col("_n") >= 2, F.col("_slope") * 1e6).otherwise(0.0).alias("drift_ppm"),
                F.when(F.col("_n") >= 2, F.col("_slope") * F.col("_span") * 1000 / rate)
                .alias("drift_total_ms"))
    )


def trajectory_stats(frames: DataFrame, rate: float) -> DataFrame:
    return robust_spread(frames, rate).join(drift(frames, rate), KEYS)


def boundary_pileup(frames: DataFrame, search_samples: float) -> DataFrame:
    """Share of usable frames at the edge of the search range."""
    edge = F.abs("delay_samples") >= F.lit(search_samples - 0.5)
    return frames.groupBy(*KEYS).agg(
        F.coalesce(F.avg(F.when(F.col("delay_samples").isNotNull(), edge.cast("double"))),
                   F.lit(0.0)).alias("edge_share"))


def is_constant(mad_max_ms: float, max_ppm: float, rate: float,
                drift_min_ms: float = 0.0, min_frames: int = 20) -> Column:
    """Constancy gate over the columns of :func:`trajectory_stats`."""
    full_ms = F.col("spread_samples") * 1000 / rate
    disp = F.col("displacement_ms")
    moved = F.coalesce(disp, full_ms)
    drifting = (
        F.lit(drift_min_ms > 0) & (F.abs("drift_ppm") > max_ppm)
        & (F.abs(F.coalesce("drift_total_ms", F.lit(0.0))) > drift_min_ms)
        & (F.abs(moved) > drift_min_ms))
    in_range = (
        F.when(disp.isNotNull(),
               (disp <= mad_max_ms) & ((F.col("n") < min_frames) | (full_ms <= mad_max_ms)))
        .otherwise(full_ms <= mad_max_ms))
    return F.coalesce((F.col("mad_ms") <= mad_max_ms) & in_range & ~drifting, F.lit(False))


def is_aligned(delay_ms: Column, delay_samples: Column, aligned_max_ms: float,
               min_shift_samples: int) -> Column:
    """No correction needed: too small in time, below a sample, or a tiny shift."""
    return ((F.abs(delay_ms) < aligned_max_ms) | (F.abs(delay_samples) < 1)
            | (F.abs(F.rint(delay_samples)) <= min_shift_samples))


def constant_offsets(frames: DataFrame, rate: float, *, mad_max_ms: float,
                     max_ppm: float, drift_min_ms: float, min_usable: int,
                     min_confidence: float, aligned_max_ms: float,
                     min_shift_samples: int) -> DataFrame:
    """Which pairs hold a constant, correctable offset, and by how much."""
    est = pair_estimate(frames, rate).withColumnRenamed("delay_samples", "offset_samples")
    stats = trajectory_stats(frames, rate)
    aligned = is_aligned(F.col("delay_ms"), F.col("offset_samples"),
                         aligned_max_ms, min_shift_samples)
    return (
        est.join(stats, KEYS, "left")
        .withColumn("constant", is_constant(mad_max_ms, max_ppm, rate, drift_min_ms))
        .withColumn("outcome",
                    F.when(F.col("offset_samples").isNull(), "unmeasured")
                    .when(F.col("usable_frames") < min_usable, "insufficient_frames")
                    .when(F.col("confidence") < min_confidence, "low_confidence")
                    .when(~F.col("constant"), "non_constant")
                    .when(aligned, "already_aligned").otherwise("fixed"))
        .select(*KEYS, "usable_frames", "offset_samples", "delay_ms", "confidence",
                "mad_ms", "displacement_ms", "drift_ppm", "constant", "outcome",
                F.when(F.col("outcome") == "fixed",
                       F.rint("offset_samples").cast("bigint")).alias("shift_samples"))
    )
