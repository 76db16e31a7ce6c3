"""Correction windows: coordinates, aggregation, gap states and fills, evidence.

A plan has one row per (file, ref, tgt, window): ``n_frames``, ``valid``,
``delay_samples`` and the integer ``shift``. Every window an applier needs is
present, measured or not.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import BLOCK, carry, neighbours, running_max, running_sum, runs
from .quantiles import exact_quantiles, stacked_quantiles
from .trajectory import KEYS

WINDOW = [*KEYS, "window_no"]
SCALED_MAD = 1.4826
FILL_POLICIES = ["hold", "no_correction_gap", "explicit_state", "current", "linear", "next"]


def latest_start(pos: Column, hop: int) -> Column:
    return F.floor(pos / F.lit(hop))


def nearest_centre(pos: Column, window: int, hop: int) -> Column:
    return F.floor((pos - window // 2 + hop // 2) / F.lit(hop))


def clip(window_no: Column, count: Column) -> Column:
    return F.least(F.greatest(window_no, F.lit(0)), count - 1).cast("bigint")


def required_windows(n: Column, hop: int) -> Column:
    return F.ceil(n / F.lit(hop)).cast("bigint")


def measured_windows(n: Column, window: int, hop: int) -> Column:
    return F.when(n < window, 0).otherwise(F.floor((n - window) / F.lit(hop)) + 1).cast("bigint")


def window_spine(lengths: DataFrame, count: Column) -> DataFrame:
    """``window_no`` 0..count-1 for every row of ``lengths``."""
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(count, F.lit(1)) - 1, F.lit(4096).cast("bigint")))
    return (
        lengths.where(count > 0).withColumn("_count", count).withColumn("_from", start)
        .withColumn("window_no", F.explode(F.sequence(
            F.col("_from"), F.least(F.col("_from") + 4095, F.col("_count") - 1))))
        .drop("_from", "_count")
    )


def pair_lengths(frames: DataFrame, n_samples: int) -> DataFrame:
    return frames.select(*KEYS).distinct().withColumn("n_samples", F.lit(n_samples).cast("bigint"))


def aggregate_frames(frames: DataFrame, lengths: DataFrame, *, hop: int, min_frames: int) -> DataFrame:
    """Frames to windows by latest start; a window below the frame floor is invalid."""
    placed = frames.where(F.col("delay_samples").isNotNull()).withColumn(
        "window_no", latest_start(F.col("center_sample"), hop))
    return _plan(placed, window_spine(lengths, required_windows(F.col("n_samples"), hop)), min_frames)


def aggregate_nearest(frames: DataFrame, lengths: DataFrame, *, window: int, hop: int,
                      min_frames: int, min_confidence: float = 0.3) -> DataFrame:
    """Confident frames to measured windows by nearest centre."""
    placed = good_frames(frames, min_confidence).join(lengths, KEYS).withColumn(
        "window_no", clip(nearest_centre(F.col("center_sample"), window, hop),
                          required_windows(F.col("n_samples"), hop)))
    spine = window_spine(lengths, measured_windows(F.col("n_samples"), window, hop))
    return _plan(placed, spine, min_frames)


def good_frames(frames: DataFrame, min_confidence: float) -> DataFrame:
    return frames.where(F.col("delay_samples").isNotNull() & (F.col("confidence") >= min_confidence))


def _plan(placed: DataFrame, spine: DataFrame, min_frames: int) -> DataFrame:
    medians = exact_quantiles(placed, WINDOW, "delay_samples", {"_med": 0.5}, count="_n", bounded=True)
    n = F.coalesce("_n", F.lit(0))
    plan = spine.join(medians, WINDOW, "left").select(
        *WINDOW, n.alias("n_frames"), (n >= min_frames).alias("valid"),
        F.when(n >= min_frames, F.col("_med")).alias("delay_samples"))
    return plan.withColumn("shift", F.rint("delay_samples").cast("bigint"))


def frame_counts(frames: DataFrame, lengths: DataFrame, *, hop: int) -> DataFrame:
    """Frames seen, finite, and outside the plan, per pair."""
    need = required_windows(F.col("n_samples"), hop)
    at = latest_start(F.col("center_sample"), hop)
    inside = (at >= 0) & (at < need)
    return frames.join(lengths, KEYS).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.count_if(inside & F.col("delay_samples").isNotNull()).alias("n_finite_frames"),
        F.count_if(~inside).alias("n_outside_plan"))


def gap_states(plan: DataFrame) -> DataFrame:
    """TRUSTED, UNRESOLVED_GAP, or REENTRY right after a gap; never on the first row."""
    wide, window, keep = neighbours(plan, KEYS, "window_no", 1)
    return (
        wide.withColumn("_prev", F.lag("valid").over(window)).where(keep)
        .withColumn("state", F.when(~F.col("valid"), "UNRESOLVED_GAP")
                    .when(~F.coalesce("_prev", F.lit(True)), "REENTRY").otherwise("TRUSTED"))
        .drop("_prev", "_home", "_blk"))


def fill_gaps(plan: DataFrame) -> DataFrame:
    """The plan's shift under every fill policy, one column each.

    ``linear`` interpolates between the trusted windows around each gap and
    holds the only one where the other side has none.
    """
    seen = F.when(F.col("valid"), F.struct(F.col("window_no").alias("w"), F.col("shift").alias("s")))
    both = carry(plan, KEYS, "window_no", seen, "_p")
    both = carry(both, KEYS, "window_no", seen, "_n", forward=False)
    p, n = F.col("_p.s"), F.col("_n.s")
    share = F.try_divide((F.col("window_no") - F.col("_p.w")).cast("double"), F.col("_n.w") - F.col("_p.w"))
    between = F.rint(p + (n - p) * F.coalesce(share, F.lit(0.0))).cast("bigint")
    zero = F.lit(0).cast("bigint")
    hold = F.coalesce(p, zero)
    return both.select(
        *WINDOW, "valid", "shift", hold.alias("hold"),
        F.when(F.col("valid"), F.col("shift")).otherwise(zero).alias("no_correction_gap"),
        hold.alias("explicit_state"), F.coalesce(p, n, zero).alias("current"),
        F.coalesce(between, p, n, zero).alias("linear"), F.coalesce(n, zero).alias("next"))


def longest_run(rows: DataFrame, keys: list[str], pos: str, flag: Column,
                wanted: bool) -> DataFrame:
    found = runs(rows, keys, pos, flag)
    return found.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("flag") == wanted, F.col("run_length"))), F.lit(0)).alias("longest"),
        F.count_if(F.col("flag") == wanted).alias("n_runs"))


def merge_intervals(intervals: DataFrame, keys: list[str], gap: int = 0,
                    size: int = BLOCK) -> DataFrame:
    """Union of half-open (start, count) intervals, joined across gaps up to ``gap``."""
    items = intervals.where(F.col("count") > 0).groupBy(*keys, "start").agg(
        F.max(F.col("start") + F.col("count")).alias("end"))
    before = running_max(items, keys, "start", F.col("end"), "_reach", size=size)
    opens = F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + max(0, gap)), 1).otherwise(0)
    island = running_sum(before, keys, "start", opens, "_island", size=size)
    return island.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
    ).select(*keys, "start", (F.col("end") - F.col("start")).alias("count"))


def evidence(plan: DataFrame, min_coverage: float) -> DataFrame:
    """Coverage, sizes and state counts of each plan."""
    stated = gap_states(plan)
    size = F.abs(F.when(F.col("valid"), F.col("shift")))
    med = exact_quantiles(plan, KEYS, size, {"median_abs_shift": 0.5})
    states = ["TRUSTED", "REENTRY", "UNRESOLVED_GAP"]
    counts = stated.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if("valid").alias("n_measured"),
        F.count_if(~F.col("valid")).alias("n_unresolved"),
        F.count_if(F.coalesce("shift", F.lit(0)) != 0).alias("n_with_value"),
        F.max(size).alias("max_abs_shift"),
        *[F.count_if(F.col("state") == x).alias(x.lower()) for x in states])
    share = F.col("n_measured") / F.col("n_windows")
    return counts.join(med, KEYS, "left").withColumn("coverage", share).withColumn(
        "coverage_ok", share >= min_coverage)


def residual_summary(residuals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distribution of |residual|; rows that are not finite are left out, not zero.

    A group with nothing measured at all gets the verdict instead.
    """
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    size = F.when(finite, F.abs(v))
    dist = exact_quantiles(residuals, keys, size, {"median_abs": 0.5, "p90_abs": 0.9, "p95_abs": 0.95, "max_abs": 1.0})
    counts = residuals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), F.count(value).alias("n_measured"),
        F.count_if(finite).alias("n_valid"),
        *[F.count_if(finite & (F.abs(v) <= k)).alias(f"le{k}") for k in (1, 2, 5)])
    return counts.join(dist, keys, "left").withColumn(
        "verdict", F.when(F.col("n_measured") == 0, "no_trusted_window"))


def feasibility(plan: DataFrame, lengths: DataFrame, *, hop: int) -> DataFrame:
    """What a measured plan would deliver: coverage, gaps, density and seam steps."""
    wide, window, keep = neighbours(plan, KEYS, "window_no", 1)
    stepped = (
        wide.withColumn("_prev", F.lag("shift").over(window)).where(keep)
        .withColumn("step", F.abs(F.col("shift") - F.col("_prev"))).select(*WINDOW, "step", "valid", "n_frames"))
    spread = stacked_quantiles(stepped, KEYS, {
        "step": ("step", {"step_p50": 0.5, "step_p90": 0.9}),
        "frames": ("n_frames", {"frames_p10": 0.1, "frames_p50": 0.5, "frames_p90": 0.9})})
    gaps = longest_run(plan, KEYS, "window_no", F.col("valid"), False).select(
        *KEYS, F.col("longest").alias("longest_gap"))
    counts = stepped.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_measured"), F.count_if("valid").alias("n_resolved"),
        F.max("step").alias("step_max"),
        *[F.count_if(F.col("step") > k).alias(f"step_gt_{k}") for k in (1, 5, 48)])
    need = required_windows(F.col("n_samples"), hop)
    return (
        lengths.join(counts, KEYS).join(gaps, KEYS).join(spread, KEYS)
        .withColumn("n_needed", need)
        .withColumn("resolved_fraction", F.col("n_resolved") / F.col("n_measured"))
        .withColumn("coverage", F.col("n_resolved") / need)
        .withColumn("seam", need - F.col("n_measured")).drop("n_samples"))


def gap_cost(frames: DataFrame, lengths: DataFrame, *, window: int, hop: int,
             min_frames: int, rate: float) -> DataFrame:
    """What holding across bounded gaps costs, and whole against fractional shifts."""
    plan = aggregate_nearest(frames, lengths, window=window, hop=hop, min_frames=min_frames)
    placed = good_frames(frames, 0.3).join(lengths, KEYS).withColumn(
        "window_no", clip(nearest_centre(F.col("center_sample"), window, hop),
                          required_windows(F.col("n_samples"), hop)))
    held = placed.select(*WINDOW, F.col("delay_samples").alias("d")).join(
        plan.where("valid").select(*WINDOW, F.col("delay_samples").alias("m")), WINDOW)
    held = held.withColumn("frac", F.abs(F.col("d") - F.col("m"))).withColumn(
        "whole", F.abs(F.col("d") - F.rint("m")))
    cost = stacked_quantiles(held, KEYS, {"frac": ("frac", {"fractional_p90": 0.9}),
                                          "whole": ("whole", {"integer_p90": 0.9})})
    mads = exact_quantiles(held, WINDOW, "frac", {"mad": 0.5}, bounded=True)
    mads = exact_quantiles(mads, KEYS, F.col("mad") * SCALED_MAD * 1000 / rate,
                           {"window_mad_p50_ms": 0.5, "window_mad_p90_ms": 0.9})
    seen = F.when(F.col("valid"), F.struct(F.col("window_no").alias("w"), F.col("delay_samples").alias("d")))
    jumps = carry(plan, KEYS, "window_no", seen, "_p", strict=True).where(
        F.col("valid") & F.col("_p").isNotNull() & (F.col("window_no") - F.col("_p.w") > 1))
    jumps = jumps.select(*KEYS, F.abs(F.col("delay_samples") - F.col("_p.d")).alias("err"),
                         (F.col("window_no") - F.col("_p.w") - 1).alias("len"))
    sizes = stacked_quantiles(jumps, KEYS, {"err": ("err", {"err_p50": 0.5, "err_p90": 0.9, "err_max": 1.0}),
                                            "len": ("len", {"gap_len_p50": 0.5, "gap_len_max": 1.0})})
    counts = plan.groupBy(*KEYS).agg(F.count_if("valid").alias("resolved"),
                                     F.count_if(~F.col("valid")).alias("unresolved"))
    gaps = jumps.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_gaps"), F.count_if(F.col("err") > 48).alias("gaps_gt_48"))
    out = counts
    for part in (gaps, sizes, cost, mads):
        out = out.join(part, KEYS, "left")
    return out.fillna(0, ["n_gaps", "gaps_gt_48"])


def _resolved_at(frames: DataFrame, lengths: DataFrame, window: int, hop: int,
                 offset: int, min_confidence: float) -> DataFrame:
    n = F.col("n_samples") - offset
    placed = good_frames(frames, min_confidence).join(lengths, KEYS).select(
        *KEYS, clip(nearest_centre(F.col("center_sample") - offset, window, hop), required_windows(n, hop)).alias("window_no"),
        measured_windows(n, window, hop).alias("_m"))
    return placed.where(F.col("window_no") < F.col("_m")).groupBy(*WINDOW).agg(F.count(F.lit(1)).alias("n"))


def grid_sensitivity(frames: DataFrame, lengths: DataFrame, *, window: int, hop: int,
                     min_frames: int = 3, min_confidence: float = 0.3) -> DataFrame:
    """Resolved windows when the grid is moved by quarters of a hop, and best-of."""
    names, parts = ["r0", "r1", "r2", "r3"], None
    for k, name in enumerate(names):
        part = _resolved_at(frames, lengths, window, hop, k * hop // 4, min_confidence).withColumn("grid", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    per_window = parts.groupBy(*WINDOW).agg(*[
        F.max(F.when(F.col("grid") == g, F.col("n"))).alias(g) for g in names])
    hits = [F.count_if(F.coalesce(F.col(g), F.lit(0)) >= min_frames) for g in names]
    best = F.greatest(*[F.coalesce(F.col(g), F.lit(0)) for g in names]) >= min_frames
    out = per_window.groupBy(*KEYS).agg(*[h.alias(f"resolved_{i}") for i, h in enumerate(hits)],
                                        F.count_if(best).alias("resolved_best"))
    return lengths.select(*KEYS).join(out, KEYS, "left").fillna(0)


def smallest_window(frames: DataFrame, lengths: DataFrame, *, window: int, hop: int,
                    ladder: list[int], min_frames: int = 3, min_confidence: float = 0.3) -> DataFrame:
    """Per window: the shortest length on the ladder (in hops) that holds enough frames.

    Prefix counts over the hop grid answer every length with one lookup; a
    window already resolved on the base grid keeps the base length.
    """
    base = _resolved_at(frames, lengths, window, hop, 0, min_confidence).withColumnRenamed("n", "_base")
    binned = good_frames(frames, min_confidence).groupBy(
        *KEYS, latest_start(F.col("center_sample"), hop).alias("window_no")).agg(F.count(F.lit(1)).alias("n"))
    spine = window_spine(lengths, required_windows(F.col("n_samples"), hop))
    dense = spine.join(binned, WINDOW, "left").fillna(0, ["n"])
    total = binned.groupBy(*KEYS).agg(F.sum("n").alias("_total"))
    summed = running_sum(dense, KEYS, "window_no", F.col("n"), "_cum").join(total, KEYS, "left")
    wide, order, keep = neighbours(summed, KEYS, "window_no", max(ladder))
    prior = F.coalesce(F.lag("_cum").over(order), F.lit(0))
    reach = {k: F.coalesce(F.lead("_cum", k - 1).over(order), F.col("_total"), F.lit(0)) - prior for k in ladder}
    need = F.coalesce(*[F.when(c >= min_frames, F.lit(k)) for k, c in reach.items()], F.lit(-1))
    looked = wide.withColumn("_need", need).where(keep)
    measured = measured_windows(F.col("n_samples"), window, hop)
    return looked.where(F.col("window_no") < measured).join(base, WINDOW, "left").select(
        *WINDOW, F.when(F.coalesce("_base", F.lit(0)) >= min_frames, ladder[0]).otherwise(F.col("_need"))
        .cast("bigint").alias("need_hops"))


def cadence(packets: DataFrame) -> DataFrame:
    """Presentation times of a file: distinct, and evenly spaced once sorted."""
    times = packets.where(F.col("pts").isNotNull()).groupBy("file_id", "pts").agg(F.count(F.lit(1)).alias("n"))
    gaps = carry(times, ["file_id"], "pts", F.col("pts"), "_prev", strict=True, size=1 << 30)
    out = gaps.groupBy("file_id").agg(
        F.sum("n").alias("n_times"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
        F.min(F.col("pts") - F.col("_prev")).alias("min_gap"), F.max(F.col("pts") - F.col("_prev")).alias("max_gap"))
    return out.withColumn("verdict", F.when(F.col("n_times") < 2, "too_few")
                          .when(F.col("duplicates") > 0, "duplicated")
                          .when((F.col("max_gap") > 0) & (F.col("min_gap") < F.col("max_gap") * 0.5), "irregular")
                          .otherwise("ok"))


def interpolate(points: DataFrame, grid: DataFrame, keys: list[str], t: str = "t", y: str = "y",
                size: int = BLOCK) -> DataFrame:
    """Linear interpolation of ``points`` at the ``grid`` times, edges held."""
    both = points.select(*keys, t, y, F.lit(False).alias("_g")).unionByName(
        grid.select(*keys, t, F.lit(None).cast("double").alias(y), F.lit(True).alias("_g")))
    merged = both.groupBy(*keys, t).agg(F.max(y).alias(y), F.bool_or("_g").alias("_g"))
    seen = F.when(F.col(y).isNotNull(), F.struct(F.col(t).alias("t"), F.col(y).alias("y")))
    around = carry(merged, keys, t, seen, "_p", size=size)
    around = carry(around, keys, t, seen, "_n", size=size, forward=False)
    share = F.try_divide((F.col(t) - F.col("_p.t")).cast("double"), F.col("_n.t") - F.col("_p.t"))
    value = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * F.coalesce(share, F.lit(0.0))
    return around.where("_g").select(*keys, t, F.coalesce(value, F.col("_p.y"), F.col("_n.y")).alias(y))


def pareto_front(points: DataFrame, keys: list[str], gain: str, cost: str, tie: str,
                 size: int = BLOCK) -> DataFrame:
    """Points no other point of the group beats, walking down from the largest gain."""
    ordered = points.withColumn("_pos", -F.col(gain))
    best = running_max(ordered, keys, "_pos", -F.col(cost), "_best", size=size, ties=[cost, tie])
    return best.where(F.col("_best").isNull() | (F.col(cost) < -F.col("_best") - 1e-9)).drop("_pos", "_best")
