"""Run-against-run comparison, re-decision, threshold sweeps, attribution."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .quantiles import exact_quantiles
from .windows import clip, nearest_centre, required_windows, good_frames

# Current thresholds and the reasons no threshold can turn.
CURRENT = {"frames": 5, "conf": 0.3, "mad": 1.0, "shift": 5, "ppm": 5.0, "drift_ms": 0.1}
NEVER = ["silent_track", "non_finite", "no_valid_anchor", "out_of_range"]
RECHECK = "recheck_residual"
REFUSED_REASONS = ["non_constant", "recheck_residual", "low_confidence"]
OFF_MS = 1000.0 * 5 / 48000
ADOPTED = ["fixed", "already_aligned"]


def first_seen(arms: DataFrame) -> DataFrame:
    """Tracks of nested arm records; the first arm in priority order wins.

    ``arms``: priority, file, channels array. One shuffle with map-side combine.
    """
    tracks = arms.select("priority", "file", F.posexplode("channels").alias("pos", "c"))
    kept = tracks.groupBy("file", F.col("c.stream").alias("stream")).agg(
        F.min_by(F.struct("priority", "c"), F.struct("priority", "pos")).alias("w"))
    return kept.select("file", F.col("w.priority").alias("priority"), "w.c.*")


def run_changes(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """Field-exact differences of two runs on (file, track).

    Tracks of files present in one run only are left to the file sets. An
    untouched track that became an anchor is ``reclassified``, not changed.
    """
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("file_id", "track_id", F.struct(*fields).alias(name))

    common = a.select("file_id").distinct().join(b.select("file_id").distinct(), "file_id")
    both = packed(a, "x").join(packed(b, "y"), ["file_id", "track_id"], "full").join(common, "file_id", "left_semi")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"x.{f}").cast("string").alias("a"),
                              F.col(f"y.{f}").cast("string").alias("b")) for f in fields])
    moved = (F.col("field") == "decision") & F.coalesce((F.col("a") == "untouched") & (F.col("b") == "anchor"), F.lit(False))
    was = F.coalesce(F.col("x.decision") == "fixed", F.lit(False))
    now = F.coalesce(F.col("y.decision") == "fixed", F.lit(False))
    return (
        both.select("file_id", "track_id", was.alias("was"), now.alias("now"), F.explode(rows).alias("r"))
        .select("file_id", "track_id", "was", "now", "r.*").where(~F.col("a").eqNullSafe(F.col("b")))
        .withColumn("change", F.when(moved, "reclassified")
                    .when((F.col("field") == "decision") & F.col("was") & ~F.col("now"), "lost_fix")
                    .when((F.col("field") == "decision") & F.col("now") & ~F.col("was"), "added_fix")
                    .when((F.col("field") == "delay_ms") & F.col("was") & F.col("now"), "changed_value")
                    .otherwise("changed")).drop("was", "now"))


def run_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("field", "change").agg(
        F.count(F.lit(1)).alias("n_changes"))


def redecide(th: dict[str, Column]) -> Column:
    """Decision a track would get under ``th`` (frames, conf, mad, shift).

    Accepted tracks can only move across the shift threshold; refused ones run
    through every gate in order.
    """
    c = F.col
    by_shift = F.when(F.abs(c("delay_samples")) <= th["shift"], "aligned").otherwise("fixed")
    drift = ((F.abs(F.coalesce("drift_ppm", F.lit(0.0))) > CURRENT["ppm"]) & (c("spread_ms") > CURRENT["drift_ms"]))
    reason = F.coalesce("reason", F.lit(""))
    return (
        F.when(c("decision") == "anchor", "anchor")
        .when(c("decision").isin(*ADOPTED), F.when(c("delay_samples").isNull(), "refused").otherwise(by_shift))
        .when(reason.isin(*NEVER), "unrecoverable").when(reason == RECHECK, "recheck")
        .when(c("delay_samples").isNull() | c("delay_ms").isNull(), "unmeasured")
        .when((F.coalesce("usable_frames", F.lit(0)) < th["frames"]) | (F.coalesce("confidence", F.lit(0.0)) < th["conf"]), "refused")
        .when(c("mad_ms").isNull() | (c("mad_ms") > th["mad"]), "refused")
        .when((c("usable_frames") >= 20) & (c("spread_ms") > th["mad"]), "refused")
        .when((c("usable_frames") < 20) & (reason == "non_constant"), "needs_remeasure")
        .when(drift, "refused").otherwise(by_shift))


def current_thresholds() -> dict[str, Column]:
    return {k: F.lit(CURRENT[k]) for k in ("frames", "conf", "mad", "shift")}


def parity(tracks: DataFrame) -> DataFrame:
    """How often the replica and the stored decision disagree on a fix."""
    again = redecide(current_thresholds()) == "fixed"
    stored = F.col("decision") == "fixed"
    return tracks.agg(F.count(F.lit(1)).alias("tracks"), F.count_if(again & ~stored).alias("only_replica"),
                      F.count_if(~again & stored).alias("only_stored"))


def sweep(tracks: DataFrame, grid: list[tuple]) -> DataFrame:
    """New fixes and remaining error for each (param, value, frames, conf, mad, shift).

    The grid is a literal carried in the projection; rows are counted map-side,
    so only one partial row per grid point leaves each task.
    """
    points = F.array(*[F.struct(F.lit(p).alias("param"), F.lit(float(v)).alias("value"), F.lit(int(fr)).alias("frames"),
                                F.lit(float(cf)).alias("conf"), F.lit(float(md)).alias("mad"), F.lit(int(sh)).alias("shift"))
                       for p, v, fr, cf, md, sh in grid])
    wide = tracks.withColumn("g", F.explode(points))
    d = redecide({k: F.col(f"g.{k}") for k in ("frames", "conf", "mad", "shift")})
    wide = wide.withColumn("d", d)
    stored = F.col("decision")
    new = (F.col("d") == "fixed") & (stored != "fixed")
    kept = ~new & F.col("d").isin("fixed", "aligned") & stored.isin(*ADOPTED)
    off = (F.col("delay_samples").isNotNull() & ~F.col("d").isin("fixed", "aligned", "anchor")
           & (F.abs("delay_samples") > CURRENT["shift"]))
    size = F.abs(F.coalesce("delay_ms", F.lit(0.0)))
    total = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    return wide.groupBy("g.param", "g.value", "g.frames", "g.mad", "g.shift").agg(
        F.count_if(new).alias("new_fixed"), F.count_if(kept).alias("adopted"),
        total(new, size).alias("recover_ms"), total(new, F.col("spread_ms")).alias("accept_ms"),
        total(off, size).alias("remain_ms"), F.count_if(off).alias("remain_tracks"))


def gate_attribution(tracks: DataFrame, mad_gate_ms: float) -> DataFrame:
    """Which gate refused the tracks that are still off: share and medians per gate."""
    gate = (F.when(F.col("mad_ms").isNull(), "no_data").when(F.col("mad_ms") > mad_gate_ms, "gate1_mad")
            .when(F.col("displacement_ms") > mad_gate_ms, "gate2_disp")
            .when(F.col("usable_frames") >= 20, "gate3_range").otherwise("other"))
    off = tracks.where((F.col("decision") == "untouched") & (F.abs("delay_ms") >= OFF_MS)).withColumn("gate", gate)
    long = off.select("gate", F.expr("stack(3, 'delay', delay_ms, 'mad', mad_ms, 'disp', displacement_ms) AS (metric, v)"))
    med = exact_quantiles(long, ["gate", "metric"], "v", {"m": 0.5})
    medians = med.groupBy("gate").agg(*[F.max(F.when(F.col("metric") == k, F.col("m"))).alias(f"{k}_median") for k in ("delay", "mad", "disp")])
    counts = off.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # over one row per gate
    return counts.withColumn("total", total).join(medians, "gate").select(
        "gate", "n", (F.col("n") / F.col("total")).alias("share"), "delay_median", "mad_median", "disp_median")


def triage_fixes(base: DataFrame, candidate: DataFrame, verified: DataFrame, rate: float) -> DataFrame:
    """Added fixes as good, beneficial, suspect or unverified."""
    fixed = F.col("decision") == "fixed"
    added = candidate.where(fixed).join(base.where(fixed).select("track_id"), "track_id", "left_anti")
    bound = F.col("displacement_ms") * rate / 1000
    outcome = (F.when(~F.coalesce("exact", F.lit(False)), "suspect").when(F.col("after").isNull(), "unverified")
               .when(F.abs("after") <= 1, "good").when(F.abs("after") <= bound, "beneficial").otherwise("suspect"))
    return added.select("track_id").join(verified, "track_id", "left").withColumn("triage", outcome).groupBy("triage").agg(
        F.count(F.lit(1)).alias("n"))


def validation_subset(tracks: DataFrame) -> DataFrame:
    """Files worth re-running: a fix, or a refused track that is still off."""
    fixed = F.col("decision") == "fixed"
    refused = ((F.col("decision") == "untouched") & F.col("reason").isin(*REFUSED_REASONS) & (F.abs("delay_ms") >= OFF_MS))
    flags = tracks.groupBy("file_id").agg(F.bool_or(fixed).alias("f"), F.bool_or(F.coalesce(refused, F.lit(False))).alias("r"))
    return flags.where("f OR r").select("file_id", F.when(F.col("f"), "fixed").otherwise("refused_off").alias("kind"))


def evidence_bound(frames: DataFrame, lengths: DataFrame, *, window: int, hop: int, min_frames: int = 3,
                   min_confidence: float = 0.3) -> DataFrame:
    """Windows the best single source resolves, and the unions over family and all.

    ``frames`` carries ``family`` and ``source``; sources of a pair are few.
    """
    keys = ["file_id", "tgt"]
    at = clip(nearest_centre(F.col("center_sample"), window, hop), required_windows(F.col("n_samples"), hop))
    placed = good_frames(frames, min_confidence).join(lengths, ["file_id", "ref", "tgt"]).withColumn("window_no", at)
    measured = placed.where(F.col("window_no") < F.floor((F.col("n_samples") - window) / F.lit(hop)) + 1)
    hits = measured.groupBy(*keys, "family", "source", "window_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_frames)
    single = hits.groupBy(*keys, "family", "source").agg(F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(
        F.max("k").alias("best_single"), F.count(F.lit(1)).alias("n_sources"))
    family = hits.groupBy(*keys, "family", "window_no").agg(F.lit(1).alias("o")).groupBy(*keys, "family").agg(
        F.count(F.lit(1)).alias("k")).groupBy(*keys).agg(F.max("k").alias("best_family"))
    union = hits.groupBy(*keys, "window_no").agg(F.lit(1).alias("o")).groupBy(*keys).agg(F.count(F.lit(1)).alias("union_all"))
    return single.join(family, keys).join(union, keys)


def improvement(tracks: DataFrame) -> DataFrame:
    """|delay| over spread of refused tracks that are off, in total and per reason."""
    off = tracks.where((F.col("decision") == "untouched") & (F.abs("delay_ms") >= OFF_MS))
    ratio = F.when(F.col("spread_ms") > 0, F.try_divide(F.abs("delay_ms"), F.col("spread_ms")))
    # every row counts once in its reason and once in the total
    rated = off.select(F.explode(F.array(F.coalesce("reason", F.lit("?")), F.lit("total"))).alias("reason"), ratio.alias("ratio"))
    q = exact_quantiles(rated, ["reason"], "ratio", {"ratio_min": 0.0, "ratio_median": 0.5, "ratio_max": 1.0})
    r = F.col("ratio")
    counts = rated.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(r < 1).alias("below_1"), F.count_if((r >= 1) & (r < 3)).alias("from_1_to_3"),
        F.count_if(r >= 3).alias("from_3"), F.count_if(r.isNull()).alias("zero_spread"))
    return counts.join(q, "reason", "left")
