"""Delay curves: weighted modes and medians, anchors, stabilising, residuals, segments."""
from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .ordered import carry, carry_all, neighbours, running_sum
from .quantiles import exact_quantiles
from .trajectory import KEYS

# Curve profile.
MIN_CC, JUMP_LIMIT, MAX_SHIFT = 0.08, 30.0, 4800.0
OUTLIER, MAX_RESIDUAL, MIN_WEIGHT = 30.0, 100.0, 1e-6
SLOPES_AT_ONCE = 2_000_000
MODE_REACH, MODE_GAP = 2, 4
CLAMP_CHUNK = 4096
SLOPE_BLOCK = 1024        # points of a key in one block
DRAWN, DRAWN_MARGIN = 100_000, 0.02  # slopes taken of a key in a round, and how far around the median the next one looks


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """First value whose running weight reaches half; plain median if all weigh zero."""
    hist = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.sum(weight).alias("_w"))
    cum = running_sum(hist, keys, "_v", F.col("_w"), "_cum", size=16)
    total = hist.groupBy(*keys).agg(F.sum("_w").alias("_total"))
    half = F.round("_cum", 9) >= F.round(F.col("_total") / 2, 9)
    out = cum.join(total, keys).where((F.col("_total") > 0) & half).groupBy(*keys).agg(F.min("_v").alias("median"))
    plain = exact_quantiles(rows, keys, value, {"_plain": 0.5})
    return plain.join(out, keys, "left").select(*keys, F.coalesce("median", "_plain").alias("median"))


def bounded_weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """:func:`weighted_median` and the row count ``n`` of groups of a fixed largest size, each taken whole."""
    items = F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))))
    whole = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(items.alias("_p"), F.sum(weight).alias("_total"), F.count(F.lit(1)).alias("n"))

    def step(acc: Column, item: Column) -> Column:
        upto = acc["upto"] + item["w"]
        reached = F.when(F.round(upto, 9) >= F.round(F.col("_total") / 2, 9), item["v"])
        return F.struct(upto.alias("upto"), F.coalesce(acc["found"], reached).alias("found"))

    start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("found"))
    low, high = F.col("_p")[F.floor((F.col("n") - 1) / 2).cast("int")]["v"], F.col("_p")[F.floor(F.col("n") / 2).cast("int")]["v"]
    heavy = F.when(F.col("_total") > 0, F.aggregate("_p", start, step, lambda acc: acc["found"]))
    return whole.select(*keys, F.coalesce(heavy, low + (high - low) * 0.5).alias("median"), "n")


def dense_index(rows: DataFrame, keys: list[str], pos: str, *, size: int) -> DataFrame:
    """0-based order of rows within a key, as ``idx``, and the row count ``n``."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = running_sum(rows, keys, pos, F.lit(1), "_i", size=size)
    return at.withColumn("idx", F.col("_i") - 1).drop("_i").join(counts, keys)


def anchors(windows: DataFrame, *, rate: int, bin_sec: int = 120, min_cc: float = MIN_CC) -> DataFrame:
    """Weighted-median delay per time bin of the window start.

    A pair with fewer than two confident windows falls back to its coarse ones.
    """
    base = windows.where(F.col("valid") & F.col("delay_samples").isNotNull())
    sure = F.abs("confidence") >= min_cc
    loose = F.coalesce(F.abs("coarse_cc"), F.abs("confidence")) >= min_cc
    counts = base.groupBy(*KEYS).agg(F.count_if(sure).alias("_sure"))
    kept = base.join(counts, KEYS).where(F.when(F.col("_sure") >= 2, sure).otherwise(loose))
    binned = kept.select(*KEYS, F.floor(F.col("start_sample") / F.lit(rate * bin_sec)).alias("bin"), "delay_samples",
                         F.greatest("confidence", F.lit(MIN_WEIGHT)).alias("w"))
    # the windows of one time bin are few, however long the take
    return bounded_weighted_median(binned, [*KEYS, "bin"], "delay_samples", "w").select(
        *KEYS, "bin", (F.col("bin") * bin_sec).alias("t_sec"), F.col("median").alias("y"), F.col("n").alias("n_windows"))


def rolling_median(points: DataFrame, keys: list[str], reach: int = 3) -> DataFrame:
    """Median of ``2 * reach + 1`` neighbours by ``idx``, edges repeated.

    Keys with fewer points than that stay as they are.
    """
    wide, window, keep = neighbours(points, keys, "idx", reach)
    cells, left, right = [F.col("y")], F.col("y"), F.col("y")
    for k in range(1, reach + 1):
        left = F.coalesce(F.lag("y", k).over(window), left)
        right = F.coalesce(F.lead("y", k).over(window), right)
        cells += [left, right]
    median = F.array_sort(F.array(*cells))[reach]
    return wide.withColumn("_m", F.when(F.col("n") >= 2 * reach + 1, median).otherwise(F.col("y"))).where(keep).select(
        *keys, "idx", "n", *[c for c in points.columns if c not in (*keys, "idx", "n", "y")], F.col("_m").alias("y"))


def _slopes(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """The slopes of all pairs of points, a bounded number at a time."""
    rows = max(1, SLOPES_AT_ONCE // (4 * max(1, len(x))))
    for a in range(0, len(x), rows):
        dx, dy = x[None, a:] - x[a:a + rows, None], y[None, a:] - y[a:a + rows, None]
        later = np.triu(np.abs(dx) > 1e-12, 1)
        yield dy[later] / dx[later]


def _slopes_between(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[np.ndarray]:
    """The slopes from the points (x, y) to the points (u, v), a bounded number at a time."""
    rows = max(1, SLOPES_AT_ONCE // (4 * max(1, len(u))))
    for a in range(0, len(x), rows):
        dx, dy = u[None, :] - x[a:a + rows, None], v[None, :] - y[a:a + rows, None]
        apart = np.abs(dx) > 1e-12
        yield dy[apart] / dx[apart]


def median_slope(x: np.ndarray, y: np.ndarray) -> float:
    """The exact median of all pairwise slopes, 0 without any.

    The slopes are never held together: a slice of them bounds the median,
    counting all of them proves the bounds, and what lies between is narrowed
    again until it can be ordered.
    """
    total = sum(map(len, _slopes(x, y)))
    if not total:
        return 0.0
    ranks, low, high, margin = ((total - 1) // 2, total // 2), -np.inf, np.inf, 0.01
    below, inside = 0, total
    while inside > SLOPES_AT_ONCE:
        step = inside // SLOPES_AT_ONCE + 1
        some = np.sort(np.concatenate([s[(s >= low) & (s <= high)][::step] for s in _slopes(x, y)]))
        at = (ranks[0] - below) / inside * (len(some) - 1)
        lo = some[max(0, int(at - margin * len(some)))]
        hi = some[min(len(some) - 1, int(at + margin * len(some)) + 1)]
        under = sum(int((s < lo).sum()) for s in _slopes(x, y))
        upto = sum(int((s <= hi).sum()) for s in _slopes(x, y))
        if under <= ranks[0] and ranks[1] < upto:
            if lo == hi:
                return float(lo)
            if upto - under == inside:  # many ties at the bounds: settle or drop them
                to_lo = sum(int((s <= lo).sum()) for s in _slopes(x, y))
                to_hi = sum(int((s < hi).sum()) for s in _slopes(x, y))
                if ranks[0] < to_lo:
                    second = lo if ranks[1] < to_lo else min(s[s > lo].min(initial=np.inf) for s in _slopes(x, y))
                    return float(lo + (second - lo) * 0.5)
                if ranks[1] >= to_hi:
                    first = hi if ranks[0] >= to_hi else max(s[s < hi].max(initial=-np.inf) for s in _slopes(x, y))
                    return float(first + (hi - first) * 0.5)
                low, high, below, inside = np.nextafter(lo, np.inf), np.nextafter(hi, -np.inf), to_lo, to_hi - to_lo
            else:
                low, high, below, inside = lo, hi, under, upto - under
        else:
            margin *= 2
    rest = np.sort(np.concatenate([s[(s >= low) & (s <= high)] for s in _slopes(x, y)]))
    first, second = (float(rest[r - below]) for r in ranks)
    return first + (second - first) * 0.5


def _count_pairs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """What each pair of blocks says of the slopes around ``low`` and ``high``, and a drawn part of those between."""
    for batch in batches:
        rows = batch.to_pylist()
        out = []
        for r in rows:
            x, y, u, v = (np.array(r[c], dtype=np.float64) for c in ("x", "y", "u", "v"))
            parts = _slopes(x, y) if r["a"] == r["b"] else _slopes_between(x, y, u, v)
            rng = np.random.default_rng([r["round"], r["a"], r["b"]])
            under = low = high = inner = 0
            drawn = []
            for slopes in parts:
                under += int((slopes < r["low"]).sum())
                low += int((slopes == r["low"]).sum())
                high += int((slopes == r["high"]).sum())
                between = slopes[(slopes > r["low"]) & (slopes < r["high"])]
                inner += len(between)
                drawn.append(between if r["step"] == 1 else between[rng.random(len(between)) * r["step"] < 1])
            out.append({**{k: r[k] for k in keys}, "under": under, "n_low": low, "n_high": high, "inner": inner,
                        "drawn": np.concatenate(drawn).tolist() if drawn else []})
        names = [*keys, "under", "n_low", "n_high", "inner", "drawn"]
        types = [*[batch.schema.field(k).type for k in keys], *[pa.int64()] * 4, pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], t) for n, t in zip(names, types)], names)


def _settle(low: float, high: float, step: int, under: int, n_low: int, n_high: int, inner: int, drawn: np.ndarray | None,
            margin: float, sample: list[float], shift: int, size: int, rest: int) -> dict:
    """Whether the counts of a round settle the median, and where the next round looks if not."""
    drawn = np.sort(np.array([] if drawn is None else drawn, dtype=np.float64))
    total = rest if rest >= 0 else inner
    if low == high:
        n_high = 0
    if total == 0:
        return {"slope": 0.0}
    ranks = (total - 1) // 2, total // 2

    def at(rank: int) -> float | None:
        if rank < under + n_low:
            return low
        if rank >= under + n_low + inner:
            return high
        return float(drawn[rank - under - n_low]) if step == 1 else None

    if under <= ranks[0] and ranks[1] < under + n_low + inner + n_high:
        first, second = map(at, ranks)
        if first is not None and second is not None:
            return {"slope": first + (second - first) * 0.5}
        sample, shift, size, margin, reach = drawn, under + n_low, inner, DRAWN_MARGIN, inner
        floor, ceiling = low, high
    else:  # the enclosing values missed it: further out in the same draw
        margin, reach, floor, ceiling = 4 * margin, total, -np.inf, np.inf
        sample = np.array(sample, dtype=np.float64)
    place = (ranks[0] - shift) / max(size, 1) * len(sample)
    lo, hi = int(place - margin * len(sample)) - 1, int(place + margin * len(sample)) + 2
    low, high = (float(sample[lo]) if 0 <= lo < len(sample) else floor), (float(sample[hi]) if 0 <= hi < len(sample) else ceiling)
    return {"slope": None, "low": low, "high": high, "margin": margin, "sample": sample.tolist(), "shift": shift, "size": size,
            "rest": total, "step": max(1, math.ceil(min(1.0, 2 * margin) * reach / DRAWN))}


def _decide_slopes(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    arguments = ["low", "high", "step", "under", "n_low", "n_high", "inner", "drawn", "margin", "sample", "shift", "size", "rest"]
    state = [("slope", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("margin", pa.float64()),
             ("sample", pa.list_(pa.float64())), ("shift", pa.int64()), ("size", pa.int64()), ("rest", pa.int64()), ("step", pa.int64())]
    for batch in batches:
        found = [_settle(*[r[c] for c in arguments]) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in keys], *[pa.array([f.get(n) for f in found], t) for n, t in state]],
            [*keys, *[n for n, _ in state]])


def theil_sen(points: DataFrame, keys: list[str], *, block: int = SLOPE_BLOCK) -> DataFrame:
    """Median of pairwise slopes over (``x``, ``y``), exact for any number of points; 0 without any pair.

    A key's points are dealt to blocks, and every pair of blocks is one row of
    work: no task holds a key's points, and only counts and a drawn part of the
    slopes leave it. Where a key has more than ``DRAWN`` slopes, a draw encloses the
    median, all slopes are counted against the enclosing values, and what lies
    between is drawn again until it can be taken whole. One round settles shorter keys.
    """
    kinds = dict(points.dtypes)
    names = ", ".join(f"{k} {kinds[k]}" for k in keys)
    rows = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
    dealt = rows.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), "blocks"))
    held = cut_lineage(dealt.groupBy(*keys, "blocks", "block").agg(F.collect_list(F.struct("x", "y")).alias("p"))
                       .select(*keys, "blocks", "block", "p.x", "p.y"))
    left = held.select(*keys, F.col("block").alias("a"), "x", "y", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("b"))
    pairs = left.join(held.select(*keys, F.col("block").alias("b"), F.col("x").alias("u"), F.col("y").alias("v")), [*keys, "b"])
    n = F.sum(F.size("x"))
    infinite = F.lit(float("inf"))
    state = held.groupBy(*keys).agg(F.ceil(n * (n - 1) / 2 / DRAWN).cast("long").alias("step")).select(
        *keys, (-infinite).alias("low"), infinite.alias("high"), F.greatest("step", F.lit(1)).alias("step"),
        F.lit(DRAWN_MARGIN).alias("margin"), F.array().cast("array<double>").alias("sample"), F.lit(0).cast("long").alias("shift"),
        F.lit(0).cast("long").alias("size"), F.lit(-1).cast("long").alias("rest"))
    done, number = None, 0
    while True:  # each round leaves a few percent of the slopes of the keys that are still open
        work = pairs.join(state.select(*keys, "low", "high", "step"), keys).withColumn("round", F.lit(number)).repartition(*keys, "a", "b")
        counts = work.mapInArrow(functools.partial(_count_pairs, keys=keys), names + ", under long, n_low long, n_high long, inner long, drawn array<double>")
        summed = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("under", "n_low", "n_high", "inner")],
                                           F.flatten(F.collect_list("drawn")).alias("drawn"))
        found = cut_lineage(summed.join(state, keys).mapInArrow(
            functools.partial(_decide_slopes, keys=keys),
            names + ", slope double, low double, high double, margin double, sample array<double>, shift long, size long, rest long, step long"))
        settled = found.where("slope IS NOT NULL").select(*keys, "slope")
        done = settled if done is None else done.unionByName(settled)
        state, number = found.where("slope IS NULL").drop("slope"), number + 1
        if state.isEmpty():
            return done


def clamp_jumps(points: DataFrame, keys: list[str], limit: float = JUMP_LIMIT, *, adaptive: bool = True,
                chunk: int = CLAMP_CHUNK) -> DataFrame:
    """Each point moved to within a limit of the one before it, in ``idx`` order.

    The recurrence is sequential: a key's points (one per time bin) pass sorted
    through one task, which holds ``chunk`` of them and the last value.
    """
    if adaptive:
        slope = theil_sen(points.withColumn("x", F.col("idx").cast("double")), keys)
        wide = points.join(slope, keys)
        steep = (F.col("n") >= 3) & (F.abs("slope") > limit)
        wide = wide.withColumn("limit", F.when(steep, F.ceil(F.abs("slope") * 1.5)).otherwise(F.lit(limit)).cast("double"))
    else:
        wide = points.withColumn("limit", F.lit(limit))
    columns = [*keys, "idx", *[c for c in points.columns if c not in (*keys, "idx", "y")], "y"]
    rows = wide.select(*columns, "limit").repartition(*keys).sortWithinPartitions(*keys, "idx")
    return rows.mapInArrow(functools.partial(_clamp, keys=keys, chunk=chunk), wide.select(*columns).schema)


def _clamp(batches: Iterator[pa.RecordBatch], keys: list[str], chunk: int) -> Iterator[pa.RecordBatch]:
    """One pass over sorted rows; the last value of a key goes on from chunk to chunk."""
    key, prev = None, 0.0
    for batch in (b.slice(a, chunk) for b in batches for a in range(0, b.num_rows, chunk)):
        ys = []
        for y, limit, *here in zip(*[batch.column(c).to_pylist() for c in ("y", "limit", *keys)]):
            if here != key:
                key, prev = here, y
            if y is not None and prev is not None:
                y = min(max(y, prev - limit), prev + limit)
            prev = y if y is not None else prev
            ys.append(y)
        names = [c for c in batch.schema.names if c not in ("y", "limit")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(ys, pa.float64())], [*names, "y"])


def drop_outliers(points: DataFrame, keys: list[str], reach: int = 2, limit: float = OUTLIER,
                  keep_min: int = 5) -> DataFrame:
    """Points far from the median of their neighbours go, unless too few would remain."""
    wide, window, keep = neighbours(points, keys, "idx", reach)
    near = F.array_sort(F.collect_list("y").over(window.rowsBetween(-reach, reach)))
    size = F.size("_near")
    median = (F.col("_near")[F.floor((size - 1) / 2).cast("int")] + F.col("_near")[F.floor(size / 2).cast("int")]) / 2
    marked = wide.withColumn("_near", near).withColumn("_ok", F.abs(F.col("y") - median) <= limit).where(keep)
    counts = marked.groupBy(*keys).agg(F.count_if("_ok").alias("_left"))
    return marked.join(counts, keys).where(F.col("_ok") | (F.col("_left") < keep_min)).select(*points.columns)


def smooth_residual(points: DataFrame, keys: list[str], *, duration: float, span: float = 300.0, hop: float = 60.0,
                    min_points: int = 3) -> DataFrame:
    """Median of the points within ``span`` of each centre, one centre per ``hop``.

    Every point names the few centres it reaches, so this is one grouping, not
    a range join. Keys with fewer than two centres keep their own points.
    """
    last = math.ceil(duration / hop) - 1
    t = F.col("t_sec")
    low = F.greatest(F.lit(0), F.ceil((t - 1.5 * span) / hop)).cast("bigint")
    high = F.least(F.lit(last), F.floor((t + 0.5 * span) / hop)).cast("bigint")
    reached = points.where(low <= high).select(*keys, "y", F.explode(F.sequence(low, high)).alias("m"))
    med = exact_quantiles(reached, [*keys, "m"], "y", {"y": 0.5}, count="_k", bounded=True).where(
        F.col("_k") >= min_points)
    # one row per centre, so counting a key's centres is a small window
    smooth = med.select(*keys, (F.col("m") * hop + span / 2).alias("t_sec"), "y",
                        F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("_c")).where("_c >= 2").drop("_c")
    sparse = points.join(smooth.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.col("t_sec").cast("double").alias("t_sec"), "y")
    return smooth.unionByName(sparse)


def on_grid(points: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Points interpolated at seconds 0..seconds-1, edges held.

    Each point fills the stretch up to the next one, so only the few points are
    ordered and the grid rows are made in place, without a shuffle.
    """
    rows = points.select(*keys, F.col("t_sec").cast("double").alias("t"), "y")
    here = F.struct("t", "y")
    linked = carry(rows, keys, "t", here, "_n", forward=False, strict=True)
    linked = carry(linked, keys, "t", F.col("t"), "_p", strict=True)
    low = F.when(F.col("_p").isNull(), 0).otherwise(F.greatest(F.ceil("t"), F.lit(0)))
    high = F.when(F.col("_n").isNull(), seconds - 1).otherwise(F.least(F.ceil("_n.t") - 1, F.lit(seconds - 1)))
    filled = linked.where(low <= high).withColumn("g", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    share = (F.col("g") - F.col("t")) / (F.col("_n.t") - F.col("t"))
    between = F.col("y") + (F.col("_n.y") - F.col("y")) * share
    inside = F.col("_n").isNotNull() & (F.col("g") > F.col("t"))
    return filled.select(*keys, F.col("g").cast("double").alias("t_sec"), F.when(inside, between).otherwise(F.col("y")).alias("y"))


def residual_curve(points: DataFrame, keys: list[str], *, seconds: int, span: float, hop: float) -> DataFrame:
    smooth = cut_lineage(smooth_residual(points, keys, duration=seconds, span=span, hop=hop))
    clipped = F.least(F.greatest(F.col("y"), F.lit(-MAX_RESIDUAL)), F.lit(MAX_RESIDUAL))
    return on_grid(smooth, keys, seconds).withColumn("y", clipped)


def anchor_points(windows: DataFrame, *, rate: int, bin_sec: int = 120) -> DataFrame:
    """Anchors numbered in time order, written out once: every later step rereads them."""
    binned = cut_lineage(anchors(windows, rate=rate, bin_sec=bin_sec))
    return cut_lineage(dense_index(binned, KEYS, "bin", size=65536))


def build_curve(windows: DataFrame, *, rate: int, seconds: int, bin_sec: int = 120) -> DataFrame:
    """Windows to a one-second curve: anchors, rolling median, clamp, interpolation.

    Pairs whose curve leaves the allowed range are dropped whole; one anchor
    gives a constant curve.
    """
    points = anchor_points(windows, rate=rate, bin_sec=bin_sec)
    smooth = rolling_median(points.select(*KEYS, "idx", "n", "t_sec", "y"), KEYS)
    stable = cut_lineage(clamp_jumps(smooth, KEYS))
    curve = on_grid(stable, KEYS, seconds)
    wild = stable.groupBy(*KEYS).agg(F.max(F.abs("y")).alias("m")).where(F.col("m") > MAX_SHIFT)
    return curve.join(wild, KEYS, "left_anti")


def _between(before: Column, after: Column, g: Column) -> Column:
    """A curve at second ``g`` between two of its points, edges held."""
    share = (g - before["t"]) / (after["t"] - before["t"])
    inside = after.isNotNull() & (g > before["t"])
    line = F.when(inside, before["y"] + (after["y"] - before["y"]) * share).otherwise(before["y"])
    return F.when(before.isNull(), after["y"]).otherwise(line)


def add_curves(base: DataFrame, residual: DataFrame, keys: list[str], seconds: int, *, gain: float = 1.0) -> DataFrame:
    """Sum of two curves at seconds 0..seconds-1, ``gain`` times the first; keys beyond the shift limit are refused.

    Both curves are given by their points. Between two neighbouring points of either, both
    run straight: such stretches are ordered and joined, and their seconds are unfolded
    last. Grids joined by second would be planned as if they were as few rows as the points.
    """
    here = F.struct(F.col("t_sec").cast("double").alias("t"), "y")
    points = base.select(*keys, here.alias("_a"), F.lit(0).alias("_side")).unionByName(
        residual.select(*keys, here.alias("_b"), F.lit(1).alias("_side")), allowMissingColumns=True)
    at = points.withColumn("t", F.coalesce("_a.t", "_b.t"))
    # side by side, the last of equal times starts the stretch, as the others end where they start
    linked = carry_all(at, keys, "t", {
        "_p": (F.col("t"), True, True), "_a0": (F.col("_a"), True, False), "_a1": (F.col("_a"), False, True),
        "_b0": (F.col("_b"), True, False), "_b1": (F.col("_b"), False, True)}, ties=["_side"])
    after = F.least("_a1.t", "_b1.t")
    low = F.when(F.col("_p").isNull(), 0).otherwise(F.greatest(F.ceil("t"), F.lit(0)))
    high = F.when(after.isNull(), seconds - 1).otherwise(F.least(F.ceil(after) - 1, F.lit(seconds - 1)))
    stretches = cut_lineage(linked.where((low <= high) & F.coalesce("_a0", "_a1").isNotNull()).select(
        *keys, low.cast("bigint").alias("_low"), high.cast("bigint").alias("_high"), "_a0", "_a1", "_b0", "_b1"))

    def unfolded(rows: DataFrame) -> DataFrame:
        g, a0, a1, b0, b1 = map(F.col, ("_g", "_a0", "_a1", "_b0", "_b1"))
        y = _between(a0, a1, g) * gain + F.coalesce(_between(b0, b1, g), F.lit(0.0))
        return rows.withColumn("_g", F.explode(F.sequence("_low", "_high"))).select(*keys, g.cast("double").alias("t_sec"), y.alias("y"))

    wild = unfolded(stretches).groupBy(*keys).agg(F.max(F.abs("y")).alias("m")).where(F.col("m") > MAX_SHIFT)
    return unfolded(stretches.join(wild, keys, "left_anti"))


def _smoothed(rows: DataFrame, keys: list[str]) -> DataFrame:
    # whole-sample delays lie in the search range, so a key's histogram is bounded
    hist = rows.where(F.col("delay").isNotNull()).groupBy(*keys, "delay").agg(
        F.count(F.lit(1)).alias("c"), F.sum("quality").alias("w"))
    near = W.partitionBy(*keys).orderBy("delay").rangeBetween(-MODE_REACH, MODE_REACH)
    return hist.withColumn("support", F.sum("c").over(near)).withColumn("near_w", F.sum("w").over(near))


def dominant_mode(rows: DataFrame, keys: list[str], min_rows: int = 3) -> DataFrame:
    """Whole-sample delay with most support within two samples, and its inliers' median."""
    hist = _smoothed(rows, keys)
    top = hist.groupBy(*keys).agg(
        F.max_by("delay", F.struct("support", (-F.col("delay")).alias("x"))).alias("center"), F.max("support").alias("support"),
        F.sum("c").alias("n")).where(F.col("n") >= min_rows)
    inliers = rows.join(top, keys).where(F.abs(F.col("delay") - F.col("center")) <= MODE_REACH)
    med = weighted_median(inliers, keys, "delay", "quality")
    spread = inliers.groupBy(*keys).agg((F.max("delay") - F.min("delay")).alias("inlier_spread"))
    return top.join(med, keys).join(spread, keys).select(
        *keys, F.col("median").cast("bigint").alias("delay"), "support", "n", (F.col("support") / F.col("n")).alias("support_frac"), "inlier_spread")


def separated_modes(rows: DataFrame, keys: list[str], k: int = 3, min_gap: int = MODE_GAP) -> DataFrame:
    """The k heaviest delays at least ``min_gap`` apart, with the weight around each."""
    item = F.struct((-F.round("w", 9)).alias("order"), "delay", "near_w")
    ranked = _smoothed(rows, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("h"))
    empty = F.array().cast("array<struct<delay:bigint,weight:double>>")
    fits = lambda acc, x: (F.size(acc) < k) & ~F.exists(acc, lambda a: F.abs(a["delay"] - x["delay"]) < min_gap)
    step = lambda acc, x: F.when(fits(acc, x), F.array_append(acc, F.struct(
        x["delay"].cast("bigint").alias("delay"), F.round(x["near_w"], 2).alias("weight")))).otherwise(acc)
    return ranked.select(*keys, F.posexplode(F.aggregate("h", empty, step)).alias("place", "m")).select(
        *keys, F.col("place").cast("bigint").alias("place"), "m.*")


def piecewise_segments(frames: DataFrame, *, min_seg: int, threshold: float, min_rows: int = 8) -> DataFrame:
    """Piecewise-constant fit by halving, all trajectories and segments per level at once.

    Cut points depend on row order only, so each level is one grouping that
    decides every open segment; no trajectory is gathered.
    """
    good = frames.where(F.col("delay_samples").isNotNull())
    rows = _indexed(good)
    rows = cut_lineage(rows.where(F.col("n") >= min_rows).withColumn("a", F.lit(0).cast("bigint")).withColumn("b", F.col("n")))
    longest = rows.agg(F.max("n").alias("n")).first()["n"] or 0
    seg = [*KEYS, "a", "b"]
    for level in range(max(0, math.ceil(math.log2(max(longest, 1) / min_rows)) + 1)):
        mid = F.floor((F.col("a") + F.col("b")) / 2)
        halves = rows.withColumn("mid", mid).withColumn("right", F.col("idx") >= mid)
        open_ = halves.where(F.col("b") - F.col("a") >= min_rows)
        med = exact_quantiles(open_, [*seg, "right"], "delay_samples", {"m": 0.5})
        at = lambda i: F.max(F.when(F.col("idx") == i, F.col("center_sample")))
        edges = open_.groupBy(*seg, "mid").agg(at(F.col("a")).alias("c0"), at(F.col("mid")).alias("c1"), at(F.col("b") - 1).alias("c2"))
        sides = med.groupBy(*seg).agg(F.max(F.when(~F.col("right"), F.col("m"))).alias("ml"), F.max(F.when(F.col("right"), F.col("m"))).alias("mr"))
        cut = edges.join(sides, seg).where(
            (F.col("c1") - F.col("c0") >= min_seg) & (F.col("c2") - F.col("c1") >= min_seg)
            & (F.abs(F.col("ml") - F.col("mr")) > threshold)).select(*seg, F.col("mid").alias("cut"))
        moved = rows.join(cut, seg, "left")
        right = F.col("idx") >= F.col("cut")
        rows = moved.select(*KEYS, "center_sample", "delay_samples", "idx", "n",
                            F.when(right, F.col("cut")).otherwise(F.col("a")).alias("a"),
                            F.when(F.col("cut").isNotNull() & ~right, F.col("cut")).otherwise(F.col("b")).alias("b"))
        if level % 2:
            rows = cut_lineage(rows)
    med = exact_quantiles(rows, seg, "delay_samples", {"m": 0.5})
    resid = rows.join(med, seg).select(*KEYS, F.abs(F.col("delay_samples") - F.col("m")).alias("r"))
    spread = exact_quantiles(resid, KEYS, "r", {"residual_p50": 0.5, "residual_p90": 0.9})
    # a segment's left neighbour ends where it starts
    left = med.select(*KEYS, F.col("b").alias("a"), F.col("m").alias("_prev"))
    seams = med.join(left, [*KEYS, "a"], "left").withColumn("seam", F.abs(F.col("m") - F.col("_prev")))
    counts = seams.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("seam") > 1).alias("seam_gt_1"),
                                      F.count_if(F.col("seam") > 48).alias("seam_gt_48"))
    return counts.join(spread, KEYS)


def _indexed(good: DataFrame) -> DataFrame:
    rows = good.select(*KEYS, "center_sample", "frame_no", "delay_samples")
    at = running_sum(rows, KEYS, "center_sample", F.lit(1), "_i", size=1 << 22, ties=["frame_no"])
    counts = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return at.withColumn("idx", F.col("_i") - 1).drop("_i", "frame_no").join(counts, KEYS)
