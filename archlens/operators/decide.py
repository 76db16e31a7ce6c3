"""Decisions over tracks: materiality, tolerance, eligibility, grouping, binding, offsets."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .quantiles import exact_quantiles, upper_median

# Status per reason and decision, eligibility reasons, binding gates.
STATUS_OF_REASON = {
    "low_confidence": "low_confidence", "insufficient_frames": "low_confidence", "non_constant": "non_constant",
    "out_of_range": "out_of_range", "recheck_residual": "recheck_failed", "already_aligned": "already_aligned",
    "evidence_insufficient": "low_confidence"}
STATUS_OF_DECISION = {"fixed": "success", "already_aligned": "already_aligned", "anchor": "already_aligned", "untouched": "failed"}
STATUSES = ["not_processed", "not_applicable", "already_aligned", "success", "low_confidence", "non_constant",
            "out_of_range", "recheck_failed", "failed"]
OFFSET_LIMIT = float(1 << 31)
BINDING = {"candidate_snr": 1.5, "min_abs_cc": 0.90, "lag_span": 5.0, "same_sign": 0.95}
ACCURATE_TIERS = (1, 2)
SOLVED = 1024  # files whose offsets a task solves together


def _map(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def materiality(delay_samples: Column, displacement_ms: Column, rate: float, k: float) -> dict[str, Column]:
    """Worth correcting: the delay is at least ``k`` times the measured displacement."""
    delay_ms = F.abs(delay_samples) * 1000 / rate
    disp = F.abs(displacement_ms)
    ok = F.lit(k > 0) & F.coalesce(delay_ms >= k * disp, F.lit(False))
    ratio = F.when(disp > 0, F.try_divide(delay_ms, disp)).otherwise(F.lit(float("inf")))
    return {"material": ok, "ratio": F.when(ok, ratio)}


def agreement(windows: DataFrame, tracks: DataFrame, *, absolute: float, relative: float, sigma: float, rate: float) -> DataFrame:
    """Second estimate against the applied shift, with the widest of three tolerances.

    ``windows`` (track_id, window_no, value_ms) holds the re-measured windows of
    each track; their upper median is the second estimate. A difference at the
    tolerance is accepted, and of equal tolerances the one named first, in the order
    absolute, relative, sigma, is the basis: all are compared to nine places, beyond
    which the order of summing decides.
    """
    known = windows.where(F.col("value_ms").isNotNull())
    middle = upper_median(known, ["track_id"], "value_ms", "_mid")
    per = known.groupBy("track_id").agg(F.stddev_samp("value_ms").alias("spread_ms")).join(middle, "track_id")
    joined = tracks.join(per, "track_id", "left").withColumn("independent", F.col("_mid") * rate / 1000)
    rel = F.lit(relative) * F.abs("delay_samples")
    sig = F.coalesce(F.lit(sigma) * F.col("spread_ms") * rate / 1000, F.lit(0.0))
    rel, sig = F.round(rel, 9), F.round(sig, 9)
    tol = F.greatest(F.lit(float(absolute)), rel, sig)
    first = F.greatest(F.lit(float(absolute)), rel)
    diff = F.abs(F.col("independent") - F.col("shift_samples"))
    return joined.select(
        "track_id", "independent", "spread_ms", tol.alias("tolerance"),
        F.when(sig > first, "sigma").when(rel > absolute, "relative").otherwise("absolute").alias("basis"),
        diff.alias("diff"), F.coalesce(F.round(diff, 9) <= tol, F.lit(True)).alias("accepted"))


def eligibility(results: DataFrame, gate: dict[str, float]) -> DataFrame:
    """Whether a result may enter correction; an ineligible one carries no offset."""
    status, off = F.col("status"), F.col("offset_samples")
    coverage = F.coalesce("coverage", F.try_divide(F.col("usable_frames").cast("double"), F.col("total_frames")))
    weak = coverage.isNotNull() & (
        F.coalesce(F.col("usable_frames") < gate["min_usable_frames"], F.lit(False))
        | F.coalesce(F.col("confidence") < gate["min_confidence"], F.lit(False))
        | (coverage < gate["min_usable_fraction"]))
    reason = (
        F.when(status.isNull() | ~status.isin(*STATUSES), "sync_status_unknown")
        .when(status != "success", F.concat(F.lit("sync_"), status))
        .when(off.isNull(), "sync_offset_missing")
        .when(F.isnan(off) | (F.abs(off) >= OFFSET_LIMIT), "sync_offset_invalid")
        .when(weak, "sync_evidence_insufficient")
        .when(F.coalesce(F.col("application") == "none", F.lit(False)), "sync_application_none"))
    rest = [c for c in results.columns if c != "offset_samples"]
    return results.withColumn("eligible", reason.isNull()).withColumn("denied", reason).select(
        *rest, "eligible", "denied", F.when(F.col("eligible"), F.rint("offset_samples")).cast("bigint").alias("offset_samples"))


def model_status(rows: DataFrame, gate: dict[str, float]) -> DataFrame:
    """Status of each report row; a success whose stated evidence fails is low confidence."""
    base = F.coalesce(_map(STATUS_OF_REASON, F.col("reason")), _map(STATUS_OF_DECISION, F.col("decision")), F.lit("not_processed"))
    stated = F.col("coverage").isNotNull() & F.col("usable_frames").isNotNull() & F.col("confidence").isNotNull()
    fails = stated & ((F.col("usable_frames") < gate["min_usable_frames"]) | (F.col("confidence") < gate["min_confidence"])
                      | (F.col("coverage") < gate["min_usable_fraction"]))
    status = F.when((base == "success") & fails, "low_confidence").otherwise(base)
    return rows.withColumn("status", status)


def attach_status(tracks: DataFrame, rows: DataFrame, gate: dict[str, float]) -> DataFrame:
    """Tracks with the report row at their audio position; no row is not_processed."""
    stated = model_status(rows, gate).select("file_id", "audio_position", "status", "reason", "decision")
    return tracks.join(stated, ["file_id", "audio_position"], "left").withColumn(
        "status", F.coalesce("status", F.lit("not_processed"))).withColumn("reason", F.coalesce("reason", "decision")).drop("decision")


def compose_reference(decisions: DataFrame, estimates: DataFrame) -> DataFrame:
    """shift(t) = shift(ref) + delay(t vs ref), for untouched tracks and settled references."""
    ref = decisions.where(F.col("decision").isin("fixed", "already_aligned", "anchor")).select(
        "file_id", F.col("track_id").alias("ref_id"), F.coalesce(F.col("shift_samples"), F.when(F.col("decision") != "fixed", 0.0)).alias("ref_shift"))
    open_tracks = decisions.where("decision = 'untouched'").select("file_id", "track_id")
    joined = estimates.join(open_tracks, ["file_id", "track_id"]).join(ref, ["file_id", "ref_id"])
    whole = F.col("ref_shift") == F.floor("ref_shift")
    return joined.where(F.col("delay_samples").isNotNull() & whole).select(
        "file_id", "track_id", "ref_id", (F.col("ref_shift") + F.col("delay_samples")).alias("composed_samples"))


def connected_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component of each node: the smallest label reachable over the edges, whose ends are nodes too.

    Links contract: each round every linked node hooks on the neighbour (or itself)
    that is first in a hashed order, links move to the hooks, and those inside one hook
    vanish. That order leaves a constant share of the nodes on any shape, so the rounds grow with the
    logarithm and all of them together read a few times the links of the first. Hooks
    of later rounds are looked up by those of earlier ones, from the last round back.
    Nodes without a link meet the labels in the last step alone. Every round is written to
    the shared folder, so a lost executor costs one round; a row count alone comes to the driver.
    """
    order = F.xxhash64
    links = lambda rows, a, b: rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left = cut_lineage(links(edges.where("a <> b"), "a", "b"))
    rounds = []
    while True:
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
        near = left.select(ends.alias("e")).select("e.*").groupBy("a").agg(F.min_by("b", order("b")).alias("b"))
        hooks = cut_lineage(near.select(F.col("a").alias("node"), F.when(order("b") < order("a"), F.col("b")).otherwise(F.col("a")).alias("hook")))
        rounds.append(hooks)
        at = lambda end: hooks.select(F.col("node").alias(end), F.col("hook").alias(f"_{end}"))
        left = cut_lineage(links(left.join(at("a"), "a").join(at("b"), "b").where("_a <> _b"), "_a", "_b"))
        if left.isEmpty():
            break
    roots = rounds.pop()
    while rounds:
        further = roots.select(F.col("node").alias("hook"), F.col("hook").alias("_root"))
        roots = cut_lineage(rounds.pop().join(further, "hook", "left").select("node", F.coalesce("_root", "hook").alias("hook")))
    first = roots.groupBy("hook").agg(F.min("node").alias("label"))
    labels = nodes.select("node", F.lit(None).cast(nodes.schema["node"].dataType).alias("label")).unionByName(
        roots.join(first, "hook").select("node", "label"))
    return labels.groupBy("node").agg(F.min("label").alias("label")).select("node", F.coalesce("label", "node").alias("label"))


def pair_edges(pairs: DataFrame, threshold: float, min_samples: int) -> DataFrame:
    """Edges between tracks whose strength was measured well enough; null is no edge."""
    return pairs.where((F.col("median") >= threshold) & (F.col("samples") >= min_samples)).select("a", "b")


def group_anchors(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """First member in candidate order, ties by index; members that are no candidate come last."""
    joined = members.join(candidates, "member", "left")
    last = F.coalesce("place", F.lit(1 << 30).cast("bigint"))
    return joined.groupBy("label").agg(F.min_by("member", F.struct(last, "member")).alias("anchor"), F.count(F.lit(1)).alias("n_members"))


def file_groups(nodes: DataFrame, edges: DataFrame, width: int = 8) -> DataFrame:
    """Connected tracks of every file, in one aggregation: (file_id, groups).

    ``nodes``: file_id, track and, if wanted, place (order as an anchor; null:
    no candidate). ``edges``: file_id, a, b; both ends are tracks too, a link to
    itself is none. Tracks are numbered 0 to ``width`` - 1 (at most 62); another
    number is an error. Each track is a mask of its neighbours, so a file is one
    row of ``width`` masks however many edges name it; the masks close over
    paths by doubling. ``groups`` is an array of (label, anchor, members):
    label is the smallest track, anchor the first by place, ties and tracks
    without a place by number.
    """
    place = F.col("place").cast("bigint") if "place" in nodes.columns else F.lit(None).cast("bigint")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    own = nodes.select("file_id", F.col("track").alias("i"), bit(F.col("track").cast("int")).alias("mask"), place.alias("place"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))
    linked = edges.where("a <> b").select("file_id", ends.alias("e")).select(
        "file_id", F.col("e.i").alias("i"), (bit(F.col("e.i").cast("int")).bitwiseOR(bit(F.col("e.j").cast("int")))).alias("mask"),
        F.lit(None).cast("bigint").alias("place"))
    wrong = (F.col("i") < 0) | (F.col("i") >= width)
    rows = own.unionByName(linked).withColumn("mask", F.when(wrong, F.raise_error(F.concat(F.lit("track out of range: "), "i"))).otherwise(F.col("mask")))
    at = lambda column, i: F.when(F.col("i") == i, F.col(column))
    masks = rows.groupBy("file_id").agg(
        F.array(*[F.coalesce(F.bit_or(at("mask", i)), F.lit(0).cast("bigint")) for i in range(width)]).alias("near"),
        F.array(*[F.min(at("place", i)) for i in range(width)]).alias("places"))
    tracks = F.sequence(F.lit(0), F.lit(width - 1))
    has = lambda mask, j: F.call_function("shiftright", mask, j).bitwiseAND(F.lit(1)) == 1
    further = lambda m: F.transform(m, lambda r: F.aggregate(tracks, r, lambda s, j: F.when(has(r, j), s.bitwiseOR(m[j])).otherwise(s)))
    rounds = F.sequence(F.lit(1), F.lit(max(1, (width - 1).bit_length())))  # a path has fewer than ``width`` steps
    reach = masks.select("file_id", "places", F.aggregate(rounds, F.col("near"), lambda m, _: further(m)).alias("reach"))
    # the smallest track of a group speaks for it
    first = lambda j: F.filter(tracks, lambda k: has(F.col("reach")[j], k))[0] == j
    order = lambda j: F.struct(F.coalesce(F.col("places")[j], F.lit(1 << 30).cast("bigint")).alias("place"), j.alias("track"))

    def group(j):
        members = F.filter(tracks, lambda k: has(F.col("reach")[j], k))
        anchor = F.array_min(F.transform(members, order))["track"]
        return F.struct(j.cast("bigint").alias("label"), anchor.cast("bigint").alias("anchor"),
                        F.transform(members, lambda k: k.cast("bigint")).alias("members"))
    return reach.select("file_id", F.transform(F.filter(tracks, lambda j: (F.col("reach")[j] != 0) & first(j)), group).alias("groups"))


def rigid_pairs(windows: DataFrame, strengths: DataFrame, *, min_windows: int = 8, min_samples: int = 0,
                storages: DataFrame | None = None, gates: dict = BINDING) -> DataFrame:
    """Pairs rigid enough to bind, with their evidence (one row per candidate).

    A candidate's strength rests on ``min_samples`` samples or more. Channels of
    different ``storages`` (file_id, channel, storage) are never bound.
    """
    keys = ["file_id", "a", "b"]
    strong = (F.col("median") >= gates["candidate_snr"]) & (F.col("samples") >= min_samples)
    cand = strengths.where(strong).select(*keys, "median")
    rows = windows.join(cand, keys)
    valid = rows.where("valid")
    q = exact_quantiles(valid, keys, "delay_samples", {"lag10": 0.1, "lag90": 0.9})
    c = exact_quantiles(valid, keys, F.abs("signed_cc"), {"abs_cc": 0.5})
    counts = rows.groupBy(*keys).agg(
        F.first("median").alias("median"), F.count(F.lit(1)).alias("n_windows"), F.count_if("valid").alias("n_valid"),
        F.avg(F.when(F.col("valid"), (F.col("signed_cc") > 0).cast("double"))).alias("positive"))
    same = F.greatest(F.col("positive"), 1 - F.col("positive"))
    span = F.col("lag90") - F.col("lag10")
    enough = F.col("n_valid") >= F.greatest(F.lit(min_windows), F.floor(F.col("n_windows") * 0.5))
    rigid = enough & (F.col("abs_cc") >= gates["min_abs_cc"]) & (span <= gates["lag_span"]) & (same >= gates["same_sign"])
    found = counts.join(q, keys, "left").join(c, keys, "left")
    alike = F.lit(True)
    if storages is not None:
        kind = lambda name: storages.select("file_id", F.col("channel").alias(name), F.col("storage").alias(f"_{name}"))
        found = found.join(kind("a"), ["file_id", "a"], "left").join(kind("b"), ["file_id", "b"], "left")
        alike = F.col("_a").eqNullSafe(F.col("_b"))
    return found.select(
        *keys, "median", "n_valid", "abs_cc", span.alias("lag_span"), same.alias("same_sign"),
        (F.coalesce(rigid, F.lit(False)) & alike).alias("rigid"),
        F.when(~alike, "storage_dtype_mismatch").alias("reason"))


def bind_pairs(candidates: DataFrame) -> DataFrame:
    """Disjoint pairs, strongest first, per file (a file has at most 28 pairs of 8 channels)."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("median")).alias("order"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))))
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    free = lambda acc, p: ~F.exists(acc, lambda q: (q["a"] == p["a"]) | (q["b"] == p["a"]) | (q["a"] == p["b"]) | (q["b"] == p["b"]))
    pick = lambda acc, x: F.when(
        free(acc, {"a": -x["na"], "b": -x["nb"]}),
        F.array_append(acc, F.struct((-x["na"]).cast("bigint").alias("a"), (-x["nb"]).cast("bigint").alias("b")))).otherwise(acc)
    return candidates.where("rigid").groupBy("file_id").agg(F.aggregate(ranked, empty, pick).alias("_p")).select(
        "file_id", F.explode("_p").alias("p")).select("file_id", "p.a", "p.b")


def follow_bound(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tracks (file_id, channel, anchor, outcome, reason, shift_samples, ...) as their bound pairs move.

    ``pairs`` (file_id, a, b) are disjoint. The anchor speaks for a pair that holds
    it, else the lower channel. A channel bound to the anchor is already aligned.
    Where the speaker is fixed or aligned, the other takes its outcome and its
    shift, so what lies between the two stays as recorded; where it is neither,
    both keep their own. Measurements stay those of the channel. ``bound_to`` is
    the speaker of a pair that moved together, on both of its rows.
    """
    two = F.explode(F.array(F.struct(F.col("a").alias("channel"), F.col("b").alias("_other")),
                            F.struct(F.col("b").alias("channel"), F.col("a").alias("_other"))))
    ends = pairs.select("file_id", two.alias("_e")).select("file_id", "_e.channel", "_e._other")
    led = tracks.join(ends, ["file_id", "channel"], "left")
    low = F.least("channel", "_other")
    held = F.col("channel").eqNullSafe(F.col("anchor"))
    led = led.withColumn("_rep", F.when(F.col("_other").eqNullSafe(F.col("anchor")), F.col("_other")).when(held, F.col("channel")).otherwise(low))
    led = led.withColumn("_rep", F.when(F.col("_other").isNotNull(), F.col("_rep")))
    settled = held | (F.col("reason").isNull() & F.col("outcome").isin("fixed", "already_aligned"))
    heads = tracks.where(settled).select(
        "file_id", F.col("channel").alias("_rep"), F.when(held, "already_aligned").otherwise(F.col("outcome")).alias("_outcome"),
        F.when(~held, F.col("shift_samples")).alias("_shift"))
    led = led.join(heads, ["file_id", "_rep"], "left")
    moved = F.col("_outcome").isNotNull() & ~held
    taken = {"outcome": F.when(moved, F.col("_outcome")).otherwise(F.col("outcome")), "reason": F.when(~moved, F.col("reason")),
             "shift_samples": F.when(moved, F.when(F.col("_outcome") == "fixed", F.col("_shift"))).otherwise(F.col("shift_samples"))}
    return led.select(*[taken[c].alias(c) if c in taken else c for c in tracks.columns],
                      F.when(F.col("_outcome").isNotNull(), F.col("_rep")).alias("bound_to"))


def _shifts(design: np.ndarray, delay: np.ndarray) -> np.ndarray:
    """Least-squares shifts of least norm, to whole samples, of many (pairs, channels) designs; rows of zeros count as absent.

    All designs are solved at once. A shift halfway between two samples is decided by the last bit, so such a
    design is solved once more by itself, without its absent rows.
    """
    u, size, v = np.linalg.svd(design, full_matrices=False)
    there = (design != 0).any(axis=2)
    least = np.finfo(float).eps * np.maximum(there.sum(axis=1), design.shape[2]) * size.max(axis=1)
    kept = size > least[:, None]
    along = np.where(kept, (u * delay[:, :, None]).sum(axis=1) / np.where(kept, size, 1.0), 0.0)
    x = (v * along[:, :, None]).sum(axis=1)
    for k in np.flatnonzero((np.abs(x - np.floor(x) - 0.5) < 1e-6).any(axis=1)):
        x[k] = np.linalg.lstsq(design[k, there[k]], delay[k, there[k]], rcond=None)[0]
    return np.rint(x)


def solve_files(a: np.ndarray, b: np.ndarray, delay: np.ndarray, weight: np.ndarray, n_channels: int, rounds: int,
                tolerance: float, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, cost, dropped, shifts) of many files of equally many pairs and channels; anchor -1 where none fits.

    One row per file: ends of its pairs as places of its channels, delays and weights. Every channel of every file
    is tried as the anchor, all at once; a trial goes on without its worst pair until all fit.
    """
    files, n_pairs = a.shape
    trials = files * n_channels
    m = np.zeros((files, n_pairs, n_channels))
    at = np.ogrid[:files, :n_pairs]
    m[at[0], at[1], b] += 1
    m[at[0], at[1], a] -= 1
    others = np.array([[c for c in range(n_channels) if c != k] for k in range(n_channels)], int).reshape(n_channels, n_channels - 1)
    free = m[:, :, others].transpose(0, 2, 1, 3).reshape(trials, n_pairs, n_channels - 1)
    a, b, delay, weight = (np.repeat(v, n_channels, axis=0) for v in (a, b, delay, weight))
    anchor = np.tile(np.arange(n_channels), files)
    live, shifts = np.ones((trials, n_pairs), bool), np.zeros((trials, n_channels))
    cost, dropped = np.full(trials, np.inf), np.zeros(trials, int)
    going = np.arange(trials)
    for _ in range(rounds):
        going = going[live[going].any(axis=1)]
        if not len(going):
            break
        on = weight[going] * live[going]
        shift = np.zeros((len(going), n_channels))
        if n_channels > 1:
            shift[np.arange(len(going))[:, None], others[anchor[going]]] = _shifts(free[going] * on[:, :, None], delay[going] * on)
        miss = np.take_along_axis(shift, b[going], 1) - np.take_along_axis(shift, a[going], 1) - delay[going]
        size = np.where(live[going], np.abs(miss), -1.0)
        fits = size.max(axis=1) <= tolerance
        near = fits & (np.abs(shift).max(axis=1) <= limit)
        found = going[near]
        shifts[found], dropped[found] = shift[near], n_pairs - live[found].sum(axis=1)
        cost[found] = np.where(live[found], miss[near] ** 2, 0.0).sum(axis=1)
        live[going[~fits], size[~fits].argmax(axis=1)] = False
        going = going[~fits]
    cost = cost.reshape(files, n_channels)
    best = cost.argmin(axis=1)
    pick = np.arange(files) * n_channels + best
    return np.where(np.isfinite(cost).any(axis=1), best, -1), cost[np.arange(files), best], dropped[pick], shifts[pick]


def solve_offsets(pairs: DataFrame, *, rounds: int = 6, tolerance: float = 2.0, limit: int = 4816) -> DataFrame:
    """Integer offsets per channel from pair delays (file_id, a, b, delay, weight).

    Weighted least squares with one channel at 0, dropping the worst pair until
    all fit; the anchor of least squared residual wins. A file whose pairs never
    fit, or only with shifts beyond ``limit``, keeps its channels with no shift
    and a ``reason``. Several rows of one pair count as their mean delay with
    their summed weight, so a file's pairs (at most 28) travel as one short array.
    Files of equally many pairs and channels are solved together, ``SOLVED`` files at a time.
    """
    pairs = pairs.groupBy("file_id", "a", "b").agg(F.avg("delay").alias("delay"), F.sum("weight").alias("weight"))
    packed = pairs.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("a", "b", "delay", "weight"))).alias("p"))
    schema = "file_id bigint, channel bigint, anchor bigint, shift bigint, cost double, dropped bigint, reason string"

    def solved(held):
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("p").combine_chunks()
        ends = lists.offsets.to_numpy()
        items = lists.values.slice(ends[0], ends[-1] - ends[0])
        a, b, delay, weight = (items.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "delay", "weight"))
        counts, starts = np.diff(ends), ends[:-1] - ends[0]
        # channels of a file ascending, and where each end stands among them
        owner = np.repeat(np.arange(len(counts)), counts)
        every, place = np.unique(np.stack([np.tile(owner, 2), np.concatenate([a, b])]), axis=1, return_inverse=True)
        first = np.searchsorted(every[0], np.arange(len(counts) + 1))
        a_at, b_at = place[:len(a)] - first[owner], place[len(a):] - first[owner]
        for n_pairs, n_channels in sorted(set(zip(counts.tolist(), np.diff(first).tolist()))):
            of = np.flatnonzero((counts == n_pairs) & (np.diff(first) == n_channels))
            rows = starts[of][:, None] + np.arange(n_pairs)
            anchor, cost, dropped, shifts = solve_files(
                a_at[rows], b_at[rows], delay[rows].astype(float), weight[rows].astype(float), n_channels, rounds, tolerance, limit)
            channels = every[1][first[of][:, None] + np.arange(n_channels)]
            none = np.repeat(anchor < 0, n_channels)
            whole = lambda v: pa.array(v.astype(np.int64), mask=none)
            wide = lambda v: np.repeat(v, n_channels)
            yield pa.RecordBatch.from_arrays([
                table.column("file_id").take(pa.array(wide(of))).combine_chunks(), pa.array(channels.ravel()),
                whole(wide(channels[np.arange(len(of)), anchor])), whole(shifts.ravel()), pa.array(wide(cost), mask=none),
                whole(wide(dropped)), pa.array(np.where(none, "no consistent shifts", ""), pa.string(), mask=~none)],
                [c.split()[0] for c in schema.split(", ")])

    def per_batch(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= SOLVED:
                yield from solved(held)
                held = []
        if held:
            yield from solved(held)
    return packed.mapInArrow(per_batch, schema)


def robust_lines(points: DataFrame, keys: list[str], *, trials: int = 256, limit: float = 3.0, min_gap: float = 1.0) -> DataFrame:
    """Robust drift line y = a + b t per key, points weighted by ``w``.

    Trials pair points chosen by hash order, so a rerun takes the same ones.
    Each trial is scored over all points by a partial aggregation; the winner's
    inliers get a weighted least-squares fit and residual quantiles. Nothing of
    a key is collected beyond its ``2 * trials`` chosen points.
    """
    order = F.xxhash64(*keys, "t", "y")
    smallest = F.slice(F.array_sort(F.collect_list("p")), 1, 2 * trials)
    # bounded sketch: keep the smallest hashes per bucket first, then per key
    bucketed = points.select(*keys, F.struct(order.alias("h"), "t", "y").alias("p")).withColumn(
        "_b", F.pmod(F.col("p.h"), F.lit(2 * trials)))
    drawn = bucketed.groupBy(*keys, "_b").agg(F.min("p").alias("p")).groupBy(*keys).agg(smallest.alias("s"))
    n = F.size("s")
    pairs = drawn.where(n >= 2).select(*keys, F.posexplode("s").alias("i", "p"), "s", n.alias("n"))
    q = F.col("s")[F.pmod(F.col("i") * 7 + 1 + F.floor(F.col("n") / 2), F.col("n")).cast("int")]
    slope = F.try_divide(F.col("p.y") - q["y"], F.col("p.t") - q["t"])
    lines = pairs.where(F.abs(F.col("p.t") - q["t"]) >= min_gap).select(
        *keys, F.col("i").alias("trial"), slope.alias("b"), (F.col("p.y") - slope * F.col("p.t")).alias("a"))
    packed = lines.groupBy(*keys).agg(F.collect_list(F.struct("trial", "a", "b")).alias("lines"))
    near = F.abs(F.col("y") - F.col("l.a") - F.col("l.b") * F.col("t")) <= limit
    scored = points.join(packed, keys).select(*keys, "t", "y", "w", F.explode("lines").alias("l"))
    scores = scored.groupBy(*keys, "l").agg(F.sum(F.when(near, F.col("w"))).alias("_score"), F.count_if(near).alias("_k"))
    best = scores.where("_k >= 3").groupBy(*keys).agg(
        F.max_by("l", F.struct(F.round("_score", 9), (-F.col("l.trial")).alias("x"))).alias("l"))
    kept = points.join(best, keys).where(near)
    w2 = F.col("w") * F.col("w")
    sums = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_inliers"), F.sum(w2).alias("sw"), F.sum(w2 * F.col("t")).alias("st"), F.sum(w2 * F.col("y")).alias("sy"),
        F.sum(w2 * F.col("t") * F.col("t")).alias("stt"), F.sum(w2 * F.col("t") * F.col("y")).alias("sty"))
    b = F.try_divide(F.col("sw") * F.col("sty") - F.col("st") * F.col("sy"), F.col("sw") * F.col("stt") - F.col("st") * F.col("st"))
    fit = sums.withColumn("slope", b).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("st")) / F.col("sw")).select(
        *keys, "n_inliers", "slope", "intercept")
    resid = kept.join(fit, keys).select(*keys, F.abs(F.col("y") - F.col("intercept") - F.col("slope") * F.col("t")).alias("r"))
    return fit.join(exact_quantiles(resid, keys, "r", {"r_p50": 0.5, "r_p90": 0.9, "r_max": 1.0}), keys)


def accurate_tier(extras: DataFrame, min_shift_samples: int = 5) -> DataFrame:
    """Finest tier a file's small corrections hold at, and what is kept of each track."""
    size, resid = F.abs("shift_samples"), F.col("residual_samples")
    bad = lambda tier: F.bool_or((size > tier) & ~F.coalesce(resid <= tier, F.lit(False)))
    per = extras.groupBy("file_id").agg(*[bad(t).alias(f"bad{t}") for t in ACCURATE_TIERS])
    tier = F.when(~F.col("bad1"), 1).when(~F.col("bad2"), 2).otherwise(min_shift_samples).cast("bigint")
    joined = extras.join(per.select("file_id", tier.alias("tier"), (F.col("bad1") & F.col("bad2")).alias("_none")), "file_id")
    keep = ~F.col("_none") & (size > F.col("tier"))
    why = (F.when(F.col("_none"), "residual exceeds tier 2")
           .when(size <= F.col("tier"), F.concat(F.lit("|shift| <= "), F.col("tier").cast("string"))))
    return joined.select("file_id", "track_id", "tier", keep.alias("keep"), why.alias("dropped"))
