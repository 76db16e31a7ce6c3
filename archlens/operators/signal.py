"""Signal measurement: frames and windows of channel pairs to delays.

``blocks`` is (file_id, channel, block_no, samples); pairs are (file_id, ref, tgt).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import pcm, signal as sg
from ..functions.scalar import is_pcm, rms_dbfs
from ..session import cut_lineage
from .ordered import neighbours
from .quantiles import exact_quantiles
from .trajectory import KEYS
from .windows import longest_run

CH = ["file_id", "channel"]
# Scope of automatic alignment, tracker and polarity settings.
RATES = [44100, 48000, 96000]
MIN_CHANNELS, MAX_CHANNELS = 3, 8
TRACK_RADIUS, TRACK_PER_MINUTE, TRACK_MIN_CC = 96, 8, 0.06
POLARITY_MIN_CC, POLARITY_SHARE = 0.25, 0.8
FULL_HALF = 8
TRACK_TRIES, INITIAL_RADIUS, REFINE_RADIUS = 2, 12, 8
TRACK_CHUNK = 4096


def eligibility(files: DataFrame, streams: DataFrame) -> DataFrame:
    """Channels of a file that may be aligned, or the first reason why not."""
    audio = streams.where("codec_type = 'audio'").withColumn("_pcm", is_pcm(F.col("codec_name")))
    per = audio.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_pcm").alias("pcm"), F.min("sample_rate").alias("lo"), F.max("sample_rate").alias("hi"),
        F.sum("channels").alias("channels"), F.min(F.coalesce("channels", F.lit(0))).alias("least"))
    c = F.col
    reason = (F.when(c("n").isNull(), "no_audio_streams").when(c("pcm") == 0, "non_pcm_audio")
              .when(c("pcm") < c("n"), "mixed_pcm_compressed_not_aligned").when(c("lo") != c("hi"), "mixed_sample_rates")
              .when(~c("lo").isin(*RATES), "unsupported_sample_rate").when(c("least") <= 0, "unknown_channel_layout")
              .when((c("channels") < MIN_CHANNELS) | (c("channels") > MAX_CHANNELS), "channel_count_out_of_range"))
    return files.select("file_id").join(per, "file_id", "left").select(
        "file_id", reason.isNull().alias("eligible"), reason.alias("reason"), F.coalesce("channels", F.lit(0)).alias("channels"))


def pair_lengths(blocks: DataFrame, size: int, ref: int = 0) -> DataFrame:
    """(file, ref, tgt) with the shorter length, for every other channel."""
    n = pcm.channel_lengths(blocks, CH, size)
    a = n.where(F.col("channel") == ref).select("file_id", F.col("channel").alias("ref"), F.col("n_samples").alias("_a"))
    b = n.where(F.col("channel") != ref).select("file_id", F.col("channel").alias("tgt"), F.col("n_samples").alias("_b"))
    return a.join(b, "file_id").select("file_id", "ref", "tgt", F.least("_a", "_b").alias("n_samples"))


def read_channel(blocks: DataFrame, ranges: DataFrame, channel: str, size: int, start: str, count: str, out: str) -> DataFrame:
    named = blocks.withColumnRenamed("channel", channel)
    return pcm.read_ranges(named, ranges, ["file_id", channel], size, start=start, count=count, out=out)


def read_pairs(blocks: DataFrame, ranges: DataFrame, size: int, *, before: int = 0, after: int = 0,
               shift: Column | None = None) -> DataFrame:
    """``ref`` and ``tgt`` samples of each range; the target is read wider and shifted."""
    wide = ranges.withColumn("_ts", F.col("start") + (F.lit(0) if shift is None else shift) - before).withColumn(
        "_tc", F.col("count") + before + after)
    keys = wide.columns
    a = read_channel(blocks, wide, "ref", size, "start", "count", "ref_x")
    b = read_channel(blocks, wide, "tgt", size, "_ts", "_tc", "tgt_x")
    return a.join(b, keys).drop("_ts", "_tc")


def loudness(blocks: DataFrame, block_sec: float, silent_dbfs: float = -50.0) -> DataFrame:
    """Level percentiles, peak, silent share and longest silent run of each channel."""
    floor = F.lit(1e-12)
    level = F.greatest(F.sqrt(pcm.dot(F.col("samples"), F.col("samples")) / F.size("samples")), floor)
    peak = F.greatest(F.array_max(F.transform("samples", lambda x: F.abs(x.cast("double")))), floor)
    rows = blocks.select(*CH, "block_no", (20 * F.log10(level)).alias("db"), (20 * F.log10(peak)).alias("peak_db"))
    silent = F.col("db") < silent_dbfs
    q = exact_quantiles(rows, CH, "db", {"db_p10": 0.1, "db_p50": 0.5, "db_p90": 0.9})
    run = longest_run(rows, CH, "block_no", silent, True).select(*CH, (F.col("longest") * block_sec).alias("longest_silent_sec"))
    counts = rows.groupBy(*CH).agg(F.count(F.lit(1)).alias("blocks"), F.max("peak_db").alias("peak_db"), F.count_if(silent).alias("silent_blocks"))
    return counts.join(q, CH).join(run, CH).withColumn("silent_fraction", F.col("silent_blocks") / F.col("blocks"))


def decimated(blocks: DataFrame, size: int, factor: int) -> DataFrame:
    """Coarse blocks equal to filtering the whole channel: each reads its filter margins."""
    margin = sg.TAPS_PER_FACTOR * factor // 2
    ranges = blocks.select(*CH, "block_no", (F.col("block_no") * size - margin).alias("start"), F.lit(size + 2 * margin).cast("bigint").alias("count"))
    read = pcm.read_ranges(blocks, ranges.withColumnRenamed("block_no", "out_block"), CH, size, out="x")
    return read.select(*CH, F.col("out_block").alias("block_no"), sg.decimate(F.col("x"), factor, margin).alias("samples"))


def frame_delays(blocks: DataFrame, size: int, *, frame: int, hop: int, search: int, gate: float = sg.RMS_GATE,
                 pairs: DataFrame | None = None) -> DataFrame:
    """One whitened-correlation delay per frame of each pair; not measurable is null."""
    ranges = pcm.frame_ranges(pair_lengths(blocks, size) if pairs is None else pairs, frame, hop)
    read = read_pairs(blocks, ranges, size, before=search, after=search)
    g = sg.gcc_phat(F.col("ref_x"), F.col("tgt_x"), lag0=search, lo=-search, hi=search, gate=gate)
    return read.select(*KEYS, "frame_no", (F.col("start") + frame // 2).alias("center_sample"), g.alias("g")).select(
        *KEYS, "frame_no", "center_sample", "g.*")


def two_stage_delays(blocks: DataFrame, size: int, *, frame: int, hop: int, search: int, factor: int,
                     min_confidence: float, gate: float = sg.RMS_GATE) -> DataFrame:
    """Coarse delay at the decimated rate, then within a few samples at full rate.

    A frame that fails either stage stays, with a null delay.
    """
    coarse = decimated(blocks, size, factor)
    first = frame_delays(coarse, size // factor, frame=frame // factor, hop=hop // factor, search=search // factor, gate=gate)
    ok = F.col("success") & (F.col("confidence") >= min_confidence)
    first = first.select(*KEYS, "frame_no", F.when(ok, (F.rint("delay") * factor).cast("bigint")).alias("coarse"),
                         F.col("confidence").alias("coarse_confidence"))
    ranges = first.where(F.col("coarse").isNotNull()).select(
        *KEYS, "frame_no", "coarse", (F.col("frame_no") * hop).alias("start"), F.lit(frame).cast("bigint").alias("count"))
    pairs = read_pairs(blocks, ranges, size, before=FULL_HALF, after=FULL_HALF, shift=F.col("coarse"))
    g = sg.gcc_phat(F.col("ref_x"), F.col("tgt_x"), lag0=FULL_HALF, lo=-FULL_HALF, hi=FULL_HALF, gate=gate)
    fine = pairs.select(*KEYS, "frame_no", "coarse", g.alias("g"))
    good = F.col("g.success") & (F.col("g.confidence") >= min_confidence)
    fine = fine.select(*KEYS, "frame_no", F.when(good, F.col("coarse") + F.col("g.delay")).alias("delay_samples"),
                       F.col("g.confidence").alias("fine_confidence"))
    return first.join(fine, [*KEYS, "frame_no"], "left").select(
        *KEYS, "frame_no", (F.col("frame_no") * hop + frame // 2).alias("center_sample"), "delay_samples",
        F.coalesce("fine_confidence", "coarse_confidence").alias("confidence"))


def fine_delay(blocks: DataFrame, estimates: DataFrame, size: int, *, rate: float, segment: int) -> DataFrame:
    """Phase-slope delay on the middle segment, after the integer delay is taken out."""
    lengths = pair_lengths(blocks, size).join(estimates.where(F.col("delay_samples").isNotNull()), KEYS)
    whole = F.floor(F.col("delay_samples") + 0.5)
    count = F.least(F.lit(segment), F.col("n_samples"))
    ranges = lengths.select(*KEYS, whole.alias("whole"), F.floor((F.col("n_samples") - count) / F.lit(2)).alias("start"), count.cast("bigint").alias("count"))
    pairs = read_pairs(blocks, ranges, size, shift=F.col("whole"))
    s = sg.phase_slope(F.col("ref_x"), F.col("tgt_x"), rate=rate)
    return pairs.select(*KEYS, "whole", s.alias("s")).select(
        *KEYS, (F.col("whole") + F.col("s.delta")).alias("fine_delay_samples"), F.col("s.r2").alias("r2"), F.col("s.polarity").alias("polarity"))


def sampled_frames(lengths: DataFrame, frame: int, hop: int, samples: int = 200) -> DataFrame:
    """At most ``samples`` frames per pair, one in each stretch of the take.

    The place within a stretch comes from a hash, so reruns take the same frames.
    """
    n = F.floor((F.col("n_samples") - frame) / F.lit(hop)) + 1
    long = lengths.where(F.col("n_samples") >= frame).withColumn("_n", n)
    k = F.least(F.col("_n"), F.lit(samples))
    spread = long.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)))
    low = F.floor(F.col("_i") * F.col("_n") / k)
    width = F.greatest(F.floor((F.col("_i") + 1) * F.col("_n") / k) - low, F.lit(1))
    return spread.select(*KEYS, (low + F.pmod(F.xxhash64(*KEYS, "_i"), width)).alias("frame_no")).withColumn(
        "start", F.col("frame_no") * hop).withColumn("count", F.lit(frame).cast("bigint"))


def pair_strength(blocks: DataFrame, size: int, *, frame: int, hop: int, search: int, samples: int = 200,
                  gate: float = sg.RMS_GATE, lengths: DataFrame | None = None) -> DataFrame:
    """Peak over noise of sampled frames per pair: median and quartiles; null is unmeasured.

    ``lengths`` (file, ref, tgt, n_samples) names the pairs; by default channel 0 meets every other.
    """
    given = pair_lengths(blocks, size) if lengths is None else lengths
    pairs = read_pairs(blocks, sampled_frames(given, frame, hop, samples), size, before=search, after=search)
    g = sg.gcc_phat(F.col("ref_x"), F.col("tgt_x"), lag0=search, lo=-search, hi=search, gate=gate)
    rows = pairs.select(*KEYS, g["snr"].alias("snr"))
    # at most ``samples`` rows per pair
    q = exact_quantiles(rows, KEYS, "snr", {"p25": 0.25, "median": 0.5, "p75": 0.75}, bounded=True)
    counts = rows.groupBy(*KEYS).agg(F.count("snr").alias("samples"))
    return counts.join(q, KEYS, "left")


def window_ranges(lengths: DataFrame, window: int, hop: int) -> DataFrame:
    return pcm.frame_ranges(lengths, window, hop).withColumnRenamed("frame_no", "window_no")


def window_peaks(blocks: DataFrame, size: int, *, window: int, hop: int, search: int) -> DataFrame:
    """Strongest |normalised correlation| of each window within ``search`` samples."""
    pairs = read_pairs(blocks, window_ranges(pair_lengths(blocks, size), window, hop), size)
    p = sg.ncc_peak(F.col("ref_x"), F.col("tgt_x"), lo=-search, hi=search)
    return pairs.select(*KEYS, "window_no", "start", p.alias("p")).select(*KEYS, "window_no", "start", "p.lag", "p.cc", "p.abs_cc")


def refine(blocks: DataFrame, coarse: DataFrame, size: int, *, window: int, segment: int, radius: int) -> DataFrame:
    """Best whole lag within ``radius`` on the centre segment, by plain correlation.

    ``coarse`` has window_no, start and lag. A candidate whose segment leaves
    the window is skipped; with none left the coarse lag stays, at quality 0.
    """
    c0 = F.greatest(F.col("start") + window // 2 - segment // 2, F.lit(0))
    ranges = coarse.where(F.col("lag").isNotNull()).select(
        *KEYS, "window_no", F.col("start").alias("w0"), F.col("lag").alias("coarse"), c0.alias("start"), F.lit(segment).cast("bigint").alias("count"))
    pairs = read_pairs(blocks, ranges, size, before=radius, after=radius, shift=F.col("coarse"))
    # the shifted segment stays inside the window and the take
    lo, hi = F.greatest(-F.col("start"), F.col("coarse") - radius), F.col("w0") + window - segment - F.col("start")
    best = sg.best_lag_near("ref_x", "tgt_x", F.col("coarse"), lo, hi, radius=radius)
    found = pairs.select(*KEYS, "window_no", "coarse", best.alias("b"))
    return found.select(*KEYS, "window_no", F.coalesce("b.lag", "coarse").alias("lag"), F.coalesce("b.quality", F.lit(0.0)).alias("quality"))


def surfaces(blocks: DataFrame, size: int, *, window: int, hop: int, search: int) -> DataFrame:
    """Normalised correlation over the whole search range for each window of each pair."""
    pairs = read_pairs(blocks, window_ranges(pair_lengths(blocks, size), window, hop), size)
    return pairs.select(*KEYS, "window_no", "start", sg.ncc_lags(F.col("ref_x"), F.col("tgt_x"), lo=-search, hi=search).alias("surface"))


TRACK_SCHEMA = ("file_id bigint, ref bigint, tgt bigint, window_no bigint, delay_samples double, cc double, "
                "valid boolean, polarity bigint, radius bigint")
FOLLOWED = TRACK_SCHEMA + ", coarse_cc double"


def _sorted_windows(rows: DataFrame) -> DataFrame:
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "window_no")


def _folded(batches: Iterator[pa.RecordBatch], chunk: int, step, schema: str) -> Iterator[pa.RecordBatch]:
    """``step(state, row)`` over sorted windows of pairs, one pass; a pair's state is a dict that begins empty."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    pair, state = None, {}
    for part in (b.slice(a, chunk) for b in batches for a in range(0, b.num_rows, chunk)):
        out = []
        columns = {c: part.column(c) for c in part.schema.names}
        for k in range(part.num_rows):
            row = {c: (v[k].values.to_numpy(zero_copy_only=False) if v[k].is_valid else None) if pa.types.is_list(v.type)
                   else v[k].as_py() for c, v in columns.items()}
            here = [row[c] for c in KEYS]
            if here != pair:
                pair, state = here, {}
            found = step(state, row)
            if found is not None:
                out.append((*here, *found))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[t]) for i, (_, t) in enumerate(fields)],
                                         [n for n, _ in fields])


def track_windows(found: DataFrame, *, rate: float, radius: int = TRACK_RADIUS, per_minute: float = TRACK_PER_MINUTE,
                  min_cc: float = TRACK_MIN_CC, chunk: int = TRACK_CHUNK) -> DataFrame:
    """Follow the delay from window to window over given surfaces, as far as they reach.

    The correlation surfaces come from a parallel stage; here only the
    prediction is carried, in one pass over a pair's sorted windows. The first window is
    searched in full (two tries), later ones around the last valid lag; a weak window
    is invalid and does not move the prediction. A task holds ``chunk`` windows.
    """
    def step(state: dict, row: dict) -> tuple:
        prev, tries, surface = state.get("lag"), state.get("tries", 0), row["surface"]
        reach = radius + int(round(per_minute * row["start"] / rate / 60))
        delay, cc = None, 0.0
        if surface is not None and len(surface) and (prev is not None or tries < 2):
            half = len(surface) // 2
            state["tries"] = tries + (prev is None)
            peak = sg.surface_peak(surface, -half if prev is None else prev - reach, half if prev is None else prev + reach, 1)
            if peak is not None:
                cc = peak[1]
                if abs(cc) >= min_cc:
                    delay = state["lag"] = peak[0]
        return row["window_no"], delay, cc, delay is not None, 1 if cc >= 0 else -1, reach

    rows = _sorted_windows(found.select(*KEYS, "window_no", "start", "surface"))
    return rows.mapInArrow(lambda batches: _folded(batches, chunk, step, TRACK_SCHEMA), TRACK_SCHEMA)


def follow_delays(blocks: DataFrame, size: int, *, rate: float, window: int, hop: int, search: int, factor: int = 4,
                  radius: int = TRACK_RADIUS, per_minute: float = TRACK_PER_MINUTE, min_cc: float = TRACK_MIN_CC,
                  initial: int | None = None, segment: int | None = None, refine_radius: int = REFINE_RADIUS,
                  lengths: DataFrame | None = None, chunk: int = 64) -> DataFrame:
    """Continuous delays of whole pairs: coarse search around the last valid lag, refined at full rate.

    A long first stretch of ``initial`` samples (twice ``window`` by default) is searched
    within ``search``, and if it is weak the one a hop later; with neither, no window is
    valid. Each window is then searched within a reach of the last valid lag that grows with
    time, whatever ``search`` was, and its centre ``segment`` is matched sample by
    sample; that lag is the next prediction. ``cc`` is the coarse |correlation|, 1 at
    most, times the refined one. Surfaces are made in parallel; the fold reads them in
    one pass, window by window, and holds ``chunk`` of them.
    """
    long, seg = initial or 2 * window, segment or max(8, window // 8)
    before = window // 2
    pairs = pair_lengths(blocks, size) if lengths is None else lengths
    tries = pairs.withColumn("window_no", F.explode(F.sequence(F.lit(-TRACK_TRIES).cast("bigint"), F.lit(-1).cast("bigint"))))
    tries = tries.withColumn("start", (F.col("window_no") + TRACK_TRIES) * hop).withColumn(
        "count", F.least(F.lit(long), F.col("n_samples") - F.col("start"))).where(F.col("count") >= 16 * factor)
    ranges = window_ranges(pairs, window, hop)
    ranges = ranges.unionByName(tries.select(*ranges.columns))
    read = read_pairs(blocks, ranges, size, before=before)
    # a first stretch is refined on the centre of its first window
    centre = F.floor(F.least(F.col("count"), F.lit(window)) / 2) - seg // 2
    rows = read.withColumn("surface", sg.coarse_surface(F.col("ref_x"), F.col("tgt_x"), before=before, factor=factor)).select(
        *KEYS, "window_no", "start", F.least(F.col("count"), F.lit(window)).alias("length"), F.greatest(centre, F.lit(0)).alias("at"),
        "surface", F.slice("ref_x", F.greatest(centre, F.lit(0)).cast("int") + 1, seg).alias("segment"),
        F.slice("tgt_x", 1, before + F.least(F.col("count"), F.lit(window)).cast("int")).alias("tgt_x"))

    def refined(row: dict, lag: int, reach: int) -> tuple[int, float]:
        if row["length"] < seg:
            return lag, 0.0
        return sg.refined_lag(row["segment"].astype(float), row["tgt_x"].astype(float), before + row["at"], lag, reach)

    def step(state: dict, row: dict) -> tuple | None:
        prev, surface = state.get("lag"), row["surface"]
        if row["window_no"] < 0:
            peak = sg.surface_peak(surface, -search, search, factor) if prev is None and surface is not None else None
            if peak is not None and abs(peak[1]) >= min_cc:
                state["lag"] = refined(row, peak[0], INITIAL_RADIUS)[0]
            return None
        reach = radius + int(round(per_minute * row["start"] / rate / 60))
        peak = sg.surface_peak(surface, prev - reach, prev + reach, factor) if prev is not None and surface is not None else None
        coarse = peak[1] if peak is not None else 0.0
        if peak is None or abs(coarse) < min_cc:
            return row["window_no"], None, 0.0, False, 1 if coarse >= 0 else -1, reach, abs(coarse)
        lag, quality = refined(row, peak[0], refine_radius)
        state["lag"] = lag
        return row["window_no"], float(lag), min(abs(coarse), 1.0) * max(quality, 0.0), True, 1 if coarse >= 0 else -1, reach, abs(coarse)

    return _sorted_windows(rows).mapInArrow(lambda batches: _folded(batches, chunk, step, FOLLOWED), FOLLOWED)


def independent_delays(blocks: DataFrame, size: int, *, window: int, hop: int, max_lag: int, min_dbfs: float = -50.0,
                       min_ratio: float = 1.5) -> DataFrame:
    """Second estimator: plain full-rate correlation, sub-sample peak, peak over sidelobe."""
    pairs = read_pairs(blocks, window_ranges(pair_lengths(blocks, size), window, hop), size)
    p = sg.ncc_peak(F.col("ref_x"), F.col("tgt_x"), lo=-max_lag, hi=max_lag, signed=True)
    rows = pairs.select(*KEYS, "window_no", p.alias("p"), F.least(rms_dbfs(F.col("ref_x")), rms_dbfs(F.col("tgt_x"))).alias("db"))
    reason = (F.when(F.lit(window < 2 * max_lag + 2), "verifier_too_short").when(F.col("p.lag").isNull(), "verifier_zero_variance")
              .when(F.col("db") < min_dbfs, "verifier_no_signal")
              .when(F.coalesce(F.col("p.peak_to_sidelobe") < min_ratio, F.lit(True)), "verifier_ambiguous_peak"))
    return rows.select(*KEYS, "window_no", F.col("p.sub_lag").alias("delay_samples"), F.col("p.cc").alias("cc"),
                       F.col("p.peak_to_sidelobe").alias("peak_to_sidelobe"), reason.isNull().alias("qualified"), reason.alias("reason"))


def onsets(blocks: DataFrame) -> DataFrame:
    """Rise of log energy from block to block; 0 on the first block and on falls."""
    energy = F.log(F.sqrt(pcm.dot(F.col("samples"), F.col("samples")) / F.size("samples")) + 1e-9)
    rows = blocks.select(*CH, "block_no", energy.alias("e"))
    wide, window, keep = neighbours(rows, CH, "block_no", 1)
    rise = F.greatest(F.col("e") - F.coalesce(F.lag("e").over(window), F.col("e")), F.lit(0.0))
    return wide.withColumn("onset", rise).where(keep).select(*CH, "block_no", "onset")


def agreement(candidates: DataFrame, keys: list[str], tolerance: int = 2) -> DataFrame:
    """Largest cluster of candidate delays within tolerance: its median, quality, spread.

    A range frame over the few candidates of a window replaces a self-join.
    """
    from pyspark.sql import Window as W
    near = W.partitionBy(*keys).orderBy("delay").rangeBetween(-tolerance, tolerance)
    scored = candidates.withColumn("_k", F.count(F.lit(1)).over(near)).withColumn("_q", F.sum("quality").over(near))
    best = scored.groupBy(*keys).agg(F.max_by("delay", F.struct("_k", F.round("_q", 9), (-F.col("delay")).alias("x"))).alias("center"))
    members = candidates.join(best, keys).where(F.abs(F.col("delay") - F.col("center")) <= tolerance)
    # candidates of one window: a handful of estimators
    return members.groupBy(*keys).agg(
        F.floor(F.median("delay")).alias("delay"), F.max("quality").alias("quality"), F.count(F.lit(1)).alias("n_methods"),
        (F.max("delay") - F.min("delay")).alias("spread"))


def correlation_summary(peaks: DataFrame, keys: list[str]) -> DataFrame:
    """Correlated, weak and uncorrelated blocks of a pair, with peak and lag spread."""
    q = exact_quantiles(peaks, keys, "ncc", {"ncc_p10": 0.1, "ncc_p50": 0.5, "ncc_p90": 0.9})
    lag = exact_quantiles(peaks, keys, "lag", {"lag_median": 0.5})
    c = F.col("ncc")
    counts = peaks.groupBy(*keys).agg(
        F.count_if(c >= 0.3).alias("correlated"), F.count_if((c >= 0.1) & (c < 0.3)).alias("weak"), F.count_if(c < 0.1).alias("uncorrelated"),
        (F.max("lag") - F.min("lag")).alias("lag_spread"))
    return counts.join(q, keys).join(lag, keys)


def polarity_votes(peaks: DataFrame, keys: list[str], min_cc: float = POLARITY_MIN_CC, share: float = POLARITY_SHARE) -> DataFrame:
    """Share of negative peaks among the strong ones, and whether to flip the pair."""
    strong = peaks.where(F.abs("cc") >= min_cc)
    med = exact_quantiles(strong, keys, F.abs("cc"), {"median_abs_cc": 0.5})
    votes = peaks.groupBy(*keys).agg(
        F.count_if(F.abs("cc") >= min_cc).alias("votes"), F.count_if((F.abs("cc") >= min_cc) & (F.col("cc") < 0)).alias("negative"))
    ratio = F.coalesce(F.try_divide(F.col("negative").cast("double"), F.col("votes")), F.lit(0.0))
    out = votes.join(med, keys, "left").withColumn("negative_ratio", ratio).fillna(0.0, ["median_abs_cc"])
    return out.withColumn("flip", (F.col("votes") > 0) & (F.col("negative_ratio") >= share) & (F.col("median_abs_cc") >= min_cc))


def polarity_triangles(votes: DataFrame) -> DataFrame:
    """Files whose three pair polarities (01, 12, 02) contradict each other."""
    sign = lambda a, b: F.max(F.when((F.col("ref") == a) & (F.col("tgt") == b), F.when(F.col("flip"), -1).otherwise(1)))
    s = votes.groupBy("file_id").agg(sign(0, 1).alias("s01"), sign(1, 2).alias("s12"), sign(0, 2).alias("s02"))
    return s.select("file_id", (F.col("s01") * F.col("s12") * F.col("s02") > 0).alias("consistent"))


def recheck(blocks: DataFrame, size: int, *, windows: int, segment: int, search: int, rate: float,
            pairs: DataFrame | None = None) -> DataFrame:
    """Residual delay at evenly spread places of a take, and the worst of them.

    ``pairs`` (file, ref, tgt, n_samples, shift) are targets to be read as if
    shifted; their segments leave room for the search, and an inverted target
    is turned before its phase is read.
    """
    places = [0.5] if windows == 1 else [0.05 + 0.9 * i / (windows - 1) for i in range(windows)]
    given = pair_lengths(blocks, size).withColumn("shift", F.lit(0).cast("bigint")) if pairs is None else pairs
    lengths = given.withColumn("place", F.explode(F.array(*[F.lit(p) for p in places])))
    room = F.col("n_samples") - (0 if pairs is None else 2 * search)
    count = F.least(F.lit(segment), room)
    begin = F.least(F.greatest(F.floor(F.col("n_samples") * F.col("place") - count / 2), F.lit(0)), F.col("n_samples") - count)
    ranges = lengths.where(room > 0).select(*KEYS, "place", "shift", begin.alias("start"), count.cast("bigint").alias("count"))
    read = read_pairs(blocks, ranges, size, before=search, after=search, shift=F.col("shift"))
    g = sg.gcc_phat(F.col("ref_x"), F.col("tgt_x"), lag0=search, lo=-search, hi=search)
    whole = read.select(*KEYS, "place", "shift", "start", "count", g.alias("g")).select(
        *KEYS, "place", "shift", "start", "count", F.when(F.col("g.success"), F.col("g.delay").cast("bigint")).alias("whole"),
        (F.lit(1) if pairs is None else F.col("g.polarity")).alias("sign"))
    fine = read_pairs(blocks, whole.where(F.col("whole").isNotNull()), size, shift=F.col("whole") + F.col("shift"))
    s = sg.phase_slope(F.col("ref_x"), F.transform("tgt_x", lambda x: x * F.col("sign")), rate=rate)
    values = fine.select(*KEYS, "place", ((F.col("whole") + F.coalesce(s["delta"], F.lit(0.0))) * 1000 / rate).alias("ms"))
    return given.select(*KEYS).join(values.groupBy(*KEYS).agg(
        F.max_by("ms", F.abs("ms")).alias("worst_ms"), F.count("ms").alias("measured")), KEYS, "left").fillna(0, ["measured"])


def score_offsets(blocks: DataFrame, candidates: DataFrame, size: int, *, window: int, n_windows: int, search: int,
                  min_overlap: int | None = None) -> DataFrame:
    """Score candidate shifts (file, set_id, shifts array) by correlation at the predicted lag.

    Windows and pairs of a file are a fixed small number per candidate. A lag is
    scored over the part of both windows that it leaves in common, and is 0 where
    that is shorter than ``min_overlap`` (a quarter window), so every set of
    every file gets a row, however far its shifts. ``offsets`` are the median
    distances of the best lag from the predicted one, pairs in (ref, tgt) order.
    """
    least = window // 4 if min_overlap is None else min_overlap
    n = pcm.channel_lengths(blocks, CH, size)
    pairs = n.select("file_id", F.col("channel").alias("ref"), F.col("n_samples").alias("_a")).join(
        n.select("file_id", F.col("channel").alias("tgt"), F.col("n_samples").alias("_b")), "file_id").where("ref < tgt")
    both = F.least("_a", "_b")
    room = F.greatest(both - window, F.lit(0))
    ranges = pairs.withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_windows - 1).cast("bigint")))).select(
        *KEYS, "window_no", F.floor(room * F.col("window_no") / max(1, n_windows - 1)).alias("start"),
        F.least(both, F.lit(window)).cast("bigint").alias("count"))
    sets = candidates.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("set_id", "shifts"))).alias("sets"))
    lag = lambda c: F.element_at(c["shifts"], (F.col("tgt") + 1).cast("int")) - F.element_at(c["shifts"], (F.col("ref") + 1).cast("int"))
    read = read_pairs(blocks, ranges, size).join(sets, "file_id").withColumn("lags", F.transform("sets", lag))
    found = read.select(*KEYS, "window_no", F.transform("sets", lambda c: c["set_id"]).alias("ids"),
                        sg.ncc_at("ref_x", "tgt_x", "lags", search=search, least=least).alias("c"))
    rows = found.select(*KEYS, "window_no", F.explode(F.arrays_zip("ids", "c")).alias("x")).select(
        *KEYS, F.col("x.ids").alias("set_id"), F.col("x.c.*"))
    # n_windows rows per pair and set
    per = rows.groupBy(*KEYS, "set_id").agg(
        F.median(F.abs("cc")).alias("at_lag"), F.median(F.abs("best")).alias("near_lag"),
        F.avg((F.col("best") > 0).cast("double")).alias("positive"), F.median("offset").cast("bigint").alias("offset"))
    scored = per.groupBy("file_id", "set_id").agg(
        F.sum("at_lag").alias("score"), F.avg("near_lag").alias("near_score"),
        F.avg(F.greatest("positive", 1 - F.col("positive"))).alias("sign_consistency"),
        F.array_sort(F.collect_list(F.struct("ref", "tgt", "offset"))).alias("_o"))
    # a file of one channel has no pairs, its sets score 0
    return candidates.select("file_id", "set_id").join(scored, ["file_id", "set_id"], "left").select(
        "file_id", "set_id", F.coalesce("score", F.lit(0.0)).alias("score"), "near_score", "sign_consistency",
        F.transform("_o", lambda o: o["offset"]).alias("offsets"))


@F.udtf(returnType="frame_no bigint, start bigint, count bigint")
class ExplodeFrames:
    """Frames of ``n`` samples, for SQL: SELECT * FROM explode_frames(n, frame, hop)."""

    def eval(self, n: int, frame: int, hop: int):
        for k in range(max(0, (n - frame) // hop + 1) if n >= frame else 0):
            yield k, k * hop, frame
