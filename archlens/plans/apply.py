"""Applying plans to PCM blocks: shifts, verification, routing, mixing. Blocks in, blocks out."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.pcm import compare_inside, read_ranges


def apply_shifts(blocks: DataFrame, plan: DataFrame, keys: list[str], *, size: int, hop: int) -> DataFrame:
    """out[k] = in[k + shift of k's window], zero outside, same length.

    A block is cut where windows change; each piece reads the input blocks its
    shifted range touches.
    """
    first, last = F.col("block_no") * size, F.col("block_no") * size + F.size("samples") - 1
    pieces = blocks.select(*keys, F.col("block_no").alias("out_block"), first.alias("_a"), last.alias("_b")).withColumn(
        "window_no", F.explode(F.sequence(F.floor(F.col("_a") / F.lit(hop)), F.floor(F.col("_b") / F.lit(hop)))))
    begin = F.greatest(F.col("_a"), F.col("window_no") * hop)
    end = F.least(F.col("_b"), F.col("window_no") * hop + hop - 1)
    shift = F.coalesce("shift", F.lit(0))
    ranges = pieces.join(plan.select(*keys, "window_no", "shift"), [*keys, "window_no"], "left").select(
        *keys, "out_block", begin.alias("at"), (begin + shift).alias("start"), (end - begin + 1).alias("count"))
    read = read_ranges(blocks, ranges, keys, size)
    # one or two pieces per block
    ordered = F.array_sort(F.collect_list(F.struct("at", "samples")))
    return read.groupBy(*keys, "out_block").agg(F.flatten(F.transform(ordered, lambda p: p["samples"])).alias("samples")).withColumnRenamed("out_block", "block_no")


def verify_shifts(source: DataFrame, shifted: DataFrame, plan: DataFrame, keys: list[str], *, size: int, hop: int) -> DataFrame:
    """Sample-by-sample check of an applied plan, derived from the plan's side.

    Every window names the output blocks it covers and each block is compared
    with the input at the window's shift, only inside that window.
    """
    covered = plan.select(*keys, "window_no", F.coalesce("shift", F.lit(0)).alias("shift")).withColumn("block_no", F.explode(F.sequence(
        F.floor(F.col("window_no") * hop / F.lit(size)), F.floor((F.col("window_no") * hop + hop - 1) / F.lit(size)))))
    outputs = shifted.select(*keys, "block_no", F.col("samples").alias("got"))
    pairs = covered.join(outputs, [*keys, "block_no"]).withColumn("start", F.col("block_no") * size + F.col("shift")).withColumn(
        "count", F.size("got").cast("bigint")).withColumnRenamed("block_no", "out_block")
    wanted = read_ranges(source, pairs.drop("got"), keys, size, out="want")
    both = wanted.join(outputs.withColumnRenamed("block_no", "out_block"), [*keys, "out_block"])
    begin = F.col("window_no") * hop - F.col("out_block") * size
    seen = both.select(*keys, (F.col("out_block") * size).alias("_at"), compare_inside("got", "want", begin, begin + hop).alias("c"))
    rows = seen.select(*keys, "c.checked", "c.mismatches", (F.col("_at") + F.col("c.first")).alias("_first"))
    # a length can differ in the last block only
    total = source.groupBy(*keys).agg(F.sum(F.size("samples")).alias("n_samples"))
    out = rows.groupBy(*keys).agg(F.sum("checked").alias("checked"), F.sum("mismatches").alias("mismatches"), F.min("_first").alias("first_mismatch"))
    return total.join(out, keys, "left").select(*keys, "n_samples", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("mismatches", F.lit(0)).alias("mismatches"),
                                                "first_mismatch", (F.coalesce("checked", F.lit(0)) == F.col("n_samples")).alias("complete"))


def route(blocks: DataFrame, mapping: DataFrame, spans: DataFrame, *, size: int) -> DataFrame:
    """Output channels fed by one source channel each; missing blocks are silence.

    ``spans`` gives each file's block count; ``faithful`` tells real data from fill.
    """
    spine = mapping.join(spans, "file_id").withColumn("block_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
    data = blocks.select("file_id", "channel", "block_no", F.col("samples").alias("_s"))
    silence = F.array_repeat(F.lit(0.0).cast("float"), size)
    return spine.join(data, ["file_id", "channel", "block_no"], "left").select(
        "file_id", "output_index", "block_no", F.coalesce("_s", silence).alias("samples"), F.col("_s").isNotNull().alias("faithful"))


def mix(blocks: DataFrame, gains: DataFrame, *, policy: str = "detect") -> DataFrame:
    """Sum of input times gain per output channel, block by block.

    An output has a handful of inputs, so the arrays summed per block are few;
    samples never become rows. ``policy`` is detect or hard_clip.
    """
    scaled = blocks.join(gains, ["file_id", "channel"]).select(
        "file_id", "sink", "block_no", "channel", F.transform("samples", lambda x: x.cast("double") * F.col("gain")).alias("s"))
    inputs = F.transform(F.array_sort(F.collect_list(F.struct("channel", "s"))), lambda e: e["s"])
    total = F.aggregate(F.slice("_in", 2, F.size("_in")), F.col("_in")[0], lambda acc, x: F.zip_with(acc, x, lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0))))
    mixed = scaled.groupBy("file_id", "sink", "block_no").agg(inputs.alias("_in")).withColumn("raw", total)
    clipped = F.transform("raw", lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)))
    return mixed.select("file_id", "sink", "block_no", "raw", (clipped if policy == "hard_clip" else F.col("raw")).alias("samples"))


def mix_statistics(mixed: DataFrame, *, size: int, limit: float = 1.0, policy: str = "detect") -> DataFrame:
    """Peak before clipping, where it is, and clipped samples per output; ``error`` policy gives a reason."""
    level = F.transform("raw", lambda x: F.abs(x))
    rows = mixed.select("file_id", "sink", "block_no", level.alias("v")).select(
        "file_id", "sink", F.array_max("v").alias("peak"), (F.col("block_no") * size + F.array_position("v", F.array_max("v")) - 1).alias("at"),
        F.size("v").alias("n"), F.size(F.filter("v", lambda x: x > limit)).alias("clips"))
    out = rows.groupBy("file_id", "sink").agg(
        F.sum("n").alias("n_samples"), F.max("peak").alias("peak"), F.max_by("at", F.struct("peak", (-F.col("at")).alias("x"))).alias("peak_at"), F.sum("clips").alias("clip_count"))
    clipped = F.col("clip_count") > 0
    return out.withColumn("hard_clipped", F.when(F.lit(policy == "hard_clip"), F.col("clip_count")).otherwise(0).cast("bigint")).withColumn(
        "reason", F.when(F.lit(policy == "error") & clipped, "audio_mix_clipping"))
