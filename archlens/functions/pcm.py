"""Reading sample ranges out of fixed-size PCM blocks.

A channel is rows of (keys, block_no, samples). Any stretch of samples is read
by naming the blocks it touches and joining on (keys, block_no): bounded rows,
no whole file anywhere, out-of-range samples as zero.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def read_ranges(blocks: DataFrame, ranges: DataFrame, keys: list[str], size: int, *,
                start: str = "start", count: str = "count", out: str = "samples") -> DataFrame:
    """``ranges`` plus the ``count`` samples from ``start`` of each, zero outside.

    Rows of ``ranges`` must be distinct; a range spans few blocks.
    """
    first = F.floor(F.col(start) / F.lit(size))
    last = F.floor((F.col(start) + F.col(count) - 1) / F.lit(size))
    named = ranges.withColumn("_first", first).withColumn(
        "block_no", F.explode(F.sequence(F.col("_first"), last)))
    data = blocks.select(*keys, "block_no", F.col("samples").alias("_s"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), size)
    whole = F.when(F.col("_s").isNull(), zero).when(F.size("_s") < size, F.concat(
        "_s", F.slice(zero, 1, size - F.size("_s")))).otherwise(F.col("_s"))
    joined = named.join(data, [*keys, "block_no"], "left").withColumn("_s", whole)
    columns = ranges.columns
    parts = joined.groupBy(*columns, "_first").agg(F.array_sort(F.collect_list(F.struct("block_no", "_s"))).alias("_p"))
    flat = F.flatten(F.transform("_p", lambda p: p["_s"]))
    at = (F.col(start) - F.col("_first") * size + 1).cast("int")
    return parts.select(*columns, F.slice(flat, at, F.col(count).cast("int")).alias(out))


def channel_lengths(blocks: DataFrame, keys: list[str], size: int) -> DataFrame:
    last = F.max_by(F.size("samples"), "block_no")
    return blocks.groupBy(*keys).agg((F.max("block_no") * size + last).cast("bigint").alias("n_samples"))


def frame_ranges(lengths: DataFrame, frame: int, hop: int) -> DataFrame:
    """Frame k covers [k * hop, k * hop + frame); only whole frames."""
    count = F.floor((F.col("n_samples") - frame) / F.lit(hop)) + 1
    long = lengths.where(F.col("n_samples") >= frame)
    return long.withColumn("frame_no", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1))).select(
        *[c for c in lengths.columns if c != "n_samples"], "frame_no",
        (F.col("frame_no") * hop).alias("start"), F.lit(frame).cast("bigint").alias("count"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def compare_inside(got: Column | str, want: Column | str, begin: Column, end: Column) -> Column:
    """Places from ``begin`` to before ``end`` of two sample arrays: how many, how many differ, the first that does.

    Two missing samples (null or not a number) are equal; a sample missing on one side only differs.
    """
    kind = T.StructType([T.StructField(n, T.LongType()) for n in ("checked", "mismatches", "first")])

    @F.pandas_udf(kind)
    def run(gots: pd.Series, wants: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for g, w, lo, hi in zip(gots, wants, begins, ends):
            lo, hi = max(0, int(lo)), min(len(g), int(hi))
            if lo >= hi:
                out.append((0, 0, None))
                continue
            g, w = np.asarray(g[lo:hi], np.float32), np.asarray(w[lo:hi], np.float32)
            differ = np.flatnonzero((g != w) & ~(np.isnan(g) & np.isnan(w)))
            out.append((hi - lo, len(differ), lo + int(differ[0]) if len(differ) else None))
        return pd.DataFrame(out, columns=["checked", "mismatches", "first"]).astype("Int64")
    return run(got, want, begin, end)
