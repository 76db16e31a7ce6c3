"""Ordered operators that never put one whole key into one task.

A plain window partitioned by a key sends every row of a hot key to a single
task. Here an ordered key is cut into position blocks: the window runs inside
(key, block), one summary row per block is scanned per key, and what the
earlier blocks contribute is joined back on (key, block). The same form serves
keys of any size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


BLOCK = 65536


def _blocked(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn("_blk", F.floor(F.col(pos) / F.lit(size)))


def carry(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, *,
          size: int = BLOCK, forward: bool = True, strict: bool = False,
          ties: list[str] = ()) -> DataFrame:
    """Nearest non-null ``value`` at or before each row (after, if not forward).

    ``strict`` leaves the row itself out. ``value`` may be a struct.
    """
    return carry_all(df, keys, pos, {out: (value, forward, strict)}, size=size, ties=ties)


def carry_all(df: DataFrame, keys: list[str], pos: str, wanted: dict[str, tuple[Column, bool, bool]], *,
              size: int = BLOCK, ties: list[str] = ()) -> DataFrame:
    """:func:`carry` of several values in one pass: column name to (value, forward, strict)."""
    names = {out: (f"_val{i}", f"_in{i}", f"_carried{i}") for i, out in enumerate(wanted)}
    blocked = _blocked(df.withColumns({names[out][0]: value for out, (value, _, _) in wanted.items()}), pos, size)
    edges, across, inside = [], [], {}
    for out, (_, forward, strict) in wanted.items():
        val, inner, carried = names[out]
        order = [F.col(c) if forward else F.col(c).desc() for c in [pos, *ties]]
        rows = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
        blocks = W.partitionBy(*keys).orderBy(
            F.col("_blk") if forward else F.col("_blk").desc()).rowsBetween(W.unboundedPreceding, -1)
        pick = F.max_by if forward else F.min_by
        # every block that holds rows gets an entry, null where it holds no value
        edges.append(pick(val, F.when(F.col(val).isNotNull(), F.struct(pos, *ties))).alias(carried))
        across.append(F.last(carried, ignorenulls=True).over(blocks).alias(carried))
        inside[inner] = F.last(val, ignorenulls=True).over(rows)
    passed = blocked.groupBy(*keys, "_blk").agg(*edges).select(*keys, "_blk", *across)
    return (
        blocked.withColumns(inside)
        .join(passed, [*keys, "_blk"], "left")
        .withColumns({out: F.coalesce(inner, carried) for out, (_, inner, carried) in names.items()})
        .drop("_blk", *[c for made in names.values() for c in made])
    )


def running_sum(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, *,
                size: int = BLOCK, ties: list[str] = ()) -> DataFrame:
    """Inclusive running sum of ``value`` in ``pos`` order."""
    blocked = _blocked(df.withColumn("_val", value), pos, size)
    inside = W.partitionBy(*keys, "_blk").orderBy(pos, *ties).rowsBetween(
        W.unboundedPreceding, 0)
    across = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy(*keys, "_blk").agg(F.sum("_val").alias("_s"))
        .select(*keys, "_blk", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_off"))
    )
    return (
        blocked.withColumn("_in", F.sum("_val").over(inside))
        .join(offsets, [*keys, "_blk"])
        .withColumn(out, F.coalesce(F.col("_in"), F.lit(0)) + F.col("_off"))
        .drop("_val", "_blk", "_in", "_off")
    )


def running_max(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, *,
                size: int = BLOCK, ties: list[str] = ()) -> DataFrame:
    """Largest ``value`` strictly before each row in ``pos`` order."""
    blocked = _blocked(df.withColumn("_val", value), pos, size)
    inside = W.partitionBy(*keys, "_blk").orderBy(pos, *ties).rowsBetween(
        W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    tops = (
        blocked.groupBy(*keys, "_blk").agg(F.max("_val").alias("_m"))
        .select(*keys, "_blk", F.max("_m").over(across).alias("_top"))
    )
    return (
        blocked.withColumn("_in", F.max("_val").over(inside))
        .join(tops, [*keys, "_blk"])
        .withColumn(out, F.greatest("_in", "_top"))
        .drop("_val", "_blk", "_in", "_top")
    )


def neighbours(df: DataFrame, keys: list[str], pos: str, reach: int, *,
               size: int = BLOCK):
    """Block ``df`` with a halo of ``reach`` positions on each side.

    For dense integer positions. Returns the widened rows, the window
    specification to use and the condition that keeps each row once.
    """
    p, step = F.col(pos), F.lit(size)
    home = F.floor(p / step)
    offset = p - home * step
    blocks = F.array_compact(F.array(
        home,
        F.when(offset < reach, home - 1),
        F.when(offset >= size - reach, home + 1)))
    wide = (df.withColumn("_home", home)
            .withColumn("_blk", F.explode(blocks)))
    return wide, W.partitionBy(*keys, "_blk").orderBy(pos), F.col("_home") == F.col("_blk")


def runs(df: DataFrame, keys: list[str], pos: str, flag: Column, *,
         size: int = BLOCK) -> DataFrame:
    """Maximal runs of equal ``flag``: one row (keys, flag, start, end, length).

    Position must be dense. A run's identity is the last position at which the
    flag changed, carried across blocks.
    """
    flagged = df.select(*keys, pos, flag.alias("flag"))
    wide, window, keep = neighbours(flagged, keys, pos, 1, size=size)
    marked = (
        wide.withColumn("_prev", F.lag("flag").over(window)).where(keep)
        .select(*keys, pos, "flag",
                F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("flag")),
                       F.col(pos)).alias("_start"))
    )
    named = carry(marked, keys, pos, F.col("_start"), "run_start",
                  size=size)
    return named.groupBy(*keys, "flag", "run_start").agg(
        F.max(pos).alias("run_end"), F.count(F.lit(1)).alias("run_length"))
