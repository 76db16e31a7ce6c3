"""Running totals over a global order, from per-partition totals.

Rows are range partitioned by the order and written once, so that every later
step sees the same partitions. Each partition's totals (one row a partition)
are scanned, and the scan inside a partition starts from its partition's offset.
No task holds more than one range of rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from archlens.session import cut_lineage


def running(df: DataFrame, order: list[Column], sums: dict[str, str] | None = None,
            maxes: dict[str, str] | None = None, totals: dict[str, str] | None = None) -> DataFrame:
    """``df`` plus one column per entry of ``sums`` / ``maxes`` ({new: column}) over the rows
    before the row in ``order``: their sum (0 before the first) or their maximum (null).
    ``totals`` ({new: column}) adds sums over all rows.

    Ties keep one fixed order of their own. A null adds nothing. The columns
    ``__part`` and ``__row`` are reserved.
    """
    sums, maxes, totals = sums or {}, maxes or {}, totals or {}
    # the last key splits a range of rows that tie in every given one
    dealt = df.withColumns({"__row": F.monotonically_increasing_id()})
    dealt = (dealt.repartitionByRange(*order, F.col("__row").asc())
             .withColumn("__part", F.spark_partition_id()))
    fixed = cut_lineage(dealt)
    parts = fixed.groupBy("__part").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"__s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"__m_{n}") for n, c in maxes.items()],
        *[F.sum(c).alias(f"__t_{n}") for n, c in totals.items()])
    # one row per partition, so this single window is bounded by the partition count
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = parts.select(
        "__part",
        *[F.coalesce(F.sum(f"__s_{n}").over(ahead), F.lit(0)).alias(f"__s_{n}") for n in sums],
        *[F.max(f"__m_{n}").over(ahead).alias(f"__m_{n}") for n in maxes],
        *[F.sum(f"__t_{n}").over(everything).alias(n) for n in totals])
    inside = (Window.partitionBy("__part").orderBy(*order, F.col("__row").asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    return (fixed.join(F.broadcast(offsets), "__part")
            .withColumns({n: F.col(f"__s_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
                          for n, c in sums.items()}
                         | {n: F.greatest(F.col(f"__m_{n}"), F.max(c).over(inside))
                            for n, c in maxes.items()})
            .drop("__part", "__row", *[f"__s_{n}" for n in sums], *[f"__m_{n}" for n in maxes]))
