"""Exact interpolated quantiles that hold under skew, in two exchanges.

A mergeable sketch per key gives, for every wanted quantile, two values that
surely enclose it; the second pass counts what lies below them and gathers only
the thin slice between, so a key's rows are counted where they are and never
ordered together. Small keys are gathered whole. Results equal
linear-interpolation percentiles exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000   # the sketch is wrong by a share of 1 / ACCURACY of a key's rows at most
REACH = 0.001       # the enclosing values are quantiles so much lower and higher
BINS_PER_UNIT, FINE = 1024, 4096
SMALL = 4096        # keys up to here are gathered whole; beyond, REACH is several ranks


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column,
                    probs: dict[str, float], *, count: str | None = None,
                    bounded: bool = False) -> DataFrame:
    """One row per key: the named quantiles of the non-null ``value``s.

    ``bounded``: the caller's groups have a fixed largest size (the frames of
    one window, a drawn set), so one task takes a group whole.
    """
    values = _values(df, keys, value)
    if bounded:
        wanted = F.percentile("_v", F.array(*[F.lit(p) for p in probs.values()]))
        out = values.groupBy(*keys).agg(wanted.alias("_q"), F.count(F.lit(1)).alias("_n"))
        return out.select(
            *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)],
            *([F.col("_n").alias(count)] if count else []))
    n = F.col("_n") - 1
    return _at_ranks(values, keys, {name: (p, F.lit(p) * n) for name, p in probs.items()}, count)


def stacked_quantiles(df: DataFrame, keys: list[str], metrics: dict[str, tuple[str | Column, dict[str, float]]],
                      *, counts: dict[str, str] | None = None) -> DataFrame:
    """One row per key with any value: quantiles of several values of the same rows, in one pass.

    ``metrics``: {metric: (value, {name: probability})}; ``counts``: {metric: name} adds
    how many values a metric has.
    """
    counts = counts or {}
    cells = [F.struct(F.lit(m).alias("_m"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("_v"))
             for m, (v, _) in metrics.items()]
    long = df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c._m", "_c._v")
    every = sorted({p for _, probs in metrics.values() for p in probs.values()})
    found = exact_quantiles(long, [*keys, "_m"], "_v", {f"_q{k}": p for k, p in enumerate(every)}, count="_n")
    picks = [F.max(F.when(F.col("_m") == m, F.col(f"_q{every.index(p)}"))).alias(name)
             for m, (_, probs) in metrics.items() for name, p in probs.items()]
    picks += [F.coalesce(F.max(F.when(F.col("_m") == m, F.col("_n"))), F.lit(0)).alias(name) for m, name in counts.items()]
    return found.groupBy(*keys).agg(*picks)


def _fine_bin(value: Column) -> Column:
    """A bin number that does not fall as ``value`` rises, fine at every magnitude; the tests look at values by it."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(BINS_PER_UNIT * FINE))


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The middle value, or the upper of the two middle ones."""
    return _at_ranks(_values(df, keys, value), keys, {out: (0.5, F.floor(F.col("_n") / 2))}, None)


def _values(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    column = F.col(value) if isinstance(value, str) else value
    return df.select(*keys, column.cast("double").alias("_v")).where(F.col("_v").isNotNull())


def _at_ranks(values: DataFrame, keys: list[str], ranks: dict[str, tuple[float, Column]],
              count: str | None) -> DataFrame:
    """Values at (possibly fractional) 0-based ranks, each near its probability."""
    probs = sorted({p for p, _ in ranks.values()})
    asked = [min(1.0, max(0.0, p + by)) for p in probs for by in (-REACH, REACH)]
    sketch = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                       F.percentile_approx("_v", asked, ACCURACY).alias("_s"))
    # a null key is a key
    named = sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", "_s")
    same = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = test if same is None else same & test
    placed = values.join(named, same)
    v, whole = F.col("_v"), F.col("_n") <= SMALL
    parts = [F.first("_n").alias("_n"), F.first("_s").alias("_s"), F.collect_list(F.when(whole, v)).alias("_all")]
    for k in range(len(probs)):
        low, high = F.col("_s")[2 * k], F.col("_s")[2 * k + 1]
        parts += [F.count_if(v < low).alias(f"_under{k}"), F.count_if(v == low).alias(f"_low{k}"),
                  F.collect_list(F.when(~whole & (v > low) & (v < high), v)).alias(f"_in{k}")]
    found = placed.groupBy(*keys).agg(*parts)
    found = found.select(*keys, "_n", "_s", F.array_sort("_all").alias("_all"), *[
        c for k in range(len(probs)) for c in (f"_under{k}", f"_low{k}", F.array_sort(f"_in{k}").alias(f"_in{k}"))])

    def at(rank: Column, k: int) -> Column:
        here = rank - F.col(f"_under{k}") - F.col(f"_low{k}")
        near = (F.when(here < 0, F.col("_s")[2 * k])
                .when(here < F.size(f"_in{k}"), F.get(F.col(f"_in{k}"), here.cast("int")))
                .otherwise(F.col("_s")[2 * k + 1]))
        return F.when(F.col("_n") <= SMALL, F.get(F.col("_all"), rank.cast("int"))).otherwise(near)

    cols = []
    for name, (p, rank) in ranks.items():
        low, high = at(F.floor(rank), probs.index(p)), at(F.ceil(rank), probs.index(p))
        cols.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    if count:
        cols.append(F.col("_n").alias(count))
    return found.select(*keys, *cols)
