"""Exact quantiles against plain ones: hot keys, ties, small keys, null keys, several metrics at once."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from archlens.operators.quantiles import SMALL, exact_quantiles, stacked_quantiles, upper_median

PROBS = {"a": 0.0, "b": 0.05, "c": 0.1, "d": 0.5, "e": 0.9, "f": 0.999, "g": 1.0}


@pytest.fixture(scope="module")
def rows() -> pd.DataFrame:
    rng = np.random.default_rng(1)
    n = 120_000
    key = np.where(rng.random(n) < 0.5, "hot", np.char.add("k", rng.integers(0, 60, n).astype(str))).astype(object)
    value = np.where(rng.random(n) < 0.5, rng.normal(size=n), rng.integers(0, 5, n))
    value[key == "k7"] = 3.0
    key[rng.random(n) < 0.01] = None
    edges = [("five", [5.0] * 5000), ("more", (np.arange(SMALL + 1) % 2).astype(float)),
             ("just", np.arange(SMALL).astype(float)), ("one", [2.5]), ("two", [1.0, 4.0]),
             ("steps", np.repeat([1.0, 2.0, 3.0], [2000, 16000, 2000]))]
    return pd.concat([pd.DataFrame({"k": key, "v": value}),
                      *[pd.DataFrame({"k": [k] * len(v), "v": v}) for k, v in edges]], ignore_index=True)


def test_exact_quantiles(spark, rows):
    df = spark.createDataFrame(rows).repartition(8)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", PROBS, count="n").collect()}
    groups = dict(tuple(rows.groupby(rows["k"].fillna("none"))["v"]))
    assert {k or "none" for k in got} == set(groups)
    for k, r in got.items():
        v = np.sort(groups[k or "none"].to_numpy())
        assert r.n == len(v)
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(np.quantile(v, p), abs=1e-12), (k, name)
    middle = {r.k: r.m for r in upper_median(df, ["k"], "v", "m").collect()}
    assert all(middle[k] == np.sort(groups[k or "none"].to_numpy())[len(groups[k or "none"]) // 2] for k in middle)


def test_a_hot_key_is_not_gathered(spark):
    """Only a thin slice of a large key reaches its task, whether its values differ or tie."""
    from archlens.operators import quantiles
    df = spark.range(400_000, numPartitions=8).selectExpr("'hot' AS k", "CAST(id % 300000 AS DOUBLE) AS v")
    plan = exact_quantiles(df, ["k"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 * 2  # the adaptive plan shows its initial plan too
    values = quantiles._values(df, ["k"], "v")
    low, high = values.agg(F.percentile_approx("_v", [0.5 - quantiles.REACH, 0.5 + quantiles.REACH], quantiles.ACCURACY)).first()[0]
    assert values.where((F.col("_v") > low) & (F.col("_v") < high)).count() < 0.004 * 400_000
    assert exact_quantiles(df, ["k"], "v", {"m": 0.5}).first().m == np.median(np.arange(400_000) % 300_000)


def test_stacked_quantiles(spark):
    df = spark.createDataFrame([("x", float(k), None if k % 2 else float(-k)) for k in range(101)] + [("y", None, 7.0)],
                               "k string, a double, b double")
    got = {r.k: r for r in stacked_quantiles(df, ["k"], {"a": ("a", {"a50": 0.5, "a90": 0.9}), "b": (F.abs("b"), {"b50": 0.5})},
                                             counts={"a": "n_a"}).collect()}
    assert (got["x"].a50, got["x"].a90, got["x"].b50, got["x"].n_a) == (50.0, 90.0, 50.0, 101)
    assert (got["y"].a50, got["y"].b50, got["y"].n_a) == (None, 7.0, 0)
    assert exact_quantiles(df.limit(0), ["k"], "a", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("kind", ["line", "steps", "ties", "same", "wide"])
def test_theil_sen_over_block_pairs(spark, monkeypatch, kind):
    """Exact with blocks far smaller than a key, and with few slopes taken in a round."""
    from archlens.operators import curves
    rng = np.random.default_rng(6)
    n = 700
    x = np.arange(float(n)) if kind != "ties" else np.floor(np.arange(n) / 50)
    y = {"line": 0.5 * x + rng.normal(size=n), "steps": np.round(rng.normal(size=n).cumsum()), "ties": rng.integers(0, 4, n) * 1.0,
         "same": np.where(np.arange(n) < 350, 0.0, x), "wide": rng.standard_cauchy(n) * 1e6}[kind]
    i, j = np.triu_indices(n, 1)
    apart = x[j] != x[i]
    want = float(np.median(((y[j] - y[i])[apart] / (x[j] - x[i])[apart])))
    rows = [("hot", float(a), float(b)) for a, b in zip(x, y)] + [("one", 1.0, 2.0), ("tie", 1.0, 2.0), ("tie", 1.0, 3.0),
                                                                 ("two", 1.0, 2.0), ("two", 3.0, 8.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    monkeypatch.setattr(curves, "DRAWN", 5000)
    got = {r.k: r.slope for r in curves.theil_sen(df, ["k"], block=64).collect()}
    assert got == {"hot": pytest.approx(want, abs=1e-12), "one": 0.0, "tie": 0.0, "two": 3.0}


def test_no_task_holds_a_hot_keys_points(spark):
    from archlens.operators import curves
    seen = spark.sparkContext.accumulator(0)
    whole = curves._count_pairs

    def watched(batches, keys):
        def looked():
            for batch in batches:
                for r in batch.to_pylist():
                    assert len(r["x"]) + len(r["u"]) < 400
                    seen.add(1)
                yield batch
        return whole(looked(), keys)
    curves._count_pairs = watched
    try:
        df = spark.range(2000).selectExpr("'hot' AS k", "CAST(id AS DOUBLE) AS x", "CAST(3 * id AS DOUBLE) AS y")
        assert curves.theil_sen(df, ["k"], block=128).first().slope == 3.0
    finally:
        curves._count_pairs = whole
    assert seen.value >= 16 * 17 // 2
