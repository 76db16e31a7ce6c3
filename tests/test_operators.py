"""Brute-force checks of operators that SQL cannot state, and hot-key behaviour."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from archlens.operators import curves as c, decide as d, ordered as o, windows as w
from archlens.operators.quantiles import exact_quantiles


def hot_rows(n=600):
    """Two thirds of the rows in one key, with repeated and extreme values."""
    rng = np.random.default_rng(7)
    key = np.where(rng.random(n) < 0.66, 1, rng.integers(2, 9, n))
    value = np.round(rng.normal(0, 50, n), 1)
    value[rng.random(n) < 0.1] = 1000.0
    value[0] = -1e12
    return [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(key, value))]


def test_quantiles(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k bigint, i bigint, v double").repartition(5)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.05, "m": 0.5, "z": 0.95, "t": 1.0}, count="n").collect()}
    for k in {r[0] for r in rows}:
        v = [r[2] for r in rows if r[0] == k]
        np.testing.assert_allclose([got[k].a, got[k].b, got[k].m, got[k].z, got[k].t], np.quantile(v, [0, 0.05, 0.5, 0.95, 1]))
        assert got[k].n == len(v)


def test_quantiles_split_close_values(spark):
    """200,000 values within 0.02 % of each other under one key: no task orders many of them."""
    df = spark.range(200_000).selectExpr("1L AS k", "1000 + pmod(id * 7919, 200000) * 1e-6 AS v")
    from archlens.operators import quantiles as q
    largest = df.groupBy("k", q._fine_bin(F.col("v")).alias("b")).count().agg(F.max("count")).first()[0]
    assert largest < 1000
    got = exact_quantiles(df, ["k"], "v", {"p": 0.25, "m": 0.5}).first()
    np.testing.assert_allclose([got.p, got.m], [1000 + 199999e-6 * 0.25, 1000 + 199999e-6 * 0.5], atol=1e-9)


def test_median_slope_of_many_points(monkeypatch):
    rng = np.random.default_rng(2)
    for n, ties in ((0, False), (1, False), (2, False), (30, True), (500, False), (500, True), (500, "two"), (401, "two")):
        x, y = np.arange(float(n)), rng.normal(size=n).cumsum()
        y = np.where(np.arange(n) < n // 2, 0.0, np.arange(n) * 1.0) if ties == "two" else np.round(y) if ties else y
        i, j = np.triu_indices(n, 1)
        want = float(np.median((y[j] - y[i]) / (x[j] - x[i]))) if n > 1 else 0.0
        for at_once in (c.SLOPES_AT_ONCE, 3000):
            monkeypatch.setattr(c, "SLOPES_AT_ONCE", at_once)
            assert abs(c.median_slope(x, y) - want) < 1e-12
        monkeypatch.undo()


def test_ordered_operators(spark):
    rows = [(k, i, None if i % 3 else v) for k, i, v in hot_rows()]
    df = spark.createDataFrame(rows, "k bigint, i bigint, v double").repartition(5)
    out = o.carry(df, ["k"], "i", F.col("v"), "prev", size=16, strict=True)
    out = o.carry(out, ["k"], "i", F.col("v"), "next", size=16, forward=False)
    out = o.running_sum(out, ["k"], "i", F.lit(1), "n", size=16)
    out = o.running_max(out, ["k"], "i", F.col("v"), "top", size=16)
    got = {r.i: r for r in out.collect()}
    for k in {r[0] for r in rows}:
        seq = [r for r in rows if r[0] == k]
        for at, (_, i, v) in enumerate(seq):
            before = [x[2] for x in seq[:at] if x[2] is not None]
            after = [x[2] for x in seq[at:] if x[2] is not None]
            assert got[i].prev == (before[-1] if before else None)
            assert got[i].next == (after[0] if after else None)
            assert got[i].n == at + 1 and got[i].top == (max(before) if before else None)


def test_runs_across_blocks(spark):
    flags = [1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    df = spark.createDataFrame([(1, i, bool(f)) for i, f in enumerate(flags)], "k bigint, i bigint, f boolean")
    got = sorted(tuple(r) for r in o.runs(df, ["k"], "i", F.col("f"), size=4).select("run_start", "run_length", "flag").collect())
    assert got == [(0, 2, True), (2, 3, False), (5, 1, True), (6, 13, False), (19, 1, True)]


def test_merge_intervals(spark):
    rows = [(1, 0, 10), (1, 10, 5), (1, 17, 3), (1, 40, 0), (1, 2, 3), (1, 2, 3), (1, 100, 50), (1, 120, 5)]
    df = spark.createDataFrame(rows, "k bigint, start bigint, count bigint")
    merged = lambda gap: sorted((r.start, r["count"]) for r in w.merge_intervals(df, ["k"], gap, size=8).collect())
    assert merged(0) == [(0, 15), (17, 3), (100, 50)]
    assert merged(2) == [(0, 20), (100, 50)]


def test_clamp_jumps(spark):
    y = [0.0, 100.0, 10.0, -500.0, 20.0, 21.0]
    df = spark.createDataFrame([(1, i, len(y), v) for i, v in enumerate(y)], "k bigint, idx bigint, n bigint, y double")
    want = [y[0]]
    for v in y[1:]:
        want.append(min(max(v, want[-1] - 30), want[-1] + 30))
    got = c.clamp_jumps(df, ["k"], 30.0, adaptive=False).orderBy("idx").collect()
    assert [r.y for r in got] == want
    chunked = c.clamp_jumps(df, ["k"], 30.0, adaptive=False, chunk=2).orderBy("idx").collect()
    assert [r.y for r in chunked] == want
    steep = spark.createDataFrame([(1, i, 6, i * 90.0) for i in range(6)], "k bigint, idx bigint, n bigint, y double")
    assert [r.y for r in c.clamp_jumps(steep, ["k"]).orderBy("idx").collect()] == [i * 90.0 for i in range(6)]


def test_theil_sen_exact_and_drawn(spark):
    rng = np.random.default_rng(3)
    few = [(1, i, 60, float(i), 2.0 * i + rng.normal()) for i in range(60)]
    many = [(2, i, 900, float(i), -0.5 * i + rng.normal()) for i in range(900)]
    df = spark.createDataFrame(few + many, "k bigint, idx bigint, n bigint, x double, y double")
    got = {r.k: r.slope for r in c.theil_sen(df, ["k"]).collect()}
    want = np.median([(few[j][4] - few[i][4]) / (j - i) for i in range(60) for j in range(i + 1, 60)])
    assert got[1] == pytest.approx(want) and got[2] == pytest.approx(-0.5, abs=0.01)
    assert got == {r.k: r.slope for r in c.theil_sen(df.repartition(7), ["k"]).collect()}


def _halve(t, y, a, b, min_seg, limit):
    mid = (a + b) // 2
    if b - a < 8 or t[mid] - t[a] < min_seg or t[b - 1] - t[mid] < min_seg or abs(np.median(y[a:mid]) - np.median(y[mid:b])) <= limit:
        return [(a, b)]
    return _halve(t, y, a, mid, min_seg, limit) + _halve(t, y, mid, b, min_seg, limit)


def test_piecewise_segments(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(3):
        n = 200 if k == 0 else 40
        t = np.sort(rng.choice(100_000, n, replace=False))
        y = np.round(np.repeat(rng.normal(0, 200, 4), n // 4) + rng.normal(0, 3, n), 2)
        segs = _halve(t, y, 0, n, 500, 48)
        med = [np.median(y[a:b]) for a, b in segs]
        resid = np.concatenate([np.abs(y[a:b] - m) for (a, b), m in zip(segs, med)])
        seams = np.abs(np.diff(med))
        want[k] = (len(segs), np.percentile(resid, 50), int((seams > 48).sum()))
        rows += [(k, 0, 1, i, int(ti), float(yi)) for i, (ti, yi) in enumerate(zip(t, y))]
    df = spark.createDataFrame(rows, "file_id bigint, ref bigint, tgt bigint, frame_no bigint, center_sample bigint, delay_samples double")
    for r in c.piecewise_segments(df, min_seg=500, threshold=48.0).collect():
        segs, p50, seam = want[r.file_id]
        assert r.segments == segs and r.residual_p50 == pytest.approx(p50) and r.seam_gt_48 == seam


def test_separated_modes(spark):
    rows = [(1, v, q) for v, q in ((10, 5.0), (11, 4.0), (14, 3.0), (30, 2.0), (31, 1.0), (90, 0.5))]
    df = spark.createDataFrame(rows, "k bigint, delay bigint, quality double")
    got = [(r.delay, r.weight) for r in c.separated_modes(df, ["k"]).orderBy("place").collect()]
    assert got == [(10, 9.0), (14, 3.0), (30, 3.0)]


def test_solve_offsets_drops_the_odd_pair(spark):
    true = [0, 120, -45, 300]
    rows = [(1, a, b, float(true[b] - true[a]), 5.0) for a in range(4) for b in range(a + 1, 4)]
    rows[4] = (1, 1, 3, 500.0, 1.0)
    df = spark.createDataFrame(rows, "file_id bigint, a bigint, b bigint, delay double, weight double")
    got = d.solve_offsets(df).orderBy("channel").collect()
    base = got[0].shift
    assert [r.shift - base for r in got] == true and {r.dropped for r in got} == {1} and {r.cost for r in got} == {0.0}


def _solved_alone(p, anchor, channels):
    """One file against one anchor by the plain loop."""
    live = list(range(len(p)))
    for _ in range(6):
        if not live:
            return None
        m = np.zeros((len(live), len(channels)))
        for i, k in enumerate(live):
            m[i, channels.index(p[k][1])] += 1
            m[i, channels.index(p[k][0])] -= 1
        w, y = np.array([p[k][3] for k in live]), np.array([p[k][2] for k in live])
        at = channels.index(anchor)
        x = np.linalg.lstsq(np.delete(m, at, axis=1) * w[:, None], y * w, rcond=None)[0]
        shift = np.insert(np.rint(x), at, 0.0)
        miss = m @ shift - y
        if np.abs(miss).max() <= 2.0:
            return (float(miss @ miss), [int(v) for v in shift], len(p) - len(live)) if np.abs(shift).max() <= 4816 else None
        del live[np.abs(miss).argmax()]
    return None


def test_files_solved_together_equal_each_alone(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for f in range(300):
        n = int(rng.integers(2, 7))
        every = [(a, b) for a in range(0, 2 * n, 2) for b in range(a + 2, 2 * n, 2)]  # channels need not be dense
        some = sorted(every[i] for i in rng.choice(len(every), int(rng.integers(1, len(every) + 1)), replace=False))
        far = 5000.0 if f % 50 == 0 else 0.0
        p = [(a, b, (b - a) * 3.5 + far + (40.0 if rng.random() < 0.25 else 0.0), float(rng.integers(1, 6))) for a, b in some]
        channels = sorted({c for a, b in some for c in (a, b)})
        tried = [(*got, c) for c in channels if (got := _solved_alone(p, c, channels)) is not None]
        cost, shift, dropped, anchor = min(tried, key=lambda t: t[0]) if tried else (None, [None] * len(channels), None, None)
        want |= {(f, c): (anchor, v, cost, dropped, None if tried else "no consistent shifts") for c, v in zip(channels, shift)}
        rows += [(f, *r) for r in p]
    df = spark.createDataFrame(rows, "file_id bigint, a bigint, b bigint, delay double, weight double")
    got = {(r.file_id, r.channel): (r.anchor, r.shift, r.cost, r.dropped, r.reason) for r in d.solve_offsets(df).collect()}
    assert got == want and {w[4] for w in want.values()} == {None, "no consistent shifts"}
    # 2,000 files of a shape are one call to the solver a round, not one a file, anchor and round
    calls, plain = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda *x, **k: calls.append(1) or plain(*x, **k))
    monkeypatch.setattr(np.linalg, "lstsq", lambda *x, **k: calls.append(1) or pytest.fail("solved alone"))
    ends = np.tile([[0, 0, 1], [1, 2, 2]], (2000, 1, 1))
    delay = np.tile([120.0, 75.0, 300.0], (2000, 1))
    anchor, cost, dropped, shifts = d.solve_files(ends[:, 0], ends[:, 1], delay, np.ones((2000, 3)) + np.arange(3), 3, 6, 2.0, 4816)
    assert len(calls) <= 6 and (dropped == 1).all() and (anchor >= 0).all() and shifts.shape == (2000, 3)


def test_bind_pairs_takes_the_strongest_disjoint(spark):
    rows = [(1, 0, 1, 2.0, True), (1, 1, 2, 1.9, True), (1, 2, 3, 1.8, True), (1, 0, 3, 1.7, True), (2, 0, 1, 2.0, False)]
    df = spark.createDataFrame(rows, "file_id bigint, a bigint, b bigint, median double, rigid boolean")
    assert sorted((r.file_id, r.a, r.b) for r in d.bind_pairs(df).collect()) == [(1, 0, 1), (1, 2, 3)]


def test_rigid_pairs(spark):
    rows = [(1, 0, 1, True, 10.0 + i % 3, 0.95) for i in range(20)] + [(1, 2, 3, True, 10.0 * i, 0.95) for i in range(20)]
    win = spark.createDataFrame(rows, "file_id bigint, a bigint, b bigint, valid boolean, delay_samples double, signed_cc double")
    strong = spark.createDataFrame([(1, 0, 1, 1.8), (1, 2, 3, 1.7)], "file_id bigint, a bigint, b bigint, median double")
    strong = strong.withColumn("samples", F.lit(20))
    assert {(r.a, r.b): r.rigid for r in d.rigid_pairs(win, strong).collect()} == {(0, 1): True, (2, 3): False}
    assert d.rigid_pairs(win, strong, min_samples=21).count() == 0
    kinds = win.select("file_id").distinct().selectExpr("file_id", "explode(array(0L, 1L, 2L, 3L)) AS channel").selectExpr(
        "*", "CASE WHEN channel = 1 THEN 's16' ELSE 's24' END AS storage")
    got = {(r.a, r.b): (r.rigid, r.reason) for r in d.rigid_pairs(win, strong, storages=kinds).collect()}
    assert got == {(0, 1): (False, "storage_dtype_mismatch"), (2, 3): (False, None)}


def test_bound_channels_follow_their_speaker(spark):
    rows = [(1, 0, 0, None, None, None), (1, 1, 0, "fixed", None, 9), (1, 2, 0, "already_aligned", None, 2), (1, 3, 0, "fixed", None, 40),
            (2, 0, 0, None, None, None), (2, 1, 0, "non_constant", "non_constant", None), (2, 2, 0, "fixed", None, 7),
            (3, 0, 2, None, "uncorrelated", None), (3, 1, 2, "fixed", "out_of_range", 99), (3, 2, 2, None, None, None), (3, 3, 2, "fixed", None, 5),
            (4, 0, 0, None, None, None), (4, 1, 0, "fixed", None, 6), (4, 2, 0, None, "low_confidence", None)]
    tracks = spark.createDataFrame(rows, "file_id long, channel long, anchor long, outcome string, reason string, shift_samples long")
    pairs = spark.createDataFrame([(1, 0, 1), (1, 2, 3), (2, 1, 2), (3, 0, 2), (3, 1, 3), (4, 1, 2)], "file_id long, a long, b long")
    got = {(r.file_id, r.channel): (r.outcome, r.reason, r.shift_samples, r.bound_to) for r in d.follow_bound(tracks, pairs).collect()}
    assert len(got) == len(rows)
    assert got[1, 0] == (None, None, None, 0) and got[1, 1] == ("already_aligned", None, None, 0)
    assert got[1, 2] == ("already_aligned", None, None, 2) and got[1, 3] == ("already_aligned", None, None, 2)
    # a speaker that is not settled moves nothing
    assert got[2, 1] == ("non_constant", "non_constant", None, None) and got[2, 2] == ("fixed", None, 7, None)
    # the anchor speaks even if it is the higher channel; an unsettled lower one does not speak for a fixed one
    assert got[3, 0] == ("already_aligned", None, None, 2) and got[3, 2] == (None, None, None, 2)
    assert got[3, 1] == ("fixed", "out_of_range", 99, None) and got[3, 3] == ("fixed", None, 5, None)
    assert got[4, 1] == ("fixed", None, 6, 1) and got[4, 2] == ("fixed", None, 6, 1)
    # no pair at all: nothing changes
    none = {(r.file_id, r.channel): (r.outcome, r.reason, r.shift_samples) for r in d.follow_bound(tracks, pairs.where("a < 0")).collect()}
    assert none == {(r[0], r[1]): (r[3], r[4], r[5]) for r in rows}


def test_robust_line_ignores_outliers(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(t), 5 + 0.25 * t + rng.normal(0, 0.3) if i % 4 else rng.uniform(-500, 500), 1.0) for i, t in enumerate(range(0, 2000, 7))]
    df = spark.createDataFrame(rows, "k bigint, t double, y double, w double")
    a = d.robust_lines(df, ["k"]).first()
    assert a.slope == pytest.approx(0.25, abs=1e-3) and a.intercept == pytest.approx(5, abs=0.5) and a.r_max <= 4
    assert a.n_inliers == d.robust_lines(df.repartition(6), ["k"]).first().n_inliers


def test_connected_groups_long_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node bigint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(25)] + [(30, 31)], "a bigint, b bigint")
    got = {r.node: r.label for r in d.connected_groups(nodes, edges).collect()}
    assert {got[i] for i in range(26)} == {0} and got[31] == 30 and got[35] == 35


def test_connected_groups_move_only_what_is_linked(spark, monkeypatch):
    """Rounds read linked nodes alone, and a long path takes few of them."""
    written = []
    keep = d.cut_lineage
    monkeypatch.setattr(d, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    nodes = spark.range(20000).select(F.col("id").alias("node")).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    path = [(i, i + 1) for i in range(100, 600)]
    star = [(7000, i) for i in range(7001, 7100)] + [(50000, 7050), (5, 5), (9, None)]  # an end that the nodes lack; links that are none
    edges = spark.createDataFrame(path * 2 + star, "a bigint, b bigint")
    got = {r.node: r.label for r in d.connected_groups(nodes, edges).collect()}
    assert len(got) == 20002 and got[None] is None and got[5] == 5 and got[9] == 9 and got[50000] == 7000
    assert {got[i] for i in range(100, 601)} == {100} and {got[i] for i in range(7000, 7100)} == {7000}
    assert sum(k == v for k, v in got.items() if k is not None) == 20002 - 1 - 500 - 100
    assert sum(df.count() for df in written) < 20000 // 2 and len(written) < 50


def test_file_groups_equal_the_global_form(spark):
    rng = np.random.default_rng(5)
    tracks = [(f, t, int(rng.integers(0, 3)) if rng.random() < 0.6 else None) for f in range(60) for t in range(8) if rng.random() < 0.8]
    links = [(f, int(rng.integers(8)), int(rng.integers(8))) for f in range(60) for _ in range(int(rng.integers(6)))]
    links += [(99, i, i + 1) for i in (6, 4, 2, 0, 1, 3, 5)] + [(98, 3, 3)]  # a path through all tracks; a link to itself names no track
    nodes = spark.createDataFrame(tracks, "file_id bigint, track bigint, place bigint")
    edges = spark.createDataFrame(links * 2, "file_id bigint, a bigint, b bigint")
    found = d.file_groups(nodes, edges)
    members = found.selectExpr("file_id", "explode(groups) AS g").selectExpr("file_id", "g.label", "g.anchor", "explode(g.members) AS track").collect()
    node = lambda f, t: F.expr(f"{f} * 8 + {t}")
    flat = edges.where("a <> b").select(node("file_id", "a").alias("a"), node("file_id", "b").alias("b"))
    all_nodes = nodes.select(node("file_id", "track").alias("node")).union(flat.select("a")).union(flat.select("b"))
    want = {r.node: r.label for r in d.connected_groups(all_nodes, flat).collect()}
    assert {r.file_id * 8 + r.track: r.file_id * 8 + r.label for r in members} == want
    places = {(f, t): p for f, t, p in tracks}
    for key in {(r.file_id, r.label) for r in members}:
        of = [r for r in members if (r.file_id, r.label) == key]
        order = lambda t: (1 << 30 if places.get((key[0], t)) is None else places[key[0], t], t)
        assert {r.anchor for r in of} == {min((r.track for r in of), key=order)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(Exception, match="track out of range"):
        d.file_groups(spark.createDataFrame([(1, 8)], "file_id bigint, track bigint"), edges).collect()
    assert d.file_groups(nodes.limit(0), edges.limit(0)).count() == 0


def test_grid_and_constant_curve(spark):
    df = spark.createDataFrame([(1, 2.5, 10.0), (1, 6.0, 17.0), (2, 0.0, 3.0)], "k bigint, t_sec double, y double")
    out = c.on_grid(df, ["k"], 9)
    got = [r.y for r in out.where("k = 1").orderBy("t_sec").collect()]
    np.testing.assert_allclose(got, np.interp(np.arange(9), [2.5, 6.0], [10.0, 17.0]))
    assert [r.y for r in out.where("k = 2").collect()] == [3.0] * 9


def test_sum_of_curves(spark):
    """Against interpolation by NumPy: equal times, points beyond the grid, no residual, one point, refused keys."""
    first = {1: [(2.5, 10.0), (6.0, 17.0), (8.0, -4.0)], 2: [(0.0, 3.0)], 3: [(-4.0, 1.0), (3.25, 9.0), (30.0, 2.0)],
             4: [(1.0, 5.0), (7.0, 600.0)], 5: [(12.0, 1.0), (40.0, 3.0)], 6: [(4.0, 480.0)]}
    second = {1: [(1.25, 2.0), (6.0, 8.0), (6.5, 1.0)], 3: [(3.25, -7.0), (11.75, 4.0)], 4: [(2.0, 1.0)], 5: [(-9.0, 2.0), (-1.5, 6.0)],
              6: [(4.0, 0.0)], 9: [(1.0, 1.0)]}
    table = lambda curve: spark.createDataFrame([(k, t, y) for k, points in curve.items() for t, y in points], "k bigint, t_sec double, y double")
    got = {}
    for r in c.add_curves(table(first), table(second), ["k"], 15, gain=10).collect():
        got.setdefault(r.k, []).append((r.t_sec, r.y))
    grid = np.arange(15)
    want = {k: 10 * np.interp(grid, *zip(*first[k])) + (np.interp(grid, *zip(*second[k])) if k in second else 0) for k in first}
    assert sorted(got) == [1, 2, 3, 5, 6]  # 4 leaves the allowed range, 9 has no first curve, 6 is just within
    for k, rows in got.items():
        assert [t for t, _ in sorted(rows)] == list(grid)
        np.testing.assert_allclose([y for _, y in sorted(rows)], want[k])


def test_sum_of_curves_over_long_takes(spark):
    """Points many position blocks apart."""
    rng = np.random.default_rng(5)
    first, second = ({t: float(rng.normal()) for t in map(float, sorted(rng.choice(300_000, n, replace=False)))} for n in (6, 4))
    table = lambda curve: spark.createDataFrame([(1, t, y) for t, y in curve.items()], "k bigint, t_sec double, y double")
    got = [r.y for r in c.add_curves(table(first), table(second), ["k"], 300_000).orderBy("t_sec").collect()]
    grid = np.arange(300_000)
    np.testing.assert_allclose(got, sum(np.interp(grid, list(x), list(x.values())) for x in (first, second)), atol=1e-9)


def test_weighted_median(spark):
    rows = [(1, 5.0, 1.0), (1, 1.0, 1.0), (1, 9.0, 2.0), (2, 4.0, 0.0), (2, 8.0, 0.0)]
    df = spark.createDataFrame(rows, "k bigint, v double, w double")
    assert {r.k: r.median for r in c.weighted_median(df, ["k"], "v", "w").collect()} == {1: 5.0, 2: 6.0}


def test_gap_states_start_trusted(spark):
    df = spark.createDataFrame([(1, 0, 1, i, v) for i, v in enumerate([False, True, True, False, True])],
                               "file_id bigint, ref bigint, tgt bigint, window_no bigint, valid boolean")
    states = [r.state for r in w.gap_states(df).orderBy("window_no").collect()]
    assert states == ["UNRESOLVED_GAP", "REENTRY", "TRUSTED", "UNRESOLVED_GAP", "REENTRY"]
