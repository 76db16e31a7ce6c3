"""Known-answer signals: delays, polarity, silence, bad samples, block size, partitions."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from archlens.functions import pcm, signal as sg
from archlens.operators import signal as g
from archlens.plans import apply as ap, track_decision as td

N, RATE = 8192, 8000.0


def noise(seed, n=N):
    rng = np.random.default_rng(seed)
    return np.convolve(rng.standard_normal(n + 8), np.ones(3) / 3, "same")[:n].astype(np.float32) * 0.2


def delayed(x, d):
    out = np.zeros_like(x)
    if d >= 0:
        out[d:] = x[: len(x) - d]
    else:
        out[:d] = x[-d:]
    return out


def blocks_of(spark, files, size, parts=3):
    rows = [(f, c, b, x[b * size:(b + 1) * size].tolist()) for f, chans in files.items() for c, x in enumerate(chans)
            for b in range(-(-len(x) // size))]
    return spark.createDataFrame(rows, "file_id bigint, channel bigint, block_no bigint, samples array<float>").repartition(parts)


@pytest.fixture(scope="module")
def takes():
    base = noise(1)
    bad = noise(3)
    bad[100] = np.nan
    return {1: [base, delayed(base, 17), -delayed(base, -40), delayed(base, 40)],
            2: [base, np.zeros(N, np.float32), bad, delayed(base, 8), delayed(base, 2)],
            3: [noise(5, 100), noise(6, 100), noise(7, 100)]}


@pytest.mark.parametrize("size,parts", [(64, 2), (100, 5), (1024, 1)])
def test_frame_delays_do_not_depend_on_blocks(spark, takes, size, parts):
    b = blocks_of(spark, {1: takes[1]}, size, parts)
    got = g.frame_delays(b, size, frame=1024, hop=512, search=64).toPandas()
    assert len(got) == 3 * ((N - 1024) // 512 + 1)
    for tgt, want, sign in ((1, 17, 1), (2, -40, -1), (3, 40, 1)):
        rows = got[got.tgt == tgt]
        assert set(rows.delay) == {want} and set(rows.polarity) == {sign} and rows.success.all()


def test_silence_is_null_not_zero(spark, takes):
    got = g.frame_delays(blocks_of(spark, {2: takes[2][:2]}, 128), 128, frame=1024, hop=1024, search=16).toPandas()
    assert got.delay.isna().all() and got.snr.isna().all() and not got.success.any()


def test_short_file_has_no_frames(spark, takes):
    assert g.frame_delays(blocks_of(spark, {3: takes[3]}, 64), 64, frame=1024, hop=512, search=8).count() == 0


@pytest.mark.parametrize("size", [64, 256])
def test_decimation_equals_whole_channel(spark, takes, size):
    x = takes[1][0]
    got = g.decimated(blocks_of(spark, {1: [x]}, size), size, 4).orderBy("block_no").collect()
    coarse = np.concatenate([r.samples for r in got])
    padded = np.concatenate([np.zeros(40), x, np.zeros(40)])
    want = np.convolve(padded, sg.low_pass(4), "valid")[: N: 4]
    np.testing.assert_allclose(coarse, want, atol=1e-5)


def test_two_stage_matches_full_search(spark, takes):
    b = blocks_of(spark, {1: takes[1]}, 256)
    got = g.two_stage_delays(b, 256, frame=2048, hop=1024, search=64, factor=4, min_confidence=0.2).toPandas()
    assert dict(got.groupby("tgt").delay_samples.median()) == {1: 17, 2: -40, 3: 40}


def test_gcc_brute_force():
    rng = np.random.default_rng(4)
    ref = rng.standard_normal((3, 64))
    tgt = rng.standard_normal((3, 96))
    out = sg.gcc_batch(ref, tgt, 16, -16, 16, 0.0)
    for i in range(3):
        a, b = ref[i] - ref[i].mean(), tgt[i] - tgt[i].mean()
        a, b = a / np.sqrt((a * a).mean()), b / np.sqrt((b * b).mean())
        n = sg.fast_len(159)
        s = np.conj(np.fft.fft(a, n)) * np.fft.fft(b, n)
        s = np.fft.ifft(s / (np.abs(s) + 1e-3 * np.abs(np.fft.rfft(a, n) * np.fft.rfft(b, n)).max() + 1e-12)).real[:33]
        if -s.min() > 1.2 * s.max():
            s = -s
        assert out["delay"][i] == int(s.argmax()) - 16


def test_phase_slope_finds_fraction(spark):
    x = noise(9, 8192).astype(float)
    f = np.fft.rfftfreq(8192)
    y = np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * f * 0.3), 8192)
    df = spark.createDataFrame([(x.tolist(), y.tolist(), x[:100].tolist())], "a array<double>, b array<double>, c array<double>")
    row = df.select(sg.phase_slope(F.col("a"), F.col("b"), rate=RATE).alias("s"), sg.phase_slope(F.col("c"), F.col("c"), rate=RATE).alias("t")).first()
    assert abs(row.s.delta - 0.3) < 0.01 and row.s.polarity == 1 and row.s.r2 > 0.9
    assert row.t.delta is None


def test_tracker_follows_and_skips_weak_windows(spark):
    x = noise(11)
    y = delayed(x, 6)
    y[3000:4100] = noise(12)[3000:4100] * 0.01
    b = blocks_of(spark, {1: [x, y]}, 128)
    got = g.track_windows(g.surfaces(b, 128, window=1024, hop=512, search=64), rate=RATE, radius=8, min_cc=0.3).toPandas()
    assert set(got[got.valid].delay_samples) == {6} and 0 < (~got.valid).sum() < len(got) / 2
    parts = g.track_windows(g.surfaces(b, 128, window=1024, hop=512, search=64), rate=RATE, radius=8, min_cc=0.3, chunk=4).toPandas()
    order = lambda p: p.sort_values("window_no").reset_index(drop=True)
    assert order(got).equals(order(parts))


def test_apply_and_verify_shifts(spark):
    x, size, hop = noise(13, 1000), 64, 150
    b = blocks_of(spark, {1: [x]}, size)
    shifts = [0, 7, -30, 200, -1, 3, 0]
    plan = spark.createDataFrame([(1, 0, i, s) for i, s in enumerate(shifts)], "file_id bigint, channel bigint, window_no bigint, shift bigint")
    keys = ["file_id", "channel"]
    out = ap.apply_shifts(b, plan, keys, size=size, hop=hop)
    got = np.concatenate([r.samples for r in out.orderBy("block_no").collect()])
    want = [x[k + shifts[k // hop]] if 0 <= k + shifts[k // hop] < 1000 else 0.0 for k in range(1000)]
    np.testing.assert_array_equal(got, np.float32(want))
    check = ap.verify_shifts(b, out, plan, keys, size=size, hop=hop).first()
    assert (check.n_samples, check.checked, check.mismatches, check.complete) == (1000, 1000, 0, True)
    wrong = plan.withColumn("shift", F.when(F.col("window_no") == 1, 8).otherwise(F.col("shift")))
    found = ap.verify_shifts(b, out, wrong, keys, size=size, hop=hop).first()
    assert found.first_mismatch == 150 and found.mismatches == 150


def test_compare_counts_missing_samples(spark):
    df = spark.createDataFrame([([1.0, None, float("nan"), 4.0], [1.0, 2.0, float("nan"), 5.0], b, e) for b, e in ((0, 4), (-3, 1), (3, 9), (2, 3), (4, 8))],
                               "got array<float>, want array<float>, b bigint, e bigint")
    c = pcm.compare_inside("got", "want", F.col("b"), F.col("e"))
    assert [tuple(r.c) for r in df.select(c.alias("c")).collect()] == [(4, 2, 1), (1, 0, None), (1, 1, 3), (1, 0, None), (0, 0, None)]


@pytest.mark.parametrize("n", [1, 2, 9, 64])
def test_overlap_surface_is_the_direct_sum(n):
    rng = np.random.default_rng(n)
    for x, y in ((rng.normal(size=n), rng.normal(size=n) + 3), (np.full(n, 0.7), rng.normal(size=n)), (np.zeros(n), np.zeros(n))):
        got = sg.overlap_surface(x, y, 3)
        for lag in range(1 - n, n):
            a, b = (x[:n - lag], y[lag:]) if lag >= 0 else (x[-lag:], y[:n + lag])
            a, b = a - a.mean(), b - b.mean()
            scale = np.sqrt((a @ a) * (b @ b))
            want = a @ b / scale if len(a) >= 3 and scale >= 1e-9 else 0.0
            assert got[lag + n - 1] == pytest.approx(want, abs=1e-9)


def test_track_decisions(spark, takes):
    b = blocks_of(spark, {1: takes[1], 2: takes[2]}, 128)
    got = td.decide_tracks(b, 128, rate=RATE, frame=1024, hop=512, search=64).toPandas().set_index(["file_id", "channel"]).sort_index()
    assert list(got.loc[1].decision) == ["anchor", "fixed", "fixed", "fixed"]
    assert list(got.loc[1].shift_samples)[1:] == [17, -40, 40]
    assert got.loc[2, 1].reason == "silent_track" and got.loc[2, 2].reason == "non_finite"
    assert got.loc[2, 3].decision == "fixed" and got.loc[2, 4].decision == "already_aligned"
    outcome = td.file_outcome(spark.createDataFrame(got.reset_index()[["file_id", "decision"]])).orderBy("file_id").toPandas()
    assert list(outcome.status) == ["applied", "applied"]


def test_mix_policies(spark):
    b = spark.createDataFrame([(1, 0, 0, [0.5, 0.9]), (1, 1, 0, [0.25, 0.4])], "file_id bigint, channel bigint, block_no bigint, samples array<float>")
    gains = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 1.0)], "file_id bigint, sink bigint, channel bigint, gain double")
    hard = ap.mix(b, gains, policy="hard_clip")
    assert np.allclose(hard.first().samples, [0.75, 1.0])
    stats = ap.mix_statistics(hard, size=2, policy="error").first()
    assert stats.clip_count == 1 and stats.peak_at == 1 and stats.reason == "audio_mix_clipping"


def test_frames_udtf(spark):
    spark.udtf.register("explode_frames", g.ExplodeFrames)
    rows = spark.sql("SELECT * FROM explode_frames(1000, 256, 300)").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 256), (1, 300, 256), (2, 600, 256)]


def test_sampled_frames_are_distinct_and_stable(spark):
    lengths = spark.createDataFrame([(1, 0, 1, 100_000), (2, 0, 1, 900)], "file_id bigint, ref bigint, tgt bigint, n_samples bigint")
    a = g.sampled_frames(lengths, 100, 50, 200).toPandas()
    b = g.sampled_frames(lengths.repartition(4), 100, 50, 200).toPandas()
    assert sorted(a.frame_no[a.file_id == 1]) == sorted(b.frame_no[b.file_id == 1]) and a[a.file_id == 1].frame_no.nunique() == 200
    assert sorted(a.frame_no[a.file_id == 2]) == list(range(17))
    assert a.frame_no.max() <= (100_000 - 100) // 50


def test_score_offsets_reaches_far_lags(spark):
    rng = np.random.default_rng(5)
    long = rng.normal(size=9000).astype(np.float32)
    channels = [long[400:8592], long[100:8292]]  # channel 1 lags by 300
    rows = [(1, c, k, x[k * 512:(k + 1) * 512].tolist()) for c, x in enumerate(channels) for k in range(16)]
    blocks = spark.createDataFrame(rows, "file_id long, channel long, block_no long, samples array<float>")
    sets = spark.createDataFrame([(1, 0, [0, 300]), (1, 1, [0, 10]), (1, 2, [0, 302]), (1, 3, [0, 5000])],
                                 "file_id long, set_id long, shifts array<long>")
    got = {r.set_id: r for r in g.score_offsets(blocks, sets, 512, window=1024, n_windows=6, search=3).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].score > 0.999 and got[0].offsets == [0] and got[1].score < 0.2
    assert got[2].near_score > 0.999 and got[2].offsets == [-2] and got[3].score == 0


def test_anchor_moves_on_from_an_uncorrelated_channel(spark):
    rng = np.random.default_rng(8)
    signal = rng.normal(size=16500)
    own = [rng.normal(size=16384), signal[100:16484], signal[88:16472], signal[80:16464]]
    other = [rng.normal(size=16384) for _ in range(3)]  # nothing fits anything
    rows = [(f, c, k, (x[k * 512:(k + 1) * 512] * 0.1).astype(np.float32).tolist())
            for f, channels in ((1, own), (2, other)) for c, x in enumerate(channels) for k in range(32)]
    blocks = spark.createDataFrame(rows, "file_id long, channel long, block_no long, samples array<float>")
    got = {(r.file_id, r.channel): r for r in td.decide_tracks(blocks, 512, rate=RATE, frame=1024, hop=512, search=64).collect()}
    assert (got[1, 0].decision, got[1, 0].reason) == ("untouched", "uncorrelated") and got[1, 1].decision == "anchor"
    assert [round(got[1, c].offset_samples) for c in (2, 3)] == [12, 20] and got[1, 3].decision == "fixed"
    assert got[2, 0].decision == "anchor" and {got[2, c].decision for c in (1, 2)} == {"untouched"}


def test_wide_search_and_recheck(spark):
    rng = np.random.default_rng(9)
    signal = rng.normal(size=20000) * 0.1
    at = lambda d: signal[2000 - d:2000 - d + 16384]
    late = at(20).copy()  # 20 in most frames, 26 in a loud middle that rules the recheck
    late[6000:10400] = 8 * at(26)[6000:10400]
    channels = [at(0), at(200), at(30), -at(64), late]
    rows = [(1, c, k, x[k * 512:(k + 1) * 512].astype(np.float32).tolist()) for c, x in enumerate(channels) for k in range(32)]
    blocks = spark.createDataFrame(rows, "file_id long, channel long, block_no long, samples array<float>")
    settings = dict(rate=RATE, frame=1024, hop=512, search=64)
    got = {r.channel: r for r in td.decide_tracks(blocks, 512, **settings).collect()}
    assert got[0].decision == "anchor" and got[1].reason == "out_of_range" and got[1].decision == "untouched"
    assert (got[2].decision, got[2].shift_samples) == ("fixed", 30)
    assert (got[3].decision, got[3].shift_samples) == ("fixed", 64)  # at the edge, but inside the range
    assert (got[4].decision, got[4].reason, got[4].shift_samples) == ("untouched", "recheck_residual", None)
    ineligible = spark.createDataFrame([(1, False, "non_pcm_audio", 5)], "file_id long, eligible boolean, reason string, channels long")
    out = td.decide_tracks(blocks, 512, eligible=ineligible, **settings).collect()
    assert len(out) == 5 and {(r.decision, r.reason) for r in out} == {("untouched", "non_pcm_audio")}


def test_file_outcome_reads_reasons(spark):
    rows = [(1, "anchor", None), (1, "untouched", "silent_track"), (2, "anchor", None), (2, "untouched", "recheck_residual"),
            (3, "untouched", "non_pcm_audio"), (4, "untouched", "two_channel_only"), (5, "untouched", "silent_track"),
            (6, "anchor", None), (6, "already_aligned", None), (6, "untouched", "low_confidence")]
    got = {r.file_id: r.status for r in td.file_outcome(spark.createDataFrame(rows, "file_id long, decision string, reason string")).collect()}
    assert got == {1: "already_aligned", 2: "measure_failed", 3: "not_eligible", 4: "two_channel_only", 5: "measure_failed", 6: "already_aligned"}


def test_strength_query_takes_every_frame(spark):
    from archlens import registry
    registry.load()
    rows = registry.QUERIES["sig_09"](spark, "/root/testdata/sf0.001").collect()
    assert max(r.samples for r in rows) > 10


def test_tracker_walks_out_of_the_first_search(spark):
    """A delay that grows window by window, far beyond the range that the first stretch was searched in."""
    n, window, hop = 16_384, 1024, 512
    x = noise(31, n + 4096)
    # the target lags ever more: sample k is taken k / 256 samples earlier
    y = np.array([x[2048 + k - k // 256] for k in range(n)], dtype=x.dtype)
    b = blocks_of(spark, {1: [x[2048:2048 + n], y], 2: [x[:n], -np.roll(x[:n], 9)]}, 128)
    got = g.follow_delays(b, 128, rate=RATE, window=window, hop=hop, search=24, factor=2, radius=16, initial=window, min_cc=0.15).toPandas()
    got = got.sort_values("window_no")
    one, two = got[got.file_id == 1], got[got.file_id == 2]
    centre = one.window_no * hop + window // 2
    assert one.valid.all() and (np.abs(one.delay_samples - centre / 256) <= 4).all() and one.delay_samples.max() > 50
    assert set(two[two.valid].delay_samples) == {9.0} and set(two[two.valid].polarity) == {-1} and two.cc.min() > 0.75
    again = g.follow_delays(b.repartition(5), 128, rate=RATE, window=window, hop=hop, search=24, factor=2, radius=16, initial=window, min_cc=0.15,
                            chunk=1).toPandas().sort_values("window_no")
    order = lambda p: p.sort_values(["file_id", "window_no"]).reset_index(drop=True)
    assert order(got).equals(order(again))


def test_tracker_tries_a_second_stretch_and_gives_up_in_silence(spark):
    x = noise(32)
    y = delayed(x, 6)
    y[:2000] = 0.0
    b = blocks_of(spark, {1: [x, y], 2: [x, np.zeros(N)]}, 128)
    got = g.follow_delays(b, 128, rate=RATE, window=1024, hop=1024, search=64, factor=2, radius=8, initial=1100, min_cc=0.3).toPandas()
    assert set(got[got.valid].file_id) <= {1} and set(got[got.valid].delay_samples) <= {6.0}
    assert not got[got.file_id == 2].valid.any() and len(got[got.file_id == 2]) == 8


def test_rigid_pairs_move_together(spark):
    rng = np.random.default_rng(4)
    base, own = rng.normal(size=(2, 16600)) * 0.1
    at = lambda x, d: x[100 - d:100 - d + 16384]
    mixed = lambda d: 0.7 * at(base, d) + 0.7 * at(own, d)
    loose = np.concatenate([at(base, 20)[:8192], at(base, 40)[8192:]])  # strong, but its lag moves
    takes = {1: [at(base, 0), at(base, 9), mixed(12), mixed(13)], 2: [at(base, 0), loose, np.zeros(16384), mixed(12)]}
    blocks = blocks_of(spark, {f: [x.astype(np.float32) for x in c] for f, c in takes.items()}, 512)
    settings = dict(rate=RATE, frame=1024, hop=256, search=64, verify_max_ms=0.2)
    bind = dict(window=2048, window_hop=1024, factor=1)
    pairs = td.bound_pairs(blocks, td.channel_health(blocks, -60.0), 512, rate=RATE, frame=1024, hop=256, search=64, **bind)
    assert sorted((r.file_id, r.a, r.b) for r in pairs.collect()) == [(1, 0, 1), (1, 2, 3)]
    got = {(r.file_id, r.channel): r for r in td.decide_tracks(blocks, 512, bind=bind, **settings).collect()}
    assert [(got[1, c].decision, got[1, c].shift_samples, got[1, c].bound_to) for c in range(4)] == [
        ("anchor", None, 0), ("already_aligned", None, 0), ("fixed", 12, 2), ("fixed", 12, 2)]
    assert round(got[1, 3].offset_samples) == 13  # its own measurement stays
    assert got[2, 0].decision == "anchor" and (got[2, 3].decision, got[2, 3].shift_samples) == ("fixed", 12)
    assert {got[2, c].bound_to for c in range(4)} == {None} and got[2, 2].reason == "silent_track"


def test_a_full_batch_of_long_takes_is_held_in_parts():
    """256 takes of 6,400 samples in one batch: equal delays, a bounded share of them as spectra at a time."""
    import tracemalloc

    import pandas as pd
    from archlens.functions import signal as parts
    rng = np.random.default_rng(4)
    tgt = rng.normal(size=(256, 6480)).astype(np.float32)
    ref = tgt[:, 50:6450]  # a delay of 10 beyond the 40 searched on either side
    one, two = pd.Series(list(ref)), pd.Series(list(tgt))
    tracemalloc.start()
    got = {int(r): v for rows, (x, y) in parts._groups(one, two)
           for r, v in zip(rows, parts.gcc_batch(x, y, 40, -40, 40, parts.RMS_GATE)["delay"])}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == dict.fromkeys(range(256), 10.0) and peak < 40e6
    mixed = pd.Series([np.zeros(n) for n in (3, 5, 3, 0, 1 << 18, 1 << 18)])
    assert [r.tolist() for r, _ in parts._groups(mixed)] == [[3], [0, 2], [1], [4], [5]]
