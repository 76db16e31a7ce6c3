"""Tolerances that tie."""
from archlens.operators import decide as d


def test_agreement_settles_ties(spark):
    """Differences equal to a tolerance and equal tolerances, in every order of the windows."""
    tracks, windows = [], []
    for t in range(1, 900):  # difference 0.01 * delay up to the last bits, for 0.01 * t >= 2
        tracks.append((t, float(t), float(t) + 0.01 * t + 0.1))
        windows += [(t, w, (t + 0.1) / 48) for w in range(2)]
    tracks.append((1000, 225.0, 226.0))  # 3 * 0.015625 * 48 = 0.01 * 225
    windows += [(1000, w, (x + 225) / 48) for w, x in enumerate([0.0, 0.75, 1.5])]
    got = {r.track_id: r for r in d.agreement(
        spark.createDataFrame(windows, "track_id bigint, window_no bigint, value_ms double"),
        spark.createDataFrame(tracks, "track_id bigint, delay_samples double, shift_samples double"),
        absolute=2, relative=0.01, sigma=3, rate=48000.0).collect()}
    assert all(got[t].accepted for t in range(1, 900))
    assert got[1000].basis == "relative"
