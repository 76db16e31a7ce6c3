"""Vectorised delay estimators: Arrow batches of equal-length arrays, one FFT per batch."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

# Whitening floor, level gate, and the weights of the confidence.
EPS_REL, EPS_ABS, RMS_GATE = 1e-3, 1e-12, 1e-12
W_HEIGHT, W_RATIO, W_PROMINENCE = 0.3, 0.5, 0.2
NEGATIVE_FACTOR, SECOND_GAP, SUCCESS_FACTOR = 1.2, 8, 2.0
MIN_PHASE_SAMPLES, GUARD = 4096, 24
TAPS_PER_FACTOR = 20
STACKED = 1 << 17  # samples of one matrix

GCC = T.StructType([T.StructField(n, t) for n, t in (
    ("delay", T.DoubleType()), ("confidence", T.DoubleType()), ("polarity", T.LongType()),
    ("success", T.BooleanType()), ("snr", T.DoubleType()))])
SLOPE = T.StructType([T.StructField(n, t) for n, t in (
    ("delta", T.DoubleType()), ("r2", T.DoubleType()), ("polarity", T.LongType()))])
NCC = T.StructType([T.StructField(n, t) for n, t in (
    ("lag", T.LongType()), ("cc", T.DoubleType()), ("abs_cc", T.DoubleType()),
    ("sub_lag", T.DoubleType()), ("peak_to_sidelobe", T.DoubleType()))])


def fast_len(n: int) -> int:
    """Smallest length at least ``n`` with no prime factor above five."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def _groups(*columns: pd.Series):
    """Row numbers that share all array lengths, with their stacked matrices.

    A matrix has ``STACKED`` samples, or one row, at most: what a task holds, several times
    that in spectra, does not grow with the rows of a batch.
    """
    sizes = list(zip(*[c.map(len) for c in columns])) if len(columns[0]) else []
    for shape in sorted(set(sizes)):
        alike = np.array([i for i, s in enumerate(sizes) if s == shape])
        step = max(1, STACKED // max(1, *shape))
        for rows in (alike[k:k + step] for k in range(0, len(alike), step)):
            yield rows, [np.stack(c.iloc[rows].to_numpy()).astype(float) for c in columns]


def _whitened(ref: np.ndarray, tgt: np.ndarray, nfft: int) -> np.ndarray:
    g = np.conj(np.fft.rfft(ref, nfft)) * np.fft.rfft(tgt, nfft)
    mag = np.abs(g)
    return np.fft.irfft(g / (mag + EPS_REL * mag.max(axis=1, keepdims=True) + EPS_ABS), nfft)


def _level(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x - x.mean(axis=1, keepdims=True)
    return x, np.sqrt((x * x).mean(axis=1))


def gcc_batch(ref: np.ndarray, tgt: np.ndarray, lag0: int, lo: int, hi: int, gate: float) -> dict[str, np.ndarray]:
    """GCC-PHAT delays of many (ref, tgt) rows of equal shape."""
    rows, width = ref.shape
    out = {"delay": np.full(rows, np.nan), "confidence": np.zeros(rows), "polarity": np.ones(rows, int),
           "success": np.zeros(rows, bool), "snr": np.full(rows, np.nan)}
    m_lo, m_hi = max(0, lag0 + lo), min(tgt.shape[1] - width, lag0 + hi)
    if width == 0 or m_hi - m_lo < 2:
        return out
    (ref, r_ref), (tgt, r_tgt) = _level(ref), _level(tgt)
    live = np.flatnonzero((r_ref >= gate) & (r_tgt >= gate))
    if not len(live):
        return out
    nfft = fast_len(width + tgt.shape[1] - 1)
    surface = _whitened(ref[live] / r_ref[live, None], tgt[live] / r_tgt[live, None], nfft)[:, m_lo:m_hi + 1]
    flip = -surface.min(axis=1) > surface.max(axis=1) * NEGATIVE_FACTOR
    surface = np.where(flip[:, None], -surface, surface)
    floor = np.sqrt(2 * np.log(nfft)) / np.sqrt(nfft)
    wall = np.full((len(live), 1), -np.inf)
    peak = (surface > np.hstack([wall, surface[:, :-1]])) & (surface > np.hstack([surface[:, 1:], wall]))
    heights = np.where(peak, surface, -np.inf)
    best = heights.argmax(axis=1)
    every = np.arange(len(live))
    found = peak.any(axis=1)
    v = np.maximum(surface[every, best], 0.0)
    rest = heights.copy()
    rest[every, best] = -np.inf
    other = rest.argmax(axis=1)
    second = np.where(np.abs(other - best) >= SECOND_GAP, rest[every, other], -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        height = np.where(v > floor, np.minimum(1.0, np.log10(v / floor) / np.log10(1.0 / floor)), 0.0)
        r = v / second
        ratio = np.where(second > 0, np.clip((r - 1) / (r - 0.5), 0.0, 1.0), 1.0)
        before = np.minimum.accumulate(surface, axis=1)[every, best]
        after = np.minimum.accumulate(surface[:, ::-1], axis=1)[:, ::-1][every, best]
        prominence = np.where(v > 0, np.minimum(1.0, (surface[every, best] - np.maximum(before, after)) / v), 0.0)
    confidence = np.clip(W_HEIGHT * height + W_RATIO * ratio + W_PROMINENCE * prominence, 0.0, 1.0)
    out["polarity"][live] = np.where(flip, -1, 1)
    hit = live[found]
    out["delay"][hit] = (m_lo + best - lag0)[found]
    out["confidence"][hit] = confidence[found]
    out["success"][hit] = (v >= SUCCESS_FACTOR * floor)[found]
    out["snr"][live] = np.maximum(surface.max(axis=1), 0.0) / floor
    return out


def gcc_phat(ref, tgt, *, lag0: int, lo: int, hi: int, gate: float = RMS_GATE):
    """Integer delay of ``tgt`` against ``ref`` by whitened correlation."""
    @F.pandas_udf(GCC)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"delay": np.nan, "confidence": 0.0, "polarity": 1, "success": False, "snr": np.nan}, index=range(len(a)))
        for rows, (x, y) in _groups(a, b):
            for name, values in gcc_batch(x, y, lag0, lo, hi, gate).items():
                out.loc[rows, name] = values
        # not measurable is null, never NaN or zero
        return out.astype({"delay": "Float64", "snr": "Float64", "polarity": "int64", "success": bool})
    return run(ref, tgt)


def phase_slope(ref, tgt, *, rate: float, low_hz: float = 200.0, high_hz: float = 8000.0):
    """Sub-sample residual delay by a weighted line through the cross phase."""
    @F.pandas_udf(SLOPE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"delta": pd.array([None] * len(a), "Float64"), "r2": pd.array([None] * len(a), "Float64"), "polarity": 1})
        for rows, (x, y) in _groups(a, b):
            n = x.shape[1]
            if n < MIN_PHASE_SAMPLES or y.shape[1] != n:
                continue
            nfft = fast_len(n)
            g = np.conj(np.fft.rfft(x, nfft)) * np.fft.rfft(y, nfft)
            f = np.fft.rfftfreq(nfft, 1.0 / rate)
            band = (f >= low_hz) & (f <= min(high_hz, rate / 2))
            w, phi, fb = np.abs(g[:, band]), np.angle(g[:, band]), f[band]
            energy = (w * fb * fb).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                sec = -(w * fb * phi).sum(axis=1) / (2 * np.pi * energy)
                miss = np.angle(np.exp(1j * (phi + 2 * np.pi * fb * sec[:, None])))
                mean = (w * phi).sum(axis=1) / w.sum(axis=1)
                r2 = 1 - (w * miss ** 2).sum(axis=1) / (w * (phi - mean[:, None]) ** 2).sum(axis=1)
            mag = np.abs(g)
            white = np.fft.irfft(g / (mag + EPS_REL * mag.max(axis=1, keepdims=True) + EPS_ABS), nfft)
            near = np.hstack([white[:, :65], white[:, nfft - 64:]])
            flip = -near.min(axis=1) > near.max(axis=1) * NEGATIVE_FACTOR
            for i, row in enumerate(rows):
                if energy[i] > 1e-300:
                    out.loc[row, ["delta", "r2"]] = [sec[i] * rate, r2[i] if np.isfinite(r2[i]) else None]
                    out.loc[row, "polarity"] = -1 if flip[i] else 1
        return out
    return run(ref, tgt)


def ncc_surface(ref: np.ndarray, tgt: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised correlation of equal-length rows at lags lo..hi, and which rows are live."""
    n = ref.shape[1]
    (a, _), (b, _) = _level(ref), _level(tgt)
    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    nfft = fast_len(2 * n - 1)
    c = np.fft.irfft(np.conj(np.fft.rfft(a, nfft)) * np.fft.rfft(b, nfft), nfft)
    lags = np.arange(max(lo, 1 - n), min(hi, n - 1) + 1)
    live = norm > RMS_GATE
    return c[:, lags] / np.where(live, norm, 1.0)[:, None], live


def ncc_peak(ref, tgt, *, lo: int, hi: int, signed: bool = False):
    """Strongest normalised correlation in a lag range; |cc| decides unless ``signed``."""
    @F.pandas_udf(NCC)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lag": pd.array([None] * len(a), "Int64"), **{
            k: pd.array([None] * len(a), "Float64") for k in ("cc", "abs_cc", "sub_lag", "peak_to_sidelobe")}})
        for rows, (x, y) in _groups(a, b):
            n = min(x.shape[1], y.shape[1])
            if n < 16:
                continue
            c, live = ncc_surface(x[:, :n], y[:, :n], lo, hi)
            first = max(lo, 1 - n)
            key = c if signed else np.abs(c)
            for i in np.flatnonzero(live):
                k = int(key[i].argmax())
                frac, side = 0.0, None
                if 0 < k < c.shape[1] - 1:
                    y0, y1, y2 = c[i, k - 1:k + 2]
                    bend = y0 - 2 * y1 + y2
                    frac = float(np.clip(0.5 * (y0 - y2) / bend, -0.5, 0.5)) if bend else 0.0
                others = np.concatenate([c[i, :max(0, k - GUARD)], c[i, k + GUARD + 1:]])
                if others.size and others.max() > 0:
                    side = c[i, k] / others.max()
                out.loc[rows[i]] = [first + k, c[i, k], abs(c[i, k]), first + k + frac, side]
        return out
    return run(ref, tgt)


def ncc_lags(ref, tgt, *, lo: int, hi: int):
    """The whole normalised correlation surface over a lag range, as an array."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None] * len(a)
        for rows, (x, y) in _groups(a, b):
            if x.shape[1] == y.shape[1] and x.shape[1] >= 16:
                c, live = ncc_surface(x, y, lo, hi)
                for i in np.flatnonzero(live):
                    out[rows[i]] = c[i]
        return pd.Series(out, dtype=object)
    return run(ref, tgt)


def coarse_surface(ref, tgt, *, before: int, factor: int):
    """Normalised correlation at every coarse lag of windows pooled by ``factor``; null where one is silent.

    ``tgt`` begins ``before`` samples ahead of ``ref``. Lag zero is in the middle.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None] * len(a)
        for rows, (x, y) in _groups(a, b):
            n = x.shape[1] // factor
            if n >= 16:
                x, y = (m[:, :n * factor].reshape(len(m), n, factor).mean(axis=2) for m in (x, y[:, before:before + x.shape[1]]))
                c, live = ncc_surface(x, y, 1 - n, n - 1)
                for i in np.flatnonzero(live):
                    out[rows[i]] = c[i].astype(np.float32)
        return pd.Series(out, dtype=object)
    return run(ref, tgt)


def surface_peak(surface: np.ndarray, lo: int, hi: int, factor: int) -> tuple[int, float] | None:
    """(lag, cc) of the strongest |cc| at the coarse lags within lo..hi samples, as far as the surface goes."""
    half = len(surface) // 2
    first, last = max(-half, -(-lo // factor)), min(half, hi // factor)
    if first > last:
        return None
    k = first + int(np.abs(surface[first + half:last + half + 1]).argmax())
    return k * factor, float(surface[k + half])


def refined_lag(segment: np.ndarray, tgt: np.ndarray, zero: int, lag: int, radius: int) -> tuple[int, float]:
    """(lag, |cc|) of the best whole lag within ``radius``; ``zero``: where the segment lies in ``tgt`` at lag 0.

    Candidates outside ``tgt`` are left out; with none, or in silence, the lag stays, at quality 0.
    """
    n = len(segment)
    lags = np.arange(max(lag - radius, -zero), min(lag + radius, len(tgt) - n - zero) + 1)
    a = segment - segment.mean() if n else segment
    scale = np.sqrt(a @ a)
    if n < 8 or not len(lags) or scale < RMS_GATE:
        return lag, 0.0
    cut = np.lib.stride_tricks.sliding_window_view(tgt[zero + lags[0]:zero + lags[-1] + n], n)
    cut = cut - cut.mean(axis=1, keepdims=True)
    norm = scale * np.sqrt((cut * cut).sum(axis=1))
    quality = np.where(norm >= 1e-12, np.abs(cut @ a) / np.where(norm >= 1e-12, norm, 1.0), -1.0)
    best = int(quality.argmax())
    return (int(lags[best]), float(quality[best])) if quality[best] >= 0 else (lag, 0.0)


def ncc_at(ref, tgt, lags, *, search: int, least: int):
    """Per lag: the correlation there, the strongest within ``search`` of it, and that one's offset.

    A correlation takes the samples that both windows share at the lag, means
    removed; it is 0 over fewer than ``least`` of them or where one is silent.
    """
    kind = T.StructType([T.StructField("cc", T.DoubleType()), T.StructField("best", T.DoubleType()),
                         T.StructField("offset", T.LongType())])

    @F.pandas_udf(T.ArrayType(kind))
    def run(refs: pd.Series, tgts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = [None] * len(refs)
        for rows, (a, b) in _groups(refs, tgts):
            for i, (x, y) in enumerate(zip(a, b)):
                cc = overlap_surface(x, y, least)
                lags_ = np.asarray(wanted[rows[i]], np.int64)
                near = lags_[:, None] + np.arange(-search, search + 1)
                reach = np.abs(near) < len(x)
                values = np.where(reach, cc[np.where(reach, near, 0) + len(x) - 1], 0.0)
                best = np.abs(values).argmax(axis=1)
                out[rows[i]] = [{"cc": float(v[search]), "best": float(v[k]), "offset": int(k) - search} for v, k in zip(values, best)]
        return pd.Series(out, dtype=object)
    return run(ref, tgt, lags)


def overlap_surface(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Correlation of two equally long windows at every lag from 1 - n to n - 1, over what they share there.

    One FFT gives the products, running sums the means and norms of each overlap.
    """
    n = len(x)
    x, y = np.asarray(x, float), np.asarray(y, float)
    nfft = fast_len(2 * n - 1)
    products = np.fft.irfft(np.fft.rfft(y, nfft) * np.conj(np.fft.rfft(x, nfft)), nfft)
    lags = np.arange(1 - n, n)
    products, count = products[lags % nfft], n - np.abs(lags)
    sums = lambda v: np.concatenate([[0.0], np.cumsum(v)])
    a, b = np.maximum(-lags, 0), np.maximum(lags, 0)
    over = lambda total, at: total[at + count] - total[at]
    sx, sy = over(sums(x), a), over(sums(y), b)
    xx, yy = over(sums(x * x), a), over(sums(y * y), b)
    vx, vy = xx - sx * sx / count, yy - sy * sy / count
    # what cancellation leaves of a constant stretch is no signal
    vx, vy = np.where(vx > 1e-12 * (x @ x), vx, 0.0), np.where(vy > 1e-12 * (y @ y), vy, 0.0)
    scale = np.sqrt(vx * vy)
    loud = (scale >= 1e-9) & (count >= max(1, least))
    return np.where(loud, (products - sx * sy / count) / np.where(loud, scale, 1.0), 0.0)


def best_lag_near(ref, tgt, coarse, lo, hi, *, radius: int):
    """(lag, quality) of the strongest |correlation| within ``radius`` of ``coarse`` and from ``lo`` to ``hi``.

    ``tgt`` reaches ``radius`` samples beyond ``ref`` on both sides at the coarse
    lag. Equal strengths, to nine digits, go to the smaller lag; null where no lag
    is allowed or one side is silent.
    """
    kind = T.StructType([T.StructField("lag", T.LongType()), T.StructField("quality", T.DoubleType())])

    @F.pandas_udf(kind)
    def run(refs: pd.Series, tgts: pd.Series, centre: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
        lag, quality = [None] * len(refs), [None] * len(refs)
        for rows, (a, b) in _groups(refs, tgts):
            a = a.astype(float) - a.mean(axis=1, keepdims=True, dtype=float)
            for i, row in enumerate(rows):
                cut = np.lib.stride_tricks.sliding_window_view(b[i].astype(float), a.shape[1])
                cut = cut - cut.mean(axis=1, keepdims=True)
                lags_ = int(centre[row]) + np.arange(-radius, radius + 1)
                power = (a[i] @ a[i], (cut * cut).sum(axis=1))
                live = (lags_ >= low[row]) & (lags_ <= high[row]) & (power[0] > 1e-20) & (power[1] > 1e-20)
                if live.any():
                    cc = np.abs(cut @ a[i]) / np.sqrt(np.where(live, power[0] * power[1], 1.0))
                    cc = np.where(live, cc, -1.0)
                    lag[row], quality[row] = int(lags_[np.round(cc, 9).argmax()]), float(cc.max())
        return pd.DataFrame({"lag": pd.array(lag, "Int64"), "quality": pd.array(quality, "Float64")})
    return run(ref, tgt, coarse, lo, hi)


def low_pass(factor: int) -> np.ndarray:
    """Windowed-sinc taps for decimation by ``factor``, unit gain at zero."""
    half = TAPS_PER_FACTOR * factor // 2
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / factor) * np.hamming(2 * half + 1)
    return taps / taps.sum()


def decimate(samples, factor: int, margin: int):
    """Every ``factor``-th filtered sample; ``margin`` input samples on each side are context."""
    taps = low_pass(factor)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(x: pd.Series) -> pd.Series:
        out = [None] * len(x)
        for rows, (m,) in _groups(x):
            nfft = fast_len(m.shape[1] + len(taps) - 1)
            full = np.fft.irfft(np.fft.rfft(m, nfft) * np.fft.rfft(taps, nfft), nfft)
            half = len(taps) // 2
            kept = full[:, half + margin:half + m.shape[1] - margin:factor].astype(np.float32)
            for i, row in enumerate(rows):
                out[row] = kept[i]
        return pd.Series(out, dtype=object)
    return run(samples)
