"""Wavelet coherence, coupling quality, motion splines, regressors and surrogates in numpy."""

from __future__ import annotations

import numpy as np

from lucera.functions import signal


# wavelet coherence -----------------------------------------------------------

#: Width of the average over scales.
OCTAVES = 0.6


def scale_grid(n: int, fs: float, dj: float = 0.25, s0: float | None = None, j1: int | None = None) -> np.ndarray:
    """Scales (s) from coarse to fine; the frequency of a scale is its inverse."""
    s0 = 2 / fs if s0 is None else s0
    j1 = int(np.log2(n / fs / s0) / dj) if j1 is None else j1
    return s0 * 2 ** (dj * np.arange(j1, -1, -1))


def morlet(x: np.ndarray, fs: float, scales: np.ndarray, bandwidth: float = 1.5) -> np.ndarray:
    """Complex Morlet transform (scales x times) of centre frequency 1, through the spectrum."""
    m = 1 << int(2 * len(x) - 1).bit_length()
    f = np.fft.fftfreq(m, 1 / fs)
    spectrum = np.fft.fft(x - x.mean(), m)
    psi = np.exp(-(np.pi**2) * bandwidth * (scales[:, None] * f - 1) ** 2) * np.sqrt(scales[:, None])
    return np.fft.ifft(spectrum * psi, axis=1)[:, : len(x)]


def smoothed(w: np.ndarray, fs: float, scales: np.ndarray, dj: float, octaves: float = OCTAVES) -> np.ndarray:
    """Gaussian in time of sigma one scale, then a moving average over scales."""
    n = w.shape[1]
    m = 1 << int(2 * n - 1).bit_length()
    f = np.fft.fftfreq(m, 1 / fs)
    kernel = np.exp(-2 * (np.pi * scales[:, None] * f) ** 2)
    out = np.fft.ifft(np.fft.fft(w, m, axis=1) * kernel, axis=1)[:, :n]
    half = max(0, int(round(octaves / dj)) // 2)
    total = np.cumsum(np.concatenate([np.zeros((1, n)), out]), axis=0)
    lo, hi = np.maximum(np.arange(len(w)) - half, 0), np.minimum(np.arange(len(w)) + half + 1, len(w))
    return (total[hi] - total[lo]) / (hi - lo)[:, None]


def wavelet_coherence(x: np.ndarray, y: np.ndarray, fs: float, dj: float = 0.25, mask_coi: bool = True, **grid) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and squared coherence (frequencies x times); NaN inside the cone of influence."""
    s = scale_grid(len(x), fs, dj, **grid)
    wx, wy = morlet(x, fs, s), morlet(y, fs, s)
    put = lambda w: smoothed(w / s[:, None], fs, s, dj)
    sxy, sx, sy = put(wx * wy.conj()), put(np.abs(wx) ** 2 + 0j).real, put(np.abs(wy) ** 2 + 0j).real
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.clip(np.abs(sxy) ** 2 / (sx * sy), 0, 1)
    if mask_coi:
        t = np.arange(len(x)) / fs
        edge = np.minimum(t, t[-1] - t)
        c[edge[None, :] < np.sqrt(2) * s[:, None]] = np.nan
    return 1 / s, c


# connectivity ----------------------------------------------------------------


def effective_samples(x: np.ndarray, y: np.ndarray, max_lag: int | None = None, taper: bool = True) -> float:
    """N / (1 + 2 sum rho_x rho_y w) over lags up to N / 5 with a Bartlett taper, within [2, N]."""
    n = len(x)
    max_lag = n // 5 if max_lag is None else max_lag

    def rho(v):
        f = np.fft.rfft(v - v.mean(), 2 * n)
        r = np.fft.irfft(f * f.conj())[: max_lag + 1]
        return r / r[0]

    w = 1 - np.arange(1, max_lag + 1) / (max_lag + 1) if taper else np.ones(max_lag)
    return float(np.clip(n / (1 + 2 * (rho(x)[1:] * rho(y)[1:] * w).sum()), 2, n))


def geodesic_distance(a: np.ndarray, b: np.ndarray, alpha: float = 0.5) -> float:
    """Affine-invariant distance of two correlation matrices shrunk to the identity."""
    shrink = lambda c: (1 - alpha) * c + alpha * np.eye(len(c))
    low = np.linalg.inv(np.linalg.cholesky(shrink(a)))
    return float(np.sqrt((np.log(np.linalg.eigvalsh(low @ shrink(b) @ low.T)) ** 2).sum()))


def bias_corrected(x: np.ndarray, y: np.ndarray, measure, surrogates: int = 200, seed: int = 0):
    """(observed - mean) / sd over pairs of phase-randomised surrogates."""
    rng = np.random.default_rng(seed)
    null = np.array([measure(signal.phase_randomized(x, rng), signal.phase_randomized(y, rng)) for _ in range(surrogates)])
    sd = null.std(0)
    return (measure(x, y) - null.mean(0)) / np.where(sd > 0, sd, np.nan)


# coupling quality ------------------------------------------------------------


def windows(n: int, fs: float, length: float, step: float | None):
    """Starts and ends, half overlapping unless step is given."""
    size = int(length * fs)
    hop = max(1, int((length / 2 if step is None else step) * fs))
    return [(i, i + size) for i in range(0, n - size + 1, hop)]


def scalp_coupling(x: np.ndarray, y: np.ndarray, fs: float, band=(0.5, 2.5), length: float = 5.0, step: float | None = None) -> np.ndarray:
    """Correlation of two wavelengths in the cardiac band (one band pass of order 3), a value a window."""
    x, y = (signal.band_pass(v, fs, *band) for v in (x, y))
    return np.array([np.corrcoef(x[a:b], y[a:b])[0, 1] if x[a:b].std() > 0 < y[a:b].std() else np.nan for a, b in windows(len(x), fs, length, step)])


def peak_power(x: np.ndarray, y: np.ndarray, fs: float, band=(0.5, 2.5), length: float = 10.0, step: float | None = None) -> np.ndarray:
    """Peak of the spectrum of two wavelengths' circular cross-correlation in the band, a value a window."""
    fx, fy = (signal.band_pass(v, fs, *band) for v in (x, y))
    out = []
    for a, b in windows(len(x), fs, length, step):
        u, v = fx[a:b], fy[a:b]
        if not (u.std() > 0 and v.std() > 0):
            out.append(np.nan)
            continue
        n = b - a
        cross = np.fft.irfft(np.fft.rfft(u / u.std()) * np.fft.rfft(v / v.std()).conj(), n) / n
        f = np.fft.rfftfreq(n, 1 / fs)
        power = np.abs(np.fft.rfft(cross - cross.mean())) ** 2 / n**2
        power[1 : (n + 1) // 2] *= 2
        keep = (f >= band[0] - 0.1) & (f <= band[1] + 0.1)
        out.append(power[keep].max() if keep.any() else np.nan)
    return np.array(out)


# motion ----------------------------------------------------------------------


def smooth(y: np.ndarray, lam: float) -> np.ndarray:
    """Discrete smoothing spline: least squares with squared second differences, in linear time."""
    n = len(y)
    if n < 3:
        return np.full(n, y.mean()) if n else y
    main, one, two = np.ones(n), np.zeros(n - 1), np.zeros(n - 2)
    for k, v in enumerate((1.0, -2.0, 1.0)):
        main[k : n - 2 + k] += lam * v * v
    one[: n - 2] += -2 * lam
    one[1 : n - 1] += -2 * lam
    two += lam
    d, e, f, z = main.copy(), np.zeros(n), np.zeros(n), y.astype(float).copy()
    for i in range(n):  # L D L' of the five-band matrix, and the forward sweep
        if i >= 1:
            d[i] -= d[i - 1] * e[i - 1] ** 2
            z[i] -= e[i - 1] * z[i - 1]
        if i >= 2:
            d[i] -= d[i - 2] * f[i - 2] ** 2
            z[i] -= f[i - 2] * z[i - 2]
        if i < n - 1:
            e[i] = (one[i] - (d[i - 1] * e[i - 1] * f[i - 1] if i >= 1 else 0.0)) / d[i]
        if i < n - 2:
            f[i] = two[i] / d[i]
    z /= d
    for i in range(n - 2, -1, -1):
        z[i] -= e[i] * z[i + 1] + (f[i] * z[i + 2] if i < n - 2 else 0.0)
    return z


def motion_mask(x: np.ndarray, k: int, gamma: float = 0.9) -> np.ndarray:
    """Samples whose moving deviation over 2k + 1 samples passes mean + gamma sd of it."""
    v = np.lib.stride_tricks.sliding_window_view(np.pad(x, k, mode="edge"), 2 * k + 1).std(-1)
    return v > v.mean() + gamma * v.std()


def trend(y: np.ndarray, most: float | None = None) -> np.ndarray:
    """Smooth curve whose squared residuals sum to `most` (n times the variance if not given): the least-squares
    cubic where that suffices, as it does by default, else a smoothing spline just stiff enough."""
    t = np.linspace(-1, 1, len(y))
    most = len(y) * y.var() if most is None else most
    cubic = np.polynomial.polynomial.polyval(t, np.polynomial.polynomial.polyfit(t, y, 3))
    if ((y - cubic) ** 2).sum() <= most * (1 + 1e-9) + 1e-300:
        return cubic
    lo, hi = -12.0, 12.0  # log10 of the stiffness
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ((y - smooth(y, 10**mid)) ** 2).sum() <= most else (lo, mid)
    return smooth(y, 10**lo)


def spline_correction(x: np.ndarray, fs: float, k: int | None = None, gamma: float = 0.9, smoothing: float | None = None, recenter: bool = True) -> np.ndarray:
    """Takes a smooth curve off each motion run of over 3 samples and puts the run at the level of the k samples
    before it; what follows a run moves as a whole, so that its first k samples are at that level too. k is
    2.5 s if not given. The result has mean 0 unless recenter is off."""
    k = max(1, round(2.5 * fs)) if k is None else k
    bad, out = motion_mask(x, k, gamma), x.astype(float).copy()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], bad.astype(int), [0]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a <= 3:
            continue
        rest = out[a:b] - trend(out[a:b], smoothing)
        level = out[a - min(k, a) : a].mean() if a else rest[0]
        out[a:b] = rest + level
        if b < len(out):
            out[b:] += level - out[b : b + k].mean()
    return out - out.mean() if recenter else out


# regressors ------------------------------------------------------------------


def hrf(fs: float, undershoot: float = 0.16, length: float = 30.0) -> np.ndarray:
    """Double gamma response of peak 1."""
    t = np.arange(0, length, 1 / fs)
    h = t**5 * np.exp(-t) / 120 - undershoot * t**15 * np.exp(-t) / 1307674368000.0
    return h / h.max()


def task_regressor(onsets, durations, n: int, fs: float, micro: float = 10.0) -> np.ndarray:
    """Events as sticks (no duration) or boxes on a fine grid, through the response."""
    up = max(1, int(np.ceil(micro / fs)))
    fine = fs * up
    x = np.zeros(n * up)
    for o, d in zip(onsets, durations, strict=True):
        a = int(round(o * fine))
        b = a + 1 if not d > 0 else int(round((o + d) * fine))
        x[max(0, a) : max(0, b)] = 1.0
    return np.convolve(x, hrf(fine))[: n * up : up]


def fir_regressors(onsets, n: int, fs: float, duration: float = 20.0) -> np.ndarray:
    """A column a lag: one where an event began so many samples before."""
    out = np.zeros((n, int(round(duration * fs))))
    for o in onsets:
        a = int(round(o * fs))
        lag = np.arange(max(0, -a), min(out.shape[1], n - a))
        out[a + lag, lag] = 1.0
    return out


def drift_overlap(task: np.ndarray, drift: np.ndarray) -> float:
    """Share of a task column that lies in the drift space."""
    r = task - drift @ np.linalg.lstsq(drift, task, rcond=None)[0]
    return float(1 - (r @ r) / (task @ task)) if task.any() else float("nan")


def nuisance_components(pool: np.ndarray, keep: float = 0.8, drift: np.ndarray | None = None) -> np.ndarray:
    """Principal components of pooled channels (times x channels): a count, or a share of variance."""
    pool = pool[:, np.isfinite(pool).any(0)]
    pool = np.where(np.isfinite(pool), pool, np.nanmean(pool, axis=0))
    if drift is not None:
        pool = pool - drift @ np.linalg.lstsq(drift, pool, rcond=None)[0]
    sd = pool.std(0)
    z = (pool - pool.mean(0))[:, sd > 0] / sd[sd > 0]
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    share = np.cumsum(s**2) / (s**2).sum()
    m = int(np.searchsorted(share, keep - 1e-12) + 1) if keep < 1 else int(keep)
    return u[:, :m] * s[:m]


def shift_t(y: np.ndarray, task: np.ndarray, other: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Least-squares t of a task column under circular shifts of it; other holds the rest of the design."""
    q = np.linalg.qr(other)[0]
    off = lambda v: v - q @ (q.T @ v)
    r, df, out = off(y), len(y) - other.shape[1] - 1, []
    for s in shifts:
        x = off(np.roll(task, int(s)))
        xx = x @ x
        b = x @ r / xx
        e = r - b * x
        out.append(b / np.sqrt(e @ e / df / xx))
    return np.array(out)
