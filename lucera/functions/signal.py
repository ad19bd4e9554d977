"""Signal kernels in numpy: they know neither Spark nor pandas, and take one series at a time."""

from __future__ import annotations

import math

import numpy as np


def butter_sos(order: int, cutoff: float, fs: float, kind: str) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a0 a1 a2) of a Butterworth low or high pass, by the bilinear transform."""
    nyquist = fs / 2
    w = math.tan(math.pi * min(max(cutoff, 1e-3 * nyquist), 0.99 * nyquist) / fs)
    rows = []
    for k in range(order // 2):
        q = 2 * math.sin(math.pi * (2 * k + 1) / (2 * order))
        a0 = 1 + q * w + w * w
        b = [w * w, 2 * w * w, w * w] if kind == "low" else [1.0, -2.0, 1.0]
        rows.append([*(x / a0 for x in b), 1.0, 2 * (w * w - 1) / a0, (1 - q * w + w * w) / a0])
    if order % 2:
        a0 = 1 + w
        b = [w, w, 0.0] if kind == "low" else [1.0, -1.0, 0.0]
        rows.append([*(x / a0 for x in b), 1.0, (w - 1) / a0, 0.0])
    return np.array(rows)


def bandpass_sos(order: int, low: float, high: float, fs: float) -> np.ndarray:
    """Sections of one Butterworth band pass of 2 x order poles, from the low-pass prototype's poles by the bilinear transform."""
    w1, w2 = (math.tan(math.pi * f / fs) for f in (low, high))
    width, centre = w2 - w1, math.sqrt(w1 * w2)
    rows = []
    for k in range(order):
        half = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) * width / 2
        for s in (half + np.sqrt(half * half - centre**2 + 0j), half - np.sqrt(half * half - centre**2 + 0j)):
            z = (1 + s) / (1 - s)
            if z.imag > 1e-14:
                rows.append([1.0, 0.0, -1.0, 1.0, -2 * z.real, abs(z) ** 2])
            elif abs(z.imag) <= 1e-14:
                rows.append([z.real])
    real = [r[0] for r in rows if len(r) == 1]  # a wide band has real poles, in pairs
    out = np.array([r for r in rows if len(r) > 1] + [[1.0, 0.0, -1.0, 1.0, -(p + q), p * q] for p, q in zip(real[::2], real[1::2], strict=True)])
    u = np.exp(-2j * math.atan(centre))
    gain = np.abs(np.prod((1 - u * u) / (1 + out[:, 4] * u + out[:, 5] * u * u)))
    out[0, :3] /= gain
    return out


def _section(s: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    b0, b1, b2, _, a1, a2 = s
    out, (z1, z2) = np.empty_like(x.T), z
    for i, v in enumerate(x.tolist() if x.ndim == 1 else x.T):
        y = b0 * v + z1
        z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
        out[i] = y
    return out.T


def _steady(s: np.ndarray) -> np.ndarray:
    """State of a section at rest under a constant input of 1."""
    b0, b1, b2, _, a1, a2 = s
    gain = (b0 + b1 + b2) / (1 + a1 + a2)
    return np.array([gain - b0, b2 - a2 * gain])


def sosfilt(sos: np.ndarray, x: np.ndarray, rest: bool = False) -> np.ndarray:
    """Along the last axis."""
    for s in sos:
        x = _section(s, x, np.multiply.outer(_steady(s), x[..., 0]) if rest else np.zeros((2, *x.shape[:-1])))
    return x


def filtfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero phase along the last axis: forward and backward over an odd extension by three times the filter's length."""
    pad = min(x.shape[-1] - 1, 3 * (2 * len(sos) + 1 - int((sos[:, 2] == 0).sum())))
    if pad < 1:
        return x.copy()
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1)
    for _ in range(2):
        ext = sosfilt(sos, ext, rest=True)[..., ::-1]
    return ext[..., pad : ext.shape[-1] - pad]


def frequency_filter(x: np.ndarray, fs: float, low: float | None = None, high: float | None = None, order: int = 3) -> np.ndarray:
    """Band limits: high pass above `low`, low pass below `high`; series with gaps give NaN."""
    if not np.isfinite(x).all():
        return np.full_like(x, np.nan)
    if low:
        x = filtfilt(butter_sos(order, low, fs, "high"), x)
    return filtfilt(butter_sos(order, high, fs, "low"), x) if high else x


def band_pass(x: np.ndarray, fs: float, low: float, high: float, order: int = 3) -> np.ndarray:
    """Zero-phase band pass by one filter; series with gaps give NaN."""
    if high >= fs / 2:
        raise ValueError("the band ends beyond half the sampling rate")
    return filtfilt(bandpass_sos(order, low, high, fs), x) if np.isfinite(x).all() else np.full_like(x, np.nan)


def tddr(x: np.ndarray, fs: float, cutoff: float = 0.5, order: int = 3, tune: float = 4.685, max_iter: int = 50) -> np.ndarray:
    """Temporal derivative repair: robust weights on the first difference of the low-passed series."""
    mean = x.mean()
    y = x - mean
    low = filtfilt(butter_sos(order, cutoff, fs, "low"), y) if cutoff < fs / 2 else y
    d = np.diff(low)
    w, mu = np.ones_like(d), np.inf
    for _ in range(max_iter):
        last, mu = mu, (w * d).sum() / w.sum()
        r = np.abs(d - mu)
        sigma = 1.4826 * np.median(r)
        if sigma == 0:
            break
        u = r / (sigma * tune)
        w = np.where(u < 1, (1 - u * u) ** 2, 0.0)
        if abs(mu - last) < math.sqrt(np.finfo(float).eps) * max(abs(mu), abs(last)) or w.sum() == 0:
            break
    fixed = np.concatenate([[0.0], np.cumsum(w * (d - mu))])
    return fixed - fixed.mean() + (y - low) + mean


#: Reconstruction low pass of the Daubechies wavelet of two vanishing moments; the others mirror it.
_LOW = np.array([1 + math.sqrt(3), 3 + math.sqrt(3), 3 - math.sqrt(3), 1 - math.sqrt(3)]) / (4 * math.sqrt(2))
_HIGH = _LOW[::-1] * np.array([1, -1, 1, -1])


def dwt_depth(n: int) -> int:
    """Levels until a level would be shorter than the filter."""
    return max(0, int(math.log2(n / 3))) if n >= 3 else 0


def dwt(x: np.ndarray, level: int) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """db2 transform over a series mirrored at its ends: approximation, details (coarse last), lengths."""
    details, sizes = [], []
    for _ in range(level):
        sizes.append(len(x))
        ext = np.pad(x, 3, mode="symmetric") if len(x) >= 3 else np.pad(x, 3, mode="edge")
        at = 2 * np.arange((len(x) + 3) // 2)[:, None] + 1 + np.arange(4)
        details.append(ext[at] @ _HIGH)
        x = ext[at] @ _LOW
    return x, details, sizes


def idwt(a: np.ndarray, details: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    for d, n in zip(reversed(details), reversed(sizes), strict=True):
        out, at = np.zeros(2 * len(d) + 2), 2 * np.arange(len(d))[:, None] + np.arange(4)
        np.add.at(out, at, a[: len(d), None] * _LOW + d[:, None] * _HIGH)
        a = out[2 : 2 + n]
    return a


def wavelet_correction(x: np.ndarray, alpha: float | None = None, iqr: float | None = None, level: int | None = None, recenter: bool = True) -> np.ndarray:
    """Zeroes outlying details and inverts. By alpha (0.1 unless iqr is given) those go whose two-sided normal
    probability is below it, with the median as centre and the scaled median deviation as scale; by iqr those
    outside so many quartile distances from the quartiles. The result has mean 0 unless recenter is off."""
    if alpha is not None and iqr is not None:
        raise ValueError("alpha and iqr are two ways to give one threshold")
    most = dwt_depth(len(x))
    level = most if level is None else min(level, most)
    if level < 1:
        raise ValueError("the series is too short for one level")
    a, details, sizes = dwt(x, level)
    for d in details:
        if iqr is not None:
            lo, hi = np.percentile(d, [25, 75])
            d[(d < lo - iqr * (hi - lo)) | (d > hi + iqr * (hi - lo))] = 0
        else:
            off = np.abs(d - np.median(d))
            scale = max(1.4826 * np.median(off), np.finfo(float).eps)
            tail = np.array([math.erfc(v) for v in off / scale / math.sqrt(2)])
            d[tail < (0.1 if alpha is None else alpha)] = 0
    y = idwt(a, details, sizes)
    return y - y.mean() if recenter else y


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Rational resampling with a Kaiser-windowed low pass of half length 10 max(up, down)."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return x.copy()
    half, rate = 10 * max(up, down), max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / rate) / rate * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    dense = np.zeros(len(x) * up)
    dense[::up] = x
    return np.convolve(dense, h)[half : half + len(dense)][::down]


def welch(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Power density by Hann segments, half overlapping, means removed."""
    return cross_welch(x, x, fs, nperseg)[0], cross_welch(x, x, fs, nperseg)[1].real


def cross_welch(x: np.ndarray, y: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    n = min(nperseg, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, len(x) - n + 1, max(1, n - n // 2))
    seg = lambda v: np.fft.rfft(np.stack([(v[s : s + n] - v[s : s + n].mean()) * w for s in starts]), axis=1)
    p = (np.conj(seg(x)) * seg(y)).mean(0) / (fs * (w * w).sum())
    p[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), p


def coherence(x: np.ndarray, y: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude-squared coherence."""
    f, xy = cross_welch(x, y, fs, nperseg)
    xx, yy = cross_welch(x, x, fs, nperseg)[1].real, cross_welch(y, y, fs, nperseg)[1].real
    with np.errstate(divide="ignore", invalid="ignore"):
        return f, np.abs(xy) ** 2 / (xx * yy)


def heart_rate(x: np.ndarray, fs: float, low: float = 0.7, high: float = 2.2, zero_pad: int = 4) -> float:
    """Beats a minute: peak of the Hann-windowed, zero-padded spectrum with a parabola through it."""
    y = frequency_filter(x - x.mean(), fs, low, high)
    n = zero_pad * len(y)
    p = np.abs(np.fft.rfft(y * np.hanning(len(y)), n))
    f = np.fft.rfftfreq(n, 1 / fs)
    band = np.flatnonzero((f >= low) & (f <= high))
    if not len(band) or not p[band].any():
        return float("nan")
    k = int(band[p[band].argmax()])
    shift = 0.0
    if 0 < k < len(p) - 1:
        a, b, c = p[k - 1 : k + 2]
        shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return 60 * (k + shift) * fs / n


def phase_randomized(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Surrogate of the same spectrum; series of an array turn by the same phases."""
    f = np.fft.rfft(x)
    turn = np.exp(2j * np.pi * rng.random(f.shape[-1]))
    turn[0] = 1
    if x.shape[-1] % 2 == 0:
        turn[-1] = 1
    return np.fft.irfft(f * turn, x.shape[-1])


def dct_drift_basis(n: int, fs: float, cutoff: float) -> np.ndarray:
    """A constant and the cosines below a cutoff, of unit norm."""
    k = np.arange(int(math.floor(2 * n / fs * cutoff)) + 1)
    b = np.cos(np.pi * (np.arange(n)[:, None] + 0.5) * k / n)
    return b / np.linalg.norm(b, axis=0)


# statistics ---------------------------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) > 0 else -1)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    """Upper tail of Student's t."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_p_value(t: float, df: float, tail: str = "two") -> float:
    return 2 * t_sf(abs(t), df) if tail == "two" else t_sf(t if tail == "up" else -t, df)


def _bisquare(r: np.ndarray, tune: float) -> tuple[np.ndarray, float]:
    """Weights of residuals, and their scale: the median absolute one, as of a normal."""
    scale = np.median(np.abs(r)) / 0.6744897501960817
    if scale == 0:
        return np.ones(len(r)), 0.0
    u = np.abs(r) / (tune * scale)
    return np.where(u < 1, (1 - u * u) ** 2, 0.0), scale


def robust_fit(x: np.ndarray, y: np.ndarray, tune: float = 4.685, max_iter: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Tukey bisquare regression by reweighting: coefficients and weights."""
    b, w = np.linalg.lstsq(x, y, rcond=None)[0], np.ones(len(y))
    for _ in range(max_iter):
        w, scale = _bisquare(y - x @ b, tune)
        if scale == 0:
            break
        q = np.sqrt(w)
        new = np.linalg.lstsq(x * q[:, None], y * q, rcond=None)[0]
        done = np.abs(new - b).max() <= 1e-8 * max(1.0, np.abs(b).max())
        b = new
        if done:
            break
    return b, w


def robust_covariance(x: np.ndarray, r: np.ndarray, tune: float = 4.685) -> np.ndarray:
    """Huber's covariance of a bisquare fit with residuals r: (X'X)^-1 times k^2 s^2 (sum psi^2 / df) / (mean psi')^2,
    where k corrects for the spread of psi'."""
    n, p = x.shape
    _, scale = _bisquare(r, tune)
    inverse = np.linalg.pinv(x)
    inverse = inverse @ inverse.T
    if scale == 0:
        return inverse * 0.0
    u = r / scale
    inside = np.abs(u) < tune
    v = (u / tune) ** 2
    psi, slope = np.where(inside, u * (1 - v) ** 2, 0.0), np.where(inside, (1 - v) * (1 - 5 * v), 0.0)
    mean = slope.mean()
    k = 1 + p / n * slope.var() / mean**2
    return inverse * k**2 * scale**2 * (psi @ psi / (n - p)) / mean**2


def ar_coefficients(r: np.ndarray, pmax: int) -> np.ndarray:
    """Autoregression of the order, 0 to pmax, that BIC prefers: lags of the series forward and backward
    (zero before their starts) and a constant, by least squares; the constant is left out."""
    n = len(r)
    pmax = max(1, min(pmax, n - 1))
    ways = (r, r[::-1])
    lagged = np.concatenate([np.stack([np.concatenate([np.zeros(k), v[: n - k]]) for k in range(1, pmax + 1)], 1) for v in ways])
    x, y = np.column_stack([np.ones(2 * n), lagged]), np.concatenate(ways)
    best, coef = np.inf, np.zeros(0)
    for p in range(pmax + 1):
        c = np.linalg.lstsq(x[:, : p + 1], y, rcond=None)[0]
        mse = ((y - x[:, : p + 1] @ c) ** 2).mean()
        bic = 2 * n * math.log(mse) + (p + 1) * math.log(2 * n) if mse > 0 else np.inf
        if bic < best:
            best, coef = bic, c[1:]
    return coef


def whitened(v: np.ndarray, f: np.ndarray) -> np.ndarray:
    """A series through the filter f as if it had stood at its first value before."""
    return np.convolve(v - v[0], f)[: len(v)] + f.sum() * v[0]


def ar_irls(y: np.ndarray, x: np.ndarray, pmax: int, max_iter: int = 10) -> tuple[np.ndarray, np.ndarray, int]:
    """Regression on data whitened by an autoregression of its residuals, robust, until the coefficients
    change by 1 % at most (in length): coefficients, covariance, AR order."""
    b, order, cov = np.linalg.lstsq(x, y, rcond=None)[0], 0, np.zeros((x.shape[1],) * 2)
    for _ in range(max_iter):
        a = ar_coefficients(y - x @ b, pmax)
        order, f = len(a), np.concatenate([[1.0], -a])
        xw, yw = np.stack([whitened(c, f) for c in x.T], 1), whitened(y, f)
        new = robust_fit(xw, yw)[0]
        cov = robust_covariance(xw, yw - xw @ new)
        done = np.linalg.norm(new - b) <= 1e-2 * np.linalg.norm(b)
        b = new
        if done:
            break
    return b, cov, order
