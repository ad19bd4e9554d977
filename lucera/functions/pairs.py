"""Pair measures of many series at once, in numpy: what one series needs is worked out once, not once a pair.

A measure is a function of (fs, n, options) that gives two functions: prepare(x) of series x (series x n)
gives arrays whose first axis is the series; combine(p, q, i, j) gives the values of the pairs (p[i], q[j])
of such arrays. Values are those of the measures of one pair.
"""

from __future__ import annotations

import numpy as np

from lucera.functions import signal, spectra

#: Series of a block: temporary arrays hold a block's pairs, however many series there are.
BLOCK = 64
#: Cells (frames x pairs) of a block where series lack values.
CELLS = 1_000_000


def values(x: np.ndarray, y: np.ndarray | None, measure) -> np.ndarray:
    """Matrix of a measure over series of x with those of y; without y, over the pairs i < j of x, else NaN."""
    prepare, combine = measure
    p = prepare(x)
    q = p if y is None else prepare(y)
    cut = lambda arrays, a: tuple(v[a : a + BLOCK] for v in arrays)
    out = np.full((len(x), len(x if y is None else y)), np.nan)
    for a in range(0, out.shape[0], BLOCK):
        for b in range(0 if y is not None else a, out.shape[1], BLOCK):
            block = out[a : a + BLOCK, b : b + BLOCK]
            i, j = np.nonzero(np.ones(block.shape, bool)) if y is not None or a != b else np.triu_indices(len(block), 1)
            block[i, j] = combine(cut(p, a), cut(q, b), i, j)
    return out


def _standard(x: np.ndarray) -> np.ndarray:
    """Series of mean 0 and length 1 along the last axis; NaN where flat."""
    c = x - x.mean(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = c / np.sqrt((c * c).sum(-1, keepdims=True))
    c[x.std(-1) == 0] = np.nan
    return c


def _median(v: np.ndarray) -> np.ndarray:
    """Medians over the first axis of what is not NaN."""
    if not np.isnan(v).any():
        return np.median(v, axis=0)
    out, some = np.full(v.shape[1:], np.nan), ~np.isnan(v).all(0)
    out[some] = np.nanmedian(v[:, some], axis=0)
    return out


def pearson(fs: float, n: int):
    def combine(p, q, i, j):
        return np.clip(p[0] @ q[0].T, -1, 1)[i, j]

    return lambda x: (_standard(x),), combine


def common_frames(frame: np.ndarray, channel: np.ndarray, v: np.ndarray, known: np.ndarray):
    """Matrices of channel x channel from samples: whether two share a frame, in how many both are known, and
    their correlation over those (NaN where there is none).

    Frames and channels are codes from 0, none left out. A channel given twice in a frame pairs each of its
    values with each of its partner's. Values count from a pair's first, so that a flat series is flat exactly.
    """
    width = int(channel.max()) + 1
    cell = frame.astype(np.int64) * width + channel
    order = np.argsort(cell, kind="stable")
    frame, channel, v, known, cell = (a[order] for a in (frame, channel, v, known, cell))
    nth = np.arange(len(cell)) - np.searchsorted(cell, cell)
    times = np.ones(int(frame.max()) + 1, np.int64)
    np.maximum.at(times, frame, nth + 1)
    start = np.cumsum(times) - times
    at = start[frame] + nth
    x = np.zeros((times.sum(), width))
    has, ok = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    x[at, channel], has[at, channel], ok[at, channel] = v, True, known
    with np.errstate(all="ignore"):
        if ok.all() and len(x) == len(times):
            c = x - x[0]
            c -= c.mean(0)
            s = np.sqrt((c * c).sum(0))
            return has[:1] & has[:1].T, np.full((width, width), len(x)), c.T @ c / s / s[:, None]
        many = times**2
        f = np.repeat(np.arange(len(times)), many)
        k = np.arange(len(f)) - np.repeat(np.cumsum(many) - many, many)
        a, b = start[f] + k // times[f], start[f] + k % times[f]
        y, has_y, ok_y = (m[b][:, None] for m in (x, has, ok))
        met, n, value = np.zeros((width, width), bool), np.zeros((width, width), np.int64), np.full((width, width), np.nan)
        step = max(1, CELLS // (len(a) * width))
        for lo in range(0, width, step):
            c = slice(lo, lo + step)
            both = ok[a, c][:, :, None] & ok_y
            met[c], n[c], first = (has[a, c][:, :, None] & has_y).any(0), both.sum(0), both.argmax(0)[None]

            def centred(u):
                u = np.broadcast_to(u, both.shape)
                u = np.where(both, u - np.take_along_axis(u, first, 0), 0)
                return np.where(both, u - u.sum(0) / n[c], 0)

            p, q = centred(x[a, c][:, :, None]), centred(y)
            value[c] = (p * q).sum(0) / np.sqrt((p * p).sum(0)) / np.sqrt((q * q).sum(0))
        return met, n, value


def n_eff(fs: float, n: int, max_lag: int | None = None, taper: bool = True):
    max_lag = n // 5 if max_lag is None else max_lag
    w = 1 - np.arange(1, max_lag + 1) / (max_lag + 1) if taper else np.ones(max_lag)

    def prepare(x):
        f = np.fft.rfft(x - x.mean(-1, keepdims=True), 2 * n)
        r = np.fft.irfft(f * f.conj())[:, : max_lag + 1]
        with np.errstate(divide="ignore", invalid="ignore"):
            return ((r / r[:, :1])[:, 1:],)

    def combine(p, q, i, j):
        with np.errstate(divide="ignore"):
            return np.clip(n / (1 + 2 * ((p[0] * w) @ q[0].T)), 2, n)[i, j]

    return prepare, combine


def coherence(fs: float, n: int, low: float = 0.0, high: float = np.inf, nperseg: int = 64):
    size = min(nperseg, n)
    f = np.fft.rfftfreq(size, 1 / fs)
    band = (f >= low) & (f <= high)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def prepare(x):
        seg = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: max(1, size - size // 2)]
        u = np.fft.rfft((seg - seg.mean(-1, keepdims=True)) * w, axis=-1)[..., band]
        return u, (np.abs(u) ** 2).sum(1)

    def combine(p, q, i, j):
        cross = np.einsum("isf,jsf->ijf", p[0].conj(), q[0])[i, j]
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.abs(cross) ** 2 / (p[1][i] * q[1][j])
        return _mean(c, np.ones(c.shape[1:], bool))

    return prepare, combine


def _mean(c: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Means over all but the first axis of what keep allows and is not NaN; NaN where nothing is left."""
    ok = keep & ~np.isnan(c)
    axes = tuple(range(1, c.ndim))
    count = ok.sum(axes)
    return np.divide(np.where(ok, c, 0.0).sum(axes), count, out=np.full(len(c), np.nan), where=count > 0)


def wavelet_coherence(fs: float, n: int, low: float = 0.0, high: float = np.inf, dj: float = 0.25, mask_coi: bool = True, **grid):
    """Only the scales of the band, and those that the average over scales takes beside them, are transformed."""
    whole = spectra.scale_grid(n, fs, dj, **grid)
    at = np.flatnonzero((1 / whole >= low) & (1 / whole <= high))
    half = max(0, int(round(spectra.OCTAVES / dj)) // 2)
    first = np.maximum(at - half, 0)
    last = np.minimum(at + half + 1, len(whole))
    start, stop = (int(first.min()), int(last.max())) if len(at) else (0, 0)
    s = whole[start:stop]
    m = 1 << int(2 * n - 1).bit_length()
    kernel = np.exp(-2 * (np.pi * s[:, None] * np.fft.fftfreq(m, 1 / fs)) ** 2) / s[:, None]
    t = np.arange(n) / fs
    keep = np.minimum(t, t[-1] - t) >= np.sqrt(2) * whole[at][:, None] if mask_coi else np.ones((len(at), n), bool)

    def put(w):
        out = np.fft.ifft(np.fft.fft(w, m, axis=-1) * kernel, axis=-1)[..., :n]
        total = np.concatenate([np.zeros_like(out[..., :1, :]), np.cumsum(out, axis=-2)], axis=-2)
        return (total[..., last - start, :] - total[..., first - start, :]) / (last - first)[:, None]

    def prepare(x):
        w = np.stack([spectra.morlet(v, fs, s) for v in x]) if len(at) else np.zeros((len(x), 0, n), complex)
        return w, np.stack([put(np.abs(v) ** 2 + 0j).real for v in w])

    def combine(p, q, i, j):
        out = np.full(len(i), np.nan)
        for k in range(0, len(i) if len(at) else 0, BLOCK):
            a, b = i[k : k + BLOCK], j[k : k + BLOCK]
            with np.errstate(divide="ignore", invalid="ignore"):
                c = np.clip(np.abs(put(p[0][a] * q[0][b].conj())) ** 2 / (p[1][a] * q[1][b]), 0, 1)
            out[k : k + BLOCK] = _mean(c, keep)
        return out

    return prepare, combine


def scalp_coupling(fs: float, n: int, band=(0.5, 2.5), length: float = 5.0, step: float | None = None):
    spans = spectra.windows(n, fs, length, step)

    def prepare(x):
        y = signal.band_pass(x, fs, *band)
        return (np.stack([_standard(y[:, a:b]) for a, b in spans], axis=1) if spans else np.zeros((len(x), 0, 0)),)

    def combine(p, q, i, j):
        r = np.clip(p[0].swapaxes(0, 1) @ q[0].transpose(1, 2, 0), -1, 1)
        return _median(r[:, i, j]) if spans else np.full(len(i), np.nan)

    return prepare, combine


def peak_power(fs: float, n: int, band=(0.5, 2.5), length: float = 10.0, step: float | None = None):
    """The spectrum of a circular cross-correlation is the product of the spectra: a pair needs no transform."""
    spans = spectra.windows(n, fs, length, step)
    size = int(length * fs)
    f = np.fft.rfftfreq(size, 1 / fs) if size else np.zeros(0)
    keep = (f >= band[0] - 0.1) & (f <= band[1] + 0.1)
    weight = np.full(len(f), 1.0 / size**4 if size else 0.0)
    weight[1 : (size + 1) // 2] *= 2
    weight[:1] = 0.0  # the mean is taken off

    def prepare(x):
        y, out = signal.band_pass(x, fs, *band), []
        for a, b in spans:
            sd = y[:, a:b].std(-1)
            u = np.fft.rfft(y[:, a:b] / np.where(sd > 0, sd, np.nan)[:, None])
            out.append(np.abs(u[:, keep]) ** 2)
        return (np.stack(out, axis=1) if out else np.zeros((len(x), 0, 0)),)

    def combine(p, q, i, j):
        if not spans or not keep.any():
            return np.full(len(i), np.nan)
        most = [((p[0][:, k] * weight[keep])[:, None] * q[0][None, :, k]).max(-1)[i, j] for k in range(len(spans))]
        return _median(np.stack(most))

    return prepare, combine


def bias_corrected(measure, n: int, surrogates: int = 200, seed: int = 0):
    """(observed - mean) / sd over pairs of phase-randomised surrogates: every pair draws the same phases, so the
    surrogates of a series are made once for all its pairs."""
    prepare, combine = measure

    def corrected(p, q, i, j):
        rng = np.random.default_rng(seed)
        null = np.empty((surrogates, len(i)))
        for k in range(surrogates):
            u = signal.phase_randomized(p[0], rng)
            null[k] = combine(prepare(u), prepare(signal.phase_randomized(q[0], rng)), i, j)
        sd = null.std(0)
        return (combine(p[1:], q[1:], i, j) - null.mean(0)) / np.where(sd > 0, sd, np.nan)

    return lambda x: (x, *prepare(x)), corrected
