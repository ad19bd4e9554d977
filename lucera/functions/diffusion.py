"""Photon diffusion in numpy: boundary reflectance, Green's functions, fits."""

from __future__ import annotations

import functools

import numpy as np

C = 2.99792458e10


@functools.lru_cache(maxsize=64)
def effective_reflectance(n1: float, n2: float = 1.0, points: int = 2000) -> float:
    """Effective reflectance of a boundary, by integrating Fresnel reflection; needs n1 >= n2."""
    if n2 > n1:
        return float("nan")
    x, w = np.polynomial.legendre.leggauss(points)
    th, w = (x + 1) * np.pi / 4, w * np.pi / 4
    s = n1 / n2 * np.sin(th)
    cos_t = np.sqrt(np.clip(1 - s * s, 0, None))
    c = np.cos(th)
    rs, rp = ((n1 * c - n2 * cos_t) / (n1 * c + n2 * cos_t)) ** 2, ((n1 * cos_t - n2 * c) / (n1 * cos_t + n2 * c)) ** 2
    r = np.where(s >= 1, 1.0, (rs + rp) / 2)
    flux = (w * 2 * np.sin(th) * c * r).sum()
    current = (w * 3 * np.sin(th) * c * c * r).sum()
    return float((flux + current) / (2 - flux + current))


def semi_infinite(rho, k, mua, musp, r_eff: float, z: float = 0.0):
    """Fluence of a point source one transport length deep and its image; k may be complex."""
    d = 1 / (3 * (mua + musp))
    z0 = 1 / (mua + musp)
    zb = 2 * d * (1 + r_eff) / (1 - r_eff)
    r1, r2 = np.sqrt(rho**2 + (z - z0) ** 2), np.sqrt(rho**2 + (z + z0 + 2 * zb) ** 2)
    return (np.exp(-k * r1) / r1 - np.exp(-k * r2) / r2) / (4 * np.pi * d)


def fd_fluence(rho, mua: float, musp: float, n: float, freq: float = 0.0):
    """Complex fluence at a modulation frequency (cm, Hz)."""
    k = np.sqrt(3 * (mua + musp) * (mua - 2j * np.pi * freq * n / C) + 0j)
    return semi_infinite(rho, k, mua, musp, effective_reflectance(n))


def td_fluence(t, rho: float, mua: float, musp: float, n: float, freq_max: float = 2e10, n_freq: int = 2048):
    """Time-domain fluence: a frequency sweep, inverted and interpolated at t (s)."""
    f = np.linspace(0, freq_max, n_freq)
    k = np.sqrt(3 * (mua + musp) * (mua + 2j * np.pi * f * n / C) + 0j)
    spectrum = semi_infinite(rho, k, mua, musp, effective_reflectance(n))
    series = np.fft.irfft(spectrum) * 2 * (n_freq - 1) * (f[1] - f[0])
    step = 1 / (2 * (n_freq - 1) * (f[1] - f[0]))
    return np.interp(t, np.arange(len(series)) * step, series, left=0.0, right=0.0)


def displacement(tau, model: str = "brownian", **p):
    if model == "brownian":
        return 6 * p["adb"] * tau
    if model == "langevin":
        return 6 * p["adb"] * (tau - p["tc"] * (1 - np.exp(-tau / p["tc"])))
    return p["av2"] * tau**2


def dcs_g1(rho: float, mua: float, musp: float, n: float, wavelength_nm: float, tau, model: str = "brownian", **p):
    """Normalised field autocorrelation."""
    k0 = 2 * np.pi * n / (wavelength_nm * 1e-7)
    mut = mua + musp
    k = lambda t: np.sqrt(3 * mua * mut + mut * musp * k0**2 * displacement(t, model, **p))
    r = effective_reflectance(n)
    return semi_infinite(rho, k(np.asarray(tau)), mua, musp, r) / semi_infinite(rho, k(0.0), mua, musp, r)


def siegert(g1, beta: float):
    return 1 + beta * np.abs(g1) ** 2


def fit_bounded(residual, bounds: dict[str, tuple[float, float]], log: tuple[str, ...] = (), starts: int | None = None, seed: int = 0, steps: int = 60) -> tuple[dict[str, float], float, np.ndarray]:
    """Least squares within bounds by damped Gauss-Newton from several starts in the unit box.

    Returns parameters, cost and their covariance. A parameter in `log` is searched by its decimal
    logarithm."""
    names = list(bounds)
    lo = np.array([np.log10(bounds[k][0]) if k in log else bounds[k][0] for k in names])
    hi = np.array([np.log10(bounds[k][1]) if k in log else bounds[k][1] for k in names])
    is_log = np.array([k in log for k in names])
    value = lambda u: dict(zip(names, np.where(is_log, 10.0 ** (x := lo + u * (hi - lo)), x).tolist(), strict=True))
    f = lambda u: np.asarray(residual(**value(u)), float)

    def slope(u, r):
        cols = []
        for i in range(len(u)):
            h = 1e-6 if u[i] < 0.5 else -1e-6
            v = u.copy()
            v[i] += h
            cols.append((f(v) - r) / h)
        return np.stack(cols, 1)

    rng = np.random.default_rng(seed)
    best = None
    for _ in range(starts or max(8, 4 * len(names))):
        u, damp = rng.random(len(names)), 1e-2
        r = f(u)
        for _ in range(steps):
            j = slope(u, r)
            a, g = j.T @ j, j.T @ r
            moved = False
            for _ in range(8):
                v = np.clip(u - np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0], 0, 1)
                q = f(v)
                if np.isfinite(q).all() and q @ q < r @ r:
                    small = r @ r - q @ q < 1e-14 * (r @ r)
                    u, r, damp, moved = v, q, damp / 5, True
                    break
                damp *= 4
            if not moved or small:
                break
        if best is None or r @ r < best[1]:
            best = (u, float(r @ r))
    u, cost = best
    j = slope(u, f(u))
    dof = max(1, len(j) - len(names))
    jac = np.array([(hi - lo)[i] * (np.log(10) * value(u)[k] if is_log[i] else 1) for i, k in enumerate(names)])
    return value(u), cost, np.linalg.pinv(j.T @ j) * cost / dof * np.outer(jac, jac)


def fit_fd(rho, data, n: float, freq: float, bounds=None) -> dict[str, float]:
    """mua and musp from complex data at several distances, on ratios to the first."""
    bounds = bounds or {"mua": (0.001, 0.5), "musp": (1.0, 30.0)}
    rho, data = np.asarray(rho, float), np.asarray(data, complex)

    def residual(mua, musp):
        m = fd_fluence(rho, mua, musp, n, freq)
        r = np.log(data[1:] / data[0]) - np.log(m[1:] / m[0])
        return np.concatenate([r.real, (r.imag + np.pi) % (2 * np.pi) - np.pi])

    return fit_bounded(residual, bounds)[0]


def fit_dcs(tau, g2, rho: float, mua: float, musp: float, n: float, wavelength_nm: float, bounds=None) -> dict[str, float]:
    """Flow index and beta from an intensity autocorrelation."""
    bounds = bounds or {"adb": (1e-11, 1e-6), "beta": (0.05, 1.0)}
    return fit_bounded(lambda adb, beta: siegert(dcs_g1(rho, mua, musp, n, wavelength_nm, tau, adb=adb), beta) - g2, bounds, log=("adb",))[0]


def tikhonov(j: np.ndarray, alpha: float) -> np.ndarray:
    """Regularised inverse J' (J J' + alpha max(J J') I)^-1."""
    g = j @ j.T
    return j.T @ np.linalg.inv(g + alpha * np.diag(g).max() * np.eye(len(g)))
