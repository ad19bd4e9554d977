"""Layered media in numpy: Green's functions by a Hankel integral, instrument responses, noise."""

from __future__ import annotations

import functools
import math

import numpy as np

from lucera.functions.diffusion import C, displacement, effective_reflectance, semi_infinite, siegert


@functools.lru_cache(maxsize=8)
def _rule(points: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(points)


def bessel_j0(x: np.ndarray) -> np.ndarray:
    """J0 by the trapezoid rule on its cosine integral, which converges geometrically."""
    x = np.asarray(x, float)
    m = int(np.abs(x).max(initial=0.0)) + 40
    th = (np.arange(m) + 0.5) * np.pi / m
    return np.cos(x[..., None] * np.sin(th)).mean(-1)


def layered(rho: float, k_sq, mua, musp, thickness, r_eff: float, panels: int | None = None):
    """Fluence at the surface over layers of one refractive index, the last one endless.

    k_sq: layers x cases, complex or real; thickness: of all layers but the last (cm). The free
    and image terms of the first layer are in closed form; what the lower layers reflect is the
    integral, so equal layers give the semi-infinite result exactly.
    """
    mua, musp, thickness = (np.asarray(v, float) for v in (mua, musp, thickness))
    k_sq = np.asarray(k_sq).reshape(len(mua), -1)
    d, z0 = 1 / (3 * (mua + musp)), 1 / (mua[0] + musp[0])
    if len(thickness) != len(mua) - 1:
        raise ValueError("one thickness a layer, the last layer excepted")
    base = semi_infinite(rho, np.sqrt(k_sq[0] + 0j), mua[0], musp[0], r_eff)
    if len(mua) == 1:
        return base
    if thickness[0] <= z0:
        raise ValueError("the first layer must hold the source, one transport length deep")
    zb = 2 * d[0] * (1 + r_eff) / (1 - r_eff)
    top = 45 / (2 * thickness[0] - z0)
    x, w = _rule(48)
    panels = panels or 10 + int(top * rho / np.pi / 4)
    edges = np.linspace(0, top, panels + 1)
    half = np.diff(edges) / 2
    s = (edges[:-1, None] + half[:, None] * (x + 1)).ravel()
    w = (half[:, None] * w).ravel()
    a = np.sqrt(s[None, :, None] ** 2 + k_sq[:, None, :] + 0j)
    admit = d[-1] * a[-1]
    for i in range(len(mua) - 2, 0, -1):
        own, th = d[i] * a[i], np.tanh(a[i] * thickness[i])
        admit = own * (admit + own * th) / (own + admit * th)
    own = d[0] * a[0]
    gamma = (own - admit) / (own + admit)
    length, u0, u = thickness[0] + zb, z0 + zb, zb
    e = lambda v: np.exp(-a[0] * v)
    back = gamma * (e(2 * length - u0 - u) - e(2 * length + u0 - u) - e(2 * length - u0 + u) + e(2 * length + u0 + u)) / (2 * own * (1 + gamma * e(2 * length)))
    return base + np.einsum("s,sk->k", w * s * bessel_j0(s * rho), back) / (2 * np.pi)


def layered_fd(rho: float, mua, musp, thickness, n: float, freq=0.0, r_eff: float | None = None):
    """Complex fluence of layers at modulation frequencies (Hz)."""
    mua, musp = np.asarray(mua, float), np.asarray(musp, float)
    k_sq = 3 * (mua + musp)[:, None] * (mua[:, None] - 2j * np.pi * np.atleast_1d(freq) * n / C)
    return layered(rho, k_sq, mua, musp, thickness, effective_reflectance(n) if r_eff is None else r_eff)


def layered_g1(rho: float, mua, musp, thickness, n: float, wavelength_nm: float, tau, motions: list[dict], model: str = "brownian"):
    """Normalised field autocorrelation; motions: the motion parameters of each layer."""
    mua, musp, tau = np.asarray(mua, float), np.asarray(musp, float), np.concatenate([[0.0], np.atleast_1d(tau)])
    k0 = 2 * np.pi * n / (wavelength_nm * 1e-7)
    moved = np.stack([displacement(tau, model, **m) for m in motions])
    mut = (mua + musp)[:, None]
    g = layered(rho, 3 * mua[:, None] * mut + mut * musp[:, None] * k0**2 * moved, mua, musp, thickness, effective_reflectance(n)).real
    return g[1:] / g[0]


def sweep_to_td(fluence, t, freq_max: float = 2e10, n_freq: int = 1024):
    """Time-domain fluence at t (s) of fluence(frequencies): sweep, inverse transform, interpolate."""
    f = np.linspace(0, freq_max, n_freq)
    df = f[1]
    series = np.fft.irfft(np.conj(fluence(f))) * 2 * (n_freq - 1) * df
    return np.interp(t, np.arange(len(series)) / (2 * (n_freq - 1) * df), series, left=0.0, right=0.0)


def layered_td(t, rho: float, mua, musp, thickness, n: float, **sweep):
    return sweep_to_td(lambda f: layered_fd(rho, mua, musp, thickness, n, f), t, **sweep)


def gate_counts(fluence, delays: np.ndarray, widths: np.ndarray) -> np.ndarray:
    return fluence(delays) * widths


def layer_arguments(p: dict[str, float], layers: int) -> dict[str, list[float]]:
    """{mua_1, musp_1, d_1, ...} -> the arguments of a layered model; one `musp` may serve all layers."""
    pick = lambda k, m: [p[f"{k}_{i}"] if f"{k}_{i}" in p else p[k] for i in range(1, m + 1)]
    return {"mua": pick("mua", layers), "musp": pick("musp", layers), "thickness": pick("d", layers - 1)}


def layer_bounds(layers: int, mua=(0.001, 0.5), musp=(1.0, 30.0), depth=(0.2, 3.0), adb=None) -> dict[str, tuple[float, float]]:
    out = {f"{k}_{i}": b for k, b in (("mua", mua), ("musp", musp)) for i in range(1, layers + 1)}
    out |= {f"d_{i}": depth for i in range(1, layers)}
    return out | ({f"adb_{i}": adb for i in range(1, layers + 1)} if adb else {})


def emg_response(t, t0: float, sigma: float, tau: float) -> np.ndarray:
    """Gaussian instrument response with an exponential tail, of unit sum."""
    t = np.asarray(t, float)
    z = (sigma / tau - (t - t0) / sigma) / math.sqrt(2)
    # exp(z^2) erfc(z) stays finite where z is large
    tail = np.array([math.exp(min(700.0, v * v)) * math.erfc(v) if v < 20 else 1 / (v * math.sqrt(math.pi)) for v in z])
    v = np.exp(-(((t - t0) / sigma) ** 2) / 2) * tail
    return v / v.sum()


def through_response(signal: np.ndarray, response: np.ndarray) -> np.ndarray:
    """Causal convolution with a response scaled to unit sum, as long as the signal."""
    return np.convolve(signal, response / response.sum())[: len(signal)]


def fd_noise_sigma(data: np.ndarray, level: float, kind: str = "proportional") -> np.ndarray:
    """Relative sigma per channel; shot noise grows as light falls, `level` at the brightest."""
    a = np.abs(data)
    return np.full(a.shape, level) if kind == "proportional" else level * np.sqrt(a.max() / a)


def fd_noise(data: np.ndarray, level: float, rng: np.random.Generator, kind: str = "proportional") -> np.ndarray:
    s = fd_noise_sigma(data, level, kind) * np.abs(data)
    return data + s * (rng.normal(size=data.shape) + 1j * rng.normal(size=data.shape))


def simulated_g2(tau, g1: np.ndarray, beta: float, rng: np.random.Generator | None = None, noise: float = 0.0) -> np.ndarray:
    g2 = siegert(g1, beta)
    return g2 if rng is None else g2 + noise * (g2 - 1 + 0.1 * beta) * rng.normal(size=g2.shape)
