"""Time-domain models, moments and fits of a semi-infinite medium, in numpy (cm, s)."""

from __future__ import annotations

import numpy as np

from lucera.functions import diffusion, layers

BOUNDS = {"mua": (0.005, 0.5), "musp": (2.0, 30.0)}


def gate_model(delays: np.ndarray, widths: np.ndarray, rho: float, mua: float, musp: float, n: float, response: np.ndarray | None = None, fluence=diffusion.td_fluence) -> np.ndarray:
    """Expected shape (unit sum) of counts in gates that begin at `delays`, through an instrument response."""
    out = layers.gate_counts(lambda t: fluence(t, rho, mua, musp, n), np.asarray(delays, float), np.asarray(widths, float))
    out = np.maximum(out, 0.0)
    if response is not None:
        out = layers.through_response(out, np.asarray(response, float))
    return out / out.sum()


def model_moments(rho: float, mua: float, musp: float, n: float, points: int = 2000, span: float = 1e-8) -> tuple[float, float]:
    """Mean and variance of the arrival times."""
    t = (np.arange(points) + 0.5) * span / points
    f = np.maximum(diffusion.td_fluence(t, rho, mua, musp, n), 0.0)
    f /= f.sum()
    m1 = float(t @ f)
    return m1, float((t - m1) ** 2 @ f)


def fit_gates(delays, widths, counts, rho: float, n: float, response=None, bounds=None, starts: int | None = None) -> tuple[dict[str, float], np.ndarray]:
    """mua, musp and their covariance from gated counts; each gate weighs by its counting noise."""
    y = np.asarray(counts, float)
    total = y.sum()
    sd = np.sqrt(np.maximum(y, 1.0))

    def residual(mua, musp):
        return (total * gate_model(delays, widths, rho, mua, musp, n, response) - y) / sd

    p, _, cov = diffusion.fit_bounded(residual, bounds or BOUNDS, starts=starts)
    return p, cov


def fit_moments(m1: float, m2: float, rho: float, n: float, bounds=None, starts: int | None = None) -> tuple[dict[str, float], np.ndarray]:
    """mua and musp whose mean and variance of arrival times are these."""

    def residual(mua, musp):
        a, b = model_moments(rho, mua, musp, n)
        return np.array([a / m1 - 1, b / m2 - 1])

    p, _, cov = diffusion.fit_bounded(residual, bounds or BOUNDS, starts=starts)
    return p, cov


def spectral_bounds() -> dict[str, tuple[float, float]]:
    """uM of both hemoglobins, and scattering amplitude (1/cm at 800 nm) and power."""
    return {"hbo": (1.0, 150.0), "hbr": (1.0, 100.0), "a": (2.0, 25.0), "b": (0.1, 3.0)}


def composed(wavelength: float, extinction: dict, hbo: float, hbr: float, a: float, b: float, water: float = 0.0) -> tuple[float, float]:
    """mua and musp of a composition at a wavelength; extinction in 1/(cm M)."""
    eo, er = extinction[wavelength]
    return (hbo * eo + hbr * er) * 1e-6 + water, a * (wavelength / 800.0) ** -b


def fit_fd_spectral(data: dict[float, tuple[np.ndarray, np.ndarray]], extinction: dict, n: float, freq: float, water: dict | None = None, starts: int | None = None) -> tuple[dict[str, float], np.ndarray]:
    """Composition from complex data (rho, value) at several wavelengths at once, on ratios to the first distance."""
    from lucera.functions.fitting import log_ratios

    def residual(hbo, hbr, a, b):
        parts = []
        for w, (rho, z) in data.items():
            mua, musp = composed(w, extinction, hbo, hbr, a, b, (water or {}).get(w, 0.0))
            parts.append(log_ratios(z, diffusion.fd_fluence(rho, mua, musp, n, freq)))
        return np.concatenate(parts)

    p, _, cov = diffusion.fit_bounded(residual, spectral_bounds(), starts=starts)
    return p, cov


def fit_td_spectral(data: dict[float, tuple], extinction: dict, rho: float, n: float, response=None, starts: int | None = None) -> tuple[dict[str, float], np.ndarray]:
    """Composition from gated counts (delays, widths, counts) at several wavelengths at once."""

    def residual(hbo, hbr, a, b):
        parts = []
        for w, (delays, widths, y) in data.items():
            mua, musp = composed(w, extinction, hbo, hbr, a, b)
            parts.append((y.sum() * gate_model(delays, widths, rho, mua, musp, n, response) - y) / np.sqrt(np.maximum(y, 1.0)))
        return np.concatenate(parts)

    p, _, cov = diffusion.fit_bounded(residual, spectral_bounds(), starts=starts)
    return p, cov
