"""Photon noise of intensity correlators (Zhou and others, Optics Express 14, 2006)."""

from __future__ import annotations

import numpy as np


def decay_rate(taus: np.ndarray, g1: np.ndarray) -> float:
    """Rate of the single exponential nearest to g1, by least squares in the rate."""
    below = np.flatnonzero(g1 < np.exp(-1.0))
    rate = 1.0 / (taus[below[0]] if len(below) else taus[-1])
    cost, damp = np.inf, 1e-3
    for _ in range(200):
        model = np.exp(-rate * taus)
        left, slope = g1 - model, -taus * model
        if (now := float(left @ left)) < cost:
            cost, best, damp = now, rate, damp / 4
            grad, curve = float(slope @ left), float(slope @ slope)
        else:
            damp *= 8
        step = grad / max(curve * (1 + damp), 1e-300)
        rate = best + step
        if abs(step) <= 1e-12 * abs(best) or damp > 1e12:
            break
    if not (np.isfinite(best) and best > 0):
        raise ValueError("g1 does not decay over the delays given")
    return best


def correlation_noise(taus: np.ndarray, rate: float, beta: float, t_int: float, counts: float, correlator: str = "linear") -> np.ndarray:
    """Standard deviation of g2 per delay, from the decay rate of g1, the integration time and the
    count rate; correlator linear counts lags by channel, multi_tau by delay over bin width."""
    if correlator not in ("linear", "multi_tau"):
        raise ValueError(f"correlator is linear or multi_tau, not {correlator}")
    taus = np.asarray(taus, float)
    width = np.diff(taus, prepend=np.nan)
    width[0] = width[1]
    width = np.maximum(width, 1e-30)
    lag = np.arange(1, len(taus) + 1) if correlator == "linear" else taus / width
    per_bin = np.maximum(counts * width, 1e-10)
    in_bin, at_lag = np.exp(-2 * rate * width), np.exp(-2 * rate * taus)
    speckle = ((1 + in_bin) * (1 + at_lag) + 2 * lag * (1 - in_bin) * at_lag) / np.maximum(1 - in_bin, 1e-10)
    shot = 2 * beta * (1 + at_lag) / per_bin + (1 + beta * np.sqrt(at_lag)) / per_bin**2
    return np.sqrt(width / t_int * (beta**2 * speckle + shot))


def noisy_correlation(g2: np.ndarray, taus: np.ndarray, rng: np.random.Generator, beta: float, t_int: float, counts: float, correlator: str = "linear") -> np.ndarray:
    """g2 with photon noise; a g2 whose g1 passes 1 is refused."""
    g2, taus = np.asarray(g2, float), np.asarray(taus, float)
    g1 = np.sqrt(np.maximum((g2 - 1) / beta, 0))
    if g1.max() > 1 + 1e-3:
        raise ValueError(f"g1 reaches {g1.max():.3g} with beta {beta}")
    return g2 + rng.standard_normal(len(taus)) * correlation_noise(taus, decay_rate(taus, g1), beta, t_int, counts, correlator)
