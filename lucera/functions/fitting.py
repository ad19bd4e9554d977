"""Fits of layered media and joint fits of modulated light and correlations, in numpy."""

from __future__ import annotations

import numpy as np

from lucera.functions import diffusion, layers


def log_ratios(data: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Differences of amplitude logs and of phases, each against the first distance."""
    r = np.log(data[1:] / data[0]) - np.log(model[1:] / model[0])
    return np.concatenate([r.real, (r.imag + np.pi) % (2 * np.pi) - np.pi])


def fit_layered_fd(rho, data, n: float, freq: float, count: int = 2, bounds: dict | None = None, fixed: dict | None = None, starts: int | None = None, seed: int = 0) -> dict[str, float]:
    """mua_i, musp_i and thickness d_i of layers from complex data at several distances. `fixed`
    holds known values; a key `musp` (or `mua`) in either serves all layers. The least thickness of
    the first layer must hold the source at the least scattering allowed."""
    fixed = dict(fixed or {})
    bounds = dict(bounds or layers.layer_bounds(count, musp=(6.0, 30.0)))
    for k in ("mua", "musp"):
        if k in fixed or k in bounds:
            bounds = {b: v for b, v in bounds.items() if not b.startswith(k + "_")}
    bounds = {b: v for b, v in bounds.items() if b not in fixed}
    low = layers.layer_arguments({b: v[0] for b, v in bounds.items()} | fixed, count)
    if count > 1 and low["thickness"][0] <= 1 / (low["mua"][0] + low["musp"][0]):
        raise ValueError("the bounds allow a first layer that does not hold the source")
    rho, data = np.asarray(rho, float), np.asarray(data, complex)

    def residual(**p):
        arg = layers.layer_arguments(p | fixed, count)
        return log_ratios(data, np.array([layers.layered_fd(r, arg["mua"], arg["musp"], arg["thickness"], n, freq)[0] for r in rho]))

    return diffusion.fit_bounded(residual, bounds, starts=starts, seed=seed)[0] | fixed


def fit_joint(rho, data, freq: float, tau, g2, dcs_rho: float, n: float, wavelength_nm: float, fd_sigma: float = 0.01, dcs_sigma: float = 0.01, bounds: dict | None = None) -> dict[str, float]:
    """mua, musp, flow index and beta of one medium seen by both instruments: each residual counts in
    units of its noise, so that the correlations also bear on the optical properties."""
    bounds = bounds or {"mua": (0.001, 0.5), "musp": (1.0, 30.0), "adb": (1e-11, 1e-6), "beta": (0.05, 1.0)}
    rho, data, tau, g2 = np.asarray(rho, float), np.asarray(data, complex), np.asarray(tau, float), np.asarray(g2, float)

    def residual(mua, musp, adb, beta):
        light = log_ratios(data, diffusion.fd_fluence(rho, mua, musp, n, freq)) / fd_sigma
        flow = (diffusion.siegert(diffusion.dcs_g1(dcs_rho, mua, musp, n, wavelength_nm, tau, adb=adb), beta) - g2) / dcs_sigma
        return np.concatenate([light, flow])

    return diffusion.fit_bounded(residual, bounds, log=("adb",))[0]
