"""Fits of layered media and joint fits per frame: one grouped call a (recording, place, frame).

Missing or non-finite data, or fewer than two distances, give a row of nulls; for joint fits so does
a frame that only one of the two instruments has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lucera.functions import fitting
from lucera.operators.fits import _schema


def _light(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distances, the model's conjugate of the recorded data, and whether it can be fitted."""
    pdf = pdf.sort_values("rho")
    z = pdf["re"].to_numpy(float) - 1j * pdf["im"].to_numpy(float)
    return pdf["rho"].to_numpy(float), z, bool(len(z) > 1 and np.isfinite(z).all() and (z != 0).all())


def _row(keys: list[str], first: pd.Series, names: list[str], p: dict | None) -> pd.DataFrame:
    return pd.DataFrame({**{k: [first[k]] for k in keys}, **{k: [p[k] if p else None] for k in names}})


def fd_to_layers(fd: DataFrame, keys: list[str], n: float = 1.4, freq: float = 1.1e8, count: int = 2, bounds: dict | None = None, fixed: dict | None = None, starts: int | None = None) -> DataFrame:
    """(keys, rho, re, im) -> mua_i, musp_i of each layer and d_i of all but the last."""
    names = [f"{k}_{i}" for k in ("mua", "musp") for i in range(1, count + 1)] + [f"d_{i}" for i in range(1, count)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rho, z, ok = _light(pdf)
        p = fitting.fit_layered_fd(rho, z, n, freq, count, bounds, fixed, starts) if ok else None
        # a property that all layers share is told for each
        p = p and {k: p[k] if k in p else p[k.split("_")[0]] for k in names}
        return _row(keys, pdf.iloc[0], names, p)

    return fd.groupBy(*keys).applyInPandas(run, _schema(fd, keys, ", ".join(f"{k} double" for k in names)))


def joint_to_properties(fd: DataFrame, dcs: DataFrame, keys: list[str], n: float = 1.4, freq: float = 1.1e8, wavelength_nm: float = 785.0, fd_sigma: float = 0.01, dcs_sigma: float = 0.01) -> DataFrame:
    """fd (keys, rho, re, im) and dcs (keys, rho, tau, g2) of the same frames -> mua, musp, adb, beta."""
    names = ["mua", "musp", "adb", "beta"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        p = None
        if len(a) and len(b):
            rho, z, ok = _light(a)
            b = b.sort_values("tau")
            tau, g2 = b["tau"].to_numpy(float), b["g2"].to_numpy(float)
            if ok and np.isfinite(g2).all():
                p = fitting.fit_joint(rho, z, freq, tau, g2, float(b["rho"].iloc[0]), n, wavelength_nm, fd_sigma, dcs_sigma)
        return _row(keys, (a if len(a) else b).iloc[0], names, p)

    return fd.groupBy(*keys).cogroup(dcs.groupBy(*keys)).applyInPandas(run, _schema(fd, keys, ", ".join(f"{k} double" for k in names)))
