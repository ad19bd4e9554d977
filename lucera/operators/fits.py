"""Model fits per frame: one grouped function call a (recording, place, frame)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lucera.functions import diffusion


def _schema(df: DataFrame, keys, rest: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.select(*keys).dtypes) + ", " + rest


def fd_to_properties(fd: DataFrame, keys: list[str], n: float = 1.33, freq: float = 1.1e8) -> DataFrame:
    """(keys, rho, re, im) -> mua, musp. Recorded phase is the conjugate of the model's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rho")
        z = pdf["re"].to_numpy(float) - 1j * pdf["im"].to_numpy(float)
        ok = len(z) > 1 and np.isfinite(z).all()
        p = diffusion.fit_fd(pdf["rho"], z, n, freq) if ok else {"mua": None, "musp": None}
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{k: [v] for k, v in p.items()}})

    return fd.groupBy(*keys).applyInPandas(run, _schema(fd, keys, "mua double, musp double"))


def dcs_to_flow(dcs: DataFrame, keys: list[str], n: float = 1.4, wavelength_nm: float = 785.0) -> DataFrame:
    """(keys, rho, mua, musp, tau, g2) -> adb, beta."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tau")
        g2 = pdf["g2"].to_numpy(float)
        ok = np.isfinite(g2).all()
        p = diffusion.fit_dcs(pdf["tau"].to_numpy(float), g2, *(float(pdf[c].iloc[0]) for c in ("rho", "mua", "musp")), n, wavelength_nm) if ok else {"adb": None, "beta": None}
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{k: [v] for k, v in p.items()}})

    return dcs.groupBy(*keys).applyInPandas(run, _schema(dcs, keys, "adb double, beta double"))
