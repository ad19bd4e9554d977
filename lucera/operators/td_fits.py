"""Time-domain and spectral fits with their uncertainties, and simulated time-domain and correlation data.

One grouped call a fit: a place of a frame. A fit gives a row a parameter (param, value, sigma) or, as
`covariances`, a row a pair of parameters; data that cannot be fitted give nulls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.functions import diffusion, layers, time_domain
from lucera.functions.registries import RESIDUALS
from lucera.operators.fits import _schema


def _fitted(df: DataFrame, keys: list[str], names: list[str], fit, covariance: bool) -> DataFrame:
    """fit(pandas group) -> (values, covariance) or None."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got, head = fit(pdf), {k: pdf[k].iloc[0] for k in keys}
        if covariance:
            pairs = [(a, b) for a in names for b in names]
            order = list(got[0]) if got else names
            values = [got[1][order.index(a), order.index(b)] if got else None for a, b in pairs]
            return pd.DataFrame({**{k: [v] * len(pairs) for k, v in head.items()}, "param": [a for a, _ in pairs], "param_2": [b for _, b in pairs], "cov": pd.Series(values, dtype=float)})
        sigma = dict(zip(got[0], np.sqrt(np.maximum(np.diag(got[1]), 0)), strict=True)) if got else {}
        return pd.DataFrame({**{k: [v] * len(names) for k, v in head.items()}, "param": names, "value": pd.Series([got[0][k] if got else None for k in names], dtype=float), "sigma": pd.Series([sigma.get(k) for k in names], dtype=float)})

    rest = "param string, param_2 string, cov double" if covariance else "param string, value double, sigma double"
    return df.groupBy(*keys).applyInPandas(run, _schema(df, keys, rest))


def td_to_properties(td: DataFrame, keys: list[str], n: float = 1.4, response=None, covariance: bool = False, starts: int = 4) -> DataFrame:
    """(keys, rho, delay, width, v) -> mua, musp of gated counts."""

    def fit(pdf):
        pdf = pdf.sort_values("delay")
        y = pdf["v"].to_numpy(float)
        if len(y) < 3 or not np.isfinite(y).all() or y.sum() <= 0:
            return None
        return time_domain.fit_gates(pdf["delay"].to_numpy(float), pdf["width"].to_numpy(float), y, float(pdf["rho"].iloc[0]), n, response, starts=starts)

    return _fitted(td, keys, ["mua", "musp"], fit, covariance)


def td_moments_to_properties(moments: DataFrame, keys: list[str], n: float = 1.4, covariance: bool = False, starts: int = 4) -> DataFrame:
    """(keys, rho, m1, m2) -> mua, musp; one row a key."""

    def fit(pdf):
        m1, m2 = float(pdf["m1"].iloc[0]), float(pdf["m2"].iloc[0])
        return time_domain.fit_moments(m1, m2, float(pdf["rho"].iloc[0]), n, starts=starts) if m1 > 0 < m2 else None

    return _fitted(moments, keys, ["mua", "musp"], fit, covariance)


def fd_to_concentration(fd: DataFrame, keys: list[str], extinction: dict, n: float = 1.4, freq: float = 1.1e8, covariance: bool = False, starts: int = 4) -> DataFrame:
    """(keys, wavelength, rho, re, im) -> hbo, hbr, a, b of all wavelengths at once."""

    def fit(pdf):
        data = {}
        for w, g in pdf.sort_values("rho").groupby("wavelength"):
            z = g["re"].to_numpy(float) - 1j * g["im"].to_numpy(float)
            if len(z) < 2 or not np.isfinite(z).all() or (z == 0).any():
                return None
            data[float(w)] = (g["rho"].to_numpy(float), z)
        return time_domain.fit_fd_spectral(data, extinction, n, freq, starts=starts) if len(data) > 1 else None

    return _fitted(fd, keys, ["hbo", "hbr", "a", "b"], fit, covariance)


def td_to_concentration(td: DataFrame, keys: list[str], extinction: dict, n: float = 1.4, response=None, covariance: bool = False, starts: int = 4) -> DataFrame:
    """(keys, wavelength, rho, delay, width, v) -> hbo, hbr, a, b."""

    def fit(pdf):
        data = {float(w): tuple(g.sort_values("delay")[c].to_numpy(float) for c in ("delay", "width", "v")) for w, g in pdf.groupby("wavelength")}
        return time_domain.fit_td_spectral(data, extinction, float(pdf["rho"].iloc[0]), n, response, starts=starts) if len(data) > 1 else None

    return _fitted(td, keys, ["hbo", "hbr", "a", "b"], fit, covariance)


def composition_variance(cov: DataFrame, keys: list[str], extinction: dict[float, tuple[float, float]]) -> DataFrame:
    """Delta-method deviation of mua at each wavelength from the covariance (keys, param, param_2, cov) of hbo and hbr."""
    rows = F.array(*[F.struct(F.lit(float(w)).alias("wavelength"), F.lit(e[0] * 1e-6).alias("hbo"), F.lit(e[1] * 1e-6).alias("hbr")) for w, e in extinction.items()])
    pick = lambda c: F.when(F.col(c) == "hbo", F.col("e.hbo")).when(F.col(c) == "hbr", F.col("e.hbr"))
    both = cov.filter("param IN ('hbo', 'hbr') AND param_2 IN ('hbo', 'hbr')").withColumn("e", F.explode(rows))
    return both.groupBy(*keys, F.col("e.wavelength").alias("wavelength")).agg(F.sqrt(F.sum(pick("param") * pick("param_2") * F.col("cov"))).alias("mua_sigma"))


def custom_fit(df: DataFrame, keys: list[str], model, target: str, bounds: dict[str, tuple[float, float]], residual="difference", response=None, log: tuple[str, ...] = (), order: str | None = None, covariance: bool = False, starts: int = 4) -> DataFrame:
    """Fits a given model: model(columns of a group as arrays, **params) -> prediction of `target`. residual and
    response are callables or registered names; a response is f(number of points) or an array that the
    prediction goes through."""
    transform = RESIDUALS.resolve(residual)

    def fit(pdf):
        pdf = pdf.sort_values(order) if order else pdf
        arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
        y = arrays[target].astype(float)
        if len(y) < len(bounds) or not np.isfinite(y).all():
            return None
        shape = None if response is None else np.asarray(response(len(y)) if callable(response) else response, float)

        def off(**p):
            m = np.asarray(model(arrays, **p), float)
            return transform(y, m if shape is None else layers.through_response(m, shape))

        p, _, cov = diffusion.fit_bounded(off, bounds, log=log, starts=starts)
        return p, cov

    return _fitted(df, keys, list(bounds), fit, covariance)


def uncertainty_of(fit: DataFrame, param: str, keys: list[str]) -> DataFrame:
    return fit.filter(F.col("param") == param).select(*keys, "sigma")


def select_params(fit: DataFrame, params: list[str]) -> DataFrame:
    return fit.filter(F.col("param").isin(params))


def simulate_td(spark: SparkSession, frames: int, rho: list[float], delays, width: float, mua: float, musp: float, n: float = 1.4, counts: float = 1e6, response=None, noise: bool = True, seed: int = 0, fs: float = 1.0) -> DataFrame:
    """(frame, t, channel, rho, delay, width, v): Poisson counts in gates; each frame has its own seed."""
    delays = np.asarray(delays, float)
    clean = [counts * time_domain.gate_model(delays, np.full(len(delays), width), r, mua, musp, n, response) for r in rho]

    def run(batches):
        for pdf in batches:
            for f in pdf["id"]:
                r = np.random.default_rng([seed, f])
                for c, (d, y) in enumerate(zip(rho, clean, strict=True)):
                    v = r.poisson(y).astype(float) if noise else y
                    yield pd.DataFrame({"frame": f, "t": f / fs, "channel": c, "rho": d, "delay": delays, "width": width, "v": v})

    return spark.range(frames).mapInPandas(run, "frame long, t double, channel int, rho double, delay double, width double, v double")


def simulate_dcs(spark: SparkSession, frames: int, rho: list[float], tau, mua: float, musp: float, adb: float, beta: float = 0.5, n: float = 1.4, wavelength_nm: float = 785.0, noise: float = 0.0, seed: int = 0, fs: float = 1.0) -> DataFrame:
    """(frame, t, channel, rho, mua, musp, tau, g2)."""
    tau = np.asarray(tau, float)
    g1 = [diffusion.dcs_g1(r, mua, musp, n, wavelength_nm, tau, adb=adb) for r in rho]

    def run(batches):
        for pdf in batches:
            for f in pdf["id"]:
                r = np.random.default_rng([seed, f])
                for c, (d, g) in enumerate(zip(rho, g1, strict=True)):
                    yield pd.DataFrame({"frame": f, "t": f / fs, "channel": c, "rho": d, "mua": mua, "musp": musp, "tau": tau, "g2": layers.simulated_g2(tau, g, beta, r if noise else None, noise)})

    return spark.range(frames).mapInPandas(run, "frame long, t double, channel int, rho double, mua double, musp double, tau double, g2 double")
