"""Column expressions of diffuse optics, units and statistics; they stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

C_CM_S = 2.99792458e10
#: The time-domain closed form keeps this rounder value.
C_CM_S_TD = 3e10
PIVOT_NM = 800.0

_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0}


def _cases(x: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(x == k, F.lit(v)).otherwise(out)
    return out


def normalize_length_unit(unit: Column) -> Column:
    u = F.lower(F.trim(unit))
    return _cases(u, {k: k for k in _MM} | {"millimeter": "mm", "millimeters": "mm", "centimeter": "cm", "centimeters": "cm", "meter": "m", "meters": "m"})


def mm_per_unit(unit: Column, default: str = "mm") -> Column:
    return _cases(F.coalesce(normalize_length_unit(unit), F.lit(default)), _MM)


def cm_per_unit(unit: Column, default: str = "cm") -> Column:
    return mm_per_unit(unit, default) / 10


def moment_of_unit(unit: Column) -> Column:
    """m0, m1 or m2 of a moment's unit."""
    u = F.lower(F.trim(unit))
    return F.when(u.isin("", "counts", "count", "1", "a.u.", "photons"), "m0").when(u.rlike(r"^(s|ms|us|ns|ps|seconds?)$"), "m1").when(u.rlike(r"^(s|ms|us|ns|ps)(\^|\*\*)?2$"), "m2")


def fisher_z(r: Column) -> Column:
    return F.atanh(F.greatest(F.least(r, F.lit(0.999)), F.lit(-0.999)))


def inverse_fisher_z(z: Column) -> Column:
    return F.tanh(z)


def mua_from_composition(hbo: Column, hbr: Column, eps_hbo: float, eps_hbr: float) -> Column:
    return (hbo * eps_hbo + hbr * eps_hbr) * 1e-6


def musp_powerlaw(a: Column, b: Column, wavelength: Column) -> Column:
    return a * F.pow(wavelength / PIVOT_NM, -b)


def msd_brownian(tau: Column, adb: Column) -> Column:
    return 6.0 * adb * tau


def msd_langevin(tau: Column, adb: Column, tc: Column) -> Column:
    return 6.0 * adb * (tau - tc * (1 - F.exp(-tau / tc)))


def msd_random(tau: Column, av2: Column) -> Column:
    return av2 * tau * tau


def msd(tau: Column, model: str, **params: Column) -> Column:
    return {"brownian": lambda: msd_brownian(tau, params["adb"]), "langevin": lambda: msd_langevin(tau, params["adb"], params["tc"]), "random": lambda: msd_random(tau, params["av2"])}[model]()


def siegert(g1: Column, beta: Column) -> Column:
    return 1 + beta * F.pow(F.abs(g1), F.lit(2.0))


def compose(alpha: Column, rate: Column) -> Column:
    return alpha * rate


def k_squared(mua: Column, musp: Column, n: float, wavelength_nm: Column, freq: float, displacement: Column) -> tuple[Column, Column]:
    """Real and imaginary part of K^2 at a frequency and a mean square displacement."""
    k0 = 2 * math.pi * n / (wavelength_nm * 1e-7)
    mut = mua + musp
    return 3 * mua * mut + mut * musp * k0 * k0 * displacement, 3 * mut * (2 * math.pi * freq * n / C_CM_S)


def td_fluence_patterson(t: Column, rho: Column, mua: Column, musp: Column, n: float, a: float = 1.0) -> Column:
    """Closed-form time-domain fluence of a semi-infinite medium, source at one transport length."""
    v, d, z0 = C_CM_S / n, 1 / (3 * musp), 1 / musp
    zb = 2 * a * d
    spread = 4 * d * v * t
    scale = v * F.pow(math.pi * spread, F.lit(-1.5)) * F.exp(-mua * v * t)
    return scale * (F.exp(-(rho * rho + z0 * z0) / spread) - F.exp(-(rho * rho + (z0 + 2 * zb) ** 2) / spread))


def optical_properties_from_moments(m1: Column, m2: Column, rho: Column, n: float = 1.37) -> tuple[Column, Column]:
    """mua and musp from mean arrival time and variance at a distance."""
    v = C_CM_S_TD / n
    mua = F.try_divide(m1 * m1 * m1, 2 * v * m2 * (m1 * m1 + m2))
    musp = F.try_divide(2 * v * m1 * (m1 * m1 + m2), 3 * rho * rho * m2)
    return mua, musp


def dpf_from_moment(m1: Column, rho: Column, n: float = 1.44) -> Column:
    return F.try_divide(m1 * (C_CM_S / n), rho)


def hrf(t: Column, undershoot: float = 0.16, scale: float = 1.0) -> Column:
    """Double-gamma response, gamma(6) - undershoot x gamma(16), zero outside 0 to 30 s."""
    g6 = F.pow(t, F.lit(5.0)) * F.exp(-t) / math.factorial(5)
    g16 = F.pow(t, F.lit(15.0)) * F.exp(-t) / math.factorial(15)
    return F.when((t >= 0) & (t <= 30), (g6 - undershoot * g16) * scale).otherwise(0.0)


def chi2_sf_df4(x: Column) -> Column:
    return F.exp(-x / 2) * (1 + x / 2)


def to_storage_label(name: Column) -> Column:
    return F.regexp_replace(name, "^aDb", "bfi")


def from_storage_label(name: Column) -> Column:
    return F.regexp_replace(name, "^bfi", "aDb")


def is_observation_param(name: Column) -> Column:
    return name.isin("beta", "t0", "sigma", "tau", "scale", "offset")


def is_composition_param(name: Column) -> Column:
    return name.rlike(r"^(hbo|hbr|HbO|HbR|A|b)(_\d+)?$")


def quality_weight(value: Column, median: Column, mad: Column, steepness: float = 1.0) -> Column:
    """Logistic of the robust z score."""
    return 1 / (1 + F.exp(-steepness * F.coalesce(F.try_divide(value - median, 1.4826 * mad), F.lit(0.0))))


def datatype_modality(code: Column) -> Column:
    """Modality of a measurement's data type code."""
    return F.when(code.between(1, 100), "CW").when(code.between(101, 200), "FD").when(code.between(201, 300), "TD_GATED").when(code.between(301, 400), "TD_MOMENTS").when(code == 410, "DCS_BFI").when(code.between(401, 500), "DCS").when(code == 99999, "CW")
