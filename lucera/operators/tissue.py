"""From measurements to tissue quantities: unmixing, moments, slopes, derived indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucera.functions.optics import C_CM_S, dpf_from_moment, musp_powerlaw, optical_properties_from_moments


def pinv2(m: list[list[float]]) -> list[list[float]]:
    import numpy as np

    return np.linalg.pinv(np.array(m, float)).tolist()


def od_to_concentration(od: DataFrame, extinction: dict[float, tuple[float, float]], dpf: dict[float, float]) -> DataFrame:
    """(recording, channel, wavelength, frame, od, rho_cm) -> hbo, hbr, hbt in uM per sample.

    The small inverse is made once on the driver and goes in as literals; unmixing is one
    aggregate over the wavelengths of a sample.
    """
    lams = sorted(extinction)
    inv = pinv2([list(extinction[w]) for w in lams])
    path = F.col("od") / (F.col("rho_cm") * F.coalesce(*[F.when(F.col("wavelength") == w, F.lit(dpf[w])) for w in lams]))

    def mixed(row):
        return F.sum(path * F.coalesce(*[F.when(F.col("wavelength") == w, F.lit(row[i])) for i, w in enumerate(lams)])) * 1e6

    whole = F.count("od") == len(lams)
    out = od.groupBy("recording", "channel", "frame").agg(F.when(whole, mixed(inv[0])).alias("hbo"), F.when(whole, mixed(inv[1])).alias("hbr"))
    return out.withColumn("hbt", F.col("hbo") + F.col("hbr"))


def absorption_to_concentration(op: DataFrame, extinction: dict[float, tuple[float, float]], water: dict[float, float], fraction: float = 0.75) -> DataFrame:
    """(recording, place, frame, wavelength, mua, var) -> hbo, hbr, and their variances."""
    lams = sorted(extinction)
    inv = pinv2([list(extinction[w]) for w in lams])
    pick = lambda row, p: F.coalesce(*[F.when(F.col("wavelength") == w, F.lit(row[i] ** p)) for i, w in enumerate(lams)])
    dry = F.col("mua") - fraction * F.coalesce(*[F.when(F.col("wavelength") == w, F.lit(water[w])) for w in lams])
    return op.groupBy("recording", "place", "frame").agg(
        (F.sum(dry * pick(inv[0], 1)) * 1e6).alias("hbo"), (F.sum(dry * pick(inv[1], 1)) * 1e6).alias("hbr"),
        (F.sum(F.col("var") * pick(inv[0], 2)) * 1e12).alias("hbo_var"), (F.sum(F.col("var") * pick(inv[1], 2)) * 1e12).alias("hbr_var"),
    )


def indices(conc: DataFrame) -> DataFrame:
    """Adds hbt, sto2 and oef."""
    total = F.col("hbo") + F.col("hbr")
    return conc.withColumns({"hbt": total, "sto2": F.try_divide("hbo", total), "oef": F.try_divide("hbr", total)})


def composition_to_properties(tissue: DataFrame, extinction: dict[float, tuple[float, float]]) -> DataFrame:
    """(…, hbo, hbr, a, b) -> mua and musp at each wavelength."""
    rows = F.array(*[F.struct(F.lit(float(w)).alias("wavelength"), F.lit(e[0]).alias("eo"), F.lit(e[1]).alias("er")) for w, e in extinction.items()])
    df = tissue.withColumn("_w", F.explode(rows)).withColumn("wavelength", F.col("_w.wavelength"))
    mua = (F.col("hbo") * F.col("_w.eo") + F.col("hbr") * F.col("_w.er")) * 1e-6
    return df.withColumn("mua", mua).withColumn("musp", musp_powerlaw(F.col("a"), F.col("b"), F.col("wavelength"))).drop("_w")


def decompose_flow(op: DataFrame, alpha: float, alpha_sigma: float = 0.0) -> DataFrame:
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    flow = F.col("bfi") / alpha
    sigma = F.sqrt((F.col("sigma") / alpha) ** 2 + (F.col("bfi") * alpha_sigma / alpha**2) ** 2)
    return op.withColumns({"flow": flow, "flow_sigma": sigma})


def covariance_to_correlation(cov: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p1, p2, cov) -> corr."""
    var = cov.filter("p1 = p2").select(*keys, F.col("p1").alias("_p"), F.col("cov").alias("_v"))
    a = var.withColumnsRenamed({"_p": "p1", "_v": "_v1"})
    b = var.withColumnsRenamed({"_p": "p2", "_v": "_v2"})
    out = cov.join(a, [*keys, "p1"]).join(b, [*keys, "p2"])
    return out.withColumn("corr", F.try_divide("cov", F.sqrt(F.col("_v1") * F.col("_v2")))).drop("_v1", "_v2")


def moments(gates: DataFrame, keys: list[str], sheppard: bool = True) -> DataFrame:
    """(keys, delay, width, v) -> m0, m1 and central m2 of the arrival times, in one aggregate."""
    s0, s1, s2 = F.sum("v"), F.sum(F.col("v") * F.col("delay")), F.sum(F.col("v") * F.col("delay") * F.col("delay"))
    out = gates.groupBy(*keys).agg(s0.alias("m0"), s1.alias("_s1"), s2.alias("_s2"), F.avg("width").alias("_w"))
    m1 = F.col("_s1") / (F.col("m0") + 1e-20)
    m2 = F.col("_s2") / (F.col("m0") + 1e-20) - 2 * F.col("m1") * F.col("_s1") / (F.col("m0") + 1e-20) + F.col("m1") ** 2 * F.col("m0") / (F.col("m0") + 1e-20)
    out = out.withColumn("m1", m1).withColumn("m2", m2 - (F.col("_w") ** 2 / 12 if sheppard else F.lit(0.0)))
    return out.drop("_s1", "_s2", "_w")


def correct_for_irf(mom: DataFrame, irf: DataFrame, on: list[str]) -> DataFrame:
    """m1 and m2 less the instrument's; m2 not below 0."""
    i = irf.select(*on, F.col("m1").alias("_m1"), F.col("m2").alias("_m2"))
    m2 = F.col("m2") - F.col("_m2")
    return mom.join(i, on).withColumns({"m1": F.col("m1") - F.col("_m1"), "m2": F.when(m2.isNotNull(), F.greatest(m2, F.lit(0.0)))}).drop("_m1", "_m2")


def moments_to_properties(mom: DataFrame, n: float = 1.37) -> DataFrame:
    mua, musp = optical_properties_from_moments(F.col("m1"), F.col("m2"), F.col("rho"), n)
    return mom.withColumns({"mua": mua, "musp": musp})


def dpf(mom: DataFrame, n: float = 1.44, mode: str = "static", keys=("channel",)) -> DataFrame:
    """Differential pathlength factor per sample, or its time mean."""
    value = dpf_from_moment(F.col("m1"), F.col("rho"), n)
    return mom.groupBy(*keys).agg(F.avg(value).alias("dpf")) if mode == "static" else mom.withColumn("dpf", value)


def slope_fit(fd: DataFrame, keys: list[str], frequency: float, n: float = 1.33) -> DataFrame:
    """(keys, rho, ac, phase) -> mua, musp from the slopes of ln(rho^2 ac) and phase over distance.

    One aggregate of regression sums per frame; standard errors follow from residual sums.
    """
    y1 = F.log(F.col("rho") * F.col("rho") * F.col("ac"))
    agg = fd.groupBy(*keys).agg(
        F.regr_slope(y1, "rho").alias("s_ac"), F.regr_slope("phase", "rho").alias("s_ph"), F.count("ac").alias("_n"),
        F.regr_sxx(y1, "rho").alias("_xx"), F.regr_sxy(y1, "rho").alias("_xy1"), F.regr_syy(y1, "rho").alias("_yy1"), F.regr_sxy("phase", "rho").alias("_xy2"), F.regr_syy("phase", "rho").alias("_yy2"),
    )
    w = 2 * 3.141592653589793 * frequency
    v = C_CM_S / n
    sa, sp = F.col("s_ac"), F.col("s_ph")
    mua = w / (2 * v) * (F.try_divide(sp, sa) - F.try_divide(sa, sp))
    out = agg.withColumn("mua", F.abs(mua)).withColumn("musp", F.try_divide(sa * sa - sp * sp, 3 * F.col("mua")) - F.col("mua"))
    err = lambda yy, xy: F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.try_divide(F.col(yy) - F.col(xy) ** 2 / F.col("_xx"), F.col("_n") - 2), F.col("_xx"))))
    return out.withColumns({"s_ac_err": err("_yy1", "_xy1"), "s_ph_err": err("_yy2", "_xy2")}).drop("_n", "_xx", "_xy1", "_yy1", "_xy2", "_yy2")


def complex_parts(fd: DataFrame) -> DataFrame:
    """(re, im) -> ac and phase."""
    return fd.withColumns({"ac": F.hypot("re", "im"), "phase": F.atan2("im", "re")})


def to_complex(fd: DataFrame, amplitude: str = "ac", phase: str = "phase") -> DataFrame:
    return fd.withColumns({"re": F.col(amplitude) * F.cos(phase), "im": F.col(amplitude) * F.sin(phase)})


def residual_to_reference(fd: DataFrame, by: list[str], order: str, consecutive: bool = False) -> DataFrame:
    """Log amplitude ratio and phase difference to the first (or the previous) channel."""
    w = Window.partitionBy(*by).orderBy(order)
    ref = (lambda c: F.lag(c).over(w)) if consecutive else (lambda c: F.first(c).over(w))
    return fd.withColumns({"log_ratio": F.log(F.try_divide("ac", ref("ac"))), "phase_diff": F.col("phase") - ref("phase")})


def nearest_wavelength(op: DataFrame, wavelength: float, keys: list[str]) -> DataFrame:
    value = F.struct("wavelength", "value")
    return op.groupBy(*keys).agg(F.min_by(value, F.struct(F.abs(F.col("wavelength") - wavelength), "wavelength")).alias("_r")).select(*keys, "_r.wavelength", "_r.value")


def interpolated(table: DataFrame, at: list[float], x: str = "lambda", ys=("hbo", "hbr")) -> DataFrame:
    """Linear interpolation of a small table at given points; the ends clamp. The table is an
    instrument constant of bounded size (one row a wavelength), joined by neighbours."""
    asked = table.sparkSession.createDataFrame([(float(a),) for a in at], "at double")
    w = Window.orderBy(x)
    pairs = table.select(x, *ys).withColumn("_x2", F.lead(x).over(w))
    for y in ys:
        pairs = pairs.withColumn(f"_{y}2", F.lead(y).over(w))
    ends = table.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    q = asked.crossJoin(F.broadcast(ends)).withColumn("_q", F.least(F.greatest("at", "_lo"), "_hi"))
    hit = q.join(pairs, (F.col("_q") >= F.col(x)) & (F.col("_q") <= F.coalesce(F.col("_x2"), F.col(x))))
    share = F.coalesce(F.try_divide(F.col("_q") - F.col(x), F.col("_x2") - F.col(x)), F.lit(0.0))
    return hit.select("at", *[(F.col(y) + share * F.coalesce(F.col(f"_{y}2") - F.col(y), F.lit(0.0))).alias(y) for y in ys]).dropDuplicates(["at"])
