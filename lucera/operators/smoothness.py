"""Smoothness of a noise field on a lattice, from residual images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "ijk"
TWO_LN2 = 2 * math.log(2)


def _roughness(rho: Column, df: float, unbiased: bool) -> Column:
    """-ln of the correlation of neighbours, which falls with the square of spacing over width."""
    if unbiased:
        rho = rho * (1 + (1 - rho * rho) / (2 * df))
    return -F.log(F.least(F.greatest(rho, F.lit(0.01)), F.lit(1 - 1e-12)))


def default_kernel(fwhm: list[float], df: float) -> float:
    """Width of the smoothing of the local map: wider for few degrees of freedom, in steps of half a unit."""
    mean = math.prod(fwhm) ** (1 / 3)
    return max(0.5, round(2 * max(1.0, 2 * (9 / df) ** (1 / 3)) * mean) / 2)


def field_smoothness(resid: DataFrame, df: float, spacing: float = 1.0, kernel: float | str | None = "auto", unbiased: bool = True) -> DataFrame:
    """(image, i, j, k, v) -> (i, j, k, rpv, fwhm_i, fwhm_j, fwhm_k): resels per voxel and widths.

    A voxel counts where every image has a value and not all are 0. Neighbours' correlations are
    averaged around a voxel by a Gaussian of width `kernel` cut at three sigma, a voxel itself
    weighing 1; voxels without neighbours along an axis take the field's value. Lattice neighbours
    meet by equal indices; the driver reads three means and a count.
    """
    images = resid.select("image").distinct().count()
    held = resid.filter("v IS NOT NULL AND NOT isnan(v)").groupBy(*AXES).agg(F.sort_array(F.collect_list(F.struct("image", "v"))).alias("r"))
    held = held.filter(F.size("r") == images).select(*AXES, F.col("r.v").alias("r"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    held = held.withColumn("ss", dot("r", "r")).filter("ss > 0")
    before = [F.struct(*[(F.col(c) - int(c == a)).alias(c) for c in AXES], F.lit(a).alias("axis")) for a in AXES]
    other = held.select(F.col("r").alias("r2"), F.col("ss").alias("ss2"), F.explode(F.array(*before)).alias("p")).select("p.*", "r2", "ss2")
    edges = held.join(other, list(AXES)).select(*AXES, "axis", (dot("r", "r2") / F.sqrt(F.col("ss") * F.col("ss2"))).alias("rho"))
    means = edges.groupBy("axis").agg(F.avg("rho").alias("rho")).select("axis", _roughness(F.col("rho"), df, unbiased).alias("l")).collect()
    field = {r["axis"]: r["l"] for r in means}
    if len(field) < len(AXES):
        raise ValueError("no neighbours along some axis, so the smoothness is not determined")

    after = F.struct(*[(F.col(c) + (F.col("axis") == c).cast("int")).alias(c) for c in AXES])
    ends = edges.select("axis", "rho", F.explode(F.array(F.struct(*AXES), after)).alias("p")).select("p.*", "axis", "rho")
    at = lambda a: F.col("axis") == a
    sums = [f(F.when(at(a), F.col("rho"))).alias(f"{n}_{a}") for a in AXES for n, f in (("s", F.sum), ("c", F.count))]
    local = ends.groupBy(*AXES).agg(*sums)
    if kernel == "auto":
        kernel = default_kernel([spacing * math.sqrt(TWO_LN2 / field[a]) for a in AXES], df)
    if kernel:
        sigma = kernel / math.sqrt(8 * math.log(2))
        reach = int(3 * sigma / spacing)
        for a in AXES:
            local = local.select("*", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias(f"d{a}"))
        apart = sum((F.col(f"d{a}") * F.col(f"d{a}") for a in AXES), F.lit(0)) * (spacing * spacing)
        local = local.withColumn("apart", apart).filter(F.col("apart") <= 9 * sigma * sigma).withColumn("w", F.exp(F.col("apart") / (-2 * sigma * sigma)))
        moved = [(F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES]
        local = local.select(*moved, *[(F.col("w") * F.col(f"{n}_{a}")).alias(f"{n}_{a}") for a in AXES for n in "sc"])
        local = local.groupBy(*AXES).agg(*[F.sum(f"{n}_{a}").alias(f"{n}_{a}") for a in AXES for n in "sc"])
    out = held.select(*AXES).join(local, list(AXES), "left")
    rough = {a: F.when(F.col(f"c_{a}") > 0, _roughness(F.col(f"s_{a}") / F.col(f"c_{a}"), df, unbiased)).otherwise(F.lit(field[a])) for a in AXES}
    out = out.select(*AXES, *[x.alias(f"l_{a}") for a, x in rough.items()])
    rpv = F.sqrt(F.col("l_i") * F.col("l_j") * F.col("l_k") / TWO_LN2**3)
    return out.select(*AXES, rpv.alias("rpv"), *[(spacing * F.sqrt(TWO_LN2 / F.col(f"l_{a}"))).alias(f"fwhm_{a}") for a in AXES])
