"""Montages from distances, flat coordinates and labels; lattices of voxels with depths, labels of tissues, surfaces."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_distances(spark: SparkSession, distances_mm: list[float], short_mm: float | None = None) -> DataFrame:
    """A montage of one source at the origin and a detector at each distance along x."""
    rows = [(i, 1, i + 1, f"S1D{i + 1}", float(d), float(d) / 2, 0.0, 0.0, short_mm is not None and d < short_mm) for i, d in enumerate(distances_mm)]
    return spark.createDataFrame(rows, "channel int, source int, detector int, label string, distance_mm double, x double, y double, z double, is_short boolean")


def channel_label(source: Column, detector: Column) -> Column:
    return F.concat(F.lit("S"), source.cast("string"), F.lit("D"), detector.cast("string"))


def listed(channels: DataFrame, short_mm: float | None = None, kind: str = "all") -> DataFrame:
    """Channels in order: all, short (nearer than short_mm) or long ones; without a threshold all are long."""
    short = F.lit(False) if short_mm is None else F.col("distance_mm") < short_mm
    df = channels.withColumn("is_short", short)
    return {"all": df, "short": df.filter("is_short"), "long": df.filter(~F.col("is_short"))}[kind].orderBy("channel")


def flat(channels: DataFrame, projection: str = "orthographic") -> DataFrame:
    """u, v of the midpoints: x and y, or the azimuthal projection that keeps distances along a sphere from its top."""
    if projection == "orthographic":
        return channels.withColumns({"u": F.col("x"), "v": F.col("y")})
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    polar = F.acos(F.try_divide("z", r))
    side = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    scale = F.coalesce(F.try_divide(r * polar, side), F.lit(0.0))
    return channels.withColumns({"u": F.col("x") * scale, "v": F.col("y") * scale})


def info(channels: DataFrame) -> DataFrame:
    return channels.agg(
        F.count(F.lit(1)).alias("n_channels"), F.countDistinct("source").alias("n_sources"), F.countDistinct("detector").alias("n_detectors"), F.count_if("is_short").alias("n_short"),
        F.min("distance_mm").alias("min_mm"), F.max("distance_mm").alias("max_mm"), F.avg("distance_mm").alias("mean_mm"),
    )


def boundary_plane(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Centre and unit normal (upward) of the plane nearest to points (x, y, z): ten sums reach the driver."""
    s = points.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(a, b).alias(a + b) for i, a in enumerate("xyz") for b in "xyz"[i:]]).first()
    cov = np.array([[s["".join(sorted(a + b))] for b in "xyz"] for a in "xyz"], float)
    normal = np.linalg.eigh(cov)[1][:, 0]
    return np.array([s[c] for c in "xyz"], float), normal * (1 if normal[2] >= 0 else -1)


def depth_below(voxels: DataFrame, centre, normal, name: str = "depth_mm") -> DataFrame:
    """Distance below a plane (positive inside)."""
    away = sum(((F.col(c) - float(centre[i])) * float(normal[i]) for i, c in enumerate("xyz")), F.lit(0.0))
    return voxels.withColumn(name, -away)


def field_of_view(channels: DataFrame, spacing: float, depth: float, margin: float = 10.0) -> DataFrame:
    """(voxel, i, j, k, x, y, z, depth_mm) of a lattice over the montage's extent and a margin, down to a depth."""
    e = channels.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    low = [e["lo_x"] - margin, e["lo_y"] - margin, e["lo_z"] - depth]
    n = [int(math.floor((h - lo) / spacing + 1e-9)) + 1 for lo, h in zip(low, (e["hi_x"] + margin, e["hi_y"] + margin, e["lo_z"]), strict=True)]
    v = F.col("id")
    ijk = channels.sparkSession.range(n[0] * n[1] * n[2]).select(v.alias("voxel"), F.floor(v / (n[1] * n[2])).cast("int").alias("i"), (F.floor(v / n[2]) % n[1]).cast("int").alias("j"), (v % n[2]).cast("int").alias("k"))
    out = ijk.withColumns({c: F.col(a) * float(spacing) + float(low[d]) for d, (c, a) in enumerate(zip("xyz", "ijk", strict=True))})
    return out.withColumn("depth_mm", F.lit(float(e["lo_z"])) - F.col("z"))


def full_axes(voxels: DataFrame) -> DataFrame:
    """(axis, cells, low, high) of a lattice."""
    rows = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("at"), F.col(a).alias("cell")) for a, c in zip("ijk", "xyz", strict=True)])
    return voxels.select(F.explode(rows).alias("r")).groupBy(F.col("r.axis").alias("axis")).agg(F.countDistinct("r.cell").alias("cells"), F.min("r.at").alias("low"), F.max("r.at").alias("high"))


def restrict(voxels: DataFrame, keep: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Voxels of a table of voxels: the same cells (i, j, k) where both tables have them, else the same voxel
    numbers, which need not be unique in a table with cells; or the same values of the columns given."""
    cells = ["i", "j", "k"]
    on = on or (cells if {*cells} <= {*voxels.columns} & {*keep.columns} else ["voxel"])
    return voxels.join(keep.select(*on).distinct(), on, "left_semi").select(*voxels.columns)


def restrict_to_surface(voxels: DataFrame, vertices: DataFrame, radius: float) -> DataFrame:
    """Voxels within radius of a vertex (vertex, x, y, z): both meet on cells of that size; a row is judged by its own place."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    v = vertices.select(*[F.col(c).alias(f"_v{c}") for c in "xyz"], *[cell(c).alias(f"_c{c}") for c in "xyz"], F.explode(near).alias("_o"))
    v = v.select(*[f"_v{c}" for c in "xyz"], *[(F.col(f"_c{c}") + F.col(f"_o.{a}")).alias(f"_w{c}") for c, a in zip("xyz", "ijk", strict=True)])
    far = sum(((F.col(c) - F.col(f"_v{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    met = F.lit(True)
    for c in "xyz":
        met = met & (F.col(f"_h{c}") == F.col(f"_w{c}"))
    return voxels.withColumns({f"_h{c}": cell(c) for c in "xyz"}).join(v, met & (far <= radius * radius), "left_semi").select(*voxels.columns)


# head volumes: voxels (i, j, k, label) and a table of tissues (label, name)


def label_ids(tissues: DataFrame, names: list[str]) -> DataFrame:
    return tissues.filter(F.lower("name").isin([n.lower() for n in names])).select("label", "name")


def tissue_mask(volume: DataFrame, tissues: DataFrame, names: list[str]) -> DataFrame:
    """Voxels of named tissues."""
    return volume.join(F.broadcast(label_ids(tissues, names).select("label")), "label", "left_semi")  # a row a tissue


def tissue_names(volume: DataFrame, tissues: DataFrame) -> DataFrame:
    """(label, name, n) of the tissues that a volume holds."""
    return volume.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(tissues, "label", "left").select("label", F.coalesce("name", F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("name"), "n")


def tissue_properties(tissues: DataFrame, table: DataFrame, wavelength: float) -> DataFrame:
    """Properties (name, wavelength, mua, musp) of each tissue at the tabulated wavelength nearest to one."""
    near = nearest_tabulated(table, wavelength)
    return tissues.join(table.join(F.broadcast(near), "wavelength"), "name").select("label", "name", "wavelength", "mua", "musp")


def nearest_tabulated(table: DataFrame, wavelength: float) -> DataFrame:
    """One row: the tabulated wavelength nearest to one, the lower of two as near."""
    return table.agg(F.min_by("wavelength", F.struct(F.abs(F.col("wavelength") - wavelength), "wavelength")).alias("wavelength"))


def tissue_depth(volume: DataFrame, outside: int = 0, spacing: float = 1.0) -> DataFrame:
    """depth_mm of each tissue voxel below the first one of its column (i, j) from above."""
    top = volume.filter(F.col("label") != outside).groupBy("i", "j").agg(F.max("k").alias("_top"))
    return volume.filter(F.col("label") != outside).join(top, ["i", "j"]).withColumn("depth_mm", (F.col("_top") - F.col("k")) * float(spacing)).drop("_top")


def ellipsoid(spark: SparkSession, a: float, b: float, c: float, rings: int = 24, spokes: int = 48) -> DataFrame:
    """(vertex, x, y, z) of an ellipsoid's mesh, top first."""
    i, j = F.floor(F.col("id") / spokes), F.col("id") % spokes
    polar, turn = (i + 0.5) * (math.pi / rings), j * (2 * math.pi / spokes)
    return spark.range(rings * spokes).select(F.col("id").alias("vertex"), (F.sin(polar) * F.cos(turn) * a).alias("x"), (F.sin(polar) * F.sin(turn) * b).alias("y"), (F.cos(polar) * c).alias("z"))


def landmark_cues(vertices: DataFrame) -> DataFrame:
    """(label, x, y, z) of a head surface's extremes: front, back, left, right and top."""
    pick = lambda label, order: vertices.agg(F.max_by(F.struct("x", "y", "z"), F.struct(order, -F.col("vertex"))).alias("p")).select(F.lit(label).alias("label"), "p.*")
    out = pick("nasion", F.col("y"))
    for label, order in (("inion", -F.col("y")), ("lpa", -F.col("x")), ("rpa", F.col("x")), ("cz", F.col("z"))):
        out = out.unionByName(pick(label, order))
    return out
