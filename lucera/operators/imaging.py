"""Sensitivity, reconstruction, registration, voxels and simulated recordings.

Tables of the montage (channels) are bounded by the instrument and go with the functions;
voxels and samples stay distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.functions import diffusion, layers


def rigid_fit(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, shift and residual per point of the best rigid move of src onto dst, no reflection."""
    if len(src) < 3:
        raise ValueError("three points or more must match")
    a, b = src - src.mean(0), dst - dst.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    turn = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
    shift = dst.mean(0) - turn @ src.mean(0)
    return turn, shift, np.linalg.norm(src @ turn.T + shift - dst, axis=1)


def moved(turn: np.ndarray, shift: np.ndarray, axes="xyz") -> dict[str, Column]:
    """Columns x, y, z after a rigid move, for withColumns."""
    return {c: sum((F.col(k) * float(turn[i, j]) for j, k in enumerate(axes)), F.lit(float(shift[i]))) for i, c in enumerate(axes)}


def voxel_grid(spark: SparkSession, low: tuple, high: tuple, spacing: float, depth_axis: str = "z") -> DataFrame:
    """(voxel, i, j, k, x, y, z, depth) of a lattice between two corners, both included."""
    n = [int(np.floor((h - lo) / spacing + 1e-9)) + 1 for lo, h in zip(low, high, strict=True)]
    v = F.col("id")
    ijk = spark.range(n[0] * n[1] * n[2]).select(v.alias("voxel"), F.floor(v / (n[1] * n[2])).cast("int").alias("i"), (F.floor(v / n[2]) % n[1]).cast("int").alias("j"), (v % n[2]).cast("int").alias("k"))
    xyz = ijk.withColumns({c: F.col(a) * float(spacing) + float(low[d]) for d, (c, a) in enumerate(zip("xyz", "ijk", strict=True))})
    return xyz.withColumn("depth", F.abs(depth_axis))


def jacobian(voxels: DataFrame, channels: pd.DataFrame, mua: float, musp: float, n: float, volume: float) -> DataFrame:
    """(channel, voxel, value): change of optical density for absorption in a voxel (x, y, depth in
    cm). channels: channel, sx, sy, dx, dy on the boundary plane."""
    r, k = diffusion.effective_reflectance(n), np.sqrt(3 * mua * (mua + musp))
    phi0 = diffusion.semi_infinite(np.hypot(channels["sx"] - channels["dx"], channels["sy"] - channels["dy"]).to_numpy(), k, mua, musp, r)
    kind = "string" if channels["channel"].dtype == object else "int"

    def run(batches):
        for pdf in batches:
            x, y, z = (pdf[c].to_numpy(float) for c in ("x", "y", "depth"))
            for c, (_, row) in enumerate(channels.iterrows()):
                g = [diffusion.semi_infinite(np.hypot(x - row[p + "x"], y - row[p + "y"]), k, mua, musp, r, z) for p in "sd"]
                yield pd.DataFrame({"channel": row["channel"], "voxel": pdf["voxel"], "value": g[0] * g[1] * volume / phi0[c]})

    return voxels.select("voxel", "x", "y", "depth").mapInPandas(run, f"channel {kind}, voxel long, value double")


#: Cells of an inverse that goes to every task (8 bytes each); a larger one is joined.
MAX_INVERSE = 20_000_000


def reconstruct(sens: DataFrame, samples: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(recording, frame, voxel, value) by Tikhonov: J' (J J' + alpha max diag I)^-1 y. The channels' Gram
    matrix, bounded by the montage, is inverted on the driver. J' times it goes to every task if it has
    MAX_INVERSE cells at most, and frames are solved in blocks; else frames' weights join the table of
    J. A frame lacking a channel is left out."""
    a = sens.select("voxel", F.col("channel").alias("ch_i"), F.col("value").alias("a"))
    b = sens.select("voxel", F.col("channel").alias("ch_j"), F.col("value").alias("b"))
    gram = a.join(b, "voxel").groupBy("ch_i", "ch_j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).toPandas()
    names = sorted(gram["ch_i"].unique().tolist())
    g = gram.pivot(index="ch_i", columns="ch_j", values="g").loc[names, names].to_numpy()
    inv = np.linalg.inv(g + alpha * g.diagonal().max() * np.eye(len(g)))
    rec, kind, vox = dict(samples.dtypes)["recording"], dict(sens.dtypes)["channel"], dict(sens.dtypes)["voxel"]
    keys = ["recording", "frame"]
    frames = samples.filter("v IS NOT NULL").filter(F.col("channel").isin(names))
    if sens.select("voxel").distinct().count() * len(names) <= MAX_INVERSE:
        j = sens.select("voxel", "channel", "value").toPandas().pivot(index="voxel", columns="channel", values="value").reindex(columns=names).fillna(0.0)
        voxels, solve = j.index.to_numpy(), inv @ j.to_numpy().T
        whole = frames.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("channel", "v"))).alias("v")).filter(F.size("v") == len(names))
        whole = whole.select(*keys, F.array(*[F.element_at("v", F.lit(c).cast(kind)) for c in names]).alias("y"))

        def run(batches):
            for pdf in batches:
                for lo in range(0, len(pdf), 64):
                    part = pdf.iloc[lo : lo + 64]
                    value = np.stack(part["y"].to_list()) @ solve
                    yield pd.DataFrame({"recording": part["recording"].repeat(len(voxels)).to_numpy(), "frame": part["frame"].repeat(len(voxels)).to_numpy(), "voxel": np.tile(voxels, len(part)), "value": value.ravel()})

        return whole.mapInPandas(run, f"recording {rec}, frame long, voxel {vox}, value double")
    rows = [(names[i], names[j], float(inv[i, j])) for i in range(len(names)) for j in range(len(names))]
    table = sens.sparkSession.createDataFrame(rows, f"to {kind}, channel {kind}, w double")
    weights = frames.join(table, "channel").groupBy(*keys, "to").agg(F.sum(F.col("w") * F.col("v")).alias("u"), F.count(F.lit(1)).alias("m"))
    weights = weights.filter(F.col("m") == len(names)).select(*keys, F.col("to").alias("channel"), "u")
    return sens.join(weights, "channel").groupBy(*keys, "voxel").agg(F.sum(F.col("value") * F.col("u")).alias("value"))


def sensitivity_matrix(sens: DataFrame, channels: list) -> DataFrame:
    """A row a voxel, a column a channel."""
    return sens.groupBy("voxel").pivot("channel", channels).agg(F.first("value"))


def resolution(sens: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(voxel, resolution): how much of a change in each voxel a reconstruction with this alpha puts there.
    The channels' Gram matrix, bounded by the montage, is inverted on the driver."""
    a = sens.select("voxel", F.col("channel").alias("ch_i"), F.col("value").alias("a"))
    b = sens.select("voxel", F.col("channel").alias("ch_j"), F.col("value").alias("b"))
    gram = a.join(b, "voxel").groupBy("ch_i", "ch_j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).toPandas()
    names = sorted(gram["ch_i"].unique().tolist())
    g = gram.pivot(index="ch_i", columns="ch_j", values="g").loc[names, names].to_numpy()
    inv = np.linalg.inv(g + alpha * g.diagonal().max() * np.eye(len(g)))
    kind = dict(sens.dtypes)["channel"]
    rows = [(names[i], names[j], float(inv[i, j])) for i in range(len(names)) for j in range(len(names))]
    table = sens.sparkSession.createDataFrame(rows, f"ch_i {kind}, ch_j {kind}, w double")
    pairs = a.join(b, "voxel").join(table, ["ch_i", "ch_j"])
    return pairs.groupBy("voxel").agg(F.sum(F.col("a") * F.col("w") * F.col("b")).alias("resolution"))


def project_to_surface(values: DataFrame, vertices: DataFrame, radius: float = 12.0, method: str = "gaussian", fwhm: float = 10.0, power: float = 2.0, min_voxels: int = 1) -> DataFrame:
    """(vertex, value) of the voxels (x, y, z, value) within radius: they meet on cells of that size."""
    cell = [F.floor(F.col(c) / radius).cast("long").alias(f"c{c}") for c in "xyz"]
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    v = vertices.select("vertex", *[F.col(c).alias(f"v{c}") for c in "xyz"], *cell).withColumn("o", near)
    v = v.withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"o.{a}") for c, a in zip("xyz", "ijk", strict=True)}).drop("o")
    far = F.sqrt(sum((F.col(c) - F.col(f"v{c}")) ** 2 for c in "xyz"))
    hit = v.join(values.filter("value IS NOT NULL").select("x", "y", "z", "value", *cell), ["cx", "cy", "cz"]).withColumn("d", far).filter(F.col("d") <= radius)
    sigma = fwhm / np.sqrt(8 * np.log(2))
    w = F.exp(-(F.col("d") ** 2) / (2 * sigma**2)) if method == "gaussian" else 1 / F.greatest(F.col("d"), F.lit(1e-9)) ** power
    value = {"nearest": F.min_by("value", "d"), "peak": F.max_by("value", F.abs("value"))}.get(method, F.try_divide(F.sum(w * F.col("value")), F.sum(w)))
    return hit.groupBy("vertex").agg(value.alias("value"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_voxels).drop("n")


def labels_at(points: DataFrame, volume: DataFrame, spacing: float = 1.0, offset=(0.0, 0.0, 0.0), outside: int = 0) -> DataFrame:
    """Adds the label of the volume's voxel (i, j, k, label) that holds each point."""
    ijk = {a: F.rint((F.col(c) - o) / spacing).cast("int") for a, c, o in zip("ijk", "xyz", offset, strict=True)}
    return points.withColumns(ijk).join(volume, ["i", "j", "k"], "left").withColumn("label", F.coalesce("label", F.lit(outside)))


def simulate_fd(spark: SparkSession, rho: list[float], frames: int, mua: float, musp: float, n: float = 1.33, freq: float = 1.1e8, level: float = 0.0, seed: int = 0, fs: float = 1.0) -> DataFrame:
    """(frame, t, channel, rho, re, im); each frame has its own seed, so a lost task repeats its rows."""
    clean = np.conj(diffusion.fd_fluence(np.asarray(rho, float), mua, musp, n, freq))

    def run(batches):
        for pdf in batches:
            for f in pdf["id"]:
                z = layers.fd_noise(clean, level, np.random.default_rng([seed, f])) if level else clean
                yield pd.DataFrame({"frame": f, "t": f / fs, "channel": range(len(rho)), "rho": rho, "re": z.real, "im": z.imag})

    return spark.range(frames).mapInPandas(run, "frame long, t double, channel int, rho double, re double, im double")
