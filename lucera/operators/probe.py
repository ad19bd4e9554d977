"""Sensor geometry: channels, distances, regions, lattices, sensitivity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distance(a: str, b: str):
    return F.sqrt(sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in "xyz"))


def channel_table(channels: DataFrame, optodes: DataFrame, short_mm: float = 15.0) -> DataFrame:
    """(channel, source, detector) + optodes (kind, idx, x, y, z) -> label, midpoint, distance, is_short."""
    s = optodes.filter("kind = 'source'").select(F.col("idx").alias("source"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    d = optodes.filter("kind = 'detector'").select(F.col("idx").alias("detector"), *[F.col(c).alias(f"d{c}") for c in "xyz"])
    out = channels.join(s, "source").join(d, "detector").withColumn("distance_mm", distance("s", "d"))
    mids = {c: (F.col(f"s{c}") + F.col(f"d{c}")) / 2 for c in "xyz"}
    out = out.withColumns(mids).withColumn("label", F.concat(F.lit("S"), "source", F.lit("D"), "detector"))
    return out.withColumn("is_short", F.col("distance_mm") < short_mm).drop(*[p + c for p in "sd" for c in "xyz"])


def midpoint_pairs(channels: DataFrame, max_mm: float) -> DataFrame:
    """Pairs of channels with midpoints within max_mm: meets on cells of that size, so only
    neighbours meet."""
    cell = [F.floor(F.col(c) / max_mm).cast("long").alias(f"c{c}") for c in "xyz"]
    a = channels.select(F.col("channel").alias("ch_i"), *[F.col(c).alias(f"i{c}") for c in "xyz"], *cell)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    a = a.withColumn("o", F.explode(around)).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j"), "cz": F.col("cz") + F.col("o.k")}).drop("o")
    b = channels.select(F.col("channel").alias("ch_j"), *[F.col(c).alias(f"j{c}") for c in "xyz"], *cell)
    return a.join(b, ["cx", "cy", "cz"]).withColumn("mm", distance("i", "j")).filter((F.col("ch_i") < F.col("ch_j")) & (F.col("mm") <= max_mm)).select("ch_i", "ch_j", "mm")


def distance_matrix(channels: DataFrame) -> DataFrame:
    """All pairs of one probe's channels: a table bounded by the instrument, not by recordings."""
    a = channels.select(F.col("channel").alias("ch_i"), *[F.col(c).alias(f"i{c}") for c in "xyz"])
    b = channels.select(F.col("channel").alias("ch_j"), *[F.col(c).alias(f"j{c}") for c in "xyz"])
    return a.join(b, F.col("ch_i") < F.col("ch_j")).select("ch_i", "ch_j", distance("i", "j").alias("mm"))


def nearest_short(channels: DataFrame) -> DataFrame:
    """Per good long channel the nearest good short one."""
    good = channels.filter(~F.col("is_bad"))
    long = good.filter(~F.col("is_short")).select("channel", *[F.col(c).alias(f"i{c}") for c in "xyz"])
    short = good.filter("is_short").select(F.col("channel").alias("short"), *[F.col(c).alias(f"j{c}") for c in "xyz"])
    return long.join(short).groupBy("channel").agg(F.min_by("short", F.struct(F.round(distance("i", "j"), 9), "short")).alias("short"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Channels of two montages: where each is, and how far apart."""
    x = a.select("channel", *[F.col(c).alias(f"a{c}") for c in "xyz"], F.lit(1).alias("_a"))
    y = b.select("channel", *[F.col(c).alias(f"b{c}") for c in "xyz"], F.lit(1).alias("_b"))
    out = x.join(y, "channel", "full_outer").withColumn("offset_mm", distance("a", "b"))
    return out.select("channel", F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("shared").alias("state"), "offset_mm")


def union(probes: list[DataFrame]) -> DataFrame:
    """First occurrence of each channel wins."""
    whole = None
    for i, p in enumerate(probes):
        part = p.withColumn("_i", F.lit(i))
        whole = part if whole is None else whole.unionByName(part)
    return whole.withColumn("_n", F.row_number().over(Window.partitionBy("channel").orderBy("_i"))).filter("_n = 1").drop("_n", "_i")


def roi_by_position(channels: DataFrame, name: str, center: tuple, radius: float) -> DataFrame:
    away = F.sqrt(sum((F.col(c) - v) ** 2 for c, v in zip("xyz", center, strict=True)))
    return channels.filter(away <= radius).select(F.lit(name).alias("roi"), "channel")


def lattice_adjacency(voxels: DataFrame, connectivity: int = 18) -> DataFrame:
    """Neighbouring voxels (a < b) of (voxel, i, j, k)."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if 0 < abs(i) + abs(j) + abs(k) <= most]
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in steps]))
    a = voxels.select(F.col("voxel").alias("a"), "i", "j", "k").withColumn("o", o)
    a = a.select("a", (F.col("i") + F.col("o.i")).alias("i"), (F.col("j") + F.col("o.j")).alias("j"), (F.col("k") + F.col("o.k")).alias("k"))
    return a.join(voxels.select(F.col("voxel").alias("b"), "i", "j", "k"), ["i", "j", "k"]).filter("a < b").select("a", "b")


def coverage(sens: DataFrame) -> DataFrame:
    """Per voxel the sum of squares over channels, least over wavelengths."""
    per = sens.groupBy("wavelength", "voxel").agg(F.sum(F.col("value") ** 2).alias("c"))
    return per.groupBy("voxel").agg(F.min("c").alias("coverage"))


def normalised(sens: DataFrame) -> DataFrame:
    peak = F.max(F.abs("value")).over(Window.partitionBy("wavelength", "channel"))
    return sens.withColumn("_n", F.try_divide(F.abs("value"), peak)).groupBy("channel", "voxel").agg(F.avg("_n").alias("value"))


def restrict_to_coverage(sens: DataFrame, share: float = 0.001) -> DataFrame:
    cov = coverage(sens)
    peak = cov.agg((F.max("coverage") * share).alias("_cut"))
    return sens.join(cov.crossJoin(F.broadcast(peak)).filter("coverage > _cut").select("voxel"), "voxel", "left_semi")


def backproject(sens: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of channels' values per voxel, weighted by normalised sensitivity."""
    w = normalised(sens).withColumnRenamed("value", "_w").join(values.select("channel", F.col("value").alias("_x")), "channel")
    return w.groupBy("voxel").agg(F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")).alias("value"))


def label_summary(labels: DataFrame) -> DataFrame:
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).withColumn("fraction", F.col("n") / F.col("_t")).drop("_t")
