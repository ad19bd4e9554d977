"""Regions of interest as tables (roi, channel): edits, masks, summaries and rules that make them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "roi string, channel int"


def add(rois: DataFrame, channels: DataFrame, name: str, members: list) -> DataFrame:
    """A region of these channels, in place of one of that name; labels that the montage lacks are left out."""
    new = channels.filter(F.col("channel").isin(members)).select(F.lit(name).alias("roi"), "channel").distinct()
    return remove(rois, name).unionByName(new)


def remove(rois: DataFrame, name: str) -> DataFrame:
    return rois.filter(F.col("roi") != name)


def rename(rois: DataFrame, old: str, new: str) -> DataFrame:
    return rois.withColumn("roi", F.when(F.col("roi") == old, new).otherwise(F.col("roi")))


def mask(rois: DataFrame, channels: DataFrame, name: str) -> DataFrame:
    """(channel, is_member) of every channel."""
    inside = rois.filter(F.col("roi") == name).select("channel", F.lit(True).alias("is_member")).distinct()
    return channels.select("channel").join(inside, "channel", "left").withColumn("is_member", F.coalesce("is_member", F.lit(False)))


def listed(rois: DataFrame) -> DataFrame:
    """(roi, n, channels): channels in order, as text."""
    return rois.groupBy("roi").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("channel")).cast("array<string>"), " ").alias("channels"))


def by_landmark(channels: DataFrame, landmarks: DataFrame, name: str, landmark: str, radius: float) -> DataFrame:
    """Channels whose midpoint lies within radius of a landmark (label, x, y, z)."""
    at = landmarks.filter(F.col("label") == landmark).select(*[F.col(c).alias(f"l{c}") for c in "xyz"])
    # one landmark has a name: a row, or some
    both = channels.join(F.broadcast(at.limit(1)), F.lit(True))
    away = F.sqrt(sum(((F.col(c) - F.col(f"l{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return both.filter(away <= radius).select(F.lit(name).alias("roi"), "channel")


def by_clustering(channels: DataFrame, n: int, names: list[str] | None = None, seed: int = 42, starts: int = 10, turns: int = 100) -> DataFrame:
    """n regions of near midpoints by k-means from several seeded starts. A montage is a small table, and
    is clustered in one group; regions are numbered by their least channel."""
    kind = dict(channels.dtypes)["channel"]

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("channel").reset_index(drop=True)
        x = pdf[["x", "y", "z"]].to_numpy(float)
        k, best = min(n, len(x)), (np.inf, None)
        for s in range(starts):
            r = np.random.default_rng([seed, s])
            at = x[r.choice(len(x), k, replace=False)]
            for _ in range(turns):
                near = ((x[:, None] - at[None]) ** 2).sum(2).argmin(1)
                new = np.array([x[near == c].mean(0) if (near == c).any() else at[c] for c in range(k)])
                if np.allclose(new, at):
                    break
                at = new
            cost = ((x - at[near]) ** 2).sum()
            if cost < best[0] - 1e-12:
                best = (cost, near)
        order = list(dict.fromkeys(best[1].tolist()))
        label = [(names[order.index(c)] if names else f"cluster_{order.index(c) + 1}") for c in best[1]]
        return pd.DataFrame({"roi": label, "channel": pdf["channel"]})

    return channels.select("channel", "x", "y", "z").groupBy().applyInPandas(run, f"roi string, channel {kind}")


def resolve(spark, given, channels: DataFrame) -> DataFrame:
    """Regions from a table, a dict of name to channels, or a function of the channels that gives either."""
    if isinstance(given, Callable) and not isinstance(given, DataFrame | dict):
        given = given(channels)
    if isinstance(given, dict):
        given = spark.createDataFrame([(k, c) for k, v in given.items() for c in v], f"roi string, channel {dict(channels.dtypes)['channel']}")
    return given.join(channels.select("channel"), "channel", "left_semi").select("roi", "channel")


def roi_values(values: DataFrame, rois: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Mean of the channels' values in each region."""
    return values.join(rois, "channel").groupBy(*keys, "roi").agg(F.avg(value).alias(value), F.count(value).alias("n"))


def align_to_channels(values: DataFrame, channels: DataFrame, value: str = "value") -> DataFrame:
    """(channel, value) of all of a montage's channels in their order; null where a group result lacks one."""
    order = channels.select("channel", F.row_number().over(Window.orderBy("channel")).alias("position"))
    return order.join(values.select("channel", value), "channel", "left").withColumn("position", F.col("position") - 1)


def cluster_by_source(channels: DataFrame) -> DataFrame:
    """(source, channels, n, mean_mm): the channels of each source, as detectors of one flow measurement."""
    return channels.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("channel")).cast("array<string>"), " ").alias("channels"), F.count(F.lit(1)).alias("n"), F.avg("distance_mm").alias("mean_mm"))
