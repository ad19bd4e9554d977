"""Signal quality: signal-to-noise ratios, windows, summaries of channels and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snr(samples: DataFrame, keys: list[str]) -> DataFrame:
    """mean |v| over the population sd; null where the sd is 0."""
    sd = F.stddev_pop("v")
    return samples.groupBy(*keys).agg(F.when(sd > 0, F.avg(F.abs("v")) / (sd + 1e-12)).alias("snr"))


def windows(samples: DataFrame, length: int, step: int) -> DataFrame:
    """A row per sample and full sliding window it lies in, numbered from 0 within its series."""
    lo = F.greatest(F.lit(0), F.ceil((F.col("frame") - length + 1) / step)).cast("long")
    return samples.withColumn("win", F.explode(F.sequence(lo, F.floor(F.col("frame") / step).cast("long"))))


def windowed_snr(samples: DataFrame, keys: list[str], length: int, step: int) -> DataFrame:
    """Median over full windows of the windows' ratios."""
    per = windows(samples, length, step).groupBy(*keys, "win").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.abs("v")).alias("_m"), F.stddev_pop("v").alias("_s"))
    per = per.filter(F.col("_n") == length).withColumn("snr", F.when(F.col("_s") > 0, F.col("_m") / (F.col("_s") + 1e-12)))
    return per.groupBy(*keys).agg(F.median("snr").alias("snr"), F.count(F.lit(1)).alias("n_windows"))


def windowed_correlation(pairs: DataFrame, keys: list[str], length: int, step: int) -> DataFrame:
    """Median over full windows of the correlation of x and y, as for a coupling index of
    band-passed wavelengths."""
    per = windows(pairs, length, step).groupBy(*keys, "win").agg(F.count(F.lit(1)).alias("_n"), F.corr("x", "y").alias("_r"))
    per = per.filter(F.col("_n") == length).withColumn("_r", F.when(~F.isnan("_r"), F.col("_r")))
    return per.groupBy(*keys).agg(F.median("_r").alias("sci"))


def combine(windowed: DataFrame, keys: list[str], sci: float = 0.8, psp: float = 0.1, logic: str = "or") -> DataFrame:
    """Share of windows above the strict thresholds."""
    a, b = F.coalesce(F.col("sci") > sci, F.lit(False)), F.coalesce(F.col("psp") > psp, F.lit(False))
    return windowed.groupBy(*keys).agg(F.avg(((a | b) if logic == "or" else (a & b)).cast("int")).alias("frac_good"))


def screen(values: DataFrame, threshold: float, null_is_bad: bool) -> DataFrame:
    """(channel, value) rows of wavelengths -> is_bad: any value below the threshold."""
    bad = F.coalesce(F.col("value") < threshold, F.lit(null_is_bad))
    return values.groupBy("channel").agg(F.min("value").alias("value"), F.bool_or(bad).alias("is_bad"))


def summary(values: DataFrame, threshold: float, by=()) -> DataFrame:
    """Good (>= threshold), bad (<) and missing counts, mean, median and population sd."""
    v = F.col("value")
    return values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v >= threshold).alias("n_good"), F.count_if(v < threshold).alias("n_bad"), F.count_if(v.isNull()).alias("n_missing"),
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"),
    )


def roi_summary(channels: DataFrame, roi: DataFrame) -> DataFrame:
    good = ~F.col("is_bad")
    out = roi.join(channels, "channel").groupBy("roi").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good"), F.count_if(F.col("is_bad")).alias("n_bad"), F.count_if(F.col("is_short")).alias("n_short"), F.count_if(~F.col("is_short")).alias("n_long"), F.count_if(good & ~F.col("is_short")).alias("n_good_long")
    )
    return out.withColumn("pct_good", F.try_divide(100.0 * F.col("n_good"), F.col("n"))).withColumn("pct_good_long", F.try_divide(100.0 * F.col("n_good_long"), F.col("n_long")))
