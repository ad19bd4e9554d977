"""Block averages over unbounded samples: the tumbling-window operator with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_average(samples: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", keys=("channel",)) -> DataFrame:
    """Tumbling means of v with a watermark: late samples are dropped, state is bounded by the
    windows still open. Works on batch and streaming tables alike."""
    df = samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = df.groupBy(F.window(time, width), *keys).agg(F.avg("v").alias("v"), F.count("v").alias("n"))
    return out.select(*keys, F.col("window.start").alias("start"), "v", "n")


def gap_sessions(samples: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", keys=("channel",)) -> DataFrame:
    df = samples.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return df.groupBy(F.session_window(time, gap), *keys).agg(F.avg("v").alias("v"), F.count("v").alias("n")).select(*keys, F.col("session_window.start").alias("start"), "v", "n")
