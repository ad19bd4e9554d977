"""Event tables: (recording, onset, duration, value, label), one row per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["recording", "onset", "duration", "value", "label"]


def from_dataframe(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def add_event(events: DataFrame, recording, onset: float, duration: float, value: float, label: str) -> DataFrame:
    row = events.sparkSession.createDataFrame([(recording, onset, duration, value, label)], events.select(*COLUMNS).schema)
    return events.select(*COLUMNS).unionByName(row)


def numbered(events: DataFrame) -> DataFrame:
    """Position of each event within its recording, from 0, in order of onset."""
    w = Window.partitionBy("recording").orderBy("onset", "label", "duration", "value")
    return events.withColumn("idx", F.row_number().over(w) - 1)


sort_by_onset = numbered


def remove_event(events: DataFrame, index: int) -> DataFrame:
    return numbered(numbered(events).filter(F.col("idx") != index).drop("idx"))


def get_event(events: DataFrame, index: int) -> DataFrame:
    return numbered(events).filter(F.col("idx") == index)


def remove_events_by_label(events: DataFrame, label: str) -> DataFrame:
    return events.filter(~F.col("label").eqNullSafe(F.lit(label)))


def get_events_by_label(events: DataFrame, label: str) -> DataFrame:
    return events.filter(F.col("label") == label)


def _updates(match: Column, **fields) -> dict[str, Column]:
    return {k: F.when(match, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items() if v is not None}


def update_event(events: DataFrame, index: int, onset=None, duration=None, value=None, label=None) -> DataFrame:
    out = numbered(events)
    return out.withColumns(_updates(F.col("idx") == index, onset=onset, duration=duration, value=value, label=label))


def update_events_by_label(events: DataFrame, old_label: str, new_label=None, duration=None, value=None) -> DataFrame:
    """Rows are chosen by their label before any change."""
    return events.withColumns(_updates(F.col("label") == old_label, label=new_label, duration=duration, value=value))


def filter_events(events: DataFrame, onset_min=None, onset_max=None, labels=None) -> DataFrame:
    """Onsets within [onset_min, onset_max] and labels in a list."""
    if onset_min is not None:
        events = events.filter(F.col("onset") >= onset_min)
    if onset_max is not None:
        events = events.filter(F.col("onset") <= onset_max)
    return events.filter(F.col("label").isin(list(labels))) if labels is not None else events


def n_events_by_condition(events: DataFrame) -> DataFrame:
    return events.groupBy("label").agg(F.count(F.lit(1)).alias("n_events"))


def remove_duplicates(events: DataFrame, subset=("onset", "label"), keep: str | bool = "first") -> DataFrame:
    """keep: first, last or False (drop every row that has a duplicate), in order of the rows' values."""
    by = ["recording", *subset]
    if keep is False:
        return events.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).filter("_n = 1").drop("_n")
    order = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in ("onset", "duration", "value", "label")]
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def merge_overlapping(events: DataFrame, tolerance: float = 0.0, by_label: bool = True) -> DataFrame:
    """Coalesces intervals that overlap or lie within the tolerance, per label or over all labels;
    value is the mean; a merged interval of several labels is called 'merged'."""
    keys = ["recording", "label"] if by_label else ["recording"]
    w = Window.partitionBy(*keys).orderBy("onset", "duration")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("onset") + F.coalesce("duration", F.lit(0.0))
    reach = F.max(end).over(before)
    df = events.withColumn("_new", F.when(reach.isNull() | (F.col("onset") > reach + tolerance), 1).otherwise(0))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    label = F.when(F.countDistinct("label") > 1, F.lit("merged")).otherwise(F.min("label"))
    out = df.groupBy(*keys, "_island").agg(
        F.min("onset").alias("onset"), (F.max(end) - F.min("onset")).alias("duration"), F.avg("value").alias("value"), *([] if by_label else [label.alias("label")])
    )
    return out.select(*COLUMNS)


def from_stim(samples: DataFrame) -> DataFrame:
    """(recording, condition, frame, t, v) -> an event per run of nonzero samples; duration from
    its first to its last sample, value of the first."""
    w = Window.partitionBy("recording", "condition").orderBy("frame")
    on = F.coalesce(F.col("v") != 0, F.lit(False))
    df = samples.withColumn("_on", on).withColumn("_new", (on & ~F.coalesce(F.lag("_on").over(w), F.lit(False))).cast("int"))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_on")
    out = df.groupBy("recording", "condition", "_run").agg(F.min("t").alias("onset"), (F.max("t") - F.min("t")).alias("duration"), F.min_by("v", "frame").alias("value"))
    return out.select("recording", "onset", "duration", "value", F.col("condition").alias("label"))


def to_dict(events: DataFrame) -> DataFrame:
    """One row per recording with the columns as ordered lists."""
    rows = F.array_sort(F.collect_list(F.struct("onset", "duration", "value", "label")))
    return events.groupBy("recording").agg(rows.alias("r")).select("recording", *[F.col("r")[c].alias(c) for c in COLUMNS[1:]])
