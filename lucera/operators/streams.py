"""Sample tables: (recording, channel, [wavelength,] frame, t, v), a row per sample.

A series is one channel (and wavelength) of one recording; windows partition by series, so a
task holds one series, never a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["recording", "channel"]
EPS = 1e-10


def intensity_to_od(samples: DataFrame, keys=tuple(SERIES), window: tuple[int, int] | None = None) -> DataFrame:
    """-ln((|v| + eps) / mean|v| + eps); the mean over all frames or frames [start, end)."""
    inside = F.abs("v") if window is None else F.when((F.col("frame") >= window[0]) & (F.col("frame") < window[1]), F.abs("v"))
    # means combine before their shuffle, and meet the samples by a join: no task holds a series
    base = samples.groupBy(*keys).agg(F.avg(inside).alias("_base"))
    od = -F.log((F.abs("v") + EPS) / F.nullif(F.col("_base"), F.lit(0.0)) + EPS)
    return samples.join(base, list(keys)).withColumn("od", od).drop("_base")


def average_seconds(samples: DataFrame, window_s: float, keys=tuple(SERIES), method: str = "mean") -> DataFrame:
    """Tumbling blocks of window_s seconds from each series' first sample."""
    first = samples.groupBy(*keys).agg(F.min("t").alias("_t0"))
    block = F.floor((F.col("t") - F.col("_t0")) / window_s).cast("long")
    agg = F.avg("v") if method == "mean" else F.median("v")
    rows = samples.join(first, list(keys)).withColumn("block", block)
    return rows.groupBy(*keys, "block").agg(agg.alias("v"), F.avg("t").alias("t"), F.count("v").alias("n"))


def average_frames(samples: DataFrame, n: int, keys=tuple(SERIES), method: str = "mean", partial: str = "keep", time_label: str = "center", skipna: bool = True) -> DataFrame:
    """Tumbling blocks of n frames; partial 'drop' leaves out a short last block."""
    agg = F.avg("v") if method == "mean" else F.median("v")
    agg = agg if skipna else F.when(F.count("v") == F.count(F.lit(1)), agg)
    t = {"center": F.avg("t"), "start": F.min("t"), "end": F.max("t")}[time_label]
    out = samples.groupBy(*keys, F.floor(F.col("frame") / n).cast("long").alias("block")).agg(agg.alias("v"), t.alias("t"), F.count(F.lit(1)).alias("_n"))
    return (out.filter(F.col("_n") == n) if partial == "drop" else out).drop("_n")


def average_gaps(samples: DataFrame, gap_s: float, keys=tuple(SERIES)) -> DataFrame:
    """A block per stretch without a gap above gap_s."""
    w = Window.partitionBy(*keys).orderBy("t", "v")
    new = F.when(F.col("t") - F.lag("t").over(w) > gap_s, 1).otherwise(0)
    df = samples.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "block").agg(F.avg("v").alias("v"), F.avg("t").alias("t"), F.count("v").alias("n"))


def average_edges(samples: DataFrame, edges: list[float], keys=tuple(SERIES)) -> DataFrame:
    """Half-open bins [edge, next edge); samples outside are left out."""
    cells = F.array(*[F.lit(float(e)) for e in edges])
    bin_ = F.size(F.filter(cells, lambda e: e <= F.col("t"))) - 1
    df = samples.withColumn("block", bin_).filter((F.col("block") >= 0) & (F.col("block") < len(edges) - 1))
    return df.groupBy(*keys, "block").agg(F.avg("v").alias("v"), F.avg("t").alias("t"))


def detrend(samples: DataFrame, keys=tuple(SERIES), recenter: bool = True) -> DataFrame:
    """Removes each series' least-squares line; recenter puts the mean back."""
    fit = samples.groupBy(*keys).agg(F.regr_slope("v", "frame").alias("_b"), F.avg("v").alias("_m"), F.avg(F.when(F.col("v").isNotNull(), F.col("frame"))).alias("_f"))
    value = F.col("v") - F.col("_b") * (F.col("frame") - F.col("_f")) - (F.lit(0.0) if recenter else F.col("_m"))
    return samples.join(fit, list(keys)).withColumn("v", value).drop("_b", "_m", "_f")


def concatenate(runs: list[DataFrame], gap: float, keys=tuple(SERIES)) -> DataFrame:
    """Runs one after another in time, each `gap` seconds after the one before it ends."""
    tagged = [r.withColumn("run", F.lit(i)) for i, r in enumerate(runs)]
    whole = tagged[0]
    for r in tagged[1:]:
        whole = whole.unionByName(r)
    span = whole.groupBy("recording", "run").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    w = Window.partitionBy("recording").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.col("_hi") - F.col("_lo") + gap).over(w), F.lit(0.0))
    spans = span.withColumn("_shift", shift)
    return whole.join(spans, ["recording", "run"]).withColumn("t", F.col("t") - F.col("_lo") + F.col("_shift")).drop("_lo", "_hi", "_shift")


def segment_by_events(samples: DataFrame, events: DataFrame, pre: float = 0.0, post: float = 0.0, min_duration: float | None = None, width: float = 3600.0) -> DataFrame:
    """Samples within [onset - pre, onset + duration + post] of each event of their recording, both
    ends included; a sample may lie in several. seg_t is the time from the segment's start.

    The range join meets on time buckets of `width` seconds, so neither side is broadcast and one
    recording spreads over many tasks.
    """
    lo = F.col("onset") - pre
    hi = F.col("onset") + F.coalesce("duration", F.lit(0.0)) + post
    e = events.select("recording", "onset", "label", lo.alias("seg_start"), hi.alias("seg_end"))
    if min_duration is not None:
        e = e.filter(F.col("seg_end") - F.col("seg_start") >= min_duration)
    e = e.withColumn("_b", F.explode(F.sequence(F.floor(F.col("seg_start") / width).cast("long"), F.floor(F.col("seg_end") / width).cast("long"))))
    s = samples.withColumn("_b", F.floor(F.col("t") / width).cast("long"))
    out = s.join(e, ["recording", "_b"]).filter((F.col("t") >= F.col("seg_start")) & (F.col("t") <= F.col("seg_end")))
    return out.withColumn("seg_t", F.col("t") - F.col("seg_start")).drop("_b")


def slice_events(samples: DataFrame, events: DataFrame, first: int, last: int) -> DataFrame:
    """Samples between the onsets of the first-th and last-th event of the recording."""
    w = Window.partitionBy("recording").orderBy("onset", "label")
    at = events.withColumn("_i", F.row_number().over(w) - 1)
    ends = at.groupBy("recording").agg(F.min(F.when(F.col("_i") == first, F.col("onset"))).alias("_lo"), F.min(F.when(F.col("_i") == last, F.col("onset"))).alias("_hi"))
    return samples.join(ends, "recording").filter((F.col("t") >= F.col("_lo")) & (F.col("t") <= F.col("_hi"))).drop("_lo", "_hi")


def align_asof(target: DataFrame, source: DataFrame, keys=("recording",), mode: str = "linear") -> DataFrame:
    """Source values (t, x) at the target's times: linear between neighbours, nearest outside."""
    k = list(keys)
    both = target.select(*k, "t", F.lit(None).cast("double").alias("x"), F.lit(1).alias("_ask")).unionByName(source.select(*k, "t", "x", F.lit(0).alias("_ask")))
    # two running values, one from either end: each grows row by row
    back = Window.partitionBy(*k).orderBy("t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*k).orderBy(F.col("t").desc(), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_ask") == 0, F.struct(F.col("t").alias("t"), F.col("x").alias("x")))
    df = both.withColumn("_p", F.last(known, ignorenulls=True).over(back)).withColumn("_n", F.last(known, ignorenulls=True).over(ahead)).filter("_ask = 1")
    p, n = F.col("_p"), F.col("_n")
    share = F.try_divide(F.col("t") - p["t"], n["t"] - p["t"])
    inside = p["x"] + (n["x"] - p["x"]) * F.coalesce(share, F.lit(0.0)) if mode == "linear" else F.when(F.col("t") - p["t"] <= n["t"] - F.col("t"), p["x"]).otherwise(n["x"])
    return df.select(*k, "t", F.when(p.isNull(), n["x"]).when(n.isNull(), p["x"]).otherwise(inside).alias("x"))


def unwrap_phase(df: DataFrame, by, order: str, degrees: str) -> DataFrame:
    """Degrees to unwrapped radians along an ordinal (channels of a frame)."""
    turn = F.lit(6.283185307179586)
    w = Window.partitionBy(*by).orderBy(order)
    rad = F.radians(degrees)
    wrapped = rad - turn * F.floor((rad + turn / 2) / turn)
    df = df.withColumn("_r", wrapped).withColumn("_d", F.col("_r") - F.lag("_r").over(w))
    jump = F.when(F.col("_d") > turn / 2, -1).when(F.col("_d") < -turn / 2, 1).otherwise(0)
    df = df.withColumn("_j", jump)
    total = F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("phase", F.col("_r") + turn * total).drop("_r", "_d", "_j")


def lag_matrix(samples: DataFrame, p: int, keys=tuple(SERIES)) -> DataFrame:
    """lag_1 .. lag_p of v, zero before the start."""
    w = Window.partitionBy(*keys).orderBy("frame")
    return samples.select("*", *[F.lag("v", k, 0.0).over(w).alias(f"lag_{k}") for k in range(1, p + 1)])


def magnitude(aux: DataFrame) -> DataFrame:
    """sqrt(x^2 + y^2 + z^2) over the signals whose names hold x, y and z."""
    part = lambda c: F.max(F.when(F.lower("signal").contains(c), F.col("v")))
    return aux.groupBy("recording", "t").agg(F.sqrt(part("x") ** 2 + part("y") ** 2 + part("z") ** 2).alias("magnitude"))


def info(samples: DataFrame, keys=tuple(SERIES)) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))


# channels ------------------------------------------------------------------


def mark_bad(channels: DataFrame, labels: list) -> DataFrame:
    return channels.withColumn("is_bad", F.when(F.col("channel").isin(labels), True).otherwise(F.col("is_bad")))


def drop_channels(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels.select("channel").distinct(), "channel", "left_anti")


def drop_bad_channels(channels: DataFrame, protect_short: bool = True) -> DataFrame:
    keep = ~F.col("is_bad")
    return channels.filter(keep | F.col("is_short")) if protect_short else channels.filter(keep)


def keep_channels(channels: DataFrame, min_distance: float | None = None, max_distance: float | None = None) -> DataFrame:
    """Marks good long channels outside [min, max] mm as bad."""
    outside = F.lit(False)
    if min_distance is not None:
        outside = outside | (F.col("distance_mm") < min_distance)
    if max_distance is not None:
        outside = outside | (F.col("distance_mm") > max_distance)
    return channels.withColumn("is_bad", F.col("is_bad") | (~F.col("is_short") & outside))


def mark_empty_bad(samples: DataFrame) -> DataFrame:
    """(recording, channel, is_bad): bad if no sample has a value."""
    return samples.groupBy(*SERIES).agg((F.count("v") == 0).alias("is_bad"))


def aggregate_channels(samples: DataFrame, groups: DataFrame, method: str = "mean") -> DataFrame:
    """Means or medians over channel groups (null if any member is null); other channels pass."""
    agg = F.avg("v") if method == "mean" else F.median("v")
    df = samples.join(groups, "channel", "left").withColumn("channel", F.coalesce("grp", F.col("channel").cast("string")))
    return df.groupBy("recording", "channel", "frame").agg(F.when(F.count("v") == F.count(F.lit(1)), agg).alias("v"), F.min("t").alias("t"))


def session_matches(filters: dict) -> Column:
    """Predicate of metadata filters: a value, a list, or (op, threshold) with >=, <=, >, <, between."""
    out = F.lit(True)
    for key, want in filters.items():
        c = F.col(key)
        if isinstance(want, tuple) and want and want[0] in (">=", "<=", ">", "<", "between"):
            num = c.try_cast("double")
            op, v = want[0], want[1:]
            test = {">=": lambda: num >= v[0], "<=": lambda: num <= v[0], ">": lambda: num > v[0], "<": lambda: num < v[0], "between": lambda: num.between(*(v[0] if len(v) == 1 else v))}[op]()
        elif isinstance(want, list | set | frozenset):
            test = c.cast("string").isin([str(x) for x in want])
        else:
            test = c.cast("string") == str(want)
        out = out & F.coalesce(test, F.lit(False))
    return out
