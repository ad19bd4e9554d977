"""Connectivity of channels, its averages, thresholds and graphs, as edge tables (i < j)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucera.functions.optics import fisher_z
from lucera.functions.pairs import common_frames


def pearson(samples: DataFrame, by=("recording",), within=None) -> DataFrame:
    """(by, ch_i, ch_j, value, n): correlation of each pair of channels over common frames.

    Samples move once, as lists, to the task of their recording (by, or the columns of it in within);
    there a group is worked out at a time, so that a task holds the pairs of one group, however many it gets.
    """
    k = list(by)
    lists = ("frame", "channel", "v")
    known = samples.select(*k, "frame", "channel", F.col("v").cast("double").alias("v")).filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*k, "frame", "channel")))
    kind = {f.name: f.dataType.simpleString() for f in known.schema}
    keys = "".join(f"`{c}` {kind[c]}, " for c in k)

    def packed(batches):
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).group_by(k, use_threads=False).aggregate([(c, "list") for c in lists])
                yield from t.select([*k, *(f"{c}_list" for c in lists)]).rename_columns([*k, *lists]).to_batches()

    def table(t):
        frame, channel, v = (pa.concat_arrays([c.flatten() for c in t.column(name).chunks]) for name in lists)
        names = channel.unique()
        names = names.take(pc.sort_indices(names))
        met, n, value = common_frames(
            frame.dictionary_encode().indices.to_numpy(), pc.index_in(channel, names).to_numpy(),
            v.to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False),
        )
        i, j = np.nonzero(np.triu(met, 1))
        key = {c: pa.repeat(t.column(c)[0], len(i)) for c in k}
        return pa.table(key | {"ch_i": names.take(pa.array(i)), "ch_j": names.take(pa.array(j)), "value": pa.array(value[i, j], mask=np.isnan(value[i, j])), "n": pa.array(n[i, j])})

    moved = known.mapInArrow(packed, keys + ", ".join(f"{c} array<{kind[c]}>" for c in lists))
    moved = moved.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(k if within is None else within))
    return moved.groupBy(*k).applyInArrow(table, f"{keys}ch_i {kind['channel']}, ch_j {kind['channel']}, value double, n bigint")


def average(fc: DataFrame, by=("ch_i", "ch_j"), how: str = "mean") -> DataFrame:
    """Fisher-z mean, or median of raw values."""
    agg = F.tanh(F.avg(fisher_z(F.col("value")))) if how == "mean" else F.median("value")
    return fc.groupBy(*by).agg(agg.alias("value"), F.count("value").alias("n"))


def check_poolable(fc: DataFrame, tol: float = 0.1) -> DataFrame:
    """Whether units agree and effective sample sizes differ by at most tol."""
    return fc.agg(
        (F.countDistinct("units") <= 1).alias("same_units"), F.coalesce(F.try_divide(F.max("n_eff") - F.min("n_eff"), F.max("n_eff")) <= tol, F.lit(True)).alias("same_n_eff")
    )


def roi_average(fc: DataFrame, roi: DataFrame, weights: DataFrame | None = None, by=()) -> DataFrame:
    """Means and sd in z over the pairs of each two regions; a channel may be in many."""
    z, k = fisher_z(F.col("value")), list(by)
    a = roi.select(F.col("roi").alias("roi_i"), F.col("channel").alias("ch_i"))
    b = roi.select(F.col("roi").alias("roi_j"), F.col("channel").alias("ch_j"))
    both = fc.select(*k, "ch_i", "ch_j", "value").unionByName(fc.select(*k, F.col("ch_j").alias("ch_i"), F.col("ch_i").alias("ch_j"), "value"))
    pairs = both.join(a, "ch_i").join(b, "ch_j").filter("roi_i < roi_j OR (roi_i = roi_j AND ch_i < ch_j)").withColumn("_z", z)
    if weights is not None:
        w = weights.select("channel", "weight")
        pairs = pairs.join(w.withColumnsRenamed({"channel": "ch_i", "weight": "_wi"}), "ch_i").join(w.withColumnsRenamed({"channel": "ch_j", "weight": "_wj"}), "ch_j")
        pairs = pairs.withColumn("_w", F.when(F.col("_z").isNotNull(), F.col("_wi") * F.col("_wj")))
    else:
        pairs = pairs.withColumn("_w", F.when(F.col("_z").isNotNull(), F.lit(1.0)))
    s = pairs.groupBy(*k, "roi_i", "roi_j").agg(
        F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_z")).alias("wz"), F.sum(F.col("_w") * F.col("_z") ** 2).alias("wzz"),
        F.count("_z").alias("n_pairs"), F.countDistinct("ch_i").alias("n_channels_i"), F.countDistinct("ch_j").alias("n_channels_j"),
    )
    mean = F.try_divide("wz", "w")
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("wzz", "w") - mean * mean))
    return s.select(*k, "roi_i", "roi_j", F.tanh(mean).alias("value"), sd.alias("sd"), "n_pairs", "n_channels_i", "n_channels_j")


def handle_negatives(fc: DataFrame, mode: str = "discard") -> DataFrame:
    value = {"discard": F.when(F.col("value").isNotNull(), F.greatest("value", F.lit(0.0))), "absolute": F.abs("value"), "keep": F.col("value")}[mode]
    return fc.withColumn("value", value)


def threshold(fc: DataFrame, kind: str = "sparsity", value: float = 0.15, binarize: bool = True, by=()) -> DataFrame:
    """Keeps the top share of edges (sparsity) or edges at or above a value; others become 0."""
    if kind == "sparsity":
        cut = fc.groupBy(*by).agg(F.percentile("value", 1 - value).alias("_cut"))
        df = fc.join(cut, list(by)) if by else fc.crossJoin(F.broadcast(cut))  # one row
    else:
        df = fc.withColumn("_cut", F.lit(float(value)))
    kept = F.col("value") >= F.col("_cut")
    return df.withColumn("value", F.when(kept, F.lit(1.0) if binarize else F.col("value")).when(F.col("value").isNotNull(), 0.0)).drop("_cut")


def to_matrix(fc: DataFrame, channels: list, by=()) -> DataFrame:
    both = fc.select(*by, "ch_i", "ch_j", "value").unionByName(fc.select(*by, F.col("ch_j").alias("ch_i"), F.col("ch_i").alias("ch_j"), "value"))
    return both.groupBy(*by, "ch_i").pivot("ch_j", channels).agg(F.first("value"))


def to_dataframe(fc: DataFrame) -> DataFrame:
    return fc.filter("ch_i <= ch_j AND value IS NOT NULL").withColumn("z", fisher_z(F.col("value")))


def reduce(fc: DataFrame, axis: str, lo: float, hi: float, how: str = "mean", by=("ch_i", "ch_j")) -> DataFrame:
    agg = {"mean": F.avg, "median": F.median, "max": F.max}[how]("value")
    return fc.filter(F.col(axis).between(lo, hi)).groupBy(*by).agg(agg.alias("value"))


# graphs ----------------------------------------------------------------------


def edges(fc: DataFrame, by=()) -> DataFrame:
    return fc.filter("value <> 0").select(*by, "ch_i", "ch_j", "value")


def density(fc: DataFrame, n_nodes: int, by=()) -> DataFrame:
    return edges(fc, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges")).withColumn("density", 2.0 * F.col("n_edges") / (n_nodes * (n_nodes - 1)))


def degree(fc: DataFrame, by=()) -> DataFrame:
    e = edges(fc, by)
    return e.select(*by, F.col("ch_i").alias("node")).unionAll(e.select(*by, F.col("ch_j").alias("node"))).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))


def clustering(fc: DataFrame, by=()) -> DataFrame:
    """Local clustering coefficient: triangles by an oriented three-way join, over pairs of neighbours."""
    e, k = edges(fc, by), list(by)
    ab = e.select(*k, F.col("ch_i").alias("a"), F.col("ch_j").alias("b"))
    bc = e.select(*k, F.col("ch_i").alias("b"), F.col("ch_j").alias("c"))
    ac = e.select(*k, F.col("ch_i").alias("a"), F.col("ch_j").alias("c"))
    tri = ab.join(bc, [*k, "b"]).join(ac, [*k, "a", "c"])
    per = tri.select(*k, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*k, "node").agg(F.count(F.lit(1)).alias("triangles"))
    out = degree(fc, by).join(per, [*k, "node"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return out.withColumn("clustering", F.when(pairs > 0, 2.0 * F.col("triangles") / pairs).otherwise(0.0))


def lagged_products(samples: DataFrame, max_lag: int, keys=("recording", "channel")) -> DataFrame:
    """Autocorrelation of each series at lags 1 .. max_lag."""
    w = Window.partitionBy(*keys)
    df = samples.withColumn("_c", F.col("v") - F.avg("v").over(w))
    o = w.orderBy("frame")
    df = df.select(*keys, "_c", *[F.lag("_c", k).over(o).alias(f"l{k}") for k in range(1, max_lag + 1)])
    return df.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col("_c") * F.col(f"l{k}")), F.sum(F.col("_c") ** 2)).alias(f"rho_{k}") for k in range(1, max_lag + 1)])
