"""The engine's tables as views of the driver's: see the survey's mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200
#: Frames of one recording of the regular stream; a longer table holds more recordings.
FRAMES = 250


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embedding_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Regular streams: a recording is FRAMES vectors, channel = position (all), 10 frames a second."""
    e = read(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("channel", "v"))
    rec, frame = F.floor(F.col("vec_id") / FRAMES).cast("long"), F.col("vec_id") % FRAMES
    return e.select(rec.alias("recording"), "channel", frame.alias("frame"), (frame / 10.0).alias("t"), F.col("v").cast("double").alias("v"), "label")


EMB = f"""emb AS (SELECT vec_id // {FRAMES} AS recording, CAST(c - 1 AS INTEGER) AS channel, vec_id % {FRAMES} AS frame, (vec_id % {FRAMES}) / 10.0::DOUBLE AS t, CAST(embedding[c] AS DOUBLE) AS v, label
 FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS c FROM embeddings))"""


def event_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular streams: recording = user, channel = event type, seconds since the first of 2024."""
    e = read(spark, sf, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) - EPOCH
    return e.select(F.col("user_id").alias("recording"), F.col("event_type").alias("channel"), F.col("event_id").alias("frame"), t.alias("t"), F.col("value").alias("v"))


EVS = f"""evs AS (SELECT user_id AS recording, event_type AS channel, event_id AS frame, epoch_us(ts) / 1e6::DOUBLE - {EPOCH} AS t, value AS v FROM events)"""


def event_table(spark: SparkSession, sf: str) -> DataFrame:
    """Events: recording = user, duration = props.k x 600 s, label = event type."""
    e = read(spark, sf, "events")
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) - EPOCH
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("recording"), t.alias("onset"), (k * 600).alias("duration"), "value", F.col("event_type").alias("label"))


EVT = f"""evt AS (SELECT user_id AS recording, epoch_us(ts) / 1e6::DOUBLE - {EPOCH} AS onset, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 600 AS duration, value, event_type AS label FROM events)"""


def subject_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Subjects = customers with three orders or more: mean price (thousands) and its variance; group = segment."""
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("subject")).agg((F.avg("o_totalprice") / 1013.7).alias("beta"), (F.var_samp("o_totalprice") / 1e6 / F.count(F.lit(1))).alias("var"), F.count(F.lit(1)).alias("n"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("grp"))
    return o.filter("n > 2").join(c, "subject")


SUB = """sub AS (SELECT o_custkey AS subject, c_mktsegment AS grp, avg(o_totalprice) / 1013.7::DOUBLE AS beta, var_samp(o_totalprice) / 1e6::DOUBLE / count(*) AS var, count(*) AS n
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_mktsegment HAVING count(*) > 2)"""


def channels(spark: SparkSession, n: int = 64) -> DataFrame:
    """An 8-wide lattice, 10 mm apart; every fifth channel short, every seventh bad."""
    i = F.col("id")
    return spark.range(n).select(
        i.cast("int").alias("channel"), (i % 8 * 10.0).cast("double").alias("x"), (F.floor(i / 8) * 10.0).cast("double").alias("y"), (i % 3 * 5.0).cast("double").alias("z"),
        (i % 5 == 0).alias("is_short"), (i % 7 == 0).alias("is_bad"), F.when(i % 5 == 0, 8.0).otherwise(20.0 + i % 20).cast("double").alias("distance_mm"),
    )


CHN = """chn AS (SELECT CAST(i AS INTEGER) AS channel, i % 8 * 10.0::DOUBLE AS x, floor(i / 8) * 10.0::DOUBLE AS y, i % 3 * 5.0::DOUBLE AS z, i % 5 = 0 AS is_short, i % 7 = 0 AS is_bad,
 CASE WHEN i % 5 = 0 THEN 8.0 ELSE 20.0 + i % 20 END::DOUBLE AS distance_mm FROM (SELECT unnest(range(64)) AS i))"""


def regions(spark: SparkSession) -> DataFrame:
    return spark.range(64).select(F.explode(F.array(F.struct(F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("roi"), F.col("id").cast("int").alias("channel")), F.struct(F.lit("all").alias("roi"), F.col("id").cast("int").alias("channel")))).alias("r")).select("r.roi", "r.channel")


ROI = """roi AS (SELECT 'g' || (i % 3) AS roi, CAST(i AS INTEGER) AS channel FROM (SELECT unnest(range(64)) AS i) UNION ALL SELECT 'all', CAST(i AS INTEGER) FROM (SELECT unnest(range(64)) AS i))"""


def fd_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency-domain frames from lineitem: an order's line numbers are distances."""
    li = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("p"), F.min("l_discount").alias("d"), F.min("l_quantity").alias("q"))
    rho = 2.0 + 0.5 * F.col("l_linenumber")
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("channel"), rho.alias("rho"), (F.col("p") / 1000 * F.exp(-rho)).alias("ac"), (rho * 0.3 + F.col("d") * 0.713131717).alias("phase"), (F.col("q") * 37).alias("deg"))


FDS = """fds AS (SELECT l_orderkey AS frame, l_linenumber AS channel, 2.0::DOUBLE + 0.5::DOUBLE * l_linenumber AS rho, min(l_extendedprice) / 1000 * exp(-(2.0::DOUBLE + 0.5::DOUBLE * l_linenumber)) AS ac,
 (2.0::DOUBLE + 0.5::DOUBLE * l_linenumber) * 0.3::DOUBLE + min(l_discount) * 0.713131717::DOUBLE AS phase, min(l_quantity) * 37 AS deg FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def gates(spark: SparkSession, sf: str) -> DataFrame:
    """Time-gated counts from lineitem: an order's lines are gates."""
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("frame"), (F.col("l_linenumber") * 0.2).alias("delay"), F.lit(0.2).alias("width"), F.col("l_quantity").alias("v"))


GAT = """gat AS (SELECT l_orderkey AS frame, l_linenumber * 0.2::DOUBLE AS delay, 0.2::DOUBLE AS width, l_quantity AS v FROM lineitem)"""
