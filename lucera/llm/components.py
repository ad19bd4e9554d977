"""Connected components of an edge table, on written tables: label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.llm.common import Work


def connected(spark: SparkSession, edges: DataFrame, work: Work, tag: str = "cc") -> DataFrame:
    """(node, root) of every node of an edge (a, b); root is the component's least node.

    Alternates large-star and small-star steps, each a group-by on nodes, until the edges no
    longer change; every turn is written, so a lost executor costs a re-read. A hub's edges are
    only summed to a minimum and joined back, never gathered.

    Defined results: edges with a null end, and of a node to itself, count for nothing; repeated edges
    count once, in either direction; a table without edges gives an empty table.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = work.save(pairs, f"{tag}0")
    state, turn = None, 0
    while True:
        turn += 1
        # large star: larger neighbours of u move to the least of u and its neighbours
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        after = work.save(small.distinct(), f"{tag}{turn}")
        now = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        work.drop(f"{tag}{turn - 1}")
        pairs = after
        if state == (now["n"], now["x"]):
            break
        state = (now["n"], now["x"])
    star = pairs.groupBy("u").agg(F.min("v").alias("root"))
    return star.select(F.col("u").alias("node"), "root").unionByName(star.select(F.col("root").alias("node"), "root").distinct())
