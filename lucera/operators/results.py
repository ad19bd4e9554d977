"""Result tables kept with their attributes and history, and shown as tables of their parts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, attributes: dict | None = None, history: list[str] | None = None) -> None:
    """Parquet with a one-row table of attributes and history beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    about = [(json.dumps(attributes or {}, sort_keys=True, default=str), json.dumps(history or []))]
    df.sparkSession.createDataFrame(about, "attributes string, history string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict, list[str]]:
    about = spark.read.schema("attributes string, history string").json(f"{path}/about").first()
    return spark.read.parquet(f"{path}/data"), json.loads(about["attributes"]), json.loads(about["history"])


def save_all(tables: dict[str, DataFrame], folder: str, config: dict | None = None) -> None:
    """A folder a table, and the config beside them."""
    for name, df in tables.items():
        save(df, f"{folder}/{name}", {"name": name})
    if tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(json.dumps({"tables": sorted(tables), **(config or {})}, sort_keys=True, default=str),)], "config string").coalesce(1).write.mode("overwrite").json(f"{folder}/study_config")


def load_all(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict]:
    config = json.loads(spark.read.schema("config string").json(f"{folder}/study_config").first()["config"])
    return {n: load(spark, f"{folder}/{n}")[0] for n in config["tables"]}, config


def to_table(results: DataFrame, keys: list[str], statistics=("beta", "se", "t_stat", "p_val")) -> DataFrame:
    """Long (keys, statistic, value)."""
    have = [s for s in statistics if s in results.columns]
    return results.select(*keys, *[F.col(s).cast("double").alias(s) for s in have]).unpivot(keys, have, "statistic", "value")


def to_dataframe(parts: dict, level_names: tuple[str, ...], metadata: DataFrame | None = None, on: str = "recording") -> DataFrame:
    """Nested dicts of tables as one, a column a level of names; metadata joins by recording."""

    def walk(node, path):
        if isinstance(node, DataFrame):
            yield node.withColumns({n: F.lit(v) for n, v in zip(level_names, path, strict=True)})
        else:
            for k, v in node.items():
                yield from walk(v, (*path, k))

    whole = None
    for df in walk(parts, ()):
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    return whole if metadata is None else whole.join(metadata, on, "left")


def with_variance_p(results: DataFrame) -> DataFrame:
    """Adds the variance of beta."""
    return results.withColumn("var", F.col("se") ** 2)


def save_summary(summary: DataFrame, path: str, notes: dict[str, str] | None = None) -> None:
    """A quality summary as CSV; notes go to a text file beside it, a line each."""
    summary.coalesce(1).write.mode("overwrite").csv(f"{path}/summary", header=True)
    lines = [(f"# {k}: {v}",) for k, v in (notes or {}).items()]
    if lines:
        summary.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/notes")
