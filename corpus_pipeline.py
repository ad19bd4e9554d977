"""Corpus pipeline: quality rules, near duplicates, repeated passages, mixing, token ids.

Each stage works on what its predecessor kept, written as Parquet; tables that a stage wrote for
itself, and the predecessor's output, are deleted once its own output is written.

Defined results: empty tables pass through; null texts go in the first stage (they have no words);
null or repeated doc_ids and sources, ties and repeated rows are treated as each operator states;
columns beyond those of documents stay as they are up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lucera.llm import bpe, jaccard_join, mixing, quality_rules, substring_dedup
from lucera.llm.common import Work, scratch, table

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("substring_dedup", substring_dedup.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: Near duplicates and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scratch() as made:
            docs = work.save(stage(spark, docs, sf_dir), name)
        for used in made:
            used.drop(*used.paths)
        if k:
            work.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
