"""Stages on documents whose extra columns are named like what the operators add."""

import corpus_pipeline
import pytest
from helpers import SCHEMA, filler, odd_rows
from lucera.llm import common

NAMES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept host_rate host_docs _host size source_size weight target taken position copy _order _no _m _row _d _t _id _h _k k "
    "h1 h2 rep root class_id kept_text runs segments a n c words owner page_id"
).split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_extra_columns_stay(spark, name):
    rows = [(r[0], r[1], r[2], r[3], 7, "h") for r in odd_rows()] + [(100 + k, filler(70, 50 + k), "en", f"s{k % 3}", 7, "h") for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = docs.selectExpr("*", *[f"doc_id * {i + 2} AS {n}" for i, n in enumerate(NAMES)])
    stage = dict(corpus_pipeline.STAGES)[name]
    plain = sorted(map(str, stage(spark, docs, "").collect()))
    got = stage(spark, wide, "")
    assert got.columns == wide.columns
    out = got.collect()
    assert all(r[n] == (None if r["doc_id"] is None else r["doc_id"] * (i + 2)) for r in out for i, n in enumerate(NAMES))
    assert sorted(str(r) for r in got.select(*docs.columns).collect()) == plain


def test_pipeline_leaves_only_its_last_tables(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    assert corpus_pipeline.run(spark, odd).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["pipeline-mixing"]
