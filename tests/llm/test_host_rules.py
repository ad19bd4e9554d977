"""Host verdicts: a bad host's documents go, a small or average host's stay; the SQL agrees."""

import duckdb
import pytest
from helpers import SCHEMA, filler
from lucera.llm import quality_rules


def rows():
    out, k = [], 0
    for host, docs, bad in (("good", 120, 3), ("fair", 90, 4), ("bad", 80, 50), ("small", 2, 1), (None, 60, 1), ("third", 150, 6)):
        for i in range(docs):
            k += 1
            out.append((k, "too short" if i < bad else filler(60, k), "en", host, 7, "h"))
    return out


@pytest.fixture(scope="module")
def hosts(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("hosts")
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_a_bad_host_goes(spark, hosts):
    df = quality_rules.op2_quality_rules(spark, hosts)
    got = [r.asDict() for r in df.collect()]
    assert {r["source"] for r in got if r["kept"] == r["base_failed"] and not r["base_failed"]} == {"bad"}
    assert sum(r["kept"] for r in got) == sum(not r["base_failed"] and r["source"] != "bad" for r in got)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{hosts}/documents.parquet/*.parquet')")
    cols = ", ".join(sorted(df.columns))
    show = lambda x: sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in x)
    assert show(df.select(sorted(df.columns)).collect()) == show(con.sql(quality_rules.ORACLE).select(cols).fetchall())


def test_the_verdict_by_brute_force(spark, hosts):
    count = {}
    for _, text, _, host, _, _ in rows():
        n, f = count.get(host, (0, 0))
        count[host] = (n + 1, f + (text == "too short"))
    total, failed = (sum(x) for x in zip(*count.values(), strict=True))
    p = failed / total
    excess = sum(n * (f / n - p) ** 2 for n, f in count.values()) - (len(count) - 1) * p * (1 - p)
    between = excess / (total - sum(n * n for n, _ in count.values()) / total)
    k = max(2.0, min(1000.0, p * (1 - p) / between - 1))
    for r in quality_rules.op2_quality_rules(spark, hosts).select("source", "host_rate", "host_low", "host_bar").distinct().collect():
        n, f = count[r["source"]]
        m = (f + p * k) / (n + k)
        assert r["host_rate"] == pytest.approx(m, abs=1e-6)
        assert r["host_low"] == pytest.approx(m - 1.644854 * (m * (1 - m) / (n + k + 1)) ** 0.5, abs=1e-6)
        assert r["host_bar"] == pytest.approx(max(0.2, min(0.5, 3 * p)), abs=1e-6)


def test_stage_drops_the_host_and_keeps_every_column(spark, hosts):
    docs = spark.read.parquet(f"{hosts}/documents.parquet")
    names = ["n_words", "kept", "base_failed", "host_rate", "host_low", "_host", "_w", "_row", "size", "position", "copy"]
    wide = docs.selectExpr("*", *[f"-doc_id AS {n}" for n in names])
    got = quality_rules.stage(spark, wide, "")
    assert got.columns == wide.columns
    out = got.collect()
    assert {r["source"] for r in out} == {"good", "fair", "small", None, "third"}
    assert all(r[n] == -r["doc_id"] for r in out for n in names)
