"""Sign flips: exhaustive in small groups, random above n_perm, always over all subjects."""

import duckdb
import numpy as np
import pytest
from lucera.operators import group
from lucera.plans import adapters, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def t_of(x):
    return np.mean(x) / (np.std(x, ddof=1) / np.sqrt(len(x)))


def test_patterns(spark):
    rng = np.random.default_rng(3)
    beta = {"few": rng.normal(1, 1, 4), "many": rng.normal(1, 1, 40), None: rng.normal(1, 1, 12)}
    rows = [(g, i, float(b)) for g, x in beta.items() for i, b in enumerate(x)]
    got = {(r["grp"], r["flip"]): r["t_stat"] for r in group.sign_flip_t(spark.createDataFrame(rows, "grp string, subject int, beta double"), ["grp"], 100, 7).collect()}
    minus = spark.range(1, 100).crossJoin(spark.range(40).select(F.col("id").cast("int").alias("subject")))
    minus = {(r[0], r[1]): r[2] for r in minus.select("id", "subject", F.getbit(F.xxhash64(F.lit(7), "id", "subject"), F.lit(0))).collect()}
    expect = {("few", f): t_of([b * (1 - 2 * (f >> i & 1)) for i, b in enumerate(beta["few"])]) for f in range(16)}
    for g in ("many", None):
        expect |= {(g, f): t_of([b * (1 - 2 * minus.get((f, i), 0)) for i, b in enumerate(beta[g])]) for f in range(100)}
    assert got.keys() == expect.keys()
    assert all(got[k] == pytest.approx(expect[k], rel=1e-9) for k in expect)
    assert 0.45 < np.mean(list(minus.values())) < 0.55 and len({t for (g, _), t in got.items() if g == "many"}) == 100


def test_query_has_all_subjects(spark):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    truth = dict(con.sql(f"WITH {adapters.SUB} SELECT grp, avg(beta - 140) / (stddev_samp(beta - 140) / sqrt(count(*))) FROM sub GROUP BY grp").fetchall())
    got = queries.QUERIES["sign_flip_null"](spark, SF).collect()
    seen = {r["grp"]: r["t_stat"] for r in got if r["flip"] == 0}
    assert seen.keys() == truth.keys() and all(seen[g] == pytest.approx(truth[g], abs=2e-6) for g in truth)
    assert len(got) == 1000 * len(truth)
