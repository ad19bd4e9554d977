"""Measures of many series at once against those of one pair, and how recordings are spread."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucera.functions import networks, pairs, spectra
from lucera.operators import connectivity, inference
from lucera.plans import catalog

FS = 10.0
BAND = {"low": 0.5, "high": 2.0}
MANY = {"pearson": {}, "n_eff": {}, "coherence": BAND, "sci": {}, "psp": {}, "wavelet_coherence": BAND}


def series(n):
    x = np.random.default_rng(5).standard_normal((70, n))
    x[3], x[5, : n // 3], x[7] = 2.0, 1.0, x[8]
    return x


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("n", [250, 131])
@pytest.mark.parametrize("method", list(MANY))
def test_many_as_one(method, n):
    x, one, kw = series(n), inference.MEASURES[method], MANY[method]
    own, cross = pairs.values(x, None, one.many(FS, n, **kw)), pairs.values(x[:9], x[60:], one.many(FS, n, **kw))
    for i, j in [(0, 1), (3, 4), (5, 6), (7, 8), (0, 65), (8, 69), (66, 69)]:
        assert np.allclose(own[i, j], one(x[i], x[j], FS, **kw), atol=1e-12, equal_nan=True) and np.isnan(own[j, i])
    assert np.allclose(cross, own[:9, 60:], atol=1e-12, equal_nan=True)


@pytest.mark.filterwarnings("ignore")
def test_surrogates_of_many():
    x, one = series(131), inference.MEASURES["pearson"]
    got = pairs.values(x, None, pairs.bias_corrected(one.many(FS, 131), 131, 20, 4))
    for i, j in [(0, 1), (3, 4), (5, 66), (7, 8), (68, 69)]:
        assert np.allclose(got[i, j], spectra.bias_corrected(x[i], x[j], lambda u, v: one(u, v, FS), 20, 4), equal_nan=True)


def test_surrogates_are_made_once_a_series(monkeypatch):
    made, whole = [], pairs.signal.phase_randomized
    monkeypatch.setattr(pairs.signal, "phase_randomized", lambda x, rng: made.append(len(x)) or whole(x, rng))
    pairs.values(series(60)[:20], None, pairs.bias_corrected(pairs.pearson(FS, 60), 60, 3))
    assert sum(made) == 2 * 3 * 20  # not 190 pairs


def test_own_measures_and_odd_series(spark):
    rows = [("r", c, f, None if c == 2 and f == 1 else float((c + 1) * f * f % 7)) for c in range(4) for f in range(9 if c == 3 else 12)]
    s = spark.createDataFrame(rows, "recording string, channel int, frame long, v double")
    inference.register_measure("sum_of_test")(lambda x, y, fs: float(x.sum() + y[0]))
    for method in ("sum_of_test", "pearson"):
        got = {(r["ch_i"], r["ch_j"]): r["value"] for r in inference.pairwise(s, method, FS).collect()}
        assert len(got) == 6 and [k for k, v in got.items() if v is not None] == [(0, 1)]
    assert inference.pairwise(s.filter("channel = 0"), "pearson", FS).count() == 0
    assert inference.pairwise(s, "sum_of_test", FS, other=s).filter("value IS NOT NULL").count() == 5


def test_small_recordings_are_spread(spark):
    e = spark.createDataFrame([(r, 0, 1) for r in range(40)], "recording long, ch_i int, ch_j int")
    g = inference.network_metrics(e, [0, 1, 2])[0]
    assert g.rdd.getNumPartitions() == 4 and g.count() == 160


def plain_rewired(adj, rng, rounds=10):
    a = adj.copy()
    e = np.argwhere(np.triu(a))
    for _ in range(rounds * len(e)):
        i, j = rng.integers(len(e), size=2)
        (p, q), (r, s) = e[i], e[j] if rng.random() < 0.5 else e[j][::-1]
        if len({p, q, r, s}) < 4 or a[p, s] or a[r, q]:
            continue
        a[p, q] = a[q, p] = a[r, s] = a[s, r] = False
        a[p, s] = a[s, p] = a[r, q] = a[q, r] = True
        e[i], e[j] = (p, s), (r, q)
    return a


def test_rewired_draws_as_one_by_one():
    g = networks.model("random", 30, 120, np.random.default_rng(1))
    one, other = np.random.default_rng(2), np.random.default_rng(2)
    for _ in range(2):  # the generator is left where single draws leave it
        assert np.array_equal(networks.rewired(g, one), plain_rewired(g, other))
    assert one.random() == other.random() and isinstance(networks._draws(one, 120, 5), zip)


def test_pearson_moves_samples_once(spark):
    rows = [(r, c, f, (r + c) % 3, None if c == f else float(((c + 2) * f * f + r) % 11 + f / 7)) for r in range(3) for c in range(5) for f in range(8) if (c + f) % 7] + [(0, 1, 2, 1, 9.0), (None, 0, 0, 0, 1.0)]
    s = spark.createDataFrame(rows, "recording long, channel int, frame long, label int, v double")
    for by in (["recording"], ["recording", "label"]):
        got = connectivity.pearson(s, by)
        a, b = s.select(*by, "frame", F.col("channel").alias("ch_i"), F.col("v").alias("x")), s.select(*by, "frame", F.col("channel").alias("ch_j"), F.col("v").alias("y"))
        want = a.join(b, [*by, "frame"]).filter("ch_i < ch_j").groupBy(*by, "ch_i", "ch_j").agg(F.corr("x", "y").alias("value"), F.sum(F.expr("int(x IS NOT NULL AND y IS NOT NULL)")).alias("n"))
        key = lambda df: sorted((*(r[c] for c in (*by, "ch_i", "ch_j", "n")), None if r["value"] is None or np.isnan(r["value"]) else round(r["value"], 9)) for r in df.collect())
        assert str(key(got)) == str(key(want))
        assert connectivity.pearson(s, by)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_reduced_axis_moves_samples_and_results_only(spark):
    plan = catalog.QUERIES["fc_reduce"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


def test_reduced_axis_is_worked_out_a_group_at_a_time(spark):
    plan = catalog.QUERIES["fc_reduce"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "corr(" not in plan  # no table of a task's pairs
    assert re.search(r"hashpartitioning\(recording#\d+L, 4\), REPARTITION_BY_NUM", plan)  # all labels of a recording meet
    s = spark.range(2400).selectExpr("id % 6 AS recording", "int(id DIV 6 % 4) AS channel", "id DIV 24 AS frame", "int(id DIV 24 % 10) AS label", "double(id * id % 17) AS v")
    fc = connectivity.pearson(s, ["recording", "label"], within=["recording"]).withColumn("task", F.spark_partition_id())
    assert fc.count() == 6 * 10 * 6 and fc.select("recording", "task").distinct().count() == 6


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("cells", [1, 10**6])
def test_common_frames_as_one_pair(monkeypatch, cells):
    monkeypatch.setattr(pairs, "CELLS", cells)
    rng = np.random.default_rng(9)
    whole = [(f, c, 0.1 if c == 4 else rng.standard_normal() + 1e6) for f in range(30) for c in range(6)]
    odd = [(f, c, None if (f + c) % 5 == 0 else 0.1 if c == 0 and f > 9 else v) for f, c, v in whole if (c != 1 or f > 9) and (c != 2 or f < 10) and (c != 3 or f == 20)]
    odd += [(12, 1, 7.0), (12, 1, None), (12, 5, 8.0), (13, 5, 9.0), (13, 5, 9.5)]
    nan = [(f, c, np.nan if (f, c) == (3, 2) else np.inf if (f, c) == (0, 5) else v) for f, c, v in whole]
    for rows in (whole, odd, nan, odd + nan, whole[:6], whole[:1]):
        order = rng.permutation(len(rows))
        f, c, v = (np.array([rows[k][i] for k in order], float) for i in range(3))
        known = np.array([rows[k][2] is not None for k in order])
        met, n, value = pairs.common_frames(f.astype(int), c.astype(int), v, known)
        for i in range(len(met)):
            for j in range(i + 1, len(met)):
                both = [(a[2], b[2]) for a in rows if a[1] == i for b in rows if b[1] == j and a[0] == b[0]]
                x = np.array([p for p in both if None not in p], float).reshape(-1, 2)
                some = len(x) and np.isfinite(x).all() and (x != x[0]).any(0).all()
                assert met[i, j] == bool(both) and (n[i, j] == len(x) or not both)
                assert np.isclose(value[i, j], np.corrcoef(x.T)[0, 1], atol=1e-9) if some else np.isnan(value[i, j])


def test_pearson_of_text_channels(spark):
    rows = [("r", c, f, None if f == 5 else float(k * f % 7)) for k, c in enumerate(["b", "a", "é", "z"], 1) for f in range(9)]
    got = connectivity.pearson(spark.createDataFrame(rows, "recording string, channel string, frame long, v double"))
    assert dict(got.dtypes) == {"recording": "string", "ch_i": "string", "ch_j": "string", "value": "double", "n": "bigint"}
    x = {c: [v for _, d, _, v in rows if d == c and v is not None] for c in "baéz"}
    seen = {(r["ch_i"], r["ch_j"]): r["value"] for r in got.collect()}
    assert seen == pytest.approx({(i, j): np.corrcoef(x[i], x[j])[0, 1] for i in x for j in x if i < j})
