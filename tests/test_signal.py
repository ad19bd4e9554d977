"""Numeric kernels, grouped functions, readers and streaming against plain expectations."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.functions import signal  # noqa: E402
from lucera.operators import series  # noqa: E402
from lucera.sources import readers  # noqa: E402
from lucera.streaming import blocks  # noqa: E402

T = np.arange(600) / 10


def test_butterworth_gain():
    for kind in ("low", "high"):
        for order in (1, 2, 3, 5):
            sos = signal.butter_sos(order, 1.0, 10.0, kind)
            z = np.exp(-2j * np.pi * np.array([0.0, 1.0, 4.999]) / 10)
            h = np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[4] * z + s[5] * z * z) for s in sos], axis=0)
            low, cut, high = np.abs(h)
            assert abs(cut - 1 / np.sqrt(2)) < 1e-9
            assert (low, high) == ((1, 0) if kind == "low" else (0, 1)) or np.allclose((low, high), (1, 0) if kind == "low" else (0, 1), atol=1e-2)


def test_zero_phase_filter_keeps_the_band():
    slow, fast = np.sin(2 * np.pi * 0.1 * T), np.sin(2 * np.pi * 3 * T)
    assert np.abs(signal.frequency_filter(slow + fast, 10, high=1.0) - slow)[50:-50].max() < 0.02
    assert np.abs(signal.frequency_filter(slow + fast + 5, 10, low=1.0) - fast)[50:-50].max() < 0.02


def test_tddr_removes_a_step():
    x = 0.1 * np.sin(2 * np.pi * 0.1 * T) + np.where(T > 30, 5.0, 0.0)
    y = signal.tddr(x, 10)
    assert abs(y[:250].mean() - y[350:].mean()) < 1.0 < abs(x[:250].mean() - x[350:].mean())


def test_wavelets_invert():
    assert all(np.allclose(d, 0) for d in signal.dwt(np.full(33, 2.0), 3)[1])
    for n in (64, 65, 77, 3, 5):
        x = np.random.default_rng(0).normal(size=n)
        a, d, s = signal.dwt(x, min(3, signal.dwt_depth(n) or 1))
        back = signal.idwt(a, d, s)
        assert np.allclose(back, x, atol=1e-9)


def test_resample_keeps_a_slow_wave():
    y = signal.resample(np.sin(2 * np.pi * 0.1 * T), 1, 2)
    assert len(y) == 300 and np.abs(y - np.sin(2 * np.pi * 0.1 * T[::2]))[20:-20].max() < 0.01


def test_heart_rate():
    assert abs(signal.heart_rate(np.sin(2 * np.pi * 1.2 * T) + 0.01 * T, 10) - 72) < 0.5


def test_t_tails():
    assert abs(signal.t_p_value(2.228138852, 10) - 0.05) < 1e-8
    assert abs(signal.t_p_value(-1.0, 1) - 0.5) < 1e-12 and signal.t_sf(0, 5) == 0.5


def test_ar_irls_finds_the_slope():
    r = np.random.default_rng(1)
    e = np.zeros(800)
    for i in range(1, 800):
        e[i] = 0.6 * e[i - 1] + 0.1 * r.normal()
    x = np.stack([np.ones(800), np.sin(np.arange(800) / 30)], 1)
    y = x @ [1.0, 2.0] + e
    b, cov, order = signal.ar_irls(y, x, 6)
    assert np.allclose(b, [1, 2], atol=0.1) and order >= 1 and (np.diag(cov) > 0).all()
    y[100] += 20
    assert np.allclose(signal.ar_irls(y, x, 6)[0], [1, 2], atol=0.1)


def test_ar_order_from_zero_up():
    r = np.random.default_rng(2)
    assert len(signal.ar_coefficients(r.normal(size=500), 8)) == 0
    e = np.zeros(4000)
    for i in range(2, 4000):
        e[i] = 0.5 * e[i - 1] - 0.3 * e[i - 2] + r.normal()
    c = signal.ar_coefficients(e + 7, 8)
    assert len(c) >= 2 and np.allclose(c[:2], [0.5, -0.3], atol=0.05)
    # by definition on a short series: lags of both directions, zero before the start, and a constant
    y = np.array([1.0, 2.0, 4.0, 3.0, 5.0, 7.0])
    x = np.array([[1, 0], [1, 1], [1, 2], [1, 4], [1, 3], [1, 5], [1, 0], [1, 7], [1, 5], [1, 3], [1, 4], [1, 2]], float)
    want = np.linalg.lstsq(x, np.concatenate([y, y[::-1]]), rcond=None)[0]
    flat = np.concatenate([y, y[::-1]])
    gain = 12 * np.log(flat.var()) - 12 * np.log(((flat - x @ want) ** 2).mean()) - np.log(12)
    assert signal.ar_coefficients(y, 1).tolist() == ([] if gain <= 0 else [want[1]])
    assert np.allclose(signal.whitened(np.array([3.0, 5.0, 4.0]), np.array([1.0, -0.5])), [1.5, 3.5, 1.5])


def test_robust_covariance_of_clean_data():
    r = np.random.default_rng(3)
    x = np.stack([np.ones(5000), r.normal(size=5000)], 1)
    y = x @ [1, 2] + r.normal(size=5000)
    b, _ = signal.robust_fit(x, y)
    cov = signal.robust_covariance(x, y - x @ b)
    # the bisquare at 4.685 has 95 % of the efficiency of least squares
    assert np.allclose(np.diag(cov), 1 / 0.95 / 5000, rtol=0.06)


def test_band_pass_gain():
    for order, low, high in ((3, 0.5, 2.5), (2, 1.0, 1.2), (3, 0.01, 4.9)):
        sos = signal.bandpass_sos(order, low, high, 10.0)
        assert len(sos) == order
        mid = np.arctan(np.sqrt(np.tan(np.pi * low / 10) * np.tan(np.pi * high / 10))) * 10 / np.pi
        z = np.exp(-2j * np.pi * np.array([0.0, low, mid, high, 5.0]) / 10)
        h = np.abs(np.prod([(s[0] + s[1] * z + s[2] * z * z) / (1 + s[4] * z + s[5] * z * z) for s in sos], axis=0))
        assert np.allclose(h, [0, 1 / np.sqrt(2), 1, 1 / np.sqrt(2), 0], atol=1e-6)


def test_wavelet_thresholds():
    r = np.random.default_rng(4)
    x = r.normal(size=200) + 5
    x[90] += 40
    y = signal.wavelet_correction(x)
    assert abs(y.mean()) < 1e-9 and abs(y[90]) < 10
    a, details, sizes = signal.dwt(x, signal.dwt_depth(200))
    assert signal.dwt_depth(200) == 6 and [len(d) for d in details] == [101, 52, 27, 15, 9, 6]
    z = [np.abs(d - np.median(d)) / (1.4826 * np.median(np.abs(d - np.median(d)))) for d in details]
    kept = [np.where(s <= 1.6448536269514722, d, 0) for s, d in zip(z, details, strict=True)]
    whole = signal.idwt(a, kept, sizes)
    assert np.allclose(y, whole - whole.mean())
    assert np.allclose(signal.wavelet_correction(x, alpha=0.0, recenter=False), x)


def samples(spark):
    rows = [("r", c, i, float(t), float(np.sin(2 * np.pi * (0.1 + 0.9 * c) * t))) for c in (0, 1) for i, t in enumerate(T)]
    return spark.createDataFrame(rows, "recording string, channel int, frame long, t double, v double")


def test_grouped_functions(spark):
    s = samples(spark)
    got = series.frequency_filter(s, 10.0, high=0.5).groupBy("channel").agg(F.stddev_pop("v").alias("s"))
    assert {r["channel"]: r["s"] > 0.5 for r in got.collect()} == {0: True, 1: False}
    assert series.tddr(s, 10.0).count() == series.wavelet_correct(s).count() == 1200
    assert series.resample(s, 10.0, 5.0).count() == 600
    assert {r["channel"]: round(r["bpm"]) for r in series.heart_rate(s, 10.0).collect()}[1] == 60
    assert series.coherence(s, 10.0, 0.5, 1.5).count() == 1
    design = pd.DataFrame({"one": np.ones(600), "wave": np.sin(2 * np.pi * 0.1 * T)})
    fit = {(r["channel"], r["regressor"]): r["beta"] for r in series.glm(s, design, "ols").collect()}
    assert abs(fit[0, "wave"] - 1) < 1e-9 and abs(fit[1, "wave"]) < 0.05
    p = series.with_p_values(spark.createDataFrame([(2.228138852, 10), (None, 3)], "t_stat double, df int")).collect()
    assert abs(p[0]["p_val"] - 0.05) < 1e-8 and p[1]["p_val"] is None


def test_readers(spark, tmp_path):
    (tmp_path / "sub-01_task-x_events.tsv").write_text("onset\tduration\ttrial_type\n1.5\t2\ttap\n0.5\tn/a\trest\n")
    got = readers.load(spark, str(tmp_path / "sub-01_task-x_events.tsv")).orderBy("onset").collect()
    assert [(r["onset"], r["duration"], r["label"]) for r in got] == [(0.5, None, "rest"), (1.5, 2.0, "tap")]
    (tmp_path / "scan.csv").write_text("frame_id,timestamp_s,bfi_l1,bfi_r1\n0,0.0,1.0,\n1,0.1,2.0,3.0\n")
    assert readers.load(spark, str(tmp_path / "scan.csv")).count() == 3
    (tmp_path / "dig.txt").write_text("s1: 1 2 3\nd2: 4 5 6\nsoma: 0 0 1\nbroken\n")
    assert {r["label"]: r["kind"] for r in readers.load(spark, str(tmp_path / "dig.txt")).collect()} == {"s1": "source", "d2": "detector", "soma": "landmark"}
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1 2/2 3/3\n")
    v, f = readers.obj_mesh(spark, str(tmp_path / "m.obj"))
    assert v.count() == 3 and tuple(f.first()) == (1, 2, 3)
    (tmp_path / "a.hdr").write_text('Sources=4\nDetectors=8\nSamplingRate=7.81\nWavelengths="760\t850"\nEvents="#\n1.0 2 10\n3.5 1 30\n#"\n')
    h = readers.load(spark, str(tmp_path / "a.hdr")).first()
    assert (h["sources"], h["detectors"], h["sampling_rate"], h["wavelengths"], len(h["events"])) == (4, 8, 7.81, [760.0, 850.0], 2)
    name = spark.createDataFrame([("sub-01_ses-b_task-rest_run-2_nirs.snirf", "my left-arm")], "f string, l string")
    assert tuple(name.select(*readers.entities(F.col("f"))).first()) == ("01", "b", "rest", None, "2")
    assert name.select(readers.sanitise_label(F.col("l"))).first()[0] == "myLeftArm"


def test_streaming_blocks_match_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "a", float(h * 60 + m)) for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, channel string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = blocks.block_average(stream).writeStream.format("memory").queryName("blocks").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("blocks").collect())) == sorted(map(tuple, blocks.block_average(df).collect()))
