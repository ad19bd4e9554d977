"""Spectra, regressors, surrogates and the grouped estimators on signals of known answers."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.functions import spectra  # noqa: E402
from lucera.operators import inference  # noqa: E402

FS = 10.0
T = np.arange(600) / FS
RNG = np.random.default_rng(5)
NOISE = RNG.normal(size=(6, 600))


def test_wavelet_coherence():
    x = np.sin(2 * np.pi * 0.5 * T) + 0.1 * NOISE[0]
    f, c = spectra.wavelet_coherence(x, x, FS)
    assert np.nanmin(c) > 1 - 1e-9 and np.isnan(c[:, 0]).all()
    f, c = spectra.wavelet_coherence(x, np.sin(2 * np.pi * 0.5 * T + 1) + 0.1 * NOISE[1], FS)
    near = np.argmin(abs(f - 0.5))
    _, u = spectra.wavelet_coherence(NOISE[2], NOISE[3], FS)
    assert np.nanmean(c[near]) > 0.9 > 0.7 > np.nanmean(u)
    power = np.abs(spectra.morlet(x, FS, 1 / f)) ** 2
    assert abs(f[power[:, 300].argmax()] - 0.5) < 0.12


def test_effective_samples_and_distance():
    assert spectra.effective_samples(NOISE[0], NOISE[1], 20) > 400
    slow = np.convolve(NOISE[0], np.ones(20), "same")
    assert spectra.effective_samples(slow, slow) < 120
    c = np.corrcoef(NOISE[:4])
    assert spectra.geodesic_distance(c, c) < 1e-7 < spectra.geodesic_distance(c, np.eye(4))
    assert abs(spectra.geodesic_distance(np.eye(2), np.array([[1, 0.5], [0.5, 1]])) - np.hypot(np.log(1.25), np.log(0.75))) < 1e-12


def test_coupling():
    beat = np.sin(2 * np.pi * 1.1 * T)
    good, bad = spectra.scalp_coupling(beat + 0.1 * NOISE[0], beat + 0.1 * NOISE[1], FS), spectra.scalp_coupling(NOISE[0], NOISE[1], FS)
    assert np.median(good) > 0.9 > 0.5 > np.median(bad) and len(good) == 23
    assert np.median(spectra.peak_power(beat, beat, FS)) > 5 * np.median(spectra.peak_power(NOISE[0], NOISE[1], FS))
    assert np.isnan(spectra.scalp_coupling(np.ones(600), beat, FS)).all()


def test_smoothing_solves_its_normal_equations():
    for n in (3, 4, 5, 30):
        y = NOISE[0][:n]
        d = np.diff(np.eye(n), 2, axis=0)
        assert np.allclose(spectra.smooth(y, 7.0), np.linalg.solve(np.eye(n) + 7.0 * d.T @ d, y))


def test_spline_trend_and_levels():
    t = np.arange(40.0)
    y = 0.01 * t**3 - t + NOISE[0][:40]
    cubic = np.polyval(np.polyfit(t, y, 3), t)
    assert np.allclose(spectra.trend(y), cubic)  # by default a cubic leaves less than the variance
    close = spectra.trend(y, 5.0)
    assert abs(((y - close) ** 2).sum() - 5.0) < 1e-3
    # a run of three samples or fewer stays, a longer one goes to the level before it
    x = np.zeros(200)
    x[100:130] = np.linspace(0, 8, 30)
    x[130:] = 8.0
    mask = spectra.motion_mask(x, 5, 0.9)
    got = spectra.spline_correction(x, 2.0, k=5, recenter=False)
    assert mask.sum() > 3 and np.allclose(got[:95], 0) and abs(got[-1]) < 0.5 < x[-1]


def test_peak_power_of_one_tone():
    # two unit tones on a bin correlate as a cosine of amplitude 1, whose one-sided power is a half
    x = np.sin(2 * np.pi * 1.2 * np.arange(400) / 10)
    assert np.allclose(spectra.peak_power(x, x, 10.0)[2:-2], 0.5, atol=0.01)
    assert len(spectra.scalp_coupling(x, x, 10.0)) == (400 - 50) // 25 + 1


def test_spline_correction_removes_a_step():
    # under a tenth of a step of one sample stays, which no smooth curve follows
    for move in (np.where(T > 30, 4.0, 0.0), 4 / (1 + np.exp(-(T - 30) / 0.2))):
        x = 0.05 * NOISE[0] + move
        y = spectra.spline_correction(x, FS)
        assert abs(y[:250].mean() - y[350:].mean()) < 0.4 and abs(y.mean()) < 1e-9


def test_regressors():
    r = spectra.task_regressor([10.0], [0.0], 600, FS)
    assert not r[:100].any() and abs(T[r.argmax()] - 15) < 0.3
    assert spectra.task_regressor([10.0, 55.0], [5.0, 30.0], 600, FS).max() > 5 * r.max()
    f = spectra.fir_regressors([1.0, 59.5], 600, FS, 2.0)
    assert f.shape == (600, 20) and f[10, 0] == f[11, 1] == f[599, 4] == 1 and f.sum() == 25
    wave = np.sin(2 * np.pi * 0.1 * T)
    assert spectra.drift_overlap(wave, wave[:, None]) > 1 - 1e-12
    pool = np.stack([wave + 0.01 * n for n in NOISE], 1)
    c = spectra.nuisance_components(pool, 0.8)
    assert c.shape[1] == 1 and abs(np.corrcoef(c[:, 0], wave)[0, 1]) > 0.99 and spectra.nuisance_components(pool, 3).shape[1] == 3


def samples(spark, rows):
    data = [("r", c, i, i / FS, None if np.isnan(v) else float(v)) for c, y in rows.items() for i, v in enumerate(y)]
    return spark.createDataFrame(data, "recording string, channel int, frame long, t double, v double")


def test_pairwise(spark):
    wave = np.sin(2 * np.pi * 0.5 * T)
    gap = wave.copy()
    gap[5] = np.nan
    s = samples(spark, {0: wave + NOISE[0], 1: wave + NOISE[1], 2: gap})
    for method, kw in (("pearson", {}), ("coherence", {"low": 0.3, "high": 0.7}), ("wavelet_coherence", {"low": 0.3, "high": 0.7}), ("n_eff", {})):
        got = {(r["ch_i"], r["ch_j"]): r["value"] for r in inference.pairwise(s, method, FS, **kw).collect()}
        assert set(got) == {(0, 1), (0, 2), (1, 2)} and got[0, 2] is None and got[0, 1] > 0.2
    # shared broad-band noise stands out of its surrogates, independent noise does not
    shared = samples(spark, {0: NOISE[4] + NOISE[0], 1: NOISE[4] + NOISE[1], 2: NOISE[2]})
    z = {(r["ch_i"], r["ch_j"]): r["value"] for r in inference.pairwise(shared, "pearson", FS, surrogates=40).collect()}
    assert z[0, 1] > 6 and abs(z[0, 2]) < 4
    assert inference.pairwise(s, "pearson", FS, other=s).count() == 9
    fc = inference.pairwise(s.filter("channel < 2"), "pearson", FS)
    assert inference.geodesic_distance(fc, fc).first()["distance"] < 1e-7


def test_network_metrics(spark):
    e = spark.createDataFrame([("r", 0, k) for k in (1, 2, 3, 4)], "recording string, ch_i int, ch_j int")
    g, n = inference.network_metrics(e, [0, 1, 2, 3, 4])
    assert {r["metric"]: r["value"] for r in g.collect()} == {"density": 0.4, "clustering": 0.0, "efficiency": 0.7, "path_length": 1.6}
    assert n.filter("node = 0 AND metric = 'betweenness'").first()["value"] == 1.0 and n.count() == 20


def test_shift_null_and_nuisance(spark):
    task = spectra.task_regressor([5.0, 25.0, 40.0], [3.0] * 3, 600, FS)
    s = samples(spark, {0: task + 0.3 * NOISE[0], 1: NOISE[1]})
    null = {r["perm"]: r["max_t"] for r in inference.circular_shift_null(s, task, np.ones((600, 1)), FS, 50, 5.0).collect()}
    assert len(null) == 51 and all(null[0] >= v for v in null.values())
    design = pd.DataFrame({"one": 1.0, "task": task}, index=range(600))
    left = inference.regress_nuisance(s, design, robust=False).filter("channel = 0").toPandas().sort_values("frame")["v"]
    assert abs(np.corrcoef(left, task)[0, 1]) < 1e-9


def test_clusters(spark):
    edges = pd.DataFrame({"a": range(9), "b": range(1, 10)})
    obs = [0, 9, 9, 0, 0, -5, 0, 0, 0, 0]
    s = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(obs)], "contrast string, node long, t double")
    null = spark.createDataFrame([("c", p, i, float(NOISE[p % 6, p * 10 + i])) for p in range(19) for i in range(10)], "contrast string, perm int, node long, t double")
    got = [tuple(r) for r in inference.clusters(s, edges, ["contrast"], 3.0, null).orderBy("cluster").collect()]
    assert got[0] == ("c", 1, 1, 2, 12.0, 9.0, 1, 0.05) and got[1][:7] == ("c", 2, -1, 1, 2.0, -5.0, 5)
    assert inference.clusters(s, edges, ["contrast"], 3.0).count() == 2
