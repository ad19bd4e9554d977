"""Queries without SQL: every series, pair and map of the whole table against the kernels or plain numpy."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.functions import networks, signal, spectra  # noqa: E402
from lucera.plans import adapters, estimators, queries  # noqa: E402

SF, FS = "/root/testdata/sf0.001", 10.0
N = adapters.FRAMES


@pytest.fixture(scope="module")
def values():
    """(recordings, frames, channels)."""
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    return np.stack(e["embedding"]).astype(float).reshape(-1, N, 64)


@pytest.fixture(scope="module")
def narrow(tmp_path_factory):
    """The table with eight positions: every pair can be worked out again."""
    path = tmp_path_factory.mktemp("narrow")
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    e.assign(embedding=[v[:8] for v in e["embedding"]]).to_parquet(path / "embeddings.parquet")
    return str(path)


def frame(spark, name, path=SF):
    return estimators.QUERIES[name](spark, path).toPandas()


def design():
    task = spectra.task_regressor(np.arange(2.0, N / FS, 10.0), np.full(3, 4.0), N, FS)
    return task, signal.dct_drift_basis(N, FS, 0.04)


def cleaned(x):
    drift = design()[1]
    b = signal.robust_fit(drift, x)[0]
    return x - drift[:, 1:] @ b[1:]


SERIES = {
    "frequency_filter": lambda x: signal.frequency_filter(x, FS, 0.1, 2.0), "tddr": lambda x: signal.tddr(x, FS), "spline_correct": lambda x: spectra.spline_correction(x, FS),
    "wavelet_correct": signal.wavelet_correction, "resample": lambda x: signal.resample(x, 2, 5), "regress_nuisance": cleaned,
}


def test_names_are_apart():
    assert not set(estimators.QUERIES) & set(queries.QUERIES)


@pytest.mark.parametrize("name", list(SERIES))
def test_series(spark, values, name):
    got = frame(spark, name).sort_values(["recording", "channel", "frame"])["v"].to_numpy().reshape(len(values), 64, -1)
    want = np.array([[SERIES[name](r[:, c]) for c in range(64)] for r in values])
    assert got.shape == want.shape and np.allclose(got, want)


def test_heart_rate(spark, values):
    got = frame(spark, "estimate_hr").sort_values(["recording", "channel"])["bpm"].to_numpy().reshape(-1, 64)
    assert np.allclose(got, [[signal.heart_rate(r[:, c], FS) for c in range(64)] for r in values])


def in_band(f, c):
    return np.nanmean(c[(f >= 0.5) & (f <= 2.0)])


PAIRS = {
    "fc_coherence": lambda x, y: in_band(*signal.coherence(x, y, FS, 64)), "fc_wavelet_coherence": lambda x, y: in_band(*spectra.wavelet_coherence(x, y, FS)),
    "fc_bias_corrected": lambda x, y: spectra.bias_corrected(x, y, lambda u, v: np.corrcoef(u, v)[0, 1], 200, 0), "sci": lambda x, y: np.nanmedian(spectra.scalp_coupling(x, y, FS)),
    "psp": lambda x, y: np.nanmedian(spectra.peak_power(x, y, FS)), "fc_cross": lambda x, y: in_band(*spectra.wavelet_coherence(x, y, FS)),
}


@pytest.mark.parametrize("name", list(PAIRS))
def test_pairs(spark, values, narrow, name):
    got = frame(spark, name, narrow)
    pairs = {(r, i, j) for r in range(len(values)) for i in range(8) for j in range(8) if (i < 4 <= j if name == "fc_cross" else i < j)}
    assert {(r, i, j) for r, i, j in got[["recording", "ch_i", "ch_j"]].itertuples(index=False)} == pairs and len(got) == len(pairs)
    want = [PAIRS[name](values[r, :, i], values[r, :, j]) for r, i, j in got[["recording", "ch_i", "ch_j"]].itertuples(index=False)]
    assert np.allclose(got["value"].to_numpy(), want, atol=1e-9)


def test_all_positions_pair(spark):
    assert len(frame(spark, "fc_coherence")) == 2016 * 2


def test_distance(spark, values):
    got = frame(spark, "fc_distance").sort_values("recording")["distance"]
    want = [spectra.geodesic_distance(np.corrcoef(r[: N // 2].T), np.corrcoef(r[N // 2 :].T)) for r in values]
    assert np.allclose(got, want)


def graph(r):
    a = np.abs(np.corrcoef(r.T)) > 0.02
    np.fill_diagonal(a, False)
    return a


def test_networks(spark, values):
    whole, nodal = frame(spark, "network_metrics"), frame(spark, "nodal_metrics")
    for k, r in enumerate(values):
        a = graph(r)
        got = whole[whole["recording"] == k].set_index("metric")["value"]
        assert np.allclose(got[["density", "efficiency", "path_length", "clustering"]], [a.sum() / 64 / 63, networks.global_efficiency(a), networks.path_length(a), networks.clustering(a).mean()])
        per = nodal[nodal["recording"] == k].pivot(index="node", columns="metric", values="value")
        assert np.array_equal(per["degree"], a.sum(1)) and np.allclose(per["betweenness"], networks.betweenness(a))


def test_glm(spark, values):
    got = frame(spark, "glm_ar_irls").set_index(["recording", "channel", "regressor"])
    task, drift = design()
    x = np.column_stack([task, drift])
    assert len(got) == len(values) * 64 * x.shape[1]
    for r, c in ((0, 0), (1, 63), (0, 31)):
        b, cov, order = signal.ar_irls(values[r, :, c], x, 4)
        row = got.loc[(r, c, "task")]
        assert np.allclose([row["beta"], row["se"], row["ar_order"]], [b[0], np.sqrt(cov[0, 0]), order])


def test_shifts(spark, values):
    got = frame(spark, "circular_shift_null").set_index(["recording", "perm"])
    task, drift = design()
    assert len(got) == 201 * len(values)
    for perm in (0, 77):
        shift = int(got.loc[(1, perm), "shift"])
        want = max(abs(spectra.shift_t(values[1, :, c], task, drift, [shift])[0]) for c in range(64))
        assert abs(got.loc[(1, perm), "max_t"] - want) < 1e-9 and (shift == 0) == (perm == 0)


def test_reconstruction(spark, values):
    j = frame(spark, "jacobian").pivot(index="voxel", columns="channel", values="value").fillna(0.0)
    got = estimators.QUERIES["reconstruct"](spark, SF).filter("frame IN (0, 249)").toPandas()
    a = j.to_numpy().T
    gram = a @ a.T
    solve = a.T @ np.linalg.inv(gram + 0.01 * gram.diagonal().max() * np.eye(len(gram)))
    for r in range(len(values)):
        for f in (0, 249):
            one = got[(got["recording"] == r) & (got["frame"] == f)].set_index("voxel")["value"].reindex(j.index)
            assert np.allclose(one, solve @ values[r, f, :], rtol=1e-6, atol=1e-12)


def test_simulated(spark):
    got = frame(spark, "simulate_fd")
    assert len(got) == 300 and got.select_dtypes("number").notna().all().all()


def test_smoothness(spark):
    got = frame(spark, "field_smoothness")
    assert len(got) >= 1 and got.select_dtypes("number").notna().all().all()
