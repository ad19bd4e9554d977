"""Queries of operators that SQL cannot express: filters, spectra, iterative fits, graphs, nulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lucera.functions import signal, spectra
from lucera.operators import imaging, inference, series, smoothness
from lucera.plans import adapters as ad

QUERIES: dict = {}
FS = 10.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def _samples(spark, sf):
    return ad.embedding_samples(spark, sf).drop("label")


def _design(spark, sf) -> pd.DataFrame:
    """Constant, a task every 10 s and slow drift over the frames of one recording: bounded by it, not by the table."""
    n = ad.FRAMES
    task = spectra.task_regressor(np.arange(2.0, n / FS, 10.0), np.full(len(np.arange(2.0, n / FS, 10.0)), 4.0), n, FS)
    drift = signal.dct_drift_basis(n, FS, 0.04)
    return pd.DataFrame({"task": task, **{f"drift_{i}": drift[:, i] for i in range(drift.shape[1])}})


for _name, _run in {
    "frequency_filter": lambda s: series.frequency_filter(s, FS, 0.1, 2.0),
    "tddr": lambda s: series.tddr(s, FS),
    "spline_correct": lambda s: series.per_series(s, lambda x: spectra.spline_correction(x, FS)),
    "wavelet_correct": series.wavelet_correct,
    "resample": lambda s: series.resample(s, FS, 4.0),
    "estimate_hr": lambda s: series.heart_rate(s, FS),
    "fc_coherence": lambda s: inference.pairwise(s, "coherence", FS, low=0.5, high=2.0),
    "fc_wavelet_coherence": lambda s: inference.pairwise(s, "wavelet_coherence", FS, low=0.5, high=2.0),
    "fc_n_eff": lambda s: inference.pairwise(s, "n_eff", FS),
    "fc_bias_corrected": lambda s: inference.pairwise(s, "pearson", FS, surrogates=200),
    "fc_cross": lambda s: inference.pairwise(s.filter("channel < 4"), "wavelet_coherence", FS, other=s.filter("channel >= 4"), low=0.5, high=2.0),
    "sci": lambda s: inference.pairwise(s, "sci", FS),
    "psp": lambda s: inference.pairwise(s, "psp", FS),
}.items():
    QUERIES[_name] = lambda spark, sf, run=_run: run(_samples(spark, sf))


@query
def fc_distance(spark, sf):
    s = _samples(spark, sf)
    half = ad.FRAMES // 2
    return inference.geodesic_distance(inference.pairwise(s.filter(F.col("frame") < half), "pearson", FS), inference.pairwise(s.filter(F.col("frame") >= half), "pearson", FS))


@query
def network_metrics(spark, sf):
    fc = inference.pairwise(_samples(spark, sf), "pearson", FS)
    return inference.network_metrics(fc.filter("abs(value) > 0.02").select("recording", "ch_i", "ch_j"), list(range(64)), small_world_nulls=5)[0]


@query
def nodal_metrics(spark, sf):
    fc = inference.pairwise(_samples(spark, sf), "pearson", FS)
    return inference.network_metrics(fc.filter("abs(value) > 0.02").select("recording", "ch_i", "ch_j"), list(range(64)))[1]


@query
def glm_ar_irls(spark, sf):
    return series.glm(_samples(spark, sf), _design(spark, sf), "ar-irls", pmax=4)


@query
def circular_shift_null(spark, sf):
    d = _design(spark, sf)
    return inference.circular_shift_null(_samples(spark, sf), d["task"].to_numpy(), d.drop(columns="task").to_numpy(), FS, 200, 5.0)


@query
def regress_nuisance(spark, sf):
    return inference.regress_nuisance(_samples(spark, sf), _design(spark, sf).drop(columns="task"))


@query
def cluster_table(spark, sf):
    """Every position of a recording is a contrast, its frames a chain of nodes."""
    t = _samples(spark, sf).select("recording", F.col("channel").alias("contrast"), F.col("frame").alias("node"), (F.col("v") * 10).alias("t"))
    chain = pd.DataFrame({"a": range(ad.FRAMES - 1), "b": range(1, ad.FRAMES)})
    return inference.clusters(t, chain, ["recording", "contrast"], 1.0)


def _montage() -> pd.DataFrame:
    """An 8-wide lattice of 64 channels over the grid of voxels; a detector lies one step on in x and y."""
    at = [k * 3 / 7 for k in range(8)]
    return pd.DataFrame([(i, at[i % 8], at[i // 8], at[(i + 1) % 8], at[(i // 8 + 1) % 8]) for i in range(64)], columns=["channel", "sx", "sy", "dx", "dy"])


@query
def jacobian(spark, sf):
    return imaging.jacobian(imaging.voxel_grid(spark, (0, 0, 0.5), (3, 3, 2.5), 0.5), _montage(), 0.1, 10.0, 1.4, 0.125)


@query
def reconstruct(spark, sf):
    return imaging.reconstruct(jacobian(spark, sf), _samples(spark, sf))


@query
def simulate_fd(spark, sf):
    return imaging.simulate_fd(spark, [2.0, 2.5, 3.0], 100, 0.1, 10.0, level=0.01)


@query
def field_smoothness(spark, sf):
    """Embeddings as images over a lattice of 4 x 4 x 4 voxels."""
    cells = ad.read(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("p", "v"))
    at = {a: F.floor(F.col("p") / w).cast("int") % 4 for a, w in zip("ijk", (16, 4, 1), strict=True)}
    return smoothness.field_smoothness(cells.select("image", *[c.alias(a) for a, c in at.items()], F.col("v").cast("double").alias("v")), 9.0)
