"""Registries, regions by rule, uncertainties, lattices, datasets and pipelines that queries with SQL do not reach."""

import json

import numpy as np
import pandas as pd
import pytest
from lucera.functions import registries, time_domain
from lucera.operators import geometry, results, rois, td_fits
from lucera.operators.study import Study, check_fc_postprocess
from lucera.sources import bids
from pyspark.sql import functions as F


def test_registries():
    assert registries.DISTANCES.get("frobenius")(np.eye(2), np.zeros((2, 2))) == pytest.approx(np.sqrt(2))
    with pytest.raises(KeyError, match="did you mean geodesic"):
        registries.DISTANCES.get("geodesc")
    registries.register_geometry("slab", "fd")(lambda rho, *a, **kw: rho)
    assert registries.resolve_geometry("slab", "fd")(3.0) == 3.0 and registries.resolve_geometry(abs, "td") is abs
    with pytest.raises(ValueError, match="low, high"):
        registries.bias_correction("phase_randomization", "coherence")
    assert registries.bias_correction("phase_randomization", "coherence", low=0.1, high=1.0) is not None
    x = np.sin(np.arange(300) / 3)
    assert registries.CROSS_MEASURES.get("pearson")(x, x, 10.0) == pytest.approx(1.0)
    assert registries.OBSERVATIONS.resolve("siegert")(np.array([0.5]), 0.4)[0] == pytest.approx(1.1)
    assert registries.RESIDUALS.resolve(lambda d, m: d)(1, 2) == 1
    assert abs(registries.GEOMETRIES.get(("semi_infinite", "fd"))(2.0, 0.1, 10.0, 1.4, freq=1.1e8)) > 0
    assert registries.RESPONSES.get("emg")(np.arange(50.0), 10.0, 2.0, 3.0).sum() == pytest.approx(1.0)


def montage(spark):
    rows = [(c, c // 4, c % 4, 100.0 * (c // 4) + c % 4, 0.0, 0.0, 10.0 + c, c < 3) for c in range(12)]
    return spark.createDataFrame(rows, "channel int, source int, detector int, x double, y double, z double, distance_mm double, is_short boolean")


def test_regions_by_clustering(spark):
    got = {r["channel"]: r["roi"] for r in rois.by_clustering(montage(spark), 3).collect()}
    assert got == {c: f"cluster_{c // 4 + 1}" for c in range(12)}
    named = {r["roi"] for r in rois.by_clustering(montage(spark), 2, ["p", "q"]).collect()}
    assert named == {"p", "q"}


def test_montages_and_lattices(spark):
    m = geometry.from_distances(spark, [8.0, 30.0], 15.0).orderBy("channel").collect()
    assert [(r["label"], r["x"], r["is_short"]) for r in m] == [("S1D1", 4.0, True), ("S1D2", 15.0, False)]
    r = np.random.default_rng(0)
    p = r.normal(size=(50, 2))
    pts = spark.createDataFrame([(float(a), float(b), float(2 + 0.5 * a)) for a, b in p], "x double, y double, z double")
    centre, normal = geometry.boundary_plane(pts)
    assert np.allclose(normal, np.array([-0.5, 0, 1]) / np.sqrt(1.25)) and abs(geometry.depth_below(pts, centre, normal).agg(F.max(F.abs("depth_mm"))).first()[0]) < 1e-9
    shell = geometry.ellipsoid(spark, 2.0, 3.0, 4.0).withColumn("one", (F.col("x") / 2) ** 2 + (F.col("y") / 3) ** 2 + (F.col("z") / 4) ** 2)
    assert shell.count() == 24 * 48 and shell.filter("abs(one - 1) > 1e-9").count() == 0


def test_uncertainties(spark):
    sim = td_fits.simulate_td(spark, 6, [2.0], np.arange(1, 41) * 1e-10, 1e-10, 0.1, 9.0, counts=1e5, seed=3)
    fit = td_fits.td_to_properties(sim, ["frame", "channel"])
    rows = fit.toPandas()
    mua = rows[rows["param"] == "mua"]
    assert (mua["sigma"] > 0).all() and (abs(mua["value"] - 0.1) < 5 * mua["sigma"]).all()
    cov = td_fits.td_to_properties(sim.filter("frame = 0"), ["frame", "channel"], covariance=True).toPandas().set_index(["param", "param_2"])["cov"]
    sigma = rows[(rows["frame"] == 0) & (rows["param"] == "mua")]["sigma"].iloc[0]
    assert cov["mua", "mua"] == pytest.approx(sigma**2) and cov["mua", "musp"] == pytest.approx(cov["musp", "mua"])
    assert td_fits.uncertainty_of(fit, "musp", ["frame"]).count() == 6
    again = td_fits.simulate_td(spark, 6, [2.0], np.arange(1, 41) * 1e-10, 1e-10, 0.1, 9.0, counts=1e5, seed=3)
    assert sorted(map(tuple, sim.collect())) == sorted(map(tuple, again.collect()))
    ext = {690.0: (276.0, 2051.96), 830.0: (974.0, 693.04)}
    c = spark.createDataFrame([(1, "hbo", "hbo", 4.0), (1, "hbr", "hbr", 9.0), (1, "hbo", "hbr", -1.0), (1, "hbr", "hbo", -1.0), (1, "a", "a", 5.0)], "frame int, param string, param_2 string, cov double")
    got = {r["wavelength"]: r["mua_sigma"] for r in td_fits.composition_variance(c, ["frame"], ext).collect()}
    e = np.array(ext[690.0]) * 1e-6
    assert got[690.0] == pytest.approx(np.sqrt(e @ np.array([[4, -1], [-1, 9]]) @ e))


def test_spectral_time_domain(spark):
    ext = {690.0: (276.0, 2051.96), 830.0: (974.0, 693.04)}
    delays, rows = np.arange(1, 41) * 1e-10, []
    for w in ext:
        mua, musp = time_domain.composed(w, ext, 60.0, 30.0, 10.0, 1.0)
        v = 1e6 * time_domain.gate_model(delays, np.full(40, 1e-10), 2.0, mua, musp, 1.4)
        rows += [(0, w, 2.0, float(d), 1e-10, float(y)) for d, y in zip(delays, v, strict=True)]
    td = spark.createDataFrame(rows, "frame int, wavelength double, rho double, delay double, width double, v double")
    got = {r["param"]: r["value"] for r in td_fits.td_to_concentration(td, ["frame"], ext).collect()}
    assert got["hbo"] == pytest.approx(60, rel=0.02) and got["hbr"] == pytest.approx(30, rel=0.02)
    flow = td_fits.simulate_dcs(spark, 2, [2.5], np.geomspace(1e-7, 1e-2, 20), 0.1, 10.0, 1e-8)
    assert flow.count() == 40 and flow.agg(F.max("g2")).first()[0] <= 1.5 + 1e-9


def test_pipelines_and_checks(spark):
    meta = spark.createDataFrame([(0, 0)], "recording int, subject int")
    s = spark.createDataFrame([(0, 0, f, f / 10, float(f)) for f in range(20)], "recording int, channel int, frame long, t double, v double")
    study = Study(spark, meta, {"raw": s})
    with pytest.raises(KeyError, match="did you mean detrend"):
        study.preprocess("raw", [("detrendd", {})])
    with pytest.raises(KeyError, match="there are raw"):
        study.get_stream("other")
    with pytest.raises(ValueError):
        check_fc_postprocess({"axis": "freq"}, None)
    flat = study.preprocess("raw", [("detrend", {})], "flat")
    assert flat.get_stream("flat").agg(F.max(F.abs(F.col("v") - 9.5))).first()[0] < 1e-9 and study.unload_stream("raw") is study
    fit = study.run_glm("raw", pd.DataFrame({"one": np.ones(20), "slope": np.arange(20.0)}), method="ols")
    assert {r["regressor"]: round(r["beta"], 6) for r in fit.collect()} == {"one": 0.0, "slope": 1.0}


def test_datasets(spark, tmp_path):
    meta = spark.createDataFrame([(1, "a", None, "rest", "1", 3), (2, "a", None, "rest", "2", 3), (3, "b c", "x", "rest", "1", 4)], "recording int, subject string, session string, task string, run string, age int")
    s = spark.createDataFrame([(r, 1, 1, w, f, f / 10, float(r + f)) for r in (1, 2, 3) for w in (690.0, 830.0) for f in range(4)], "recording int, source int, detector int, wavelength double, frame long, t double, v double")
    ev = spark.createDataFrame([(1, 0.1, 0.2, 1.0, "tap")], "recording int, onset double, duration double, value double, label string")
    places = pd.DataFrame([("source", 1, 0.0, 0.0, 0.0), ("detector", 1, 30.0, 0.0, 0.0)], columns=["kind", "idx", "x", "y", "z"])
    out = bids.write_dataset(spark, str(tmp_path / "d"), meta, s, places, ev, 10.0, "test", ["me"], "CC0").collect()
    assert {r["name"] for r in out} == {"sub-a_task-rest_run-1_nirs", "sub-a_task-rest_run-2_nirs", "sub-bC_ses-x_task-rest_run-1_nirs"}
    base = tmp_path / "d" / "sub-bC" / "ses-x" / "nirs"
    assert sorted(p.name.split("run-1_")[1] for p in base.iterdir() if not p.name.startswith(".")) == ["channels.tsv", "coordsystem.json", "events.tsv", "nirs.json", "nirs.snirf", "optodes.tsv"]
    side = json.loads((base / "sub-bC_ses-x_task-rest_run-1_nirs.json").read_text())
    assert (side["SamplingFrequency"], side["NIRSChannelCount"], side["TaskName"]) == (10.0, 2, "rest")
    assert (tmp_path / "d" / "participants.tsv").read_text().splitlines()[1:] == ["sub-a\t2\t3", "sub-bC\t1\t4"]
    assert json.loads((tmp_path / "d" / "dataset_description.json").read_text())["License"] == "CC0"
    study = bids.load_dataset(spark, str(tmp_path / "d"), {"subject": "a"})
    assert study.get_stream("optical").groupBy("recording").count().count() == 2 and study.events.count() == 1
    assert {r["age"] for r in study.meta.collect()} == {"3"}
    with pytest.raises(ValueError, match="two recordings"):
        bids.write_dataset(spark, str(tmp_path / "e"), meta.withColumn("run", F.lit("1")), s, places, ev, 10.0)


def test_custom_models(spark):
    rows = [(g, float(x), (1 + g) * np.exp(-x / 2.0)) for g in range(3) for x in np.linspace(0, 6, 30)]
    df = spark.createDataFrame([(g, x, float(y)) for g, x, y in rows], "grp int, x double, y double")
    model = lambda d, a, tau: a * np.exp(-d["x"] / tau)
    got = td_fits.custom_fit(df, ["grp"], model, "y", {"a": (0.1, 10.0), "tau": (0.2, 10.0)}, order="x").collect()
    assert all(r["value"] == pytest.approx({"a": 1 + r["grp"], "tau": 2.0}[r["param"]], rel=1e-4) for r in got) and len(got) == 6
    half = np.array([0.5, 0.5])
    seen = spark.createDataFrame([(0, float(x), float(y)) for x, y in zip(np.arange(30.0), np.convolve(3 * np.exp(-np.arange(30) / 4), half)[:30], strict=True)], "grp int, x double, y double")
    got = {r["param"]: r["value"] for r in td_fits.custom_fit(seen, ["grp"], model, "y", {"a": (0.1, 10.0), "tau": (0.2, 10.0)}, residual=lambda d, m: d - m, response=half, order="x").collect()}
    assert got["a"] == pytest.approx(3, rel=1e-4) and got["tau"] == pytest.approx(4, rel=1e-4)


def test_resolution(spark):
    from lucera.operators import imaging

    r = np.random.default_rng(5)
    j = r.normal(size=(4, 9))
    sens = spark.createDataFrame([(c, v, float(j[c, v])) for c in range(4) for v in range(9)], "channel int, voxel long, value double")
    got = imaging.resolution(sens, 0.1).toPandas().sort_values("voxel")["resolution"]
    g = j @ j.T
    assert np.allclose(got, np.diag(j.T @ np.linalg.inv(g + 0.1 * g.diagonal().max() * np.eye(4)) @ j))
    assert imaging.sensitivity_matrix(sens, [0, 1, 2, 3]).count() == 9


def test_more_readers(spark, tmp_path):
    import gzip
    import struct

    from lucera.sources import readers

    (tmp_path / "a.hdr").write_text('Sources=2\nS-D-Mask="#\n1\t0\t1\n0\t1\t0\n#"\n')
    assert sorted((r["source"], r["detector"]) for r in readers.nirx_mask(spark, str(tmp_path / "a.hdr")).collect()) == [(1, 1), (1, 3), (2, 2)]
    ch = spark.createDataFrame([(1, 1), (1, 8), (2, 8)], "source int, detector int")
    assert sorted((r["source"], r["detector"], r["is_short"]) for r in readers.remap_short_detectors(ch, 8).collect()) == [(1, 1, False), (1, 8, True), (2, 9, True)]
    frames = spark.createDataFrame([("r", f, f / 10) for f in range(5)], "recording string, frame long, t double")
    stim = readers.stim_samples(spark.createDataFrame([("r", 2, 7), ("r", 3, 7)], "recording string, frame long, marker int"), frames)
    assert [r["v"] for r in stim.orderBy("frame").collect()] == [0, 0, 1, 1, 0] and stim.first()["condition"] == "marker_7"
    (tmp_path / "e.csv").write_text("lambda,hbo,hbr,water_mua\nnm,cm-1/M,cm-1/M,cm-1\n650,368,3750.12,\n700,290,1794.28,0.006\n")
    assert [tuple(r) for r in readers.extinction_csv(spark, str(tmp_path / "e.csv")).orderBy("lambda").collect()] == [(650, 368, 3750.12, None), (700, 290, 1794.28, 0.006)]
    vol = np.zeros((3, 4, 2), "<i2")
    vol[1, 2, 0], vol[2, 3, 1] = 5, -7
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 3, 4, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<f", head, 108, 352.0)
    (tmp_path / "v.nii.gz").write_bytes(gzip.compress(bytes(head) + vol.tobytes(order="F")))
    assert sorted((r["i"], r["j"], r["k"], r["label"]) for r in readers.nifti(spark, str(tmp_path / "v.nii.gz")).collect()) == [(1, 2, 0, 5), (2, 3, 1, -7)]


def test_distances_by_name(spark):
    from lucera.operators import inference

    fc = spark.createDataFrame([("r", 0, 1, 0.5)], "recording string, ch_i int, ch_j int, value double")
    other = fc.withColumn("value", F.lit(0.2))
    assert inference.distance(fc, other, "frobenius").first()["distance"] == pytest.approx(0.3 * np.sqrt(2))
    assert inference.distance(fc, other, lambda a, b: 1.5).first()["distance"] == 1.5


def test_summaries(spark, tmp_path):
    results.save_summary(spark.createDataFrame([(1, 0.5)], "channel int, value double"), str(tmp_path / "q"), {"threshold": "0.7"})
    assert spark.read.csv(str(tmp_path / "q" / "summary"), header=True).first()["value"] == "0.5"
    assert spark.read.text(str(tmp_path / "q" / "notes")).first()[0] == "# threshold: 0.7"


def test_stim_of_a_recording_without_a_marker(spark):
    from lucera.sources import readers

    frames = spark.createDataFrame([(r, f, f / 10) for r in ("a", "b") for f in range(2)], "recording string, frame long, t double")
    marks = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 0, 0)], "recording string, frame long, marker int")
    got = {(r["recording"], r["condition"], r["frame"]): r["v"] for r in readers.stim_samples(marks, frames, [0, 1]).collect()}
    assert len(got) == 8 and [got["b", c, f] for c in ("marker_0", "marker_1") for f in (0, 1)] == [1, 0, 0, 0]


def lattice_of_one_number(spark):
    """Two voxels whose numbers are equal, as those of cells past 9999 are."""
    return spark.createDataFrame([(0, 0, 10000, 10000, 0.0, 0.0, 40000.0, 1), (0, 1, 0, 10000, 0.0, 4.0, 0.0, 2)], "i int, j int, k int, voxel int, x double, y double, z double, label int")


def test_surface_voxels_by_place(spark):
    from lucera.operators import geometry

    vertices = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 3.0, 1.0)], "x double, y double, z double")
    assert [r["j"] for r in geometry.restrict_to_surface(lattice_of_one_number(spark), vertices, 6.0).collect()] == [1]


def test_restricted_voxels_by_cell(spark):
    from lucera.operators import geometry

    v = lattice_of_one_number(spark)
    assert [r["label"] for r in geometry.restrict(v, v.filter("label = 2")).collect()] == [2]
    assert geometry.restrict(v.drop("i", "j", "k"), v.filter("label = 2")).count() == 2
