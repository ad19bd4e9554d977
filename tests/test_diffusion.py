"""Diffusion models and fits on simulated data with known truth."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.functions import diffusion as d  # noqa: E402
from lucera.operators import fits  # noqa: E402

RHO = np.array([2.0, 2.5, 3.0])


def test_reflectance_is_zero_without_a_step_and_grows():
    assert abs(d.effective_reflectance(1.0)) < 1e-9
    assert 0.42 < d.effective_reflectance(1.33) < 0.45 < d.effective_reflectance(1.4) < 0.52
    assert np.isnan(d.effective_reflectance(1.0, 1.4))


def test_noiseless_fits_recover_the_truth():
    for mua, musp in ((0.10, 11.0), (0.12, 9.0)):
        got = d.fit_fd(RHO, d.fd_fluence(RHO, mua, musp, 1.4, 1.1e8), 1.4, 1.1e8)
        assert abs(got["mua"] - mua) < 1e-4 and abs(got["musp"] - musp) < 1e-2
    tau = np.geomspace(1e-7, 1e-2, 60)
    got = d.fit_dcs(tau, d.siegert(d.dcs_g1(2.5, 0.1, 10, 1.4, 785, tau, adb=1e-8), 0.5), 2.5, 0.1, 10, 1.4, 785)
    assert abs(got["adb"] - 1e-8) < 1e-11 and abs(got["beta"] - 0.5) < 1e-4


def test_time_domain_integral_is_the_steady_fluence():
    t = np.linspace(0, 2e-8, 20001)
    area = np.trapezoid(d.td_fluence(t, 2.0, 0.1, 10.0, 1.4), t)
    assert abs(area / d.fd_fluence(2.0, 0.1, 10.0, 1.4).real - 1) < 0.02


def test_grouped_fits(spark):
    z = np.conj(d.fd_fluence(RHO, 0.1, 10.0, 1.33, 1.1e8))
    rows = [("r", k, float(r), float(v.real) if k else None, float(v.imag)) for k in (0, 1) for r, v in zip(RHO, z)]
    df = spark.createDataFrame(rows, "recording string, frame int, rho double, re double, im double")
    got = {r["frame"]: r["mua"] for r in fits.fd_to_properties(df, ["recording", "frame"]).collect()}
    assert got[0] is None or np.isnan(got[0])
    assert abs(got[1] - 0.1) < 1e-4
