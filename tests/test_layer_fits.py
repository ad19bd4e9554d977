"""Layered and joint fits recover what the models were given."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.functions import diffusion, fitting, layers  # noqa: E402
from lucera.operators import layer_fits  # noqa: E402

RHO = [1.0, 1.5, 2.0, 2.5, 3.0, 3.5]


def _two_layers():
    return np.array([layers.layered_fd(r, [0.1, 0.2], [10.0, 10.0], [1.0], 1.4, 1.1e8)[0] for r in RHO])


def test_layered_fit(spark):
    z = _two_layers()
    rows = [(f, r, float(v.real), float(-v.imag)) for f in (0, 1) for r, v in zip(RHO, z, strict=True)]
    rows[-1] = (1, RHO[-1], None, 0.0)
    fd = spark.createDataFrame(rows, "frame int, rho double, re double, im double")
    got = {r["frame"]: r for r in layer_fits.fd_to_layers(fd, ["frame"], fixed={"musp": 10.0}, starts=3).collect()}
    assert got[0]["musp_1"] == got[0]["musp_2"] == 10.0
    assert abs(got[0]["mua_1"] - 0.1) < 5e-3 and abs(got[0]["mua_2"] - 0.2) < 2e-2 and abs(got[0]["d_1"] - 1.0) < 0.1
    assert got[1]["mua_1"] is None and got[1]["d_1"] is None
    with pytest.raises(ValueError, match="does not hold the source"):
        fitting.fit_layered_fd(RHO, z, 1.4, 1.1e8, bounds=layers.layer_bounds(2))


def test_joint_fit(spark):
    tau = np.logspace(-7, -2, 40)
    z = diffusion.fd_fluence(np.array(RHO), 0.1, 10.0, 1.4, 1.1e8)
    g2 = diffusion.siegert(diffusion.dcs_g1(2.5, 0.1, 10.0, 1.4, 785.0, tau, adb=1e-8), 0.5)
    fd = spark.createDataFrame([(f, r, float(v.real), float(-v.imag)) for f in (0, 1) for r, v in zip(RHO, z, strict=True)], "frame int, rho double, re double, im double")
    dcs = spark.createDataFrame([(0, 2.5, float(t), float(v)) for t, v in zip(tau, g2, strict=True)], "frame int, rho double, tau double, g2 double")
    got = {r["frame"]: r for r in layer_fits.joint_to_properties(fd, dcs, ["frame"]).collect()}
    assert np.allclose([got[0][k] for k in ("mua", "musp", "adb", "beta")], [0.1, 10.0, 1e-8, 0.5], rtol=1e-3)
    assert got[1]["mua"] is None
