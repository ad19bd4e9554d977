"""Registration, reconstruction, projection, simulated and binary recordings against known truth."""

import sqlite3
import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.functions import diffusion  # noqa: E402
from lucera.operators import fits, imaging  # noqa: E402
from lucera.sources import recordings  # noqa: E402


def test_rigid_fit(spark):
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    src = rng.normal(size=(5, 3))
    turn, shift, left = imaging.rigid_fit(src, src @ q.T + [1, 2, 3])
    assert np.allclose(turn, q) and left.max() < 1e-12
    df = spark.createDataFrame(src.tolist(), "x double, y double, z double").withColumns(imaging.moved(turn, shift))
    assert np.allclose(df.toPandas().to_numpy(), src @ q.T + [1, 2, 3])


def test_reconstruction(spark):
    vox = imaging.voxel_grid(spark, (0, 0, 0.5), (3, 3, 2.5), 1.0)
    assert vox.count() == 48
    ch = pd.DataFrame([(i, float(i % 4), float(i // 4), float((i + 1) % 4), float((i // 4 + 1) % 4)) for i in range(12)], columns=["channel", "sx", "sy", "dx", "dy"])
    j = imaging.jacobian(vox, ch, 0.1, 10.0, 1.4, 1.0)
    m = j.toPandas().pivot(index="channel", columns="voxel", values="value").to_numpy()
    assert m.shape == (12, 48) and (m > 0).all()
    y = m[:, 20] * 0.1
    s = spark.createDataFrame([("r", int(c), f, float(y[c])) for c in range(12) for f in (0, 1) if (c, f) != (3, 1)], "recording string, channel int, frame long, v double")
    got = imaging.reconstruct(j, s, 0.01).toPandas()
    assert set(got["frame"]) == {0}
    assert np.allclose(got.sort_values("voxel")["value"], diffusion.tikhonov(m, 0.01) @ y)


def test_projection_and_labels(spark):
    vox = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (4.0, 0.0, 0.0, -3.0), (40.0, 0.0, 0.0, 9.0), (1.0, 0.0, 0.0, None)], "x double, y double, z double, value double")
    ver = spark.createDataFrame([(1, 1.0, 0.0, 0.0), (2, 100.0, 0.0, 0.0)], "vertex int, x double, y double, z double")
    for method, want in (("nearest", 1.0), ("peak", -3.0), ("idw", (1 - 3 / 9) / (1 + 1 / 9))):
        assert [(r["vertex"], round(r["value"], 9)) for r in imaging.project_to_surface(vox, ver, method=method).collect()] == [(1, round(want, 9))]
    vol = spark.createDataFrame([(1, 0, 0, 7)], "i int, j int, k int, label int")
    assert {r["vertex"]: r["label"] for r in imaging.labels_at(ver, vol).collect()} == {1: 7, 2: 0}


def test_simulated_frames_fit_back(spark):
    fd = imaging.simulate_fd(spark, [2.0, 2.5, 3.0], 2, 0.1, 10.0)
    for r in fits.fd_to_properties(fd, ["frame"]).collect():
        assert abs(r["mua"] - 0.1) < 2e-3 and abs(r["musp"] - 10) < 0.2
    noisy = imaging.simulate_fd(spark, [2.0, 2.5, 3.0], 4, 0.1, 10.0, level=0.01)
    assert sorted(map(tuple, noisy.collect())) == sorted(map(tuple, noisy.repartition(3).collect()))


def element(kind, data):
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def array(name, v, cls=6):
    head = element(6, struct.pack("<II", cls, 0))
    if isinstance(v, dict):
        names = b"".join(k.encode().ljust(16, b"\0") for k in v)
        body = struct.pack("<HHi", 5, 4, 16) + element(1, names) + b"".join(array("", x) for x in v.values())
        return element(14, element(6, struct.pack("<II", 2, 0)) + element(5, struct.pack("<ii", 1, 1)) + element(1, name.encode()) + body)
    v = np.atleast_2d(np.asarray(v, float))
    return element(14, head + element(5, struct.pack("<ii", *v.shape)) + element(1, name.encode()) + element(9, v.tobytes("F")))


def test_nirs_files(spark, tmp_path):
    d = np.arange(6.0).reshape(3, 2)
    sd = {"Lambda": [[760, 850]], "MeasList": [[1, 2, 1, 1], [1, 2, 1, 2]]}
    parts = [array("d", d), array("t", [[0.0], [0.1], [0.2]]), array("SD", sd), array("s", [[0], [1], [0]])]
    packed = zlib.compress(parts[0])
    raw = b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", 15, len(packed)) + packed + b"".join(parts[1:])
    (tmp_path / "a.nirs").write_bytes(raw)
    df = recordings.nirs_mat(spark, str(tmp_path / "a.nirs"))
    got = sorted((r["wavelength"], r["frame"], r["v"]) for r in df.filter("kind = 'raw'").collect())
    assert got == [(w, f, d[f, i]) for i, w in enumerate((760.0, 850.0)) for f in range(3)]
    assert df.filter("kind = 'stim' AND v = 1").first()["t"] == 0.1 and df.filter("kind = 'raw'").first()["channel"] == "S1D2"


def test_other_files(spark, tmp_path):
    (tmp_path / "a.wl1").write_text("1 2 3 4\n5 6 7 8\n\n")
    got = recordings.nirx_intensity(spark, str(tmp_path / "a.wl1"), 2, 2, [[1, 0], [0, 1]], 10.0, 760.0).collect()
    assert sorted((r["channel"], r["frame"], r["t"], r["v"]) for r in got) == [("S1D1", 0, 0.0, 1.0), ("S1D1", 1, 0.1, 5.0), ("S2D2", 0, 0.0, 4.0), ("S2D2", 1, 0.1, 8.0)]
    con = sqlite3.connect(tmp_path / "s.db")
    con.execute("CREATE TABLE sessions (id INTEGER, session_label TEXT, session_start REAL)")
    con.execute("CREATE TABLE session_data (session_id INTEGER, side INTEGER, cam_id INTEGER, frame_id INTEGER, timestamp_s REAL, bfi REAL, quality REAL)")
    con.executemany("INSERT INTO sessions VALUES (?, ?, ?)", [(1, "a", 1.0), (2, "a", 2.0)])
    con.executemany("INSERT INTO session_data VALUES (?, ?, ?, ?, ?, ?, ?)", [(1, 0, 0, 0, 0.0, 1.0, 1), (2, 1, 2, 0, 0.0, 5.0, None), (2, 0, -1, 0, 0.0, 6.0, 1), (2, 0, -1, 1, 0.1, None, 1)])
    con.commit()
    con.close()
    got = recordings.scan_sqlite(spark, str(tmp_path / "s.db"), session_label="a").collect()
    assert sorted((r["channel"], r["v"]) for r in got) == [("S2D3", 5.0), ("left_avg", 6.0)]
