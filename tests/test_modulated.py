"""Text exports of modulated light, correlator noise and field smoothness against known truth."""

import itertools
import struct
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from lucera.functions import photon  # noqa: E402
from lucera.operators import smoothness  # noqa: E402
from lucera.sources import modulated  # noqa: E402

WAVES = [690.0, 830.0] * 4


def _oxiplex(path, raw_a, raw_b, marks):
    coef = lambda k: [f"{n}\t" + "\t".join(str(k + i) for i in range(8)) for n in ("AC", "DC", "PH")]
    dist = lambda k: "\t".join(str(k + i) for i in range(8))
    names = ["Time Stamp", "Elapsed Time", *[f"a{i}" for i in range(24)], *[f"x{i}" for i in range(4)], "Marker", *[f"b{i}" for i in range(24)]]
    lines = ["ISS", "Modulation Frequency: 1.1e8", "Coef A", *coef(1), "Coef B", *coef(2)]
    lines += [f"Distance\t{dist(2)}", "x", "y", f"Distance B\t{dist(3)}", "\t".join(names)]
    for f, (a, b, m) in enumerate(zip(raw_a, raw_b, marks, strict=True)):
        lines.append("\t".join(map(str, [100 + f, f * 0.5, *a, 0, 0, 0, 0, m, *b])))
    path.write_text("\n".join(lines) + "\n\n")


def test_oxiplex(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(1, 9, (3, 24)), rng.uniform(1, 9, (3, 24))
    _oxiplex(tmp_path / "r.txt", a, b, [0, 2, 0])
    for det, raw, k in (("A", a, 0), ("B", b, 1)):
        got = {(r["channel"], r["wavelength"], r["freq"], r["frame"]): r for r in modulated.oxiplex(spark, str(tmp_path), det, WAVES).collect()}
        assert len(got) == 4 * 2 * 2 * 3
        for f, i in itertools.product(range(3), range(8)):
            gain = 1 + k + i
            dc, ac = (got[(f"S{i // 2 + 1}D1", WAVES[i], q, f)] for q in (0.0, 1.1e8))
            assert np.isclose(dc["re"], raw[f, 8 + i] * gain) and dc["im"] == 0 and dc["t"] == f * 0.5
            want = raw[f, i] * gain * np.exp(1j * np.deg2rad(raw[f, 16 + i] + gain))
            assert np.isclose(complex(ac["re"], ac["im"]), want)
            assert ac["distance"] == 2 + k + (i // 2) * 2 + 0.5
    assert [tuple(r)[1:] for r in modulated.oxiplex_marks(spark, str(tmp_path)).collect()] == [(0.5, 0.0, 2.0, "button_press")]


def _mat(name: str, body: bytes, cls: int, dims=(1, 1)) -> bytes:
    tag = lambda kind, data: struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)
    return tag(14, tag(6, struct.pack("<II", cls, 0)) + tag(5, struct.pack("<ii", *dims)) + tag(1, name.encode()) + body)


def _array(name: str, a) -> bytes:
    a = np.atleast_2d(np.asarray(a, float))
    data = a.tobytes(order="F")
    return _mat(name, struct.pack("<II", 9, len(data)) + data, 6, a.shape)


def _layout(path, chans, lists, src, det, lam):
    fields = {"MeasList": lists, "SrcPos": src, "DetPos": det, "Lambda": lam}
    names = b"".join(k.encode().ljust(32, b"\0") for k in fields)
    body = struct.pack("<HHI", 5, 4, 32) + struct.pack("<II", 1, len(names)) + names + b"".join(_array("", v) for v in fields.values())
    path.write_bytes(b"MATLAB 5.0".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + _mat("SD", body, 2) + _array("channel_map", chans))


def _boxy(path, distances, rows):
    names = [f"A-{k}{c}" for c in (1, 2, 5) for k in ("AC", "DC", "Ph")]
    lines = ["#WF CALIBRATION VALUES", "", "Val Type\t" + "\t".join(names), "Term\t" + "\t".join(["0", "0", "10"] * 3), "Factor\t" + "\t".join(["2", "3", "X"] * 3)]
    lines += ["#DISTANCE SETTINGS", "A-1\tA-2\tA-5", "\t".join(map(str, distances)), "#DATA BEGINS", "", "time\t" + "\t".join(names) + "\tmark"]
    path.write_text("\n".join(lines + ["\t".join(map(str, r)) for r in rows] + ["#DATA ENDS", ""]))


def test_boxy(spark, tmp_path):
    rows = [[5.0 + f, *range(1 + f, 10 + f), f % 2] for f in range(3)]
    (tmp_path / "d").mkdir()
    _boxy(tmp_path / "d" / "r.txt", [3.0, 0, 3.1], rows)
    args = [[[1, 1, 1, 1], [1, 1, 1, 2]], [[0, 0, 0]], [[3, 0, 0]], [690, 830]]
    _layout(tmp_path / "ok.layout", [1, 5], *args)
    _layout(tmp_path / "bad.layout", [1, 2], *args)
    for cal in (False, True):
        got = {(r["wavelength"], r["freq"], r["frame"]): r for r in modulated.boxy(spark, str(tmp_path / "d"), str(tmp_path / "ok.layout"), 1.1e8, cal).collect()}
        assert len(got) == 12 and {r["channel"] for r in got.values()} == {"S1D1"}
        for f, (w, at, told) in itertools.product(range(3), ((690.0, 1, 3.0), (830.0, 7, 3.1))):
            ac, dc, ph = rows[f][at : at + 3]
            r = got[(w, 1.1e8, f)]
            assert np.isclose(complex(r["re"], r["im"]), ac * (2 if cal else 1) * np.exp(1j * np.deg2rad(ph + (10 if cal else 0))))
            assert got[(w, 0.0, f)]["re"] == dc * (3 if cal else 1)
            assert (r["t"], r["distance"], r["file_distance"]) == (f, 3.0, told)
    assert [tuple(r)[1:] for r in modulated.boxy_marks(spark, str(tmp_path / "d")).collect()] == [(1.0, 0.0, 1.0, "button_press")]
    with pytest.raises(Exception, match="no distance for channel 2"):
        modulated.boxy(spark, str(tmp_path / "d"), str(tmp_path / "bad.layout"), 1.1e8).collect()


def test_correlation_noise():
    taus = np.arange(1, 101) * 1e-6
    g1 = np.exp(-3e4 * taus)
    assert np.isclose(photon.decay_rate(taus, g1), 3e4, rtol=1e-8)
    sd = photon.correlation_noise(taus, 3e4, 0.5, 1.0, 1e5)
    assert sd.shape == taus.shape and (sd > 0).all()
    assert np.allclose(photon.correlation_noise(taus, 3e4, 0.5, 4.0, 1e5), sd / 2)
    draws = np.array([photon.noisy_correlation(1 + 0.5 * g1**2, taus, np.random.default_rng(s), 0.5, 1.0, 1e5) for s in range(400)])
    assert np.allclose(draws.std(0), sd, rtol=0.25)
    with pytest.raises(ValueError, match="g1 reaches"):
        photon.noisy_correlation(1 + 0.5 * g1**2, taus, np.random.default_rng(0), 0.2, 1.0, 1e5)


def test_field_smoothness(spark):
    rng = np.random.default_rng(1)
    shape, images, df, h = (4, 4, 3), 12, 11.0, 2.0
    v = rng.normal(size=(images, *shape)) + rng.normal(size=(images, 1, 1, 1))
    v[:, 0, 0, 0] = 0
    v[3, 3, 3, 2] = np.nan
    rows = [(m, *x, float(v[(m, *x)])) for m in range(images) for x in np.ndindex(*shape)]
    df_in = spark.createDataFrame(rows, "image int, i int, j int, k int, v double")
    keep = [x for x in np.ndindex(*shape) if x not in ((0, 0, 0), (3, 3, 2))]
    rough = lambda r: -np.log(np.clip(r * (1 + (1 - r * r) / (2 * df)), 0.01, 1 - 1e-12))
    total = {x: np.zeros((3, 2)) for x in keep}
    for x, a in itertools.product(keep, range(3)):
        y = tuple(np.add(x, np.eye(3, dtype=int)[a]).tolist())
        if y in total:
            u, w = v[(slice(None), *x)], v[(slice(None), *y)]
            for end in (x, y):
                total[end][a] += (u @ w / np.sqrt((u @ u) * (w @ w)), 1)
    whole = sum(total.values())
    field = rough(whole[:, 0] / whole[:, 1])
    auto = smoothness.default_kernel((h * np.sqrt(2 * np.log(2) / field)).tolist(), df)
    for kernel in (None, 3.0, "auto"):
        got = {(r["i"], r["j"], r["k"]): r for r in smoothness.field_smoothness(df_in, df, h, kernel).collect()}
        assert sorted(got) == sorted(keep)
        width = auto if kernel == "auto" else kernel
        for x in keep:
            near = total[x]
            if width:
                s2 = width**2 / (8 * np.log(2))
                gap = {y: h * h * sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) for y in keep}
                near = sum(np.exp(-d / (2 * s2)) * total[y] for y, d in gap.items() if d <= 9 * s2)
            want = np.where(near[:, 1] > 0, rough(near[:, 0] / np.maximum(near[:, 1], 1e-300)), field)
            assert np.isclose(got[x]["rpv"], np.sqrt(np.prod(want / (2 * np.log(2)))))
            assert np.allclose([got[x][f"fwhm_{a}"] for a in "ijk"], h * np.sqrt(2 * np.log(2) / want))
