"""HDF5 trees and SNIRF files round trip; chunked, compressed and newer layouts are read."""

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from lucera.sources import hdf5, snirf


def test_trees_round_trip():
    tree = {
        "a": np.arange(12.0).reshape(3, 4), "b": np.array([1, -2, 3], np.int32), "n": 7, "x": 2.5, "s": "text é", "l": ["one", "two", ""], "e": np.zeros((0, 3)), "g": {"h": {"deep": np.int64(2**40)}, "empty": {}},
        **{f"m{k}": k for k in range(300)},
    }
    back = hdf5.loads(hdf5.dumps(tree))
    assert set(back) == set(tree) and back["s"] == "text é" and back["l"] == ["one", "two", ""] and back["n"] == 7 and back["x"] == 2.5
    assert np.array_equal(back["a"], tree["a"]) and np.array_equal(back["b"], tree["b"]) and back["e"].shape == (0, 3)
    assert back["g"] == {"h": {"deep": 2**40}, "empty": {}} and all(back[f"m{k}"] == k for k in range(300))
    assert hdf5.loads(hdf5.dumps(tree), "g/h/deep") == 2**40
    with pytest.raises(ValueError):
        hdf5.loads(b"no such file")


def newer(values: np.ndarray, chunk: int) -> bytes:
    """A file as newer libraries write it: superblock 2, version 2 headers, compact links, and a chunked dataset
    with shuffle and deflate; also a string of variable length in a global heap."""
    out = bytearray(48)

    def put(b):
        out.extend(bytes(-len(out) % 8))
        out.extend(b)
        return len(out) - len(b)

    def header(messages):
        body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
        return put(b"OHDR" + bytes([2, 2]) + struct.pack("<I", len(body)) + body + bytes(4))

    keys = b""
    n = -(-len(values) // chunk)
    for i in range(n):
        part = np.zeros(chunk, "<f8")
        part[: len(values[i * chunk : (i + 1) * chunk])] = values[i * chunk : (i + 1) * chunk]
        packed = zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, 8).T.tobytes())
        at = put(packed)
        keys += struct.pack("<IIQQ", len(packed), 0, i * chunk, 0) + struct.pack("<Q", at)
    keys += struct.pack("<IIQQ", 0, 0, n * chunk, 0)
    tree = put(b"TREE" + struct.pack("<BBHQQ", 1, 0, n, hdf5.UNDEFINED, hdf5.UNDEFINED) + keys)
    f8 = struct.pack("<BBBBI", 0x11, 0x20, 0x3F, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)
    filters = bytes([2, 2]) + struct.pack("<HHHI", 2, 0, 1, 8) + struct.pack("<HHHI", 1, 0, 1, 4)
    data = header([(1, struct.pack("<BBBBQ", 2, 1, 0, 1, len(values))), (3, f8), (8, struct.pack("<BBBQII", 3, 2, 2, tree, chunk, 8)), (11, filters)])
    word = b"a string"
    heap = put(b"GCOL" + struct.pack("<B3xQ", 1, 4096) + struct.pack("<HH4xQ", 1, 1, len(word)) + word + bytes(16))
    ref = put(struct.pack("<IQI", len(word), heap, 1))
    vlen = struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x10, 0, 0, 0, 1) + struct.pack("<HH", 0, 8)
    text = header([(1, bytes([2, 0, 0, 0])), (3, vlen), (8, struct.pack("<BBQQ", 3, 1, ref, 16))])
    link = lambda name, at: (6, bytes([1, 0, len(name)]) + name + struct.pack("<Q", at))
    root = header([(2, bytes([0, 0]) + struct.pack("<QQ", hdf5.UNDEFINED, hdf5.UNDEFINED)), link(b"data", data), link(b"name", text)])
    out[:48] = hdf5.SIGNATURE + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", 0, hdf5.UNDEFINED, len(out), root) + bytes(4)
    return bytes(out)


def test_newer_layouts():
    values = np.random.default_rng(0).normal(size=23)
    got = hdf5.loads(newer(values, 10))
    assert np.array_equal(got["data"], values) and got["name"] == "a string"


def test_times():
    assert snirf.times([0.5, 0.1], 4).tolist() == pytest.approx([0.5, 0.6, 0.7, 0.8]) and snirf.times([1, 2, 4], 3).tolist() == [1, 2, 4]


def test_files_round_trip(spark, tmp_path):
    rows = [(f"r{r}", s, d, w, 101 + k, "AC" if not k else "PH", "V" if not k else "deg", f, f / 10, float(r + s + d + w + f + k)) for r in range(2) for s in (1, 2) for d in (1, 3) for w in (690.0, 830.0) for k in (0, 1) for f in range(5)]
    df = spark.createDataFrame(rows, "recording string, source int, detector int, wavelength double, data_type int, label string, unit string, frame long, t double, v double")
    events = spark.createDataFrame([("r0", 0.1, 0.2, 1.0, "tap"), ("r0", 0.3, 0.1, 2.0, "rest"), ("r1", 0.0, 0.0, 1.0, "tap")], "recording string, onset double, duration double, value double, label string")
    aux = spark.createDataFrame([("r0", "acc", "g", 0.0, 1.0), ("r0", "acc", "g", 0.5, 2.0)], "recording string, signal string, unit string, t double, v double")
    optodes = pd.DataFrame([("source", 1, "a", 0, 0, 0), ("source", 2, "b", 1, 0, 0), ("detector", 1, "c", 0, 1, 0), ("detector", 3, "d", 0, 2, 1)], columns=["kind", "idx", "label", "x", "y", "z"])
    written = snirf.write_snirf(df, str(tmp_path / "s"), optodes, events, aux, {"SubjectID": "x"}).collect()
    assert sorted(r["recording"] for r in written) == ["r0", "r1"]
    got = snirf.read_snirf(spark, str(tmp_path / "s"))
    cols = ["recording", "source", "detector", "wavelength", "data_type", "label", "unit", "frame", "t", "v"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(rows)
    assert {r["channel"] for r in got.collect()} == {"S1D1", "S1D3", "S2D1", "S2D3"}
    assert sorted(map(tuple, snirf.read_snirf_events(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, events.collect()))
    assert [(r["signal"], r["unit"], r["t"], r["v"]) for r in snirf.read_snirf_aux(spark, str(tmp_path / "s")).orderBy("frame").collect()] == [("acc", "g", 0.0, 1.0), ("acc", "g", 0.5, 2.0)]
    probe = snirf.read_snirf_probe(spark, str(tmp_path / "s")).filter("recording = 'r1' AND kind = 'detector'").orderBy("idx").collect()
    assert [(r["label"], r["y"], r["z"], r["unit"]) for r in probe] == [("c", 1.0, 0.0, "mm"), ("d", 2.0, 1.0, "mm")]
    columns = snirf.read_measurement_list(spark, str(tmp_path / "s"))
    assert columns.count() == 32 and {r["modality"] for r in snirf.modality(columns).collect()} == {"FD"}
    assert snirf.describe_columns(columns).filter("column = 0").first()["description"].startswith("S1-D1 690 nm type 101")
    z = snirf.fd_to_complex(got, True).filter("recording = 'r0' AND channel = 'S1D1' AND wavelength = 690 AND frame = 2").first()
    assert z["v"] == pytest.approx(694 * np.cos(np.radians(695))) and z["v_im"] == pytest.approx(694 * np.sin(np.radians(695)))


def test_enumerated(spark):
    ch = spark.createDataFrame([(2, 1), (1, 1)], "source int, detector int")
    got = snirf.enumerate_columns(ch, [690.0, 830.0], [1]).orderBy("column").collect()
    assert [(r["source"], r["wavelength"], r["column"]) for r in got] == [(1, 690.0, 0), (1, 830.0, 1), (2, 690.0, 2), (2, 830.0, 3)]
