"""Binary and multi-file recordings: MATLAB version 5 `.nirs`, NIRx intensity files, sqlite scans."""

from __future__ import annotations

import sqlite3
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: MATLAB level 5 storage types (fixed values of the format).
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2"}


def _element(raw: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """(type, data, next place); small elements keep their data in the tag."""
    kind, size = struct.unpack_from(order + "II", raw, at)
    if kind >> 16:
        return kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)], at + 8
    end = at + 8 + size
    return kind, raw[at + 8 : end], end if kind == 15 else end + -size % 8


def _numbers(kind: int, data: bytes, order: str) -> np.ndarray:
    return np.frombuffer(data, np.dtype(_TYPES[kind]).newbyteorder(order))


def _matrix(raw: bytes, order: str):
    flags, at = _element(raw, 0, order)[1], _element(raw, 0, order)[2]
    kind, data, at = _element(raw, at, order)
    dims = _numbers(kind, data, order).tolist()
    _, name, at = _element(raw, at, order)
    cls = struct.unpack_from(order + "I", flags)[0] & 0xFF
    if cls in (1, 2):  # cells, or a struct with its field names first
        fields = [None]
        if cls == 2:
            kind, data, at = _element(raw, at, order)
            width = int(_numbers(kind, data, order)[0])
            _, data, at = _element(raw, at, order)
            fields = [data[i : i + width].split(b"\0")[0].decode() for i in range(0, len(data), width)]
        values = []
        for _ in range(int(np.prod(dims)) * len(fields)):
            _, data, at = _element(raw, at, order)
            values.append(_matrix(data, order)[1] if data else np.zeros((0, 0)))
        if cls == 1:
            return name.decode(), values
        rows = [dict(zip(fields, values[i : i + len(fields)], strict=True)) for i in range(0, len(values), len(fields))]
        return name.decode(), rows[0] if len(rows) == 1 else rows
    kind, data, at = _element(raw, at, order)
    v = _numbers(kind, data, order)
    if cls == 4:
        return name.decode(), "".join(map(chr, v))
    return name.decode(), v.reshape(dims, order="F").astype(float)


def matlab5(raw: bytes) -> dict:
    """Variables of a level 5 MATLAB file: arrays, strings, cells as lists, structs as dicts."""
    if len(raw) < 128 or raw[:4] == b"\x89HDF" or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB level 5 file")
    order, at, out = "<" if raw[126:128] == b"IM" else ">", 128, {}
    while at + 8 <= len(raw):
        kind, data, at = _element(raw, at, order)
        if kind == 15:
            kind, data, _ = _element(zlib.decompress(data), 0, order)
        if kind == 14:
            name, value = _matrix(data, order)
            out[name] = value
    return out


def nirs_mat(spark: SparkSession, path: str) -> DataFrame:
    """`.nirs` files -> (recording, kind, channel, source, detector, wavelength, frame, t, v): kind
    'raw' for light, 'stim' a condition and 'aux' a signal, whose channel is its column. A task a file."""

    def run(batches):
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                m = matlab5(bytes(content))
                t, sd = m["t"].ravel(), m["SD"]
                lists, lam = sd["MeasList"].astype(int), sd["Lambda"].ravel()
                for kind, block in (("raw", m["d"]), ("stim", m.get("s")), ("aux", m.get("aux"))):
                    if block is None or not block.size:
                        continue
                    for c in range(block.shape[1]):
                        s, d, w = (lists[c, 0], lists[c, 1], lam[lists[c, 3] - 1]) if kind == "raw" else (None, None, None)
                        label = f"S{s}D{d}" if kind == "raw" else str(c)
                        yield pd.DataFrame({"recording": where, "kind": kind, "channel": label, "source": s, "detector": d, "wavelength": w, "frame": range(len(t)), "t": t, "v": block[:, c]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "recording string, kind string, channel string, source int, detector int, wavelength double, frame long, t double, v double")


def nirx_intensity(spark: SparkSession, path: str, sources: int, detectors: int, mask: list[list[int]], rate: float, wavelength: float) -> DataFrame:
    """One `.wlN` file's row-major source-detector columns that the mask (sources x detectors) keeps."""
    keep = [(s * detectors + d, f"S{s + 1}D{d + 1}") for s in range(sources) for d in range(detectors) if mask[s][d]]
    cells = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("recording"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("frame", "value"))
    pick = F.explode(F.array(*[F.struct(F.lit(name).alias("channel"), F.get(F.col("c"), F.lit(i)).try_cast("double").alias("v")) for i, name in keep]))
    rows = lines.select("recording", F.col("frame").cast("long").alias("frame"), cells.alias("c")).select("recording", "frame", pick.alias("p"))
    return rows.select("recording", "p.channel", F.lit(float(wavelength)).alias("wavelength"), "frame", (F.col("frame") / rate).alias("t"), "p.v")


def scan_sqlite(spark: SparkSession, path: str, session_id: int | None = None, session_label: str | None = None) -> DataFrame:
    """Flow scan of a sqlite file: the session of an id, the latest of a label, or the only one. One
    file is one recording, read in the one task that opens it; the driver reads no sample."""
    where = "id = ?" if session_id is not None else "session_label = ?" if session_label is not None else "1 = 1"
    key = [v for v in (session_id, session_label) if v is not None][:1]

    def run(batches):
        for pdf in batches:
            for file in pdf["path"]:
                con = sqlite3.connect(f"file:{file}?mode=ro", uri=True)
                found = con.execute(f"SELECT id FROM sessions WHERE {where} ORDER BY session_start DESC, id DESC", key).fetchall()
                if not found or (not key and len(found) > 1):
                    raise ValueError(f"{len(found)} sessions match in {file}")
                cur = con.execute("SELECT side, cam_id, frame_id, timestamp_s, bfi, quality FROM session_data WHERE session_id = ? AND bfi IS NOT NULL", found[0])
                while part := cur.fetchmany(50_000):
                    yield pd.DataFrame(part, columns=["side", "cam_id", "frame", "t", "v", "quality"]).astype({"quality": float}).assign(recording=file)
                con.close()

    rows = spark.createDataFrame([(path,)], "path string").mapInPandas(run, "recording string, side int, cam_id int, frame long, t double, v double, quality double")
    side = F.when(F.col("side") == 0, "left").otherwise("right")
    label = F.when(F.col("cam_id") == -1, F.concat(side, F.lit("_avg"))).otherwise(F.format_string("S%dD%d", F.col("side") + 1, F.col("cam_id") + 1))
    return rows.select("recording", label.alias("channel"), "frame", "t", "v", "quality")
