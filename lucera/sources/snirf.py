"""SNIRF files: samples, measurement lists, probes, events and auxiliary signals as tables, and back.

A file is one recording and is parsed whole in one task; files spread over tasks. Tables are long:
a row a sample. Written files are named by their recording and lie in a folder that all tasks share.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.functions.optics import datatype_modality
from lucera.sources import hdf5

LIST = "recording string, nirs string, data string, column int, source int, detector int, wavelength_idx int, wavelength double, data_type int, data_type_index int, label string, unit string"
SAMPLES = f"{LIST}, channel string, frame long, t double, v double"
#: Data types of the measurement list, as the format fixes them.
AMPLITUDE, FD_AC, FD_PHASE, TD_GATED, TD_MOMENTS, DCS_G2, DCS_BFI, PROCESSED = 1, 101, 102, 201, 301, 401, 410, 99999


def _numbered(tree: dict, name: str) -> list[tuple[str, dict]]:
    """Groups name, name1, name2 ... in order of their number."""
    found = [(int(m.group(1) or 0), k) for k in tree if (m := re.fullmatch(rf"{name}(\d*)", k))]
    return [(k, tree[k]) for _, k in sorted(found)]


def _one(x, default=None):
    """A number or string that may come as an array of one."""
    if x is None:
        return default
    if isinstance(x, list):
        return x[0] if x else default
    return x.reshape(-1)[0].item() if isinstance(x, np.ndarray) else x


def times(t, n: int) -> np.ndarray:
    """All times, from all of them or from a start and a step."""
    t = np.atleast_1d(np.asarray(t, float)).reshape(-1)
    return t if len(t) == n else t[0] + np.arange(n) * (t[1] if len(t) > 1 else 1.0)


def columns_of(recording: str, tree: dict) -> pd.DataFrame:
    """The measurement list: a row a column of a data block."""
    rows = []
    for nirs, g in _numbered(tree, "nirs"):
        waves = np.atleast_1d(g.get("probe", {}).get("wavelengths", [])).astype(float).reshape(-1)
        for data, block in _numbered(g, "data"):
            for k, (_, m) in enumerate(_numbered(block, "measurementList")):
                w = int(_one(m.get("wavelengthIndex"), 1)) - 1
                rows.append((
                    recording, nirs, data, k, int(_one(m["sourceIndex"])), int(_one(m["detectorIndex"])), w, waves[w] if 0 <= w < len(waves) else None, int(_one(m.get("dataType"), AMPLITUDE)),
                    int(_one(m.get("dataTypeIndex"), 1)), _one(m.get("dataTypeLabel")), _one(m.get("dataUnit")),
                ))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in LIST.split(", ")])


def _samples(recording: str, tree: dict) -> pd.DataFrame:
    cols, out = columns_of(recording, tree), []
    for (nirs, data), part in cols.groupby(["nirs", "data"]):
        block = tree[nirs][data]
        v = np.asarray(block["dataTimeSeries"], float)
        v = v.reshape(len(v), -1)
        t = times(block["time"], len(v))
        for row in part.itertuples(index=False):
            out.append(pd.DataFrame({**row._asdict(), "channel": f"S{row.source}D{row.detector}", "frame": np.arange(len(t)), "t": t, "v": v[:, row.column]}))
    return pd.concat(out) if out else pd.DataFrame(columns=[*cols.columns, "channel", "frame", "t", "v"])


def _aux(recording: str, tree: dict) -> pd.DataFrame:
    out = []
    for _, g in _numbered(tree, "nirs"):
        for name, a in _numbered(g, "aux"):
            v = np.asarray(a["dataTimeSeries"], float).reshape(-1)
            out.append(pd.DataFrame({"recording": recording, "signal": _one(a.get("name"), name), "unit": _one(a.get("dataUnit")), "frame": np.arange(len(v)), "t": times(a["time"], len(v)) + float(_one(a.get("timeOffset"), 0.0)), "v": v}))
    return pd.concat(out) if out else pd.DataFrame(columns=["recording", "signal", "unit", "frame", "t", "v"])


def _stims(recording: str, tree: dict) -> pd.DataFrame:
    rows = []
    for _, g in _numbered(tree, "nirs"):
        for name, s in _numbered(g, "stim"):
            for onset, duration, value, *_ in np.asarray(s.get("data", []), float).reshape(-1, max(3, np.asarray(s.get("data", [])).shape[-1] if np.size(s.get("data", [])) else 3)):
                rows.append((recording, onset, duration, value, _one(s.get("name"), name)))
    return pd.DataFrame(rows, columns=["recording", "onset", "duration", "value", "label"])


def _probe(recording: str, tree: dict) -> pd.DataFrame:
    rows = []
    for _, g in _numbered(tree, "nirs"):
        p, unit = g.get("probe", {}), _one(g.get("metaDataTags", {}).get("LengthUnit"), "mm")
        for kind in ("source", "detector", "landmark"):
            at = p.get(f"{kind}Pos3D", p.get(f"{kind}Pos2D"))
            if at is None:
                continue
            at = np.asarray(at, float)
            at = at.reshape(-1, at.shape[-1])
            names = p.get(f"{kind}Labels") or []
            for i, xyz in enumerate(at):
                rows.append((recording, kind, i + 1, names[i] if i < len(names) else None, *np.pad(xyz[:3], (0, max(0, 3 - len(xyz)))), unit))
    return pd.DataFrame(rows, columns=["recording", "kind", "idx", "label", "x", "y", "z", "unit"])


def _table(spark: SparkSession, path: str, f, schema: str, inner: str = "") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.snirf").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield f(path.rsplit("/", 1)[-1].removesuffix(".snirf"), hdf5.loads(content))[names]

    return files.mapInPandas(run, schema)


def read_measurement_list(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, columns_of, LIST)


def read_snirf(spark: SparkSession, path: str) -> DataFrame:
    """All samples of the files at a path, with what the measurement list says of their column."""
    return _table(spark, path, _samples, SAMPLES)


def read_snirf_aux(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, _aux, "recording string, signal string, unit string, frame long, t double, v double")


def read_snirf_events(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, _stims, "recording string, onset double, duration double, value double, label string")


def read_snirf_probe(spark: SparkSession, path: str) -> DataFrame:
    """Optodes and landmarks, without reading samples into rows."""
    return _table(spark, path, _probe, "recording string, kind string, idx int, label string, x double, y double, z double, unit string")


def modality(columns: DataFrame) -> DataFrame:
    """(recording, modality): that of the list's data types; null where they differ."""
    m = datatype_modality(F.col("data_type"))
    m = F.when(m.startswith("DCS"), "DCS").otherwise(m)
    return columns.groupBy("recording").agg(F.when(F.countDistinct(m) == 1, F.min(m)).alias("modality"))


def describe_columns(columns: DataFrame) -> DataFrame:
    """A line of text a column, as a listing shows it."""
    text = F.format_string("S%d-D%d %s type %d", "source", "detector", F.coalesce(F.concat(F.col("wavelength").cast("int").cast("string"), F.lit(" nm")), F.col("label"), F.lit("-")), "data_type")
    return columns.select("recording", "data", "column", F.concat_ws(" ", text, "label", "unit").alias("description"))


def enumerate_columns(channels: DataFrame, wavelengths: list[float], data_types: list[int]) -> DataFrame:
    """Columns of a written block: channels (source, detector) by wavelengths by data types, in this order.
    A montage is small: its rows are numbered in one task."""
    from pyspark.sql import Window

    cells = F.array(*[F.struct(F.lit(i).alias("wavelength_idx"), F.lit(float(w)).alias("wavelength"), F.lit(d).alias("data_type")) for i, w in enumerate(wavelengths) for d in data_types])
    rows = channels.select("source", "detector", F.posexplode(cells).alias("_k", "c")).select("source", "detector", "_k", "c.*")
    return rows.withColumn("column", F.row_number().over(Window.orderBy("source", "detector", "_k")) - 1).drop("_k")


def fd_to_complex(samples: DataFrame, degrees: bool = False) -> DataFrame:
    """AC amplitude (101) and phase (102) of a channel and wavelength to the parts of a complex number."""
    one = lambda code: F.max(F.when(F.col("data_type") == code, F.col("v")))
    got = samples.groupBy("recording", "channel", "wavelength", "frame").agg(F.min("t").alias("t"), one(FD_AC).alias("ac"), one(FD_PHASE).alias("phase"))
    phase: Column = F.radians("phase") if degrees else F.col("phase")
    return got.withColumns({"v": F.col("ac") * F.cos(phase), "v_im": F.col("ac") * F.sin(phase)})


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def file_of(samples: pd.DataFrame, wavelengths: list[float], optodes: pd.DataFrame | None = None, events: pd.DataFrame | None = None, aux: pd.DataFrame | None = None, tags: dict | None = None) -> bytes:
    """The file of one recording. samples: source, detector, wavelength, data_type, label, unit, frame, t, v;
    optodes: kind, idx, x, y, z[, label]; events: onset, duration, value, label; aux: signal, t, v[, unit]."""
    keys = ["source", "detector", "wavelength", "data_type", "label", "unit"]
    have = samples.assign(**{c: None for c in keys if c not in samples}).fillna({"label": "", "unit": "", "data_type": AMPLITUDE})
    wide = have.drop_duplicates(["frame", *keys]).set_index(["frame", "t", *keys])["v"].unstack(keys).sort_index().sort_index(axis=1) if len(have) else None
    block: dict = {"dataTimeSeries": np.zeros((0, 0)), "time": np.zeros(0)}
    if wide is not None:
        block = {"dataTimeSeries": wide.to_numpy(float), "time": wide.index.get_level_values("t").to_numpy(float)}
        for k, (source, detector, w, kind, label, unit) in enumerate(wide.columns):
            m = {"sourceIndex": int(source), "detectorIndex": int(detector), "wavelengthIndex": wavelengths.index(w) + 1, "dataType": int(kind), "dataTypeIndex": 1}
            block[f"measurementList{k + 1}"] = m | ({"dataTypeLabel": label} if label else {}) | ({"dataUnit": unit} if unit else {})
    nirs: dict = {"data1": block, "probe": {"wavelengths": np.array(wavelengths, float)}}
    nirs["metaDataTags"] = {"SubjectID": "unknown", "MeasurementDate": "unknown", "MeasurementTime": "unknown", "LengthUnit": "mm", "TimeUnit": "s", "FrequencyUnit": "Hz"} | (tags or {})
    if optodes is not None:
        for kind, part in optodes.sort_values("idx").groupby("kind"):
            nirs["probe"][f"{kind}Pos3D"] = part[["x", "y", "z"]].to_numpy(float)
            if "label" in part and part["label"].notna().all():
                nirs["probe"][f"{kind}Labels"] = part["label"].astype(str).tolist()
    if events is not None:
        for k, (label, part) in enumerate(events.groupby("label")):
            nirs[f"stim{k + 1}"] = {"name": str(label), "data": part.sort_values("onset")[["onset", "duration", "value"]].to_numpy(float)}
    if aux is not None:
        for k, (signal, part) in enumerate(aux.groupby("signal")):
            part = part.sort_values("t")
            unit = {"dataUnit": str(part["unit"].iloc[0])} if "unit" in part and part["unit"].notna().all() else {}
            nirs[f"aux{k + 1}"] = {"name": str(signal), "dataTimeSeries": part["v"].to_numpy(float), "time": part["t"].to_numpy(float)} | unit
    return hdf5.dumps({"formatVersion": "1.1", "nirs": nirs})


def write_snirf(samples: DataFrame, folder: str, optodes: pd.DataFrame | None = None, events: DataFrame | None = None, aux: DataFrame | None = None, tags: dict | None = None) -> DataFrame:
    """Writes a file a recording; rows (recording, path, bytes). The wavelengths' order is that of the table
    of all recordings; optodes are one montage's and go with the function. Recordings meet their events and
    auxiliary signals in one group each."""
    waves = sorted(r[0] for r in samples.select("wavelength").distinct().collect())
    rec = dict(samples.dtypes)["recording"]
    cols = [c for c in ("source", "detector", "wavelength", "data_type", "label", "unit", "frame", "t", "v") if c in samples.columns]
    rows = samples.select("recording", F.lit("samples").alias("part"), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("row"))
    for part, df in (("events", events), ("aux", aux)):
        if df is not None:
            rows = rows.unionByName(df.select("recording", F.lit(part).alias("part"), F.to_json(F.struct(*[c for c in df.columns if c != "recording"]), {"ignoreNullFields": "false"}).alias("row")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        tables = {k: pd.DataFrame([json.loads(x) for x in g["row"]]) for k, g in pdf.groupby("part")}
        name = pdf["recording"].iloc[0]
        data = file_of(tables.get("samples", pd.DataFrame(columns=cols)), waves, optodes, tables.get("events"), tables.get("aux"), tags)
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}.snirf") as f:
            f.write(data)
        return pd.DataFrame({"recording": [name], "path": [f"{base}/{name}.snirf"], "bytes": [len(data)]})

    return rows.groupBy("recording").applyInPandas(run, f"recording {rec}, path string, bytes long")
