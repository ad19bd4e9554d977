"""Readers of recording files into tables; every one is a Spark text or CSV scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLOAT = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def bids_events(spark: SparkSession, path: str) -> DataFrame:
    """_events.tsv or .csv: label, else trial_type; missing columns are null; sorted by onset within a file."""
    df = spark.read.csv(path, sep="\t" if path.rstrip("*").endswith(".tsv") or ".tsv" in path else ",", header=True, nullValue="n/a")
    names = {"onsettime_s": "onset", "duration": "duration", "condition": "trial_type"}
    df = df.withColumnsRenamed({c: names.get(c.lower(), c.lower()) for c in df.columns})
    has = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
    return df.select(F.input_file_name().alias("recording"), has("onset", "double").alias("onset"), has("duration", "double").alias("duration"), has("value", "double").alias("value"), F.coalesce(has("label", "string"), has("trial_type", "string")).alias("label"))


def events_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("onset double, duration double, value double, label string").csv(path, header=True)


def write_events(events: DataFrame, path: str, sep: str = "\t") -> None:
    """All four columns, one folder a recording."""
    events.write.partitionBy("recording").option("sep", sep).option("nullValue", "n/a").csv(path, header=True)


def openmotion_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide corrected scan -> (recording, channel, frame, t, v), empty cells left out."""
    df = spark.read.csv(path, header=True, inferSchema=True).withColumn("recording", F.input_file_name())
    wide = [c for c in df.columns if c.startswith("bfi_")]
    long = df.unpivot(["recording", "frame_id", "timestamp_s"], wide, "channel", "v").filter("v IS NOT NULL")
    return long.select("recording", F.regexp_replace("channel", "^bfi_", "").alias("channel"), F.col("frame_id").alias("frame"), F.col("timestamp_s").alias("t"), F.col("v").cast("double").alias("v"))


def atlas_optodes(spark: SparkSession, path: str) -> DataFrame:
    """`label: x y z` lines; s and d followed by a number are optodes, others landmarks."""
    line = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", rf"^\s*([^:]+?)\s*:\s*({FLOAT})\s+({FLOAT})\s+({FLOAT})\s*$", i)
    df = line.select(part(1).alias("label"), *[part(i + 2).try_cast("double").alias(c) for i, c in enumerate("xyz")]).filter("label <> ''")
    low = F.lower("label")
    kind = F.when(low.rlike(r"^s\d+$"), "source").when(low.rlike(r"^d\d+$"), "detector").otherwise("landmark")
    return df.withColumn("kind", kind).withColumn("idx", F.regexp_extract("label", r"(\d+)$", 1).try_cast("int"))


def obj_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices x y z, faces a b c) of an OBJ file; face indices from 1, in file order of vertices."""
    cell = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.monotonically_increasing_id().alias("line"))
    v = cell.filter("c[0] = 'v'").select("line", *[F.get("c", F.lit(i + 1)).cast("double").alias(k) for i, k in enumerate("xyz")])
    f = cell.filter("c[0] = 'f'").select(*[F.split(F.get("c", F.lit(i + 1)), "/")[0].cast("int").alias(k) for i, k in enumerate("abc")])
    return v, f


def nirx_header(spark: SparkSession, path: str) -> DataFrame:
    """sources, detectors, sampling_rate, wavelengths and event rows of a .hdr, a row per file."""
    df = spark.read.text(path, wholetext=True).withColumn("recording", F.input_file_name())
    one = lambda k, t: F.regexp_extract("value", rf'(?m)^{k}\s*=\s*"?({FLOAT})', 1).try_cast(t)
    lams = F.transform(F.regexp_extract_all(F.regexp_extract("value", r'(?m)^Wavelengths\s*=\s*"([^"]*)"', 1), F.lit(f"({FLOAT})"), 1), lambda x: x.cast("double"))
    block = F.regexp_extract("value", r'(?s)Events\s*=\s*"#(.*?)#"', 1)
    rows = F.filter(F.transform(F.split(block, r"\r?\n"), lambda r: F.regexp_extract_all(r, F.lit(f"({FLOAT})"), 1)), lambda r: F.size(r) >= 2)
    return df.select("recording", one("Sources", "int").alias("sources"), one("Detectors", "int").alias("detectors"), one("SamplingRate", "double").alias("sampling_rate"), lams.alias("wavelengths"), rows.alias("events"))


def nirx_mask(spark: SparkSession, path: str) -> DataFrame:
    """(recording, source, detector) of the pairs that a .hdr's S-D-Mask turns on."""
    df = spark.read.text(path, wholetext=True).withColumn("recording", F.input_file_name())
    rows = F.filter(F.split(F.regexp_extract("value", r'(?s)S-D-Mask\s*=\s*"#(.*?)#"', 1), r"\r?\n"), lambda r: F.trim(r) != "")
    lines = df.select("recording", F.posexplode(rows).alias("source", "line"))
    cells = lines.select("recording", (F.col("source") + 1).alias("source"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("detector", "on"))
    return cells.filter("on = '1'").select("recording", "source", (F.col("detector") + 1).alias("detector"))


def remap_short_detectors(channels: DataFrame, first: int) -> DataFrame:
    """Detectors numbered from `first` on are one bundle of short ones; each is named after its source."""
    short = F.col("detector") >= first
    return channels.withColumns({"is_short": short, "detector": F.when(short, F.lit(first - 1) + F.col("source")).otherwise(F.col("detector"))})


def stim_samples(events: DataFrame, frames: DataFrame, markers: list | None = None) -> DataFrame:
    """(recording, condition, frame, t, v): a column of zeros and ones a condition, from events (recording,
    frame, marker) and the frames (recording, frame, t). Every recording has the given markers' columns,
    also where it holds none of their events; without markers, a recording has those of its own events."""
    named = F.concat(F.lit("marker_"), F.col("marker").cast("string")).alias("condition")
    on = events.select("recording", named, "frame", F.lit(1.0).alias("v")).distinct()
    if markers is None:
        every = frames.join(events.select("recording", named).distinct(), "recording")
    else:
        every = frames.withColumn("condition", F.explode(F.array(*[F.lit(f"marker_{m}") for m in markers])))
    return every.join(on, ["recording", "condition", "frame"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))).select("recording", "condition", "frame", "t", "v")


def extinction_csv(spark: SparkSession, path: str) -> DataFrame:
    """(lambda, hbo, hbr, water_mua) of a table whose second line holds units; blank cells are null."""
    df = spark.read.csv(path, header=True)
    number = {c: F.col(c).try_cast("double") for c in df.columns}
    return df.select(*[number[c].alias(c) for c in df.columns]).filter("lambda IS NOT NULL")


def nifti(spark: SparkSession, path: str) -> DataFrame:
    """(recording, i, j, k, label) of the voxels that are not 0 of NIfTI-1 volumes, plain or gzipped; a file a task."""
    import gzip
    import struct

    import numpy as np
    import pandas as pd

    #: Types of the format's codes.
    types = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
                dims = struct.unpack(f"{order}8h", raw[40:56])
                kind, at = struct.unpack(f"{order}h", raw[70:72])[0], int(struct.unpack(f"{order}f", raw[108:112])[0])
                shape = tuple(max(1, d) for d in dims[1:4])
                v = np.frombuffer(raw, order + types[kind], int(np.prod(shape)), at).reshape(shape, order="F")
                i, j, k = np.nonzero(v)
                yield pd.DataFrame({"recording": name, "i": i, "j": j, "k": k, "label": v[i, j, k].astype("int64")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "recording string, i int, j int, k int, label long")


def entities(name: Column) -> list[Column]:
    """subject, session, task, recording and run of a BIDS file name."""
    keys = {"subject": "sub", "session": "ses", "task": "task", "rec": "recording", "run": "run"}
    return [F.nullif(F.regexp_extract(name, rf"(?:^|[_/]){v}-([A-Za-z0-9]+)", 1), F.lit("")).alias(k) for k, v in keys.items()]


def sanitise_label(value: Column) -> Column:
    """Alphanumeric pieces of a label joined, each after the first capitalised."""
    parts = F.filter(F.split(value, "[^A-Za-z0-9]+"), lambda p: p != "")
    up = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2), F.length(p)))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(up(p))), "")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix."""
    from lucera.sources import recordings

    by_suffix = {"_events.tsv": bids_events, "_events.csv": bids_events, ".hdr": nirx_header, ".csv": openmotion_csv, ".txt": atlas_optodes, ".nirs": recordings.nirs_mat, ".db": recordings.scan_sqlite}
    for suffix, reader in by_suffix.items():
        if path.endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}; HDF5 files need h5py, which is not among the libraries here")
