"""BIDS datasets of optical recordings: names, sidecars and the folders of a study, written and read."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.sources import readers, snirf
from lucera.sources.snirf import _filesystem

VERSION = "1.8.0"


def file_name(subject: Column, session: Column, task: Column, run: Column) -> Column:
    """sub-_[ses-_]task-_[run-_]nirs of labels, made alphanumeric."""
    clean = readers.sanitise_label
    part = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f"{key}-"), clean(c)))
    return F.concat_ws("_", part("sub", subject), part("ses", session), part("task", task), part("run", run), F.lit("nirs"))


def records(meta: DataFrame) -> DataFrame:
    """(recording, name, folder) of recordings (recording, subject, session, task, run); equal names raise when written."""
    name = file_name(F.col("subject"), F.col("session"), F.col("task"), F.col("run"))
    clean = readers.sanitise_label
    folder = F.concat_ws("/", F.concat(F.lit("sub-"), clean(F.col("subject"))), F.when(F.col("session").isNotNull(), F.concat(F.lit("ses-"), clean(F.col("session")))), F.lit("nirs"))
    return meta.select("recording", "subject", name.alias("name"), folder.alias("folder"))


def channel_type(data_type: Column, label: Column) -> Column:
    """Type of a channel in a channels table."""
    low = F.lower(label)
    processed = F.when(low == "dod", "NIRSCWOPTICALDENSITY").when(low == "hbo", "NIRSCWHBO").when(low == "hbr", "NIRSCWHBR").when(low == "mua", "NIRSCWMUA").otherwise("MISC")
    return F.when(data_type == snirf.PROCESSED, processed).when(data_type == snirf.AMPLITUDE, "NIRSCWAMPLITUDE").when(data_type == snirf.FD_AC, "NIRSFDACAMPLITUDE").when(data_type == snirf.FD_PHASE, "NIRSFDPHASE").otherwise("MISC")


def channels_table(columns: DataFrame, short_mm: DataFrame | None = None) -> DataFrame:
    """channels.tsv of a measurement list: a row a column."""
    name = F.concat(F.lit("S"), "source", F.lit("-D"), "detector", F.coalesce(F.concat(F.lit(" "), F.col("wavelength").cast("int").cast("string")), F.lit("")))
    return columns.select("recording", "column", name.alias("name"), channel_type(F.col("data_type"), F.col("label")).alias("type"), F.concat(F.lit("S"), "source").alias("source"), F.concat(F.lit("D"), "detector").alias("detector"), F.col("wavelength").alias("wavelength_nominal"), F.coalesce("unit", F.lit("n/a")).alias("units"))


def optodes_table(probe: DataFrame) -> DataFrame:
    """optodes.tsv of a probe: its sources and detectors."""
    return probe.filter("kind <> 'landmark'").select("recording", F.concat(F.upper(F.substring("kind", 1, 1)), "idx").alias("name"), F.col("kind").alias("type"), "x", "y", "z")


def participants_table(meta: DataFrame) -> DataFrame:
    """participants.tsv: a row a subject with the metadata that its recordings agree on."""
    others = [c for c in meta.columns if c not in ("recording", "subject", "session", "task", "run")]
    one = lambda c: F.when(F.countDistinct(c) == 1, F.min(c)).alias(c)
    return meta.groupBy(F.concat(F.lit("sub-"), readers.sanitise_label(F.col("subject"))).alias("participant_id")).agg(F.count(F.lit(1)).alias("n_recordings"), *[one(c) for c in others])


def events_table(events: DataFrame) -> DataFrame:
    return events.select("recording", "onset", "duration", F.col("label").alias("trial_type"), "value").orderBy("recording", "onset")


def dataset_description(name: str, authors: list[str], license: str | None = None) -> dict:
    return {"Name": name, "BIDSVersion": VERSION, "DatasetType": "raw", "Authors": authors} | ({"License": license} if license else {})


def nirs_sidecar(task: str, sampling: float, channels: int, sources: int, detectors: int) -> dict:
    return {"TaskName": task, "SamplingFrequency": sampling, "NIRSChannelCount": channels, "NIRSSourceOptodeCount": sources, "NIRSDetectorOptodeCount": detectors}


def coordinate_sidecar(unit: str = "mm", system: str = "Other") -> dict:
    return {"NIRSCoordinateSystem": system, "NIRSCoordinateUnits": unit, "NIRSCoordinateSystemDescription": "as measured"}


def _tsv(df: pd.DataFrame) -> str:
    out = io.StringIO()
    w = csv.writer(out, delimiter="\t", lineterminator="\n")
    w.writerow(df.columns)
    for row in df.itertuples(index=False):
        w.writerow(["n/a" if v is None or v != v else v for v in row])
    return out.getvalue()


def write_dataset(spark: SparkSession, folder: str, meta: DataFrame, samples: DataFrame, optodes: pd.DataFrame, events: DataFrame, sampling: float, name: str = "dataset", authors=(), license: str | None = None) -> DataFrame:
    """A dataset of a study's recordings (keyed by recording) under a shared folder; rows (recording, name, files).

    SNIRF files are written by tasks under their recordings' names, with sidecars beside them; participants
    and the description are one small table each, written by the driver."""
    named = records(meta)
    twice = named.groupBy("name").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two recordings would be named {twice[0]['name']}")
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)

    def put(path: str, text: str) -> None:
        with fs.open_output_stream(f"{base}/{path}") as f:
            f.write(text.encode())

    put("dataset_description.json", json.dumps(dataset_description(name, list(authors), license), indent=2))
    put("participants.tsv", _tsv(participants_table(meta).orderBy("participant_id").toPandas()))
    waves = sorted(r[0] for r in samples.select("wavelength").distinct().collect())
    cols = ["source", "detector", "wavelength", "frame", "t", "v"]
    rows = samples.select("recording", F.lit("samples").alias("part"), F.to_json(F.struct(*cols)).alias("row"))
    rows = rows.unionByName(events.select("recording", F.lit("events").alias("part"), F.to_json(F.struct("onset", "duration", "value", "label")).alias("row")))
    rows = rows.join(named.select("recording", "name", "folder"), "recording").join(meta.select("recording", "task"), "recording")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: pd.DataFrame([json.loads(x) for x in g["row"]]) for k, g in pdf.groupby("part")}
        stem, place, task = pdf["name"].iloc[0], pdf["folder"].iloc[0], pdf["task"].iloc[0]
        fs, base = _filesystem(folder)
        fs.create_dir(f"{base}/{place}", recursive=True)
        s = parts.get("samples", pd.DataFrame(columns=cols))
        ev = parts.get("events", pd.DataFrame(columns=["onset", "duration", "value", "label"]))
        pairs = s[["source", "detector"]].drop_duplicates()
        listed = s[["source", "detector", "wavelength"]].drop_duplicates().sort_values(["source", "detector", "wavelength"])
        channels = pd.DataFrame({"name": [f"S{a}-D{b} {int(w)}" for a, b, w in listed.itertuples(index=False)], "type": "NIRSCWAMPLITUDE", "source": [f"S{a}" for a in listed["source"]], "detector": [f"D{b}" for b in listed["detector"]], "wavelength_nominal": listed["wavelength"].to_numpy(), "units": "V"})
        placed = pd.DataFrame({"name": [f"{k[0].upper()}{i}" for k, i in zip(optodes["kind"], optodes["idx"], strict=True)], "type": optodes["kind"], "x": optodes["x"], "y": optodes["y"], "z": optodes["z"]})
        head = stem.removesuffix("_nirs")
        files = {
            f"{stem}.snirf": snirf.file_of(s, waves, optodes, ev), f"{stem}.json": json.dumps(nirs_sidecar(task, sampling, len(listed), pairs["source"].nunique(), pairs["detector"].nunique()), indent=2).encode(),
            f"{head}_channels.tsv": _tsv(channels).encode(), f"{head}_optodes.tsv": _tsv(placed).encode(), f"{head}_coordsystem.json": json.dumps(coordinate_sidecar(), indent=2).encode(),
            f"{head}_events.tsv": _tsv(ev.rename(columns={"label": "trial_type"})[["onset", "duration", "trial_type", "value"]].sort_values("onset")).encode(),
        }
        for file, data in files.items():
            with fs.open_output_stream(f"{base}/{place}/{file}") as f:
                f.write(data)
        return pd.DataFrame({"recording": [pdf["recording"].iloc[0]], "name": [stem], "files": [len(files)]})

    rec = dict(meta.dtypes)["recording"]
    return rows.groupBy("recording").applyInPandas(run, f"recording {rec}, name string, files int")


def load_dataset(spark: SparkSession, folder: str, filters: dict | None = None):
    """A study of a dataset's recordings: entities of the names, participants' metadata, samples, events.
    Filters on subject, session, task and run choose files before they are read."""
    from lucera.operators.study import Study

    samples = snirf.read_snirf(spark, folder)
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.snirf").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"([^/]+)\.snirf$", 1).alias("recording"))
    meta = names.select("recording", *readers.entities(F.col("recording")))
    people = spark.read.csv(f"{folder}/participants.tsv", sep="\t", header=True, nullValue="n/a")
    meta = meta.withColumn("participant_id", F.concat(F.lit("sub-"), "subject")).join(people, "participant_id", "left").drop("participant_id")
    study = Study(spark, meta, {"optical": samples}, snirf.read_snirf_events(spark, folder))
    return study.select(filters) if filters else study
