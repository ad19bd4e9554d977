"""Text exports of modulated light: OxiplexTS and Imagent records, by column expressions only.

Light is (recording, channel, source, detector, distance, wavelength, freq, frame, t, re, im): the
row of freq 0 is the mean intensity, that of the modulation is AC at its phase. Phases are not
unwrapped, as re and im do not depend on it. Marks are an event table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.sources.recordings import matlab5

LIGHT = ["recording", "channel", "source", "detector", "distance", "wavelength", "freq", "frame", "t", "re", "im"]


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("recording"), F.split("value", r"\r?\n").alias("lines"))


def _line(start: str) -> Column:
    """Place from 0 of the first line that starts so; a file without it is refused."""
    at = F.array_position(F.transform("lines", lambda x: x.startswith(start)), True)
    return F.when(at > 0, at - 1).otherwise(F.raise_error(F.lit(f"no line starts with {start}")).cast("long")).cast("int")


def _after(at: Column, rows: Column | None = None) -> Column:
    """Lines that hold something, from place `at` on."""
    return F.filter(F.slice("lines", at + 1, F.size("lines")) if rows is None else rows, lambda x: F.trim(x) != "")


def _cells(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _numbers(line: Column) -> Column:
    """The numbers after a line's first word."""
    return F.transform(F.filter(_cells(line), lambda x: x.try_cast("double").isNotNull()), lambda x: x.cast("double"))


def _filled(line: Column) -> Column:
    return F.filter(F.split(line, "\t"), lambda x: F.trim(x) != "")


def _light(dc: Column, ac: Column, degrees: Column, freq: Column) -> Column:
    turn = F.radians(degrees)
    row = lambda f, re, im: F.struct(f.alias("freq"), re.alias("re"), im.alias("im"))
    return F.array(row(F.lit(0.0), dc, F.lit(0.0)), row(freq, ac * F.cos(turn), ac * F.sin(turn)))


def _oxiplex_rows(spark: SparkSession, path: str) -> DataFrame:
    head = _files(spark, path).select("*", _line("Time Stamp").alias("begin"), _line("Coef").alias("coef"), _line("Distance").alias("dist"), _line("Modulation Frequency:").alias("mod"))
    return head.select("*", F.posexplode(_after(F.col("begin") + 1)).alias("frame", "row")).withColumn("cell", _cells(F.col("row")))


def oxiplex(spark: SparkSession, path: str, detector: str, wavelengths: list[float]) -> DataFrame:
    """Light of detector A or B; `wavelengths` names the wavelength of each of the 8 raw columns. The
    k-th column of a wavelength is source k, at the mean distance of the wavelengths' k-th columns."""
    if detector not in ("A", "B") or len(wavelengths) != 8:
        raise ValueError("detector is A or B, and there are 8 raw columns")
    place = [wavelengths[:i].count(w) for i, w in enumerate(wavelengths)]
    if len({wavelengths.count(w) for w in wavelengths}) > 1:
        raise ValueError("every wavelength needs as many columns as the others")
    base, coef, dist = (2, 1, 0) if detector == "A" else (31, 5, 3)
    line = lambda at: F.get("lines", at)
    head = _oxiplex_rows(spark, path).select(
        "recording", "frame", "cell", F.get("cell", F.lit(1)).try_cast("double").alias("t"), F.get(_numbers(line(F.col("mod"))), F.lit(0)).alias("f"),
        *[_numbers(line(F.col("coef") + coef + k)).alias(c) for k, c in enumerate(("ac", "dc", "turn"))], _numbers(line(F.col("dist") + dist)).alias("rho"),
    )
    cell = lambda i: F.get("cell", F.lit(base + i)).try_cast("double")
    picks = []
    for i, (w, k) in enumerate(zip(wavelengths, place, strict=True)):
        same = [j for j, p in enumerate(place) if p == k]
        mean = sum((F.get("rho", F.lit(j)) for j in same), F.lit(0.0)) / len(same)
        light = _light(cell(8 + i) * F.get("dc", F.lit(i)), cell(i) * F.get("ac", F.lit(i)), cell(16 + i) + F.get("turn", F.lit(i)), F.col("f"))
        picks.append(F.struct(F.lit(k + 1).alias("source"), mean.alias("distance"), F.lit(float(w)).alias("wavelength"), light.alias("light")))
    rows = head.select("recording", F.col("frame").cast("long").alias("frame"), "t", F.explode(F.array(*picks)).alias("p")).select("recording", "frame", "t", "p.*")
    rows = rows.select("*", F.inline("light")).withColumns({"channel": F.format_string("S%dD1", "source"), "detector": F.lit(1)})
    return rows.select(*LIGHT)


def oxiplex_marks(spark: SparkSession, path: str) -> DataFrame:
    """Event table of the rows whose Marker is not 0; both detectors share it."""
    rows = _oxiplex_rows(spark, path).withColumn("at", F.array_position(_filled(F.get("lines", F.col("begin"))), "Marker"))
    return _presses(rows.select("recording", F.get("cell", F.lit(1)).try_cast("double").alias("onset"), F.when(F.col("at") > 0, F.get("cell", (F.col("at") - 1).cast("int"))).try_cast("double").alias("value")))


def _presses(rows: DataFrame) -> DataFrame:
    return rows.filter("value <> 0").select("recording", "onset", F.lit(0.0).alias("duration"), "value", F.lit("button_press").alias("label"))


def _boxy_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample line: its cells, the column names, and the file's blocks."""
    data = F.filter(_after(_line("#DATA BEGINS") + 1), lambda x: ~x.startswith("#"))
    head = _files(spark, path).withColumn("data", data)
    head = head.withColumn("names", F.transform(_filled(F.get("data", F.lit(0))), lambda x: F.trim(x)))
    rows = head.select("*", F.posexplode(F.slice("data", 2, F.greatest(F.size("data") - 1, F.lit(0)))).alias("frame", "row")).withColumn("cell", _cells(F.col("row")))
    rows = rows.withColumn("cell", F.when(F.size("cell") == F.size("names"), F.col("cell")).otherwise(F.raise_error(F.lit("a row has not as many fields as the header")).cast("array<string>")))
    zero = F.get(_cells(F.get("data", F.lit(1))), (F.array_position("names", "time") - 1).cast("int")).try_cast("double")
    return rows.withColumn("t", _named(F.lit("time")) - zero)


def _named(name: Column) -> Column:
    at = F.array_position("names", name)
    found = F.when(at > 0, F.get("cell", (at - 1).cast("int"))).otherwise(F.raise_error(F.concat(F.lit("no column "), name)).cast("string"))
    return found.try_cast("double")


def boxy(spark: SparkSession, path: str, layout: str, modulation: float, calibrate: bool = False) -> DataFrame:
    """Light of an Imagent record, with its own file_distance beside the distance of the layout's
    positions. `layout` is a level 5 MATLAB file with SD and channel_map; the record holds no
    modulation frequency. `calibrate` applies the record's own terms and factors, which stored values
    normally include. A mapped channel that the record gives no distance is refused, as the two
    files then do not belong together."""
    m = matlab5(bytes(spark.read.format("binaryFile").load(layout).select("content").first()[0]))
    if "channel_map" not in m:
        raise ValueError(f"{layout} has no channel_map")
    sd, chans = m["SD"], np.ravel(m["channel_map"]).astype(int).tolist()
    lists, lam = np.atleast_2d(sd["MeasList"]).astype(int), np.ravel(sd["Lambda"])
    src, det = np.atleast_2d(sd["SrcPos"]), np.atleast_2d(sd["DetPos"])
    if len(chans) != len(lists):
        raise ValueError(f"channel_map has {len(chans)} entries for {len(lists)} measurements")

    rows = _boxy_rows(spark, path)
    letter = lambda x: F.regexp_extract(x, r"^([A-Za-z])-(?:AC|DC|Ph)\d+$", 1)
    letters = F.array_distinct(F.filter(F.transform("names", letter), lambda x: x != ""))
    one = F.when(F.size(letters) == 1, F.get(letters, F.lit(0))).otherwise(F.raise_error(F.lit("a record of one detector letter is needed")).cast("string"))
    marked = lambda block, start: F.filter(_after(_line(block)), lambda x: F.startswith(x, F.lit(start)))
    labels = F.transform(_filled(F.get(marked("#DISTANCE SETTINGS", "A-1"), F.lit(0))), lambda x: F.trim(x))
    # the row of distances is the one after the labels among the lines that hold something
    lines = _after(_line("#DISTANCE SETTINGS"))
    label_at = F.array_position(F.transform(lines, lambda x: x.startswith("A-1")), True)
    values = F.transform(_filled(F.get(lines, label_at.cast("int"))), lambda x: x.try_cast("double"))
    rows = rows.withColumns({"letter": one, "labels": labels, "values": values})
    if calibrate:
        block = _after(_line("#WF CALIBRATION VALUES"))
        tabs = lambda start: F.slice(F.split(F.get(F.filter(block, lambda x: x.startswith(start)), F.lit(0)), "\t"), 2, 10_000)
        rows = rows.withColumns({"cal": F.filter(tabs("Val Type"), lambda x: F.trim(x) != ""), "terms": tabs("Term"), "factors": tabs("Factor")})

    def column(kind: str, ch: int) -> Column:
        name = F.concat("letter", F.lit(f"-{kind}{ch}"))
        v = _named(name)
        if not calibrate:
            return v
        fix = F.get("terms" if kind == "Ph" else "factors", (F.array_position("cal", name) - 1).cast("int")).try_cast("double")
        return v + fix if kind == "Ph" else v * fix

    first: dict[int, int] = {}
    for s, d in lists[:, :2].tolist():
        first.setdefault(s, d)
    picks = []
    for ch, (s, w) in zip(chans, lists[:, [0, 3]].tolist(), strict=True):
        told = F.get("values", (F.array_position(F.transform("labels", lambda x: F.regexp_extract(x, r"-(\d+)$", 1)), str(ch)) - 1).cast("int"))
        told = F.when(F.abs(told) >= 1e-9, told).otherwise(F.raise_error(F.lit(f"the record has no distance for channel {ch}")).cast("double"))
        light = _light(column("DC", ch), column("AC", ch), column("Ph", ch), F.lit(float(modulation)))
        rho = float(np.linalg.norm(src[s - 1] - det[first[s] - 1]))
        picks.append(F.struct(F.lit(f"S{s}D{first[s]}").alias("channel"), F.lit(s).alias("source"), F.lit(first[s]).alias("detector"), F.lit(rho).alias("distance"), told.alias("file_distance"), F.lit(float(lam[w - 1])).alias("wavelength"), light.alias("light")))
    rows = rows.select("recording", F.col("frame").cast("long").alias("frame"), "t", F.explode(F.array(*picks)).alias("p")).select("recording", "frame", "t", "p.*")
    return rows.select("*", F.inline("light")).select(*LIGHT, "file_distance")


def boxy_marks(spark: SparkSession, path: str) -> DataFrame:
    """Event table of the rows whose mark is not 0; records without the column have none."""
    at = F.array_position("names", "mark")
    value = F.when(at > 0, F.get("cell", (at - 1).cast("int"))).try_cast("double")
    return _presses(_boxy_rows(spark, path).select("recording", F.col("t").alias("onset"), value.alias("value")))
