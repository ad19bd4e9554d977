"""More queries and their SQL: edits, units, regions, montages, lattices, studies, files and fits of known truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucera.functions import optics
from lucera.operators import connectivity as fc
from lucera.operators import events as ev
from lucera.operators import fits, geometry, imaging, probe, quality, results, rois, streams, td_fits, tissue
from lucera.operators.study import Study, group_connectivity, postprocess_fc
from lucera.plans import adapters as ad
from lucera.plans import queries as base
from lucera.plans.adapters import EMB, EVS, EVT
from lucera.plans.queries import EV_COLS, EXT, _PEARSON, _r, _rounded
from lucera.sources import bids, readers, shared, snirf
from lucera.streaming import blocks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, digits: int = 6):
    def put(f):
        QUERIES[name] = lambda spark, sf: _rounded(f(spark, sf), digits)
        SQL[name] = sql
        return f

    return put


# a montage from suppliers, optodes from nations, a head volume from parts ----------------


def montage(spark, sf) -> DataFrame:
    s, k = ad.read(spark, sf, "supplier"), F.col("s_suppkey")
    mm = 10 + F.abs("s_acctbal") / 500.0
    return s.select(
        k.cast("int").alias("channel"), F.col("s_nationkey").cast("int").alias("source"), (k % 7).cast("int").alias("detector"), (k % 20 * 10.0).alias("x"), (F.floor(k / 20) % 20 * 10.0).alias("y"), (k % 3 * 5.0).alias("z"),
        mm.alias("distance_mm"), (mm < 15).alias("is_short"), (F.col("s_acctbal") < 0).alias("is_bad"),
    )


MON = """mon AS (SELECT CAST(s_suppkey AS INTEGER) AS channel, CAST(s_nationkey AS INTEGER) AS source, CAST(s_suppkey % 7 AS INTEGER) AS detector, s_suppkey % 20 * 10.0::DOUBLE AS x, s_suppkey // 20 % 20 * 10.0::DOUBLE AS y,
 s_suppkey % 3 * 5.0::DOUBLE AS z, 10 + abs(s_acctbal) / 500.0::DOUBLE AS distance_mm, 10 + abs(s_acctbal) / 500.0::DOUBLE < 15 AS is_short, s_acctbal < 0 AS is_bad FROM supplier)"""


def optodes(spark, sf) -> DataFrame:
    n, k = ad.read(spark, sf, "nation"), F.col("n_nationkey")
    kinds = F.explode(F.array(F.struct(F.lit("source").alias("kind"), F.lit(0.0).alias("o")), F.struct(F.lit("detector").alias("kind"), F.lit(20.0).alias("o")))).alias("e")
    return n.select(k.cast("int").alias("idx"), "n_name", "n_regionkey", kinds).select("e.kind", "idx", (F.col("idx") % 5 * 30.0 + F.col("e.o")).alias("x"), (F.floor(F.col("idx") / 5) * 30.0).cast("double").alias("y"), (F.col("n_regionkey") * 2.0).alias("z"))


OPT = """opt AS (SELECT kind, CAST(n_nationkey AS INTEGER) AS idx, n_nationkey % 5 * 30.0::DOUBLE + o AS x, n_nationkey // 5 * 30.0::DOUBLE AS y, n_regionkey * 2.0::DOUBLE AS z FROM nation, (VALUES ('source', 0.0::DOUBLE), ('detector', 20.0::DOUBLE)) AS e(kind, o))"""


def volume(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return ad.read(spark, sf, "part").select((k % 10).cast("int").alias("i"), (F.floor(k / 10) % 10).cast("int").alias("j"), F.floor(k / 100).cast("int").alias("k"), (F.col("p_size") % 5).cast("int").alias("label"))


VOL = """vol AS (SELECT CAST(p_partkey % 10 AS INTEGER) AS i, CAST(p_partkey // 10 % 10 AS INTEGER) AS j, CAST(p_partkey // 100 AS INTEGER) AS k, CAST(p_size % 5 AS INTEGER) AS label FROM part)"""


def tissues(spark, sf) -> DataFrame:
    return ad.read(spark, sf, "region").filter("r_regionkey < 4").select(F.col("r_regionkey").cast("int").alias("label"), F.col("r_name").alias("name"))


TIS = "tis AS (SELECT CAST(r_regionkey AS INTEGER) AS label, r_name AS name FROM region WHERE r_regionkey < 4)"


# events ----------------------------------------------------------------------------------


@query("event_add", f"WITH {EVT} SELECT {EV_COLS} FROM evt UNION ALL SELECT 1, 12.5, 3.0, 7.0, 'added'")
def _(spark, sf):
    return ev.add_event(ad.event_table(spark, sf), 1, 12.5, 3.0, 7.0, "added")


_NUM = f"{EVT}, num AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY onset, label, duration, value) - 1 AS k FROM evt)"


@query("event_remove", f"WITH {_NUM} SELECT {EV_COLS}, CAST(row_number() OVER (PARTITION BY recording ORDER BY onset, label, duration, value) - 1 AS INTEGER) AS idx FROM num WHERE k <> 2")
def _(spark, sf):
    return ev.remove_event(ad.event_table(spark, sf), 2)


@query("event_update", f"WITH {_NUM} SELECT recording, {_r('onset', 'onset')}, {_r('CASE WHEN k = 0 THEN 9.0 ELSE duration END', 'duration')}, {_r('value', 'value')}, CASE WHEN k = 0 THEN 'first' ELSE label END AS label, CAST(k AS INTEGER) AS idx FROM num")
def _(spark, sf):
    return ev.update_event(ad.event_table(spark, sf), 0, duration=9.0, label="first")


@query("event_get", f"WITH {_NUM} SELECT {EV_COLS}, CAST(k AS INTEGER) AS idx FROM num WHERE k = 3")
def _(spark, sf):
    return ev.get_event(ad.event_table(spark, sf), 3)


@query("events_by_label", f"WITH {EVT} SELECT {EV_COLS} FROM evt WHERE label = 'view'")
def _(spark, sf):
    return ev.get_events_by_label(ad.event_table(spark, sf), "view")


@query("events_table", f"WITH {EVT} SELECT {EV_COLS} FROM evt")
def _(spark, sf):
    return ev.from_dataframe(ad.event_table(spark, sf).withColumn("extra", F.lit(1)))


@query("events_to_dict", f"WITH {_NUM}, f AS (SELECT recording, count(*) AS n FROM num GROUP BY 1), o AS (SELECT recording, onset, duration, label, row_number() OVER (PARTITION BY recording ORDER BY onset, duration, value, label) AS q FROM num) SELECT f.recording, n, {_r('onset', 'first_onset')}, {_r('duration', 'first_duration')}, label AS first_label FROM f JOIN o ON f.recording = o.recording AND q = 1")
def _(spark, sf):
    d = ev.to_dict(ad.event_table(spark, sf))
    return d.select("recording", F.size("onset").cast("long").alias("n"), F.col("onset")[0].alias("first_onset"), F.col("duration")[0].alias("first_duration"), F.col("label")[0].alias("first_label"))


@query("stream_slice", f"""WITH {EVT}, n AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY onset, label) - 1 AS i FROM evt),
 w AS (SELECT recording, min(CASE WHEN i = 1 THEN onset END) AS lo, min(CASE WHEN i = 6 THEN onset END) AS hi FROM n GROUP BY 1)
 SELECT evt.recording, count(*) AS n, {_r('avg(value)', 'v')} FROM evt JOIN w ON evt.recording = w.recording AND onset >= lo AND onset <= hi GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    e = ad.event_table(spark, sf)
    s = streams.slice_events(e.select("recording", F.col("onset").alias("t"), F.col("value").alias("v")), e, 1, 6)
    return s.groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"))


# streams and channels --------------------------------------------------------------------


@query("mark_bad_channels", f"WITH {MON} SELECT channel, is_bad OR channel IN (1, 5, 9) AS is_bad FROM mon")
def _(spark, sf):
    return streams.mark_bad(montage(spark, sf), [1, 5, 9]).select("channel", "is_bad")


@query("drop_channels", f"WITH {EMB}, {MON} SELECT recording, channel, frame, {_r('v', 'v')} FROM emb WHERE channel NOT IN (SELECT channel FROM mon WHERE is_bad)")
def _(spark, sf):
    return streams.drop_channels(ad.embedding_samples(spark, sf), montage(spark, sf).filter("is_bad")).select("recording", "channel", "frame", "v")


@query("mark_empty_bad", f"WITH {EMB} SELECT recording, channel, count(CASE WHEN channel % 9 <> 0 THEN v END) = 0 AS is_bad FROM emb GROUP BY 1, 2")
def _(spark, sf):
    return streams.mark_empty_bad(ad.embedding_samples(spark, sf).withColumn("v", F.when(F.col("channel") % 9 != 0, F.col("v"))))


@query("stream_wavelengths", f"WITH {EMB} SELECT recording, CASE WHEN channel % 2 = 0 THEN 690.0::DOUBLE ELSE 830.0 END AS wavelength, count(DISTINCT channel) AS n FROM emb GROUP BY 1, 2")
def _(spark, sf):
    s = ad.embedding_samples(spark, sf).withColumn("wavelength", F.when(F.col("channel") % 2 == 0, 690.0).otherwise(830.0))
    return s.groupBy("recording", "wavelength").agg(F.countDistinct("channel").alias("n"))


@query("aux_select_signal", f"WITH {EVS} SELECT recording, {_r('t', 't')}, {_r('v', 'v')} FROM evs WHERE channel = 'click'")
def _(spark, sf):
    return ad.event_samples(spark, sf).filter("channel = 'click'").select("recording", "t", "v")


# units and names -------------------------------------------------------------------------

_UNITS = ["mm", "cm", "Meters", " millimeter ", "furlong", None]
_UNIT_SQL = "CASE n_nationkey % 6 WHEN 0 THEN 'mm' WHEN 1 THEN 'cm' WHEN 2 THEN 'Meters' WHEN 3 THEN ' millimeter ' WHEN 4 THEN 'furlong' END"


def _one_of(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


@query("length_units", f"""WITH u AS (SELECT n_nationkey, {_UNIT_SQL} AS unit FROM nation), k AS (SELECT *, CASE lower(trim(unit)) WHEN 'mm' THEN 'mm' WHEN 'cm' THEN 'cm' WHEN 'meters' THEN 'm' WHEN 'millimeter' THEN 'mm' END AS norm FROM u)
 SELECT n_nationkey, norm, CASE coalesce(norm, 'mm') WHEN 'mm' THEN 1.0 WHEN 'cm' THEN 10.0 ELSE 1000.0 END::DOUBLE AS mm, CASE coalesce(norm, 'cm') WHEN 'mm' THEN 0.1 WHEN 'cm' THEN 1.0 ELSE 100.0 END::DOUBLE AS cm FROM k""")  # fmt: skip
def _(spark, sf):
    u = ad.read(spark, sf, "nation").withColumn("unit", _one_of(_UNITS, F.col("n_nationkey")))
    return u.select("n_nationkey", optics.normalize_length_unit(F.col("unit")).alias("norm"), optics.mm_per_unit(F.col("unit")).alias("mm"), optics.cm_per_unit(F.col("unit")).alias("cm"))


_MOMENT = ["counts", "s", "ps^2", " S ", "ns2", "volt", ""]


@query("moment_units", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' WHEN 2 THEN 'm2' WHEN 3 THEN 'm1' WHEN 4 THEN 'm2' WHEN 6 THEN 'm0' END AS moment FROM part")
def _(spark, sf):
    return ad.read(spark, sf, "part").select("p_partkey", optics.moment_of_unit(_one_of(_MOMENT, F.col("p_partkey"))).alias("moment"))


_NAMES = ["aDb", "aDb_1", "beta", "HbO", "HbR_2", "A", "b", "mua", "bfi_2", "t0"]
_NAME_SQL = "CASE p_partkey % 10 WHEN 0 THEN 'aDb' WHEN 1 THEN 'aDb_1' WHEN 2 THEN 'beta' WHEN 3 THEN 'HbO' WHEN 4 THEN 'HbR_2' WHEN 5 THEN 'A' WHEN 6 THEN 'b' WHEN 7 THEN 'mua' WHEN 8 THEN 'bfi_2' ELSE 't0' END"


@query("param_names", f"""WITH n AS (SELECT p_partkey, {_NAME_SQL} AS name FROM part)
 SELECT p_partkey, regexp_replace(name, '^aDb', 'bfi') AS stored, regexp_replace(name, '^bfi', 'aDb') AS named, name IN ('beta', 't0', 'sigma', 'tau', 'scale', 'offset') AS is_obs, regexp_matches(name, '^(hbo|hbr|HbO|HbR|A|b)(_[0-9]+)?$') AS is_comp FROM n""")  # fmt: skip
def _(spark, sf):
    n = ad.read(spark, sf, "part").withColumn("name", _one_of(_NAMES, F.col("p_partkey")))
    c = F.col("name")
    return n.select("p_partkey", optics.to_storage_label(c).alias("stored"), optics.from_storage_label(c).alias("named"), optics.is_observation_param(c).alias("is_obs"), optics.is_composition_param(c).alias("is_comp"))


@query("data_types", "SELECT p_partkey, CASE WHEN k <= 100 THEN 'CW' WHEN k <= 200 THEN 'FD' WHEN k <= 300 THEN 'TD_GATED' WHEN k <= 400 THEN 'TD_MOMENTS' WHEN k = 410 THEN 'DCS_BFI' WHEN k <= 500 THEN 'DCS' END AS modality FROM (SELECT p_partkey, p_size * 10 + 0 AS k FROM part)")
def _(spark, sf):
    return ad.read(spark, sf, "part").select("p_partkey", optics.datatype_modality(F.col("p_size") * 10).alias("modality"))


@query("name_entities", "SELECT c_custkey, CAST(c_custkey % 90 AS VARCHAR) AS subject, CASE WHEN c_custkey % 2 = 0 THEN 'b' || (c_custkey % 7) END AS session, 'rest' AS task, CAST(c_nationkey AS VARCHAR) AS run FROM customer")
def _(spark, sf):
    c = ad.read(spark, sf, "customer")
    ses = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("_ses-b"), (F.col("c_custkey") % 7).cast("string"))).otherwise("")
    name = F.concat(F.lit("sub-"), (F.col("c_custkey") % 90).cast("string"), ses, F.lit("_task-rest_run-"), F.col("c_nationkey").cast("string"), F.lit("_nirs.snirf"))
    return c.select("c_custkey", *readers.entities(name)).drop("rec")


@query("clean_labels", "SELECT c_custkey, 'my' || upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) || c_nationkey AS label FROM customer")
def _(spark, sf):
    c = ad.read(spark, sf, "customer")
    return c.select("c_custkey", readers.sanitise_label(F.concat(F.lit("_my-"), F.lower("c_mktsegment"), F.lit(" ("), F.col("c_nationkey").cast("string"), F.lit(")"))).alias("label"))


# optics ----------------------------------------------------------------------------------


@query("td_closed_form", """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity * 5e-11 AS t, 1.0 + l_linenumber / 4.0::DOUBLE AS rho, 0.05 + l_discount AS mua, 8.0 + l_tax * 20 AS musp FROM lineitem),
 y AS (SELECT *, 2.99792458e10 / 1.4 AS v, 1 / (3 * musp) AS d, 1 / musp AS z0 FROM x), z AS (SELECT *, 4 * d * v * t AS s, 2 * d AS zb FROM y)
 SELECT l_orderkey, l_linenumber, round(log10(v * pow(pi() * s, -1.5) * exp(-mua * v * t) * (exp(-(rho * rho + z0 * z0) / s) - exp(-(rho * rho + (z0 + 2 * zb) * (z0 + 2 * zb)) / s))), 4) AS phi FROM z""", 4)  # fmt: skip
def _(spark, sf):
    li = ad.read(spark, sf, "lineitem")
    phi = optics.td_fluence_patterson(F.col("l_quantity") * 5e-11, 1.0 + F.col("l_linenumber") / 4.0, 0.05 + F.col("l_discount"), 8.0 + F.col("l_tax") * 20, 1.4)
    return li.select("l_orderkey", "l_linenumber", F.log10(phi).alias("phi"))


@query("flow_compose", "SELECT s_suppkey, round(0.5 * s_acctbal, 6) AS bfi FROM supplier")
def _(spark, sf):
    return ad.read(spark, sf, "supplier").select("s_suppkey", optics.compose(F.lit(0.5), F.col("s_acctbal")).alias("bfi"))


@query("wave_number", "SELECT p_partkey, round(3 * a * (a + s) + (a + s) * s * pow(2 * pi() * 1.4 / 785e-7, 2) * 1e-9, 4) AS re, round(3 * (a + s) * 2 * pi() * 1.1e8 * 1.4 / 2.99792458e10, 6) AS im FROM (SELECT p_partkey, 0.05 + p_size / 500.0::DOUBLE AS a, 8.0 + p_size / 10.0::DOUBLE AS s FROM part)", 4)
def _(spark, sf):
    re, im = optics.k_squared(0.05 + F.col("p_size") / 500.0, 8.0 + F.col("p_size") / 10.0, 1.4, F.lit(785.0), 1.1e8, F.lit(1e-9))
    return ad.read(spark, sf, "part").select("p_partkey", re.alias("re"), im.alias("im"))


SQL["wave_number"] = SQL["wave_number"].replace("2.99792458e10, 6)", "2.99792458e10, 4)")


@query("quality_weight", """WITH v AS (SELECT c_custkey, c_mktsegment, c_acctbal AS x, median(c_acctbal) OVER (PARTITION BY c_mktsegment) AS m FROM customer), d AS (SELECT *, median(abs(x - m)) OVER (PARTITION BY c_mktsegment) AS mad FROM v)
 SELECT c_custkey, round(1 / (1 + exp(-(x - m) / (1.4826 * mad))), 6) AS weight FROM d""")  # fmt: skip
def _(spark, sf):
    c = ad.read(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("x"))
    m = c.join(c.groupBy("c_mktsegment").agg(F.median("x").alias("m")), "c_mktsegment")
    d = m.groupBy("c_mktsegment").agg(F.median(F.abs(F.col("x") - F.col("m"))).alias("mad"))
    return m.join(d, "c_mktsegment").select("c_custkey", optics.quality_weight(F.col("x"), F.col("m"), F.col("mad")).alias("weight"))


@query("fisher_transform", "SELECT c_custkey, round(tanh(atanh(greatest(least(c_acctbal / 9000, 0.999::DOUBLE), -0.999::DOUBLE))), 6) AS r FROM customer")
def _(spark, sf):
    return ad.read(spark, sf, "customer").select("c_custkey", optics.inverse_fisher_z(optics.fisher_z(F.col("c_acctbal") / 9000)).alias("r"))


@query("at_wavelength", f"WITH {EMB}, w AS (SELECT recording, frame, 650.0::DOUBLE + channel * 5 AS wavelength, v, abs(650.0 + channel * 5 - 803) AS off FROM emb) SELECT recording, frame, wavelength, {_r('v', 'value')} FROM w QUALIFY row_number() OVER (PARTITION BY recording, frame ORDER BY off, wavelength) = 1")
def _(spark, sf):
    s = ad.embedding_samples(spark, sf).select("recording", "frame", (650.0 + F.col("channel") * 5).cast("double").alias("wavelength"), F.col("v").alias("value"))
    return tissue.nearest_wavelength(s, 803.0, ["recording", "frame"])


@query("absorption_unmixing", f"""WITH {EMB}, p AS (SELECT recording, channel // 2 AS place, frame, max(CASE WHEN channel % 2 = 0 THEN abs(v) END) - 0.75 * 0.004 AS a, max(CASE WHEN channel % 2 = 1 THEN abs(v) END) - 0.75 * 0.02 AS b FROM emb GROUP BY 1, 2, 3)
 SELECT recording, CAST(place AS INTEGER) AS place, frame, round((0.69 * a - 2.05 * b) / (0.35::DOUBLE * 0.69 - 2.05 * 0.97) * 1e6 + 0.0::DOUBLE, 2) AS hbo, round((0.35 * b - 0.97 * a) / (0.35::DOUBLE * 0.69 - 2.05 * 0.97) * 1e6 + 0.0::DOUBLE, 2) AS hbr FROM p""", 2)  # fmt: skip
def _(spark, sf):
    s = ad.embedding_samples(spark, sf).select("recording", F.floor(F.col("channel") / 2).cast("int").alias("place"), "frame", F.when(F.col("channel") % 2 == 0, 690.0).otherwise(830.0).alias("wavelength"), F.abs("v").alias("mua"), F.lit(0.0).alias("var"))
    return tissue.absorption_to_concentration(s, EXT, {690.0: 0.004, 830.0: 0.02}).select("recording", "place", "frame", "hbo", "hbr")


@query("extinction_between", """WITH t AS (SELECT 600.0::DOUBLE + 10 * n_nationkey AS x, n_regionkey * 1.5::DOUBLE AS hbo, n_nationkey % 7 * 0.25::DOUBLE AS hbr FROM nation), q AS (SELECT * FROM (VALUES (500.0::DOUBLE), (603.0), (700.0), (777.7), (990.0)) AS v("at")),
 c AS (SELECT "at", greatest(least("at", (SELECT max(x) FROM t)), (SELECT min(x) FROM t)) AS y FROM q),
 j AS (SELECT "at", y, (SELECT max(x) FROM t WHERE x <= y) AS lo, (SELECT min(x) FROM t WHERE x >= y) AS hi FROM c)
 SELECT "at", round(a.hbo + coalesce((y - lo) / nullif(hi - lo, 0), 0) * (b.hbo - a.hbo), 6) AS hbo, round(a.hbr + coalesce((y - lo) / nullif(hi - lo, 0), 0) * (b.hbr - a.hbr), 6) AS hbr FROM j JOIN t a ON a.x = lo JOIN t b ON b.x = hi""")  # fmt: skip
def _(spark, sf):
    k = F.col("n_nationkey")
    t = ad.read(spark, sf, "nation").select((600.0 + 10 * k).cast("double").alias("lambda"), (F.col("n_regionkey") * 1.5).alias("hbo"), (k % 7 * 0.25).alias("hbr"))
    return tissue.interpolated(t, [500.0, 603.0, 700.0, 777.7, 990.0])


# quality and connectivity ------------------------------------------------------------------


@query("combine_sci_psp", f"WITH {EMB} SELECT recording, channel, {_r('avg(CASE WHEN v * 6 > 0.8 OR abs(v) > 0.1 THEN 1 ELSE 0 END)', 'frac_good')} FROM emb GROUP BY 1, 2")
def _(spark, sf):
    w = ad.embedding_samples(spark, sf).select("recording", "channel", (F.col("v") * 6).alias("sci"), F.abs("v").alias("psp"))
    return quality.combine(w, ["recording", "channel"])


@query("poolable", "SELECT count(DISTINCT c_mktsegment) <= 1 AS same_units, coalesce((max(n) - min(n)) / nullif(max(n), 0) <= 0.1, true) AS same_n_eff FROM (SELECT c_mktsegment, count(*)::DOUBLE AS n FROM customer GROUP BY 1)")
def _(spark, sf):
    return fc.check_poolable(ad.read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("units")).agg(F.count(F.lit(1)).cast("double").alias("n_eff")))


@query("fc_table", f"WITH {_PEARSON} SELECT recording, ch_i, ch_j, {_r('value', 'value')}, {_r('atanh(greatest(least(value, 0.999::DOUBLE), -0.999::DOUBLE))', 'z')} FROM fc")
def _(spark, sf):
    return fc.to_dataframe(fc.pearson(ad.embedding_samples(spark, sf)).drop("n"))


_FC_LABEL = f"{_PEARSON}, fl AS (SELECT recording, label, ch_i, ch_j, corr(x, y) AS c FROM pr GROUP BY 1, 2, 3, 4)"


@query("fc_reduce", f"WITH {_FC_LABEL} SELECT recording, ch_i, ch_j, {_r('max(CASE WHEN isnan(c) THEN NULL ELSE c END)', 'value')} FROM fl WHERE label BETWEEN 2 AND 6 GROUP BY 1, 2, 3")
def _(spark, sf):
    s = ad.embedding_samples(spark, sf).filter(F.col("label").between(2, 6))  # as in reduce: other labels need no pairs
    return postprocess_fc(fc.pearson(s, ["recording", "label"], within=["recording"]), {"axis": "label", "lo": 2, "hi": 6, "how": "max"})


@query("fc_group", f"WITH {_PEARSON} SELECT ch_i, ch_j, {_r('tanh(avg(atanh(greatest(least(value, 0.999::DOUBLE), -0.999::DOUBLE))))', 'value')}, count(value) AS n FROM fc GROUP BY 1, 2")
def _(spark, sf):
    return group_connectivity(fc.pearson(ad.embedding_samples(spark, sf)))


@query("graph_degree", f"WITH {base._GRAPH} SELECT recording, node, degree FROM d")
def _(spark, sf):
    return fc.degree(fc.threshold(fc.pearson(ad.embedding_samples(spark, sf)), "sparsity", 0.5, by=["recording"]), ["recording"])


@query("fc_effective_samples", f"""WITH {EMB}, c AS (SELECT recording, channel, frame, v - avg(v) OVER (PARTITION BY recording, channel) AS c FROM emb), s AS (SELECT recording, channel, sum(c * c) AS ss, count(*) AS n FROM c GROUP BY 1, 2),
 r AS (SELECT a.recording, a.channel, b.frame - a.frame AS k, sum(a.c * b.c) AS p FROM c a JOIN c b ON a.recording = b.recording AND a.channel = b.channel AND b.frame - a.frame BETWEEN 1 AND {ad.FRAMES // 5} GROUP BY 1, 2, 3),
 q AS (SELECT r.recording, r.channel, k, p / ss AS rho, n FROM r JOIN s ON r.recording = s.recording AND r.channel = s.channel WHERE k <= n // 5)
 SELECT a.recording, a.channel AS ch_i, b.channel AS ch_j, round(greatest(2.0, least(a.n, a.n / (1 + 2 * sum(a.rho * b.rho * (1 - a.k / (a.n // 5 + 1.0::DOUBLE)))))), 4) AS value FROM q a JOIN q b ON a.recording = b.recording AND a.k = b.k AND a.channel < b.channel GROUP BY 1, 2, 3, a.n""", 4)  # fmt: skip
def _(spark, sf):
    from lucera.operators import inference

    return inference.pairwise(ad.embedding_samples(spark, sf).drop("label"), "n_eff", 10.0)


@query("cluster_runs", f"""WITH {EMB}, t AS (SELECT recording, channel, frame, v * 10 AS t FROM emb), m AS (SELECT recording, channel, frame, 1 AS sign, t FROM t WHERE t > 1 UNION ALL SELECT recording, channel, frame, -1, t FROM t WHERE -t > 1),
 g AS (SELECT *, frame - row_number() OVER (PARTITION BY recording, channel, sign ORDER BY frame) AS g FROM m)
 SELECT recording, channel AS contrast, sign, count(*) AS size, {_r('sum(sign * t - 1)', 'statistic')}, {_r('arg_max(t, sign * t)', 'peak_t')} FROM g GROUP BY recording, channel, sign, g""")  # fmt: skip
def _(spark, sf):
    from lucera.plans import estimators

    return estimators.cluster_table(spark, sf).select("recording", "contrast", "sign", "size", "statistic", "peak_t")


@query("fc_cross_pearson", f"WITH {EMB} SELECT a.recording, a.channel AS ch_i, b.channel AS ch_j, {_r('corr(a.v, b.v)', 'value')} FROM emb a JOIN emb b ON a.recording = b.recording AND a.frame = b.frame WHERE a.channel < 4 AND b.channel >= 4 GROUP BY 1, 2, 3")
def _(spark, sf):
    from lucera.operators import inference

    s = ad.embedding_samples(spark, sf).drop("label")
    return inference.pairwise(s.filter("channel < 4"), "pearson", 10.0, other=s.filter("channel >= 4"))


@query("fc_frobenius", f"""WITH {EMB}, h AS (SELECT recording, channel, frame, v, frame < {ad.FRAMES // 2} AS early FROM emb), c AS (SELECT a.recording, a.early, a.channel AS i, b.channel AS j, corr(a.v, b.v) AS r FROM h a JOIN h b ON a.recording = b.recording AND a.frame = b.frame AND a.channel < b.channel GROUP BY 1, 2, 3, 4)
 SELECT x.recording, {_r('sqrt(2 * sum(pow(x.r - y.r, 2)))', 'distance')} FROM c x JOIN c y ON x.recording = y.recording AND x.i = y.i AND x.j = y.j AND x.early AND NOT y.early GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    from lucera.operators import inference

    s = ad.embedding_samples(spark, sf)
    half = lambda c: fc.pearson(s.filter(c)).drop("n")
    return inference.distance(half(F.col("frame") < ad.FRAMES // 2), half(F.col("frame") >= ad.FRAMES // 2), "frobenius")


@query("glm_ols", f"WITH {EMB} SELECT recording, channel, {_r('regr_slope(v, frame / 100.0::DOUBLE)', 'beta')}, {_r('sqrt((regr_syy(v, frame / 100.0::DOUBLE) - pow(regr_sxy(v, frame / 100.0::DOUBLE), 2) / regr_sxx(v, frame / 100.0::DOUBLE)) / (count(v) - 2) / regr_sxx(v, frame / 100.0::DOUBLE))', 'se')}, count(v) - 2 AS df FROM emb GROUP BY 1, 2")
def _(spark, sf):
    import numpy as np

    from lucera.operators import series

    design = pd.DataFrame({"one": np.ones(ad.FRAMES), "trend": np.arange(ad.FRAMES) / 100.0})
    return series.glm(ad.embedding_samples(spark, sf).drop("label"), design, "ols").filter("regressor = 'trend'").select("recording", "channel", "beta", "se", "df")


@query("sign_flip_p", base.SQL["sign_flip_null"].rsplit("SELECT grp, flip,", 1)[0] + ", n AS (SELECT grp, flip, m / (sd / sqrt(n)) AS t FROM t), o AS (SELECT grp, abs(t) AS o FROM n WHERE flip = 0) SELECT n.grp, round(avg(CASE WHEN abs(t) >= o - 1e-9 THEN 1 ELSE 0 END), 6) AS p_val FROM n JOIN o ON n.grp = o.grp GROUP BY 1")
def _(spark, sf):
    from lucera.operators import group

    e = ad.subject_effects(spark, sf).select("grp", "subject", (F.col("beta") - 140).alias("beta"))
    return group.p_of_null(group.sign_flip_t(e, ["grp"], 200), ["grp"])


@query("stim_matrix", f"WITH {EMB}, f AS (SELECT DISTINCT recording, frame FROM emb), c AS (VALUES (0), (1)) SELECT recording, 'marker_' || k AS condition, frame, CASE WHEN frame % 40 = 0 AND frame % 80 // 40 = k THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM f, c AS c(k)")
def _(spark, sf):
    frames = ad.embedding_samples(spark, sf).filter("channel = 0").select("recording", "frame", "t")
    marks = frames.filter("frame % 40 = 0").select("recording", "frame", F.floor(F.col("frame") % 80 / 40).cast("int").alias("marker"))
    return readers.stim_samples(marks, frames, [0, 1]).select("recording", "condition", "frame", "v")


@query("short_detectors", f"WITH {MON} SELECT channel, detector >= 5 AS is_short, CASE WHEN detector >= 5 THEN 4 + source ELSE detector END AS detector FROM mon")
def _(spark, sf):
    return readers.remap_short_detectors(montage(spark, sf), 5).select("channel", "is_short", "detector")


# montages and regions ----------------------------------------------------------------------


@query("channel_table", f"""WITH {MON}, {OPT}, c AS (SELECT channel, source, detector FROM mon), j AS (SELECT channel, 'S' || c.source || 'D' || c.detector AS label, s.x AS sx, s.y AS sy, s.z AS sz, d.x AS dx, d.y AS dy, d.z AS dz FROM c JOIN opt s ON s.kind = 'source' AND s.idx = c.source JOIN opt d ON d.kind = 'detector' AND d.idx = c.detector)
 SELECT channel, label, {_r('(sx + dx) / 2', 'x')}, {_r('(sy + dy) / 2', 'y')}, {_r('(sz + dz) / 2', 'z')}, {_r('sqrt(pow(sx - dx, 2) + pow(sy - dy, 2) + pow(sz - dz, 2))', 'distance_mm')}, sqrt(pow(sx - dx, 2) + pow(sy - dy, 2) + pow(sz - dz, 2)) < 15 AS is_short FROM j""")  # fmt: skip
def _(spark, sf):
    return probe.channel_table(montage(spark, sf).select("channel", "source", "detector"), optodes(spark, sf)).select("channel", "label", "x", "y", "z", "distance_mm", "is_short")


@query("list_short_channels", f"WITH {MON} SELECT channel, 'S' || source || 'D' || detector AS label FROM mon WHERE distance_mm < 16")
def _(spark, sf):
    return geometry.listed(montage(spark, sf), 16.0, "short").select("channel", geometry.channel_label(F.col("source"), F.col("detector")).alias("label"))


@query("list_long_channels", f"WITH {MON} SELECT channel, {_r('distance_mm', 'distance_mm')} FROM mon WHERE distance_mm >= 16")
def _(spark, sf):
    return geometry.listed(montage(spark, sf), 16.0, "long").select("channel", "distance_mm")


@query("probe_info", f"WITH {MON} SELECT count(*) AS n_channels, count(DISTINCT source) AS n_sources, count(DISTINCT detector) AS n_detectors, count(*) FILTER (WHERE is_short) AS n_short, {_r('min(distance_mm)', 'min_mm')}, {_r('max(distance_mm)', 'max_mm')}, {_r('avg(distance_mm)', 'mean_mm')} FROM mon")
def _(spark, sf):
    return geometry.info(montage(spark, sf))


@query("probe_union", f"WITH {MON} SELECT channel, {_r('CASE WHEN channel % 2 = 0 THEN x ELSE x + 1 END', 'x')} FROM mon")
def _(spark, sf):
    m = montage(spark, sf)
    return probe.union([m.filter("channel % 2 = 0"), m.withColumn("x", F.col("x") + 1)]).select("channel", "x")


@query("flat_coordinates", f"WITH {MON}, p AS (SELECT channel, x, y, sqrt(x * x + y * y + z * z) AS r, sqrt(x * x + y * y) AS s, z FROM mon) SELECT channel, {_r('x * coalesce(r * acos(z / nullif(r, 0)) / nullif(s, 0), 0)', 'u')}, {_r('y * coalesce(r * acos(z / nullif(r, 0)) / nullif(s, 0), 0)', 'v')} FROM p")
def _(spark, sf):
    return geometry.flat(montage(spark, sf), "azimuthal").select("channel", "u", "v")


def _regions(spark, sf):
    return montage(spark, sf).select(F.concat(F.lit("n"), F.col("source").cast("string")).alias("roi"), "channel")


REG = f"{MON}, reg AS (SELECT 'n' || source AS roi, channel FROM mon)"


@query("roi_add", f"WITH {REG} SELECT roi, channel FROM reg WHERE roi <> 'n3' UNION ALL SELECT 'n3', channel FROM mon WHERE channel IN (1, 2, 4, 999999)")
def _(spark, sf):
    return rois.add(_regions(spark, sf), montage(spark, sf), "n3", [1, 2, 4, 999999])


@query("roi_rename", f"WITH {REG} SELECT CASE WHEN roi = 'n5' THEN 'renamed' ELSE roi END AS roi, channel FROM reg")
def _(spark, sf):
    return rois.rename(_regions(spark, sf), "n5", "renamed")


@query("roi_mask", f"WITH {REG} SELECT channel, source = 7 AS is_member FROM mon")
def _(spark, sf):
    return rois.mask(_regions(spark, sf), montage(spark, sf), "n7")


@query("roi_list", f"WITH {REG} SELECT roi, count(*) AS n, string_agg(CAST(channel AS VARCHAR), ' ' ORDER BY channel) AS channels FROM reg GROUP BY roi")
def _(spark, sf):
    return rois.listed(_regions(spark, sf))


@query("roi_by_landmark", f"WITH {MON}, l AS (SELECT n_nationkey % 5 * 30.0::DOUBLE AS x, n_nationkey // 5 * 30.0::DOUBLE AS y, 5.0::DOUBLE AS z FROM nation WHERE n_nationkey = 6) SELECT 'near' AS roi, channel FROM mon, l WHERE sqrt(pow(mon.x - l.x, 2) + pow(mon.y - l.y, 2) + pow(mon.z - l.z, 2)) <= 90")
def _(spark, sf):
    k = F.col("n_nationkey")
    marks = ad.read(spark, sf, "nation").select(F.concat(F.lit("L"), k.cast("string")).alias("label"), (k % 5 * 30.0).alias("x"), (F.floor(k / 5) * 30.0).cast("double").alias("y"), F.lit(5.0).alias("z"))
    return rois.by_landmark(montage(spark, sf), marks, "near", "L6", 90.0)


@query("roi_resolve", f"WITH {MON} SELECT CASE WHEN is_short THEN 'short' ELSE 'long' END AS roi, channel FROM mon")
def _(spark, sf):
    return rois.resolve(spark, lambda ch: ch.select(F.when(F.col("is_short"), "short").otherwise("long").alias("roi"), "channel"), montage(spark, sf))


@query("roi_stream", f"WITH {EMB}, {REG} SELECT recording, frame, roi, {_r('avg(v)', 'v')}, count(v) AS n FROM emb JOIN reg ON emb.channel = reg.channel GROUP BY 1, 2, 3")
def _(spark, sf):
    return rois.roi_values(ad.embedding_samples(spark, sf), _regions(spark, sf), ["recording", "frame"])


@query("align_to_channels", f"WITH {EMB}, {MON}, m AS (SELECT channel, avg(v) AS value FROM emb GROUP BY 1) SELECT mon.channel, CAST(row_number() OVER (ORDER BY mon.channel) - 1 AS INTEGER) AS position, {_r('value', 'value')} FROM mon LEFT JOIN m ON mon.channel = m.channel")
def _(spark, sf):
    return rois.align_to_channels(ad.embedding_samples(spark, sf).groupBy("channel").agg(F.avg("v").alias("value")), montage(spark, sf))


@query("channels_by_source", f"WITH {MON} SELECT source, string_agg(CAST(channel AS VARCHAR), ' ' ORDER BY channel) AS channels, count(*) AS n, {_r('avg(distance_mm)', 'mean_mm')} FROM mon GROUP BY 1")
def _(spark, sf):
    return rois.cluster_by_source(montage(spark, sf))


# lattices and volumes ----------------------------------------------------------------------


@query("voxel_axes", f"""WITH {MON}, e AS (SELECT min(x) - 10 AS lx, max(x) + 10 AS hx, min(y) - 10 AS ly, max(y) + 10 AS hy, min(z) - 20 AS lz, min(z) AS hz FROM mon)
 SELECT axis, CAST(floor((hi - lo) / 5 + 1e-9) + 1 AS BIGINT) AS cells, {_r('lo', 'low')}, {_r('lo + 5 * floor((hi - lo) / 5 + 1e-9)', 'high')} FROM (SELECT 'i' AS axis, lx AS lo, hx AS hi FROM e UNION ALL SELECT 'j', ly, hy FROM e UNION ALL SELECT 'k', lz, hz FROM e)""")  # fmt: skip
def _(spark, sf):
    return geometry.full_axes(geometry.field_of_view(montage(spark, sf), 5.0, 20.0))


_LAT = f"{VOL}, lat AS (SELECT *, i * 4.0::DOUBLE AS x, j * 4.0::DOUBLE AS y, k * 4.0::DOUBLE AS z, i * 1000000 + j * 10000 + k AS voxel FROM vol)"


def _lattice(spark, sf):
    v = volume(spark, sf)
    return v.select("*", *[(F.col(a) * 4.0).alias(c) for a, c in zip("ijk", "xyz", strict=True)], (F.col("i") * 1000000 + F.col("j") * 10000 + F.col("k")).alias("voxel"))


@query("voxels_near_surface", f"WITH {_LAT}, {OPT} SELECT voxel FROM lat WHERE EXISTS (SELECT 1 FROM opt WHERE pow(lat.x - opt.x, 2) + pow(lat.y - opt.y, 2) + pow(lat.z - opt.z, 2) <= 36)")
def _(spark, sf):
    return geometry.restrict_to_surface(_lattice(spark, sf), optodes(spark, sf), 6.0).select("voxel")


@query("voxel_depths", f"WITH {_LAT} SELECT voxel, {_r('-((x - 1) * 0.6 + (z - 2) * 0.8)', 'depth_mm')} FROM lat")
def _(spark, sf):
    return geometry.depth_below(_lattice(spark, sf), (1.0, 0.0, 2.0), (0.6, 0.0, 0.8)).select("voxel", "depth_mm")


@query("voxels_restricted", f"WITH {_LAT} SELECT voxel, label FROM lat WHERE label = 2")
def _(spark, sf):
    v = _lattice(spark, sf)
    return geometry.restrict(v, v.filter("label = 2"), ["i", "j", "k", "label"]).select("voxel", "label")


@query("tissue_mask", f"WITH {VOL}, {TIS} SELECT i, j, k, vol.label FROM vol JOIN tis ON vol.label = tis.label WHERE lower(name) IN ('asia', 'europe')")
def _(spark, sf):
    return geometry.tissue_mask(volume(spark, sf), tissues(spark, sf), ["Asia", "EUROPE"]).select("i", "j", "k", "label")


@query("tissue_names", f"WITH {VOL}, {TIS} SELECT vol.label, coalesce(any_value(name), 'label_' || vol.label) AS name, count(*) AS n FROM vol LEFT JOIN tis ON vol.label = tis.label GROUP BY vol.label")
def _(spark, sf):
    return geometry.tissue_names(volume(spark, sf), tissues(spark, sf))


def _optical_table(spark, sf):
    n = ad.read(spark, sf, "nation").join(ad.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("name"), (650.0 + F.col("n_nationkey") % 4 * 50).cast("double").alias("wavelength")).agg(F.avg("n_nationkey").alias("mua"), F.max("n_nationkey").cast("double").alias("musp"))


_OPTAB = "ot AS (SELECT r_name AS name, 650.0::DOUBLE + n_nationkey % 4 * 50 AS wavelength, avg(n_nationkey) AS mua, max(n_nationkey)::DOUBLE AS musp FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"


@query("tissue_properties", f"WITH {TIS}, {_OPTAB}, w AS (SELECT arg_min(wavelength, abs(wavelength - 690) * 1e6 + wavelength) AS w FROM ot) SELECT label, tis.name, wavelength, {_r('mua', 'mua')}, {_r('musp', 'musp')} FROM tis JOIN ot ON tis.name = ot.name JOIN w ON wavelength = w")
def _(spark, sf):
    return geometry.tissue_properties(tissues(spark, sf), _optical_table(spark, sf), 690.0)


@query("nearest_tabulated", f"WITH {_OPTAB} SELECT arg_min(wavelength, abs(wavelength - 778) * 1e6 + wavelength) AS wavelength FROM ot")
def _(spark, sf):
    return geometry.nearest_tabulated(_optical_table(spark, sf), 778.0)


@query("tissue_depth", f"WITH {VOL}, t AS (SELECT *, max(k) OVER (PARTITION BY i, j) AS top FROM vol WHERE label <> 0) SELECT i, j, k, {_r('(top - k) * 2.0', 'depth_mm')} FROM t")
def _(spark, sf):
    return geometry.tissue_depth(volume(spark, sf), 0, 2.0).select("i", "j", "k", "depth_mm")


@query("labels_at_points", f"WITH {VOL}, {MON}, p AS (SELECT channel, CAST(round_even((x - 1) / 20, 0) AS INTEGER) AS i, CAST(round_even((y - 1) / 20, 0) AS INTEGER) AS j, CAST(round_even((z - 1) / 20, 0) AS INTEGER) AS k FROM mon) SELECT channel, coalesce(label, 0) AS label FROM p LEFT JOIN vol ON p.i = vol.i AND p.j = vol.j AND p.k = vol.k")
def _(spark, sf):
    return imaging.labels_at(montage(spark, sf), volume(spark, sf), 20.0, (1.0, 1.0, 1.0)).select("channel", "label")


@query("surface_projection", f"""WITH {MON}, {OPT}, h AS (SELECT CASE WHEN kind = 'source' THEN idx ELSE idx + 100 END AS vertex, distance_mm AS value, sqrt(pow(mon.x - opt.x, 2) + pow(mon.y - opt.y, 2) + pow(mon.z - opt.z, 2)) AS d FROM opt JOIN mon ON abs(mon.x - opt.x) <= 15 AND abs(mon.y - opt.y) <= 15)
 SELECT vertex, {_r('sum(value * exp(-d * d / (2 * pow(10 / sqrt(8 * ln(2)), 2)))) / sum(exp(-d * d / (2 * pow(10 / sqrt(8 * ln(2)), 2))))', 'value')} FROM h WHERE d <= 15 GROUP BY vertex""")  # fmt: skip
def _(spark, sf):
    vertices = optodes(spark, sf).select(F.when(F.col("kind") == "source", F.col("idx")).otherwise(F.col("idx") + 100).alias("vertex"), "x", "y", "z")
    return imaging.project_to_surface(montage(spark, sf).select("x", "y", "z", F.col("distance_mm").alias("value")), vertices, 15.0)


@query("rigid_move", f"WITH {MON} SELECT channel, {_r('0.6 * x - 0.8 * y + 1', 'x')}, {_r('0.8 * x + 0.6 * y + 2', 'y')}, {_r('z + 3', 'z')} FROM mon")
def _(spark, sf):
    import numpy as np

    # a move known from four points of the montage's space and where they went
    a = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 0], [0, 0, 10]], float)
    turn = np.array([[0.6, -0.8, 0], [0.8, 0.6, 0], [0, 0, 1]])
    found = imaging.rigid_fit(a, a @ turn.T + [1, 2, 3])
    return montage(spark, sf).withColumns(imaging.moved(found[0], found[1])).select("channel", "x", "y", "z")


@query("sensitivity_restricted", f"WITH {base._SENS}, c AS (SELECT voxel, min(c) AS c FROM (SELECT wavelength, voxel, sum(value * value) AS c FROM sens GROUP BY 1, 2) GROUP BY voxel) SELECT voxel, count(*) AS n FROM sens WHERE voxel IN (SELECT voxel FROM c WHERE c > (SELECT max(c) FROM c) * 0.5) GROUP BY voxel")
def _(spark, sf):
    return probe.restrict_to_coverage(base._sens(spark, sf), 0.5).groupBy("voxel").agg(F.count(F.lit(1)).alias("n"))


@query("head_landmarks", f"""WITH {MON} SELECT 'nasion' AS label, x, y, z FROM mon QUALIFY row_number() OVER (ORDER BY y DESC, channel) = 1 UNION ALL SELECT 'inion', x, y, z FROM mon QUALIFY row_number() OVER (ORDER BY y, channel) = 1 UNION ALL
 SELECT 'lpa', x, y, z FROM mon QUALIFY row_number() OVER (ORDER BY x, channel) = 1 UNION ALL SELECT 'rpa', x, y, z FROM mon QUALIFY row_number() OVER (ORDER BY x DESC, channel) = 1 UNION ALL SELECT 'cz', x, y, z FROM mon QUALIFY row_number() OVER (ORDER BY z DESC, channel) = 1""")  # fmt: skip
def _(spark, sf):
    return geometry.landmark_cues(montage(spark, sf).withColumnRenamed("channel", "vertex"))


# blocks ------------------------------------------------------------------------------------


def _ticks(spark, sf):
    return ad.read(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), F.col("value").alias("v"))


@query("tumbling_blocks", f"SELECT event_type AS channel, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, {_r('avg(value)', 'v')}, count(value) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return blocks.block_average(_ticks(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("session_blocks", f"""WITH a AS (SELECT event_type AS channel, ts, value, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS d FROM events), b AS (SELECT *, sum(CASE WHEN d >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a)
 SELECT channel, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, {_r('avg(value)', 'v')}, count(value) AS n FROM b GROUP BY channel, g""")  # fmt: skip
def _(spark, sf):
    return blocks.gap_sessions(_ticks(spark, sf)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


# results and studies -----------------------------------------------------------------------


@query("results_table", "WITH g AS (SELECT c_mktsegment, avg(c_acctbal) AS beta, stddev_samp(c_acctbal) / sqrt(count(*)) AS se FROM customer GROUP BY 1) SELECT c_mktsegment, 'beta' AS statistic, round(beta, 6) AS value FROM g UNION ALL SELECT c_mktsegment, 'se', round(se, 6) FROM g")
def _(spark, sf):
    g = ad.read(spark, sf, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("beta"), (F.stddev_samp("c_acctbal") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return results.to_table(g, ["c_mktsegment"])


@query("results_round_trip", "SELECT s_suppkey, round(s_acctbal * s_acctbal, 6) AS var FROM supplier")
def _(spark, sf):
    path = shared.new_folder(spark, "results")
    results.save(results.with_variance_p(ad.read(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("se"))), path, {"method": "none"}, ["made"])
    df, attributes, history = results.load(spark, path)
    assert attributes == {"method": "none"} and history == ["made"]
    return df.select("s_suppkey", "var")


def _study(spark, sf) -> Study:
    """Recordings of the embedding stream, two to a subject; metadata from their number."""
    s = ad.embedding_samples(spark, sf).drop("label")
    meta = s.select("recording").distinct().select("recording", F.floor(F.col("recording") / 2).cast("long").alias("subject"), (F.col("recording") % 2).cast("int").alias("run"), F.lit("rest").alias("task"), F.lit(None).cast("string").alias("session"), (20.0 + F.col("recording")).alias("age"))
    return Study(spark, meta, {"raw": s}, channels=montage(spark, sf))


@query("study_select", f"WITH {EMB} SELECT recording, count(*) AS n FROM emb WHERE recording % 2 = 1 AND 20 + recording >= 21 GROUP BY 1")
def _(spark, sf):
    return _study(spark, sf).select({"run": 1, "age": (">=", 21)}).get_stream("raw").groupBy("recording").agg(F.count(F.lit(1)).alias("n"))


@query("study_preprocess", f"WITH {EMB}, f AS (SELECT recording, channel, regr_slope(2 * v, frame) AS b, avg(2 * v) AS m, avg(frame) AS c FROM emb GROUP BY 1, 2) SELECT emb.recording, emb.channel, frame, {_r('2 * v - b * (frame - c)', 'v')} FROM emb JOIN f ON emb.recording = f.recording AND emb.channel = f.channel WHERE emb.channel NOT IN (3, 4)")
def _(spark, sf):
    return _study(spark, sf).preprocess("raw", [("scale", {"by": 2.0}), ("detrend", {}), ("drop_channels", {"labels": [3, 4]})]).get_stream("raw").select("recording", "channel", "frame", "v")


_FIT = f"""{EMB}, fr AS (SELECT DISTINCT recording, frame FROM emb), des AS (SELECT recording, frame, 'wave' AS regressor, cos(frame / 20.0::DOUBLE) AS x FROM fr UNION ALL SELECT recording, frame, 'trend', frame / 100.0::DOUBLE FROM fr),
 fit AS (SELECT emb.recording, channel, regressor, regr_slope(v, x) AS beta, count(v) - 2 AS df, sqrt(greatest(0, regr_syy(v, x) - pow(regr_sxy(v, x), 2) / regr_sxx(v, x)) / (count(v) - 2) / regr_sxx(v, x)) AS se FROM emb JOIN des ON emb.recording = des.recording AND emb.frame = des.frame GROUP BY 1, 2, 3)"""


def _two(spark, sf):
    fr = ad.embedding_samples(spark, sf).select("recording", "frame").distinct()
    cells = F.array(F.struct(F.lit("wave").alias("regressor"), F.cos(F.col("frame") / 20.0).alias("x")), F.struct(F.lit("trend").alias("regressor"), (F.col("frame") / 100.0).alias("x")))
    return fr.select("recording", "frame", F.explode(cells).alias("r")).select("recording", "frame", "r.regressor", "r.x")


@query("study_glm", f"WITH {_FIT} SELECT recording, channel, regressor, {_r('beta', 'beta')}, df, {_r('se', 'se')}, round(beta / se + 0.0::DOUBLE, 5) AS t_stat FROM fit")
def _(spark, sf):
    return _study(spark, sf).glm_by_tables("raw", _two(spark, sf)).withColumn("t_stat", F.round("t_stat", 5))


@query("study_glm_subjects", f"WITH {_FIT} SELECT recording // 2 AS subject, channel, regressor, {_r('avg(beta)', 'beta')}, {_r('sqrt(avg(se * se) / count(beta))', 'se')}, CAST(sum(df) AS BIGINT) AS df, count(beta) AS n, round(avg(beta) / sqrt(avg(se * se) / count(beta)) + 0.0::DOUBLE, 5) AS t_stat FROM fit GROUP BY 1, 2, 3")
def _(spark, sf):
    return _study(spark, sf).glm_by_tables("raw", _two(spark, sf), average_runs=True).withColumn("t_stat", F.round("t_stat", 5))


@query("study_group_stats", f"WITH {_FIT} SELECT channel, regressor, count(beta) AS n_subjects, {_r('avg(beta)', 'beta')}, {_r('stddev_samp(beta) / sqrt(count(beta) + 1e-10)', 'se')}, round(CASE WHEN count(beta) >= 2 THEN avg(beta) / (stddev_samp(beta) / sqrt(count(beta) + 1e-10) + 1e-10) END + 0.0::DOUBLE, 4) AS t_stat, count(beta) - 1 AS df FROM fit GROUP BY 1, 2")
def _(spark, sf):
    study = _study(spark, sf)
    return study.group_stats(study.glm_by_tables("raw", _two(spark, sf)), "simple").withColumn("t_stat", F.round("t_stat", 4))


_Z = "atanh(greatest(least(value, 0.999::DOUBLE), -0.999::DOUBLE))"


@query("study_fc", f"WITH {_PEARSON} SELECT recording // 2 AS subject, ch_i, ch_j, {_r(f'tanh(avg({_Z}))', 'value')} FROM fc GROUP BY 1, 2, 3")
def _(spark, sf):
    return _study(spark, sf).run_fc("raw", average_runs=True)


@query("study_fc_roi", f"""WITH {_PEARSON}, {REG}, u AS (SELECT recording, ch_i, ch_j, {_Z} AS z FROM fc UNION ALL SELECT recording, ch_j, ch_i, {_Z} FROM fc), p AS (SELECT recording, a.roi AS roi_i, b.roi AS roi_j, ch_i, ch_j, z FROM u JOIN reg a ON a.channel = ch_i JOIN reg b ON b.channel = ch_j WHERE a.roi < b.roi OR (a.roi = b.roi AND ch_i < ch_j))
 SELECT recording, roi_i, roi_j, {_r('tanh(avg(z))', 'value')}, {_r('sqrt(greatest(0, avg(z * z) - avg(z) * avg(z)))', 'sd')}, count(z) AS n_pairs, count(DISTINCT ch_i) AS n_channels_i, count(DISTINCT ch_j) AS n_channels_j FROM p GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, sf):
    return _study(spark, sf).run_fc("raw", roi=lambda ch: ch.select(F.concat(F.lit("n"), F.col("source").cast("string")).alias("roi"), "channel"))


@query("study_fc_segments", f"""WITH {EMB}, seg AS (SELECT DISTINCT recording, CASE WHEN k = 2 THEN 'b' ELSE 'a' END AS label, k * 8.0::DOUBLE AS a, k * 8.0 + 5 AS b FROM emb, (VALUES (0), (1), (2)) AS s(k)),
 pr AS (SELECT x.recording, seg.label, a, x.channel AS ch_i, y.channel AS ch_j, corr(x.v, y.v) AS c FROM emb x JOIN emb y ON x.recording = y.recording AND x.frame = y.frame AND x.channel < y.channel JOIN seg ON x.recording = seg.recording AND x.t BETWEEN a AND b GROUP BY 1, 2, 3, 4, 5)
 SELECT recording, label, ch_i, ch_j, {_r('tanh(avg(atanh(greatest(least(c, 0.999::DOUBLE), -0.999::DOUBLE))))', 'value')} FROM pr GROUP BY 1, 2, 3, 4""")  # fmt: skip
def _(spark, sf):
    study = _study(spark, sf)
    rows = F.explode(F.array(*[F.struct((F.lit(k) * 8.0).alias("onset"), F.lit(5.0).alias("duration"), F.lit("b" if k == 2 else "a").alias("label")) for k in range(3)])).alias("e")
    return study.run_fc("raw", segments=study.meta.select("recording", rows).select("recording", "e.*"))


@query("study_blocks", f"WITH {EMB}, f AS (SELECT recording, channel, min(t) AS t0 FROM emb GROUP BY 1, 2) SELECT emb.recording, emb.channel, CAST(floor((t - t0) / 5) AS BIGINT) AS block, {_r('avg(v)', 'v')}, {_r('avg(t)', 't')}, count(v) AS n FROM emb JOIN f ON emb.recording = f.recording AND emb.channel = f.channel GROUP BY 1, 2, 3")
def _(spark, sf):
    return _study(spark, sf).block_average("raw", 5.0)


@query("study_save_load", f"WITH {EMB} SELECT recording, recording // 2 AS subject, count(*) AS n, {_r('sum(v)', 'v')} FROM emb GROUP BY 1")
def _(spark, sf):
    path = shared.new_folder(spark, "study")
    _study(spark, sf).save(path)
    back = Study.load(spark, path)
    return back.get_stream("raw").join(back.meta, "recording").groupBy("recording", "subject").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query("study_add_session", f"WITH {EMB} SELECT recording, count(*) AS n FROM emb GROUP BY 1 UNION ALL SELECT recording + 1000, count(*) FROM emb WHERE channel < 5 GROUP BY 1")
def _(spark, sf):
    a = _study(spark, sf)
    later = lambda df: df.withColumn("recording", F.col("recording") + 1000)
    b = Study(spark, later(a.meta), {"raw": later(a.get_stream("raw").filter("channel < 5"))})
    both = a.add_session(b)
    return both.get_stream("raw").join(both.meta.select("recording"), "recording", "left_semi").groupBy("recording").agg(F.count(F.lit(1)).alias("n"))


@query("study_dataframe", f"WITH {EMB} SELECT recording, 'mean' AS measure, CASE WHEN channel < 32 THEN 'left' ELSE 'right' END AS side, {_r('avg(v)', 'value')}, recording // 2 AS subject FROM emb GROUP BY 1, 3")
def _(spark, sf):
    study = _study(spark, sf)
    mean = lambda c: study.get_stream("raw").filter(c).groupBy("recording").agg(F.avg("v").alias("value"))
    return study.to_dataframe({"mean": {"left": mean("channel < 32"), "right": mean("channel >= 32")}}, ("measure", "side")).select("recording", "measure", "side", "value", "subject")


@query("probe_consistency", """WITH m AS (SELECT DISTINCT o_custkey % 50 AS recording, o_orderkey % 9 AS channel FROM orders WHERE (o_custkey % 50) % 4 <> 1 OR o_orderkey % 9 < 5), r AS (SELECT channel FROM m WHERE recording = (SELECT min(recording) FROM m)),
 p AS (SELECT recording, count(*) AS n, count(r.channel) AS s FROM m LEFT JOIN r ON m.channel = r.channel GROUP BY 1), q AS (SELECT *, (SELECT count(*) FROM r) AS k FROM p)
 SELECT CASE WHEN n = s AND n = k THEN 'identical' WHEN s = 0 THEN 'incompatible' WHEN s = n OR s = k THEN 'nested' ELSE 'overlapping' END AS relation, count(*) AS recordings FROM q GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    o = ad.read(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("recording"), (F.col("o_orderkey") % 9).alias("channel")).filter("recording % 4 <> 1 OR channel < 5").distinct()
    return _study(spark, sf).probe_consistency(o)


# files -------------------------------------------------------------------------------------


def _light(spark, sf) -> DataFrame:
    """The stream as a montage of 32 channels of two wavelengths."""
    c = F.col("channel")
    return ad.embedding_samples(spark, sf).select("recording", (F.floor(c / 16) + 1).cast("int").alias("source"), (F.floor(c / 2) % 8 + 1).cast("int").alias("detector"), F.when(c % 2 == 0, 690.0).otherwise(830.0).alias("wavelength"), "frame", "t", "v")


_LIGHT = f"{EMB}, lig AS (SELECT recording, channel // 16 + 1 AS source, channel // 2 % 8 + 1 AS detector, CASE WHEN channel % 2 = 0 THEN 690.0::DOUBLE ELSE 830.0 END AS wavelength, frame, t, v FROM emb)"


def _marks(spark, sf) -> DataFrame:
    s = ad.embedding_samples(spark, sf).filter("channel = 0 AND frame % 40 = 0")
    return s.select("recording", F.col("t").alias("onset"), F.lit(2.0).alias("duration"), F.lit(1.0).alias("value"), F.when(F.col("frame") % 80 == 0, "tap").otherwise("rest").alias("label"))


_MARKS = "mks AS (SELECT recording, t AS onset, 2.0::DOUBLE AS duration, 1.0::DOUBLE AS value, CASE WHEN frame % 80 = 0 THEN 'tap' ELSE 'rest' END AS label FROM emb WHERE channel = 0 AND frame % 40 = 0)"


def _places() -> pd.DataFrame:
    return pd.DataFrame([("source", i, i * 10.0, 0.0, 0.0) for i in range(1, 5)] + [("detector", i, i * 5.0, 30.0, 1.0) for i in range(1, 9)], columns=["kind", "idx", "x", "y", "z"])


def _written(spark, sf) -> str:
    folder = shared.new_folder(spark, "snirf")
    aux = ad.embedding_samples(spark, sf).filter("channel < 2").select("recording", F.concat(F.lit("acc"), F.col("channel").cast("string")).alias("signal"), "t", "v")
    # the files are what the query reads
    snirf.write_snirf(_light(spark, sf).withColumn("unit", F.lit("V")), folder, _places(), _marks(spark, sf), aux).collect()
    return folder


@query("snirf_round_trip", f"WITH {_LIGHT} SELECT CAST(recording AS VARCHAR) AS recording, CAST(source AS INTEGER) AS source, CAST(detector AS INTEGER) AS detector, wavelength, frame, {_r('t', 't')}, {_r('v', 'v')} FROM lig")
def _(spark, sf):
    return snirf.read_snirf(spark, _written(spark, sf)).select("recording", "source", "detector", "wavelength", "frame", "t", "v")


@query("snirf_columns", f"WITH {_LIGHT}, d AS (SELECT DISTINCT recording, source, detector, wavelength FROM lig) SELECT CAST(recording AS VARCHAR) AS recording, 'S' || source || '-D' || detector || ' ' || CAST(wavelength AS INTEGER) || ' nm type 1 V' AS description, 'CW' AS modality FROM d")
def _(spark, sf):
    columns = snirf.read_measurement_list(spark, _written(spark, sf))
    return snirf.describe_columns(columns).join(snirf.modality(columns), "recording").select("recording", F.regexp_replace("description", "  +", " ").alias("description"), "modality")


@query("snirf_events", f"WITH {EMB}, {_MARKS} SELECT CAST(recording AS VARCHAR) AS recording, {_r('onset', 'onset')}, duration, value, label FROM mks")
def _(spark, sf):
    return snirf.read_snirf_events(spark, _written(spark, sf))


@query("snirf_aux", f"WITH {EMB} SELECT CAST(recording AS VARCHAR) AS recording, 'acc' || channel AS signal, frame, {_r('t', 't')}, {_r('v', 'v')} FROM emb WHERE channel < 2")
def _(spark, sf):
    return snirf.read_snirf_aux(spark, _written(spark, sf)).select("recording", "signal", "frame", "t", "v")


@query("snirf_probe", f"WITH {EMB}, r AS (SELECT DISTINCT CAST(recording AS VARCHAR) AS recording FROM emb) SELECT recording, 'source' AS kind, CAST(i AS INTEGER) AS idx, i * 10.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM r, range(1, 5) t(i) UNION ALL SELECT recording, 'detector', CAST(i AS INTEGER), i * 5.0::DOUBLE, 30.0, 1.0 FROM r, range(1, 9) t(i)")
def _(spark, sf):
    return snirf.read_snirf_probe(spark, _written(spark, sf)).select("recording", "kind", "idx", "x", "y", "z")


@query("snirf_complex", "SELECT l_orderkey % 40 AS recording, l_linenumber AS frame, round(min(l_quantity) * cos(radians(min(l_discount) * 1000)), 6) AS v, round(min(l_quantity) * sin(radians(min(l_discount) * 1000)), 6) AS v_im FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    li = ad.read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("recording"), F.col("l_linenumber").alias("frame")).agg(F.min("l_quantity").alias("a"), (F.min("l_discount") * 1000).alias("p"))
    rows = F.explode(F.array(F.struct(F.lit(101).alias("data_type"), F.col("a").alias("v")), F.struct(F.lit(102).alias("data_type"), F.col("p").alias("v")))).alias("r")
    s = li.select("recording", F.lit("S1D1").alias("channel"), F.lit(690.0).alias("wavelength"), "frame", F.lit(0.0).alias("t"), rows).select("*", "r.*")
    return snirf.fd_to_complex(s, True).select("recording", "frame", "v", "v_im")


@query("snirf_enumerated", f"WITH {MON}, c AS (SELECT DISTINCT source, detector FROM mon), r AS (SELECT source, detector, w, i, d, row_number() OVER (ORDER BY source, detector, i, d) - 1 AS k FROM c, (VALUES (0, 690.0::DOUBLE), (1, 830.0)) AS w(i, w), (VALUES (101), (102)) AS t(d)) SELECT source, detector, i AS wavelength_idx, w AS wavelength, d AS data_type, CAST(k AS INTEGER) AS column FROM r".replace(" AS column ", ' AS "column" '))
def _(spark, sf):
    return snirf.enumerate_columns(montage(spark, sf).select("source", "detector").distinct(), [690.0, 830.0], [101, 102])


@query("bids_names", "SELECT c_custkey AS recording, 'sub-' || c_custkey || CASE WHEN c_nationkey > 12 THEN '_ses-N' || c_nationkey ELSE '' END || '_task-rest_run-1_nirs' AS name, 'sub-' || c_custkey || CASE WHEN c_nationkey > 12 THEN '/ses-N' || c_nationkey ELSE '' END || '/nirs' AS folder FROM customer")
def _(spark, sf):
    c = ad.read(spark, sf, "customer")
    ses = F.when(F.col("c_nationkey") > 12, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
    return bids.records(c.select(F.col("c_custkey").alias("recording"), F.col("c_custkey").cast("string").alias("subject"), ses.alias("session"), F.lit("rest").alias("task"), F.lit("1").alias("run"))).drop("subject")


@query("bids_participants", "SELECT 'sub-' || c_nationkey AS participant_id, count(*) AS n_recordings, CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS c_mktsegment FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    c = ad.read(spark, sf, "customer").select(F.col("c_custkey").alias("recording"), F.col("c_nationkey").cast("string").alias("subject"), "c_mktsegment")
    return bids.participants_table(c)


@query("bids_channels", f"WITH {_LIGHT}, d AS (SELECT DISTINCT CAST(recording AS VARCHAR) AS recording, source, detector, wavelength FROM lig) SELECT recording, 'S' || source || '-D' || detector || ' ' || CAST(wavelength AS INTEGER) AS name, 'NIRSCWAMPLITUDE' AS type, 'S' || source AS source, 'D' || detector AS detector, wavelength AS wavelength_nominal, 'V' AS units FROM d")
def _(spark, sf):
    return bids.channels_table(snirf.read_measurement_list(spark, _written(spark, sf))).drop("column")


@query("bids_optodes", f"WITH {OPT} SELECT 1 AS recording, CASE WHEN kind = 'source' THEN 'S' ELSE 'D' END || idx AS name, kind AS type, x, y, z FROM opt")
def _(spark, sf):
    return bids.optodes_table(optodes(spark, sf).withColumn("recording", F.lit(1)))


@query("bids_events", f"WITH {EVT} SELECT recording, {_r('onset', 'onset')}, {_r('duration', 'duration')}, label AS trial_type, {_r('value', 'value')} FROM evt")
def _(spark, sf):
    return bids.events_table(ad.event_table(spark, sf))


@query("bids_round_trip", f"WITH {_LIGHT} SELECT 'sub-' || (recording // 2) || '_task-rest_run-' || (recording % 2) || '_nirs' AS recording, CAST(recording // 2 AS VARCHAR) AS subject, CAST(recording % 2 AS VARCHAR) AS run, count(*) AS n, {_r('sum(v)', 'v')} FROM lig GROUP BY recording")
def _(spark, sf):
    folder = shared.new_folder(spark, "bids")
    meta = _study(spark, sf).meta.select("recording", F.col("subject").cast("string").alias("subject"), "session", "task", F.col("run").cast("string").alias("run"), "age")
    bids.write_dataset(spark, folder, meta, _light(spark, sf), _places(), _marks(spark, sf), 10.0, "embeddings", ["nobody"]).collect()
    study = bids.load_dataset(spark, folder, {"task": "rest"})
    return study.get_stream("optical").join(study.meta.select("recording", "subject", "run"), "recording").groupBy("recording", "subject", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


# fits of data simulated from the table's own parameters -------------------------------------


def _media(spark, sf) -> DataFrame:
    """A medium a part size: mua and musp are known."""
    return ad.read(spark, sf, "part").select("p_size").distinct().select("p_size", (0.04 + F.col("p_size") / 500.0).alias("mua"), (6.0 + F.col("p_size") / 10.0).alias("musp"))


_MEDIA = "med AS (SELECT DISTINCT p_size, 0.04 + p_size / 500.0::DOUBLE AS mua, 6.0 + p_size / 10.0::DOUBLE AS musp FROM part)"
_PARAMS = "SELECT p_size, 'mua' AS param, round(mua, 3) AS value FROM med UNION ALL SELECT p_size, 'musp', round(musp, 3) FROM med"


def _simulated(media: DataFrame, f, schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield f(row)

    return media.mapInPandas(run, schema)


@query("fit_td_gates", f"WITH {_MEDIA} {_PARAMS}", 3)
def _(spark, sf):
    import numpy as np

    from lucera.functions import time_domain

    delays = np.arange(1, 41) * 1e-10

    def gates(m):
        v = 1e6 * time_domain.gate_model(delays, np.full(40, 1e-10), 2.0, m.mua, m.musp, 1.4)
        return pd.DataFrame({"p_size": m.p_size, "rho": 2.0, "delay": delays, "width": 1e-10, "v": v})

    sim = _simulated(_media(spark, sf), gates, "p_size int, rho double, delay double, width double, v double")
    return td_fits.select_params(td_fits.td_to_properties(sim, ["p_size"]), ["mua", "musp"]).select("p_size", "param", "value")


@query("fit_td_moments", f"WITH {_MEDIA} {_PARAMS}", 3)
def _(spark, sf):
    from lucera.functions import time_domain

    def moments(m):
        m1, m2 = time_domain.model_moments(2.0, m.mua, m.musp, 1.4)
        return pd.DataFrame({"p_size": [m.p_size], "rho": 2.0, "m1": m1, "m2": m2})

    sim = _simulated(_media(spark, sf), moments, "p_size int, rho double, m1 double, m2 double")
    return td_fits.td_moments_to_properties(sim, ["p_size"]).select("p_size", "param", "value")


@query("fit_fd", f"WITH {_MEDIA} SELECT p_size, round(mua, 4) AS mua, round(musp, 4) AS musp FROM med", 4)
def _(spark, sf):
    import numpy as np

    from lucera.functions import diffusion

    def light(m):
        rho = np.array([2.0, 2.5, 3.0])
        z = np.conj(diffusion.fd_fluence(rho, m.mua, m.musp, 1.33, 1.1e8))
        return pd.DataFrame({"p_size": m.p_size, "rho": rho, "re": z.real, "im": z.imag})

    return fits.fd_to_properties(_simulated(_media(spark, sf), light, "p_size int, rho double, re double, im double"), ["p_size"])


@query("fit_dcs", "SELECT DISTINCT p_size, round(p_size * 0.2::DOUBLE, 3) AS flow, 0.45::DOUBLE AS beta FROM part", 3)
def _(spark, sf):
    import numpy as np

    from lucera.functions import diffusion

    tau = np.geomspace(1e-7, 1e-2, 40)

    def g2(m):
        g1 = diffusion.dcs_g1(2.5, 0.1, 10.0, 1.4, 785.0, tau, adb=m.p_size * 2e-9)
        return pd.DataFrame({"p_size": m.p_size, "rho": 2.5, "mua": 0.1, "musp": 10.0, "tau": tau, "g2": diffusion.siegert(g1, 0.45)})

    sim = _simulated(_media(spark, sf), g2, "p_size int, rho double, mua double, musp double, tau double, g2 double")
    return fits.dcs_to_flow(sim, ["p_size"]).select("p_size", (F.col("adb") * 1e8).alias("flow"), "beta")


@query("fit_fd_spectral", "SELECT DISTINCT p_size, round(20.0::DOUBLE + p_size, 2) AS hbo, 30.0::DOUBLE AS hbr, 10.0::DOUBLE AS a, 1.2::DOUBLE AS b FROM part", 2)
def _(spark, sf):
    import numpy as np

    from lucera.functions import diffusion, time_domain

    # 1/(cm M): fixed values of the example's three wavelengths
    ext = {690.0: (276.0, 2051.96), 785.0: (735.0, 957.0), 830.0: (974.0, 693.04)}

    def light(m):
        rho, out = np.array([2.0, 2.5, 3.0]), []
        for w in ext:
            mua, musp = time_domain.composed(w, ext, 20.0 + m.p_size, 30.0, 10.0, 1.2)
            z = np.conj(diffusion.fd_fluence(rho, mua, musp, 1.4, 1.1e8))
            out.append(pd.DataFrame({"p_size": m.p_size, "wavelength": w, "rho": rho, "re": z.real, "im": z.imag}))
        return pd.concat(out)

    sim = _simulated(_media(spark, sf), light, "p_size int, wavelength double, rho double, re double, im double")
    fit = td_fits.fd_to_concentration(sim, ["p_size"], ext)
    one = lambda k: F.max(F.when(F.col("param") == k, F.col("value"))).alias(k)
    return fit.groupBy("p_size").agg(*[one(k) for k in ("hbo", "hbr", "a", "b")])
