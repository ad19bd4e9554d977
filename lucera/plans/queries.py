"""A query and its SQL for each operator that SQL can express. Doubles are rounded on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from lucera.functions import optics
from lucera.operators import connectivity as fc
from lucera.operators import events as ev
from lucera.operators import group, probe, quality, streams, tissue
from lucera.plans import adapters as ad
from lucera.plans.adapters import CHN, EMB, EVS, EVT, FDS, GAT, ROI, SUB

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _rounded(df, digits=6):
    return df.select(*[F.round(F.col(c) + F.lit(0.0), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str, digits: int = 6):
    def put(f):
        QUERIES[name] = lambda spark, sf: _rounded(f(spark, sf), digits)
        SQL[name] = sql
        return f

    return put


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr} + 0.0::DOUBLE, {digits}) AS {name}"


# events ----------------------------------------------------------------------

EV_COLS = f"recording, {_r('onset', 'onset')}, {_r('duration', 'duration')}, {_r('value', 'value')}, label"


@query("events_filter", f"WITH {EVT} SELECT {EV_COLS} FROM evt WHERE onset BETWEEN 86400 AND 864000 AND label IN ('click', 'view', 'purchase')")
def _(spark, sf):
    return ev.filter_events(ad.event_table(spark, sf), 86400, 864000, ["click", "view", "purchase"])


@query("events_count", f"WITH {EVT} SELECT label, count(*) AS n_events FROM evt GROUP BY label")
def _(spark, sf):
    return ev.n_events_by_condition(ad.event_table(spark, sf))


@query("events_sorted", f"WITH {EVT} SELECT {EV_COLS}, CAST(row_number() OVER (PARTITION BY recording ORDER BY onset, label, duration, value) - 1 AS INTEGER) AS idx FROM evt")
def _(spark, sf):
    return ev.sort_by_onset(ad.event_table(spark, sf))


@query("events_update_label", f"WITH {EVT} SELECT recording, {_r('onset', 'onset')}, {_r(chr(67) + 'ASE WHEN label = ' + chr(39) + 'click' + chr(39) + ' THEN 5.0 ELSE duration END', 'duration')}, {_r('value', 'value')}, CASE WHEN label = 'click' THEN 'tap' ELSE label END AS label FROM evt")
def _(spark, sf):
    return ev.update_events_by_label(ad.event_table(spark, sf), "click", new_label="tap", duration=5.0)


@query("events_remove_label", f"WITH {EVT} SELECT {EV_COLS} FROM evt WHERE label <> 'click'")
def _(spark, sf):
    return ev.remove_events_by_label(ad.event_table(spark, sf), "click")


_TWICE = f"{EVT}, two AS (SELECT * FROM evt UNION ALL SELECT recording, onset, duration + 60, value, label FROM evt WHERE recording % 3 = 0)"


def _twice(spark, sf):
    e = ad.event_table(spark, sf)
    return e.unionByName(e.filter("recording % 3 = 0").withColumn("duration", F.col("duration") + 60))


@query("events_dedup_first", f"WITH {_TWICE} SELECT {EV_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY recording, onset, label ORDER BY onset, duration, value, label) AS k FROM two) WHERE k = 1")
def _(spark, sf):
    return ev.remove_duplicates(_twice(spark, sf))


@query("events_dedup_last", f"WITH {_TWICE} SELECT {EV_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY recording, onset, label ORDER BY onset DESC, duration DESC, value DESC, label DESC) AS k FROM two) WHERE k = 1")
def _(spark, sf):
    return ev.remove_duplicates(_twice(spark, sf), keep="last")


@query("events_dedup_none", f"WITH {_TWICE} SELECT {EV_COLS} FROM (SELECT *, count(*) OVER (PARTITION BY recording, onset, label) AS k FROM two) WHERE k = 1")
def _(spark, sf):
    return ev.remove_duplicates(_twice(spark, sf), keep=False)


def _merge_sql(keys: str, label: str, tol: float) -> str:
    return f"""WITH {EVT},
    a AS (SELECT *, max(onset + duration) OVER (PARTITION BY {keys} ORDER BY onset, duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM evt),
    b AS (SELECT *, sum(CASE WHEN reach IS NULL OR onset > reach + {tol} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY onset, duration ROWS UNBOUNDED PRECEDING) AS island FROM a)
    SELECT recording, {_r('min(onset)', 'onset')}, {_r('max(onset + duration) - min(onset)', 'duration')}, {_r('avg(value)', 'value')}, {label} AS label FROM b GROUP BY {keys}, island"""


@query("events_merge_by_label", _merge_sql("recording, label", "label", 0.0))
def _(spark, sf):
    return ev.merge_overlapping(ad.event_table(spark, sf))


@query("events_merge_all", _merge_sql("recording", "CASE WHEN count(DISTINCT label) > 1 THEN 'merged' ELSE min(label) END", 30.0))
def _(spark, sf):
    return ev.merge_overlapping(ad.event_table(spark, sf), 30.0, by_label=False)


@query("events_from_stim", f"""WITH {EMB}, a AS (SELECT *, v > 0.05 AS o, lag(v > 0.05) OVER (PARTITION BY recording, channel ORDER BY frame) AS p FROM emb),
 b AS (SELECT *, sum(CASE WHEN o AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY recording, channel ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM a)
 SELECT recording, {_r('min(t)', 'onset')}, {_r('max(t) - min(t)', 'duration')}, {_r('arg_min(v, frame)', 'value')}, channel AS label FROM b WHERE o GROUP BY recording, channel, run""")  # fmt: skip
def _(spark, sf):
    s = ad.embedding_samples(spark, sf).withColumn("v", F.when(F.col("v") > 0.05, F.col("v")).otherwise(0.0)).withColumnRenamed("channel", "condition")
    return ev.from_stim(s)


# streams -----------------------------------------------------------------------


@query("intensity_to_od", f"WITH {EMB} SELECT recording, channel, frame, {_r('-ln((abs(v) + 1e-10) / avg(abs(v)) OVER (PARTITION BY recording, channel) + 1e-10)', 'od')} FROM emb")
def _(spark, sf):
    return streams.intensity_to_od(ad.embedding_samples(spark, sf)).select("recording", "channel", "frame", "od")


@query("od_baseline_window", f"WITH {EMB} SELECT recording, channel, frame, {_r('-ln((abs(v) + 1e-10) / avg(CASE WHEN frame >= 10 AND frame < 60 THEN abs(v) END) OVER (PARTITION BY recording, channel) + 1e-10)', 'od')} FROM emb")
def _(spark, sf):
    return streams.intensity_to_od(ad.embedding_samples(spark, sf), window=(10, 60)).select("recording", "channel", "frame", "od")


@query("time_average_seconds", f"""WITH {EVS}, f AS (SELECT recording, channel, min(t) AS t0 FROM evs GROUP BY 1, 2)
 SELECT evs.recording, evs.channel, CAST(floor((evs.t - t0) / 3600) AS BIGINT) AS block, {_r('avg(v)', 'v')}, {_r('avg(evs.t)', 't', 4)}, count(v) AS n FROM evs JOIN f ON evs.recording = f.recording AND evs.channel = f.channel GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, sf):
    return streams.average_seconds(ad.event_samples(spark, sf), 3600.0).withColumn("t", F.round("t", 4))


@query("time_average_median", f"""WITH {EMB} SELECT recording, channel, CAST(floor(frame / 7) AS BIGINT) AS block, {_r('median(v)', 'v')}, {_r('min(t)', 't')} FROM emb GROUP BY 1, 2, 3 HAVING count(*) = 7""")
def _(spark, sf):
    return streams.average_frames(ad.embedding_samples(spark, sf), 7, method="median", partial="drop", time_label="start")


@query("gap_average", f"""WITH {EVS}, a AS (SELECT *, t - lag(t) OVER (PARTITION BY recording, channel ORDER BY t, v) AS d FROM evs),
 b AS (SELECT *, sum(CASE WHEN d > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY recording, channel ORDER BY t, v ROWS UNBOUNDED PRECEDING) AS block FROM a)
 SELECT recording, channel, CAST(block AS BIGINT) AS block, {_r('avg(v)', 'v')}, {_r('avg(t)', 't', 4)}, count(v) AS n FROM b GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, sf):
    return streams.average_gaps(ad.event_samples(spark, sf), 1800.0).withColumn("t", F.round("t", 4))


@query("edge_average", f"WITH {EMB} SELECT recording, channel, CAST(CASE WHEN t < 6.25 THEN 0 WHEN t < 12.5 THEN 1 ELSE 2 END AS INTEGER) AS block, {_r('avg(v)', 'v')}, {_r('avg(t)', 't')} FROM emb GROUP BY 1, 2, 3")
def _(spark, sf):
    whole = ad.FRAMES / 10.0  # a quarter, a quarter and a half of each recording
    return streams.average_edges(ad.embedding_samples(spark, sf), [0.0, whole / 4, whole / 2, whole])


@query("detrend", f"""WITH {EMB}, f AS (SELECT recording, channel, regr_slope(v, frame) AS b, avg(v) AS m, avg(frame) AS c FROM emb GROUP BY 1, 2)
 SELECT emb.recording, emb.channel, frame, {_r('v - b * (frame - c)', 'v')} FROM emb JOIN f ON emb.recording = f.recording AND emb.channel = f.channel""")  # fmt: skip
def _(spark, sf):
    return streams.detrend(ad.embedding_samples(spark, sf)).select("recording", "channel", "frame", "v")


@query("concatenate", f"""WITH {EMB}, u AS (SELECT recording, CASE WHEN frame < 100 THEN 0 ELSE 1 END AS run, channel, t, v FROM emb),
 s AS (SELECT recording, run, min(t) AS lo, max(t) AS hi FROM u GROUP BY 1, 2), o AS (SELECT recording, run, lo, coalesce(sum(hi - lo + 0.1) OVER (PARTITION BY recording ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sh FROM s)
 SELECT u.recording, u.run, channel, {_r('t - lo + sh', 't')}, {_r('v', 'v')} FROM u JOIN o ON u.recording = o.recording AND u.run = o.run""")  # fmt: skip
def _(spark, sf):
    s = ad.embedding_samples(spark, sf)
    return streams.concatenate([s.filter("frame < 100"), s.filter("frame >= 100")], 0.1).select("recording", "run", "channel", "t", "v")


@query("segment_by_events", f"""WITH {EVT}, w AS (SELECT recording, onset - 60 AS a, onset + duration + 60 AS b FROM evt WHERE label = 'purchase' AND duration + 120 >= 300)
 SELECT w.recording, {_r('a', 'seg_start')}, {_r('b', 'seg_end')}, count(*) AS n, {_r('avg(value)', 'v')}, {_r('max(onset - a)', 'last_t')} FROM evt e JOIN w ON e.recording = w.recording AND e.onset BETWEEN a AND b GROUP BY w.recording, a, b""")  # fmt: skip
def _(spark, sf):
    e = ad.event_table(spark, sf)
    samples = e.select("recording", F.col("onset").alias("t"), F.col("value").alias("v"))
    s = streams.segment_by_events(samples, e.filter("label = 'purchase'"), 60, 60, 300)
    return s.groupBy("recording", "seg_start", "seg_end").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"), F.max("seg_t").alias("last_t"))


@query("align_asof", f"""WITH {EVS}, s AS (SELECT recording, t, avg(v) AS x FROM evs WHERE channel = 'click' GROUP BY 1, 2), q AS (SELECT DISTINCT recording, t FROM evs WHERE channel = 'purchase'),
 j AS (SELECT q.recording, q.t, p.t AS pt, p.x AS px, n.t AS nt, n.x AS nx FROM q ASOF LEFT JOIN s p ON q.recording = p.recording AND q.t >= p.t ASOF LEFT JOIN s n ON q.recording = n.recording AND q.t <= n.t)
 SELECT recording, {_r('t', 't')}, {_r('CASE WHEN pt IS NULL THEN nx WHEN nt IS NULL THEN px WHEN nt = pt THEN px ELSE px + (nx - px) * (t - pt) / (nt - pt) END', 'x')} FROM j""")  # fmt: skip
def _(spark, sf):
    s = ad.event_samples(spark, sf)
    source = s.filter("channel = 'click'").groupBy("recording", "t").agg(F.avg("v").alias("x"))
    return streams.align_asof(s.filter("channel = 'purchase'").select("recording", "t").distinct(), source).select("recording", "t", "x")


@query("unwrap_phase", f"""WITH {FDS}, a AS (SELECT frame, channel, radians(deg) - 6.283185307179586::DOUBLE * floor((radians(deg) + 3.141592653589793::DOUBLE) / 6.283185307179586::DOUBLE) AS r FROM fds),
 b AS (SELECT *, r - lag(r) OVER (PARTITION BY frame ORDER BY channel) AS d FROM a)
 SELECT frame, channel, {_r('r + 6.283185307179586::DOUBLE * sum(CASE WHEN d > 3.141592653589793 THEN -1 WHEN d < -3.141592653589793 THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY channel ROWS UNBOUNDED PRECEDING)', 'phase')} FROM b""")  # fmt: skip
def _(spark, sf):
    return streams.unwrap_phase(ad.fd_samples(spark, sf), ["frame"], "channel", "deg").select("frame", "channel", "phase")


@query("lag_matrix", f"WITH {EMB} SELECT recording, channel, frame, {_r('lag(v, 1, 0.0) OVER w', 'lag_1')}, {_r('lag(v, 2, 0.0) OVER w', 'lag_2')} FROM emb WINDOW w AS (PARTITION BY recording, channel ORDER BY frame)")
def _(spark, sf):
    return streams.lag_matrix(ad.embedding_samples(spark, sf), 2).select("recording", "channel", "frame", "lag_1", "lag_2")


@query("aux_magnitude", f"WITH {EMB} SELECT recording, {_r('t', 't')}, {_r('sqrt(sum(v * v))', 'magnitude')} FROM emb WHERE channel < 3 GROUP BY recording, t")
def _(spark, sf):
    s = ad.embedding_samples(spark, sf).filter("channel < 3").withColumn("signal", F.get(F.array(F.lit("acc_X"), F.lit("acc_Y"), F.lit("acc_Z")), "channel"))
    return streams.magnitude(s).select("recording", "t", "magnitude")


@query("stream_info", f"WITH {EVS} SELECT recording, channel, count(*) AS n, count(v) AS n_valid, {_r('min(t)', 't_min')}, {_r('max(t)', 't_max')}, {_r('min(v)', 'v_min')}, {_r('max(v)', 'v_max')} FROM evs GROUP BY 1, 2")
def _(spark, sf):
    return streams.info(ad.event_samples(spark, sf))


@query("aggregate_channels", f"WITH {EMB} SELECT recording, CASE WHEN channel < 4 THEN 'front' ELSE CAST(channel AS VARCHAR) END AS channel, frame, {_r('avg(v)', 'v')}, {_r('min(t)', 't')} FROM emb GROUP BY 1, 2, 3")
def _(spark, sf):
    groups = spark.range(4).select(F.col("id").cast("int").alias("channel"), F.lit("front").alias("grp"))
    return streams.aggregate_channels(ad.embedding_samples(spark, sf), groups)


@query("keep_channels", f"WITH {CHN} SELECT channel, is_bad OR (NOT is_short AND (distance_mm < 22 OR distance_mm > 35)) AS is_bad FROM chn")
def _(spark, sf):
    return streams.keep_channels(ad.channels(spark), 22, 35).select("channel", "is_bad")


@query("drop_bad_channels", f"WITH {CHN} SELECT channel FROM chn WHERE NOT is_bad OR is_short")
def _(spark, sf):
    return streams.drop_bad_channels(ad.channels(spark)).select("channel")


@query("create_group", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000 AND c_acctbal BETWEEN 0 AND 8000")
def _(spark, sf):
    c = ad.read(spark, sf, "customer")
    return c.filter(streams.session_matches({"c_mktsegment": ["BUILDING", "MACHINERY"], "c_acctbal": (">=", 1000)}) & streams.session_matches({"c_acctbal": ("between", (0, 8000))})).select("c_custkey", "c_mktsegment")


# tissue ------------------------------------------------------------------------

EXT = {690.0: (0.35, 2.05), 830.0: (0.97, 0.69)}


@query("mbll", f"""WITH {EMB}, o AS (SELECT recording, channel // 2 AS channel, channel % 2 AS w, frame, -ln((abs(v) + 1e-10) / avg(abs(v)) OVER (PARTITION BY recording, channel) + 1e-10) AS od FROM emb),
 p AS (SELECT recording, channel, frame, sum(CASE WHEN w = 0 THEN od END) / 18 AS a, sum(CASE WHEN w = 1 THEN od END) / 18 AS b FROM o GROUP BY 1, 2, 3),
 q AS (SELECT recording, channel, frame, (0.69 * a - 2.05 * b) / (0.35::DOUBLE * 0.69 - 2.05 * 0.97) * 1e6 AS hbo, (0.35 * b - 0.97 * a) / (0.35::DOUBLE * 0.69 - 2.05 * 0.97) * 1e6 AS hbr FROM p)
 SELECT recording, CAST(channel AS INTEGER) AS channel, frame, {_r('hbo', 'hbo', 2)}, {_r('hbr', 'hbr', 2)}, {_r('hbo + hbr', 'hbt', 2)} FROM q""", 2)  # fmt: skip
def _(spark, sf):
    od = streams.intensity_to_od(ad.embedding_samples(spark, sf))
    od = od.withColumns({"wavelength": F.when(F.col("channel") % 2 == 0, 690.0).otherwise(830.0), "rho_cm": F.lit(3.0)}).withColumn("channel", F.floor(F.col("channel") / 2).cast("int"))
    return tissue.od_to_concentration(od, EXT, {690.0: 6.0, 830.0: 6.0}).select("recording", "channel", "frame", "hbo", "hbr", "hbt")


@query("tissue_indices", f"SELECT c_custkey, {_r('c_acctbal + s', 'hbt')}, {_r('c_acctbal / nullif(c_acctbal + s, 0)', 'sto2')}, {_r('s / nullif(c_acctbal + s, 0)', 'oef')} FROM (SELECT c_custkey, c_acctbal, c_nationkey * 10.0::DOUBLE AS s FROM customer)")
def _(spark, sf):
    c = ad.read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("hbo"), (F.col("c_nationkey") * 10.0).alias("hbr"))
    return tissue.indices(c).select("c_custkey", "hbt", "sto2", "oef")


@query("composition_to_properties", "SELECT p_partkey, w AS wavelength, round((p_size * eo + p_retailprice / 97 * er) * 1e-6 * 1e5, 6) AS mua, round(10.0::DOUBLE * pow(w / 800.0::DOUBLE, -p_size / 25.0::DOUBLE), 6) AS musp FROM part, (VALUES (690.0::DOUBLE, 0.35::DOUBLE, 2.05::DOUBLE), (830.0::DOUBLE, 0.97::DOUBLE, 0.69::DOUBLE)) AS e(w, eo, er)")
def _(spark, sf):
    p = ad.read(spark, sf, "part").select("p_partkey", F.col("p_size").alias("hbo"), (F.col("p_retailprice") / 97).alias("hbr"), F.lit(10.0).alias("a"), (F.col("p_size") / 25.0).alias("b"))
    return tissue.composition_to_properties(p, EXT).select("p_partkey", "wavelength", (F.col("mua") * 1e5).alias("mua"), "musp")


_MOM = f"{GAT}, s AS (SELECT frame, sum(v) AS m0, sum(v * delay) AS s1, sum(v * delay * delay) AS s2 FROM gat GROUP BY frame), mom AS (SELECT frame, m0, s1 / (m0 + 1e-20) AS m1, s2 / (m0 + 1e-20) - pow(s1 / (m0 + 1e-20), 2) - 0.04::DOUBLE / 12 AS m2 FROM s)"


def _moments(spark, sf):
    return tissue.moments(ad.gates(spark, sf), ["frame"])


@query("calculate_moments", f"WITH {_MOM} SELECT frame, {_r('m0', 'm0')}, {_r('m1', 'm1')}, {_r('m2', 'm2')} FROM mom")
def _(spark, sf):
    return _moments(spark, sf)


@query("dpf_moments", f"WITH {_MOM} SELECT frame % 10 AS channel, {_r('avg(m1 * 1e-9 * 2.99792458e10 / 1.44 / 3.0)', 'dpf')} FROM mom GROUP BY 1")
def _(spark, sf):
    m = _moments(spark, sf).withColumns({"m1": F.col("m1") * 1e-9, "rho": F.lit(3.0), "channel": F.col("frame") % 10})
    return tissue.dpf(m)


@query("irf_correction", f"WITH {_MOM}, i AS (SELECT frame % 10 AS channel, avg(m1) * 0.5 AS i1, avg(m2) AS i2 FROM mom GROUP BY 1) SELECT frame, {_r('m1 - i1', 'm1')}, {_r('greatest(m2 - i2, 0.0)', 'm2')} FROM mom JOIN i ON frame % 10 = i.channel")
def _(spark, sf):
    m = _moments(spark, sf).withColumn("channel", F.col("frame") % 10)
    irf = m.groupBy("channel").agg((F.avg("m1") * 0.5).alias("m1"), F.avg("m2").alias("m2"))
    return tissue.correct_for_irf(m, irf, ["channel"]).select("frame", "m1", "m2")


@query("moments_to_properties", f"""WITH {_MOM}, k AS (SELECT frame, m1 * 1e-9 AS a, m2 * 1e-18 AS b, 3e10::DOUBLE / 1.37 AS v FROM mom WHERE m2 > 0.001)
 SELECT frame, {_r('a * a * a / (2 * v * b * (a * a + b))', 'mua')}, {_r('2 * v * a * (a * a + b) / (3 * 9.0 * b)', 'musp', 4)} FROM k""")  # fmt: skip
def _(spark, sf):
    m = _moments(spark, sf).filter("m2 > 0.001").withColumns({"m1": F.col("m1") * 1e-9, "m2": F.col("m2") * 1e-18, "rho": F.lit(3.0)})
    return tissue.moments_to_properties(m).select("frame", "mua", F.round("musp", 4).alias("musp"))


@query("fd_slope_fit", f"""WITH {FDS}, s AS (SELECT frame, regr_slope(ln(rho * rho * ac), rho) AS a, regr_slope(phase, rho) AS p FROM fds GROUP BY frame HAVING count(*) > 3),
 m AS (SELECT *, abs(2 * pi() * 1.1e8 / (2 * (2.99792458e10 / 1.33)) * (p / a - a / p)) AS mua FROM s) SELECT frame, {_r('a', 's_ac')}, {_r('p', 's_ph')}, {_r('mua', 'mua', 4)} FROM m""")  # fmt: skip
def _(spark, sf):
    fd = ad.fd_samples(spark, sf)
    many = fd.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).filter("n > 3").select("frame")
    return tissue.slope_fit(fd.join(many, "frame"), ["frame"], 1.1e8).select("frame", "s_ac", "s_ph", F.round("mua", 4).alias("mua"))


@query("fd_complex_parts", f"WITH {FDS} SELECT frame, channel, {_r('ac', 'ac')}, {_r('atan2(sin(phase), cos(phase))', 'phase')} FROM fds")
def _(spark, sf):
    return tissue.complex_parts(tissue.to_complex(ad.fd_samples(spark, sf))).select("frame", "channel", "ac", "phase")


@query("fd_residual_reference", f"WITH {FDS} SELECT frame, channel, {_r('ln(ac / first(ac) OVER w)', 'log_ratio')}, {_r('phase - first(phase) OVER w', 'phase_diff')} FROM fds WINDOW w AS (PARTITION BY frame ORDER BY channel)")
def _(spark, sf):
    return tissue.residual_to_reference(ad.fd_samples(spark, sf), ["frame"], "channel").select("frame", "channel", "log_ratio", "phase_diff")


@query("fd_residual_consecutive", f"WITH {FDS} SELECT frame, channel, {_r('ln(ac / lag(ac) OVER w)', 'log_ratio')}, {_r('phase - lag(phase) OVER w', 'phase_diff')} FROM fds WINDOW w AS (PARTITION BY frame ORDER BY channel)")
def _(spark, sf):
    return tissue.residual_to_reference(ad.fd_samples(spark, sf), ["frame"], "channel", True).select("frame", "channel", "log_ratio", "phase_diff")


@query("decompose_flow", "SELECT s_suppkey, round(s_acctbal / 0.5::DOUBLE, 6) AS flow, round(sqrt(pow(2.0 / 0.5, 2) + pow(s_acctbal * 0.1 / 0.25, 2)), 6) AS flow_sigma FROM supplier")
def _(spark, sf):
    s = ad.read(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bfi"), F.lit(2.0).alias("sigma"))
    return tissue.decompose_flow(s, 0.5, 0.1).select("s_suppkey", "flow", "flow_sigma")


@query("correlation_of_covariance", "WITH c AS (SELECT p_size % 5 AS g, covar_pop(p_size, p_retailprice) AS xy, var_pop(p_size) AS xx, var_pop(p_retailprice) AS yy FROM part GROUP BY 1) SELECT g, round(xy / sqrt(xx * yy), 6) AS corr FROM c")
def _(spark, sf):
    c = ad.read(spark, sf, "part").withColumn("g", F.col("p_size") % 5).groupBy("g").agg(F.covar_pop("p_size", "p_retailprice").alias("xy"), F.var_pop("p_size").alias("xx"), F.var_pop("p_retailprice").alias("yy"))
    rows = F.array(*[F.struct(F.lit(a).alias("p1"), F.lit(b).alias("p2"), F.col(k).alias("cov")) for a, b, k in (("x", "y", "xy"), ("x", "x", "xx"), ("y", "y", "yy"))])
    return tissue.covariance_to_correlation(c.select("g", F.explode(rows).alias("r")).select("g", "r.*"), ["g"]).filter("p1 <> p2").select("g", "corr")


@query("dcs_expressions", """SELECT l_orderkey, l_linenumber, round(6 * 1e-8 * q * 1e6, 6) AS brownian, round(6 * 1e-8 * (q - 0.5 * (1 - exp(-q / 0.5))) * 1e6, 6) AS langevin, round(2e-3 * q * q, 6) AS random,
 round(1 + 0.5 * pow(abs(exp(-q / 10)), 2), 6) AS g2 FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem)""")  # fmt: skip
def _(spark, sf):
    li = ad.read(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return li.select(
        "l_orderkey", "l_linenumber", (optics.msd(q, "brownian", adb=F.lit(1e-8)) * 1e6).alias("brownian"), (optics.msd(q, "langevin", adb=F.lit(1e-8), tc=F.lit(0.5)) * 1e6).alias("langevin"),
        optics.msd(q, "random", av2=F.lit(2e-3)).alias("random"), optics.siegert(F.exp(-q / 10), F.lit(0.5)).alias("g2"),
    )


@query("hrf", f"WITH {EVS} SELECT recording, channel, frame, {_r('CASE WHEN x <= 30 THEN pow(x, 5) * exp(-x) / 120 - 0.16 * pow(x, 15) * exp(-x) / 1307674368000.0::DOUBLE ELSE 0 END', 'h')} FROM (SELECT recording, channel, frame, t % 40 AS x FROM evs)")
def _(spark, sf):
    return ad.event_samples(spark, sf).select("recording", "channel", "frame", optics.hrf(F.col("t") % 40).alias("h"))


# quality -------------------------------------------------------------------------


@query("snr", f"WITH {EMB} SELECT recording, channel, {_r('avg(abs(v)) / (stddev_pop(v) + 1e-12)', 'snr')} FROM emb GROUP BY 1, 2")
def _(spark, sf):
    return quality.snr(ad.embedding_samples(spark, sf), ["recording", "channel"])


@query("windowed_snr", f"""WITH {EMB}, w AS (SELECT recording, channel, k, count(*) AS n, avg(abs(v)) / (stddev_pop(v) + 1e-12) AS s FROM emb, (SELECT unnest(range(0, 25)) AS k) WHERE frame >= k * 10 AND frame < k * 10 + 20 GROUP BY 1, 2, 3 HAVING count(*) = 20)
 SELECT recording, channel, {_r('median(s)', 'snr')}, count(*) AS n_windows FROM w GROUP BY 1, 2""")  # fmt: skip
def _(spark, sf):
    return quality.windowed_snr(ad.embedding_samples(spark, sf), ["recording", "channel"], 20, 10)


@query("windowed_correlation", f"""WITH {EMB}, p AS (SELECT a.recording, a.channel // 2 AS channel, a.frame, a.v AS x, b.v AS y FROM emb a JOIN emb b ON a.recording = b.recording AND a.frame = b.frame AND b.channel = a.channel + 1 WHERE a.channel % 2 = 0),
 w AS (SELECT recording, channel, k, corr(x, y) AS r FROM p, (SELECT unnest(range(0, 10)) AS k) WHERE frame >= k * 25 AND frame < k * 25 + 50 GROUP BY 1, 2, 3 HAVING count(*) = 50)
 SELECT recording, CAST(channel AS INTEGER) AS channel, {_r('median(r)', 'sci')} FROM w GROUP BY 1, 2""")  # fmt: skip
def _(spark, sf):
    s = ad.embedding_samples(spark, sf)
    pair = F.floor(F.col("channel") / 2).cast("int")
    p = s.groupBy("recording", pair.alias("channel"), "frame").agg(F.max(F.when(F.col("channel") % 2 == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("channel") % 2 == 1, F.col("v"))).alias("y"))
    return quality.windowed_correlation(p, ["recording", "channel"], 50, 25)


@query("quality_summary", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE v >= 4000) AS n_good, count(*) FILTER (WHERE v < 4000) AS n_bad, count(*) FILTER (WHERE v IS NULL) AS n_missing, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std FROM (SELECT c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS v FROM customer) GROUP BY 1")
def _(spark, sf):
    v = ad.read(spark, sf, "customer").select("c_mktsegment", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("value"))
    return quality.summary(v, 4000, ["c_mktsegment"])


@query("roi_channel_summary", f"""WITH {CHN}, {ROI}, s AS (SELECT roi, count(*) AS n, count(*) FILTER (WHERE NOT is_bad) AS n_good, count(*) FILTER (WHERE is_bad) AS n_bad, count(*) FILTER (WHERE is_short) AS n_short, count(*) FILTER (WHERE NOT is_short) AS n_long, count(*) FILTER (WHERE NOT is_bad AND NOT is_short) AS n_good_long FROM roi JOIN chn ON roi.channel = chn.channel GROUP BY roi)
 SELECT *, {_r('100.0 * n_good / n', 'pct_good')}, {_r('100.0 * n_good_long / nullif(n_long, 0)', 'pct_good_long')} FROM s""")  # fmt: skip
def _(spark, sf):
    return quality.roi_summary(ad.channels(spark), ad.regions(spark))


@query("screen", f"WITH {EMB}, s AS (SELECT recording, channel, label, avg(abs(v)) / (stddev_pop(v) + 1e-12) AS value FROM emb GROUP BY 1, 2, 3 HAVING stddev_pop(v) > 0) SELECT channel, {_r('min(value)', 'value')}, bool_or(value < 0.7) AS is_bad FROM s GROUP BY channel")
def _(spark, sf):
    return quality.screen(quality.snr(ad.embedding_samples(spark, sf), ["recording", "channel", "label"]).withColumnRenamed("snr", "value").filter("value IS NOT NULL"), 0.7, True)


# connectivity ----------------------------------------------------------------------

_PEARSON = f"{EMB}, pr AS (SELECT a.recording, a.label, a.channel AS ch_i, b.channel AS ch_j, a.v AS x, b.v AS y FROM emb a JOIN emb b ON a.recording = b.recording AND a.frame = b.frame AND a.channel < b.channel), fc AS (SELECT recording, ch_i, ch_j, corr(x, y) AS value FROM pr GROUP BY 1, 2, 3)"


def _fc(spark, sf):
    return fc.pearson(ad.embedding_samples(spark, sf))


@query("fc_pearson", f"WITH {_PEARSON} SELECT recording, ch_i, ch_j, {_r('corr(x, y)', 'value')}, count(*) AS n FROM pr GROUP BY 1, 2, 3")
def _(spark, sf):
    return _fc(spark, sf)


@query("fc_average", f"WITH {_PEARSON}, g AS (SELECT recording, label, ch_i, ch_j, corr(x, y) AS c FROM pr GROUP BY 1, 2, 3, 4) SELECT ch_i, ch_j, {_r('tanh(avg(atanh(greatest(least(c, 0.999::DOUBLE), -0.999::DOUBLE))))', 'value')}, count(c) AS n FROM g GROUP BY 1, 2")
def _(spark, sf):
    return fc.average(fc.pearson(ad.embedding_samples(spark, sf), ["recording", "label"]))


@query("fc_roi_average", f"""WITH {_PEARSON}, {ROI}, u AS (SELECT recording, ch_i, ch_j, value FROM fc UNION ALL SELECT recording, ch_j, ch_i, value FROM fc),
 p AS (SELECT recording, a.roi AS roi_i, b.roi AS roi_j, ch_i, ch_j, atanh(greatest(least(value, 0.999::DOUBLE), -0.999::DOUBLE)) AS z FROM u JOIN roi a ON a.channel = ch_i JOIN roi b ON b.channel = ch_j WHERE a.roi < b.roi OR (a.roi = b.roi AND ch_i < ch_j))
 SELECT recording, roi_i, roi_j, {_r('tanh(avg(z))', 'value')}, {_r('sqrt(greatest(0, avg(z * z) - avg(z) * avg(z)))', 'sd')}, count(z) AS n_pairs, count(DISTINCT ch_i) AS n_channels_i, count(DISTINCT ch_j) AS n_channels_j FROM p GROUP BY 1, 2, 3""")  # fmt: skip
def _(spark, sf):
    return fc.roi_average(_fc(spark, sf).drop("n"), ad.regions(spark), by=["recording"])


@query("fc_threshold", f"WITH {_PEARSON}, c AS (SELECT recording, quantile_cont(value, 0.7) AS cut FROM fc GROUP BY 1) SELECT fc.recording, ch_i, ch_j, CASE WHEN value >= cut THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM fc JOIN c ON fc.recording = c.recording")
def _(spark, sf):
    return fc.threshold(_fc(spark, sf).drop("n"), "sparsity", 0.3, by=["recording"])


@query("fc_handle_negatives", f"WITH {_PEARSON} SELECT recording, ch_i, ch_j, {_r('greatest(value, 0.0)', 'value')} FROM fc")
def _(spark, sf):
    return fc.handle_negatives(_fc(spark, sf).drop("n"))


@query("fc_to_matrix", f"WITH {_PEARSON}, u AS (SELECT recording, ch_i, ch_j, value FROM fc UNION ALL SELECT recording, ch_j, ch_i, value FROM fc) SELECT recording, ch_i, " + ", ".join(_r(f"max(CASE WHEN ch_j = {j} THEN value END)", f'"{j}"') for j in range(64)) + " FROM u GROUP BY 1, 2")
def _(spark, sf):
    return fc.to_matrix(_fc(spark, sf), list(range(64)), by=["recording"])


_GRAPH = f"{_PEARSON}, ct AS (SELECT recording, quantile_cont(value, 0.5) AS cut FROM fc GROUP BY 1), e AS (SELECT fc.recording, ch_i, ch_j FROM fc JOIN ct ON fc.recording = ct.recording WHERE value >= cut), d AS (SELECT recording, node, count(*) AS degree FROM (SELECT recording, ch_i AS node FROM e UNION ALL SELECT recording, ch_j FROM e) GROUP BY 1, 2)"


@query("graph_density", f"WITH {_GRAPH} SELECT recording, count(*) AS n_edges, {_r('2.0 * count(*) / (64 * 63)', 'density')} FROM e GROUP BY 1")
def _(spark, sf):
    return fc.density(fc.threshold(_fc(spark, sf), "sparsity", 0.5, by=["recording"]), 64, by=["recording"])


@query("graph_clustering", f"""WITH {_GRAPH}, t AS (SELECT a.recording, a.ch_i AS a, a.ch_j AS b, b.ch_j AS c FROM e a JOIN e b ON a.recording = b.recording AND a.ch_j = b.ch_i JOIN e x ON x.recording = a.recording AND x.ch_i = a.ch_i AND x.ch_j = b.ch_j),
 n AS (SELECT recording, node, count(*) AS tr FROM (SELECT recording, a AS node FROM t UNION ALL SELECT recording, b FROM t UNION ALL SELECT recording, c FROM t) GROUP BY 1, 2)
 SELECT d.recording, d.node, degree, coalesce(tr, 0) AS triangles, {_r('CASE WHEN degree > 1 THEN 2.0 * coalesce(tr, 0) / (degree * (degree - 1)) ELSE 0 END', 'clustering')} FROM d LEFT JOIN n ON d.recording = n.recording AND d.node = n.node""")  # fmt: skip
def _(spark, sf):
    return fc.clustering(fc.threshold(_fc(spark, sf), "sparsity", 0.5, by=["recording"]), by=["recording"])


@query("autocorrelation", f"WITH {EMB}, c AS (SELECT recording, channel, frame, v - avg(v) OVER (PARTITION BY recording, channel) AS c FROM emb), l AS (SELECT recording, channel, c, lag(c) OVER w AS l1, lag(c, 2) OVER w AS l2 FROM c WINDOW w AS (PARTITION BY recording, channel ORDER BY frame)) SELECT recording, channel, {_r('sum(c * l1) / sum(c * c)', 'rho_1')}, {_r('sum(c * l2) / sum(c * c)', 'rho_2')} FROM l GROUP BY 1, 2")
def _(spark, sf):
    return fc.lagged_products(ad.embedding_samples(spark, sf), 2)


# group ------------------------------------------------------------------------------


@query("group_simple", f"WITH {SUB}, g AS (SELECT grp, count(beta) AS n, avg(beta) AS b, stddev_samp(beta) AS s FROM sub GROUP BY grp) SELECT grp, n AS n_subjects, {_r('b', 'beta')}, {_r('s / sqrt(n + 1e-10)', 'se')}, {_r('b / (s / sqrt(n + 1e-10) + 1e-10)', 't_stat')}, n - 1 AS df FROM g")
def _(spark, sf):
    return group.simple_group(ad.subject_effects(spark, sf), ["grp"])


@query("group_weighted", f"""WITH {SUB}, o AS (SELECT grp, count(*) AS n, sum(1 / var) AS sw, sum(beta / var) AS swb, sum(1 / var / var) AS sww, sum(beta * beta / var) AS swbb FROM sub WHERE var > 0 GROUP BY grp),
 t AS (SELECT grp, n, greatest(0, (swbb - swb * swb / sw - (n - 1)) / nullif(sw - sww / sw, 0)) AS tau FROM o),
 w AS (SELECT s.grp, t.n, tau, sum(1 / (var + tau)) AS sr, sum(beta / (var + tau)) AS srb FROM sub s JOIN t ON s.grp = t.grp WHERE var > 0 GROUP BY 1, 2, 3)
 SELECT grp, n AS n_subjects, {_r('tau', 'tau_sq', 4)}, {_r('srb / sr', 'beta')}, {_r('sqrt(1 / sr)', 'se')}, {_r('srb / sr / sqrt(1 / sr)', 't_stat')}, n - 1 AS df FROM w""")  # fmt: skip
def _(spark, sf):
    return group.weighted_group(ad.subject_effects(spark, sf), ["grp"]).withColumn("tau_sq", F.round("tau_sq", 4))


@query("glm_average", f"WITH {SUB} SELECT grp, {_r('avg(beta)', 'beta')}, {_r('sqrt(avg(var) / count(beta))', 'se')}, CAST(sum(n - 1) AS BIGINT) AS df, count(beta) AS n, {_r('avg(beta) / sqrt(avg(var) / count(beta))', 't_stat')} FROM sub GROUP BY grp")
def _(spark, sf):
    e = ad.subject_effects(spark, sf).select("grp", "beta", F.sqrt("var").alias("se"), (F.col("n") - 1).alias("df"))
    return group.glm_average(e, ["grp"])


@query("fdr_bh", """WITH p AS (SELECT c_custkey AS id, c_mktsegment AS grp, (c_custkey * 7919 % 10007) / 10007.0::DOUBLE AS p FROM customer),
 k AS (SELECT *, count(*) OVER (PARTITION BY grp) AS m, row_number() OVER (PARTITION BY grp ORDER BY p, id) AS k FROM p)
 SELECT id, grp, round(p, 6) AS p, round(least(1.0, min(p * m / k) OVER (PARTITION BY grp ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_fdr FROM k""")  # fmt: skip
def _(spark, sf):
    p = ad.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"), (F.col("c_custkey") * 7919 % 10007 / 10007.0).alias("p"))
    return group.fdr_bh(p, ["grp"])


@query("combine_hb", """WITH x AS (SELECT c_custkey, c_acctbal AS bo, c_nationkey - 12.0::DOUBLE AS br, (1 + c_custkey % 97) / 100.0::DOUBLE AS po, (1 + c_custkey % 89) / 100.0::DOUBLE AS pr FROM customer),
 y AS (SELECT *, -2 * (ln(po) + ln(pr)) AS chi2, CASE WHEN bo > 0 AND br < 0 THEN exp(ln(po) + ln(pr)) * (1 - ln(po) - ln(pr)) ELSE 1.0 END AS p_val FROM x)
 SELECT c_custkey, round(bo - br, 6) AS beta, round(chi2, 6) AS chi2, round(sqrt(chi2), 6) AS t_stat, round(p_val, 6) AS p_val, p_val < 0.05 AS is_significant FROM y""")  # fmt: skip
def _(spark, sf):
    k = F.col("c_custkey")
    c = ad.read(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("beta_hbo"), (F.col("c_nationkey") - 12.0).alias("beta_hbr"), ((1 + k % 97) / 100.0).alias("p_hbo"), ((1 + k % 89) / 100.0).alias("p_hbr"))
    return group.combine_hb(c).select("c_custkey", "beta", "chi2", "t_stat", "p_val", "is_significant")


_DESIGN = f"{EMB}, fr AS (SELECT DISTINCT recording, frame FROM emb), des AS (SELECT recording, frame, 'one' AS regressor, 1.0::DOUBLE AS x FROM fr UNION ALL SELECT recording, frame, 'trend', frame / 100.0::DOUBLE FROM fr UNION ALL SELECT recording, frame, 'wave', cos(frame / 20.0::DOUBLE) FROM fr)"


def _design(spark, sf):
    fr = ad.embedding_samples(spark, sf).select("recording", "frame").distinct()
    rows = F.array(F.struct(F.lit("one").alias("regressor"), F.lit(1.0).alias("x")), F.struct(F.lit("trend").alias("regressor"), (F.col("frame") / 100.0).alias("x")), F.struct(F.lit("wave").alias("regressor"), F.cos(F.col("frame") / 20.0).alias("x")))
    return fr.withColumn("r", F.explode(rows)).select("recording", "frame", "r.regressor", "r.x")


@query("glm_normal_xx", f"WITH {_DESIGN} SELECT a.recording, a.regressor AS r_i, b.regressor AS r_j, {_r('sum(a.x * b.x)', 'xx', 4)} FROM des a JOIN des b ON a.recording = b.recording AND a.frame = b.frame GROUP BY 1, 2, 3", 4)
def _(spark, sf):
    return group.normal_equations(_design(spark, sf), ad.embedding_samples(spark, sf))[0]


@query("glm_normal_xy", f"WITH {_DESIGN} SELECT emb.recording, channel, regressor, {_r('sum(x * v)', 'xy', 4)} FROM emb JOIN des ON emb.recording = des.recording AND emb.frame = des.frame GROUP BY 1, 2, 3", 4)
def _(spark, sf):
    return group.normal_equations(_design(spark, sf), ad.embedding_samples(spark, sf))[1]


@query("contrasts", f"""WITH {_DESIGN}, b AS (SELECT emb.recording, channel, regressor, sum(x * v) AS beta FROM emb JOIN des ON emb.recording = des.recording AND emb.frame = des.frame GROUP BY 1, 2, 3), v AS (SELECT emb.recording, channel, a.regressor AS ri, c.regressor AS rj, avg(a.x * c.x * v * v) AS cov FROM emb JOIN des a ON emb.recording = a.recording AND emb.frame = a.frame JOIN des c ON emb.recording = c.recording AND emb.frame = c.frame GROUP BY 1, 2, 3, 4),
 w AS (SELECT * FROM (VALUES ('up', 'trend', 1.0::DOUBLE), ('diff', 'trend', 1.0), ('diff', 'wave', -1.0)) AS t(contrast, regressor, w)),
 cb AS (SELECT contrast, recording, channel, sum(w * beta) AS beta FROM b JOIN w ON b.regressor = w.regressor GROUP BY 1, 2, 3),
 cv AS (SELECT x.contrast, recording, channel, sum(x.w * y.w * cov) AS q FROM v JOIN w x ON ri = x.regressor JOIN w y ON rj = y.regressor AND x.contrast = y.contrast GROUP BY 1, 2, 3)
 SELECT cb.contrast, cb.recording, cb.channel, {_r('beta', 'beta')}, {_r('sqrt(greatest(q, 1e-15))', 'se')}, {_r('beta / sqrt(greatest(q, 1e-15))', 't_stat', 5)} FROM cb JOIN cv ON cb.contrast = cv.contrast AND cb.recording = cv.recording AND cb.channel = cv.channel""")  # fmt: skip
def _(spark, sf):
    d, s = _design(spark, sf), ad.embedding_samples(spark, sf)
    beta = s.join(d, ["recording", "frame"]).groupBy("recording", "channel", "regressor").agg(F.sum(F.col("x") * F.col("v")).alias("beta"))
    di, dj = d.select("recording", "frame", F.col("regressor").alias("r_i"), F.col("x").alias("a")), d.select("recording", "frame", F.col("regressor").alias("r_j"), F.col("x").alias("b"))
    cov = s.join(di, ["recording", "frame"]).join(dj, ["recording", "frame"]).groupBy("recording", "channel", "r_i", "r_j").agg(F.avg(F.col("a") * F.col("b") * F.col("v") ** 2).alias("cov"))
    w = spark.createDataFrame([("up", "trend", 1.0), ("diff", "trend", 1.0), ("diff", "wave", -1.0)], "contrast string, regressor string, weight double")
    return group.contrasts(beta, cov, w, ["recording", "channel"]).withColumn("t_stat", F.round("t_stat", 5))


@query("sign_flip_null", f"""WITH {SUB}, s AS (SELECT grp, subject, beta - 140 AS beta FROM sub), f AS (SELECT unnest(range(0, 200)) AS flip),
 t AS (SELECT grp, flip, avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM (SELECT grp, flip, CASE WHEN flip > 0 AND hash_bit THEN -beta ELSE beta END AS x FROM
  (SELECT grp, flip, beta, (CAST(('0x' || substr(md5('0:' || flip || ':' || subject), 1, 1)) AS INTEGER) & 1) = 1 AS hash_bit FROM s, f)) GROUP BY 1, 2)
 SELECT grp, flip, {_r('m / (sd / sqrt(n))', 't_stat')} FROM t""")  # fmt: skip
def _(spark, sf):
    e = ad.subject_effects(spark, sf).select("grp", "subject", (F.col("beta") - 140).alias("beta"))
    return group.sign_flip_t(e, ["grp"], 200)


@query("add_metadata", f"WITH {SUB} SELECT subject, grp, {_r('beta', 'beta')}, n_name FROM sub JOIN customer ON subject = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    meta = ad.read(spark, sf, "customer").join(ad.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("subject"), "n_name")
    return ad.subject_effects(spark, sf).join(meta, "subject", "left").select("subject", "grp", "beta", "n_name")


# probe ------------------------------------------------------------------------------


@query("channel_adjacency", f"WITH {CHN} SELECT a.channel AS ch_i, b.channel AS ch_j, {_r('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))', 'mm')} FROM chn a JOIN chn b ON a.channel < b.channel AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) <= 12.5")
def _(spark, sf):
    return probe.midpoint_pairs(ad.channels(spark), 12.5)


@query("channel_distance_matrix", f"WITH {CHN} SELECT a.channel AS ch_i, b.channel AS ch_j, {_r('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))', 'mm')} FROM chn a JOIN chn b ON a.channel < b.channel")
def _(spark, sf):
    return probe.distance_matrix(ad.channels(spark))


@query("nearest_short_channel", f"""WITH {CHN}, p AS (SELECT a.channel, b.channel AS short, row_number() OVER (PARTITION BY a.channel ORDER BY round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 9), b.channel) AS k
 FROM chn a, chn b WHERE NOT a.is_bad AND NOT b.is_bad AND NOT a.is_short AND b.is_short) SELECT channel, short FROM p WHERE k = 1""")  # fmt: skip
def _(spark, sf):
    return probe.nearest_short(ad.channels(spark))


@query("probe_compare", f"WITH {CHN}, a AS (SELECT * FROM chn WHERE channel < 40), b AS (SELECT channel, x + 0.5 AS x, y, z FROM chn WHERE channel >= 20) SELECT coalesce(a.channel, b.channel) AS channel, CASE WHEN b.channel IS NULL THEN 'missing' WHEN a.channel IS NULL THEN 'extra' ELSE 'shared' END AS state, {_r('sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))', 'offset_mm')} FROM a FULL JOIN b ON a.channel = b.channel")
def _(spark, sf):
    c = ad.channels(spark)
    return probe.compare(c.filter("channel < 40"), c.filter("channel >= 20").withColumn("x", F.col("x") + 0.5))


@query("roi_by_position", f"WITH {CHN} SELECT 'near' AS roi, channel FROM chn WHERE sqrt(pow(x - 30, 2) + pow(y - 30, 2) + pow(z - 5, 2)) <= 15")
def _(spark, sf):
    return probe.roi_by_position(ad.channels(spark), "near", (30.0, 30.0, 5.0), 15.0)


@query("lattice_adjacency", "WITH v AS (SELECT i * 30 + j * 5 + k AS voxel, i, j, k FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(6)) AS j), (SELECT unnest(range(5)) AS k)) SELECT a.voxel AS a, b.voxel AS b FROM v a JOIN v b ON a.voxel < b.voxel AND greatest(abs(a.i - b.i), abs(a.j - b.j), abs(a.k - b.k)) = 1 AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= 2")
def _(spark, sf):
    v = spark.range(180).select(F.col("id").alias("voxel"), F.floor(F.col("id") / 30).cast("int").alias("i"), F.floor(F.col("id") % 30 / 5).cast("int").alias("j"), (F.col("id") % 5).cast("int").alias("k"))
    return probe.lattice_adjacency(v)


_SENS = f"{EMB}, sens AS (SELECT channel % 2 AS wavelength, channel // 2 AS channel, recording * {ad.FRAMES} + frame AS voxel, v AS value FROM emb)"


def _sens(spark, sf):
    return ad.embedding_samples(spark, sf).select((F.col("channel") % 2).alias("wavelength"), F.floor(F.col("channel") / 2).cast("int").alias("channel"), (F.col("recording") * ad.FRAMES + F.col("frame")).alias("voxel"), F.col("v").alias("value"))


@query("sensitivity_coverage", f"WITH {_SENS} SELECT voxel, {_r('min(c)', 'coverage')} FROM (SELECT wavelength, voxel, sum(value * value) AS c FROM sens GROUP BY 1, 2) GROUP BY voxel")
def _(spark, sf):
    return probe.coverage(_sens(spark, sf))


@query("sensitivity_normalised", f"WITH {_SENS}, n AS (SELECT channel, voxel, abs(value) / max(abs(value)) OVER (PARTITION BY wavelength, channel) AS n FROM sens) SELECT CAST(channel AS INTEGER) AS channel, voxel, {_r('avg(n)', 'value')} FROM n GROUP BY 1, 2")
def _(spark, sf):
    return probe.normalised(_sens(spark, sf))


@query("sensitivity_backproject", f"WITH {_SENS}, n AS (SELECT channel, voxel, abs(value) / max(abs(value)) OVER (PARTITION BY wavelength, channel) AS n FROM sens), w AS (SELECT channel, voxel, avg(n) AS w FROM n GROUP BY 1, 2) SELECT voxel, {_r('sum(w * (channel + 1)) / sum(w)', 'value')} FROM w GROUP BY voxel")
def _(spark, sf):
    values = spark.range(32).select(F.col("id").cast("int").alias("channel"), (F.col("id") + 1.0).cast("double").alias("value"))
    return probe.backproject(_sens(spark, sf), values)


@query("label_summary", "SELECT o_orderpriority AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS fraction FROM orders GROUP BY 1")
def _(spark, sf):
    return probe.label_summary(ad.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("label")))


@query("block_average_od", f"""WITH {EVS}, f AS (SELECT recording, channel, min(t) AS t0 FROM evs GROUP BY 1, 2), b AS (SELECT evs.recording, evs.channel, CAST(floor((evs.t - t0) / 3600) AS BIGINT) AS block, avg(abs(v)) AS v FROM evs JOIN f ON evs.recording = f.recording AND evs.channel = f.channel GROUP BY 1, 2, 3)
 SELECT recording, channel, block, {_r('-ln((v + 1e-10) / avg(v) OVER (PARTITION BY recording, channel) + 1e-10)', 'od')} FROM b""")  # fmt: skip
def block_average_od(spark, sf):
    blocks = streams.average_seconds(ad.event_samples(spark, sf).withColumn("v", F.abs("v")), 3600.0)
    return streams.intensity_to_od(blocks).select("recording", "channel", "block", "od")
