"""Studies: the tables of many recordings under one set of names, their pipelines and group results.

A study holds samples (recording, channel, frame, t, v) by stream name, events, channels and metadata
(recording, subject and whatever describes it). A session is a study of one subject's recordings: every
operator works on all recordings at once, keyed by recording. Tables are lazy; nothing is read before a
result is.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucera.functions.registries import STEPS, register_step
from lucera.operators import connectivity, group, inference, results, rois, series, streams
from lucera.sources import readers, snirf


@dataclass(frozen=True)
class Study:
    spark: SparkSession
    meta: DataFrame
    streams: dict[str, DataFrame] = field(default_factory=dict)
    events: DataFrame | None = None
    channels: DataFrame | None = None
    outputs: dict[str, DataFrame] = field(default_factory=dict)

    # tables

    def add_stream(self, name: str, samples: DataFrame) -> Study:
        return replace(self, streams=self.streams | {name: samples})

    def add_stream_path(self, name: str, path: str) -> Study:
        """A stream of SNIRF files, read when it is needed."""
        return self.add_stream(name, snirf.read_snirf(self.spark, path))

    def get_stream(self, name: str) -> DataFrame:
        if name not in self.streams:
            raise KeyError(f"no stream {name!r}; there are {', '.join(sorted(self.streams))}")
        return self.streams[name]

    def unload_stream(self, name: str) -> Study:
        self.get_stream(name).unpersist()
        return self

    def get_probe(self, path: str) -> DataFrame:
        """Optodes of files, without their samples."""
        return snirf.read_snirf_probe(self.spark, path)

    def load_all_streams(self) -> Study:
        """Marks every stream to be kept in memory once read."""
        return replace(self, streams={n: s.persist() for n, s in self.streams.items()})

    def add_session(self, other: Study) -> Study:
        """Both studies' recordings; streams that only one has stay."""
        joined = dict(self.streams)
        for n, s in other.streams.items():
            joined[n] = joined[n].unionByName(s, allowMissingColumns=True) if n in joined else s
        events = self.events if other.events is None else other.events if self.events is None else self.events.unionByName(other.events)
        return replace(self, meta=self.meta.unionByName(other.meta, allowMissingColumns=True), streams=joined, events=events)

    def select(self, filters: dict) -> Study:
        """Recordings whose metadata match: a value, a list, or (op, threshold)."""
        meta = self.meta.filter(streams.session_matches(filters))
        keep = meta.select("recording")
        return replace(self, meta=meta, streams={n: s.join(keep, "recording", "left_semi") for n, s in self.streams.items()}, events=None if self.events is None else self.events.join(keep, "recording", "left_semi"))

    # pipelines

    def preprocess(self, stream: str, pipeline: list[tuple[str, dict]], output: str | None = None) -> Study:
        """Steps by name, one after another; an unknown name raises before any is planned."""
        steps = [(STEPS.get(name), options) for name, options in pipeline]
        samples = self.get_stream(stream)
        for f, options in steps:
            samples = f(samples, **options)
        return self.add_stream(output or stream, samples)

    def run_glm(self, stream: str, design, pipeline=(), method: str = "ar-irls", average_runs: bool = False, average_subjects: bool = False, **options) -> DataFrame:
        """Fits of every recording (recording, channel, regressor, beta, se, t_stat, df); averaged over a
        subject's recordings, or over subjects' averages, where asked."""
        samples = self.preprocess(stream, list(pipeline)).get_stream(stream)
        fit = series.glm(samples, design, method, **options)
        return self._averaged(fit.withColumn("t_stat", F.try_divide("beta", "se")), average_runs, average_subjects)

    def glm_by_tables(self, stream: str, design: DataFrame, average_runs: bool = False, average_subjects: bool = False) -> DataFrame:
        """Least squares of one regressor (recording, frame, regressor, x) at a time, each with a constant, by aggregates."""
        samples = self.get_stream(stream)
        both = samples.join(design, ["recording", "frame"]).filter("v IS NOT NULL")
        fit = both.groupBy("recording", "channel", "regressor").agg(
            F.regr_slope("v", "x").alias("beta"), F.regr_sxx("v", "x").alias("_sxx"), F.regr_syy("v", "x").alias("_syy"), F.regr_sxy("v", "x").alias("_sxy"), (F.count("v") - 2).alias("df")
        )
        left = F.greatest(F.lit(0.0), F.col("_syy") - F.try_divide(F.col("_sxy") ** 2, F.col("_sxx")))
        fit = fit.withColumn("se", F.sqrt(F.try_divide(F.try_divide(left, F.col("df")), F.col("_sxx")))).drop("_sxx", "_syy", "_sxy")
        return self._averaged(fit.withColumn("t_stat", F.try_divide("beta", "se")), average_runs, average_subjects)

    def _averaged(self, fit: DataFrame, runs: bool, subjects: bool) -> DataFrame:
        if not (runs or subjects):
            return fit
        named = fit.join(self.meta.select("recording", "subject"), "recording")
        per = group.glm_average(named, ["subject", "channel", "regressor"])
        return group.glm_average(per, ["channel", "regressor"]) if subjects else per

    def group_stats(self, fit: DataFrame, method: str = "weighted", by=("channel", "regressor")) -> DataFrame:
        """Subjects' effects (subject, by, beta, se) to a simple or a random-effects group."""
        effects = fit.withColumn("var", F.col("se") ** 2)
        return group.weighted_group(effects, list(by)) if method == "weighted" else group.simple_group(effects, list(by))

    def permutation_null(self, stream: str, task, other, fs: float, n_perm: int = 1000, min_shift_s: float = 30.0, seed: int = 0) -> DataFrame:
        return inference.circular_shift_null(self.get_stream(stream), task, other, fs, n_perm, min_shift_s, seed)

    def run_fc(self, stream: str, method: str = "pearson", fs: float = 1.0, segments: DataFrame | None = None, average_runs: bool = False, average_subjects: bool = False, roi=None, **options) -> DataFrame:
        """(recording, ch_i, ch_j, value); of event segments, averaged over a subject's recordings, over all
        subjects, or over regions, where asked. Averages are of Fisher's z."""
        samples, keys = self.get_stream(stream), ["recording"]
        if segments is not None:
            samples, keys = streams.segment_by_events(samples, segments, **options.pop("pads", {})), ["recording", "label", "seg_start"]
        if method == "pearson":
            fc = connectivity.pearson(samples, keys)
        elif segments is None:
            fc = inference.pairwise(samples, method, fs, **options)
        else:
            raise ValueError("event segments take the pearson method")
        if segments is not None:  # the occurrences of a label
            keys = ["recording", "label"]
            fc = connectivity.average(fc, (*keys, "ch_i", "ch_j")).drop("n")
        if average_runs or average_subjects:
            fc = fc.join(self.meta.select("recording", "subject"), "recording")
            keys = ["subject", *keys[1:]]
            fc = connectivity.average(fc, (*keys, "ch_i", "ch_j")).drop("n")
        if average_subjects:
            keys = keys[1:]
            fc = connectivity.average(fc, (*keys, "ch_i", "ch_j")).drop("n")
        return postprocess_fc(fc, roi=None if roi is None else rois.resolve(self.spark, roi, self.channels), by=keys)

    def block_average(self, stream: str, window_s: float, method: str = "mean") -> DataFrame:
        return streams.average_seconds(self.get_stream(stream), window_s, method=method)

    def probe_consistency(self, montage: DataFrame) -> DataFrame:
        """(relation, recordings) of each recording's channels (recording, channel) to those of the first one:
        identical, nested, overlapping or incompatible."""
        first = montage.agg(F.min("recording").alias("r"))
        ref = montage.join(F.broadcast(first), montage["recording"] == first["r"]).select("channel").distinct().withColumn("_in", F.lit(1))
        size = ref.agg(F.count(F.lit(1)).alias("_ref"))  # one row
        per = montage.select("recording", "channel").distinct().join(F.broadcast(ref), "channel", "left").groupBy("recording").agg(F.count(F.lit(1)).alias("n"), F.count("_in").alias("shared"))
        per = per.crossJoin(F.broadcast(size))
        relation = F.when((F.col("n") == F.col("shared")) & (F.col("n") == F.col("_ref")), "identical").when(F.col("shared") == 0, "incompatible").when((F.col("shared") == F.col("n")) | (F.col("shared") == F.col("_ref")), "nested").otherwise("overlapping")
        return per.withColumn("relation", relation).groupBy("relation").agg(F.count(F.lit(1)).alias("recordings"))

    def to_dataframe(self, parts: dict, level_names=("condition",)) -> DataFrame:
        return results.to_dataframe(parts, level_names, self.meta)

    def save(self, folder: str) -> None:
        tables = {f"stream_{n}": s for n, s in self.streams.items()} | {f"output_{n}": s for n, s in self.outputs.items()} | {"meta": self.meta}
        results.save_all(tables | ({"events": self.events} if self.events is not None else {}) | ({"channels": self.channels} if self.channels is not None else {}), folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Study:
        t, _ = results.load_all(spark, folder)
        part = lambda p: {n.removeprefix(p): s for n, s in t.items() if n.startswith(p)}
        return cls(spark, t["meta"], part("stream_"), t.get("events"), t.get("channels"), part("output_"))

    @classmethod
    def from_snirf(cls, spark: SparkSession, path: str, name: str = "optical") -> Study:
        samples = snirf.read_snirf(spark, path)
        meta = snirf.read_measurement_list(spark, path).select("recording").distinct()
        meta = meta.select("recording", *readers.entities(F.col("recording"))).withColumn("subject", F.coalesce("subject", "recording"))
        return cls(spark, meta, {name: samples, "aux": snirf.read_snirf_aux(spark, path)}, snirf.read_snirf_events(spark, path))


def postprocess_fc(fc: DataFrame, reduce: dict | None = None, roi: DataFrame | None = None, by=("recording",)) -> DataFrame:
    """Reduces an axis (axis, lo, hi), then averages over regions."""
    check_fc_postprocess(reduce, roi)
    if reduce:
        fc = connectivity.reduce(fc, by=(*by, "ch_i", "ch_j"), **reduce)
    return fc if roi is None else connectivity.roi_average(fc, roi, by=by)


def check_fc_postprocess(reduce: dict | None, roi) -> None:
    """Raises on unknown options, before anything is planned."""
    unknown = set(reduce or {}) - {"axis", "lo", "hi", "how"}
    if unknown or (reduce and not {"axis", "lo", "hi"} <= set(reduce)):
        raise ValueError(f"reduce takes axis, lo, hi and how, not {sorted(unknown) or sorted(reduce)}")


def group_connectivity(fc: DataFrame) -> DataFrame:
    """Fisher-z mean over all recordings."""
    return connectivity.average(fc)


def _optical_density(samples: DataFrame, **kw) -> DataFrame:
    return streams.intensity_to_od(samples, **kw).withColumn("v", F.col("od")).drop("od")


register_step("intensity_to_od")(_optical_density)
register_step("detrend")(streams.detrend)
register_step("frequency_filter")(series.frequency_filter)
register_step("tddr")(series.tddr)
register_step("wavelet_correct")(series.wavelet_correct)
register_step("resample")(series.resample)
register_step("scale")(lambda samples, by: samples.withColumn("v", F.col("v") * by))
register_step("drop_channels")(lambda samples, labels: samples.filter(~F.col("channel").isin(labels)))
