"""Per-montage, per-graph and per-map estimators as grouped functions, and a registry of pair measures.

A group is the channels of a recording, a montage's graph or one statistic map: bounded by the
instrument or the lattice, never by the number of recordings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucera.functions import lattice, networks, pairs, signal, spectra
from lucera.functions.registries import BIAS_CORRECTIONS, CROSS_MEASURES, DISTANCES, batched, bias_correction

#: Measures of two series, fs and options to one number; register_measure adds to it.
MEASURES: dict = {}


def register_measure(name: str):
    def put(f):
        MEASURES[name] = f
        return f

    return put


@register_measure("pearson")
@batched(pairs.pearson)
def _pearson(x, y, fs):
    return float(np.corrcoef(x, y)[0, 1]) if x.std() > 0 < y.std() else float("nan")


@register_measure("n_eff")
@batched(pairs.n_eff)
def _n_eff(x, y, fs, **kw):
    return spectra.effective_samples(x, y, **kw)


@register_measure("coherence")
@batched(pairs.coherence)
def _coherence(x, y, fs, low=0.0, high=np.inf, nperseg=64):
    f, c = signal.coherence(x, y, fs, nperseg)
    return float(np.nanmean(c[(f >= low) & (f <= high)]))


@register_measure("wavelet_coherence")
@batched(pairs.wavelet_coherence)
def _wavelet(x, y, fs, low=0.0, high=np.inf, **kw):
    f, c = spectra.wavelet_coherence(x, y, fs, **kw)
    c = c[(f >= low) & (f <= high)]
    return float(np.nanmean(c)) if np.isfinite(c).any() else float("nan")


@register_measure("sci")
@batched(pairs.scalp_coupling)
def _sci(x, y, fs, **kw):
    return float(np.nanmedian(spectra.scalp_coupling(x, y, fs, **kw)))


@register_measure("psp")
@batched(pairs.peak_power)
def _psp(x, y, fs, **kw):
    return float(np.nanmedian(spectra.peak_power(x, y, fs, **kw)))


def _spread(df: DataFrame) -> DataFrame:
    """Recordings over all shuffle partitions: their bytes are few and their work is not, so they must not be coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "recording")


def pairwise(samples: DataFrame, method: str, fs: float, other: DataFrame | None = None, surrogates: int = 0, seed: int = 0, correction: str = "phase_randomization", **kw) -> DataFrame:
    """(recording, ch_i, ch_j, value) of a registered measure over the pairs ch_i < ch_j of a
    recording, or over all of one stream with all of another; with surrogates, bias-corrected.
    A series with a null or fewer than two samples, or of another length, has a null value.

    A recording is one group: its samples move once, and a measure with a form for many series
    works out what a series needs once, not once a pair."""
    f = CROSS_MEASURES.get(method) if other is not None and method in CROSS_MEASURES.items else MEASURES[method]
    correct = bias_correction(correction, method, **kw) if surrogates and (correction, method) in BIAS_CORRECTIONS.items else spectra.bias_corrected
    many = getattr(f, "many", None) if not surrogates or correct is spectra.bias_corrected else None
    kind, rec = (dict(samples.dtypes)[c] for c in ("channel", "recording"))

    def series(pdf):
        groups = pdf.sort_values(["channel", "frame", "v"], na_position="first").groupby("channel", sort=False, dropna=False)["v"]
        channels, x = zip(*[(c, v.to_numpy(float)) for c, v in groups], strict=True)
        return pd.Series(channels), x, [len(v) if len(v) > 1 and np.isfinite(v).all() else 0 for v in x]

    def one(x, y):
        return correct(x, y, lambda u, v: f(u, v, fs, **kw), surrogates, seed) if surrogates else f(x, y, fs, **kw)

    def table(recording, a, b=None):
        (ch_i, x, size), (ch_j, y, width) = a, b or a
        value = np.full((len(x), len(y)), np.nan)
        i, j = np.triu_indices(len(x), 1) if b is None else np.nonzero(np.ones(value.shape, bool))
        for n in {*size} & {*width} - {0}:
            p, q = np.flatnonzero(np.equal(size, n)), np.flatnonzero(np.equal(width, n))
            if many:
                measure = many(fs, n, **kw)
                measure = pairs.bias_corrected(measure, n, surrogates, seed) if surrogates else measure
                value[np.ix_(p, q)] = pairs.values(np.stack([x[k] for k in p]), None if b is None else np.stack([y[k] for k in q]), measure)
            else:
                for u, v in zip(i, j, strict=True):
                    if size[u] == width[v] == n:
                        value[u, v] = one(x[u], y[v])
        return pd.DataFrame({"recording": recording, "ch_i": ch_i.iloc[i].to_numpy(), "ch_j": ch_j.iloc[j].to_numpy(), "value": value[i, j]})

    cols = [*[F.col(c).alias(c) for c in ("recording", "channel", "frame")], F.col("v").cast("double").alias("v")]  # both streams may be one DataFrame
    schema = f"recording {rec}, ch_i {kind}, ch_j {kind}, value double"
    a = _spread(samples.filter("recording IS NOT NULL").select(*cols))
    if other is None:
        return a.filter("channel IS NOT NULL").groupBy("recording").applyInPandas(lambda p: table(p["recording"].iloc[0], series(p)), schema)
    b = _spread(other.filter("recording IS NOT NULL").select(*cols))
    none = pd.DataFrame({c: [] for c in ("recording", "ch_i", "ch_j", "value")})
    return a.groupBy("recording").cogroup(b.groupBy("recording")).applyInPandas(lambda p, q: table(p["recording"].iloc[0], series(p), series(q)) if len(p) and len(q) else none, schema)


def _matrix(pdf: pd.DataFrame, nodes: list) -> np.ndarray:
    at = {c: i for i, c in enumerate(nodes)}
    m = np.eye(len(nodes))
    i, j = pdf["ch_i"].map(at).to_numpy(), pdf["ch_j"].map(at).to_numpy()
    m[i, j] = m[j, i] = pdf["value"].to_numpy(float)
    return m


def geodesic_distance(a: DataFrame, b: DataFrame, alpha: float = 0.5) -> DataFrame:
    return distance(a, b, "geodesic", alpha=alpha)


def distance(a: DataFrame, b: DataFrame, method="geodesic", **kw) -> DataFrame:
    """(recording, distance) of the connectivity of each recording in a and b, by a registered method or a
    function of two matrices; null where a cell is."""
    between = DISTANCES.resolve(method)
    rec = dict(a.dtypes)["recording"]

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"recording": [], "distance": []})
        nodes = sorted({*x["ch_i"], *x["ch_j"], *y["ch_i"], *y["ch_j"]})
        m, n = _matrix(x, nodes), _matrix(y, nodes)
        ok = np.isfinite(m).all() and np.isfinite(n).all()
        return pd.DataFrame({"recording": x["recording"].iloc[:1], "distance": [float(between(m, n, **kw)) if ok else None]})

    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # a and b may be one DataFrame
    return a.groupBy("recording").cogroup(b.groupBy("recording")).applyInPandas(run, f"recording {rec}, distance double")


def network_metrics(edges: DataFrame, nodes: list, small_world_nulls: int = 0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Global metrics a recording (long: metric, value) and nodal ones (node, metric, value) of the
    edges (recording, ch_i, ch_j); nodes without an edge count."""
    rec, kind = (dict(edges.dtypes)[c] for c in ("recording", "ch_i"))

    def adjacency(pdf):
        return (_matrix(pdf.assign(value=1.0), nodes) - np.eye(len(nodes))).astype(bool)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        a = adjacency(pdf)
        m = {"density": a.mean() * len(a) / max(1, len(a) - 1), "clustering": networks.clustering(a).mean(), "efficiency": networks.global_efficiency(a), "path_length": networks.path_length(a)}
        if small_world_nulls:
            m |= networks.small_worldness(a, np.random.default_rng(seed), small_world_nulls)
        return pd.DataFrame({"recording": pdf["recording"].iloc[0], "metric": list(m), "value": list(m.values())})

    def nodal(pdf: pd.DataFrame) -> pd.DataFrame:
        a = adjacency(pdf)
        m = {"degree": a.sum(1), "efficiency": networks.nodal_efficiency(a), "betweenness": networks.betweenness(a), "clustering": networks.clustering(a)}
        return pd.concat([pd.DataFrame({"recording": pdf["recording"].iloc[0], "node": nodes, "metric": k, "value": v.astype(float)}) for k, v in m.items()])

    g = _spread(edges).groupBy("recording")
    return g.applyInPandas(whole, f"recording {rec}, metric string, value double"), g.applyInPandas(nodal, f"recording {rec}, node {kind}, metric string, value double")


def circular_shift_null(samples: DataFrame, task: np.ndarray, other: np.ndarray, fs: float, n_perm: int = 1000, min_shift_s: float = 30.0, seed: int = 0) -> DataFrame:
    """(recording, shift, max_t): the largest |t| over channels at each shift; shift 0 is observed.
    A task a channel, then a maximum that combines before its shuffle."""
    rec, gap = dict(samples.dtypes)["recording"], int(round(min_shift_s * fs))
    if len(task) <= 2 * gap:
        raise ValueError("the recording is shorter than two least shifts")
    shifts = np.concatenate([[0], np.random.default_rng(seed).integers(gap, len(task) - gap, n_perm)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("frame")["v"].to_numpy(float)
        t = spectra.shift_t(y, task, other, shifts) if np.isfinite(y).all() and len(y) == len(task) else np.full(len(shifts), np.nan)
        return pd.DataFrame({"recording": pdf["recording"].iloc[0], "perm": range(len(shifts)), "shift": shifts, "t": t})

    per = samples.groupBy("recording", "channel").applyInPandas(run, f"recording {rec}, perm int, shift long, t double")
    return per.filter(~F.isnan("t")).groupBy("recording", "perm", "shift").agg(F.max(F.abs("t")).alias("max_t"))


def regress_nuisance(samples: DataFrame, design: pd.DataFrame, keys=("recording", "channel"), robust: bool = True) -> DataFrame:
    """v less what the nuisance design explains, its constant columns kept."""
    from lucera.operators.series import per_series

    whole = design.to_numpy(float)
    flat = np.ptp(whole, axis=0) == 0

    def clean(y):
        x = whole[: len(y)]
        b = signal.robust_fit(x, y)[0] if robust else np.linalg.lstsq(x, y, rcond=None)[0]
        return y - x[:, ~flat] @ b[~flat]

    return per_series(samples, clean, keys)


def clusters(stats: DataFrame, edges: pd.DataFrame, keys: list[str], cut: float, null: DataFrame | None = None, kind: str = "mass", exhaustive: bool = False) -> DataFrame:
    """(keys, cluster, sign, size, statistic, peak_t, peak_node, p_fwe) of maps (keys, node, t): both
    signs; with null maps (keys, perm, node, t) the p of each cluster over the null's maxima. edges
    (a, b) are the lattice's, sent with the function."""
    ea, eb = edges["a"].to_numpy(), edges["b"].to_numpy()
    n = int(max(ea.max(initial=0), eb.max(initial=0))) + 1 if len(ea) else 1
    sch = lambda df: ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    schema = sch(stats) + ", cluster int, sign int, size long, statistic double, peak_t double, peak_node long, p_fwe double"
    cols = [*keys, "cluster", "sign", "size", "statistic", "peak_t", "peak_node", "p_fwe"]

    def full(pdf):
        size = max(n, int(pdf["node"].max()) + 1) if len(pdf) else n
        v = np.zeros(size)
        v[pdf["node"].to_numpy()] = np.nan_to_num(pdf["t"].to_numpy(float))
        return v

    def table(pdf, maxima):
        t, out = full(pdf), []
        for sign in (1, -1):
            lab, value = lattice.cluster_values(sign * t, ea, eb, cut, kind)
            p = lattice.max_statistic_p(value, maxima, exhaustive) if maxima is not None else np.full(len(value), np.nan)
            for c, (v, q) in enumerate(zip(value, p, strict=True), 1):
                at = np.flatnonzero(lab == c)
                peak = at[np.argmax(sign * t[at])]
                out.append([*pdf[keys].iloc[0], 0, sign, len(at), v, t[peak], peak, q])
        df = pd.DataFrame(out, columns=cols).sort_values(["p_fwe", "size", "peak_node"], ascending=[True, False, True])
        return df.assign(cluster=range(1, len(df) + 1))

    if null is None:
        return stats.groupBy(*keys).applyInPandas(lambda p: table(p, None), schema)

    def most(pdf: pd.DataFrame) -> pd.DataFrame:
        t = full(pdf)
        m = max(lattice.cluster_values(s * t, ea, eb, cut, kind)[1].max(initial=0.0) for s in (1, -1))
        return pdf[[*keys]].iloc[:1].assign(m=m)

    maxima = null.groupBy(*keys, "perm").applyInPandas(most, sch(null) + ", m double")
    return stats.groupBy(*keys).cogroup(maxima.groupBy(*keys)).applyInPandas(lambda p, m: table(p, m["m"].to_numpy()) if len(p) else pd.DataFrame([], columns=cols), schema)
