"""Ordered or iterative algorithms, one series per group in an Arrow-backed grouped function.

A group is one channel of one recording, so groups stay small however many recordings there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucera.functions import signal

KEYS = ["recording", "channel"]


def per_series(samples: DataFrame, f, keys=tuple(KEYS)) -> DataFrame:
    """v replaced by f(values in order of frame)."""
    cols = [*keys, "frame", "t", "v"]
    schema = ", ".join(f"`{n}` {t}" for n, t in samples.select(*cols).dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        x = pdf["v"].to_numpy(float)
        return pdf.assign(v=f(x) if np.isfinite(x).all() and len(x) > 1 else np.nan)[cols]

    return samples.select(*cols).groupBy(*keys).applyInPandas(run, schema)


def frequency_filter(samples, fs: float, low=None, high=None, order: int = 3) -> DataFrame:
    return per_series(samples, lambda x: signal.frequency_filter(x, fs, low, high, order))


def tddr(samples, fs: float, **kw) -> DataFrame:
    return per_series(samples, lambda x: signal.tddr(x, fs, **kw))


def wavelet_correct(samples, **kw) -> DataFrame:
    return per_series(samples, lambda x: signal.wavelet_correction(x, **kw))


def band_snr(samples: DataFrame, fs: float, band: tuple[float, float], noise: tuple[float, float] | None = None, window_s: float | None = None, step_s: float | None = None, keys=tuple(KEYS)) -> DataFrame:
    """(keys, snr): deviation in the band over that in the noise band, or over what the band leaves; with
    window_s the median over sliding windows (half overlapping unless step_s is given). Flat series are null."""
    schema = ", ".join(f"`{n}` {t}" for n, t in samples.select(*keys).dtypes) + ", snr double"

    def one(x):
        if not np.isfinite(x).all() or x.std() == 0:
            return np.nan
        s = signal.frequency_filter(x, fs, *band)
        other = signal.frequency_filter(x, fs, *noise) if noise else x - s
        return s.std() / (other.std() + 1e-12)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("frame")["v"].to_numpy(float)
        if window_s is None:
            got = one(x)
        else:
            size, hop = int(window_s * fs), max(1, int((window_s / 2 if step_s is None else step_s) * fs))
            per = [one(x[a : a + size]) for a in range(0, len(x) - size + 1, hop)]
            got = np.nanmedian(per) if np.isfinite(per).any() else np.nan
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "snr": [got]})

    return samples.groupBy(*keys).applyInPandas(run, schema)


def resample(samples: DataFrame, fs: float, new_fs: float, keys=tuple(KEYS)) -> DataFrame:
    from fractions import Fraction

    ratio = Fraction(new_fs / fs).limit_denominator(1000)
    schema = ", ".join(f"`{n}` {t}" for n, t in samples.select(*keys).dtypes) + ", frame long, t double, v double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        y = signal.resample(pdf["v"].to_numpy(float), ratio.numerator, ratio.denominator)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(y) for k in keys}, "frame": range(len(y)), "t": pdf["t"].iloc[0] + np.arange(len(y)) / new_fs, "v": y})

    return samples.groupBy(*keys).applyInPandas(run, schema)


def heart_rate(samples: DataFrame, fs: float, keys=tuple(KEYS)) -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in samples.select(*keys).dtypes) + ", bpm double"
    run = lambda pdf: pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "bpm": [signal.heart_rate(pdf.sort_values("frame")["v"].to_numpy(float), fs)]})
    return samples.groupBy(*keys).applyInPandas(run, schema)


def coherence(samples: DataFrame, fs: float, low: float, high: float, nperseg: int = 64) -> DataFrame:
    """(recording, ch_i, ch_j, value): mean coherence in a band. A pair is a group of its own, so
    the pairs of a large montage spread over tasks."""
    kind = dict(samples.dtypes)["channel"]
    a = samples.groupBy("recording", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "v"))), lambda s: s["v"]).alias("x"))
    b = a.withColumnsRenamed({"channel": "ch_j", "x": "y"})
    pairs = a.withColumnRenamed("channel", "ch_i").join(b, "recording").filter("ch_i < ch_j")

    def run(batches):
        for pdf in batches:
            out = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                f, c = signal.coherence(np.asarray(x, float), np.asarray(y, float), fs, nperseg)
                out.append(np.nanmean(c[(f >= low) & (f <= high)]))
            yield pdf[["recording", "ch_i", "ch_j"]].assign(value=out)

    return pairs.mapInPandas(run, f"recording string, ch_i {kind}, ch_j {kind}, value double")


def glm(samples: DataFrame, design: pd.DataFrame, method: str = "ar-irls", pmax: int = 8, keys=tuple(KEYS)) -> DataFrame:
    """(keys, regressor, beta, se, df, ar_order) per series; design: frames by regressors, small
    and broadcast with the function."""
    whole, names = design.to_numpy(float), list(design.columns)
    schema = ", ".join(f"`{n}` {t}" for n, t in samples.select(*keys).dtypes) + ", regressor string, beta double, se double, df long, ar_order int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("frame")["v"].to_numpy(float)
        if not np.isfinite(y).all() or len(y) <= len(names):
            return pd.DataFrame({c: [] for c in [*keys, "regressor", "beta", "se", "df", "ar_order"]})
        x = whole[: len(y)]
        order, df = 0, len(y) - len(names)
        if method == "ar-irls":
            b, cov, order = signal.ar_irls(y, x, pmax)
        else:
            b = signal.robust_fit(x, y)[0] if method == "robust" else np.linalg.lstsq(x, y, rcond=None)[0]
            r = y - x @ b
            cov = signal.robust_covariance(x, r) if method == "robust" else np.linalg.pinv(x.T @ x) * (r @ r) / df
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(names) for k in keys}, "regressor": names, "beta": b, "se": np.sqrt(np.maximum(np.diag(cov), 0)), "df": df, "ar_order": order})

    return samples.groupBy(*keys).applyInPandas(run, schema)


def with_p_values(results: DataFrame, tail: str = "two") -> DataFrame:
    """Adds p_val of t_stat and df."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([signal.t_p_value(a, b, tail) if pd.notna(a) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype=float)

    return results.withColumn("p_val", p(F.col("t_stat"), F.col("df").cast("double")))
