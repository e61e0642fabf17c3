"""The 24 features of one epoch of samples.

Moments, crossings, activity and ordinal patterns are array expressions.  Two
things need Python: the segment-averaged spectrum (an FFT) and the pairwise
distances of the sample entropy; both are Arrow batches of small NumPy calls.
Everything derived from the spectrum is again an expression.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nocturne.functions.arrays import diff, let, variance

# Frequency bands in Hz.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "beta": (12.0, 30.0)}
TOTAL_BAND = (0.5, 30.0)
# Point caps of the two entropies, tolerance ratio and orders.
SAMPLE_ENTROPY_POINTS, SAMPLE_ENTROPY_M, SAMPLE_ENTROPY_R = 120, 2, 0.2
PERMUTATION_POINTS, PERMUTATION_ORDER = 300, 3

EPOCHS_PER_FFT = 256


def crossings(xs: Column) -> Column:
    """Share of neighbouring samples with different signs, zero counting as positive."""

    def rate(x, n):
        flips = F.zip_with(F.slice(x, F.lit(2), n), F.slice(x, F.lit(1), n), lambda b, a: F.when((a < 0) != (b < 0), 1).otherwise(0))
        return F.when(n > 0, F.aggregate(flips, F.lit(0), lambda s, v: s + v) / n).otherwise(0.0)

    return let(xs, lambda x: let(F.greatest(F.size(x) - 1, F.lit(0)), lambda n: rate(x, n)))


def segment_length(fs: float, n: int) -> int:
    return min(int(max(8, round(fs * 4.0))), n)


def _spectra(x: np.ndarray, fs: float) -> np.ndarray:
    """Averaged one-sided power density: half-overlapping Hann segments, mean removed from each.

    ``x`` holds epochs of one length as rows, so one FFT call serves the batch.
    """
    k = segment_length(fs, x.shape[1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(k) / k) if k > 1 else np.ones(1)
    pieces = np.lib.stride_tricks.sliding_window_view(x, k, axis=1)[:, :: max(k - k // 2, 1)]
    pieces = (pieces - pieces.mean(axis=2, keepdims=True)) * window
    power = np.abs(np.fft.rfft(pieces, axis=2)) ** 2 / (fs * (window**2).sum())
    power[:, :, 1 : None if k % 2 else -1] *= 2
    return power.mean(axis=1)


def psd(signal: Column, fs: float) -> Column:
    """Power density per frequency bin of an array of finite doubles; null for an empty array."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        sizes = batch.map(lambda x: 0 if x is None else len(x))
        for _, same in batch[sizes > 0].groupby(sizes[sizes > 0]):
            for at in range(0, len(same), EPOCHS_PER_FFT):
                rows = same.iloc[at : at + EPOCHS_PER_FFT]
                out[rows.index] = list(_spectra(np.stack(rows.to_numpy()).astype(float), fs))
        return out

    return run(signal)


def bin_width(n: Column, fs: float) -> Column:
    """Distance of two frequency bins for an epoch of ``n`` samples."""
    return F.lit(fs) / F.nullif(F.least(F.lit(int(max(8, round(fs * 4.0)))), n), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)


def band_power(power: Column, step: Column, lo: float, hi: float) -> Column:
    """Trapezoid over the bins with lo <= f < hi; no bin or one bin gives 0."""

    def area(p):
        ends = (p[0] + F.element_at(p, -1)) / 2
        return F.when(F.size(p) > 1, (_total(p) - ends) * step).otherwise(0.0)

    return let(F.filter(power, lambda p, i: (i * step >= lo) & (i * step < hi)), area)


def spectral_entropy(power: Column) -> Column:
    def bits(share):
        total = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))
        return F.when(F.size(share) > 1, total / F.log2(F.size(share).cast("double"))).otherwise(0.0)

    return let(F.nullif(_total(power), F.lit(0.0)), lambda t: let(F.filter(F.transform(power, lambda p: p / t), lambda p: p > 0), bits))


def spectral_edge(power: Column, step: Column, quantile: float) -> Column:
    """First frequency at which the cumulative power share reaches the quantile."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"))

    def walk(goal):
        return F.aggregate(
            power,
            start,
            lambda s, p: F.when(s["sum"] >= goal, s).otherwise(F.struct((s["sum"] + p).alias("sum"), (s["i"] + 1).alias("i"))),
            lambda s: F.greatest(s["i"] - 1, F.lit(0)) * step,
        )

    return let(_total(power), lambda t: F.when(t > 0, let(t * quantile, walk)).otherwise(0.0))


def _sample_entropy(x: np.ndarray) -> float:
    x = x[:: -(-len(x) // SAMPLE_ENTROPY_POINTS)] if len(x) > SAMPLE_ENTROPY_POINTS else x
    m, spread = SAMPLE_ENTROPY_M, x.std()
    if len(x) <= m + 1 or spread <= 0:
        return 0.0
    near = np.abs(x[:, None] - x[None, :]) <= SAMPLE_ENTROPY_R * spread
    pair = near[:-1, :-1] & near[1:, 1:]
    triple = pair[:-1, :-1] & near[2:, 2:]
    b, a = (pair.sum() - len(pair)) / 2, (triple.sum() - len(triple)) / 2
    return float(-np.log(a / b)) if a > 0 and b > 0 else 0.0


def sample_entropy(signal: Column) -> Column:
    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None or len(x) == 0 else _sample_entropy(np.asarray(x, dtype=float)))

    return run(signal)


def _thinned(xs: Column, points: int) -> Column:
    """Every n-th sample so that at most ``points`` remain."""

    def picked(x):
        step = F.ceil(F.size(x) / points).cast("int")
        return F.transform(F.sequence(F.lit(0), F.size(x) - 1, step), lambda i: x[i])

    return let(xs, lambda x: F.when(F.size(x) > points, picked(x)).otherwise(x))


def permutation_entropy(xs: Column) -> Column:
    """Normalised entropy of the order patterns of three neighbouring samples, ties in time order."""

    def codes(x, k):
        # Three comparisons identify the stable sort pattern of a triple.
        part = [F.slice(x, F.lit(i + 1), k) for i in range(3)]
        ab = F.zip_with(part[0], part[1], lambda a, b: F.when(a <= b, 1).otherwise(0))
        bc = F.zip_with(part[1], part[2], lambda b, c: F.when(b <= c, 2).otherwise(0))
        ac = F.zip_with(part[0], part[2], lambda a, c: F.when(a <= c, 4).otherwise(0))
        return F.zip_with(F.zip_with(ab, bc, lambda a, b: a + b), ac, lambda a, b: a + b)

    def bits(code, k):
        # a <= b <= c fixes a <= c, and likewise downwards, so codes 3 and 4 cannot occur.
        share = F.transform(F.array(*[F.lit(c) for c in (0, 1, 2, 5, 6, 7)]), lambda c: F.size(F.filter(code, lambda v: v == c)) / k)
        total = F.aggregate(share, F.lit(0.0), lambda s, p: s + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
        return total / math.log2(math.factorial(PERMUTATION_ORDER))

    def entropy(x):
        triples = F.greatest(F.size(x) - (PERMUTATION_ORDER - 1), F.lit(0))
        return let(triples, lambda k: F.when(k > 1, let(codes(x, k), lambda code: bits(code, k))).otherwise(0.0))

    return let(_thinned(xs, PERMUTATION_POINTS), entropy)


def hjorth(xs: Column) -> Column:
    """Struct (activity, mobility, complexity); degenerate cases give 0."""

    def build(s):
        mobility = F.when((s["a"] > 0) & (s["b"] > 0), F.sqrt(s["b"] / F.nullif(s["a"], F.lit(0.0)))).otherwise(0.0)
        ratio = F.sqrt(s["c"] / F.nullif(s["b"], F.lit(0.0))) / F.nullif(mobility, F.lit(0.0))
        return F.struct(s["a"].alias("activity"), mobility.alias("mobility"), F.coalesce(F.when(s["c"] > 0, ratio), F.lit(0.0)).alias("complexity"))

    def spread(x, d):
        zero = lambda v: F.coalesce(v, F.lit(0.0))
        return F.struct(variance(x).alias("a"), zero(variance(d)).alias("b"), zero(variance(diff(d))).alias("c"))

    return let(xs, lambda x: let(diff(x), lambda d: let(spread(x, d), build)))


def shape(m: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis from a moments struct; undefined gives 0."""
    flat = m["m2"] <= F.pow(F.lit(2.0**-52) * m["mu"], 2)
    n, m2 = m["n"], F.when(~flat, m["m2"])
    skew = m["m3"] / F.pow(m2, 1.5) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    excess = m["m4"] / (m2 * m2) - 3
    kurt = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * excess + 6)
    return F.coalesce(F.when(n > 2, skew), F.lit(0.0)), F.coalesce(F.when(n > 3, kurt).otherwise(excess), F.lit(0.0))


NUMBERS = "psd array<double>, n int, mu double, m2 double, m3 double, m4 double, flips double, d1 double, d2 double, samp double, perm double"


def _numbers(x: np.ndarray, fs: float) -> pd.DataFrame:
    """The sums behind the features, for epochs of one length as rows."""
    n = x.shape[1]
    mu = x.mean(axis=1)
    d = x - mu[:, None]
    square = d * d
    dx = np.diff(x, axis=1)
    thin = x[:, :: -(-n // PERMUTATION_POINTS)]
    a, b, c = (thin[:, i : max(thin.shape[1] - 2 + i, 0)] for i in range(3))
    code = (a <= b) + 2 * (b <= c) + 4 * (a <= c)
    share = np.stack([(code == v).mean(axis=1) for v in range(8)], axis=1) if code.shape[1] > 1 else np.ones((len(x), 1))
    return pd.DataFrame({
        "psd": list(_spectra(x, fs)), "n": n, "mu": mu, "m2": square.mean(axis=1), "m3": (square * d).mean(axis=1), "m4": (square * square).mean(axis=1),
        "flips": ((x[:, 1:] < 0) != (x[:, :-1] < 0)).mean(axis=1) if n > 1 else 0.0, "d1": dx.var(axis=1) if n > 1 else 0.0,
        "d2": np.diff(dx, axis=1).var(axis=1) if n > 2 else 0.0, "samp": [_sample_entropy(row) for row in x],
        "perm": -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1) / math.log2(math.factorial(PERMUTATION_ORDER)),
    })


def epoch_numbers(signal: Column, fs: float, normalize: bool) -> Column:
    """Struct of sums per epoch; n = 0 for an epoch without finite samples.

    Measured on 3000-sample epochs this Arrow pass is several times faster than the
    array expressions above, which serve when only some features are wanted.
    """

    @F.pandas_udf(NUMBERS)
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = [np.zeros(0) if x is None else np.asarray(x, dtype=float) for x in batch]
        rows = [x[np.isfinite(x)] for x in rows]
        if normalize:
            rows = [x if not len(x) else (x - x.mean()) / (x.std() if x.std() > 0 else 1.0) for x in rows]
        sizes = pd.Series([len(x) for x in rows])
        out = [pd.DataFrame({"n": 0, "psd": None}, index=sizes.index[sizes == 0])]
        for _, same in sizes[sizes > 0].groupby(sizes[sizes > 0]):
            for at in range(0, len(same), EPOCHS_PER_FFT):
                where = same.index[at : at + EPOCHS_PER_FFT]
                out.append(_numbers(np.stack([rows[i] for i in where]), fs).set_index(where))
        names = [part.split()[0] for part in NUMBERS.split(", ")]
        table = pd.concat(out).sort_index().reindex(columns=names)
        table["psd"] = [p if isinstance(p, np.ndarray) else None for p in table["psd"]]
        return table

    return run(signal)


def export_features(df: DataFrame, signal: str, fs: float, *, prefix: str = "eeg", normalize: bool = False) -> DataFrame:
    """All columns of ``df`` plus the 24 features; epochs without finite samples get nulls."""
    work = df.withColumn("_s", epoch_numbers(F.col(signal), fs, normalize))
    s = lambda c: F.col(f"_s.{c}")
    work = work.withColumn("_step", bin_width(s("n"), fs))
    work = work.withColumns({f"_p_{b}": band_power(s("psd"), F.col("_step"), lo, hi) for b, (lo, hi) in {**BANDS, "total": TOTAL_BAND}.items()})
    m = F.struct(s("n").cast("double").alias("n"), s("mu").alias("mu"), s("m2").alias("m2"), s("m3").alias("m3"), s("m4").alias("m4"))
    skew, kurt = shape(m)
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    mobility = F.sqrt(ratio(s("d1"), s("m2")))
    out = {"mean": s("mu"), "std": F.sqrt(s("m2")), "var": s("m2"), "rms": F.sqrt(s("m2") + s("mu") * s("mu")), "zero_crossing_rate": s("flips")}
    for b in BANDS:
        out[f"bandpower_{b}"] = F.col(f"_p_{b}")
        out[f"rel_power_{b}"] = ratio(F.col(f"_p_{b}"), F.col("_p_total"))
    out["theta_alpha_ratio"] = ratio(F.col("_p_theta"), F.col("_p_alpha"))
    out.update({
        "spectral_entropy": spectral_entropy(s("psd")), "sef50": spectral_edge(s("psd"), F.col("_step"), 0.50), "sef95": spectral_edge(s("psd"), F.col("_step"), 0.95),
        "hjorth_activity": s("m2"), "hjorth_mobility": mobility, "hjorth_complexity": ratio(F.sqrt(ratio(s("d2"), s("d1"))), mobility),
        "sample_entropy": s("samp"), "permutation_entropy": s("perm"), "skewness": skew, "kurtosis": kurt,
    })
    return work.select(*df.columns, *[F.when(s("n") > 0, c).alias(f"{prefix}_{n}") for n, c in out.items()])
