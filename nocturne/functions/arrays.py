"""Expressions on one epoch's sample array."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(signal: Column) -> Column:
    """Samples as doubles without null, NaN and infinities."""
    return F.filter(signal.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def cut_epoch(signal: Column, fs: Column, start_sec: Column, end_sec: Column, n: int) -> Column:
    """Samples [round(start fs), round(end fs)) made exactly ``n`` long: cut, or padded with the last value (zero if none)."""
    a = F.greatest(F.bround(start_sec.cast("double") * fs), F.lit(0)).cast("int")
    b = F.greatest(F.bround(end_sec.cast("double") * fs).cast("int"), a)
    part = F.slice(signal.cast("array<float>"), a + 1, F.least(b - a, F.lit(n)))
    pad = F.greatest(F.lit(n) - F.size(part), F.lit(0))
    last = F.coalesce(F.try_element_at(part, F.lit(-1)), F.lit(0.0).cast("float"))
    return F.concat(part, F.array_repeat(last, pad))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def mean(xs: Column) -> Column:
    return let(xs, lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(x), F.lit(0)))


def _moments(x: Column, mu: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    n = F.nullif(F.size(x), F.lit(0))

    def add(s, d):
        return F.struct((s["a"] + d * d).alias("a"), (s["b"] + d * d * d).alias("b"), (s["c"] + d * d * d * d).alias("c"))

    def finish(s):
        return F.struct(F.size(x).cast("double").alias("n"), mu.alias("mu"), (s["a"] / n).alias("m2"), (s["b"] / n).alias("m3"), (s["c"] / n).alias("m4"))

    return F.aggregate(F.transform(x, lambda v: v - mu), zero, add, finish)


def moments(xs: Column) -> Column:
    """Struct (n, mu, m2, m3, m4): size, mean and central moments, in two passes."""
    return let(xs, lambda x: let(mean(x), lambda mu: _moments(x, mu)))


def variance(xs: Column) -> Column:
    """Population variance."""
    return let(xs, lambda x: let(mean(x), lambda mu: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mu) * (v - mu)) / F.nullif(F.size(x), F.lit(0))))


def diff(xs: Column) -> Column:
    """First differences."""
    return let(xs, lambda x: let(F.greatest(F.size(x) - 1, F.lit(0)), lambda n: F.zip_with(F.slice(x, F.lit(2), n), F.slice(x, F.lit(1), n), lambda b, a: b - a)))


def normalize(xs: Column, floor: float = 1e-6) -> Column:
    """Centred samples, divided by the population deviation when it exceeds ``floor``."""

    def scaled(x):
        stats = F.struct(mean(x).alias("mu"), F.sqrt(variance(x)).alias("sd"))
        return let(stats, lambda s: let(F.when(s["sd"] > floor, s["sd"]).otherwise(1.0), lambda d: F.transform(x, lambda v: (v - s["mu"]) / d)))

    return let(xs, scaled)


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends only on its arguments."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def gaussian(*parts: Column) -> Column:
    u, v = uniform(F.lit(1), *parts), uniform(F.lit(2), *parts)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * np.pi * v)


def resample(signal: Column, orig_hz: float, target_hz: float, kind: str = "float") -> Column:
    """Fourier-domain resampling to round(n target/orig) samples; equal rates pass through."""
    if orig_hz <= 0 or target_hz <= 0:
        raise ValueError("sampling rates must be positive")
    if abs(orig_hz - target_hz) < 1e-6:
        return signal.cast(f"array<{kind}>")

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else _fourier_resample(np.asarray(x, dtype=float), orig_hz, target_hz))

    return run(signal).cast(f"array<{kind}>")


def _fourier_resample(x: np.ndarray, orig_hz: float, target_hz: float) -> np.ndarray:
    n, m = len(x), round(len(x) * target_hz / orig_hz)
    if m <= 0:
        raise ValueError("resampling would leave no samples")
    spec, low = np.fft.rfft(x), min(n, m)
    kept = np.zeros(m // 2 + 1, dtype=complex)
    kept[: low // 2 + 1] = spec[: low // 2 + 1]
    if low % 2 == 0 and m != n:  # the shared Nyquist bin stands for two mirrored bins
        kept[low // 2] *= 2.0 if m < n else 0.5
    return np.fft.irfft(kept, m) * (m / n)


def drop_band(signal: Column, key: Column, fraction: float, prob: float, seed: int) -> Column:
    """Zero a random frequency band of the given width with probability ``prob``."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series, hit: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series([
            None if x is None else (_zero_band(np.asarray(x, dtype=float), fraction, u) if h < prob else np.asarray(x, dtype=np.float32))
            for x, h, u in zip(batch, hit, place)
        ])

    return run(signal, uniform(F.lit(seed), F.lit("band"), key), uniform(F.lit(seed), F.lit("place"), key))


def _zero_band(x: np.ndarray, fraction: float, u: float) -> np.ndarray:
    spec = np.fft.rfft(x)
    width = max(1, round(len(spec) * fraction))
    at = int(u * (max(0, len(spec) - width) + 1))
    spec[at : at + width] = 0
    return np.fft.irfft(spec, len(x)).astype(np.float32)


def _zero_span(xs: Column, at: Column, width: Column) -> Column:
    return F.transform(xs, lambda x, i: F.when((i >= at) & (i < at + width), 0.0).otherwise(x))


def augment(signal: Column, key: Column, *, noise_std: float = 0.0, scale: tuple[float, float] = (1.0, 1.0), mask_fraction: float = 0.0, mask_count: int = 0, band_fraction: float = 0.0, band_prob: float = 0.0, seed: int = 42) -> Column:
    """Noise, amplitude scale, zeroed time spans and a zeroed band; draws depend only on key and seed."""
    out, s = signal.cast("array<double>"), F.lit(seed)
    if noise_std > 0:
        out = F.transform(out, lambda x, i: x + noise_std * gaussian(s, F.lit("noise"), key, i))
    lo, hi = scale
    if abs(lo - 1) > 1e-6 or abs(hi - 1) > 1e-6:
        out = F.transform(out, lambda x: x * (lo + (hi - lo) * uniform(s, F.lit("scale"), key)))
    if mask_fraction > 0:
        for j in range(mask_count):
            width = F.greatest(F.bround(F.size(signal) * mask_fraction), F.lit(1))
            at = F.floor(uniform(s, F.lit(f"mask{j}"), key) * (F.greatest(F.size(signal) - width, F.lit(0)) + 1))
            out = _zero_span(out, at, width)
    if band_fraction > 0 and band_prob > 0:
        return drop_band(out, key, band_fraction, band_prob, seed)
    return out.cast("array<float>")
