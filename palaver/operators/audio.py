"""Signal statistics over arrays of samples, and frame operators (numpy, one row at a time in Arrow batches)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _mean(c: Column, f) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x.cast("double"))) / F.size(c)


def rms(c: Column) -> Column:
    return F.sqrt(_mean(c, lambda x: x * x))


def peak(c: Column) -> Column:
    return F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))


def clipping_ratio(c: Column, level: float = 0.98) -> Column:
    return _mean(c, lambda x: F.when(F.abs(x) > level, 1.0).otherwise(0.0))


def silence_ratio(c: Column, level: float = 0.005) -> Column:
    return _mean(c, lambda x: F.when(F.abs(x) < level, 1.0).otherwise(0.0))


def snr_db(c: Column) -> Column:
    """20 * log10 of the 95th over the 20th position of the sorted magnitudes (floor(n * q), zeros as 1e-6)."""
    s = F.array_sort(F.transform(c, lambda x: F.abs(x.cast("double"))))
    at = lambda q: F.greatest(F.element_at(s, F.least(F.size(s), F.floor(F.size(s) * q).cast("int") + 1)), F.lit(1e-6))
    return 20 * F.log10(at(0.95) / at(0.2))


def quality_class(clip: Column, silence: Column, snr: Column, seconds: Column, peak_: Column) -> Column:
    """poor with three faults or more, or if mostly silent or too quiet; fair with two, or if noisy; else good. Faults: clipped, mostly silent, noisy, short, quiet; a null is no fault."""
    clipped, silent, noisy, short, quiet = (F.coalesce(c, F.lit(False)) for c in (clip > 0.001, silence > 0.8, snr < 10, seconds < 5, peak_ < 0.05))
    faults = sum((c.cast("int") for c in (clipped, silent, noisy, short, quiet)), F.lit(0))
    return F.when((faults >= 3) | silent | quiet, "poor").when((faults >= 2) | noisy, "fair").otherwise("good")


def mono(channels: Column) -> Column:
    """The mean of the channels, sample by sample."""
    n = F.size(channels)
    return F.aggregate(F.filter(channels, lambda _, i: i > 0), F.element_at(channels, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y), lambda s: F.transform(s, lambda x: x / n))


def gained(c: Column, target: float = 0.1, most: float = 8.0) -> Column:
    """Amplified to a target RMS, at most ``most`` times, clamped to [-1, 1]."""
    g = F.least(F.lit(most), F.lit(target) / F.greatest(rms(c), F.lit(1e-9)))
    return F.transform(c, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * g)))


def resample(x: np.ndarray, src: int, dst: int) -> np.ndarray:
    """Linear interpolation to another rate."""
    n = max(1, int(len(x) * dst / src))
    return np.interp(np.arange(n) * src / dst, np.arange(len(x)), x) if len(x) else x


def voiced(x: np.ndarray, frame: int, level: float, pad: int, longest_gap: int) -> np.ndarray:
    """x without frames that are quiet, but for ``pad`` frames around loud ones and up to ``longest_gap`` frames of each silence."""
    n = -(-len(x) // frame)
    loud = np.array([np.sqrt(np.mean(x[i * frame : (i + 1) * frame] ** 2)) >= level for i in range(n)], bool)
    near = np.convolve(loud, np.ones(2 * pad + 1), "same")[:n] > 0 if n else loud
    run, keep = 0, []
    for i in range(n):
        run = 0 if near[i] else run + 1
        if run <= longest_gap:
            keep.append(x[i * frame : (i + 1) * frame])
    return np.concatenate(keep) if keep else x[:0]


def high_pass(x: np.ndarray, alpha: float) -> np.ndarray:
    """One-pole high pass: y[i] = alpha * (y[i-1] + x[i] - x[i-1])."""
    y = np.zeros(len(x))
    for i in range(1, len(x)):
        y[i] = alpha * (y[i - 1] + x[i] - x[i - 1])
    return y


def denoised(x: np.ndarray, frame: int = 512, noise_frames: int = 10, strength: float = 1.0) -> np.ndarray:
    """Spectral subtraction: half-overlapping Hann frames, minus the mean magnitude of the first frames, overlap-added."""
    hop, win = frame // 2, np.hanning(frame + 1)[:frame]
    padded = np.concatenate([x, np.zeros(frame)])
    starts = range(0, max(1, len(x)), hop)
    spec = np.array([np.fft.rfft(padded[s : s + frame] * win) if len(padded[s : s + frame]) == frame else np.zeros(hop + 1, complex) for s in starts])
    noise = np.abs(spec[:noise_frames]).mean(0)
    mag = np.maximum(np.abs(spec) - strength * noise, 0.05 * np.abs(spec))
    out = np.zeros(len(padded) + frame)
    for s, m, p in zip(starts, mag, np.angle(spec), strict=True):
        out[s : s + frame] += np.fft.irfft(m * np.exp(1j * p), frame)
    return out[: len(x)]


def array_udf(f, **options):
    """A pandas UDF over arrays of samples from a numpy function."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda v: None if v is None else f(np.asarray(v, float), **options).tolist())

    return run
