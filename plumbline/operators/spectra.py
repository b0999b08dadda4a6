"""Band power of signal windows (Welch's method) and the feature sets made from it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.signals import _by_shape, _stack

# Band edges in Hz, both ends inclusive (a shared edge bin counts twice).
BANDS = {
    "delta": (1.0, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 13.0),
    "beta": (13.0, 30.0),
    "gamma": (30.0, 45.0),
}
SAMPLING_HZ = {"deap": 128.0, "dreamer": 128.0, "seed_iv": 200.0}


def segment_length(n_samples: int, sfreq: float) -> int:
    """Two seconds, or the whole window if it is shorter."""
    return min(n_samples, int(sfreq * 2))


def band_bins(n_samples: int, sfreq: float, bands: dict[str, tuple[float, float]]) -> dict[str, np.ndarray]:
    freqs = np.fft.rfftfreq(segment_length(n_samples, sfreq), 1.0 / sfreq)
    bins = {name: (freqs >= low) & (freqs <= high) for name, (low, high) in bands.items()}
    empty = [name for name, mask in bins.items() if not mask.any()]
    if empty:
        raise ValueError(f"bands {empty} hold no frequency bin at {sfreq} Hz with {n_samples} samples")
    return bins


def welch(x: np.ndarray, sfreq: float) -> np.ndarray:
    """One-sided power density over the last axis: Hann segments, half overlap, mean removed."""
    size = segment_length(x.shape[-1], sfreq)
    step = size - size // 2
    segments = np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::step, :]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = np.abs(np.fft.rfft((segments - segments.mean(-1, keepdims=True)) * taper, axis=-1)) ** 2
    power /= sfreq * (taper**2).sum()
    power[..., 1 : (-1 if size % 2 == 0 else None)] *= 2
    return power.mean(axis=-2)


def band_power(signal: Column | str, sfreq: float, bands: dict[str, tuple[float, float]] = BANDS) -> Column:
    """Mean density per band and channel, band-major; one transform per Arrow batch."""

    @F.pandas_udf("array<double>")
    def power(windows: pd.Series) -> pd.Series:
        parts = []
        for positions in _by_shape(windows):
            x = _stack(windows.loc[positions])
            density = welch(x, sfreq)
            masks = band_bins(x.shape[-1], sfreq, bands).values()
            means = np.concatenate([density[..., m].mean(axis=-1) for m in masks], axis=-1)
            parts.append(pd.Series(means.tolist(), index=positions))
        return pd.concat(parts).loc[windows.index] if parts else pd.Series([], dtype=object)

    return power(F.col(signal) if isinstance(signal, str) else signal)


def log_features(power: Column | str) -> Column:
    """``log(1 + max(x, 0))`` as floats."""
    p = F.col(power) if isinstance(power, str) else power
    return F.transform(p, lambda v: F.log1p(F.greatest(v, F.lit(0.0))).cast("float"))


def feature_names(bands: dict[str, tuple[float, float]], n_channels: int) -> list[str]:
    return [f"{band}_ch{c:03d}" for band in bands for c in range(n_channels)]


def extract_features(
    windows: DataFrame,
    signal: str,
    sfreq: float,
    n_channels: int,
    bands: dict[str, tuple[float, float]] = BANDS,
    alpha: str = "alpha",
) -> DataFrame:
    """Both feature sets from one pass: ``spectral`` (all bands) and ``alpha`` (one of them)."""
    start = list(bands).index(alpha) * n_channels
    out = windows.withColumn("spectral", log_features(band_power(signal, sfreq, bands))).drop(signal)
    return out.withColumn("alpha", F.slice("spectral", start + 1, n_channels))
