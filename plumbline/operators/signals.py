"""Transforms of signal windows (``array<array<double>>``: channels of samples).

All are fixed per row, so training and testing see the same transformed window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.arrays import with_moments
from plumbline.functions.hashing import seeded_md5

# Guard added to a window's spread, and the frequency of the injected control.
ZSCORE_EPS, INJECTED_HZ = 1e-6, 10.0

MODES = ("none", "time_reverse", "time_shuffle", "phase_random")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_reverse(signal: Column | str) -> Column:
    return F.transform(_column(signal), lambda channel: F.reverse(channel))


def time_shuffle(signal: Column | str, seed: int, key: Column | str = "row_index") -> Column:
    """One seeded order of the samples per row, the same for all channels."""
    sig = _column(signal)
    first = F.element_at(sig, 1)
    row_seed = F.lit(seed) + _column(key)
    order = F.array_sort(
        F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.struct(seeded_md5(row_seed, i).alias("h"), i.alias("i")))
    )
    # The order is carried along with the channels, so it is made once per row.
    carried = F.transform(F.array(order), lambda o: F.struct(o.alias("o"), sig.alias("s")))
    return F.element_at(
        F.transform(
            carried,
            lambda c: F.transform(c["s"], lambda channel: F.transform(c["o"], lambda p: F.element_at(channel, p["i"] + 1))),
        ),
        1,
    )


def _stack(batch: pd.Series) -> np.ndarray:
    """A batch of equally shaped windows as (rows, channels, samples)."""
    return np.stack([np.stack(w) for w in batch]).astype(float)


def _by_shape(batch: pd.Series):
    """Positions of the windows of each shape in a batch."""
    shapes = batch.map(lambda w: (len(w), len(w[0])))
    for _, positions in shapes.groupby(shapes).groups.items():
        yield positions


def counter_uniform(seed: int, keys: np.ndarray, width: int) -> np.ndarray:
    """Numbers in [0, 1) per key and counter 0 .. width - 1: a bit mixer over (seed, key, counter), no generator state.

    Every number depends on these three alone, so a row has the same ones in any batch.
    """
    counter = np.arange(width, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = _mixed(np.uint64(seed % 2**64) + keys.astype(np.int64).astype(np.uint64))[:, None] + counter
    return (_mixed(x) >> np.uint64(11)) * 2.0**-53


def _mixed(x: np.ndarray) -> np.ndarray:
    # Shifts and factors of the published 64-bit finaliser of split-mix generators.
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def phase_random(signal: Column | str, seed: int, key: Column | str = "row_index") -> Column:
    """Fourier surrogate with one random phase per frequency shared by all channels.

    Magnitudes and cross-spectra are kept; the mean and, for an even length, the highest
    bin keep their phase.  The phases of a batch are one call of :func:`counter_uniform`.
    """

    @F.pandas_udf("array<array<double>>")
    def surrogate(windows: pd.Series, keys: pd.Series) -> pd.Series:
        parts = []
        for positions in _by_shape(windows):
            x = _stack(windows.loc[positions])
            spectrum = np.fft.rfft(x, axis=-1)
            phases = 2 * np.pi * counter_uniform(seed, keys.loc[positions].to_numpy(), spectrum.shape[-1])
            phases[:, 0] = 0.0
            if x.shape[-1] % 2 == 0:
                phases[:, -1] = 0.0
            turned = np.fft.irfft(spectrum * np.exp(1j * phases)[:, None, :], n=x.shape[-1], axis=-1)
            parts.append(pd.Series(turned.tolist(), index=positions))
        return pd.concat(parts).loc[windows.index] if parts else pd.Series([], dtype=object)

    return surrogate(_column(signal), _column(key))


def apply_mode(signal: Column | str, mode: str, seed: int, key: Column | str = "row_index") -> Column:
    """The transform named ``mode``."""
    if mode == "none":
        return _column(signal)
    if mode == "time_reverse":
        return time_reverse(signal)
    if mode == "time_shuffle":
        return time_shuffle(signal, seed, key)
    if mode == "phase_random":
        return phase_random(signal, seed, key)
    raise ValueError(f"unknown transform {mode!r}")


def inject_signal(signal: Column | str, class_id: Column | str, snr: float, sfreq: float, hz: float = INJECTED_HZ) -> Column:
    """Positive control: windows of class 0 get a sine of ``snr`` times each channel's spread."""
    sig = _column(signal)

    def with_wave(channel: Column) -> Column:
        added = F.transform(
            with_moments(channel),
            lambda m: F.transform(
                m["x"], lambda v, i: v + F.lit(snr) * m["sd"] * F.sin(F.lit(2 * np.pi * hz) * i / F.lit(sfreq))
            ),
        )
        return F.element_at(added, 1)

    return F.when(_column(class_id) == 0, F.transform(sig, with_wave)).otherwise(sig)


def zscore(signal: Column | str) -> Column:
    """Per window and channel: ``(x - mean) / (sd + 1e-6)`` with the population sd."""

    def scaled(channel: Column) -> Column:
        out = F.transform(
            with_moments(channel), lambda m: F.transform(m["x"], lambda v: (v - m["mean"]) / (m["sd"] + F.lit(ZSCORE_EPS)))
        )
        return F.element_at(out, 1)

    return F.transform(_column(signal), scaled)
