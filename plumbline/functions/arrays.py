"""Array-column maths.

A value that a lambda needs for every element (a mean, a spread) is computed once per
array by carrying it in a struct: lambda bodies are evaluated per element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def with_moments(x: Column) -> Column:
    """Struct ``x, mean, sd`` (population) of one array, wrapped in a one-element array."""
    one = F.transform(F.array(x), lambda c: F.struct(c.alias("x"), mean(c).alias("mean")))
    return F.transform(
        one,
        lambda s: F.struct(
            s["x"].alias("x"),
            s["mean"].alias("mean"),
            F.sqrt(
                F.aggregate(s["x"], F.lit(0.0), lambda acc, v: acc + (v - s["mean"]) * (v - s["mean"])) / F.size(s["x"])
            ).alias("sd"),
        ),
    )


def as_channels(flat: Column | str, channels: int, samples: int) -> Column:
    """A flat array as ``channels`` arrays of ``samples`` doubles."""
    doubles = (F.col(flat) if isinstance(flat, str) else flat).cast("array<double>")
    return F.array(*[F.slice(doubles, c * samples + 1, samples) for c in range(channels)])


def standardize(x: Column, mean_: Column, scale: Column) -> Column:
    """Element-wise ``(x - mean) / scale`` of three arrays."""
    centred = F.zip_with(x, mean_, lambda a, m: a - m)
    return F.zip_with(centred, scale, lambda a, s: a / s)


def pick(x: Column, positions: list[int]) -> Column:
    """Elements of ``x`` at 0-based ``positions``, in that order."""
    return F.transform(F.array(*[F.lit(p + 1) for p in positions]), lambda j: F.element_at(x, j))
