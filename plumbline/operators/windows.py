"""Cutting recordings into fixed-length windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ranking import ranged_rank


def sequence_number(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str, piece_rows: int | None = None) -> DataFrame:
    """0-based position along ``order`` inside each group; no task sorts a whole recording."""
    ranked = ranged_rank(df, list(groups), list(order), "_place", piece_rows)
    return ranked.withColumn(out, F.col("_place") - 1).drop("_place")


def window_starts(position: Column, size: int, overlap: int = 0) -> Column:
    """Numbers of the windows a sample belongs to (several if windows overlap)."""
    step = size - overlap
    last = F.floor(position / step)
    first = F.greatest(F.lit(0).cast("long"), F.floor((position - size) / step) + 1)
    return F.sequence(first, last)


def cut_windows(
    samples: DataFrame,
    recording: str,
    position: str,
    value: str,
    size: int,
    overlap: int = 0,
) -> DataFrame:
    """``recording, window, samples``: full windows of ``size`` samples, ``size - overlap`` apart.

    Samples are grouped by (recording, window), so a group never holds more than ``size``
    values, however long a recording is.  The incomplete last window is dropped.
    """
    spread = samples.select(
        recording, position, value, F.explode(window_starts(F.col(position), size, overlap)).alias("window")
    )
    grouped = spread.groupBy(recording, "window").agg(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("i"), F.col(value).alias("v")))).alias("_s")
    )
    return grouped.where(F.size("_s") == size).select(
        recording, "window", F.transform("_s", lambda s: s["v"]).alias("samples")
    )
