"""Gapless positions inside groups of any size, with built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one sort of the second level holds on average.
BUCKET_ROWS = 50_000
#: Copies of a row that one array numbers.
RUN = 1_000


def leading(draw: Column, bits: int) -> Column:
    """The ``bits`` leading bits of a 64-bit draw."""
    return F.shiftrightunsigned(draw, 64 - bits) if bits else F.lit(0).cast("long")


def bits_for(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    return max(0, math.ceil(math.log2(max(1, rows) / per_bucket)))


def gapless(df: DataFrame, group: str, draw: str, ties: list[str], out: str, rows: int) -> DataFrame:
    """Adds ``out``: 0, 1, 2 ... inside each group, in the order of the 64-bit ``draw``.

    A group is cut by the leading bits of its draws; the sizes of the cuts become offsets and
    only the rows of one cut are sorted together, so no task holds a group.  ``rows`` is
    the number of rows of ``df`` and sets the number of cuts.
    """
    cut = df.withColumn("_cut", leading(F.col(draw), bits_for(rows)))
    running = Window.partitionBy(group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(group, "_cut").agg(F.count("*").alias("_n"))
    offsets = sizes.select(group, "_cut", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_cut").orderBy(draw, *ties)
    ranked = cut.join(offsets, [group, "_cut"]).withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
    return ranked.drop("_cut", "_offset")


def copies(rows: DataFrame, key: list[str], out: str = "copy") -> DataFrame:
    """The columns ``key`` of every row with a number ``out`` that tells equal rows apart, from 0; equal rows are counted before the shuffle."""
    counted = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    runs = counted.withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    each = F.sequence(F.col("_first"), F.least(F.col("_first") + RUN, F.col("_n")) - 1)
    return runs.select(*key, F.explode(each).alias(out))
