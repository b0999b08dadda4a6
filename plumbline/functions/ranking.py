"""Exact ranks, quotas and running totals that never sort a whole group in one task.

A plain ``row_number() over (partition by label order by h)`` sends each label to one
task, which fails when one label holds a third of all rows.  Groups of at most
``PIECE_ROWS`` rows are ranked in exactly that way; only rows of larger groups are cut:

* along a hash (:func:`bucketed_rank`) by arithmetic on the hash: a group gets as many pieces
  as its counted size asks for, piece sizes become offsets, and only rows of one
  piece are sorted together;
* along any other order (:func:`ranged_rank`, :func:`sorted_rank`) by Spark's range partitioning: rows
  are laid out in ranges once, their number inside the range is written with them, and
  the counts of the ranges, one row each, are added in front.  No row is compared with a list of cuts.

The table of large groups has at most one row per ``PIECE_ROWS`` rows and is settled, so
joins see its real size; where it is empty, nothing is planned for large groups.

Rows whose group columns are null form a group like any other.

A ``Bucket`` says how an order is cut: given the number of pieces of the group it returns a
piece number that does not decrease along the order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import unit_interval
from plumbline.functions.settle import settle

#: Rows that one sort holds on average (some tens of megabytes).
PIECE_ROWS = 200_000

#: Bits of ``monotonically_increasing_id`` below the partition number (Spark's documented layout).
ROW_BITS = 33

Bucket = Callable[[Column], Column]


def hash_bucket(md5_hex: Column | str) -> Bucket:
    """Pieces of equal width along a hex digest."""
    return linear_bucket(unit_interval(F.col(md5_hex) if isinstance(md5_hex, str) else md5_hex), 1)


def linear_bucket(x: Column, width: Column | float) -> Bucket:
    """Pieces of equal width along a number in [0, width)."""
    return lambda pieces: F.floor(x / width * pieces)


def magnitude_bucket(x: Column, per_octave: int = 64) -> Bucket:
    """Pieces along the logarithm of a positive number; tied numbers share one."""
    return lambda pieces: F.floor(F.log2(x) * F.lit(per_octave))


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the key columns come from ``left``."""
    renamed = right.select(*(F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns))
    condition = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"_right_{k}" for k in keys))


def large_groups(df: DataFrame, groups: Sequence[str], piece_rows: int | None) -> DataFrame | None:
    """(groups, _pieces) of the groups above ``piece_rows`` rows; None where there is none."""
    piece_rows = piece_rows or PIECE_ROWS
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"))
    pieces = F.ceil(F.col("_rows") / piece_rows).alias("_pieces")
    large = settle(sizes.where(F.col("_rows") > piece_rows).select(*groups, pieces))
    return None if large.isEmpty() else large


def cut(df: DataFrame, groups: Sequence[str], bucket: Bucket, large: DataFrame) -> DataFrame:
    """``df`` with ``_bucket``: the piece of each row, 0 in groups that are not large."""
    sized = match(df, large, groups, "left")
    piece = F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(bucket(F.col("_pieces")))
    return sized.withColumn("_bucket", piece.cast("long"))


def _offsets(counts: DataFrame, groups: Sequence[str], n: str) -> DataFrame:
    """Per piece, how much of the group lies in earlier pieces."""
    earlier = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum(n).over(earlier), F.lit(0)))


def _grouped(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(groups)) if groups else (df.withColumn("_whole", F.lit(1)), ["_whole"])


def _along_pieces(
    df: DataFrame, groups: Sequence[str], bucket: Bucket, total: Column, inside: Callable, out: str, piece_rows: int | None, most: int | None = None
) -> DataFrame:
    """A window value inside each piece plus the ``total`` of the earlier pieces of the group.

    ``most``: rows of the largest group, where the caller knows a bound; groups need not be counted then.
    """
    df, groups = _grouped(df, groups)
    small = most is not None and most <= (piece_rows or PIECE_ROWS)
    large = None if small else large_groups(df, groups, piece_rows)
    if large is None:
        return df.withColumn(out, inside(W.partitionBy(*groups))).drop("_whole")
    tagged = cut(df, groups, bucket, large)
    keys = [*groups, "_bucket"]
    sums = tagged.where(F.col("_pieces").isNotNull()).groupBy(*keys).agg(total.alias("_sum"))
    offsets = settle(_offsets(sums, groups, "_sum").drop("_sum"))
    placed = tagged.withColumn("_inside", inside(W.partitionBy(*keys)))
    value = F.coalesce("_before", F.lit(0)) + F.col("_inside")
    return match(placed, offsets, keys, "left").withColumn(out, value).drop("_bucket", "_pieces", "_before", "_inside", "_whole")


def _row_number(order: Sequence[Column | str]) -> Callable:
    return lambda window: F.row_number().over(window.orderBy(*order)).cast("long")


def bucketed_rank(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], bucket: Bucket, out: str = "rank", piece_rows: int | None = None, most: int | None = None
) -> DataFrame:
    """``row_number() over (partition by groups order by order)`` as a column ``out``."""
    return _along_pieces(df, groups, bucket, F.count(F.lit(1)), _row_number(order), out, piece_rows, most)


def bucketed_running_sum(
    df: DataFrame, groups: Sequence[str], order: str, bucket: Bucket, value: str, out: str, piece_rows: int | None = None, most: int | None = None
) -> DataFrame:
    """Inclusive running total of ``value`` along ``order`` (unique inside a group)."""
    upto = lambda window: F.sum(value).over(window.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return _along_pieces(df, groups, bucket, F.sum(value), upto, out, piece_rows, most)


def sorted_rank(df: DataFrame, order: Sequence[str], out: str = "rank", most: int | None = None) -> DataFrame:
    """Global 1-based rank along ``order`` (unique tuples; nulls first), in two passes.

    Rows go to ranges of the order and are sorted inside them; each is written with its
    range and its number there.  The sizes of the ranges, of which there are as many as
    shuffle partitions, are added up and broadcast.  A table known to have at most
    ``PIECE_ROWS`` rows (``most``) is one sort.
    """
    if most is not None and most <= PIECE_ROWS:
        return df.withColumn(out, _row_number(order)(W.partitionBy(F.lit(0))))
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = settle(numbered).withColumn("_range", F.shiftright("_at", ROW_BITS)).withColumn("_inside", F.col("_at").bitwiseAND(2**ROW_BITS - 1))
    sizes = laid.groupBy("_range").agg((F.max("_inside") + 1).alias("_n"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_inside") + 1).alias(out)
    return laid.join(F.broadcast(offsets), "_range").select(*df.columns, place)


def ranged_rank(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str = "rank", piece_rows: int | None = None) -> DataFrame:
    """``row_number() over (partition by groups order by order)`` along any order (unique inside a group; nulls first).

    Rows of large groups are ranked over all of them (:func:`sorted_rank` by group, then
    order) and counted from the first rank of their group.
    """
    if not groups:
        return sorted_rank(df, order, out)
    number = _row_number(order)(W.partitionBy(*groups))
    large = large_groups(df, groups, piece_rows)
    if large is None:
        return df.withColumn(out, number)
    small = match(df, large, groups, "left_anti").withColumn(out, number)
    ranked = sorted_rank(match(df, large, groups, "left_semi"), [*groups, *order], "_place")
    first = settle(ranked.groupBy(*groups).agg(F.min("_place").alias("_first")))
    rank = (F.col("_place") - F.col("_first") + 1).alias(out)
    return small.unionByName(match(ranked, first, groups).select(*df.columns, rank))


def mark_first(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    quota: Column,
    bucket: Bucket,
    out: str = "taken",
    quotas: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    piece_rows: int | None = None,
) -> DataFrame:
    """Flag the first ``quota`` rows of every group along the non-null columns ``order``.

    ``quota`` is an expression over the group columns, ``_total`` (group size) and the
    columns of ``quotas``: a table keyed by the groups, or a function that makes one from
    the group sizes (groups, ``_total``).  Without large groups a row number decides.  With
    them the last row taken is looked up in the one piece of its group in which the quota
    is reached; every other row is compared with it, so the rows themselves are neither
    sorted nor shuffled.
    """
    columns = df.columns
    df, groups = _grouped(df, groups)
    large = large_groups(df, groups, piece_rows)
    tagged = df.withColumn("_bucket", F.lit(0).cast("long")) if large is None else cut(df, groups, bucket, large)
    counts = settle(tagged.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    if callable(quotas):
        quotas = quotas(totals)
    if quotas is not None:
        totals = match(totals, quotas, groups, "left")
    wanted = totals.select(*groups, "_total", F.coalesce(quota.cast("long"), F.lit(0)).alias("_quota"))
    place = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    if large is None:
        return match(df, settle(wanted), groups, "left").withColumn(out, place <= F.col("_quota")).select(*columns, out)
    partly = wanted.where((F.col("_quota") > 0) & (F.col("_quota") < F.col("_total")))
    edges = (
        match(_offsets(counts, groups, "_n"), partly, groups)
        .where((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_n")))
        .select(*groups, "_bucket", (F.col("_quota") - F.col("_before")).alias("_need"))
    )
    at_edge = match(tagged, settle(edges), [*groups, "_bucket"]).withColumn("_place", place)
    last = at_edge.where(F.col("_place") == F.col("_need")).select(*groups, F.struct(*order).alias("_last"))
    limits = settle(match(wanted, last, groups, "left"))
    taken = F.when(F.col("_quota") >= F.col("_total"), True).otherwise(F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False)))
    return match(df, limits, groups, "left").select(*columns, taken.alias(out))
