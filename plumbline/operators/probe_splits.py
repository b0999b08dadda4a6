"""Closed-set probe splits: what is held out follows from the label that is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import crc_order
from plumbline.functions.ranking import linear_bucket, mark_first, match
from plumbline.functions.settle import settle

# Names of the status and of the two kinds of split in results.
NOT_ESTIMABLE = "NOT_ESTIMABLE"
WITHIN_CLASS, BY_SUBJECT = "within_class_groups", "subject_holdout"

TRIALS, SUBJECTS = "trial_key", "subject_key"

#: The unit that is held out to ask for a label.  A stimulus is asked of unseen subjects, for a
#: known subject's other trials would give it away; anything else is asked of unseen trials of known classes.
HELD_OUT = {"stimulus_key": SUBJECTS}

#: Share of the units that tests, and units that a class needs to be asked for.
TEST_SHARE, LEAST_UNITS = 0.3, 2


def unit_of(label: str) -> str:
    return HELD_OUT.get(label, TRIALS)


def kind_of(label: str) -> str:
    return BY_SUBJECT if unit_of(label) == SUBJECTS else WITHIN_CLASS


def _tested(units: DataFrame, classes: list[str], unit: str, least: int, seed: int) -> DataFrame:
    """``units`` with ``_test``: the first share of each class along a seeded CRC order; none in a class below ``least``."""
    n = F.col("_total")
    size = F.greatest(F.lit(1), F.least(F.bround(n * TEST_SHARE), n - 1))
    quota = F.when(n >= least, size).otherwise(F.lit(0))
    ordered = units.withColumn("_crc", crc_order(seed, unit))
    return mark_first(ordered, classes, ["_crc", unit], quota, linear_bucket(F.col("_crc"), 2**32), "_test").drop("_crc")


def spanning_groups(meta: DataFrame, label: str, unit: str = TRIALS) -> DataFrame:
    """Units that carry several classes; such a question is ill-defined."""
    ends = meta.groupBy(unit).agg(F.min(label).alias("lowest"), F.max(label).alias("highest"))
    return ends.where(F.col("lowest") != F.col("highest"))


def _sided(tested: DataFrame, usable: DataFrame, unit: str, label: str) -> DataFrame:
    side = F.when(F.col("_usable"), F.when(F.col("_test"), "test").otherwise("train"))
    return match(tested, usable, [label]).select(unit, label, side.alias("side"))


def within_class_split(meta: DataFrame, label: str, seed: int, unit: str = TRIALS) -> DataFrame:
    """``unit, label, side``; ``side`` is null where the class has too few units."""
    pairs = settle(meta.select(unit, label).distinct())
    enough = pairs.groupBy(label).agg((F.count(F.lit(1)) >= LEAST_UNITS).alias("_usable"))
    return _sided(_tested(pairs, [label], unit, LEAST_UNITS, seed), enough, unit, label)


def by_subject_split(meta: DataFrame, label: str, seed: int) -> DataFrame:
    """``subject, label, side``; ``side`` is null for classes missing on one side."""
    pairs = settle(meta.select(SUBJECTS, label).distinct())
    tested = match(pairs, _tested(pairs.select(SUBJECTS).distinct(), [], SUBJECTS, 2, seed), [SUBJECTS])
    on_both = tested.groupBy(label).agg((F.min("_test") != F.max("_test")).alias("_usable"))
    return _sided(tested, on_both, SUBJECTS, label)


def probe_sides(meta: DataFrame, label: str, seed: int) -> DataFrame:
    """Which side every (held-out unit, label) pair is on; null for unusable classes."""
    return settle(by_subject_split(meta, label, seed) if unit_of(label) == SUBJECTS else within_class_split(meta, label, seed))


def probe_rows(meta: DataFrame, sides: DataFrame, label: str) -> DataFrame:
    """Rows of ``meta`` with ``side`` (train or test); rows of unusable classes are left out."""
    return meta.join(sides.where(F.col("side").isNotNull()), [unit_of(label), label])


def _distinct_where(condition: Column, value: Column) -> Column:
    return F.count_distinct(F.when(condition, value))


def split_report(sides: DataFrame, label: str) -> DataFrame:
    """One row: eligible and skipped classes, units per side, status."""
    usable, unit, asked = F.col("side").isNotNull(), F.col(unit_of(label)), F.col(label)
    counted = sides.agg(
        _distinct_where(usable, asked).alias("n_eligible_classes"),
        (F.count_distinct(asked) - _distinct_where(usable, asked)).alias("n_skipped_classes"),
        _distinct_where(F.col("side") == "train", unit).alias("n_train_groups"),
        _distinct_where(F.col("side") == "test", unit).alias("n_test_groups"),
    )
    ok = (F.col("n_eligible_classes") >= 2) & (F.col("n_test_groups") >= 1)
    return counted.select(
        F.lit(label).alias("probe_query"),
        F.lit(kind_of(label)).alias("probe_split"),
        "*",
        F.when(ok, "OK").otherwise(NOT_ESTIMABLE).alias("status"),
    )
