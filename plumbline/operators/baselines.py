"""Baselines that need no features: majority class and sampling from the class shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_md5, unit_interval


def majority_label(train_counts: DataFrame, by: Sequence[str], label: str = "target_label", n: str = "train") -> DataFrame:
    """``by, majority``: the most frequent training class, ties to the first label."""
    return train_counts.groupBy(*by).agg(F.min_by(label, F.struct(-F.col(n), F.col(label))).alias("majority"))


def majority_counts(composition: DataFrame, by: Sequence[str], label: str = "target_label") -> DataFrame:
    """Prediction counts of the majority baseline from fold composition alone.

    ``composition`` has ``by, label, train, test``; no row of data is touched, so all folds
    of a leave-one-out design cost one small join.
    """
    best = majority_label(composition, by, label)
    return (
        composition.where(F.col("test") > 0)
        .join(best, list(by))
        .select(*by, F.col(label).alias("y_true"), F.col("majority").alias("y_pred"), F.col("test").alias("n"))
    )


def prior_blocks(train_counts: DataFrame, by: Sequence[str], label: str = "target_label", n: str = "train") -> DataFrame:
    """``by, blocks``: classes in order with the upper end of their share of [0, 1)."""
    group = W.partitionBy(*by)
    upto = F.sum(n).over(group.orderBy(label).rowsBetween(W.unboundedPreceding, 0))
    shares = train_counts.where(F.col(n) > 0).select(*by, label, (upto / F.sum(n).over(group)).alias("_upto"))
    return shares.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_upto", F.col(label).alias("_name")))).alias("blocks")
    )


def prior_predictions(test_rows: DataFrame, blocks: DataFrame, seed: int, key: str = "row_index") -> DataFrame:
    """Draw a class for each test row from the class shares of its fold (a seeded draw per row)."""
    u = unit_interval(seeded_md5(F.lit(seed) + F.col("fold"), key))
    pick = F.element_at(F.filter("blocks", lambda b: F.col("_u") < b["_upto"]), 1)
    return test_rows.withColumn("_u", u).join(blocks, "fold").withColumn("y_pred", pick["_name"]).drop("_u", "blocks")
