"""Scores from (y_true, y_pred, n) counts: any number of predictions costs one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prediction_counts(predictions: DataFrame, by: Sequence[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """``by, y_true, y_pred, n``: the only thing scores are computed from."""
    return predictions.groupBy(
        *by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class that occurs in truth or prediction: support, predicted and hit counts."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    as_true = F.struct(
        F.col("y_true").alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("hit")
    )
    as_pred = F.struct(F.col("y_pred").alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hit"))
    sides = counts.select(*by, F.explode(F.array(as_true, as_pred)).alias("s")).select(*by, "s.*")
    return sides.groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hit")]
    )


def fold_metrics(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy (mean recall over classes present in the truth),
    macro F1 (classes in truth or prediction) and weighted F1, with the chance level of
    the scored classes and the majority share of the test rows."""
    f1 = F.col("hit") * 2 / (F.col("support") + F.col("predicted"))
    total = F.sum("support")
    present = F.count_if(F.col("support") > 0)
    balanced = F.avg(F.try_divide("hit", "support"))
    return class_counts(counts, by).groupBy(*by).agg(
        total.alias("n_test"),
        (F.sum("hit") / total).alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        F.avg(f1).alias("macro_f1"),
        (F.sum(F.col("support") * f1) / total).alias("weighted_f1"),
        present.alias("n_test_classes"),
        (F.lit(1.0) / present).alias("uniform_chance"),
        (balanced * present).alias("ba_over_uniform_chance"),
        (F.max("support") / total).alias("test_majority_accuracy"),
    )


def confusion_matrix(counts: DataFrame, by: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """``by, y_true, y_pred, n, support`` over a fixed class set, zeros included."""
    names = F.array(*[F.lit(c) for c in classes])
    grid = (
        counts.select(*by).distinct()
        .select(*by, F.explode(names).alias("y_true"))
        .select("*", F.explode(names).alias("y_pred"))
    )
    support = counts.groupBy(*by, "y_true").agg(F.sum("n").alias("support"))
    zero = F.lit(0).cast("long")
    return (
        grid.join(counts, [*by, "y_true", "y_pred"], "left")
        .join(support, [*by, "y_true"], "left")
        .select(*by, "y_true", "y_pred", F.coalesce("n", zero).alias("n"), F.coalesce("support", zero).alias("support"))
    )


def comparable_units(metrics: DataFrame) -> DataFrame:
    """Units whose test data has a single class leave balanced-accuracy comparisons."""
    return metrics.where(F.col("n_test_classes") >= 2)


def single_class_units(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Units kept and excluded by :func:`comparable_units`."""
    return metrics.groupBy(*by).agg(
        F.count_if(F.col("n_test_classes") >= 2).alias("n_units"),
        F.count_if(F.col("n_test_classes") < 2).alias("n_excluded_single_class"),
    )


def balanced_weights(counts: DataFrame, by: Sequence[str], label: str, n: str, n_classes: int, absent: str = "zero") -> DataFrame:
    """Training weights ``total / (K * n_k)`` per class.

    A class without training rows weighs 0, or (``absent='clip'``) as if it had one row.
    """
    from pyspark.sql import Window as W

    total = F.sum(n).over(W.partitionBy(*by))
    if absent == "clip":
        weight = total / (F.lit(n_classes) * F.greatest(F.col(n), F.lit(1)))
    else:
        weight = F.when(F.col(n) > 0, total / (F.lit(n_classes) * F.col(n))).otherwise(F.lit(0.0))
    return counts.select(*by, label, n, weight.alias("weight"))


def trial_predictions(scores: DataFrame, trial: str, label: str, score: str, n_classes: int) -> DataFrame:
    """Mean class scores over a trial's windows, then the first class with the highest mean.

    One average per class, so windows are combined before the shuffle.
    """
    means = [F.avg(F.get(score, F.lit(i))) for i in range(n_classes)]
    return (
        scores.groupBy(trial)
        .agg(F.min(label).alias("y_true"), F.array(*means).alias("_means"), (F.min(label) != F.max(label)).alias("mixed"))
        .select(trial, "y_true", (F.array_position("_means", F.array_max("_means")) - 1).cast("long").alias("y_pred"), "mixed")
    )


def window_predictions(score: Column | str) -> Column:
    """The first class with the highest score of one window."""
    return (F.array_position(score, F.array_max(score)) - 1).cast("long")
