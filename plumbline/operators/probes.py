"""Confound probes: is subject, stimulus or session linearly readable from features?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.settle import at_once, settle
from plumbline.operators import linear, metrics, sampling
from plumbline.operators.probe_splits import NOT_ESTIMABLE, TRIALS, probe_rows, probe_sides, spanning_groups, split_report, unit_of

PROBE_ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("probe_query", "probe_split", "group_col", "status")]
    + [
        T.StructField(c, T.LongType())
        for c in (
            "n_chunks", "n_subjects", "n_trials", "n_eligible_classes", "n_skipped_classes", "n_train_groups",
            "n_test_groups", "n_test_classes",
        )
    ]
    + [
        T.StructField(c, T.DoubleType())
        for c in ("balanced_accuracy", "accuracy", "uniform_chance", "ba_over_uniform_chance", "test_majority_accuracy")
    ]
    + [T.StructField("converged", T.BooleanType())]
)


#: Name of the split that draws windows.
WINDOWS = "window_random"


class ProbeError(ValueError):
    """The probe question is ill-defined for the data."""


def probe(features: DataFrame, meta: DataFrame, label: str, seed: int) -> dict:
    """One probe of one feature space: a row of counts and scores, or NOT_ESTIMABLE.

    ``meta`` has ``row_index, subject_key, trial_key`` and the asked label; ``features``
    has ``row_index, features``.
    """
    meta = settle(meta)
    unit = unit_of(label)
    if unit == TRIALS and spanning_groups(meta, label).limit(1).count():
        raise ProbeError(f"a trial carries several values of {label}")
    split = probe_sides(meta, label, seed)
    row = split_report(split, label).first().asDict()
    row["group_col"] = unit
    sizes = meta.groupBy("subject_key", "trial_key").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(
        F.sum("n").alias("n_chunks"),
        F.count_distinct("subject_key").alias("n_subjects"),
        F.count_distinct("trial_key").alias("n_trials"),
    ).first()
    row.update(total.asDict())
    if row["status"] != "OK":
        return row
    rows = settle(probe_rows(meta, split, label).select("row_index", F.col(label).cast("string").alias("label"), "side"))
    return with_scores(row, features, rows, balanced=False)


def with_scores(row: dict, features: DataFrame, rows: DataFrame, balanced: bool) -> dict:
    """``row`` with the scores of a model that is trained and tested on ``rows`` (row_index, label, side)."""
    sides = rows.groupBy("label").agg(
        F.bool_or(F.col("side") == "train").alias("fit"), F.bool_or(F.col("side") == "test").alias("test")
    ).collect()
    if not any(r["fit"] for r in sides) or not any(r["test"] for r in sides):
        row["status"] = NOT_ESTIMABLE
        return row
    unsupported = [r["label"] for r in sides if r["test"] and not r["fit"]]
    if unsupported:
        raise ProbeError(f"test classes without training rows: {unsupported[:3]}")
    names = [r["label"] for r in sides]
    assigned = rows.select(F.lit(1).alias("fold"), "row_index", F.col("side").alias("split"), "label")
    predicted = linear.fit_predict(assigned, features, names, linear.LOGISTIC, label="label", balanced=balanced)
    converged = predicted.agg(F.bool_and("converged")).first()[0]
    counts = metrics.prediction_counts(predicted.withColumn("_all", F.lit(1)), ["_all"])
    scored = metrics.fold_metrics(counts, ["_all"]).first().asDict()
    row.update({k: v for k, v in scored.items() if k in PROBE_ROW.names})
    row["converged"] = bool(converged)
    return row


def window_random_probe(features: DataFrame, meta: DataFrame, label: str, seed: int) -> dict:
    """A probe whose test windows are drawn at random within each class, with balanced class weights.

    Windows of one trial may fall on both sides, so the score tells how much a split by
    windows flatters; groups are windows here.  Rows without a value of the label take no part, and
    fewer than two classes are NOT_ESTIMABLE.
    """
    meta = settle(meta.where(F.col(label).isNotNull()))
    split = settle(sampling.stratified_holdout(meta, seed, label))
    row = meta.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.count_distinct("subject_key").alias("n_subjects"),
        F.count_distinct("trial_key").alias("n_trials"),
        F.count_distinct(label).alias("n_eligible_classes"),
    ).first().asDict()
    groups = split.agg(
        F.count_if(F.col("split") == "train").alias("n_train_groups"),
        F.count_if(F.col("split") == "test").alias("n_test_groups"),
        F.count_distinct(F.when(F.col("split") == "test", F.col(label))).alias("n_test_classes"),
    ).first().asDict()
    row |= groups | {"probe_query": label, "probe_split": WINDOWS, "group_col": "row_index", "n_skipped_classes": 0, "status": "OK"}
    if row["n_eligible_classes"] < 2:
        row["status"] = NOT_ESTIMABLE
        return row
    rows = split.select("row_index", F.col(label).cast("string").alias("label"), F.col("split").alias("side"))
    return with_scores(row, features, rows, balanced=True)


def probe_suite(features: DataFrame, meta: DataFrame, labels: Sequence[str], max_rows: int, seed: int, min_class_count: int, asked=None) -> DataFrame:
    """The confound suite over one feature table: one row per asked label, on a balanced sample.

    ``asked`` is the kind of probe: :func:`probe` (the default) or :func:`window_random_probe`.
    """
    asked = asked or probe

    def one(label: str) -> dict | None:
        sampled = settle(sampling.probe_sample(meta, label, max_rows, seed, min_class_count))
        if sampled.select(label).distinct().limit(2).count() < 2:
            return None
        return asked(features, sampled, label, seed)

    return probe_table(meta, [r for r in at_once(meta.sparkSession, one, list(labels)) if r is not None])


def probe_spaces(spaces: DataFrame, meta: DataFrame, labels: Sequence[str], seed: int, by: Sequence[str]) -> DataFrame:
    """One probe per encoder, space and label; coordinates are never pooled between encoders.

    ``spaces`` has ``by`` (for example encoder and space), ``row_index, features``;
    ``meta`` has the first column of ``by`` and the entity keys.
    """
    units = sorted(tuple(r) for r in spaces.select(*by).distinct().collect())

    def one(asked: tuple) -> dict | None:
        unit, label = asked
        mine, info = spaces, meta
        for column, value in zip(by, unit, strict=True):
            mine = mine.where(F.col(column) == value)
            if column in info.columns:
                info = info.where(F.col(column) == value)
        if label == "session_key" and info.select(label).distinct().limit(2).count() < 2:
            return None
        return {**dict(zip(by, unit, strict=True)), **probe(mine, info, label, seed)}

    rows = at_once(meta.sparkSession, one, [(unit, label) for unit in units for label in labels])
    return probe_table(meta, [r for r in rows if r is not None], by)


def probe_table(like: DataFrame, rows: list[dict], by: Sequence[str] = ()) -> DataFrame:
    """Probe results (one row per question) as a table."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in by] + PROBE_ROW.fields)
    return like.sparkSession.createDataFrame([[r.get(f.name) for f in schema.fields] for r in rows], schema)
