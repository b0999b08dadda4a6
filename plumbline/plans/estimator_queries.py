"""Models on feature vectors: fold baselines, probes, the permutation null, transfer.

``embeddings`` is read as one feature vector per window: 4 bands x 16 channels, ten
subjects, two sessions, five stimuli.  At 64 features these queries are checked
against brute force in the tests; ``solver_queries`` checks the same runners by value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import checkpoint_dir, settle
from plumbline.operators import evaluation, folds, labels, linear, metrics, probes, registry
from plumbline.plans.bindings import SEED, table
from plumbline.plans.catalog import query
from plumbline.plans.metric_queries import METRICS_SQL, SCORE_COLUMNS, rounded
from plumbline.sources import runs

CLASSES = ("high_valence", "low_valence")


def feature_windows(spark, sf) -> DataFrame:
    """Keys, labels and both feature sets of every window."""
    number = F.col("vec_id")
    subject = F.concat(F.lit("s"), F.format_string("%02d", number % 10))
    session = F.concat(F.lit("session_"), (F.floor(number / 10) % 2 + 1).cast("string"))
    trial = (F.floor(number / 20) % 5).cast("string")
    vector = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        number.alias("row_index"),
        "label",
        subject.alias("subject_key"),
        session.alias("session_key"),
        F.concat_ws("::", subject, session, F.concat(F.lit("trial_"), trial)).alias("trial_key"),
        F.concat(F.lit("trial_"), trial).alias("stimulus_key"),
        F.when(F.col("label") >= 5, CLASSES[0]).otherwise(CLASSES[1]).alias("target_label"),
        vector.alias("spectral"),
        F.slice(vector, 33, 16).alias("alpha"),
    )


def loso(spark, sf) -> DataFrame:
    rows = feature_windows(spark, sf).drop("spectral", "alpha")
    return folds.assign_rows(rows, folds.subject_rules(folds.subject_circle(rows, SEED)), ["subject_key"])


def feature_table(spark, sf) -> DataFrame:
    return feature_windows(spark, sf).select("row_index", "alpha", "spectral")


@query("fold_baselines")
def _baselines(spark, sf):
    models = ["majority", "random_prior", "alpha_logistic", "spectral_logistic", "spectral_svm"]
    return rounded(
        evaluation.run_baselines(loso(spark, sf), feature_table(spark, sf), models, CLASSES, "leave_one_subject_out", SEED), 4
    )


FEATURE_LOSO_SQL = f"""rows AS (
  SELECT vec_id AS row_index, printf('s%02d', vec_id % 10) AS subject_key,
         CASE WHEN label >= 5 THEN 'high_valence' ELSE 'low_valence' END AS target_label FROM embeddings),
subjects AS (SELECT DISTINCT subject_key FROM rows),
circle AS (
  SELECT subject_key, row_number() OVER (ORDER BY subject_key) AS fold,
         row_number() OVER (ORDER BY md5('{SEED}:' || subject_key), subject_key) - 1 AS pos, count(*) OVER () AS n FROM subjects),
assigned AS (
  SELECT r.*, t.fold, CASE WHEN s.pos = t.pos THEN 'test' WHEN (s.pos - t.pos + s.n) % s.n <= ceil((s.n - 1) * 0.2) THEN 'val' ELSE 'train' END AS split
  FROM rows r JOIN circle s USING (subject_key), circle t),
train AS (SELECT fold, target_label, count(*) AS n FROM assigned WHERE split = 'train' GROUP BY ALL),
best AS (SELECT DISTINCT ON (fold) fold, target_label AS majority FROM train ORDER BY fold, n DESC, target_label),
ends AS (
  SELECT fold, target_label, sum(n) OVER (PARTITION BY fold ORDER BY target_label) / sum(n) OVER (PARTITION BY fold) AS upto FROM train),
predictions AS (
  SELECT 'majority' AS model, fold, target_label AS y_true, majority AS y_pred FROM assigned JOIN best USING (fold) WHERE split = 'test'
  UNION ALL
  SELECT * FROM (
    SELECT DISTINCT ON (a.fold, row_index) 'random_prior', a.fold, a.target_label, e.target_label
    FROM assigned a JOIN ends e ON e.fold = a.fold
     AND CAST('0x' || substr(md5(({SEED} + a.fold) || ':' || row_index), 1, 8) AS BIGINT) / 4294967296.0 < upto
    WHERE split = 'test' ORDER BY a.fold, row_index, upto)),
counts AS (SELECT model, fold, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL),
{METRICS_SQL.format(by='model, fold')}"""


@query(
    "featureless_fold_baselines",
    f"WITH {FEATURE_LOSO_SQL} SELECT model, fold, n_test, n_test_classes, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLUMNS)
    + " FROM scores",
)
def _featureless(spark, sf):
    models = ["majority", "random_prior"]
    return rounded(
        evaluation.run_baselines(loso(spark, sf), feature_table(spark, sf), models, CLASSES, "leave_one_subject_out", SEED)
    )


@query(
    "resumed_fold_baselines",
    f"WITH {FEATURE_LOSO_SQL.replace('label >= 5', 'label > 3')} SELECT model, fold, n_test, n_test_classes, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLUMNS)
    + ", model = 'majority' OR fold <= 4 AS reused FROM scores",
)
def _resumed(spark, sf):
    """A declared label contract, and a ledger: one model on all folds, another on four; the whole run makes the rest only."""
    rows = feature_windows(spark, sf).withColumn("valence", F.col("label").cast("double")).drop("spectral", "alpha", "target_label")
    rows = labels.with_labels(rows, "dreamer", "valence")
    assigned = folds.assign_rows(rows, folds.subject_rules(folds.subject_circle(rows, SEED)), ["subject_key"])
    features = feature_table(spark, sf)
    path = f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    ledger = runs.Ledger(path, {"dataset": "dreamer", "target": "valence", "features": "embeddings"})

    def run(rows, models):
        contract = ("dreamer", "valence", labels.PRIMARY)
        return evaluation.run_baselines(rows, features, models, CLASSES, "leave_one_subject_out", SEED, contract=contract, ledger=ledger)

    run(assigned, ["majority"])
    run(assigned.where("fold <= 4"), ["random_prior"])
    before = settle(spark.read.parquet(path).select("model", "fold", F.lit(True).alias("reused")))
    whole = run(assigned, ["majority", "random_prior"])
    return rounded(whole.join(before, ["model", "fold"], "left").withColumn("reused", F.coalesce("reused", F.lit(False))))


@query("multiclass_linear_svm")
def _svm(spark, sf):
    """Ten classes, one against the rest, five folds: fifty problems in one set of passes."""
    rows = feature_windows(spark, sf).withColumn("name", F.concat(F.lit("c"), F.col("label").cast("string")))
    assigned = folds.segment_random(rows, 5, SEED, "name", ["name"])
    names = [f"c{i}" for i in range(10)]
    features = rows.select("row_index", F.col("spectral").alias("features"))
    predicted = linear.fit_predict(assigned, features, names, linear.SVM, label="name")
    return rounded(metrics.fold_metrics(metrics.prediction_counts(predicted, ["fold"]), ["fold"]), 4)


@query("multiclass_logistic")
def _logistic(spark, sf):
    rows = feature_windows(spark, sf).withColumn("name", F.concat(F.lit("c"), F.col("label").cast("string")))
    split = folds.segment_random(rows, 5, SEED, "name", ["name"])
    names = [f"c{i}" for i in range(10)]
    features = rows.select("row_index", F.col("spectral").alias("features"))
    predicted = linear.fit_predict(split, features, names, linear.LOGISTIC, label="name")
    return rounded(metrics.fold_metrics(metrics.prediction_counts(predicted, ["fold"]), ["fold"]), 4)


@query("confound_probe_suite")
def _suite(spark, sf):
    rows = feature_windows(spark, sf)
    features = rows.select("row_index", F.col("spectral").alias("features"))
    meta = rows.drop("spectral", "alpha", "label", "target_label")
    return rounded(probes.probe_suite(features, meta, ["subject_key", "stimulus_key", "session_key"], 50_000, SEED, 20), 4)


def encoder_spaces(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two stand-in encoders (halves of the rows), each with a learned and a raw space."""
    rows = feature_windows(spark, sf).withColumn(
        "encoder_id", F.when(F.col("label") < 5, "encoder_1").otherwise("encoder_2")
    )
    spaces = rows.select(
        "encoder_id",
        "row_index",
        F.explode(
            F.array(
                F.struct(F.lit("learned").alias("space"), F.col("alpha").alias("features")),
                F.struct(F.lit("raw_spectral").alias("space"), F.col("spectral").alias("features")),
            )
        ).alias("s"),
    ).select("encoder_id", "s.space", "row_index", "s.features")
    return spaces, rows.drop("spectral", "alpha", "label", "target_label")


@query("matched_space_probes")
def _spaces(spark, sf):
    spaces, meta = encoder_spaces(spark, sf)
    return rounded(probes.probe_spaces(spaces, meta, ["subject_key", "stimulus_key", "session_key"], SEED, ["encoder_id", "space"]), 4)


@query("label_permutation_null")
def _null(spark, sf):
    rows = evaluation.run_permutation_null(
        loso(spark, sf), feature_table(spark, sf), ["alpha_logistic", "spectral_logistic"], CLASSES, 3, SEED, "leave_one_subject_out"
    )
    named = rows.withColumns(
        {
            "dataset": F.lit("dreamer"),
            "target": F.lit("valence"),
            "protocol": F.lit("strict_loso"),
            "n_classes": F.lit(2),
        }
    )
    return rounded(registry.permutation_summary(named), 4)


def domains(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Trials of two domains: odd and even stimuli."""
    rows = feature_windows(spark, sf).select(
        "row_index", "subject_key", "trial_key", "target_label", F.col("spectral").alias("features"), F.col("stimulus_key").isin("trial_1", "trial_3").alias("_odd")
    )
    return evaluation.trial_rows(rows.where("_odd")), evaluation.trial_rows(rows.where("not _odd"))


@query("cross_domain_transfer")
def _transfer(spark, sf):
    evaluation.require_transfer("deap", "dreamer", "valence")
    source, target = domains(spark, sf)
    predicted = evaluation.run_transfer(source, target, CLASSES, n_bands=4, n_channels=16)
    return rounded(metrics.fold_metrics(metrics.prediction_counts(predicted, ["method"]), ["method"]), 4)


@query("transfer_per_target_subject")
def _transfer_units(spark, sf):
    """Per target subject scores of the pooled pipeline with both losses, in the shape the summary reads."""
    source, target = domains(spark, sf)
    predicted = evaluation.run_transfer(
        source, target, CLASSES, ["pooled"], [linear.LOGISTIC, linear.SVM], n_bands=4, n_channels=16
    )
    units = metrics.fold_metrics(metrics.prediction_counts(predicted, ["method", "subject_key"]), ["method", "subject_key"])
    rows = metrics.comparable_units(units).select(
        F.lit("deap").alias("source"),
        F.lit("dreamer").alias("target_dataset"),
        F.lit("valence").alias("target"),
        F.col("method").alias("pipeline"),
        F.col("subject_key").alias("target_subject"),
        F.col("balanced_accuracy").alias("ba"),
    )
    return rounded(registry.transfer_estimates(rows), 4)
