"""Runners: baselines per fold, the label-permutation null, and transfer between domains."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.operators import audits, baselines, features, labels, linear, metrics, sampling, shuffles
from plumbline.sources import runs
from plumbline.sources.tables import covered_rows

# Names of the models, with the feature column and the loss of each.
MODELS = {
    "majority": (None, None),
    "random_prior": (None, None),
    "alpha_logistic": ("alpha", linear.LOGISTIC),
    "alpha_svm": ("alpha", linear.SVM),
    "spectral_logistic": ("spectral", linear.LOGISTIC),
    "spectral_svm": ("spectral", linear.SVM),
}

#: Added to the seed of the test caps, so they draw another order than the training caps.
TEST_DRAW = 7


def capped(assignments: DataFrame, seed: int, max_train: int | None, max_test: int | None) -> DataFrame:
    """Class-balanced row caps of every fold, all folds in the same passes."""
    out = None
    for split, cap, shift in (("train", max_train, 0), ("test", max_test, TEST_DRAW)):
        part = assignments.where(F.col("split") == split)
        if cap is not None:
            part = sampling.balanced_cap(part, cap, F.lit(seed + shift) + F.col("fold"), by=["fold"])
        out = part if out is None else out.unionByName(part)
    return out


#: Entities that a protocol keeps on one side of every fold.
SEPARATED = {"trial_grouped": ("trial_key",), "leave_one_subject_out": ("trial_key", "subject_key")}


def audited(assignments: DataFrame, protocol: str) -> DataFrame:
    """Stop before any model if a fold repeats rows or leaks entities its protocol separates: one scan for all checks."""
    audits.require_empty(audits.role_audit(assignments, SEPARATED.get(protocol, ())), f"{protocol}: repeated rows or leakage")
    return assignments


def checked(assignments: DataFrame, feature_table: DataFrame, protocol: str, allow_partial: bool, contract: tuple[str, str, str] | None) -> DataFrame:
    """The assignments, written once: as declared (dataset, target, variant), without leaks, with features for every row."""
    rows = settle(assignments)
    if contract is not None:
        labels.require_contract(rows, *contract)
    audited(rows, protocol)
    return covered_rows(rows, feature_table, allow_partial=allow_partial)


def predictions_of(
    model: str, assignments: DataFrame, feature_table: DataFrame | None, classes: Sequence[str], seed: int, unit: Sequence[str] = ("fold",),
    label: str = "target_label", test_label: str = "target_label",
) -> DataFrame:
    """``unit, row_index, y_true, y_pred`` of one model over all folds."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {sorted(MODELS)}")
    which, loss = MODELS[model]
    if which is None:
        train = assignments.where(F.col("split") == "train").groupBy(*unit, label).agg(F.count(F.lit(1)).alias("train"))
        test = assignments.where(F.col("split") == "test").withColumn("y_true", F.col(test_label))
        if model == "majority":
            best = baselines.majority_label(train, unit, label)
            return test.join(best, list(unit)).select(*unit, "row_index", "y_true", F.col("majority").alias("y_pred"))
        drawn = baselines.prior_predictions(test, baselines.prior_blocks(train, unit, label), seed)
        return drawn.select(*unit, "row_index", "y_true", "y_pred")
    columns = feature_table.select("row_index", F.col(which).alias("features"))
    return linear.fit_predict(assignments, columns, classes, loss, unit, label, test_label)


def metrics_schema(assignments: DataFrame, unit: Sequence[str]) -> DataFrame:
    """A table without rows that has the columns of a runner's result."""
    kinds = {"model": "string", "fold": assignments.schema["fold"].dataType.simpleString(), "permutation": "int"}
    keys = ", ".join(f"{c} {kinds[c]}" for c in unit)
    counts = assignments.sparkSession.createDataFrame([], f"{keys}, y_true string, y_pred string, n long")
    return metrics.fold_metrics(counts, unit)


def resumed(
    ledger: runs.Ledger, assignments: DataFrame, models: Sequence[str], unit: Sequence[str], own: dict, prepare: Callable[[DataFrame], DataFrame],
    score: Callable[[str, DataFrame], DataFrame],
) -> DataFrame:
    """Results of all folds and models, of which only those that ``ledger`` lacks are made.

    Folds in which some model is open are prepared (checked, capped) together; each model then
    runs on its own open folds and is appended before the next begins.  Where nothing is open, no
    check or model runs at all.
    """
    folds = settle(assignments.select("fold").distinct())
    book = ledger.opened(metrics_schema(assignments, unit), own)
    pending = settle(book.pending(folds, models))
    left = {r["model"] for r in pending.select("model").distinct().collect()}  # at most one row per model
    if left:
        rows = settle(prepare(assignments.join(pending.select("fold").distinct(), "fold", "left_semi")))
        for model in models:
            if model in left:
                mine = rows.join(pending.where(F.col("model") == model), "fold", "left_semi")
                book.append(score(model, mine))
    wanted = folds.select("fold", F.explode(F.array(*map(F.lit, models))).alias("model"))
    return book.results(folds.sparkSession, unit).join(wanted, ["model", "fold"], "left_semi")


def run_baselines(
    assignments: DataFrame,
    feature_table: DataFrame,
    models: Sequence[str],
    classes: Sequence[str],
    protocol: str,
    seed: int,
    max_train: int | None = None,
    max_test: int | None = None,
    allow_partial: bool = False,
    contract: tuple[str, str, str] | None = None,
    ledger: runs.Ledger | None = None,
) -> DataFrame:
    """All models on all folds: contract, audit, coverage, caps, fit, score.  ``model, fold`` metrics.

    With a ``ledger`` only folds without a result under the same settings are run (see :func:`resumed`).
    """

    def prepare(rows: DataFrame) -> DataFrame:
        return capped(checked(rows, feature_table, protocol, allow_partial, contract), seed, max_train, max_test)

    def counted(model: str, rows: DataFrame) -> DataFrame:
        predicted = predictions_of(model, rows, feature_table, classes, seed)
        return metrics.prediction_counts(predicted, ["fold"]).withColumn("model", F.lit(model))

    unit = ["model", "fold"]
    if ledger is not None:
        own = {
            "runner": "baselines", "classes": tuple(classes), "protocol": protocol, "seed": seed, "max_train_rows": max_train, "max_test_rows": max_test,
            "allow_partial": allow_partial, "contract": contract,
        }
        return resumed(ledger, assignments, models, unit, own, prepare, lambda model, rows: metrics.fold_metrics(counted(model, rows), unit))
    rows = prepare(assignments)
    counts = None
    for model in models:
        mine = counted(model, rows)
        counts = mine if counts is None else counts.unionByName(mine)
    return metrics.fold_metrics(counts, unit)


def with_permuted_labels(assignments: DataFrame, n_permutations: int, seed: int) -> DataFrame:
    """Train rows once per permutation with permuted ``_label``, test rows once per permutation with their own."""
    train = assignments.where(F.col("split") == "train")
    permuted = shuffles.permute_labels(train, n_permutations, seed).select(
        "fold", "permutation", "row_index", F.lit("train").alias("split"), "target_label", F.col("permuted_label").alias("_label")
    )
    test = assignments.where(F.col("split") == "test").select(
        "fold",
        F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))).alias("permutation"),
        "row_index",
        "split",
        "target_label",
        F.col("target_label").alias("_label"),
    )
    return permuted.unionByName(test)


def run_permutation_null(
    assignments: DataFrame,
    feature_table: DataFrame,
    models: Sequence[str],
    classes: Sequence[str],
    n_permutations: int,
    seed: int,
    protocol: str,
    max_train: int | None = None,
    max_test: int | None = None,
    allow_partial: bool = False,
    contract: tuple[str, str, str] | None = None,
    ledger: runs.Ledger | None = None,
) -> DataFrame:
    """Train labels permuted inside each fold: ``model, fold, permutation`` metrics.

    The same checks and caps as :func:`run_baselines` come first.  All folds and
    permutations of a model are solved together; features are not copied.  A ``ledger`` holds all
    permutations of a fold or none.
    """
    unit = ["fold", "permutation"]

    def prepare(rows: DataFrame) -> DataFrame:
        rows = settle(capped(checked(rows, feature_table, protocol, allow_partial, contract), seed, max_train, max_test))
        return with_permuted_labels(rows, n_permutations, seed)

    def counted(model: str, rows: DataFrame) -> DataFrame:
        predicted = predictions_of(model, rows, feature_table, classes, seed, unit, "_label", "target_label")
        return metrics.prediction_counts(predicted, unit).withColumn("model", F.lit(model))

    by = ["model", *unit]
    if ledger is not None:
        own = {
            "runner": "permutation_null", "classes": tuple(classes), "protocol": protocol, "seed": seed, "n_permutations": n_permutations,
            "max_train_rows": max_train, "max_test_rows": max_test, "allow_partial": allow_partial, "contract": contract,
        }
        return resumed(ledger, assignments, models, by, own, prepare, lambda model, rows: metrics.fold_metrics(counted(model, rows), by))
    both = settle(prepare(assignments))
    counts = None
    for model in models:
        mine = counted(model, both)
        counts = mine if counts is None else counts.unionByName(mine)
    return metrics.fold_metrics(counts, by)


# -- transfer -----------------------------------------------------------------------------

ALIGNMENTS = ("raw", "znorm", "coral", "pooled")


def require_transfer(source: str, target_domain: str, target: str, targets: Sequence[str] = ("valence", "arousal")) -> None:
    if source == target_domain or target not in targets:
        raise ValueError(f"transfer {source} to {target_domain} on {target!r} is not allowed")


def align(source: DataFrame, target: DataFrame, how: str, n_bands: int = 1, n_channels: int = 1) -> tuple[DataFrame, DataFrame]:
    """Features of both domains after a label-free alignment."""
    if how == "raw":
        return source, target
    if how == "coral":
        return features.coral_align(source, target, "features"), target
    if how == "znorm":
        both = source.withColumn("_d", F.lit("s")).unionByName(target.withColumn("_d", F.lit("t")))
        scaled = features.znorm_by_domain(both, "_d", "features")
        return scaled.where("_d = 's'").drop("_d"), scaled.where("_d = 't'").drop("_d")
    if how == "pooled":
        pooled = features.pool_channels(F.col("features"), n_bands, n_channels)
        return source.withColumn("features", pooled), target.withColumn("features", pooled)
    raise ValueError(f"unknown alignment {how!r}")


def trial_rows(windows: DataFrame, trial: str = "trial_key") -> DataFrame:
    """One row per trial: mean features, with number, subject and label of its first window."""
    means = features.trial_means(windows, [trial], "features", ["row_index", "subject_key", "target_label"])
    return means.select("row_index", "subject_key", "target_label", "features")


def run_transfer(
    source: DataFrame,
    target: DataFrame,
    classes: Sequence[str],
    hows: Sequence[str] = ALIGNMENTS,
    losses: Sequence[str] = (linear.LOGISTIC,),
    n_bands: int = 1,
    n_channels: int = 1,
) -> DataFrame:
    """Train on every source trial, test on every target trial: predictions per alignment and loss.

    Both inputs have ``row_index, subject_key, target_label, features``, with row numbers
    unique over the two; give trials (:func:`trial_rows`).  The intercept is penalised like a weight in both losses.
    Returns ``method, row_index, subject_key, y_true, y_pred``.
    """
    out = None
    for how in hows:
        left, right = align(source, target, how, n_bands, n_channels)
        both = settle(
            left.withColumn("split", F.lit("train")).unionByName(right.withColumn("split", F.lit("test"))).withColumn("fold", F.lit(1))
        )
        for loss in losses:
            predicted = linear.fit_predict(both, both.select("row_index", "features"), classes, loss, intercept_ridge=1.0)
            named = predicted.join(both.select("row_index", "subject_key"), "row_index").select(
                F.lit(f"{how}_{loss}").alias("method"), "row_index", "subject_key", "y_true", "y_pred"
            )
            out = named if out is None else out.unionByName(named)
    return out
