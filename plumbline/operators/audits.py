"""Split audits: each returns violating rows or per-fold violation counts; none is good."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import settle


class AuditError(AssertionError):
    """A split or a join breaks its contract."""


def require_empty(violations: DataFrame, what: str, examples: int = 3) -> None:
    """Raise with a few examples if there is any violating row."""
    found = violations.limit(examples).collect()
    if found:
        raise AuditError(f"{what}: {[r.asDict() for r in found]}")


def row_audit(assignments: DataFrame, n_rows: Column | None = None, key: str = "row_index") -> DataFrame:
    """Per fold: rows, rows assigned more than once, and rows not assigned.

    ``n_rows`` is the expected number of rows, for protocols that place every row.
    """
    copies = assignments.groupBy("fold", key).agg(F.count(F.lit(1)).alias("_copies"))
    per_fold = copies.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_copies") > 1).alias("n_repeated")
    )
    if n_rows is None:
        return per_fold.withColumn("n_missing", F.lit(0).cast("long"))
    return per_fold.withColumn("n_missing", n_rows - F.col("n_rows"))


#: Role bits: an entity with both is on both sides of a fold.
FIT_BIT, TEST_BIT = 1, 2


def role_audit(assignments: DataFrame, entities: Sequence[str], key: str = "row_index", by: Sequence[str] = ("fold",)) -> DataFrame:
    """Repeated rows and leaked entities of every fold from one scan: ``by, kind, value, n, bits``.

    One aggregation over grouping sets (row, each entity) counts and or-s the role bits; ``kind`` is
    the column that breaks its rule: ``key`` more than once, an entity with both bits.
    """
    columns = [key, *(e for e in entities if e != key)]
    bit = F.when(F.col("split") == "test", TEST_BIT).otherwise(FIT_BIT)
    sets = [[*(F.col(b) for b in by), F.col(c)] for c in columns]
    kind = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns])
    grouped = assignments.select(*by, *columns, bit.alias("_bit")).groupingSets(sets, *(F.col(c) for c in (*by, *columns)))
    found = grouped.agg(kind.alias("kind"), value.alias("value"), F.count(F.lit(1)).alias("n"), F.bit_or("_bit").alias("bits"))
    broken = F.when(F.col("kind") == key, F.col("n") > 1).otherwise(F.col("bits") == FIT_BIT + TEST_BIT)
    return found.where(broken).select(*by, "kind", "value", "n", "bits")


def sides(assignments: DataFrame, entity: str, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Per fold and entity, whether it occurs in training/validation and in test."""
    test = F.col("split") == "test"
    return assignments.groupBy(*by, entity).agg(F.bool_or(~test).alias("in_fit"), F.bool_or(test).alias("in_test"))


def leaks(assignments: DataFrame, entity: str, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Entities on both sides of a fold."""
    return sides(assignments, entity, by).where(F.col("in_fit") & F.col("in_test")).select(*by, entity)


def uncovered(assignments: DataFrame, entity: str, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Test entities that never occur in training or validation."""
    return sides(assignments, entity, by).where(~F.col("in_fit") & F.col("in_test")).select(*by, entity)


def leak_counts(assignments: DataFrame, entities: list[str], by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Per fold, the number of leaked entities of each kind, from one pre-aggregation."""
    test = F.col("split") == "test"
    small = assignments.groupBy(*by, *entities).agg(F.bool_or(~test).alias("in_fit"), F.bool_or(test).alias("in_test"))
    kinds = F.explode(
        F.array(*[F.struct(F.lit(e).alias("kind"), F.col(e).cast("string").alias("entity")) for e in entities])
    )
    long = small.select(*by, "in_fit", "in_test", kinds.alias("_k")).select(*by, "in_fit", "in_test", "_k.*")
    both = long.groupBy(*by, "kind", "entity").agg(F.bool_or("in_fit").alias("f"), F.bool_or("in_test").alias("t"))
    return both.groupBy(*by).agg(
        *[F.count_if((F.col("kind") == e) & F.col("f") & F.col("t")).alias(f"leaked_{e}") for e in entities]
    )


def test_set_differences(assignments: DataFrame, condition: str = "protocol", key: str = "row_index", n: int = 2) -> DataFrame:
    """Test rows that do not occur in every condition of a fold."""
    tests = assignments.where(F.col("split") == "test").select(condition, "fold", key).distinct()
    return tests.groupBy("fold", key).agg(F.count(F.lit(1)).alias("n_conditions")).where(F.col("n_conditions") != n)


def unmatched_classes(assignments: DataFrame, label: str = "target_label", condition: str = "protocol") -> DataFrame:
    """Classes whose training or validation counts differ between conditions."""
    counts = (
        assignments.where(F.col("split") != "test")
        .groupBy(condition, "fold", "split", label)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        counts.groupBy("fold", "split", label)
        .agg(F.min("_n").alias("low"), F.max("_n").alias("high"), F.count(F.lit(1)).alias("n_conditions"))
        .where((F.col("low") != F.col("high")) | (F.col("n_conditions") != 2))
    )


def split_summary(assignments: DataFrame, by: list[str]) -> DataFrame:
    """Rows and distinct subjects, trials and classes per split.

    Rows collapse to (subject, trial, class) first, so the distinct counts run on entities.
    """
    small = assignments.groupBy(*by, "subject_key", "trial_key", "target_label").agg(F.count(F.lit(1)).alias("_n"))
    return small.groupBy(*by).agg(
        F.sum("_n").alias("chunks"),
        F.count_distinct("subject_key").alias("subjects"),
        F.count_distinct("trial_key").alias("trials"),
        F.count_distinct("target_label").alias("classes"),
    )


def rule_summary(rows: DataFrame, rules: DataFrame, by: Sequence[str], group: str = "trial_key") -> DataFrame:
    """:func:`split_summary` by ``by, fold, split`` of rows that take their roles from ``rules`` (``group, fold, split``, one role of a group in a fold).

    Rows collapse to entities before they meet the folds, and each kind of entity is counted alone, so that
    no aggregation holds entities x folds x kinds.
    """
    small = settle(rows.groupBy(*by, "subject_key", group, "target_label").agg(F.count(F.lit(1)).alias("_n")))
    roles = settle(rules.select(group, "fold", "split"))
    cell = [*by, "fold", "split"]

    def placed(*entity: str) -> DataFrame:
        return small.groupBy(*by, group, *entity).agg(F.sum("_n").alias("_n")).join(roles, group)

    classes = placed("target_label").groupBy(*cell, "target_label").agg(F.sum("_n").alias("_n"))
    subjects = placed("subject_key").select(*cell, "subject_key").distinct()
    counted = [
        classes.groupBy(*cell).agg(F.sum("_n").alias("chunks"), F.count("target_label").alias("classes")),
        subjects.groupBy(*cell).agg(F.count("subject_key").alias("subjects")),
        placed().groupBy(*cell).agg(F.count(group).alias("trials")),
    ]
    names = ["chunks", "subjects", "trials", "classes"]
    parts = counted[0].unionByName(counted[1], allowMissingColumns=True).unionByName(counted[2], allowMissingColumns=True)
    return parts.groupBy(*cell).agg(*(F.sum(c).alias(c) for c in names))


def composed_summary(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`split_summary` from entity counts per role: ``by, kind, value, test, val, train``.

    ``kind`` is ``row`` (one value per class), ``trial`` or ``subject``; see ``folds.entity_counts``.
    """
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("split"), F.col(r).alias("n")) for r in ("train", "val", "test")])).alias("_r")
    long = counts.select(*by, "kind", "value", roles).select(*by, "kind", "value", "_r.*").where("n > 0")
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).cast("long")
    return long.groupBy(*by, "split").agg(
        total("row").alias("chunks"),
        total("subject").alias("subjects"),
        total("trial").alias("trials"),
        F.count_if(F.col("kind") == "row").alias("classes"),
    )


def composed_support(summary: DataFrame, n_classes: int) -> DataFrame:
    """:func:`support_report` from a :func:`composed_summary` by fold."""
    of = lambda split, column: F.sum(F.when(F.col("split") == split, F.col(column)).otherwise(0))
    per_fold = summary.groupBy("fold").agg(
        of("test", "chunks").alias("test_rows"), of("train", "chunks").alias("train_rows"), of("test", "trials").alias("test_trials"), of("test", "classes").alias("test_classes")
    )
    return _support(per_fold, n_classes)


def test_support(assignments: DataFrame, classes: list[str], by: str = "fold") -> DataFrame:
    """Test rows by fold and class, zero where a class is absent."""
    test = assignments.where(F.col("split") == "test")
    return test.groupBy(by).pivot("target_label", classes).agg(F.count(F.lit(1))).fillna(0, classes)


def support_report(assignments: DataFrame, n_classes: int) -> DataFrame:
    """One row: folds missing a class, smallest test fold in rows and trials, mean training rows."""
    is_test, is_train = F.col("split") == "test", F.col("split") == "train"
    small = assignments.groupBy("fold", "trial_key", "target_label").agg(
        F.count_if(is_test).alias("_test"), F.count_if(is_train).alias("_train")
    )
    per_fold = small.groupBy("fold").agg(
        F.sum("_test").alias("test_rows"),
        F.sum("_train").alias("train_rows"),
        F.count_distinct(F.when(F.col("_test") > 0, F.col("trial_key"))).alias("test_trials"),
        F.count_distinct(F.when(F.col("_test") > 0, F.col("target_label"))).alias("test_classes"),
    )
    return _support(per_fold, n_classes)


def _support(per_fold: DataFrame, n_classes: int) -> DataFrame:
    return per_fold.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.count_if(F.col("test_classes") < n_classes).alias("folds_missing_class"),
        F.min("test_rows").alias("min_test_rows"),
        F.min("test_trials").alias("min_test_trials"),
        F.avg("train_rows").alias("mean_train_rows"),
    )


def keyed_join(left: DataFrame, right: DataFrame, key: str = "row_index") -> DataFrame:
    """Exact one-to-one join by key; :func:`keyed_join_audit` says when it is not."""
    return left.join(right, key)


def _ends(label: str | None, out: str) -> list[Column]:
    """Lowest and highest label of a key, so that repeated keys cannot decide by their order."""
    return [F.min(label).alias(out), F.max(label).alias(f"{out}_top")] if label else [F.lit(None).alias(out), F.lit(None).alias(f"{out}_top")]


def keyed_join_audit(left: DataFrame, right: DataFrame, key: str = "row_index", label_pair: tuple[str, str] | None = None) -> DataFrame:
    """One row: duplicates on each side, keys missing on each side, label ids that disagree."""
    a, b = label_pair or (None, None)
    lhs = left.groupBy(key).agg(F.count(F.lit(1)).alias("_nl"), *_ends(a, "_a"))
    rhs = right.groupBy(key).agg(F.count(F.lit(1)).alias("_nr"), *_ends(b, "_b"))
    both = lhs.join(rhs, key, "full_outer")
    present = F.col("_nl").isNotNull() & F.col("_nr").isNotNull()
    return both.agg(
        F.count_if(F.col("_nl") > 1).alias("n_duplicate_left"),
        F.count_if(F.col("_nr") > 1).alias("n_duplicate_right"),
        F.count_if(F.col("_nl").isNull()).alias("n_missing_left"),
        F.count_if(F.col("_nr").isNull()).alias("n_missing_right"),
        F.count_if(present & ~(F.col("_a").eqNullSafe(F.col("_b")) & F.col("_a_top").eqNullSafe(F.col("_b_top")))).alias("n_label_mismatch"),
        F.count_if(present).alias("n_joined"),
    )
