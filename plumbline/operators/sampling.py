"""Seeded samples with exact sizes: balanced caps, held-out subjects, matched conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import CIRCLE, circle_position, seeded_md5
from plumbline.functions.ranking import hash_bucket, linear_bucket, mark_first
from plumbline.functions.settle import settle
from plumbline.operators.folds import VAL_FRACTION, largest_remainder


def first_n(df: DataFrame, n: int, order: str = "row_index") -> DataFrame:
    """The extraction cap: the first ``n`` rows by key (a distributed top-n)."""
    return df.orderBy(order).limit(n)


def first_folds(assignments: DataFrame, n: int) -> DataFrame:
    """The fold cap: rows of the ``n`` smallest fold numbers."""
    keep = assignments.select("fold").distinct().orderBy("fold").limit(n)
    return assignments.join(keep, "fold", "left_semi")


def balanced_cap(
    rows: DataFrame,
    cap: int,
    seed: int | Column,
    label: str = "target_label",
    floor: int = 1,
    key: str = "row_index",
    by: Sequence[str] = (),
) -> DataFrame:
    """At most ``cap`` rows per group of ``by``: an equal share per class, then filled from
    the rest (or trimmed).

    Groups within the cap are kept whole.  ``floor`` is the least share of a class.  All
    groups (for example all folds) are sampled in the same passes.
    """
    columns = rows.columns
    groups = list(by) or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(1))
    sizes = settle(rows.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n")))
    shares = sizes.groupBy(*groups).agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_k")).select(
        *groups,
        F.when(F.col("_rows") <= cap, F.col("_rows"))
        .otherwise(F.greatest(F.lit(floor), F.floor(F.lit(cap) / F.col("_k"))))
        .cast("long")
        .alias("_share"),
    )
    per_class = sizes.join(shares, groups)
    have = settle(
        per_class.groupBy(*groups).agg(F.sum(F.least("n", "_share")).alias("_have"), F.sum("n").alias("_rows"))
    )
    found = have.agg(
        F.max("_rows").alias("most"),
        F.bool_or((F.col("_rows") > cap) & (F.col("_have") < cap)).alias("fill"),
        F.bool_or(F.col("_have") > cap).alias("trim"),
    ).first()
    if not found["most"] or found["most"] <= cap:
        return rows.select(*columns)
    quotas = per_class.select(*groups, label, "_share")
    hashed = rows.withColumn("_h", seeded_md5(_shifted(seed, 0), key))
    marked = mark_first(hashed, [*groups, label], ["_h", key], F.col("_share"), hash_bucket("_h"), "_taken", quotas).drop("_h")
    chosen = marked.where("_taken").drop("_taken")
    if found["trim"]:
        chosen = _top(chosen, groups, F.lit(cap), _shifted(seed, 2), key)
    if found["fill"]:
        need = have.select(*groups, F.greatest(F.lit(0), F.least(F.lit(cap), F.col("_rows")) - F.col("_have")).alias("_need"))
        rest = marked.where(~F.col("_taken")).drop("_taken")
        chosen = chosen.unionByName(_top(rest, groups, F.col("_need"), _shifted(seed, 1), key, need))
    return chosen.select(*columns)


def _shifted(seed: int | Column, by: int) -> int | Column:
    return seed + by if by else seed


def _top(
    df: DataFrame, groups: Sequence[str], n: Column, seed: int | Column, key: str, quotas: DataFrame | None = None
) -> DataFrame:
    """The first ``n`` rows of each group in seeded order."""
    hashed = df.withColumn("_h", seeded_md5(seed, key))
    marked = mark_first(hashed, groups, ["_h", key], n, hash_bucket("_h"), "_top", quotas)
    return marked.where("_top").drop("_top", "_h")


def probe_sample(rows: DataFrame, label: str, cap: int, seed: int, min_class_count: int, key: str = "row_index") -> DataFrame:
    """Drop classes below ``min_class_count``, then :func:`balanced_cap` with trimming."""
    big = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_class_count).select(label)
    return balanced_cap(rows.join(big, label, "left_semi"), cap, seed, label, min_class_count, key)


def stratified_holdout(
    rows: DataFrame, seed: int, label: str, fraction: float = VAL_FRACTION, key: str = "row_index"
) -> DataFrame:
    """Window-random stratified split ``key, label, split`` (windows of a trial may fall on both sides)."""
    base = rows.select(key, F.col(label).alias("stratum")).withColumn("_h", seeded_md5(seed, key))

    def quotas(sizes: DataFrame) -> DataFrame:
        total = F.sum("_total").over(W.partitionBy("_one"))
        wanted = sizes.withColumn("_one", F.lit(1)).withColumn("_want", total - F.ceil(total * fraction))
        return largest_remainder(wanted, ["_one"], "_total", F.col("_want"), "_train").select(
            "stratum", (F.col("_total") - F.col("_train")).alias("_test")
        )

    marked = mark_first(base, ["stratum"], ["_h", key], F.col("_test"), hash_bucket("_h"), "_in_test", quotas)
    return marked.select(
        key, F.col("stratum").alias(label), F.when(F.col("_in_test"), "test").otherwise("train").alias("split")
    )


def resplit_subjects(assignments: DataFrame, seed: int, n_val: int = 2, subject: str = "subject_key") -> DataFrame:
    """Per fold, hold out ``n_val`` whole non-test subjects of train+val: ``fold, subject, split``.

    At least one subject always stays in training.
    """
    sides = settle(
        assignments.groupBy("fold", subject).agg(F.max((F.col("split") == "test").cast("int")).alias("_test"))
    )
    pool = sides.where(F.col("_test") == 0).withColumn("_h", seeded_md5(F.lit(seed) + F.col("fold"), subject))
    quota = F.least(F.lit(max(1, n_val)), F.col("_total") - 1)
    marked = mark_first(pool, ["fold"], ["_h", subject], quota, hash_bucket("_h"), "_val")
    return marked.select("fold", subject, F.when(F.col("_val"), "val").otherwise("train").alias("split"))


def subject_holdout(rows: DataFrame, seed: int, fraction: float, subject: str = "subject_key") -> DataFrame:
    """Hold out a fraction of the subjects, at least one and never all: ``subject, split``."""
    subjects = settle(rows.select(subject).distinct()).withColumn("_h", seeded_md5(seed, subject))
    quota = F.greatest(F.lit(1), F.least(F.bround(F.col("_total") * fraction), F.col("_total") - 1))
    marked = mark_first(subjects, [], ["_h", subject], quota, hash_bucket("_h"), "_val")
    return marked.select(subject, F.when(F.col("_val"), "val").otherwise("train").alias("split"))


# -- matched conditions -----------------------------------------------------------------


def matching_quotas(counts: DataFrame, label: str = "target_label", n: str = "_total", n_conditions: int = 2) -> DataFrame:
    """Per fold, split and class, the smaller of the two conditions' counts (0 if absent in one).

    ``counts`` has one row per (condition, fold, split, class).
    """
    both = F.count(F.lit(1)) == n_conditions
    return counts.groupBy("fold", "split", label).agg(
        F.when(both, F.min(n)).otherwise(F.lit(0)).cast("long").alias("quota")
    )


def with_sample_hash(rows: DataFrame, seed: int, key: str = "row_index") -> DataFrame:
    """One digest per row, for :func:`match_conditions`; add it before joining folds."""
    return rows.withColumn("sample_hash", F.substring(seeded_md5(seed, key), 1, 8))


def match_conditions(
    assignments: DataFrame, seed: int, label: str = "target_label", condition: str = "protocol", key: str = "row_index"
) -> DataFrame:
    """Subsample train and val of every condition to equal class counts; test rows stay.

    ``assignments`` may carry ``sample_hash`` (see :func:`with_sample_hash`), computed per
    row before rows were spread over folds; otherwise it is computed here.
    """
    if "sample_hash" not in assignments.columns:
        assignments = with_sample_hash(assignments, seed, key)
    fit = assignments.where(F.col("split") != "test").withColumn("_h", circle_position(F.col("sample_hash"), F.col("fold")))

    def quotas(sizes: DataFrame) -> DataFrame:
        keys = sizes.select(condition, "fold", "split", label)
        return keys.join(matching_quotas(sizes, label), ["fold", "split", label])

    groups = [condition, "fold", "split", label]
    bucket = linear_bucket(F.col("_h"), CIRCLE)
    kept = mark_first(fit, groups, ["_h", key], F.col("quota"), bucket, "_kept", quotas)
    kept = kept.where("_kept").drop("_kept", "_h")
    return kept.unionByName(assignments.where(F.col("split") == "test")).drop("sample_hash")


def class_histograms(counts: DataFrame, groups: Sequence[str], label: str = "target_label", n: str = "_total") -> DataFrame:
    """Rows and class histogram (JSON, classes in order) per group, from class counts."""
    entries = F.array_sort(F.collect_list(F.struct(label, n)))
    return counts.groupBy(*groups).agg(
        F.sum(n).alias("rows"), F.to_json(F.map_from_entries(entries)).alias("classes")
    )


def condition_ratios(composition: DataFrame, held: str, seen: str, label: str = "target_label") -> DataFrame:
    """Per fold: training rows of both conditions, their ratio, matched rows, and the
    largest difference in class shares.  Input: one row per (protocol, fold, class)."""
    def rows_of(c: str) -> Column:
        return F.sum(F.when(F.col("protocol") == c, F.col("train")).otherwise(0))

    per_class = composition.groupBy("fold", label).agg(rows_of(seen).alias("seen"), rows_of(held).alias("held"))
    fold = W.partitionBy("fold")
    shares = per_class.withColumn(
        "_gap",
        F.abs(
            F.try_divide("seen", F.sum("seen").over(fold)) - F.try_divide("held", F.sum("held").over(fold))
        ),
    )
    return shares.groupBy("fold").agg(
        F.sum("seen").alias("train_seen"),
        F.sum("held").alias("train_heldout"),
        F.try_divide(F.sum("held"), F.sum("seen")).alias("ratio_heldout_to_seen"),
        F.sum(F.least("seen", "held")).alias("train_matched"),
        F.max("_gap").alias("class_share_diff"),
    )
