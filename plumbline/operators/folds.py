"""Split protocols as rules.

A split is a function (fold, entity) -> role.  The functions here return small rule
tables at entity grain, or closed-form role expressions; rows x folds is only produced
by joining rows to rules (:func:`assign_rows`).

Seeded choices use a circle: entities are put in a seeded random order once, and the
validation part of a fold is an arc of that circle.  A role is then arithmetic on two
positions, so one leave-one-out design over S subjects is described by S rows, and
counts per fold follow from running totals instead of S x S comparisons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_md5
from plumbline.functions.ranking import (
    bucketed_rank,
    bucketed_running_sum,
    hash_bucket,
    linear_bucket,
    mark_first,
    match,
    sorted_rank,
)
from plumbline.functions.settle import settle

VAL_FRACTION = 0.2
ALIASES = {"loso": "leave_one_subject_out", "strict_loso": "leave_one_subject_out", "trial_within_subject": "trial_grouped"}


def protocol_name(name: str) -> str:
    """Resolve the historical protocol names."""
    return ALIASES.get(name, name)


# -- row-level stratified folds ---------------------------------------------------------


def largest_remainder(counts: DataFrame, groups: Sequence[str], n: str, wanted: Column, out: str) -> DataFrame:
    """Split ``wanted`` (per group) over the rows of ``counts`` in proportion to ``n``.

    ``counts`` is a small table (groups x classes).  Fractions are rounded down and the
    remainder goes to the largest fractions, ties to the first label.
    """
    group = W.partitionBy(*groups)
    share = F.col(n) * wanted / F.sum(n).over(group)
    floor = F.floor(share)
    left = wanted - F.sum(F.col("_floor")).over(group)
    order = F.row_number().over(group.orderBy(F.desc("_fraction"), "stratum"))
    return (
        counts.withColumn("_floor", floor)
        .withColumn("_fraction", share - floor)
        .withColumn(out, (F.col("_floor") + F.when(order <= left, 1).otherwise(0)).cast("long"))
        .drop("_floor", "_fraction")
    )


def segment_random(
    rows: DataFrame, k: int, seed: int, label: str = "target_label", carry: Sequence[str] = (), piece_rows: int | None = None
) -> DataFrame:
    """Stratified k-fold over rows with a stratified validation part: ``row_index, fold, split`` and the columns ``carry``.

    Falls back to unstratified folds if there is one class or a class smaller than ``k``.
    Inside a class rows are ranked once in a seeded order; test fold and validation arc
    are arithmetic on that rank.
    """
    kept = [c for c in carry if c != "row_index"]
    base = rows.select("row_index", F.col(label).alias("_label"), *kept)
    sizes = settle(base.groupBy("_label").agg(F.count(F.lit(1)).alias("n")))
    found = sizes.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    stratified = found["classes"] > 1 and found["least"] >= k
    stratify = F.lit(stratified)
    most = found["most"] if stratified else found["rows"]
    hashed = base.withColumn("_ok", stratify).select(
        "row_index",
        F.when(F.col("_ok"), F.col("_label")).otherwise(F.lit("")).alias("stratum"),
        seeded_md5(seed, "row_index").alias("_h"),
        *kept,
    )
    ranked = bucketed_rank(hashed, ["stratum"], ["_h", "row_index"], hash_bucket("_h"), "_rank", piece_rows, most).select(
        "row_index", "stratum", (F.col("_rank") - 1).alias("r"), *kept
    )
    per_fold = (
        sizes.withColumn("_ok", stratify)
        .groupBy(F.when(F.col("_ok"), F.col("_label")).otherwise(F.lit("")).alias("stratum"))
        .agg(F.sum("n").alias("n"))
        .select("stratum", "n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
        .withColumn("pool", F.col("n") - F.floor((F.col("n") + k - F.col("fold")) / k))
        .withColumn("_pool_all", F.sum("pool").over(W.partitionBy("fold")))
        .withColumn("_train_all", F.col("_pool_all") - F.ceil(F.col("_pool_all") * VAL_FRACTION))
    )
    quotas = largest_remainder(per_fold, ["fold"], "pool", F.col("_train_all"), "_train").select(
        "stratum", "fold", "pool", (F.col("pool") - F.col("_train")).alias("n_val")
    )
    in_pool = F.col("r") - F.floor((F.col("r") + k - F.col("fold")) / k)
    start = F.floor(F.col("pool") * (F.col("fold") - 1) / k)
    split = (
        F.when(F.pmod("r", F.lit(k)) == F.col("fold") - 1, "test")
        .when(F.pmod(in_pool - start, F.col("pool")) < F.col("n_val"), "val")
        .otherwise("train")
    )
    return match(ranked, quotas, ["stratum"]).select("row_index", "fold", split.alias("split"), *kept)


# -- groups to k folds ------------------------------------------------------------------


def trial_grouped_rules(rows: DataFrame, k: int, seed: int, group: str = "trial_key") -> DataFrame:
    """Whole groups to ``k`` size-balanced folds: ``group, fold, split``.

    Groups are dealt out in snake order from the largest to the smallest.  With fewer
    groups than ``k`` there is one fold with a seeded 20 % of the groups as test.  A
    seeded 20 % of the remaining groups of each fold validate.
    """
    sizes = settle(
        rows.groupBy(group)
        .agg(F.count(F.lit(1)).alias("size"))
        .select(group, (-F.col("size")).alias("_small_first"))
    )
    n_groups = sizes.count()
    if n_groups < k:
        n_folds = 1
        seeded = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(seeded_md5(seed, group), group))
        dealt = sizes.withColumn("_test_fold", (seeded <= F.ceil(F.lit(n_groups * VAL_FRACTION))).cast("int"))
    else:
        n_folds = k
        order = ["_small_first", group]
        ranked = sorted_rank(sizes, order, "_rank", n_groups)
        place = F.pmod(F.col("_rank") - 1, F.lit(k))
        back = F.pmod(F.floor((F.col("_rank") - 1) / k), F.lit(2)) == 1
        dealt = ranked.withColumn("_test_fold", F.when(back, k - place).otherwise(place + 1).cast("int"))
    spread = settle(dealt.select(group, "_test_fold")).withColumn(
        "fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds)))
    )
    pool = spread.where(F.col("_test_fold") != F.col("fold")).withColumn(
        "_h", seeded_md5(F.lit(seed) + F.col("fold"), group)
    )
    # A pool of a single group is not split.
    quota = F.when(F.col("_total") > 1, F.ceil(F.col("_total") * VAL_FRACTION)).otherwise(F.lit(0))
    carved = mark_first(pool, ["fold"], ["_h", group], quota, hash_bucket("_h"), "_val").select(
        group, "fold", F.when(F.col("_val"), "val").otherwise("train").alias("split")
    )
    test = spread.where(F.col("_test_fold") == F.col("fold")).select(group, "fold", F.lit("test").alias("split"))
    return carved.unionByName(test)


# -- leave one subject out --------------------------------------------------------------


def subject_circle(rows: DataFrame, seed: int, subject: str = "subject_key") -> DataFrame:
    """One row per subject: ``subject, fold`` (rank of the key), ``pos`` (0-based seeded position), ``n``."""
    subjects = settle(rows.select(subject).distinct())
    n = subjects.count()
    folds = sorted_rank(subjects, [subject], "fold", n)
    hashed = folds.withColumn("_h", seeded_md5(seed, subject))
    placed = bucketed_rank(hashed, [], ["_h", subject], hash_bucket("_h"), "_place", most=n)
    return settle(
        placed.select(subject, "fold", (F.col("_place") - 1).alias("pos"), F.lit(n).cast("long").alias("n"))
    )


def loso_val_size(n: Column | str) -> Column:
    """20 % of the other subjects, rounded up; none if only one other subject is left."""
    others = (F.col(n) if isinstance(n, str) else n) - 1
    return F.when(others > 1, F.ceil(others * VAL_FRACTION)).otherwise(F.lit(0)).cast("long")


def stimulus_val_size(n: Column | str) -> Column:
    """20 % of the other subjects, rounded half to even, at least one."""
    others = (F.col(n) if isinstance(n, str) else n) - 1
    return F.greatest(F.lit(1), F.bround(others * VAL_FRACTION)).cast("long")


def arc_role(pos: Column, test_pos: Column, n: Column, n_val: Column) -> Column:
    """Role of the subject at ``pos`` in the fold that tests ``test_pos``."""
    ahead = F.pmod(pos - test_pos, n)
    return F.when(ahead == 0, "test").when(ahead <= n_val, "val").otherwise("train")


def subject_rules(circle: DataFrame, val_size=loso_val_size, folds: Sequence[int] | None = None) -> DataFrame:
    """``subject, fold, role, test_subject`` for the named folds.

    All folds of S subjects are S x S rows; name folds, or use :func:`fold_composition`,
    which needs S rows, when there are many subjects.
    """
    subject = circle.columns[0]
    wanted = F.sequence(F.lit(1), F.col("n").cast("int")) if folds is None else F.array(*[F.lit(int(f)) for f in folds])
    tests = circle.select("fold", F.col("pos").alias("_test_pos"), F.col(subject).alias("test_subject"))
    spread = circle.select(subject, "pos", "n", F.explode(wanted).alias("fold"))
    role = arc_role(F.col("pos"), F.col("_test_pos"), F.col("n"), val_size("n"))
    spread = spread.withColumn("fold", F.col("fold").cast("long"))
    # Written first: rules grow by exploding, which only the size of the written table shows.
    return settle(spread.join(tests, "fold").select(subject, "fold", role.alias("split"), "test_subject"))


def entity_counts(rows: DataFrame, subject: str = "subject_key", trial: str = "trial_key", label: str = "target_label") -> DataFrame:
    """``subject, kind, value, n``: per subject its rows by class, its distinct trials, and itself; input of :func:`fold_composition`."""
    small = rows.groupBy(subject, trial, label).agg(F.count(F.lit(1)).alias("n"))
    by_class = small.groupBy(subject, F.lit("row").alias("kind"), F.col(label).alias("value")).agg(F.sum("n").alias("n"))
    trials = small.groupBy(subject, F.lit("trial").alias("kind"), F.lit("").alias("value")).agg(F.count_distinct(trial).alias("n"))
    own = small.select(subject).distinct().select(subject, F.lit("subject").alias("kind"), F.lit("").alias("value"), F.lit(1).cast("long").alias("n"))
    return by_class.unionByName(trials).unionByName(own)


def fold_composition(
    rows: DataFrame, circle: DataFrame, cells: Sequence[str], val_size=loso_val_size, n: str | None = None
) -> DataFrame:
    """Rows per (fold, cell) and role for every fold, without pairing subjects.

    Training counts are total minus own minus the validation arc; the arc is the
    difference of two running totals around the circle.  ``cells`` are low-cardinality
    columns such as the label; ``n`` a column of counts, where rows are counted already.
    Returns ``fold, subject, *cells, test, val, train``.
    """
    subject = circle.columns[0]
    counts = settle(rows.groupBy(subject, *cells).agg((F.sum(n) if n else F.count(F.lit(1))).alias("_n")))
    kinds = counts.select(*cells).distinct().agg(F.collect_list(F.struct(*cells))).scalar()
    grid = circle.withColumn("_kinds", kinds).select(
        subject, "fold", "pos", "n", F.explode("_kinds").alias("_c")
    ).select(subject, "fold", "pos", "n", "_c.*")
    filled = grid.join(counts, [subject, *cells], "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
    along = linear_bucket(F.col("pos"), F.col("n"))
    running = settle(bucketed_running_sum(filled, list(cells), "pos", along, "_n", "_upto", most=circle.count()))
    totals = counts.groupBy(*cells).agg(F.sum("_n").alias("_all"))
    arc_end = running.select(*cells, F.col("pos").alias("_end"), F.col("_upto").alias("_upto_end"))
    joined = (
        running.join(totals, list(cells))
        .withColumn("_n_val", val_size("n"))
        .withColumn("_end", F.pmod(F.col("pos") + F.col("_n_val"), F.col("n")))
        .join(arc_end, [*cells, "_end"])
    )
    wraps = F.col("pos") + F.col("_n_val") >= F.col("n")
    val = F.when(wraps, F.col("_all")).otherwise(0) + F.col("_upto_end") - F.col("_upto")
    return joined.withColumn("val", val.cast("long")).select(
        "fold",
        subject,
        *cells,
        F.col("_n").alias("test"),
        "val",
        (F.col("_all") - F.col("_n") - F.col("val")).alias("train"),
    )


# -- subject x stimulus holdout ---------------------------------------------------------

HELD_OUT, SEEN = "loso_stimulus_heldout", "loso_stimulus_seen"
CONDITIONS = (SEEN, HELD_OUT)


def held_group(fold: Column | str, groups: int) -> Column:
    f = F.col(fold) if isinstance(fold, str) else fold
    return F.pmod(f - 1, F.lit(groups)).cast("long")


def excluded_group(condition: Column | str, fold: Column | str, groups: int) -> Column:
    """The stimulus group left out of training: the tested one, or the one half way round."""
    g = held_group(fold, groups)
    held = (F.col(condition) if isinstance(condition, str) else condition) == HELD_OUT
    return F.when(held, g).otherwise(F.pmod(g + groups // 2, F.lit(groups))).cast("long")


def stimulus_rules(circle: DataFrame, groups: int, folds: Sequence[int] | None = None) -> DataFrame:
    """``subject, stimulus_group, fold, protocol, split`` of both conditions.

    Test: the fold's subject and stimulus group.  Training pool: the other subjects
    without the excluded group.  The validation subjects are the same in both conditions.
    """
    subject = circle.columns[0]
    rules = subject_rules(circle, stimulus_val_size, folds)
    spread = rules.select(
        "*",
        F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("protocol"),
    ).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("stimulus_group"))
    tested = F.col("stimulus_group") == held_group("fold", groups)
    excluded = F.col("stimulus_group") == excluded_group("protocol", "fold", groups)
    keep = F.when(F.col("split") == "test", tested).otherwise(~excluded)
    return settle(spread.where(keep).select(subject, "stimulus_group", "fold", "protocol", "split"))


def stimulus_composition(rows: DataFrame, circle: DataFrame, groups: int, label: str = "target_label") -> DataFrame:
    """Rows per (protocol, fold, label) and role for every fold of both conditions."""
    cells = fold_composition(rows, circle, [label, "stimulus_group"], stimulus_val_size)
    spread = cells.withColumn("protocol", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    tested = F.col("stimulus_group") == held_group("fold", groups)
    pooled = F.col("stimulus_group") != excluded_group("protocol", "fold", groups)
    return spread.groupBy("protocol", "fold", label).agg(
        F.sum(F.when(tested, F.col("test")).otherwise(0)).alias("test"),
        F.sum(F.when(pooled, F.col("val")).otherwise(0)).alias("val"),
        F.sum(F.when(pooled, F.col("train")).otherwise(0)).alias("train"),
    )


def stimulus_sides(met: DataFrame, circle: DataFrame, groups: int) -> DataFrame:
    """``protocol, fold, stimulus_key, in_fit, in_test`` of both conditions, from which subject met which stimulus (distinct pairs)."""
    cells = fold_composition(met, circle, ["stimulus_key", "stimulus_group"], stimulus_val_size)
    spread = cells.withColumn("protocol", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])))
    tested = (F.col("stimulus_group") == held_group("fold", groups)) & (F.col("test") > 0)
    pooled = (F.col("stimulus_group") != excluded_group("protocol", "fold", groups)) & (F.col("val") + F.col("train") > 0)
    return spread.groupBy("protocol", "fold", "stimulus_key").agg(F.bool_or(pooled).alias("in_fit"), F.bool_or(tested).alias("in_test"))


# -- rows -------------------------------------------------------------------------------


def assign_rows(rows: DataFrame, rules: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows x folds on request: rows joined to the rules of their entity."""
    return rows.join(rules, list(on))
