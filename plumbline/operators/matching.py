"""Matched conditions decided on counts and a few rows, never on rows x folds.

Training and validation rows of two conditions are subsampled to equal class counts: per
(condition, fold, split, class) the rows that come first on the fold's turn of the circle of sample
positions stay (``hashing.circle_position``), as many as the smaller condition has.

Which rows a fold trains on is an interval of subjects on the subject circle, so counts per (fold, split,
class, stimulus group, piece of sample positions) follow from running totals (``folds.fold_composition``).  Where a quota is
reached is looked up in these counts: it names one piece per group, and only the rows of that piece, one
in ``pieces``, are ranked.  The result is one limit per group; a row is kept where its
turned position does not exceed the limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import CIRCLE, CIRCLE_STEP, seeded_md5
from plumbline.functions.settle import settle
from plumbline.operators.folds import CONDITIONS, arc_role, excluded_group, fold_composition, held_group, stimulus_composition, stimulus_val_size

#: Most pieces of the circle of sample positions, as a power of two.
PIECE_BITS = 12

GROUP = ["protocol", "fold", "split", "target_label"]


def fit_counts(composition: DataFrame) -> DataFrame:
    """``protocol, fold, split, target_label, _total`` (training and validation, above zero) from a composition by role."""
    sides = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("_total")) for s in ("train", "val")])
    spread = composition.select("protocol", "fold", "target_label", F.explode(sides).alias("_s"))
    return spread.select("protocol", "fold", "target_label", "_s.*").where(F.col("_total") > 0)


def sample_rows(rows: DataFrame, circle: DataFrame, seed: int, key: str = "row_index") -> DataFrame:
    """Narrow, settled rows: key, class, stimulus group, ``pos`` and ``n`` of the subject, and the sample position ``base``."""
    subject = circle.columns[0]
    base = F.conv(F.substring(seeded_md5(seed, key), 1, 8), 16, 10).cast("long")
    narrow = rows.select(subject, F.col(key).alias("row_index"), "target_label", "stimulus_group", base.alias("base"))
    return settle(narrow.join(circle.select(subject, "pos", "n"), subject))


def _turned(base: Column, fold: Column) -> Column:
    return F.pmod(base + fold * F.lit(CIRCLE_STEP), F.lit(CIRCLE))


def _conditions() -> Column:
    return F.explode(F.array(*[F.lit(c) for c in CONDITIONS]))


def matching_limits(sampled: DataFrame, circle: DataFrame, groups: int) -> DataFrame:
    """Per (protocol, fold, split, class): ``_total``, ``quota`` and, where a part is kept, the last position and key kept.

    ``sampled``: see :func:`sample_rows`.  ``groups``: number of stimulus groups.
    """
    subject = circle.columns[0]
    sizes = sampled.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("target_label").alias("classes")).first()
    cells = max(1, sizes["classes"]) * groups
    # A grid of subjects x cells x pieces costs as much as the rows of one piece, for every fold, at the square root.
    bits = min(PIECE_BITS, max(0, math.floor(math.log2(max(1.0, math.sqrt(sizes["rows"] / cells))))))
    pieces, shift = 2**bits, 32 - bits
    placed = sampled.withColumn("_piece", F.shiftright("base", shift))
    parts = fold_composition(placed, circle, ["target_label", "stimulus_group", "_piece"], stimulus_val_size)
    by_condition = parts.withColumn("protocol", _conditions()).where(F.col("stimulus_group") != excluded_group("protocol", "fold", groups))
    counts = by_condition.groupBy("protocol", "fold", "target_label", "_piece").agg(F.sum("train").alias("train"), F.sum("val").alias("val"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("_n")) for s in ("train", "val")])).alias("_s")
    counts = settle(counts.select("protocol", "fold", "target_label", "_piece", sides).select("protocol", "fold", "target_label", "_piece", "_s.*").where("_n > 0"))

    totals = counts.groupBy(*GROUP).agg(F.sum("_n").alias("_total"))
    both = totals.groupBy("fold", "split", "target_label").agg(F.when(F.count(F.lit(1)) == len(CONDITIONS), F.min("_total")).otherwise(0).alias("quota"))
    wanted = settle(totals.join(both, ["fold", "split", "target_label"]))
    partly = wanted.where((F.col("quota") > 0) & (F.col("quota") < F.col("_total")))

    # A fold starts reading the circle inside a piece; its rows before the start come last.
    start = F.pmod(-F.col("fold") * F.lit(CIRCLE_STEP), F.lit(CIRCLE))
    tests = circle.select("fold", F.col("pos").alias("_test_pos"), start.alias("_start"), F.shiftright(start, shift).alias("_first"))

    def in_group(met: DataFrame) -> DataFrame:
        """Rows met with folds, kept where they train or validate in the fold and condition."""
        role = arc_role(F.col("pos"), F.col("_test_pos"), F.col("n"), stimulus_val_size("n"))
        return met.withColumn("split", role).where((F.col("split") != "test") & (F.col("stimulus_group") != excluded_group("protocol", "fold", groups)))

    met = placed.join(tests, F.col("_piece") == F.col("_first")).withColumn("protocol", _conditions())
    heads = in_group(met).where(F.col("base") >= F.col("_start")).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_head"))
    turned = counts.join(partly, GROUP).join(tests, "fold").join(heads, GROUP, "left").withColumn("_head", F.coalesce("_head", F.lit(0)))
    here = F.when(F.col("_piece") == F.col("_first"), F.array(F.struct(F.lit(0).alias("_turn"), F.col("_head").alias("_n")), F.struct(F.lit(pieces).alias("_turn"), (F.col("_n") - F.col("_head")).alias("_n"))))
    turn = F.pmod(F.col("_piece") - F.col("_first"), F.lit(pieces)).cast("int")
    cut = F.explode(here.otherwise(F.array(F.struct(turn.alias("_turn"), F.col("_n").alias("_n"))))).alias("_c")
    along = turned.select(*GROUP, "_piece", "_test_pos", "_start", "quota", cut).select("*", "_c.*").drop("_c")
    upto = F.sum("_n").over(W.partitionBy(*GROUP).orderBy("_turn").rowsBetween(W.unboundedPreceding, 0))
    reached = along.withColumn("_upto", upto).where((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
    edges = settle(reached.select(*GROUP, "_piece", "_test_pos", "_start", "_turn", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_need")))

    edges = edges.withColumnRenamed("split", "_split")
    near = in_group(placed.join(edges, ["_piece", "target_label"])).where(F.col("split") == F.col("_split"))
    side = F.when(F.col("_turn") == 0, F.col("base") >= F.col("_start")).when(F.col("_turn") == pieces, F.col("base") < F.col("_start")).otherwise(F.lit(True))
    order = F.struct(_turned(F.col("base"), F.col("fold")).alias("at"), F.col("row_index").alias("key"))
    place = F.row_number().over(W.partitionBy(*GROUP).orderBy("_order"))
    last = near.where(side).withColumn("_order", order).withColumn("_place", place).where(F.col("_place") == F.col("_need"))
    return settle(wanted.join(last.select(*GROUP, F.col("_order").alias("last")), GROUP, "left"))


def matched_rows(sampled: DataFrame, circle: DataFrame, limits: DataFrame, groups: int) -> DataFrame:
    """``protocol, fold, split, target_label, row_index`` of both conditions after matching; test rows stay.

    The result has rows x folds; each of its rows is decided where it is made, without a shuffle.
    """
    rules = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "protocol", "split"), F.struct("_total", "quota", "last"))))
    by_class = settle(limits.groupBy("fold", "target_label").agg(rules.alias("_rules")))
    tests = circle.select("fold", F.col("pos").alias("_test_pos"))
    spread = sampled.withColumn("fold", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).join(tests, "fold").join(by_class, ["fold", "target_label"], "left")
    role = arc_role(F.col("pos"), F.col("_test_pos"), F.col("n"), stimulus_val_size("n"))
    spread = spread.withColumn("split", role).withColumn("protocol", _conditions())
    tested = F.col("stimulus_group") == held_group("fold", groups)
    pooled = F.col("stimulus_group") != excluded_group("protocol", "fold", groups)
    rule = F.element_at("_rules", F.concat_ws("/", "protocol", "split"))
    here = F.struct(_turned(F.col("base"), F.col("fold")).alias("at"), F.col("row_index").alias("key"))
    within = (rule["quota"] >= rule["_total"]) | F.coalesce(here <= rule["last"], F.lit(False))
    return spread.where(F.when(F.col("split") == "test", tested).otherwise(pooled & within)).select("protocol", "fold", "split", "target_label", "row_index")


def match_rows(rows: DataFrame, circle: DataFrame, groups: int, seed: int) -> DataFrame:
    """Both conditions of every fold of ``circle``, matched: see :func:`matched_rows`."""
    sampled = sample_rows(rows, circle, seed)
    return matched_rows(sampled, circle, matching_limits(sampled, circle, groups), groups)


def match_audit(rows: DataFrame, circle: DataFrame, groups: int, seed: int) -> DataFrame:
    """One row: test rows that differ between conditions, classes whose kept counts differ, rows of the result.

    Kept counts come from the limits, test sets from distinct (subject, stimulus group) pairs.
    """
    sampled = sample_rows(rows, circle, seed)
    limits = matching_limits(sampled, circle, groups)
    found = F.when(F.col("quota") >= F.col("_total"), F.col("_total")).when(F.col("last").isNotNull(), F.col("quota")).otherwise(0)
    kept = limits.withColumn("kept", found).where("kept > 0")
    per_class = kept.groupBy("fold", "split", "target_label").agg(F.min("kept").alias("low"), F.max("kept").alias("high"), F.count(F.lit(1)).alias("k"))
    unequal = per_class.where((F.col("low") != F.col("high")) | (F.col("k") != len(CONDITIONS)))
    pairs = sampled.groupBy("pos", "stimulus_group").agg(F.count(F.lit(1)).alias("rows"))
    tests = pairs.join(circle.select("pos", "fold"), "pos").withColumn("protocol", _conditions()).where(F.col("stimulus_group") == held_group("fold", groups))
    one_sided = tests.groupBy("fold", "pos", "stimulus_group").agg(F.count(F.lit(1)).alias("k"), F.max("rows").alias("rows")).where(F.col("k") != len(CONDITIONS))
    total = kept.select(F.col("kept").alias("rows")).unionByName(tests.select("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))
    return total.select(
        "n_rows",
        one_sided.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar().alias("test_rows_differ"),
        unequal.agg(F.count(F.lit(1))).scalar().alias("classes_differ"),
    )


def matching_counts(rows: DataFrame, circle: DataFrame, groups: int) -> DataFrame:
    """Rows per (protocol, fold, split, class) before matching, from running totals of subjects."""
    return fit_counts(stimulus_composition(rows, circle, groups))
