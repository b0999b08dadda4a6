"""Intervals and paired tests per held-out unit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.ranking import bucketed_running_sum, magnitude_bucket, match
from plumbline.functions.settle import settle
from plumbline.functions.tails import normal_two_sided, t_multiplier

# Exact tests up to 25 units, and up to 50 where no magnitudes are tied;
# no test below 5 units.
EXACT_ALWAYS, EXACT_UNTIED, LEAST_UNITS = 25, 50, 5

#: Differences are compared at this many digits: the order in which a distributed average
#: is summed must not decide whether two magnitudes are tied.
TIE_DIGITS = 12


def is_finite(c: Column | str) -> Column:
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def t_interval(units: DataFrame, by: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """``n, mean, sd, multiplier, low, high`` over finite units; bounds are null below two units."""
    out = (
        units.where(is_finite(value))
        .groupBy(*by)
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("sd"),
        )
        .withColumn("sd", F.when(F.col("n") >= 2, F.col("sd")))
        .withColumn("multiplier", F.when(F.col("n") >= 2, t_multiplier(F.col("n"), confidence)))
    )
    half = F.col("multiplier") * F.col("sd") / F.sqrt("n")
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def normal_interval(units: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The same with the fixed multiplier 1.96 (used by the label-permutation null)."""
    return (
        units.where(is_finite(value))
        .groupBy(*by)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
        .withColumn("low", F.col("mean") - 1.96 * F.col("sd") / F.sqrt("n"))
        .withColumn("high", F.col("mean") + 1.96 * F.col("sd") / F.sqrt("n"))
    )


def paired_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, a, b, diff`` over units present on both sides."""
    left = a.select(*keys, F.col(value).alias("a"))
    right = b.select(*keys, F.col(value).alias("b"))
    return left.join(right, list(keys)).withColumn("diff", F.col("a") - F.col("b"))


def unmatched_units(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units present on one side only; a strict pairing rejects them."""
    left = a.select(*keys, F.lit(1).alias("_a"))
    right = b.select(*keys, F.lit(1).alias("_b"))
    return (
        left.join(right, list(keys), "full_outer")
        .where(F.col("_a").isNull() | F.col("_b").isNull())
        .select(*keys, F.when(F.col("_a").isNull(), "b").otherwise("a").alias("only_in"))
    )


def cohens_dz(diff: str = "diff") -> Column:
    """Aggregate: mean / sd (n - 1) of differences; null below two units or without spread."""
    sd = F.stddev_samp(diff)
    return F.when((F.count(diff) >= 2) & (sd > 0), F.avg(diff) / sd)


def wilcoxon(units: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Two-sided signed-rank test per group: ``n_used, w_plus, p_wilcoxon``.

    Zeros and non-finite values are dropped and tied magnitudes share their mean rank.
    Up to 25 units, and up to 50 without ties, p comes from the exact null distribution
    of those (doubled, hence integer) ranks; above from the normal form with tie
    correction.  Magnitudes are counted before they are ranked, and ranked in buckets.
    """
    by = list(by)
    if not by:
        return wilcoxon(units.withColumn("_all", F.lit(1)), ["_all"], value).drop("_all")
    finite = units.where(is_finite(value)).select(*by, F.col(value).cast("double").alias("_raw"))
    largest = finite.groupBy(*by).agg(F.max(F.abs("_raw")).alias("_most"))
    # Ties are found at TIE_DIGITS digits of the largest magnitude, whatever the unit of the value.
    finite = match(finite, largest, by).select(*by, F.round(F.try_divide("_raw", "_most"), TIE_DIGITS).alias("_d"))
    signed = finite.where(F.col("_d") != 0).select(
        *by, F.abs("_d").alias("_size"), (F.col("_d") > 0).cast("long").alias("_up")
    )
    sizes = settle(signed.groupBy(*by, "_size").agg(F.count(F.lit(1)).alias("_n"), F.sum("_up").alias("_pos")))
    ranked = bucketed_running_sum(sizes, by, "_size", magnitude_bucket(F.col("_size")), "_n", "_upto").withColumn(
        "_rank2", 2 * F.col("_upto") - F.col("_n") + 1
    )
    totals = sizes.groupBy(*by).agg(F.sum("_n").alias("n_used"), F.max("_n").alias("_ties"))
    exact = (F.col("n_used") <= EXACT_ALWAYS) | ((F.col("n_used") <= EXACT_UNTIED) & (F.col("_ties") == 1))
    ranks = F.array_repeat(F.col("_rank2").cast("int"), F.col("_n").cast("int"))
    per_group = (
        ranked.join(totals, by)
        .withColumn("_exact", exact & (F.col("n_used") >= LEAST_UNITS))
        .groupBy(*by)
        .agg(
            F.max("n_used").alias("n_used"),
            F.max("_exact").alias("_exact"),
            F.sum(F.col("_pos") * F.col("_rank2")).alias("_w2"),
            F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).alias("_tied"),
            # At most 50 ranks: collected only for groups small enough for the exact test.
            F.flatten(F.collect_list(F.when(F.col("_exact"), ranks))).alias("_ranks"),
        )
    )
    ways = F.aggregate(
        "_ranks",
        F.array(F.lit(1.0)),
        lambda acc, r: F.zip_with(
            F.concat(acc, F.array_repeat(F.lit(0.0), r)), F.concat(F.array_repeat(F.lit(0.0), r), acc), lambda x, y: x + y
        ),
    )
    with_ways = per_group.withColumn("_ways", F.when(F.col("_exact"), ways))

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)

    below = total(F.slice("_ways", 1, F.col("_w2").cast("int") + 1))
    above = total(F.slice("_ways", F.col("_w2").cast("int") + 1, F.size("_ways")))
    p_exact = F.least(F.lit(1.0), 2 * F.least(below, above) / F.pow(F.lit(2.0), F.col("n_used")))
    n = F.col("n_used").cast("double")
    se = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_tied") / 48)
    z = (F.col("_w2") / 2 - n * (n + 1) / 4) / se
    return (
        with_ways.withColumn("_z", F.when(~F.col("_exact") & (F.col("n_used") >= LEAST_UNITS), z))
        .withColumn("_p_normal", normal_two_sided(F.col("_z")))
        .select(
            *by,
            "n_used",
            (F.col("_w2") / 2).alias("w_plus"),
            F.when(F.col("_exact"), p_exact).otherwise(F.col("_p_normal")).alias("p_wilcoxon"),
        )
    )


def with_holm(table: DataFrame, family: Sequence[str], p: str = "p_wilcoxon", key: Sequence[str] = (), out: str = "p_holm") -> DataFrame:
    """Holm step-down inside each family; rows without p stay without.

    ``table`` is a report (one row per estimate); ``key`` makes the order of equal p total.
    """
    fam = W.partitionBy(*family, F.col(p).isNotNull()) if family else W.partitionBy(F.col(p).isNotNull())
    ordered = fam.orderBy(p, *key)
    step = F.least(F.lit(1.0), (F.count(p).over(fam) - F.row_number().over(ordered) + 1) * F.col(p))
    running = F.max("_step").over(ordered.rowsBetween(W.unboundedPreceding, 0))
    return (
        table.withColumn("_step", step).withColumn(out, F.when(F.col(p).isNotNull(), running)).drop("_step")
    )
