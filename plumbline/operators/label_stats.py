"""What a label rule does to ratings: threshold sweeps, boundary zones, stimulus agreement.

Input is one row per trial (see :func:`plumbline.operators.keys.distinct_trials`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Half-widths of the boundary zone, and the sweep around the threshold.
BOUNDARY_DELTAS = (0.25, 0.5, 1.0)
SWEEP_STEP, SWEEP_REACH = 0.25, 1.0


def threshold_sweep(trials: DataFrame, rating: str, nominal: float, by: Sequence[str] = ()) -> DataFrame:
    """Low and high counts for nine thresholds around ``nominal``: one pass, nine counters."""
    steps = round(2 * SWEEP_REACH / SWEEP_STEP)
    thresholds = [round(nominal - SWEEP_REACH + i * SWEEP_STEP, 2) for i in range(steps + 1)]
    x = F.col(rating)
    counted = trials.groupBy(*by).agg(
        F.count(rating).alias("n_trials"), *[F.count_if(x > t).alias(f"_{i}") for i, t in enumerate(thresholds)]
    )
    rows = [F.struct(F.lit(t).alias("threshold"), F.col(f"_{i}").alias("high_count")) for i, t in enumerate(thresholds)]
    return counted.select(*by, "n_trials", F.explode(F.array(*rows)).alias("s")).select(
        *by,
        "s.threshold",
        "n_trials",
        (F.col("n_trials") - F.col("s.high_count")).alias("low_count"),
        "s.high_count",
        (F.col("s.high_count") / F.col("n_trials")).alias("high_fraction"),
    )


def boundary_statistics(trials: DataFrame, rating: str, nominal: float, by: Sequence[str] = ()) -> DataFrame:
    """Per half-width: trials in the (inclusive) boundary zone, exact ties apart, and trials
    whose label differs between ``nominal - delta`` and ``nominal + delta``."""
    x, tau = F.col(rating), F.lit(nominal)
    counters = []
    for i, d in enumerate(BOUNDARY_DELTAS):
        zone = x.between(nominal - d, nominal + d)
        counters += [
            F.count_if(zone).alias(f"_zone{i}"),
            F.count_if((x > nominal - d) != (x > nominal + d)).alias(f"_flip{i}"),
        ]
    counted = trials.groupBy(*by).agg(
        F.count(rating).alias("n_trials"),
        F.count_distinct(rating).alias("n_unique_ratings"),
        F.avg(rating).alias("rating_mean"),
        F.stddev_samp(rating).alias("rating_std"),
        F.count_if(x > tau).alias("nominal_high_count"),
        F.count_if(x == tau).alias("at_threshold_count"),
        *counters,
    )
    rows = [
        F.struct(F.lit(d).alias("delta"), F.col(f"_zone{i}").alias("zone"), F.col(f"_flip{i}").alias("flip"))
        for i, d in enumerate(BOUNDARY_DELTAS)
    ]
    n = F.col("n_trials")
    return counted.withColumn("s", F.explode(F.array(*rows))).select(
        *by,
        "s.delta",
        "n_trials",
        "n_unique_ratings",
        "rating_mean",
        "rating_std",
        (n - F.col("nominal_high_count")).alias("nominal_low_count"),
        "nominal_high_count",
        (F.col("nominal_high_count") / n).alias("nominal_high_fraction"),
        "at_threshold_count",
        (F.col("at_threshold_count") / n).alias("at_threshold_fraction"),
        (F.col("s.zone") - F.col("at_threshold_count")).alias("boundary_excluding_ties_count"),
        F.col("s.zone").alias("boundary_count"),
        (F.col("s.zone") / n).alias("boundary_fraction"),
        F.col("s.flip").alias("shift_disagreement_count"),
        (F.col("s.flip") / n).alias("shift_disagreement_fraction"),
    )


def _entropy(n: Column, parts: Column) -> Column:
    """Bits, from a total and the sum of ``c * log2(c)`` over its parts."""
    return F.log2(n) - parts / n


def stimulus_agreement(trials: DataFrame, stimulus: str, rating: str, nominal: float, target: str) -> DataFrame:
    """Per stimulus: dominant label and its share, label entropy, mean and sd of the rating."""
    per = trials.groupBy(stimulus).agg(
        F.count(rating).alias("n_subject_trials"),
        F.count_if(F.col(rating) > nominal).alias("_high"),
        F.avg(rating).alias("rating_mean"),
        F.stddev_samp(rating).alias("rating_std"),
    )
    n, high = F.col("n_subject_trials"), F.col("_high")
    low = n - high
    bits = sum((F.when(c > 0, c * F.log2(c)).otherwise(0.0) for c in (high, low)), F.lit(0.0))
    return per.select(
        stimulus,
        "n_subject_trials",
        F.when(high >= low, f"high_{target}").otherwise(f"low_{target}").alias("dominant_label"),
        (F.greatest(high, low) / n).alias("dominant_fraction"),
        _entropy(n, bits).alias("label_entropy_bits"),
        "rating_mean",
        "rating_std",
    )


def stimulus_determinism(trials: DataFrame, stimulus: str, label: str) -> DataFrame:
    """Per stimulus: number of labels, dominant label (ties: first label) and share, entropy."""
    counts = trials.groupBy(stimulus, label).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    return counts.groupBy(stimulus).agg(
        n.alias("n_subject_trials"),
        F.count(F.lit(1)).alias("n_labels"),
        F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias("dominant_label"),
        (F.max("_n") / n).alias("dominant_fraction"),
        _entropy(n, F.sum(F.col("_n") * F.log2("_n"))).alias("label_entropy_bits"),
    )


def determinism_summary(trials: DataFrame, stimulus: str, label: str, subject: str) -> DataFrame:
    """One row: trials, subjects, stimuli, mean dominant share, share of stimuli with one label."""
    per = stimulus_determinism(trials, stimulus, label)
    subjects = trials.groupBy(subject).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1))).scalar()
    return per.agg(
        F.sum("n_subject_trials").alias("n_trials"),
        F.count(F.lit(1)).alias("n_stimulus_keys"),
        F.avg("dominant_fraction").alias("mean_stimulus_dominant_fraction"),
        F.avg((F.col("dominant_fraction") == 1.0).cast("double")).alias("fully_deterministic_stimulus_fraction"),
    ).withColumn("n_subjects", subjects)
