"""Rating enrichment: joining a provider's rating table to a manifest, and checking it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tolerances of the cross-check |a - b| <= ATOL + RTOL * |b|.
ATOL, RTOL = 0.011, 1e-5


def rating_keys(ratings: DataFrame, participant: str, experiment: str) -> DataFrame:
    """Derive manifest keys from a rating table: ``s01.dat`` style subjects, 0-based trials."""
    return ratings.withColumn("subject_id", F.format_string("s%02d.dat", F.col(participant).cast("long"))).withColumn(
        "trial_id", F.col(experiment).cast("long") - 1
    )


def duplicate_keys(ratings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, which would multiply manifest rows."""
    return ratings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1)


def enrich(
    manifest: DataFrame, ratings: DataFrame, keys: Sequence[str], replaced: dict[str, str], source: str
) -> DataFrame:
    """Replace rating columns by the joined table's; the old values stay as ``*_preprocessed``.

    ``replaced`` maps manifest columns to rating columns.  Rows without a rating keep null
    values (see :func:`enrichment_audit`).
    """
    right = ratings.select(*keys, *[F.col(r).alias(f"_new_{m}") for m, r in replaced.items()])
    joined = manifest.join(right, list(keys), "left")
    kept = [c for c in manifest.columns if c not in replaced]
    return joined.select(
        *kept,
        *[F.col(m).alias(f"{m}_preprocessed") for m in replaced],
        *[F.col(f"_new_{m}").alias(m) for m in replaced],
        F.lit(source).alias("rating_source"),
    )


def enrichment_audit(enriched: DataFrame, column: str) -> DataFrame:
    """One row: rows, rows without a rating."""
    return enriched.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_unmatched")
    )


def out_of_tolerance(df: DataFrame, a: str, b: str, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """Rows where two columns that should agree do not (a null on either side disagrees)."""
    close = F.abs(F.col(a) - F.col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col(b))
    return df.where(~F.coalesce(close, F.lit(False)))


def provenance(trials: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """One row over distinct trials: count, range of each rating and share above ``threshold``."""
    aggregates = [F.count(F.lit(1)).alias("n_trials")]
    for c in columns:
        aggregates += [
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.avg((F.col(c) > threshold).cast("double")).alias(f"high_{c}_fraction"),
        ]
    return trials.agg(*aggregates)
