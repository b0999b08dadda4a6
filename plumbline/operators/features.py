"""Feature vectors: montages, pooling, trial means, normalisation and alignment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import pick, standardize, with_moments

# Channel order of the two recordings that can be aligned by name.
CHANNELS = {
    "deap": (
        "FP1", "AF3", "F7", "F3", "FC1", "FC5", "T7", "C3", "CP1", "CP5", "P7", "P3", "PZ", "PO3", "O1", "OZ",
        "O2", "PO4", "P4", "P8", "CP6", "CP2", "C4", "T8", "FC6", "FC2", "F4", "F8", "AF4", "FP2", "FZ", "CZ",
    ),
    "dreamer": ("AF3", "F7", "F3", "FC5", "T7", "P7", "O1", "O2", "P8", "T8", "FC6", "F4", "F8", "AF4"),
}
SHARED = CHANNELS["dreamer"]

# Guards of the normalisation and of the covariance alignment.
NORM_EPS, CORAL_EPS = 1e-6, 1e-5

#: Tasks in which partial sums of partitions meet first.
BRANCHES = 16


def shared_positions(dataset: str) -> list[int]:
    """Where the shared channels sit in a recording's own order."""
    return [CHANNELS[dataset].index(name) for name in SHARED]


def select_channels(signal: Column, positions: list[int]) -> Column:
    """Channels of a window, selected and reordered."""
    return pick(signal, positions)


def select_feature_channels(features: Column, n_bands: int, n_channels: int, positions: list[int]) -> Column:
    """The same for band-major feature vectors."""
    return pick(features, [b * n_channels + p for b in range(n_bands) for p in positions])


def pool_channels(features: Column, n_bands: int, n_channels: int) -> Column:
    """Per band, mean, population sd, minimum and maximum over channels (statistic-major)."""
    bands = F.array(*[F.slice(features, b * n_channels + 1, n_channels) for b in range(n_bands)])
    moments = F.transform(bands, lambda b: F.element_at(with_moments(b.cast("array<double>")), 1))
    return F.flatten(
        F.array(
            F.transform(moments, lambda m: m["mean"]),
            F.transform(moments, lambda m: m["sd"]),
            F.transform(moments, lambda m: F.array_min(m["x"])),
            F.transform(moments, lambda m: F.array_max(m["x"])),
        )
    )


def _vector(c: str) -> Column:
    return array_to_vector(F.col(c).cast("array<double>"))


def trial_means(windows: DataFrame, keys: Sequence[str], features: str, first: Sequence[str] = (), key: str = "row_index") -> DataFrame:
    """Element-wise mean vector per trial, with values of its first window.

    Vectors are summed before the shuffle; nothing is exploded or collected.
    """
    aggregates = [Summarizer.mean(_vector(features)).alias("_mean"), F.count(F.lit(1)).alias("n_windows")]
    aggregates += [F.min_by(c, key).alias(c) for c in first]
    return (
        windows.groupBy(*keys)
        .agg(*aggregates)
        .withColumn(features, vector_to_array("_mean"))
        .drop("_mean")
    )


def position_stats(rows: DataFrame, features: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n, mean, sd``: arrays of means and population sds per position."""
    summary = Summarizer.metrics("count", "mean", "variance").summary(_vector(features)).alias("_s")
    stats = rows.groupBy(*by).agg(summary).select(
        *by,
        F.col("_s.count").alias("n"),
        vector_to_array("_s.mean").alias("mean"),
        vector_to_array("_s.variance").alias("_var"),
    )
    shrink = (F.col("n") - 1) / F.col("n")
    return stats.withColumn("_k", shrink).select(
        *by, "n", "mean", F.zip_with("_var", F.array_repeat("_k", F.size("_var")), lambda v, k: F.sqrt(v * k)).alias("sd")
    )


def znorm_by_domain(rows: DataFrame, domain: str, features: str) -> DataFrame:
    """Each domain normalised by its own statistics (no labels, no shared statistics)."""
    stats = position_stats(rows, features, [domain]).select(
        domain, F.col("mean").alias("_m"), F.transform("sd", lambda s: s + F.lit(NORM_EPS)).alias("_s")
    )
    return rows.join(stats, domain).withColumn(features, standardize(F.col(features), F.col("_m"), F.col("_s"))).drop("_m", "_s")


def standardize_on_train(rows: DataFrame, features: str, is_train: Column, by: Sequence[str] = ()) -> DataFrame:
    """Standardise all rows by the training rows (population sd; a constant column keeps scale 1)."""
    stats = position_stats(rows.where(is_train), features, by).select(
        *by,
        F.col("mean").alias("_m"),
        F.transform("sd", lambda s: F.when(s > 0, s).otherwise(F.lit(1.0))).alias("_s"),
    )
    if by:
        joined = rows.join(stats, list(by))
    else:
        joined = rows.withColumn("_t", stats.agg(F.first(F.struct("_m", "_s"))).scalar()).select("*", "_t._m", "_t._s").drop("_t")
    return joined.withColumn(features, standardize(F.col(features), F.col("_m"), F.col("_s"))).drop("_m", "_s")


# -- covariance alignment -----------------------------------------------------------------


def moments(rows: DataFrame, features: str) -> DataFrame:
    """One row: ``n``, ``shift``, and sums of shifted vectors (``s``) and of their outer products (``outer``, row-major).

    Every partition adds up its rows, ``BRANCHES`` tasks add up partitions.  The shift is any
    one vector; it keeps the sums near the size of the spread.
    """
    vectors = rows.select(F.col(features).cast("array<double>").alias("x")).where("x is not null")
    some = vectors.first()
    if some is None:
        raise ValueError("a covariance needs rows")
    shift = np.asarray(some["x"])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(1 + len(shift) + len(shift) ** 2)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy()) - shift
                acc += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pd.DataFrame({"branch": [TaskContext.get().partitionId() % BRANCHES], "sums": [acc]})

    partial = vectors.mapInPandas(sums, "branch int, sums array<double>")
    for by in (["branch"], []):
        partial = partial.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    d = len(shift)
    return partial.select(
        F.element_at("sums", 1).alias("n"), F.lit(shift.tolist()).alias("shift"), F.slice("sums", 2, d).alias("s"), F.slice("sums", 2 + d, d * d).alias("outer")
    )


def covariance_table(rows: DataFrame, features: str) -> DataFrame:
    """``i, j, cov``: the sample covariance as a table (d x d rows; one row of input: zeros)."""
    cells = moments(rows, features).select("n", "s", F.size("s").alias("_d"), F.posexplode("outer").alias("_k", "_o"))
    i, j = F.floor(F.col("_k") / F.col("_d")).cast("long"), (F.col("_k") % F.col("_d")).cast("long")
    cells = cells.withColumn("i", i).withColumn("j", j)
    product = F.element_at("s", (F.col("i") + 1).cast("int")) * F.element_at("s", (F.col("j") + 1).cast("int"))
    return cells.select("i", "j", F.coalesce(F.try_divide(F.col("_o") - product / F.col("n"), F.col("n") - 1), F.lit(0.0)).alias("cov"))


def covariance(rows: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean (d) and sample covariance (d x d) on the driver, for its eigenvalues; d is the vector length."""
    found = moments(rows, features).first()
    n, s, d = found["n"], np.asarray(found["s"]), len(found["s"])
    cov = (np.asarray(found["outer"]).reshape(d, d) - np.outer(s, s) / n) / max(1.0, n - 1)
    return np.asarray(found["shift"]) + s / n, cov


def matrix_power(matrix: np.ndarray, power: float, eps: float = CORAL_EPS) -> np.ndarray:
    """Power of a symmetric d x d matrix, its eigenvalues floored at ``eps``."""
    values, vectors = np.linalg.eigh(matrix)
    return vectors @ np.diag(np.maximum(values, eps) ** power) @ vectors.T


def coral_align(source: DataFrame, target: DataFrame, features: str, eps: float = CORAL_EPS) -> DataFrame:
    """Source rows re-coloured to the target's covariance and mean; only d x d matrices leave Spark."""
    mean_s, cov_s = covariance(source, features)
    mean_t, cov_t = covariance(target, features)
    ridge = eps * np.eye(len(mean_s))
    mapping = matrix_power(cov_s + ridge, -0.5, eps) @ matrix_power(cov_t + ridge, 0.5, eps)

    @F.pandas_udf("array<double>")
    def recolour(batch: pd.Series) -> pd.Series:
        x = np.stack(batch.to_numpy()).astype(float)
        return pd.Series(list((x - mean_s) @ mapping + mean_t))

    return source.withColumn(features, recolour(F.col(features).cast("array<double>")))
