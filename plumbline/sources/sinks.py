"""Writing tables, predictions and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_md5


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "append") -> None:
    """Keyed predictions, one folder per model and fold."""
    columns = ["row_index", "subject_key", "trial_key", "stimulus_key", "y_true", "y_pred", "model", "fold"]
    kept = [c for c in columns if c in predictions.columns]
    predictions.select(*kept).write.mode(mode).partitionBy("model", "fold").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` plus the rows of ``old`` whose key is not in ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def read_back_check(source: DataFrame, copy: DataFrame, n: int, seed: int, key: str = "row_index") -> DataFrame:
    """Rows of a seeded sample of ``n`` keys whose copy is missing or differs in any column."""
    picked = source.orderBy(seeded_md5(seed, key), key).limit(n)
    columns = [c for c in source.columns if c != key]
    other = copy.select(key, F.struct(*columns).alias("_copy"), F.lit(True).alias("_found"))
    same = F.struct(*columns).eqNullSafe(F.col("_copy"))
    return picked.join(other, key, "left").where(F.col("_found").isNull() | ~same).select(key)
