"""Digests of label vectors and partitions by one definition at every size, and file digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file under ``path``; a file is one value, so files are below 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def multiset_digest(df: DataFrame, line: Column, by: Sequence[str] = (), out: str = "digest") -> DataFrame:
    """Digest of a multiset of text lines that needs no order.

    Each line is hashed, the sixteen 16-bit words of the hashes are summed, and the sums
    with the line count are hashed again: a plain aggregation, combined before the
    shuffle, for any number of lines.
    """
    hashed = df.select(*by, F.sha2(line, 256).alias("_h"))
    words = [F.sum(F.conv(F.substring("_h", 4 * i + 1, 4), 16, 10).cast("long")).alias(f"_w{i}") for i in range(16)]
    summed = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("n_lines"), *words)
    text = F.concat_ws(":", F.col("n_lines").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(16)])
    return summed.select(*by, "n_lines", F.sha2(text, 256).alias(out))


def label_line(key: str, label: str) -> Column:
    return F.concat_ws("\t", F.col(key).cast("string"), F.col(label).cast("string"))


def partition_line() -> Column:
    return F.concat_ws(",", F.col("fold").cast("string"), "split", F.col("row_index").cast("string"))


def label_digest(df: DataFrame, key: str = "row_index", label: str = "target_label", by: Sequence[str] = ()) -> DataFrame:
    """Of the lines ``key TAB label``, one per key; a repeated key stops the digest with an error (:func:`duplicate_keys` lists them)."""
    per_key = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_copies"), F.min(label_line(key, label)).alias("_line"))
    repeated = F.raise_error(F.concat(F.lit("label vector repeats key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string")
    return multiset_digest(per_key, F.when(F.col("_copies") == 1, F.col("_line")).otherwise(repeated), by)


def partition_digest(assignments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return multiset_digest(assignments, partition_line(), by)


def duplicate_keys(df: DataFrame, key: str = "row_index") -> DataFrame:
    """Keys that occur more than once; a label vector must not have any."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1)
