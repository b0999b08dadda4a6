"""Seeded permutations: segment order inside a trial, labels inside a fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_md5
from plumbline.functions.permute import permuted
from plumbline.functions.ranking import bucketed_rank, hash_bucket, match, ranged_rank
from plumbline.functions.settle import settle


def shuffle_segments(
    df: DataFrame, groups: list[str], segment: str, seed: int, key: str = "row_index", piece_rows: int | None = None
) -> DataFrame:
    """Permute ``segment`` among the rows of each group; all other columns stay.

    The row at place p of a seeded order receives the segment at place p of the original
    order.  Rows with null groups are permuted among themselves.
    """
    ordered = ranged_rank(df, groups, [segment, key], "_place", piece_rows).select(*groups, "_place", segment)
    hashed = df.drop(segment).withColumn("_h", seeded_md5(seed, key))
    drawn = bucketed_rank(hashed, groups, ["_h", key], hash_bucket("_h"), "_place", piece_rows).drop("_h")
    return match(drawn, ordered, [*groups, "_place"]).drop("_place")


def permute_labels(
    train: DataFrame, n_permutations: int, seed: int, label: str = "target_label", key: str = "row_index"
) -> DataFrame:
    """``n_permutations`` permutations of the training labels of each fold.

    Rows of a fold are ranked once, in a seeded order; every permutation is a keyed bijection of
    these ranks, and the classes are dealt to the permuted places in blocks of their original sizes, so the
    class histogram is unchanged by construction.
    Returns ``fold, permutation, key, label, permuted_label``.
    """
    train = settle(train.select("fold", key, label))
    sizes = settle(train.groupBy("fold", label).agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(W.partitionBy("fold").orderBy(label).rowsBetween(W.unboundedPreceding, 0))
    blocks = (
        sizes.withColumn("_upto", upto)
        .groupBy("fold")
        .agg(F.sum("_n").alias("_rows"), F.array_sort(F.collect_list(F.struct("_upto", F.col(label).alias("_name")))).alias("_blocks"))
    )
    hashed = train.withColumn("_h", seeded_md5(seed, key))
    ranked = bucketed_rank(hashed, ["fold"], ["_h", key], hash_bucket("_h"), "_place")
    # Ranking leaves whole folds in few tasks; the work per row grows with the permutations.
    spread = ranked.repartition(key).join(blocks, "fold").withColumn("permutation", F.explode(F.sequence(F.lit(0), F.lit(n_permutations - 1))))
    draw = F.concat_ws("/", F.lit(str(seed)), F.col("fold").cast("string"), F.col("permutation").cast("string"))
    placed = spread.withColumn("_at", permuted(F.col("_place") - 1, F.col("_rows"), draw))
    block = F.element_at(F.filter("_blocks", lambda b: F.col("_at") < b["_upto"]), 1)
    return placed.select("fold", "permutation", key, label, block["_name"].alias("permuted_label"))
