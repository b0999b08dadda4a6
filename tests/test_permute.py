"""Keyed permutations are permutations, near uniform, and need one sort for any number of them."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.permute import permuted
from plumbline.operators import shuffles


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 1000, 4097])
def test_every_key_gives_a_permutation(spark, n):
    rows = spark.range(n).withColumn("k", F.explode(F.array(*[F.lit(f"key{j}") for j in range(6)]))).withColumn("n", F.lit(n).cast("long"))
    got = rows.select("k", permuted(F.col("id"), F.col("n"), F.col("k")).alias("at")).groupBy("k").agg(
        F.count_distinct("at").alias("d"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    assert {tuple(r)[1:] for r in got.collect()} == {(n, 0, n - 1)}


def test_places_are_near_uniform(spark):
    """Over 4,000 keys, every one of 12 places receives every row about equally often (chi-square with 121 degrees of freedom)."""
    rows = spark.range(12).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4000)))).withColumn("n", F.lit(12).cast("long"))
    cells = rows.select("id", permuted(F.col("id"), F.col("n"), F.col("k").cast("string")).alias("at")).groupBy("id", "at").count().collect()
    expected = 4000 / 12
    chi = sum((r["count"] - expected) ** 2 / expected for r in cells)
    assert len(cells) == 144 and chi < 200


def test_one_sort_for_any_number_of_permutations(spark):
    train = spark.range(300).select((F.col("id") % 3).alias("fold"), F.col("id").alias("row_index"), F.concat(F.lit("c"), F.col("id") % 4).alias("target_label"))
    plans = []
    for n in (1, 50):
        out = shuffles.permute_labels(train, n, 5)
        tree = out._jdf.queryExecution().optimizedPlan().toString()
        plans.append((tree.count("Window"), tree.count("Sort")))
        counts = out.groupBy("fold", "permutation", "permuted_label").count().select("fold", "permuted_label", "count").distinct()
        assert counts.count() == 12 and out.count() == 300 * n
    assert plans[0] == plans[1]
    labels = out.where("fold = 0").groupBy("permutation").agg(F.array_sort(F.collect_list(F.struct("row_index", "permuted_label"))).alias("l"))
    assert labels.select("l").distinct().count() == 50
