"""The bucketed forms equal the plain windows, also with one group holding most rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.hashing import seeded_md5
from plumbline.functions.ranking import bucketed_rank, bucketed_running_sum, hash_bucket, linear_bucket, mark_first, ranged_rank, sorted_rank
from plumbline.operators.shuffles import shuffle_segments
from plumbline.operators.windows import cut_windows, sequence_number


@pytest.fixture(scope="module")
def skewed(spark):
    """Group 'hot' holds three quarters of the rows."""
    return spark.range(4000).select(
        F.col("id").alias("row_index"), F.when(F.col("id") % 4 < 3, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g")
    ).withColumn("h", seeded_md5(1, "row_index"))


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bucketed_rank(skewed):
    ranked = bucketed_rank(skewed, ["g"], ["h", "row_index"], hash_bucket("h"), "r", 50)
    plain = skewed.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("h", "row_index")).cast("long"))
    same(ranked.select("row_index", "r"), plain.select("row_index", "r"))


def test_sorted_rank(skewed):
    keys = skewed.select(F.concat(F.lit("s"), F.col("row_index").cast("string")).alias("k"))
    plain = keys.withColumn("r", F.row_number().over(W.orderBy("k")).cast("long"))
    same(sorted_rank(keys, ["k"], "r").select("k", "r"), plain.select("k", "r"))


@pytest.mark.parametrize("rows", [50, 2000, 50_000])
def test_ranged_rank(skewed, rows):
    """Along an order that is no hash, with null groups, null values and a hot group spread over several ranges."""
    holes = skewed.withColumn("g", F.when(F.col("row_index") % 5 > 0, F.col("g"))).withColumn("v", F.when(F.col("row_index") % 3 > 0, F.col("row_index") % 11))
    plain = holes.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("v", "row_index")).cast("long"))
    same(ranged_rank(holes, ["g"], ["v", "row_index"], "r", rows).select("row_index", "r"), plain.select("row_index", "r"))


def test_ranks_compare_no_row_with_a_list_of_cuts(skewed):
    plan = ranged_rank(skewed, ["g"], ["row_index"], "r", 50)._jdf.queryExecution().toString()
    assert "filter(" not in plan.lower().replace("filter (", "") and "percentile" not in plan


def test_running_sum(skewed):
    out = bucketed_running_sum(skewed.withColumn("v", F.col("row_index") % 5), ["g"], "row_index", linear_bucket(F.col("row_index"), 4000), "v", "s", 64)
    plain = skewed.withColumn("s", F.sum(F.col("row_index") % 5).over(W.partitionBy("g").orderBy("row_index")))
    same(out.select("row_index", "s"), plain.select("row_index", "s"))


@pytest.mark.parametrize("rows", [10, 300, 50_000])
@pytest.mark.parametrize("quota", [0, 1, 37, 10_000])
def test_mark_first(skewed, rows, quota):
    marked = mark_first(skewed, ["g"], ["h", "row_index"], F.lit(quota), hash_bucket("h"), "t", piece_rows=rows).where("t")
    plain = skewed.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("h", "row_index"))).where(F.col("r") <= quota)
    same(marked.select("row_index"), plain.select("row_index"))


def test_mark_first_without_groups(skewed):
    marked = mark_first(skewed, [], ["h", "row_index"], F.ceil(F.col("_total") * 0.1), hash_bucket("h"), "t").where("t")
    same(marked.select("row_index"), skewed.orderBy("h").limit(400).select("row_index"))


@pytest.mark.parametrize("hot_rows", [100, 1_000_000])
def test_hot_recordings_are_cut_alike(skewed, hot_rows):
    """Windows and permutations do not depend on whether a group counts as hot."""
    numbered = sequence_number(skewed.drop("h"), ["g"], ["row_index"], "i", hot_rows)
    plain = skewed.withColumn("i", F.row_number().over(W.partitionBy("g").orderBy("row_index")).cast("long") - 1)
    same(numbered.select("row_index", "i"), plain.select("row_index", "i"))
    shuffled = shuffle_segments(numbered, ["g"], "i", 5, piece_rows=hot_rows)
    assert shuffled.groupBy("g").agg((F.sum("i") == F.count("*") * (F.count("*") - 1) / 2).alias("ok")).where("not ok").count() == 0
    reference = shuffle_segments(numbered, ["g"], "i", 5, piece_rows=1_000_000)
    same(shuffled.select("row_index", "i"), reference.select("row_index", "i"))


def test_windows_with_overlap(spark):
    samples = spark.range(20).select(F.lit("r").alias("rec"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    got = {r["window"]: r["samples"] for r in cut_windows(samples, "rec", "i", "v", 8, 4).collect()}
    assert got == {w: [float(4 * w + j) for j in range(8)] for w in range(4)}


@pytest.mark.parametrize("rows", [20, 50_000])
def test_null_groups_are_groups(skewed, rows):
    holes = skewed.withColumn("g", F.when(F.col("row_index") % 4 > 0, F.col("g")))
    order = W.partitionBy("g").orderBy("h", "row_index")
    plain = holes.withColumn("r", F.row_number().over(order).cast("long"))
    same(bucketed_rank(holes, ["g"], ["h", "row_index"], hash_bucket("h"), "r", rows).select("row_index", "r"), plain.select("row_index", "r"))
    taken = mark_first(holes, ["g"], ["h", "row_index"], F.lit(10), hash_bucket("h"), "t", piece_rows=rows)
    assert taken.count() == 4000
    same(taken.where("t").select("row_index"), plain.where("r <= 10").select("row_index"))
    moved = shuffle_segments(holes.withColumn("i", F.col("row_index")), ["g"], "i", 5, piece_rows=rows)
    assert moved.count() == 4000 and moved.where("g is null and i % 4 > 0").count() == 0


def test_folds_and_holdouts_keep_null_classes(spark):
    from plumbline.operators import folds, sampling

    rows = spark.range(1000).select(F.col("id").alias("row_index"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("target_label"))
    split = folds.segment_random(rows, 5, 1)
    assert split.where("fold = 1").count() == 1000 and split.where("split = 'test'").count() == 1000
    held = sampling.stratified_holdout(rows, 1, "target_label", 0.2)
    assert held.count() == 1000 and held.where("split = 'test'").count() == 200
