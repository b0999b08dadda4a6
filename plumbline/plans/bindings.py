"""How the given tables are read as manifests of labelled windows.

``events``: a row is a window, the user is the subject, the hour is the trial (the
stimulus everybody meets), ``floor(value / 10)`` is a rating with many exact ties at 3.
``orders``: a row is a window, the customer's nation is the subject (a fixed, small
number of subjects, so rows x folds stays linear in the data).
``embeddings``: 64 numbers, read as 4 bands (or channels) of 16.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.keys import standardize, with_stimulus
from plumbline.sources.tables import spread

SEED = 20260926


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rating_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with 24 trials per subject and ratings on a scale with threshold 3."""
    rating = F.floor(F.col("value") / 10).cast("double")
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type"))
    return events.select(
        F.col("event_id").alias("row_index"),
        F.col("user_id").alias("subject_id"),
        F.hour("ts").cast("long").alias("trial_id"),
        F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("clip_id"),
        rating.alias("valence"),
        F.pmod(rating, F.lit(7)).alias("arousal"),
        "event_type",
    )


RATING_SQL = """manifest AS (
  SELECT event_id AS row_index, user_id AS subject_id, CAST(extract(hour FROM ts) AS BIGINT) AS trial_id,
         'w' || event_id AS clip_id, floor(value / 10) AS valence, floor(value / 10) % 7 AS arousal, event_type,
         printf('s%02d', user_id + 1) AS subject_key, 'session_1' AS session_key,
         printf('s%02d', user_id + 1) || '::session_1::trial_' || CAST(extract(hour FROM ts) AS BIGINT) AS trial_key,
         CASE WHEN floor(value / 10) > 3 THEN 'high_valence' ELSE 'low_valence' END AS target_label,
         'clip_' || CAST(extract(hour FROM ts) AS BIGINT) AS stimulus_key,
         CAST(extract(hour FROM ts) AS BIGINT) % 3 AS stimulus_group
  FROM events)"""


def rated(spark: SparkSession, sf_dir: str, variant: str = "primary") -> DataFrame:
    return with_stimulus(standardize(rating_manifest(spark, sf_dir), "dreamer", "valence", variant), "dreamer")


def coded_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as 3 sessions x 24 trials, each trial of one of four codes."""
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01")))
    hour = F.hour("ts").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_index"),
        F.col("user_id").alias("subject_id"),
        (F.pmod(F.floor(day / 10), F.lit(3)) + 1).cast("long").alias("session_id"),
        hour.alias("trial_id"),
        F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("clip_id"),
        F.pmod(hour, F.lit(4)).alias("emotion"),
        "value",
    )


CODED_SQL = """coded AS (
  SELECT event_id AS row_index, user_id AS subject_id,
         CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 10) AS BIGINT) % 3 + 1 AS session_id,
         CAST(extract(hour FROM ts) AS BIGINT) AS trial_id, 'w' || event_id AS clip_id,
         CAST(extract(hour FROM ts) AS BIGINT) % 4 AS emotion, value
  FROM events),
coded_keys AS (
  SELECT *, printf('s%02d', subject_id) AS subject_key, 'session_' || session_id AS session_key,
         printf('s%02d', subject_id) || '::session_' || session_id || '::trial_' || trial_id AS trial_key,
         CASE emotion WHEN 0 THEN 'neutral' WHEN 1 THEN 'sad' WHEN 2 THEN 'fear' ELSE 'happy' END AS target_label
  FROM coded)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stimulus(standardize(coded_manifest(spark, sf_dir), "seed_iv", "emotion"), "seed_iv")


def orders_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with the customer's nation as subject, 18 trials, ratings 1 to 5."""
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus"]
    orders = spread(table(spark, sf_dir, "orders").select(*columns))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_index"),
        F.col("c_nationkey").cast("long").alias("subject_id"),
        F.pmod("o_orderkey", F.lit(18)).alias("trial_id"),
        F.concat(F.lit("w"), F.col("o_orderkey").cast("string")).alias("clip_id"),
        (F.least(F.floor(F.col("o_totalprice") / 100000), F.lit(4)) + 1).cast("double").alias("valence"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("arousal"),
        "o_orderstatus",
    )


ORDERS_SQL = """ordered AS (
  SELECT o_orderkey AS row_index, CAST(c_nationkey AS BIGINT) AS subject_id, o_orderkey % 18 AS trial_id,
         'w' || o_orderkey AS clip_id,
         CAST(least(floor(o_totalprice / 100000), 4) + 1 AS DOUBLE) AS valence,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS arousal, o_orderstatus,
         printf('s%02d', c_nationkey + 1) AS subject_key,
         printf('s%02d', c_nationkey + 1) || '::session_1::trial_' || (o_orderkey % 18) AS trial_key,
         'clip_' || (o_orderkey % 18) AS stimulus_key, (o_orderkey % 18) % 3 AS stimulus_group,
         CASE WHEN least(floor(o_totalprice / 100000), 4) + 1 > 3 THEN 'high_valence' ELSE 'low_valence' END AS target_label
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def nation_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_stimulus(standardize(orders_manifest(spark, sf_dir), "dreamer", "valence"), "dreamer")
