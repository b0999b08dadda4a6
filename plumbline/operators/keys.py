"""Entity keys: subject, session, trial, stimulus and window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.labels import PRIMARY, with_labels

# Number of stimulus groups per dataset.
STIMULUS_GROUPS = {"deap": 5, "dreamer": 3, "seed_iv": 6}


def zero_padded(number: Column) -> Column:
    """At least two digits; never truncates."""
    return F.format_string("%02d", number)


def subject_key(dataset: str) -> Column:
    sid = F.col("subject_id")
    if dataset == "deap":
        return sid.cast("string")
    if dataset == "dreamer":
        return F.concat(F.lit("s"), zero_padded(sid.cast("long") + 1))
    if dataset == "seed_iv":
        return F.concat(F.lit("s"), zero_padded(sid.cast("long")))
    raise ValueError(f"unknown dataset {dataset!r}")


def session_key(dataset: str) -> Column:
    if dataset == "seed_iv":
        return F.concat(F.lit("session_"), F.col("session_id").cast("long").cast("string"))
    return F.lit("session_1")


def with_keys(df: DataFrame, dataset: str) -> DataFrame:
    """Add ``subject_key, session_key, trial_key, chunk_id`` to a manifest with ``row_index``."""
    keyed = df.withColumn("subject_key", subject_key(dataset)).withColumn("session_key", session_key(dataset))
    trial = F.concat_ws(
        "::", "subject_key", "session_key", F.concat(F.lit("trial_"), F.col("trial_id").cast("string"))
    )
    keyed = keyed.withColumn("trial_key", trial)
    if "clip_id" not in df.columns:
        return keyed
    parts = [F.lit(dataset), F.col("subject_key"), F.col("trial_key"), F.col("clip_id"), F.col("row_index")]
    return keyed.withColumn("chunk_id", F.concat_ws("::", *[p.cast("string") for p in parts]))


def standardize(df: DataFrame, dataset: str, target: str, variant: str = PRIMARY) -> DataFrame:
    """Labels and keys in one projection: the table every split is made from."""
    return with_keys(with_labels(df, dataset, target, variant), dataset)


def with_stimulus(df: DataFrame, dataset: str, groups: int | None = None) -> DataFrame:
    """Add ``stimulus_key, stimulus_group``.

    Rated datasets take the trial number modulo the group count.  Coded datasets rank the
    distinct clips of a (session, code), so that every group holds one clip of each class;
    the clip table has one row per (session, trial, code).
    """
    trial = F.col("trial_id").cast("long")
    if dataset in ("deap", "dreamer"):
        prefix = "video_" if dataset == "deap" else "clip_"
        n = groups or STIMULUS_GROUPS[dataset]
        return df.withColumn("stimulus_key", F.concat(F.lit(prefix), trial.cast("string"))).withColumn(
            "stimulus_group", F.pmod(trial, F.lit(n))
        )
    if dataset != "seed_iv":
        raise ValueError(f"unknown dataset {dataset!r}")
    clip = ["session_id", "trial_id", "emotion"]
    order = W.partitionBy("session_id", "emotion").orderBy("trial_id")
    clips = df.select(*clip).distinct().withColumn("stimulus_group", F.row_number().over(order).cast("long") - 1)
    name = F.concat(F.lit("s"), F.col("session_id").cast("string"), F.lit("_t"), trial.cast("string"))
    return df.join(clips, clip, "left").withColumn("stimulus_key", name)


def stimulus_from_trial(trial_key: str = "trial_key", session_key: str | None = None) -> Column:
    """``trial_<n>`` from the end of a trial key, prefixed by the session where clips differ by session."""
    name = F.concat(F.lit("trial_"), F.regexp_extract(trial_key, r"trial_(\d+)$", 1))
    return name if session_key is None else F.concat_ws("::", session_key, name)


def distinct_trials(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per trial, with the values of its first window (lowest ``row_index``)."""
    first = F.min_by(F.struct(*values), "row_index").alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def trial_label_audit(df: DataFrame, keys: list[str], label: str = "target_label") -> DataFrame:
    """Trials that carry more than one label, or none."""
    return (
        df.groupBy(*keys)
        .agg(F.min(label).alias("lowest"), F.max(label).alias("highest"))
        .where(F.col("lowest").isNull() | (F.col("lowest") != F.col("highest")))
    )


def trial_labels(df: DataFrame, keys: list[str], label: str = "target_label") -> DataFrame:
    """One label per trial; a trial with several labels has ``n_labels`` above one."""
    return df.groupBy(*keys).agg(
        F.min(label).alias(label),
        F.when(F.min(label) == F.max(label), 1).otherwise(F.count_distinct(label)).cast("long").alias("n_labels"),
    )
