"""Run bookkeeping: fingerprints, resumable folds, completeness, smoke flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.operators.labels import Policy

# Settings whose presence makes a run a smoke run.
CAPS = ("max_folds", "max_train_rows", "max_val_rows", "max_test_rows")


def fingerprint(settings: Sequence[str]) -> Column:
    """SHA-256 of the settings as one JSON object with sorted keys; nulls are kept as keys."""
    ordered = F.struct(*[F.col(c) for c in sorted(settings)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def pending_folds(planned: DataFrame, done: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Folds (and ``by``, such as the model) without a result under exactly the same fingerprint.

    A result without a fingerprint equals nothing and is never reused.
    """
    key = ["fingerprint", *by, "fold"]
    return planned.join(done.select(*key), key, "left_anti")


class Ledger:
    """Results of finished (fingerprint, model, fold) units in a Parquet folder that runners share.

    ``settings`` name the run (data, features, policy); a runner adds its own, so a changed
    setting has another fingerprint and nothing of it counts as done.  Results are appended
    per model, so a run that was stopped goes on with the models and folds it lacks.  Units that
    two runs have both written count once.
    """

    def __init__(self, path: str, settings: Mapping[str, object]):
        self.path, self.settings = path, dict(settings)

    def opened(self, like: DataFrame, own: Mapping[str, object]) -> OpenLedger:
        """The ledger for results with the columns of ``like`` under the settings of the runner as well."""
        clash = self.settings.keys() & own.keys()
        if clash:
            raise ValueError(f"settings that the runner gives itself: {sorted(clash)}")
        spark = like.sparkSession
        named = self.settings | dict(own)
        row = spark.range(1).select(*[F.lit(None if v is None else str(v)).cast("string").alias(c) for c, v in named.items()])
        value = row.select(fingerprint(list(named)).alias("f")).first()["f"]
        schema = like.select(F.lit(value).alias("fingerprint"), *like.columns).schema
        spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path)
        return OpenLedger(self.path, value, schema)


@dataclass(frozen=True)
class OpenLedger:
    path: str
    fingerprint: str
    schema: StructType

    def results(self, spark: SparkSession, unit: Sequence[str]) -> DataFrame:
        """Results under this fingerprint, one per ``unit``."""
        kept = spark.read.schema(self.schema).parquet(self.path).where(F.col("fingerprint") == self.fingerprint)
        return kept.dropDuplicates(list(unit)).drop("fingerprint")

    def pending(self, folds: DataFrame, models: Sequence[str]) -> DataFrame:
        """(model, fold) without a result."""
        planned = folds.select(F.lit(self.fingerprint).alias("fingerprint"), F.explode(F.array(*map(F.lit, models))).alias("model"), "fold")
        done = self.results(folds.sparkSession, ["model", "fold"]).withColumn("fingerprint", F.lit(self.fingerprint))
        return pending_folds(planned, done, ["model"]).select("model", "fold")

    def append(self, results: DataFrame) -> None:
        stamped = results.withColumn("fingerprint", F.lit(self.fingerprint))
        stamped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.mode("append").parquet(self.path)


def is_smoke(caps: Sequence[str] = CAPS) -> Column:
    return F.coalesce(*[F.col(c) for c in caps]).isNotNull()


def faults(policy: Policy) -> dict[str, Column]:
    """Name and condition of everything that keeps a run document (see ``RUN_DOCUMENT``) from counting for ``policy``."""
    run, print_ = F.col("metadata"), F.col("metadata.run_fingerprint")
    wanted = F.array(*[F.lit(c) for c in policy.classes])
    scored = F.coalesce(F.size("fold_metrics"), F.lit(0))
    other = {
        "data": ~(print_["dataset"].eqNullSafe(F.lit(policy.dataset)) & print_["target"].eqNullSafe(F.lit(policy.target))),
        "policy": ~print_["label_policy_id"].eqNullSafe(F.lit(policy.policy_id)),
    }
    return {
        "unknown classes": F.exists("fold_metrics", lambda f: F.size(F.array_except(F.coalesce(f["classes"], F.array()), wanted)) > 0),
        "missing folds": (scored < 1) | ~run["n_folds_completed"].eqNullSafe(run["n_folds_expected"]),
        "trial run": F.coalesce(run["is_smoke"], F.lit(True)),
        "no fingerprint": print_.isNull(),
        "other data": print_.isNotNull() & other["data"],
        "other policy": print_.isNotNull() & other["policy"],
    }


def incomplete_reasons(policy: Policy) -> Column:
    """Names of the faults of a run document; empty if it is complete."""
    return F.array_compact(F.array(*[F.when(found, name) for name, found in faults(policy).items()]))


def completeness_report(docs: DataFrame, policy: Policy) -> DataFrame:
    """``path, complete, reasons``."""
    reasons = incomplete_reasons(policy)
    return docs.select("path", (F.size(reasons) == 0).alias("complete"), F.array_join(reasons, "; ").alias("reasons"))
