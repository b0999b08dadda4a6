"""Reading manifests, result tables, run documents, features and embeddings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_SCHEMA = "row_index long, subject_id long, trial_id long, clip_id string, valence double, arousal double"

# How an embedding export is named.
ENCODER_NAME = (
    r"(deap|dreamer|seed_iv)_(strict_loso)_(valence|arousal|emotion)_"
    r"(eegnet|shallow_convnet|deep_convnet)_(none|time_shuffle)_fold(\d+)"
)
ENCODER_PARTS = ("dataset", "protocol", "target", "model", "transform", "fold")

FOLD_METRICS = T.ArrayType(
    T.StructType(
        [
            T.StructField("fold", T.LongType()),
            T.StructField("seed", T.LongType()),
            T.StructField("model", T.StringType()),
            T.StructField("n_test_classes", T.LongType()),
            T.StructField("balanced_accuracy", T.DoubleType()),
            T.StructField("train_balanced_accuracy", T.DoubleType()),
            T.StructField("classes", T.ArrayType(T.StringType())),
        ]
    )
)

FINGERPRINT = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("label_policy_id", T.StringType()),
        T.StructField("temporal_ablation", T.StringType()),
        T.StructField("epochs", T.LongType()),
        T.StructField("batch_size", T.LongType()),
        T.StructField("early_stopping", T.BooleanType()),
        T.StructField("class_weighting", T.StringType()),
        T.StructField("inject_class_signal_snr", T.DoubleType()),
    ]
)

RUN_DOCUMENT = T.StructType(
    [
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("dataset", T.StringType()),
                    T.StructField("target", T.StringType()),
                    T.StructField("protocol", T.StringType()),
                    T.StructField("model", T.StringType()),
                    T.StructField("models", T.ArrayType(T.StringType())),
                    T.StructField("seed", T.LongType()),
                    T.StructField("label_policy_id", T.StringType()),
                    T.StructField("label_variant", T.StringType()),
                    T.StructField("is_smoke", T.BooleanType()),
                    T.StructField("n_folds_expected", T.LongType()),
                    T.StructField("n_folds_completed", T.LongType()),
                    T.StructField("run_fingerprint", FINGERPRINT),
                ]
            ),
        ),
        T.StructField("fold_metrics", FOLD_METRICS),
        T.StructField("_unreadable", T.StringType()),
    ]
)


def spread(scan: DataFrame) -> DataFrame:
    """A narrow table about to fan out (rows to folds), dealt out evenly to as many tasks as its size asks for."""
    return scan.hint("rebalance")


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    """A manifest from CSV with a header, or from parquet.  The schema is given, not inferred."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def read_parts(spark: SparkSession, patterns: Sequence[str], schemas: Sequence[str]) -> DataFrame:
    """One table from all files of several path patterns; columns missing in some become null."""
    out = None
    for pattern, schema in zip(patterns, schemas, strict=True):
        part = spark.read.schema(schema).csv(pattern, header=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_run_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per run document: ``path, metadata, fold_metrics, _unreadable``."""
    docs = spark.read.schema(RUN_DOCUMENT).json(
        path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_unreadable", recursiveFileLookup=True
    )
    return docs.select("metadata", "fold_metrics", "_unreadable", F.col("_metadata.file_path").alias("path"))


def run_document_rejects(docs: DataFrame) -> DataFrame:
    """``path, reason`` for documents that may not enter a registry."""
    models = F.array_distinct(F.transform("fold_metrics", lambda f: F.coalesce(f["model"], F.col("metadata.model"))))
    empty = F.col("fold_metrics").isNull() | (F.size("fold_metrics") == 0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("path").rlike("_fold_checkpoints/"), "checkpoint of a fold"),
            F.when(F.col("_unreadable").isNotNull() | empty, "fold_metrics is not a non-empty list"),
            F.when(F.coalesce("metadata.is_smoke", F.lit(False)), "smoke run"),
            F.when(F.size(models) > 1, "several models"),
        )
    )
    return docs.select("path", F.explode(reasons).alias("reason"))


def runs_from_documents(docs: DataFrame) -> DataFrame:
    """One registry row per accepted document."""
    bad = run_document_rejects(docs).select("path").distinct()
    m, fp = F.col("metadata"), F.col("metadata.run_fingerprint")
    return docs.join(bad, "path", "left_anti").select(
        "path",
        F.when(m["models"].isNotNull(), "classical").otherwise("deep").alias("kind"),
        m["dataset"].alias("dataset"),
        m["target"].alias("target"),
        F.coalesce(fp["label_policy_id"], m["label_policy_id"]).alias("label_policy_id"),
        F.coalesce(m["label_variant"], F.lit("primary")).alias("label_variant"),
        m["protocol"].alias("protocol"),
        F.coalesce(F.get("fold_metrics", F.lit(0))["model"], m["model"]).alias("model"),
        F.coalesce(fp["temporal_ablation"], F.lit("none")).alias("transform"),
        fp["epochs"].alias("epochs"),
        fp["batch_size"].alias("batch_size"),
        F.coalesce(fp["early_stopping"], F.lit(False)).alias("early_stopping"),
        F.coalesce(fp["class_weighting"], F.lit("none")).alias("class_weighting"),
        F.coalesce(fp["inject_class_signal_snr"], F.lit(0.0)).alias("inject_snr"),
        m["seed"].alias("seed"),
    )


def fold_rows_from_documents(docs: DataFrame) -> DataFrame:
    """One row per fold of the accepted documents."""
    bad = run_document_rejects(docs).select("path").distinct()
    folds = docs.join(bad, "path", "left_anti").select(
        "path", F.col("metadata.seed").alias("_seed"), F.explode("fold_metrics").alias("f")
    )
    return folds.select(
        "path",
        F.coalesce("f.seed", "_seed").alias("seed"),
        "f.fold",
        "f.n_test_classes",
        "f.balanced_accuracy",
        "f.train_balanced_accuracy",
    )


def gather_features(rows: DataFrame, features: DataFrame, key: str = "row_index") -> DataFrame:
    """Features of a row set, by key."""
    return rows.join(features, key)


def coverage(rows: DataFrame, features: DataFrame, key: str = "row_index") -> DataFrame:
    """One row: rows wanted and rows without features."""
    marked = rows.select(key).join(features.select(key, F.lit(1).alias("_has")), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_has").isNull()).alias("n_uncovered"))


def covered_rows(rows: DataFrame, features: DataFrame, key: str = "row_index", allow_partial: bool = False) -> DataFrame:
    """``rows`` if all have features; with ``allow_partial`` (smoke tests only) those that have."""
    if not allow_partial:
        missing = rows.select(key).distinct().join(features.select(key), key, "left_anti").limit(3).collect()
        if missing:
            raise ValueError(f"features do not cover all rows, e.g. {[r[0] for r in missing]}")
        return rows
    return rows.join(features.select(key), key, "left_semi")


def read_encoders(spark: SparkSession, path: str, keep_split: str = "val") -> DataFrame:
    """Embedding exports: settings parsed from each file's folder name, rows of one split."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    where = F.regexp_extract(F.col("_metadata.file_path"), ENCODER_NAME, 0)
    parts = [
        F.regexp_extract(where, ENCODER_NAME, i + 1).alias(name) for i, name in enumerate(ENCODER_PARTS)
    ]
    named = rows.select("*", where.alias("encoder_id"), *parts)
    return named.where((F.col("encoder_id") != "") & (F.col("split") == keep_split)).withColumn(
        "fold", F.col("fold").cast("long")
    )
