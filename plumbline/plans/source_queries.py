"""Scans, sinks, digests and run bookkeeping.

Connector queries write what they read back to the shared checkpoint folder first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import checkpoint_dir
from plumbline.operators import labels, sampling
from plumbline.plans.bindings import ORDERS_SQL, RATING_SQL, SEED, nation_rated, rated, rating_manifest, table
from plumbline.plans.catalog import query
from plumbline.plans.split_queries import SEGMENT_SQL, segment_rows
from plumbline.sources import digests, runs, sinks, tables


def fresh_path(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def per_event(spark, sf) -> DataFrame:
    return table(spark, sf, "events")


# -- scans ------------------------------------------------------------------------------


@query(
    "manifest_csv_scan",
    f"WITH {RATING_SQL} SELECT row_index, subject_id, trial_id, clip_id, valence, arousal FROM manifest",
)
def _csv(spark, sf):
    path = fresh_path(spark, "manifest")
    columns = ["row_index", "subject_id", "trial_id", "clip_id", "valence", "arousal"]
    sinks.write_table(rating_manifest(spark, sf).select(*columns), path, "csv")
    return tables.read_manifest(spark, path)


@query(
    "multi_file_scan",
    """SELECT event_type, count(*) AS n_rows, count(value) AS n_values, count(props) AS n_props FROM (
  SELECT event_type, value, NULL AS props FROM events WHERE event_type < 'm'
  UNION ALL SELECT event_type, NULL, props FROM events WHERE event_type >= 'm') GROUP BY event_type""",
)
def _parts(spark, sf):
    root, events = fresh_path(spark, "parts"), per_event(spark, sf)
    sinks.write_table(events.where("event_type < 'm'").select("event_type", "value"), f"{root}/per_subject_a", "csv")
    sinks.write_table(events.where("event_type >= 'm'").select("event_type", "props"), f"{root}/per_subject_b", "csv")
    both = tables.read_parts(
        spark,
        [f"{root}/per_subject_a/*.csv", f"{root}/per_subject_b/*.csv"],
        ["event_type string, value double", "event_type string, props string"],
    )
    return both.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.count("props").alias("n_props")
    )


@query("column_pruned_scan", "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY o_orderstatus")
def _pruned(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))


def run_documents(spark, sf) -> DataFrame:
    """One JSON document per customer nation, written and read back."""
    path = fresh_path(spark, "runs")
    folds = nation_rated(spark, sf).groupBy("subject_id", "trial_id").agg(
        F.avg((F.col("valence") > 3).cast("double")).alias("ba"), F.count_distinct("target_label").alias("k")
    )
    n = F.col("subject_id")
    metrics = F.when(
        n % 6 != 1,
        F.array_sort(
            F.collect_list(
                F.struct(
                    (F.col("trial_id") + 1).alias("fold"),
                    F.lit(7).alias("seed"),
                    F.when((n % 8 == 3) & (F.col("trial_id") > 9), "svm").otherwise("logistic").alias("model"),
                    F.col("k").alias("n_test_classes"),
                    F.col("ba").alias("balanced_accuracy"),
                    F.when(n % 9 == 4, F.array(F.lit("high_arousal"))).otherwise(
                        F.array(F.lit("high_valence"), F.lit("low_valence"))
                    ).alias("classes"),
                )
            )
        ),
    )
    fp = F.struct(
        F.when(n % 7 == 2, "deap").otherwise("dreamer").alias("dataset"),
        F.lit("valence").alias("target"),
        F.when(n % 10 == 6, "dreamer_valence_gt3_tie_high_v1").otherwise("dreamer_valence_gt3_tie_low_v1").alias(
            "label_policy_id"
        ),
        F.lit(5).alias("epochs"),
    )
    meta = F.struct(
        F.lit("dreamer").alias("dataset"),
        F.lit("valence").alias("target"),
        F.lit("strict_loso").alias("protocol"),
        F.when(n % 2 == 0, F.array(F.lit("logistic"))).alias("models"),
        F.lit(7).alias("seed"),
        (n % 5 == 0).alias("is_smoke"),
        F.lit(18).alias("n_folds_expected"),
        F.when(n % 11 == 8, 17).otherwise(18).alias("n_folds_completed"),
        F.when(n % 13 != 12, fp).alias("run_fingerprint"),
    )
    docs = folds.groupBy("subject_id").agg(metrics.alias("fold_metrics")).select(
        F.concat(F.lit("run_"), n.cast("string"), F.when(n % 12 == 9, "_fold_checkpoints").otherwise("")).alias("name"),
        F.to_json(F.struct(meta.alias("metadata"), "fold_metrics")).alias("value"),
    )
    docs.repartition("name").write.partitionBy("name").text(path)
    return tables.read_run_documents(spark, path)


DOCS_SQL = f"""{ORDERS_SQL},
folds AS (
  SELECT subject_id AS n, trial_id, avg(CASE WHEN valence > 3 THEN 1.0 ELSE 0.0 END) AS ba, count(DISTINCT target_label) AS k FROM ordered GROUP BY ALL),
docs AS (SELECT DISTINCT n FROM folds),
rejects AS (
  SELECT n, 'checkpoint of a fold' AS reason FROM docs WHERE n % 12 = 9
  UNION ALL SELECT n, 'fold_metrics is not a non-empty list' FROM docs WHERE n % 6 = 1
  UNION ALL SELECT n, 'smoke run' FROM docs WHERE n % 5 = 0
  UNION ALL SELECT n, 'several models' FROM docs WHERE n % 8 = 3 AND n % 6 <> 1)"""


def _run_number():
    return F.regexp_extract("path", r"name=run_(\d+)", 1).cast("long").alias("run")


@query(
    "run_document_scan",
    f"""WITH {DOCS_SQL}
SELECT n AS run, CASE WHEN n % 2 = 0 THEN 'classical' ELSE 'deep' END AS kind, trial_id + 1 AS fold, 7 AS seed, k AS n_test_classes,
       round(ba, 6) AS balanced_accuracy FROM folds WHERE n NOT IN (SELECT n FROM rejects)""",
)
def _documents(spark, sf):
    docs = run_documents(spark, sf)
    kinds = tables.runs_from_documents(docs).select("path", "kind")
    rows = tables.fold_rows_from_documents(docs).join(kinds, "path")
    return rows.select(
        _run_number(), "kind", "fold", "seed", "n_test_classes", F.round("balanced_accuracy", 6).alias("balanced_accuracy")
    )


@query("run_document_rejects", f"WITH {DOCS_SQL} SELECT n AS run, reason FROM rejects")
def _rejects(spark, sf):
    return tables.run_document_rejects(run_documents(spark, sf)).select(_run_number(), "reason")


@query(
    "run_completeness_report",
    f"""WITH {DOCS_SQL},
reasons AS (
  SELECT n, concat_ws('; ', CASE WHEN n % 6 <> 1 AND n % 9 = 4 THEN 'unknown classes' END,
    CASE WHEN n % 6 = 1 OR n % 11 = 8 THEN 'missing folds' END,
    CASE WHEN n % 5 = 0 THEN 'trial run' END,
    CASE WHEN n % 13 = 12 THEN 'no fingerprint' END,
    CASE WHEN n % 13 <> 12 AND n % 7 = 2 THEN 'other data' END,
    CASE WHEN n % 13 <> 12 AND n % 10 = 6 THEN 'other policy' END) AS reasons FROM docs)
SELECT n AS run, reasons = '' AS complete, reasons FROM reasons""",
)
def _complete(spark, sf):
    report = runs.completeness_report(run_documents(spark, sf), labels.policy("dreamer", "valence"))
    return report.select(_run_number(), "complete", "reasons")


# -- features and embeddings --------------------------------------------------------------


@query(
    "feature_gather",
    """SELECT d.doc_id AS row_index, d.lang, round(list_sum(embedding), 4) AS feature_sum FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def _gather(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_index"), "lang")
    feats = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_index"), "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return tables.gather_features(rows, feats).select("row_index", "lang", F.round(total, 4).alias("feature_sum"))


@query(
    "feature_coverage_guard",
    """SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_uncovered,
       (SELECT count(*) FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) AS n_kept""",
)
def _coverage(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row_index"))
    feats = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_index"))
    kept = tables.covered_rows(rows, feats, allow_partial=True).agg(F.count(F.lit(1))).scalar()
    return tables.coverage(rows, feats).withColumn("n_kept", kept)


def encoder_folder(spark, sf) -> str:
    """Two embedding exports in folders named after their settings."""
    root = fresh_path(spark, "encoders")
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_index"),
        F.when(F.col("vec_id") % 3 == 0, "val").otherwise("train").alias("split"),
        "embedding",
        "label",
    )
    for fold, model, part in ((1, "eegnet", "label < 5"), (2, "shallow_convnet", "label >= 5")):
        name = f"dreamer_strict_loso_valence_{model}_none_fold{fold:02d}"
        sinks.write_table(vectors.where(part), f"{root}/{name}")
    sinks.write_table(vectors, f"{root}/notes_on_something_else")
    return root


@query(
    "embedding_export_scan",
    """SELECT 'dreamer' AS dataset, CASE WHEN label < 5 THEN 'eegnet' ELSE 'shallow_convnet' END AS model, 'none' AS transform,
       CASE WHEN label < 5 THEN 1 ELSE 2 END AS fold, vec_id AS row_index, label FROM embeddings WHERE vec_id % 3 = 0""",
)
def _encoders(spark, sf):
    found = tables.read_encoders(spark, encoder_folder(spark, sf))
    return found.select("dataset", "model", "transform", "fold", "row_index", "label")


# -- sinks ----------------------------------------------------------------------------------


@query("table_sink", f"WITH {RATING_SQL} SELECT target_label, count(*) AS n_rows FROM manifest GROUP BY target_label")
def _sink(spark, sf):
    path = fresh_path(spark, "table")
    sinks.write_table(rated(spark, sf), path)
    return spark.read.parquet(path).groupBy("target_label").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "predictions_sink",
    f"""WITH {SEGMENT_SQL}
SELECT 'majority' AS model, CAST(fold AS BIGINT) AS fold, target_label AS y_true, 'low_valence' AS y_pred, count(*) AS n_rows
FROM assigned JOIN manifest USING (row_index) WHERE split = 'test' GROUP BY fold, target_label""",
)
def _predictions(spark, sf):
    path = fresh_path(spark, "predictions")
    rows = segment_rows(spark, sf, *rated(spark, sf).columns).where("split = 'test'")
    sinks.write_predictions(
        rows.withColumn("model", F.lit("majority"))
        .withColumn("y_true", F.col("target_label"))
        .withColumn("y_pred", F.lit("low_valence")),
        path,
    )
    return spark.read.parquet(path).groupBy("model", F.col("fold").cast("long").alias("fold"), "y_true", "y_pred").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "summary_upsert",
    """SELECT c_custkey, c_mktsegment, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS balance
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)""",
)
def _upsert(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("balance"))
    new = (
        table(spark, sf, "supplier")
        .join(old.drop("balance"), F.col("s_suppkey") == F.col("c_custkey"), "left")
        .select(F.col("s_suppkey").alias("c_custkey"), "c_mktsegment", F.col("s_acctbal").alias("balance"))
    )
    return sinks.upsert(old, new, ["c_custkey"])


@query(
    "sampled_read_back_check",
    f"""WITH sample AS (SELECT event_id, value FROM events ORDER BY md5('{SEED}:' || event_id), event_id LIMIT 1000)
SELECT event_id AS row_index FROM sample WHERE value > 100""",
)
def _read_back(spark, sf):
    """A copy that lost one row in ten values is caught on exactly the sampled rows."""
    source = per_event(spark, sf).select(F.col("event_id").alias("row_index"), "value", "event_type")
    path = fresh_path(spark, "copy")
    damaged = source.withColumn("value", F.when(F.col("value") > 100, -1.0).otherwise(F.col("value")))
    sinks.write_table(damaged, path)
    return sinks.read_back_check(source, spark.read.parquet(path), 1000, SEED)


@query(
    "first_rows",
    "SELECT event_id AS row_index, event_type FROM events ORDER BY event_id LIMIT 500",
)
def _first(spark, sf):
    return sampling.first_n(per_event(spark, sf).select(F.col("event_id").alias("row_index"), "event_type"), 500)


# -- digests ----------------------------------------------------------------------------------


def multiset_sql(source: str, line: str, by: str = "1") -> str:
    words = ", ".join(
        f"CAST(sum(CAST('0x' || substr(h, {4 * i + 1}, 4) AS BIGINT)) AS BIGINT) AS w{i}" for i in range(16)
    )
    text = " || ':' || ".join(["n"] + [f"w{i}" for i in range(16)])
    return f"""hashed AS (SELECT {by} AS part, sha256({line}) AS h FROM {source}),
sums AS (SELECT part, count(*) AS n, {words} FROM hashed GROUP BY part),
digested AS (SELECT part, n AS n_lines, sha256({text}) AS digest FROM sums)"""


def tab_line() -> str:
    return "row_index || chr(9) || target_label"


@query(
    "label_vector_digest",
    f"WITH {RATING_SQL}, {multiset_sql('manifest', tab_line())} SELECT n_lines, digest FROM digested",
)
def _label_digest(spark, sf):
    return digests.label_digest(rated(spark, sf))


@query(
    "partition_digest",
    f"""WITH {SEGMENT_SQL}, {multiset_sql('assigned', "fold || ',' || split || ',' || row_index", 'fold')}
SELECT CAST(part AS BIGINT) AS fold, n_lines, digest FROM digested""",
)
def _partition_digest(spark, sf):
    rows = segment_rows(spark, sf).withColumn("fold", F.col("fold").cast("long"))
    return digests.partition_digest(rows, ["fold"])


@query(
    "duplicate_keys",
    "SELECT l_orderkey AS row_index, count(*) AS n_copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def _duplicates(spark, sf):
    return digests.duplicate_keys(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_index")))


@query(
    "file_digests",
    f"""WITH {RATING_SQL},
lines AS (SELECT target_label || '-' || (row_index % 4) AS part, target_label || ':' || (row_index % 4) || ':' || count(*) || chr(10) AS line
          FROM manifest GROUP BY target_label, row_index % 4)
SELECT part, CAST(strlen(line) AS BIGINT) AS length, sha256(line) AS sha256 FROM lines""",
)
def _file_digests(spark, sf):
    """Text files of one line each, so that their bytes are known."""
    path = fresh_path(spark, "digested")
    part = F.pmod("row_index", F.lit(4))
    counts = rated(spark, sf).groupBy("target_label", part.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    lines = counts.select(F.concat_ws(":", "target_label", "k", "n").alias("value"), F.concat_ws("-", "target_label", "k").alias("part"))
    lines.repartition("part").write.partitionBy("part").text(path)
    found = digests.file_digests(spark, path).where(F.col("length") > 0)
    return found.select(F.regexp_extract("path", "part=([^/]+)/", 1).alias("part"), "length", "sha256")


# -- runs --------------------------------------------------------------------------------------


def _planned(spark, sf) -> DataFrame:
    """Two models on every nation's data, with a fingerprint over settings and the label digest."""
    rows = nation_rated(spark, sf)
    digest = digests.label_digest(rows, by=["subject_id"]).select("subject_id", F.col("digest").alias("labels"))
    spread = digest.withColumn("model", F.explode(F.array(F.lit("logistic"), F.lit("svm"))))
    settings = ["model", "labels", "fold", "epochs", "cap"]
    return (
        spread.withColumn("fold", F.col("subject_id") + 1)
        .withColumn("epochs", F.lit(5))
        .withColumn("cap", F.when(F.col("fold") % 6 == 0, 100))
        .withColumn("fingerprint", runs.fingerprint(settings))
    )


PLANNED_SQL = f"""{ORDERS_SQL}, {multiset_sql('ordered', tab_line(), 'subject_id')},
planned AS (
  SELECT model, part + 1 AS fold, CASE WHEN (part + 1) % 6 = 0 THEN 100 END AS cap,
         sha256('{{"cap":' || coalesce(CAST(CASE WHEN (part + 1) % 6 = 0 THEN 100 END AS VARCHAR), 'null') || ',"epochs":5,"fold":' || (part + 1) ||
                ',"labels":"' || digest || '","model":"' || model || '"}}') AS fingerprint
  FROM digested, (VALUES ('logistic'), ('svm')) m(model))"""


@query("run_fingerprints", f"WITH {PLANNED_SQL} SELECT model, fold, fingerprint FROM planned")
def _fingerprints(spark, sf):
    return _planned(spark, sf).select("model", "fold", "fingerprint")


@query(
    "pending_folds",
    f"WITH {PLANNED_SQL} SELECT model, fold, fingerprint FROM planned WHERE NOT (model = 'logistic' AND fold % 3 <> 0)",
)
def _pending(spark, sf):
    """Done: the logistic folds not divisible by 3; results of other folds carry no or another fingerprint."""
    planned = _planned(spark, sf).select("model", "fold", "fingerprint")
    stale = F.when(F.col("fold") % 2 == 0, F.lit(None).cast("string")).otherwise(F.sha2("fingerprint", 256))
    done = planned.select(
        "fold",
        F.when((F.col("model") == "logistic") & (F.col("fold") % 3 != 0), F.col("fingerprint")).otherwise(stale).alias("fingerprint"),
    )
    return runs.pending_folds(planned, done)


@query(
    "smoke_run_flags",
    f"WITH {PLANNED_SQL} SELECT model, fold, cap IS NOT NULL AS is_smoke FROM planned",
)
def _smoke(spark, sf):
    planned = _planned(spark, sf).select("model", "fold", F.col("cap").alias("max_train_rows"))
    for cap in runs.CAPS:
        if cap not in planned.columns:
            planned = planned.withColumn(cap, F.lit(None).cast("int"))
    return planned.select("model", "fold", runs.is_smoke().alias("is_smoke"))
