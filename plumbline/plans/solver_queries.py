"""The estimators on two features, where SQL can follow every Newton step.

The runners are those of ``estimator_queries``; only the feature table is narrow.  The SQL
standardises the training rows of each unit, takes full Newton steps in a recursive
query, and predicts with the result, so scores and null distributions are checked by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.permute import permuted_sql
from plumbline.functions.settle import settle
from plumbline.operators import evaluation, linear, metrics, probes
from plumbline.plans.bindings import SEED, table
from plumbline.plans.catalog import query
from plumbline.plans.estimator_queries import CLASSES, FEATURE_LOSO_SQL, feature_windows, loso
from plumbline.plans.metric_queries import METRICS_SQL, rounded
from plumbline.plans.split_queries import within_class_sql

STEPS = 40

#: Score, residual and curvature of one row, by loss; the first is the ridge on the intercept.
LOSSES = {
    "logistic": (0.0, "1 / (1 + exp(y * s))", "1 / (1 + exp(y * s)) * (1 - 1 / (1 + exp(y * s)))"),
    "ridge_logistic": (1.0, "1 / (1 + exp(y * s))", "1 / (1 + exp(y * s)) * (1 - 1 / (1 + exp(y * s)))"),
    "svm": (1.0, "2 * greatest(1 - y * s, 0)", "CASE WHEN y * s < 1 THEN 2.0 ELSE 0.0 END"),
}


def fitted_sql(name: str, train: str, test: str, loss: str, stretch: str = "1") -> str:
    """CTEs ending in ``{name}(unit, row_index, score)``: test rows of ``test(unit, row_index, x1, x2)`` under the model of
    ``train(unit, y, w, x1, x2)``; ``unit`` is one column.  ``stretch``: factor of the standardised features (k equal copies of
    a feature under the penalty are one feature times sqrt(k))."""
    ridge, residual, curvature = LOSSES[loss]
    return f"""{name}_scale AS (
  SELECT unit, avg(x1) AS m1, avg(x2) AS m2, coalesce(nullif(stddev_pop(x1), 0), 1) AS s1, coalesce(nullif(stddev_pop(x2), 0), 1) AS s2 FROM {train} GROUP BY unit),
{name}_z AS (SELECT unit, y, w, {stretch} * (x1 - m1) / s1 AS z1, {stretch} * (x2 - m2) / s2 AS z2 FROM {train} JOIN {name}_scale USING (unit)),
{name}_newton AS (
  SELECT unit, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM {name}_scale
  UNION ALL
  SELECT unit, step + 1,
         a - (ga * (hbb * hcc - hbc * hbc) - hab * (gb * hcc - hbc * gc) + hac * (gb * hbc - hbb * gc)) / det,
         b - (haa * (gb * hcc - hbc * gc) - ga * (hab * hcc - hbc * hac) + hac * (hab * gc - gb * hac)) / det,
         c - (haa * (hbb * gc - gb * hbc) - hab * (hab * gc - gb * hac) + ga * (hab * hbc - hbb * hac)) / det
  FROM (
    SELECT *, haa * (hbb * hcc - hbc * hbc) - hab * (hab * hcc - hbc * hac) + hac * (hab * hbc - hbb * hac) AS det FROM (
      SELECT unit, step, a, b, c, a - sum(w * r * y * z1) AS ga, b - sum(w * r * y * z2) AS gb, {ridge} * c - sum(w * r * y) AS gc,
             1 + sum(w * k * z1 * z1) AS haa, 1 + sum(w * k * z2 * z2) AS hbb, {ridge} + sum(w * k) AS hcc,
             sum(w * k * z1 * z2) AS hab, sum(w * k * z1) AS hac, sum(w * k * z2) AS hbc
      FROM (SELECT *, {residual} AS r, {curvature} AS k FROM (
        SELECT n.*, y, w, z1, z2, a * z1 + b * z2 + c AS s FROM {name}_newton n JOIN {name}_z USING (unit) WHERE step < {STEPS}))
      GROUP BY unit, step, a, b, c))),
{name} AS (
  SELECT unit, row_index, {stretch} * (a * (x1 - m1) / s1 + b * (x2 - m2) / s2) + c AS score
  FROM {test} JOIN {name}_scale USING (unit) JOIN (SELECT * FROM {name}_newton WHERE step = {STEPS}) USING (unit))"""


def narrow_features(spark, sf):
    """Components 1 and 2 as one feature set, 3 and 4 as the other."""
    vector = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_index"), F.slice(vector, 1, 2).alias("alpha"), F.slice(vector, 3, 2).alias("spectral")
    )


def balanced_sql(name: str, source: str, first: int, label: str = "target_label") -> str:
    """Training rows of a model: y, balanced weight and two components."""
    return f"""{name}_train AS (
  SELECT unit, CASE WHEN {label} = 'low_valence' THEN 1.0 ELSE -1.0 END AS y,
         count(*) OVER (PARTITION BY unit) / (2.0 * count(*) OVER (PARTITION BY unit, {label})) AS w,
         embedding[{first}]::DOUBLE AS x1, embedding[{first + 1}]::DOUBLE AS x2
  FROM {source} JOIN embeddings ON vec_id = row_index WHERE split = 'train'),
{name}_test AS (
  SELECT unit, row_index, embedding[{first}]::DOUBLE AS x1, embedding[{first + 1}]::DOUBLE AS x2
  FROM {source} JOIN embeddings ON vec_id = row_index WHERE split = 'test')"""


LOSO_ONLY_SQL = FEATURE_LOSO_SQL[: FEATURE_LOSO_SQL.index("train AS (")] + "loso AS (SELECT fold AS unit, row_index, split, target_label FROM assigned)"
FOLD_SQL = f"""RECURSIVE {LOSO_ONLY_SQL},
{balanced_sql('lr', 'loso', 1)}, {fitted_sql('lr', 'lr_train', 'lr_test', 'logistic')},
{balanced_sql('sv', 'loso', 3)}, {fitted_sql('sv', 'sv_train', 'sv_test', 'svm')},
counts AS (
  SELECT model, unit AS fold, target_label AS y_true, CASE WHEN score > 0 THEN 'low_valence' ELSE 'high_valence' END AS y_pred, count(*) AS n
  FROM (SELECT 'alpha_logistic' AS model, * FROM lr UNION ALL SELECT 'spectral_svm', * FROM sv) JOIN rows USING (row_index) GROUP BY ALL),
{METRICS_SQL.format(by='model, fold')}"""


@query(
    "two_feature_fold_baselines",
    f"WITH {FOLD_SQL} SELECT model, fold, n_test, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1 FROM scores",
)
def _folds(spark, sf):
    models = ["alpha_logistic", "spectral_svm"]
    scored = evaluation.run_baselines(loso(spark, sf), narrow_features(spark, sf), models, CLASSES, "leave_one_subject_out", SEED)
    return rounded(scored.select("model", "fold", "n_test", "accuracy", "balanced_accuracy", "macro_f1"))


NULL_SQL = f"""RECURSIVE {LOSO_ONLY_SQL},
spread AS (SELECT unit AS fold, row_index, split, target_label, p FROM loso, range(2) t(p)),
turned AS (
  SELECT *, '{SEED}/' || fold || '/' || p AS perm_key, count(*) OVER (PARTITION BY fold, p) AS n,
         row_number() OVER (PARTITION BY fold, p ORDER BY md5('{SEED}:' || row_index), row_index) - 1 AS place,
         count(*) FILTER (target_label = 'high_valence') OVER (PARTITION BY fold, p) AS n_high FROM spread WHERE split = 'train'),
{permuted_sql('turned', 'placed')},
dealt AS (
  SELECT fold * 10 + p AS unit, row_index, split, CASE WHEN landed < n_high THEN 'high_valence' ELSE 'low_valence' END AS target_label FROM placed
  UNION ALL SELECT fold * 10 + p, row_index, split, target_label FROM spread WHERE split = 'test'),
{balanced_sql('lr', 'dealt', 1)}, {fitted_sql('lr', 'lr_train', 'lr_test', 'logistic')},
counts AS (
  SELECT unit, target_label AS y_true, CASE WHEN score > 0 THEN 'low_valence' ELSE 'high_valence' END AS y_pred, count(*) AS n
  FROM lr JOIN rows USING (row_index) GROUP BY ALL),
{METRICS_SQL.format(by='unit')}"""


@query(
    "two_feature_permutation_null",
    f"WITH {NULL_SQL} SELECT 'alpha_logistic' AS model, CAST(floor(unit / 10) AS BIGINT) AS fold, CAST(unit % 10 AS BIGINT) AS permutation, n_test, round(balanced_accuracy, 6) AS balanced_accuracy FROM scores",
)
def _null(spark, sf):
    rows = evaluation.run_permutation_null(loso(spark, sf), narrow_features(spark, sf), ["alpha_logistic"], CLASSES, 2, SEED, "leave_one_subject_out")
    return rounded(rows.select("model", F.col("fold").cast("long").alias("fold"), F.col("permutation").cast("long").alias("permutation"), "n_test", "balanced_accuracy"))


def root_sql(m: str) -> tuple[str, str, str]:
    """The three entries of the square root of the symmetric 2 x 2 matrix with columns ``m11, m12, m22``."""
    det = f"sqrt({m}11 * {m}22 - {m}12 * {m}12)"
    size = f"sqrt({m}11 + {m}22 + 2 * {det})"
    return f"({m}11 + {det}) / {size}", f"{m}12 / {size}", f"({m}22 + {det}) / {size}"


#: Pooled over one channel, mean, minimum and maximum of a band are three copies of it (and the spread is constant).
POOLED_COPIES = "CASE unit WHEN 4 THEN sqrt(3) ELSE 1 END"

TRANSFER_SQL = f"""RECURSIVE windows AS (
  SELECT vec_id AS row_index, CASE WHEN label >= 5 THEN 'high_valence' ELSE 'low_valence' END AS label, vec_id % 10 AS subject, floor(vec_id / 10) % 2 AS session,
         floor(vec_id / 20) % 5 AS trial, embedding[3]::DOUBLE AS x1, embedding[4]::DOUBLE AS x2 FROM embeddings),
rows AS (
  SELECT min(row_index) AS row_index, arg_min(label, row_index) AS target_label, CASE WHEN trial IN (1, 3) THEN 'train' ELSE 'test' END AS split, avg(x1) AS x1, avg(x2) AS x2
  FROM windows GROUP BY subject, session, trial),
own AS (
  SELECT split, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) + 1e-6 AS s1, stddev_pop(x2) + 1e-6 AS s2,
         var_samp(x1) + 1e-5 AS c11, covar_samp(x1, x2) AS c12, var_samp(x2) + 1e-5 AS c22 FROM rows GROUP BY split),
roots AS (SELECT split, m1, m2, {', '.join(f'{e} AS {n}' for e, n in zip(root_sql('c'), ('r11', 'r12', 'r22')))} FROM own),
coral AS (
  SELECT a.m1 AS a1, a.m2 AS a2, b.m1 AS b1, b.m2 AS b2,
         (a.r22 * b.r11 - a.r12 * b.r12) / d AS k11, (a.r22 * b.r12 - a.r12 * b.r22) / d AS k12,
         (a.r11 * b.r12 - a.r12 * b.r11) / d AS k21, (a.r11 * b.r22 - a.r12 * b.r12) / d AS k22
  FROM (SELECT *, r11 * r22 - r12 * r12 AS d FROM roots WHERE split = 'train') a, (SELECT * FROM roots WHERE split = 'test') b),
pair AS (
  SELECT 1 AS unit, row_index, target_label, split, x1, x2 FROM rows
  UNION ALL SELECT 2, row_index, target_label, split, (x1 - m1) / s1, (x2 - m2) / s2 FROM rows JOIN own USING (split)
  UNION ALL SELECT 3, row_index, target_label, split, CASE WHEN split = 'train' THEN (x1 - a1) * k11 + (x2 - a2) * k21 + b1 ELSE x1 END,
                   CASE WHEN split = 'train' THEN (x1 - a1) * k12 + (x2 - a2) * k22 + b2 ELSE x2 END FROM rows, coral
  UNION ALL SELECT 4, row_index, target_label, split, x1, x2 FROM rows),
tr_train AS (
  SELECT unit, CASE WHEN target_label = 'low_valence' THEN 1.0 ELSE -1.0 END AS y,
         count(*) OVER (PARTITION BY unit) / (2.0 * count(*) OVER (PARTITION BY unit, target_label)) AS w, x1, x2 FROM pair WHERE split = 'train'),
tr_test AS (SELECT unit, row_index, x1, x2 FROM pair WHERE split = 'test'),
{fitted_sql('lr', 'tr_train', 'tr_test', 'ridge_logistic', POOLED_COPIES)}, {fitted_sql('sv', 'tr_train', 'tr_test', 'svm', POOLED_COPIES)},
named AS (SELECT 'logistic' AS loss, * FROM lr UNION ALL SELECT 'svm', * FROM sv),
counts AS (
  SELECT CASE unit WHEN 1 THEN 'raw_' WHEN 2 THEN 'znorm_' WHEN 3 THEN 'coral_' ELSE 'pooled_' END || loss AS method, target_label AS y_true,
         CASE WHEN score > 0 THEN 'low_valence' ELSE 'high_valence' END AS y_pred, count(*) AS n
  FROM named JOIN rows USING (row_index) GROUP BY ALL),
{METRICS_SQL.format(by='method')}"""


@query(
    "two_feature_transfer",
    f"WITH {TRANSFER_SQL} SELECT method, n_test, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM scores",
)
def _transfer(spark, sf):
    """Trials of two domains under every alignment and both losses."""
    rows = feature_windows(spark, sf).drop("spectral", "alpha").join(narrow_features(spark, sf), "row_index").select(
        "row_index", "subject_key", "trial_key", "target_label", F.col("spectral").alias("features"), F.col("stimulus_key").isin("trial_1", "trial_3").alias("_odd")
    )
    source, target = evaluation.trial_rows(rows.where("_odd")), evaluation.trial_rows(rows.where("not _odd"))
    predicted = evaluation.run_transfer(source, target, CLASSES, losses=["logistic", "svm"], n_bands=2, n_channels=1)
    scored = metrics.fold_metrics(metrics.prediction_counts(predicted, ["method"]), ["method"])
    return rounded(scored.select("method", "n_test", "accuracy", "balanced_accuracy"))


KEYED_SQL = """keyed AS (
  SELECT vec_id AS row_index, 'session_' || CAST(floor(vec_id / 10) % 2 + 1 AS BIGINT) AS session_key,
         printf('s%02d', vec_id % 10) || '::session_' || CAST(floor(vec_id / 10) % 2 + 1 AS BIGINT) || '::trial_' || CAST(floor(vec_id / 20) % 5 AS BIGINT) AS trial_key
  FROM embeddings)"""
PROBE_SQL = f"""RECURSIVE {KEYED_SQL}, {within_class_sql('session_key', 'keyed')},
asked AS (SELECT 1 AS unit, row_index, side AS split, session_key FROM keyed k JOIN sides s ON s.trial_key = k.trial_key AND s.label = k.session_key),
lr_train AS (
  SELECT unit, CASE WHEN session_key = 'session_2' THEN 1.0 ELSE -1.0 END AS y, 1.0 AS w, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2
  FROM asked JOIN embeddings ON vec_id = row_index WHERE split = 'train'),
lr_test AS (SELECT unit, row_index, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM asked JOIN embeddings ON vec_id = row_index WHERE split = 'test'),
{fitted_sql('lr', 'lr_train', 'lr_test', 'logistic')},
counts AS (
  SELECT 'session_key' AS probe_query, session_key AS y_true, CASE WHEN score > 0 THEN 'session_2' ELSE 'session_1' END AS y_pred, count(*) AS n
  FROM lr JOIN keyed USING (row_index) GROUP BY ALL),
{METRICS_SQL.format(by='probe_query')}"""


@query(
    "two_feature_probe",
    f"""WITH {PROBE_SQL} SELECT probe_query, (SELECT count(*) FROM keyed) AS n_chunks, (SELECT count(DISTINCT trial_key) FROM sides WHERE side = 'train') AS n_train_groups,
  (SELECT count(DISTINCT trial_key) FROM sides WHERE side = 'test') AS n_test_groups, round(balanced_accuracy, 6) AS balanced_accuracy, true AS converged FROM scores""",
)
def _probe(spark, sf):
    meta = feature_windows(spark, sf).drop("spectral", "alpha", "label", "target_label")
    features = narrow_features(spark, sf).select("row_index", F.col("alpha").alias("features"))
    row = probes.probe(features, meta, "session_key", SEED)
    table_of_one = probes.probe_table(meta, [row])
    return rounded(table_of_one.select("probe_query", "n_chunks", "n_train_groups", "n_test_groups", "balanced_accuracy", "converged"))


WINDOW_PROBE_SQL = f"""RECURSIVE keyed AS (SELECT vec_id AS row_index, 'session_' || (vec_id // 10 % 2 + 1) AS session_key, embedding FROM embeddings),
placed AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY md5('{SEED}:' || row_index), row_index) AS place FROM keyed),
sizes AS (SELECT session_key, count(*) AS n FROM keyed GROUP BY ALL),
shares AS (SELECT *, sum(n) OVER () - CAST(ceil(sum(n) OVER () * 0.2) AS BIGINT) AS want, sum(n) OVER () AS total FROM sizes),
floors AS (
  SELECT *, floor(n * want / total) AS low,
         row_number() OVER (ORDER BY n * want / total - floor(n * want / total) DESC, session_key) AS pick FROM shares),
quotas AS (SELECT session_key, n - low - CASE WHEN pick <= want - sum(low) OVER () THEN 1 ELSE 0 END AS n_test FROM floors),
sides AS (SELECT placed.*, place <= n_test AS tested FROM placed JOIN quotas USING (session_key)),
lr_train AS (
  SELECT 1 AS unit, CASE WHEN session_key = 'session_2' THEN 1.0 ELSE -1.0 END AS y,
         count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY session_key)) AS w, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2
  FROM sides WHERE NOT tested),
lr_test AS (SELECT 1 AS unit, row_index, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM sides WHERE tested),
{fitted_sql('lr', 'lr_train', 'lr_test', 'logistic')},
counts AS (
  SELECT 'session_key' AS probe_query, session_key AS y_true, CASE WHEN score > 0 THEN 'session_2' ELSE 'session_1' END AS y_pred, count(*) AS n
  FROM lr JOIN keyed USING (row_index) GROUP BY ALL),
{METRICS_SQL.format(by='probe_query')}"""


@query(
    "two_feature_window_random_probe",
    f"""WITH {WINDOW_PROBE_SQL} SELECT probe_query, 'window_random' AS probe_split, (SELECT count(*) FROM keyed) AS n_chunks,
  (SELECT count(*) FROM sides WHERE NOT tested) AS n_train_groups, (SELECT count(*) FROM sides WHERE tested) AS n_test_groups, n_test_classes,
  round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, true AS converged FROM scores""",
)
def _window_probe(spark, sf):
    """The session question on test windows drawn at random, balanced weights."""
    meta = feature_windows(spark, sf).drop("spectral", "alpha", "label", "target_label")
    features = narrow_features(spark, sf).select("row_index", F.col("alpha").alias("features"))
    told = probes.probe_table(meta, [probes.window_random_probe(features, meta, "session_key", SEED)])
    columns = "probe_query probe_split n_chunks n_train_groups n_test_groups n_test_classes accuracy balanced_accuracy converged"
    return rounded(told.select(*columns.split()))


#: Steps of the accelerated descent; the error shrinks by about 1 - 1/sqrt(condition number) a step.
DESCENT_STEPS = 1200


def softmax_sql(name: str, train: str, test: str) -> str:
    """CTEs ending in ``{name}(unit, row_index, y_pred)``: softmax over classes 0, 1, 2 of two features, by accelerated gradient descent.

    Parameters are a list of nine numbers, three (two weights, free intercept) per class.
    """
    score = lambda k: f"p[{3 * k + 1}] * z1 + p[{3 * k + 2}] * z2 + p[{3 * k + 3}]"
    slopes = ", ".join(f"sum(w * (e{k} / (e0 + e1 + e2) - CAST(y = {k} AS INTEGER)) * {z})" for k in range(3) for z in ("z1", "z2", "1"))
    return f"""{name}_scale AS (
  SELECT unit, avg(x1) AS m1, avg(x2) AS m2, coalesce(nullif(stddev_pop(x1), 0), 1) AS s1, coalesce(nullif(stddev_pop(x2), 0), 1) AS s2 FROM {train} GROUP BY unit),
{name}_z AS (SELECT unit, y, w, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM {train} JOIN {name}_scale USING (unit)),
{name}_bound AS (SELECT unit, 1 + 0.5 * sum(w * (z1 * z1 + z2 * z2 + 1)) AS most FROM {name}_z GROUP BY unit),
{name}_steps AS (
  SELECT unit, most, (sqrt(most) - 1) / (sqrt(most) + 1) AS momentum, 0 AS step, list_transform(range(9), lambda i: 0.0::DOUBLE) AS p, list_transform(range(9), lambda i: 0.0::DOUBLE) AS old FROM {name}_bound
  UNION ALL
  SELECT unit, most, momentum, step + 1,
         list_transform(range(9), lambda i: new[i + 1] + momentum * (new[i + 1] - old[i + 1])), new
  FROM (
    SELECT unit, most, momentum, step, old,
           list_transform(range(9), lambda i: p[i + 1] - (g[i + 1] + CASE WHEN i % 3 < 2 THEN p[i + 1] ELSE 0 END) / most) AS new
    FROM (
      SELECT unit, most, momentum, step, p, old, [{slopes}] AS g
      FROM (SELECT s.*, y, w, z1, z2, exp({score(0)}) AS e0, exp({score(1)}) AS e1, exp({score(2)}) AS e2 FROM {name}_steps s JOIN {name}_z USING (unit) WHERE step < {DESCENT_STEPS})
      GROUP BY unit, most, momentum, step, p, old))),
{name}_scores AS (
  SELECT unit, row_index, {score(0)} AS c0, {score(1)} AS c1, {score(2)} AS c2
  FROM (SELECT unit, row_index, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM {test} JOIN {name}_scale USING (unit))
  JOIN (SELECT unit, old AS p FROM {name}_steps WHERE step = {DESCENT_STEPS}) USING (unit)),
{name} AS (SELECT unit, row_index, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 'c0' WHEN c1 >= c2 THEN 'c1' ELSE 'c2' END AS y_pred FROM {name}_scores)"""


THREE_CLASS_SQL = f"""RECURSIVE named AS (SELECT vec_id AS row_index, label % 3 AS y, 'c' || (label % 3) AS name, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2 FROM embeddings),
spread AS (SELECT named.*, unit, CASE WHEN row_index % 4 = unit THEN 'test' ELSE 'train' END AS split FROM named, range(4) u(unit)),
sm_train AS (SELECT *, count(*) OVER (PARTITION BY unit) / (3.0 * count(*) OVER (PARTITION BY unit, y)) AS w FROM spread WHERE split = 'train'),
sm_test AS (SELECT * FROM spread WHERE split = 'test'),
{softmax_sql('sm', 'sm_train', 'sm_test')},
counts AS (SELECT unit AS fold, name AS y_true, y_pred, count(*) AS n FROM sm JOIN named USING (row_index) GROUP BY ALL),
{METRICS_SQL.format(by='fold')}"""


@query(
    "two_feature_softmax",
    f"WITH {THREE_CLASS_SQL} SELECT CAST(fold AS BIGINT) AS fold, n_test, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(macro_f1, 6) AS macro_f1, true AS converged FROM scores",
)
def _softmax(spark, sf):
    """Three classes, four folds: one batch of softmax problems."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_index"), F.concat(F.lit("c"), F.col("label") % 3).alias("name"))
    spread = rows.withColumn("fold", F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])))
    assigned = spread.withColumn("split", F.when(F.col("row_index") % 4 == F.col("fold"), "test").otherwise("train"))
    features = narrow_features(spark, sf).select("row_index", F.col("alpha").alias("features"))
    predicted = settle(linear.fit_predict(assigned, features, ["c0", "c1", "c2"], linear.LOGISTIC, label="name"))
    scored = metrics.fold_metrics(metrics.prediction_counts(predicted, ["fold"]), ["fold"])
    solved = predicted.groupBy("fold").agg(F.bool_and("converged").alias("converged"))
    return rounded(scored.join(solved, "fold").select("fold", "n_test", "accuracy", "balanced_accuracy", "macro_f1", "converged"))
