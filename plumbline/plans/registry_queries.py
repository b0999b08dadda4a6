"""A registry of runs built from the tables, its validation and its summaries.

Four stand-in runs score ``orders`` per nation (the held-out subject): three guess the
label from one column each, with three seeds (a third of the rows each), and one has no
seed.  Everything a registry needs follows from their fold metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.operators import metrics, registry
from plumbline.plans.bindings import ORDERS_SQL, nation_rated
from plumbline.plans.catalog import query
from plumbline.plans.metric_queries import METRICS_SQL, holm_sql, rounded, t_table_sql, wilcoxon_sql

GUESSES = {
    "A": "o_orderstatus = 'F'",
    "B": "arousal < 3",
    "C": "row_index % 7 < 3",
    "D": "o_orderstatus = 'F' OR arousal < 2",
}
# run, kind, protocol, model, transform
RUNS = (
    ("A", "classical", "strict_loso", "spectral_logistic", "none"),
    ("B", "classical", "strict_loso", "alpha_logistic", "none"),
    ("C", "deep", "strict_loso", "eegnet", "time_shuffle"),
    ("D", "classical", "strict_loso", "spectral_svm", "none"),
)
# estimate, analysis, family, role, run
ESTIMATES = (
    ("single_a", "subject_held_out", "above_chance", "single", "A"),
    ("single_b", "subject_held_out", "above_chance", "single", "B"),
    ("single_c", "subject_held_out", "above_chance", "single", "C"),
    ("single_d", "training_only", "above_chance", "single", "D"),
    ("a_minus_b", "contrast", "contrasts", "A", "A"),
    ("a_minus_b", "contrast", "contrasts", "B", "B"),
    ("a_minus_c", "contrast", "contrasts", "A", "A"),
    ("a_minus_c", "contrast", "contrasts", "B", "C"),
    ("a_minus_d", "contrast", "contrasts", "A", "A"),
    ("a_minus_d", "contrast", "contrasts", "B", "D"),
    ("protocols", "protocol_decomposition", "none", "segment_random", "A"),
    ("protocols", "protocol_decomposition", "none", "trial_within_subject", "B"),
    ("protocols", "protocol_decomposition", "none", "strict_loso", "C"),
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


_GUESS_SQL = " UNION ALL ".join(
    f"SELECT '{run}' AS run_id, {'CAST(NULL AS BIGINT)' if run == 'D' else 'row_index % 3 + ' + ('2' if run == 'C' else '1')} AS seed, "
    f"subject_id + 1 AS fold, target_label AS y_true, CASE WHEN {rule} THEN 'high_valence' ELSE 'low_valence' END AS y_pred FROM ordered"
    for run, rule in GUESSES.items()
)
RESULTS_SQL = f"""{ORDERS_SQL}, guesses AS ({_GUESS_SQL}),
counts AS (SELECT run_id, coalesce(seed, -1) AS seed, fold, y_true, y_pred, count(*) AS n FROM guesses GROUP BY ALL),
{METRICS_SQL.format(by='run_id, seed, fold')},
results AS (
  SELECT run_id, CASE WHEN seed >= 0 THEN seed END AS seed, fold, n_test_classes, n_test, balanced_accuracy, accuracy FROM scores),
runs(run_id, kind, protocol, model, transform) AS (VALUES {_values(RUNS)}),
defs(estimate, analysis, holm_family, role, run_id) AS (VALUES {_values(ESTIMATES)}),
joined AS (SELECT * FROM defs JOIN results USING (run_id) JOIN runs USING (run_id))"""


def results(spark, sf) -> DataFrame:
    """``run_id, seed, fold`` metrics of the stand-in runs."""
    rows = nation_rated(spark, sf)
    runs = []
    for run, rule in GUESSES.items():
        seed = F.lit(None).cast("long") if run == "D" else F.pmod("row_index", F.lit(3)) + (2 if run == "C" else 1)
        guess = F.when(F.expr(rule), "high_valence").otherwise("low_valence")
        runs.append(F.struct(F.lit(run).alias("run_id"), seed.alias("seed"), guess.alias("y_pred")))
    guesses = rows.select(
        (F.col("subject_id") + 1).alias("fold"), F.col("target_label").alias("y_true"), F.explode(F.array(*runs)).alias("_r")
    ).select("fold", "y_true", "_r.*")
    by = ["run_id", "seed", "fold"]
    return settle(metrics.fold_metrics(metrics.prediction_counts(guesses, by), by))


def run_table(spark) -> DataFrame:
    """The runs with every condition column (the registry's own dimension table)."""
    base = spark.createDataFrame(list(RUNS), "run_id string, kind string, protocol string, model string, transform string")
    return base.select(
        "run_id", "kind", F.lit("dreamer").alias("dataset"), F.lit("valence").alias("target"),
        F.lit("dreamer_valence_gt3_tie_low_v1").alias("label_policy_id"), F.lit("primary").alias("label_variant"),
        "protocol", F.lit("primary").alias("split_variant"), "model", "transform", F.lit(5).alias("epochs"),
        F.lit(64).alias("batch_size"), F.lit(False).alias("early_stopping"), F.lit("none").alias("class_weighting"),
        F.lit(0.0).alias("inject_snr"), F.lit("abc").alias("split_partition_sha256"), F.lit(None).cast("long").alias("seed"),
    )


def estimate_table(spark, rows: DataFrame) -> DataFrame:
    defs = spark.createDataFrame(
        list(ESTIMATES), "estimate string, analysis string, holm_family string, role string, run_id string"
    )
    return defs.join(rows.select("run_id", "seed", "fold"), "run_id").select(*registry.ESTIMATE_COLUMNS)


def registry_rows(spark, sf) -> DataFrame:
    rows = results(spark, sf)
    return settle(registry.joined(run_table(spark), rows, estimate_table(spark, rows)))


@query(
    "registry_validation",
    f"""WITH {RESULTS_SQL}
SELECT 'balanced accuracy outside [0, 1]' AS rule, count(*) AS n FROM results WHERE fold = 3
UNION ALL SELECT 'duplicate result', count(*) FROM results WHERE fold = 5
UNION ALL SELECT 'duplicate run', 1
UNION ALL SELECT 'unknown run', 1
UNION ALL SELECT 'estimate without result', (SELECT count(*) FROM defs JOIN results USING (run_id) WHERE fold = 7)
  + (SELECT count(*) FROM (VALUES ('nowhere'), ('E')) runs_without_rows)
UNION ALL SELECT 'several runs for one seed and fold', 1
UNION ALL SELECT 'mixed conditions in a role', 1
UNION ALL SELECT 'a pair needs both roles', 1
UNION ALL SELECT 'roles have identical conditions', 1
UNION ALL SELECT 'roles differ in dataset or target', 1""",
)
def _validation(spark, sf):
    """A registry with one planted fault per rule: every rule finds its own and nothing else."""
    rows, runs = results(spark, sf), run_table(spark)
    estimates = estimate_table(spark, rows)
    bad_rows = rows.where("fold <> 7").withColumn(
        "balanced_accuracy", F.when(F.col("fold") == 3, 1.5).otherwise(F.col("balanced_accuracy"))
    )
    bad_rows = bad_rows.unionByName(bad_rows.where("fold = 5"))
    other = runs.where("run_id = 'B'").withColumn("run_id", F.lit("E")).withColumn("target", F.lit("arousal"))
    bad_runs = runs.unionByName(runs.where("run_id = 'D'")).unionByName(other)

    def extra(run: str, role: str, name: str, source: str = "A", where: str = "fold = 1 and seed = 1") -> DataFrame:
        return rows.where(f"run_id = '{source}' and {where}").select(
            F.lit(name).alias("estimate"), F.lit("contrast").alias("analysis"), F.lit("f").alias("holm_family"),
            F.lit(role).alias("role"), F.lit(run).alias("run_id"), "seed", "fold",
        )

    planted = [
        extra("nowhere", "single", "unknown"),
        extra("A", "single", "crowded"), extra("B", "single", "crowded"),
        extra("A", "A", "lonely"),
        extra("A", "A", "twins"), extra("A", "B", "twins"),
        extra("A", "A", "far"), extra("E", "B", "far"),
    ]
    for p in planted:
        estimates = estimates.unionByName(p)
    found = registry.violations(bad_runs, settle(bad_rows), settle(estimates))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


UNITS_SQL = """units AS (
  SELECT estimate, analysis, holm_family, fold, avg(balanced_accuracy) AS ba FROM joined WHERE role = 'single' GROUP BY ALL),
against AS (SELECT estimate, ba - 0.5 AS d FROM units WHERE analysis = 'subject_held_out')"""


@query(
    "seed_averaged_units",
    f"""WITH {RESULTS_SQL}
SELECT estimate, role, fold, round(avg(balanced_accuracy), 6) AS balanced_accuracy FROM joined GROUP BY ALL""",
)
def _units(spark, sf):
    return rounded(registry.per_unit(registry_rows(spark, sf), ["estimate", "role", "fold"]))


@query(
    "above_chance_estimates",
    f"""WITH {RESULTS_SQL}, {UNITS_SQL}, {wilcoxon_sql('against', 'estimate', 'd')}, {t_table_sql(64)},
stats AS (SELECT estimate, analysis, holm_family, count(*) AS n, avg(ba) AS mean, stddev_samp(ba) AS sd FROM units GROUP BY ALL),
heads AS (SELECT DISTINCT estimate, model FROM joined WHERE role = 'single'),
full_table AS (SELECT * FROM stats JOIN heads USING (estimate) JOIN t USING (n) LEFT JOIN tested USING (estimate)),
{holm_sql('full_table', 'holm_family', 'estimate')}
SELECT estimate, analysis, holm_family, 'dreamer' AS dataset, 'valence' AS target, model, n AS n_subjects, round(mean, 6) AS mean,
       round(sd, 6) AS sd, round(mean - multiplier * sd / sqrt(n), 6) AS t95_low, round(mean + multiplier * sd / sqrt(n), 6) AS t95_high,
       CASE WHEN analysis = 'subject_held_out' THEN 0.5::DOUBLE END AS chance, round(p_wilcoxon, 6) AS p_wilcoxon, round(p_holm, 6) AS p_holm
FROM adjusted""",
)
def _single(spark, sf):
    return rounded(registry.single_estimates(registry_rows(spark, sf)))


@query(
    "paired_estimates",
    f"""WITH {RESULTS_SQL},
pair AS (SELECT * FROM joined WHERE role IN ('A', 'B')),
shared AS (SELECT estimate, seed FROM pair WHERE seed IS NOT NULL GROUP BY ALL HAVING count(DISTINCT role) = 2),
n_shared AS (SELECT estimate, count(*) AS n_seeds FROM shared GROUP BY estimate),
kept AS (
  SELECT p.* FROM pair p LEFT JOIN n_shared n USING (estimate)
  WHERE n.n_seeds IS NULL OR EXISTS (SELECT 1 FROM shared s WHERE s.estimate = p.estimate AND s.seed = p.seed)),
sides AS (
  SELECT estimate, analysis, holm_family, fold, avg(balanced_accuracy) FILTER (role = 'A') AS a,
         avg(balanced_accuracy) FILTER (role = 'B') AS b FROM kept GROUP BY ALL),
diffs AS (SELECT *, a - b AS d FROM sides WHERE a IS NOT NULL AND b IS NOT NULL),
{wilcoxon_sql('diffs', 'estimate', 'd')}, {t_table_sql(64)},
stats AS (
  SELECT estimate, analysis, holm_family, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS mean, stddev_samp(d) AS sd,
         count(*) FILTER (d > 0) AS n_positive FROM diffs GROUP BY ALL),
full_table AS (
  SELECT * FROM stats JOIN t USING (n) LEFT JOIN tested USING (estimate) LEFT JOIN n_shared USING (estimate)),
{holm_sql('full_table', 'holm_family', 'estimate')}
SELECT estimate, analysis, holm_family, 'dreamer' AS dataset, 'valence' AS target, 'spectral_logistic' AS model, coalesce(n_seeds, 1) AS n_seeds,
       n AS n_pairs, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean, 6) AS mean_diff,
       round(mean - multiplier * sd / sqrt(n), 6) AS diff_t95_low, round(mean + multiplier * sd / sqrt(n), 6) AS diff_t95_high,
       round(mean / sd, 6) AS d_z, n_positive, round(p_wilcoxon, 6) AS p_wilcoxon, round(p_holm, 6) AS p_holm FROM adjusted""",
)
def _paired(spark, sf):
    return rounded(registry.paired_estimates(registry_rows(spark, sf)))


_DECOMPOSED_SQL = ", ".join(
    f"round(avg(balanced_accuracy) FILTER (role = '{p}'), 6) AS {p}_mean, round(min(balanced_accuracy) FILTER (role = '{p}'), 6) AS {p}_min, "
    f"round(max(balanced_accuracy) FILTER (role = '{p}'), 6) AS {p}_max, count(DISTINCT fold) FILTER (role = '{p}') AS {p}_n"
    for p in registry.DECOMPOSED
)


@query(
    "protocol_decomposition",
    f"""WITH {RESULTS_SQL}, m AS (
  SELECT estimate, avg(balanced_accuracy) FILTER (role = 'segment_random') AS s, avg(balanced_accuracy) FILTER (role = 'trial_within_subject') AS t,
         avg(balanced_accuracy) FILTER (role = 'strict_loso') AS l FROM joined WHERE analysis = 'protocol_decomposition' GROUP BY estimate)
SELECT estimate, 'dreamer' AS dataset, 'valence' AS target, {_DECOMPOSED_SQL}, round(any_value(s - t), 6) AS gap_segment_minus_trial,
       round(any_value(t - l), 6) AS gap_trial_minus_loso, round(any_value(s - l), 6) AS gap_segment_minus_loso
FROM joined JOIN m USING (estimate) WHERE analysis = 'protocol_decomposition' GROUP BY estimate""",
)
def _protocols(spark, sf):
    return rounded(registry.protocol_estimates(registry_rows(spark, sf)))


@query(
    "transfer_estimates",
    f"""WITH {RESULTS_SQL}, {t_table_sql(64)},
units AS (
  SELECT CASE WHEN run_id = 'B' THEN 'dreamer' ELSE 'deap' END AS source, run_id AS pipeline, fold, avg(balanced_accuracy) AS ba
  FROM results GROUP BY ALL),
diffs AS (SELECT pipeline, ba - 0.5 AS d FROM units),
{wilcoxon_sql('diffs', 'pipeline', 'd')},
stats AS (SELECT source, pipeline, count(*) AS n, avg(ba) AS mean, stddev_samp(ba) AS sd FROM units GROUP BY ALL),
full_table AS (SELECT *, 1 AS fam FROM stats JOIN t USING (n) JOIN tested USING (pipeline)),
{holm_sql('full_table', 'fam', 'source, pipeline')}
SELECT source, 'dreamer' AS target_dataset, 'valence' AS target, pipeline, n AS subj_n, round(mean, 6) AS subj_mean,
       round(mean - multiplier * sd / sqrt(n), 6) AS subj_t95_low, round(mean + multiplier * sd / sqrt(n), 6) AS subj_t95_high,
       round(p_wilcoxon, 6) AS subj_p_wilcoxon, round(p_holm, 6) AS subj_p_holm FROM adjusted""",
)
def _transfer(spark, sf):
    rows = results(spark, sf).select(
        F.when(F.col("run_id") == "B", "dreamer").otherwise("deap").alias("source"),
        F.lit("dreamer").alias("target_dataset"),
        F.lit("valence").alias("target"),
        F.col("run_id").alias("pipeline"),
        F.col("fold").alias("target_subject"),
        "seed",
        F.col("balanced_accuracy").alias("ba"),
    )
    return rounded(registry.transfer_estimates(rows))


@query(
    "permutation_null_summary",
    f"""WITH {RESULTS_SQL},
stats AS (
  SELECT model, count(*) AS n_rows, count(DISTINCT fold) AS n_folds, count(DISTINCT seed) AS n_permutations, max(n_test_classes) AS n_classes,
         avg(balanced_accuracy) AS bm, stddev_samp(balanced_accuracy) AS bs, avg(accuracy) AS am, stddev_samp(accuracy) AS asd, count(*) AS n
  FROM results JOIN runs USING (run_id) GROUP BY model)
SELECT 'dreamer' AS dataset, 'valence' AS target, 'strict_loso' AS protocol, model, n_rows, n_folds, n_permutations, n_classes,
       round(bm, 6) AS balanced_accuracy_mean, round(bs, 6) AS balanced_accuracy_sd, round(bm - 1.96 * bs / sqrt(n), 6) AS balanced_accuracy_ci95_low,
       round(bm + 1.96 * bs / sqrt(n), 6) AS balanced_accuracy_ci95_high, round(am, 6) AS accuracy_mean, round(asd, 6) AS accuracy_sd,
       round(am - 1.96 * asd / sqrt(n), 6) AS accuracy_ci95_low, round(am + 1.96 * asd / sqrt(n), 6) AS accuracy_ci95_high,
       round(1.0 / n_classes, 6) AS chance_balanced_accuracy, round(bm - 1.0 / n_classes, 6) AS balanced_accuracy_minus_chance,
       CASE WHEN abs(bm - 1.0 / n_classes) <= 0.03 THEN 'near chance; null sanity check passed'
            WHEN abs(bm - 1.0 / n_classes) <= 0.07 THEN 'small deviation from chance; inspect fold variability'
            ELSE 'material deviation from chance; investigate leakage or pipeline bug' END AS interpretation
FROM stats""",
)
def _null_summary(spark, sf):
    rows = results(spark, sf).join(run_table(spark).select("run_id", "dataset", "target", "protocol", "model"), "run_id")
    rows = rows.withColumn("permutation", F.col("seed")).withColumn("n_classes", F.col("n_test_classes"))
    return rounded(registry.permutation_summary(rows))


@query(
    "probe_summary",
    f"""WITH {RESULTS_SQL}
SELECT model, transform, count(DISTINCT fold) AS n_encoders, round(avg(balanced_accuracy), 6) AS ba_mean, round(stddev_samp(balanced_accuracy), 6) AS ba_sd,
       round(avg(1.0 / n_test_classes), 6) AS chance_mean, round(avg(balanced_accuracy * n_test_classes), 6) AS ratio_mean,
       round(avg(n_test_classes), 6) AS n_test_classes_mean
FROM results JOIN runs USING (run_id) WHERE fold % 4 <> 0 GROUP BY model, transform""",
)
def _probe_summary(spark, sf):
    rows = results(spark, sf).join(run_table(spark).select("run_id", "model", "transform"), "run_id")
    rows = rows.withColumn("status", F.when(F.col("fold") % 4 == 0, "NOT_ESTIMABLE").otherwise("OK"))
    return rounded(registry.probe_summary(rows, ["model", "transform"]))


@query(
    "probe_status_counts",
    f"""WITH {RESULTS_SQL} SELECT CASE WHEN fold % 4 = 0 THEN 'NOT_ESTIMABLE' ELSE 'OK' END AS status, count(*) AS n FROM results GROUP BY 1""",
)
def _status(spark, sf):
    rows = results(spark, sf).withColumn("status", F.when(F.col("fold") % 4 == 0, "NOT_ESTIMABLE").otherwise("OK"))
    return registry.status_counts(rows)


@query(
    "run_extras",
    f"""WITH {RESULTS_SQL}
SELECT run_id, round(median(n_test % 30), 6) AS median_best_epoch, round(avg(balanced_accuracy), 6) AS ba_mean,
       round(min(balanced_accuracy), 6) AS ba_min, round(max(balanced_accuracy), 6) AS ba_max FROM results GROUP BY run_id""",
)
def _extras(spark, sf):
    rows = results(spark, sf).withColumn("best_epoch", F.col("n_test") % 30)
    return rounded(registry.run_extras(rows, ["run_id"]))
