"""Scores, baselines, intervals, tests and label statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from plumbline.operators import baselines, folds, inference, label_stats, metrics
from plumbline.operators.keys import distinct_trials
from plumbline.plans.bindings import CODED_SQL, ORDERS_SQL, RATING_SQL, SEED, coded, nation_rated, orders_manifest, rated, table
from plumbline.plans.catalog import query
from plumbline.plans.split_queries import (
    K,
    LOSO_VAL,
    NATION_LOSO_SQL,
    SEGMENT_SQL,
    STIMULUS_COUNTS_SQL,
    circle_sql,
    nation_loso_rows,
    roles_sql,
    segment_rows,
)


def rounded(df, digits: int = 6):
    """Round every double column, so that summation order does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def t_table_sql(limit: int = 400, most: int = 1_000_000) -> str:
    """97.5 % points of Student's t by number of units, computed apart from the engine.

    Up to ``limit`` units by bisection of the closed sums of the distribution function;
    beyond, in SQL, by the expansion in powers of 1 / df around the normal point, whose error is
    below 1e-11 there.
    """

    def below(t: float, df: int) -> float:
        """P(|T| < t) as a finite sum over the angle whose tangent is t / sqrt(df)."""
        angle = math.atan(t / math.sqrt(df))
        term = total = 1.0 if df % 2 == 0 else (math.cos(angle) if df > 1 else 0.0)
        for k in range(2 + df % 2, df - 1, 2):
            term *= math.cos(angle) ** 2 * (k - 1) / k
            total += term
        return math.sin(angle) * total if df % 2 == 0 else 2 / math.pi * (angle + math.sin(angle) * total)

    def point(df: int) -> float:
        low, high = 0.0, 20.0
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if below(middle, df) < 0.95 else (low, middle)
        return low

    rows = ", ".join(f"({n}, {point(n - 1)!r}::DOUBLE)" for n in range(2, limit + 1))
    z = NormalDist().inv_cdf(0.975)
    terms = [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    series = " + ".join(f"{a!r} / pow(n - 1, {k})" for k, a in enumerate(terms))
    return f"t(n, multiplier) AS (SELECT * FROM (VALUES {rows}) UNION ALL SELECT n, {series} FROM range({limit + 1}, {most}) r(n))"


def normal_tail_sql(z: str) -> str:
    """Two-sided normal tail by the all-positive series of the error function."""
    x = f"(abs({z}) / sqrt(2))"
    return (
        f"CASE WHEN {x} = 0 THEN 1.0 ELSE 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 200), "
        f"lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln({x}) + lgamma(k + 1) - lgamma(2 * k + 2)))) END"
    )


def wilcoxon_sql(source: str, by: str, value: str) -> str:
    """CTEs ending in ``tested(by, n_used, w_plus, p_wilcoxon)``."""
    return f"""signed AS (
  SELECT {by}, abs(round(raw / most, 12)) AS size, raw > 0 AS up FROM (
    SELECT {by}, CAST({value} AS DOUBLE) AS raw, max(abs(CAST({value} AS DOUBLE))) OVER (PARTITION BY {by}) AS most FROM {source} WHERE isfinite({value}))
  WHERE most > 0 AND round(raw / most, 12) <> 0),
midranks AS (
  SELECT *, 2 * rank() OVER (PARTITION BY {by} ORDER BY size) + count(*) OVER (PARTITION BY {by}, size) - 1 AS rank2,
         count(*) OVER (PARTITION BY {by}, size) AS ties FROM signed),
sums AS (
  SELECT {by}, count(*) AS n_used, CAST(coalesce(sum(rank2) FILTER (up), 0) AS BIGINT) AS w2, max(ties) AS ties,
         CAST(sum(ties * ties - 1) AS BIGINT) AS tied, list(rank2) AS ranks FROM midranks GROUP BY {by}),
ways AS (
  SELECT *, (n_used <= 25 OR (n_used <= 50 AND ties = 1)) AND n_used >= 5 AS exact,
         CASE WHEN (n_used <= 25 OR (n_used <= 50 AND ties = 1)) AND n_used >= 5 THEN
           list_reduce(list_concat([[1.0::DOUBLE]], list_transform(ranks, lambda r: [r::DOUBLE])),
             lambda acc, r: list_transform(range(1, CAST(len(acc) + r[1] + 1 AS BIGINT)),
               lambda i: CASE WHEN i <= len(acc) THEN acc[i] ELSE 0 END + CASE WHEN i > r[1] THEN acc[i - CAST(r[1] AS BIGINT)] ELSE 0 END))
         END AS ways FROM sums),
tested AS (
  SELECT {by}, n_used, w2 / 2 AS w_plus,
         CASE WHEN exact THEN least(1.0, 2 * least(list_sum(ways[1:w2 + 1]), list_sum(ways[w2 + 1:])) / pow(2.0, n_used))
              WHEN n_used >= 5 THEN {normal_tail_sql("((w2 / 2 - n_used * (n_used + 1) / 4) / sqrt(n_used * (n_used + 1) * (2 * n_used + 1) / 24 - tied / 48))")}
         END AS p_wilcoxon FROM ways)"""


def holm_sql(source: str, family: str, key: str, p: str = "p_wilcoxon") -> str:
    """CTE ``adjusted`` = source plus ``p_holm``."""
    part = f"PARTITION BY {family}, {p} IS NULL"
    return f"""steps AS (
  SELECT *, least(1.0, (count({p}) OVER ({part}) - row_number() OVER ({part} ORDER BY {p}, {key}) + 1) * {p}) AS step FROM {source}),
adjusted AS (
  SELECT * EXCLUDE (step), CASE WHEN {p} IS NOT NULL THEN max(step) OVER ({part} ORDER BY {p}, {key} ROWS UNBOUNDED PRECEDING) END AS p_holm
  FROM steps)"""


METRICS_SQL = """per_class AS (
  SELECT {by}, class, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(hit) AS BIGINT) AS hit FROM (
    SELECT {by}, y_true AS class, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS hit FROM counts
    UNION ALL SELECT {by}, y_pred, 0, n, 0 FROM counts) GROUP BY ALL),
scores AS (
  SELECT {by}, CAST(sum(support) AS BIGINT) AS n_test, sum(hit) / sum(support) AS accuracy,
         avg(hit / nullif(support, 0)) AS balanced_accuracy, avg(2 * hit / (support + predicted)) AS macro_f1,
         sum(support * 2 * hit / (support + predicted)) / sum(support) AS weighted_f1,
         count(*) FILTER (support > 0) AS n_test_classes, 1.0 / count(*) FILTER (support > 0) AS uniform_chance,
         avg(hit / nullif(support, 0)) * count(*) FILTER (support > 0) AS ba_over_uniform_chance,
         max(support) / sum(support) AS test_majority_accuracy
  FROM per_class GROUP BY {by})"""

SCORE_COLUMNS = (
    "accuracy balanced_accuracy macro_f1 weighted_f1 uniform_chance ba_over_uniform_chance test_majority_accuracy".split()
)


def scores_out(by: str) -> str:
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLUMNS)
    return f"SELECT {by}, n_test, n_test_classes, {cols} FROM scores"


# -- leave-one-subject-out majority baseline ----------------------------------------------

LOSO_COMPOSITION_SQL = f"""{RATING_SQL}, {circle_sql('manifest')}, {roles_sql(LOSO_VAL)},
class_counts AS (SELECT subject_key, target_label, count(*) AS n FROM manifest GROUP BY ALL),
composed AS (
  SELECT fold, target_label, coalesce(sum(n) FILTER (split = 'test'), 0) AS test,
         coalesce(sum(n) FILTER (split = 'train'), 0) AS train FROM roles JOIN class_counts USING (subject_key) GROUP BY ALL),
best AS (SELECT DISTINCT ON (fold) fold, target_label AS majority FROM composed ORDER BY fold, train DESC, target_label),
counts AS (
  SELECT fold, target_label AS y_true, majority AS y_pred, CAST(test AS BIGINT) AS n FROM composed JOIN best USING (fold) WHERE test > 0)"""


def loso_majority(spark, sf):
    rows = rated(spark, sf)
    composition = folds.fold_composition(rows, folds.subject_circle(rows, SEED), ["target_label"])
    return metrics.fold_metrics(baselines.majority_counts(composition, ["fold"]), ["fold"])


@query("held_out_majority_scores", f"WITH {LOSO_COMPOSITION_SQL}, {METRICS_SQL.format(by='fold')} {scores_out('fold')}")
def _majority(spark, sf):
    return rounded(loso_majority(spark, sf))


@query(
    "held_out_majority_interval",
    f"""WITH {LOSO_COMPOSITION_SQL}, {METRICS_SQL.format(by='fold')}, {t_table_sql()},
units AS (
  SELECT 'accuracy' AS metric, accuracy AS value FROM scores WHERE n_test_classes >= 2
  UNION ALL SELECT 'balanced_accuracy', balanced_accuracy FROM scores WHERE n_test_classes >= 2),
stats AS (SELECT metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM units GROUP BY metric)
SELECT metric, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(multiplier, 6) AS multiplier,
       round(mean - multiplier * sd / sqrt(n), 6) AS low, round(mean + multiplier * sd / sqrt(n), 6) AS high
FROM stats JOIN t USING (n)""",
)
def _majority_interval(spark, sf):
    scored = metrics.comparable_units(loso_majority(spark, sf))
    units = scored.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "balanced_accuracy")]
            )
        ).alias("u")
    ).select("u.*")
    return rounded(inference.t_interval(units, ["metric"], "value"))


@query(
    "single_class_units",
    f"""WITH {STIMULUS_COUNTS_SQL},
units AS (SELECT protocol, fold, count(*) FILTER (test > 0) AS k FROM composed GROUP BY ALL)
SELECT protocol, count(*) FILTER (k >= 2) AS n_units, count(*) FILTER (k < 2) AS n_excluded_single_class FROM units GROUP BY protocol""",
)
def _single_class(spark, sf):
    rows = rated(spark, sf)
    comp = folds.stimulus_composition(rows, folds.subject_circle(rows, SEED), 3)
    units = comp.groupBy("protocol", "fold").agg(F.count_if(F.col("test") > 0).alias("n_test_classes"))
    return metrics.single_class_units(units, ["protocol"])


# -- scores from predictions ----------------------------------------------------------------

STATUS_SQL = f"""{NATION_LOSO_SQL},
predictions AS (
  SELECT fold, split, target_label AS y_true, CASE WHEN o_orderstatus = 'F' THEN 'high_valence' ELSE 'low_valence' END AS y_pred
  FROM ordered JOIN roles USING (subject_key)),
counts AS (SELECT fold, y_true, y_pred, count(*) AS n FROM predictions WHERE split = 'test' GROUP BY ALL)"""


def status_predictions(spark, sf):
    """A stand-in classifier on a feature of the table: the order status."""
    guess = F.when(F.col("o_orderstatus") == "F", "high_valence").otherwise("low_valence")
    return nation_loso_rows(spark, sf).select("fold", "split", F.col("target_label").alias("y_true"), guess.alias("y_pred"))


@query("fold_metrics", f"WITH {STATUS_SQL}, {METRICS_SQL.format(by='fold')} {scores_out('fold')}")
def _fold_metrics(spark, sf):
    test = status_predictions(spark, sf).where(F.col("split") == "test")
    return rounded(metrics.fold_metrics(metrics.prediction_counts(test, ["fold"]), ["fold"]))


@query(
    "training_fit_diagnostic",
    f"""WITH {STATUS_SQL.replace("WHERE split = 'test'", "WHERE split = 'train'")}, {METRICS_SQL.format(by='fold')} {scores_out('fold')}""",
)
def _train_fit(spark, sf):
    train = status_predictions(spark, sf).where(F.col("split") == "train")
    return rounded(metrics.fold_metrics(metrics.prediction_counts(train, ["fold"]), ["fold"]))


@query(
    "confusion_matrices",
    f"""WITH {CODED_SQL},
classes(c) AS (VALUES ('fear'), ('happy'), ('neutral'), ('sad')),
predictions AS (
  SELECT session_key, target_label AS y_true, CASE WHEN value < 20 THEN 'fear' WHEN value < 50 THEN 'happy' ELSE 'sad' END AS y_pred FROM coded_keys),
counts AS (SELECT session_key, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL)
SELECT s.session_key, a.c AS y_true, b.c AS y_pred, coalesce(n, 0) AS n,
       CAST(coalesce((SELECT sum(n) FROM counts x WHERE x.session_key = s.session_key AND x.y_true = a.c), 0) AS BIGINT) AS support
FROM (SELECT DISTINCT session_key FROM counts) s, classes a, classes b
LEFT JOIN counts k ON k.session_key = s.session_key AND k.y_true = a.c AND k.y_pred = b.c""",
)
def _confusion(spark, sf):
    guess = F.when(F.col("value") < 20, "fear").when(F.col("value") < 50, "happy").otherwise("sad")
    rows = coded(spark, sf).select("session_key", F.col("target_label").alias("y_true"), guess.alias("y_pred"))
    counts = metrics.prediction_counts(rows, ["session_key"])
    return metrics.confusion_matrix(counts, ["session_key"], ["fear", "happy", "neutral", "sad"])


@query(
    "balanced_class_weights",
    f"""WITH {LOSO_COMPOSITION_SQL}
SELECT fold, target_label, CAST(train AS BIGINT) AS train,
       round(CASE WHEN train > 0 THEN sum(train) OVER (PARTITION BY fold) / (2 * train) ELSE 0 END, 6) AS weight FROM composed""",
)
def _weights(spark, sf):
    rows = rated(spark, sf)
    composition = folds.fold_composition(rows, folds.subject_circle(rows, SEED), ["target_label"])
    return rounded(metrics.balanced_weights(composition, ["fold"], "target_label", "train", 2))


@query(
    "clipped_class_weights",
    """WITH labels10 AS (SELECT CAST(i AS INTEGER) AS label FROM range(0, 12) r(i)),
counts AS (SELECT l.label, count(e.vec_id) AS n FROM labels10 l LEFT JOIN embeddings e ON e.label = l.label GROUP BY l.label)
SELECT label, n, round(sum(n) OVER () / (12 * greatest(n, 1)), 6) AS weight FROM counts""",
)
def _clipped_weights(spark, sf):
    counts = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    classes = spark.range(12).select(F.col("id").cast("int").alias("label"))
    filled = classes.join(counts, "label", "left").select(F.lit(1).alias("all"), "label", F.coalesce("_n", F.lit(0)).alias("n"))
    return rounded(metrics.balanced_weights(filled, ["all"], "label", "n", 12, absent="clip").drop("all"))


@query(
    "prior_sampling_scores",
    f"""WITH {SEGMENT_SQL},
rows AS (SELECT a.fold, a.split, m.row_index, m.target_label FROM assigned a JOIN manifest m USING (row_index)),
class_ends AS (
  SELECT fold, target_label, sum(count(*)) OVER (PARTITION BY fold ORDER BY target_label) / sum(count(*)) OVER (PARTITION BY fold) AS upto
  FROM rows WHERE split = 'train' GROUP BY fold, target_label),
drawn AS (
  SELECT fold, row_index, target_label AS y_true, CAST('0x' || substr(md5(({SEED} + fold) || ':' || row_index), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM rows WHERE split = 'test'),
predictions AS (
  SELECT DISTINCT ON (d.fold, d.row_index) d.fold, d.row_index, y_true, s.target_label AS y_pred
  FROM drawn d JOIN class_ends s ON s.fold = d.fold AND u < upto ORDER BY d.fold, d.row_index, upto),
counts AS (SELECT CAST(fold AS BIGINT) AS fold, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL),
{METRICS_SQL.format(by='fold')} {scores_out('fold')}""",
)
def _prior(spark, sf):
    rows = segment_rows(spark, sf, "target_label")
    rows = rows.withColumn("fold", F.col("fold").cast("long"))
    train = rows.where(F.col("split") == "train").groupBy("fold", "target_label").agg(F.count(F.lit(1)).alias("train"))
    test = rows.where(F.col("split") == "test").withColumnRenamed("target_label", "y_true")
    predicted = baselines.prior_predictions(test, baselines.prior_blocks(train, ["fold"]), SEED)
    return rounded(metrics.fold_metrics(metrics.prediction_counts(predicted, ["fold"]), ["fold"]))


LEVELS_SQL = f"""scored AS (
  SELECT label || '_' || (vec_id % 7) AS trial_key, CAST(label AS BIGINT) AS y_true,
         list_transform(range(10), lambda c: list_sum(list_transform(range(c, len(embedding), 10), lambda i: embedding[i + 1]::DOUBLE))) AS score FROM embeddings),
windows AS (
  SELECT y_true, CAST(list_position(score, list_max(score)) - 1 AS BIGINT) AS y_pred FROM scored),
means AS (
  SELECT trial_key, min(y_true) AS y_true, [{', '.join(f'avg(score[{i}])' for i in range(1, 11))}] AS m FROM scored GROUP BY trial_key),
trials AS (SELECT trial_key, y_true, CAST(list_position(m, list_max(m)) - 1 AS BIGINT) AS y_pred FROM means)"""


def _scored_windows(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.concat_ws("_", "label", F.pmod("vec_id", F.lit(7))).alias("trial_key"),
        F.col("label").cast("long").alias("label"),
        F.transform(
            F.sequence(F.lit(0), F.lit(9)),
            lambda c: F.aggregate(
                F.filter("embedding", lambda x, i: F.pmod(i, F.lit(10)) == c), F.lit(0.0), lambda total, x: total + x.cast("double")
            ),
        ).alias("score"),  # class c: the sum of components c, c + 10, ... of the whole vector
    )


@query("trial_level_predictions", f"WITH {LEVELS_SQL} SELECT trial_key, y_true, y_pred, false AS mixed FROM trials")
def _trial_predictions(spark, sf):
    return metrics.trial_predictions(_scored_windows(spark, sf), "trial_key", "label", "score", 10)


@query(
    "window_and_trial_level_scores",
    f"""WITH {LEVELS_SQL},
counts AS (
  SELECT level, y_true, y_pred, count(*) AS n FROM (
    SELECT 'chunk' AS level, y_true, y_pred FROM windows UNION ALL SELECT 'trial', y_true, y_pred FROM trials) GROUP BY ALL),
{METRICS_SQL.format(by='level')}
SELECT level, n_test AS n_eval, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy,
       round(macro_f1, 6) AS macro_f1, round(balanced_accuracy - 0.1, 6) AS balanced_accuracy_minus_chance FROM scores""",
)
def _levels(spark, sf):
    scored = _scored_windows(spark, sf)
    trial = metrics.trial_predictions(scored, "trial_key", "label", "score", 10).select(F.lit("trial").alias("level"), "y_true", "y_pred")
    chunk = scored.select(F.lit("chunk").alias("level"), F.col("label").alias("y_true"), metrics.window_predictions("score").alias("y_pred"))
    out = metrics.fold_metrics(metrics.prediction_counts(chunk.unionByName(trial), ["level"]), ["level"])
    return rounded(
        out.select(
            "level",
            F.col("n_test").alias("n_eval"),
            "accuracy",
            "balanced_accuracy",
            "macro_f1",
            (F.col("balanced_accuracy") - 0.1).alias("balanced_accuracy_minus_chance"),
        )
    )


# -- intervals and tests ----------------------------------------------------------------------


def user_units(spark, sf):
    """Per nation and user: share of high ratings, a unit value for the tests below."""
    per = orders_manifest(spark, sf).groupBy("subject_id", "trial_id").agg(
        F.avg((F.col("valence") > 3).cast("double")).alias("a"), F.avg((F.col("arousal") > 3).cast("double")).alias("b")
    )
    return per


UNITS_SQL = f"""{ORDERS_SQL},
units AS (
  SELECT subject_id, trial_id, avg(CASE WHEN valence > 3 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN arousal > 3 THEN 1.0 ELSE 0.0 END) AS b
  FROM ordered GROUP BY ALL)"""


@query(
    "t_intervals",
    f"""WITH {UNITS_SQL}, {t_table_sql(64)}, stats AS (SELECT trial_id, count(*) AS n, avg(a) AS mean, stddev_samp(a) AS sd FROM units GROUP BY trial_id)
SELECT trial_id, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(multiplier, 6) AS multiplier,
       round(mean - multiplier * sd / sqrt(n), 6) AS low, round(mean + multiplier * sd / sqrt(n), 6) AS high FROM stats JOIN t USING (n)""",
)
def _t_intervals(spark, sf):
    return rounded(inference.t_interval(user_units(spark, sf), ["trial_id"], "a"))


@query(
    "paired_differences",
    f"""WITH {UNITS_SQL}
SELECT trial_id, count(*) AS n_pairs, round(avg(a - b), 6) AS mean_diff, round(avg(a - b) / stddev_samp(a - b), 6) AS d_z,
       count(*) FILTER (a - b > 0) AS n_positive FROM units GROUP BY trial_id""",
)
def _paired(spark, sf):
    units = user_units(spark, sf)
    pairs = inference.paired_differences(
        units.select("trial_id", "subject_id", F.col("a").alias("v")),
        units.select("trial_id", "subject_id", F.col("b").alias("v")),
        ["trial_id", "subject_id"],
        "v",
    )
    return rounded(
        pairs.groupBy("trial_id").agg(
            F.count("diff").alias("n_pairs"),
            F.avg("diff").alias("mean_diff"),
            inference.cohens_dz().alias("d_z"),
            F.count_if(F.col("diff") > 0).alias("n_positive"),
        )
    )


@query(
    "unmatched_units",
    """SELECT only_in, count(*) AS n FROM (
  SELECT CASE WHEN d.doc_id IS NULL THEN 'b' ELSE 'a' END AS only_in FROM documents d FULL OUTER JOIN labels l USING (doc_id)
  WHERE d.doc_id IS NULL OR l.doc_id IS NULL) GROUP BY only_in""",
)
def _unmatched(spark, sf):
    found = inference.unmatched_units(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"])
    return found.groupBy("only_in").agg(F.count(F.lit(1)).alias("n"))


TRIAL_DIFF_SQL = f"{UNITS_SQL}, diffs AS (SELECT trial_id, CAST(round((a - b) * 1000) AS DOUBLE) AS d FROM units)"


def _trial_diffs(spark, sf):
    return user_units(spark, sf).select("trial_id", F.round((F.col("a") - F.col("b")) * 1000).alias("d"))


@query(
    "wilcoxon_exact",
    f"""WITH {TRIAL_DIFF_SQL}, {wilcoxon_sql('diffs', 'trial_id', 'd')}
SELECT trial_id, n_used, w_plus, round(p_wilcoxon, 6) AS p_wilcoxon FROM tested""",
)
def _wilcoxon_exact(spark, sf):
    """25 units per test: exact null distribution, with ties."""
    return rounded(inference.wilcoxon(_trial_diffs(spark, sf), ["trial_id"], "d"))


@query(
    "wilcoxon_normal",
    f"""WITH {RATING_SQL},
units AS (SELECT trial_id, subject_id, avg(valence) - 4 AS d FROM manifest GROUP BY ALL),
{wilcoxon_sql('units', 'trial_id', 'd')} SELECT trial_id, n_used, w_plus, round(p_wilcoxon, 6) AS p_wilcoxon FROM tested""",
)
def _wilcoxon_normal(spark, sf):
    """Well over 50 units per test: normal form with tie correction."""
    units = rated(spark, sf).groupBy("trial_id", "subject_id").agg((F.avg("valence") - 4).alias("d"))
    return rounded(inference.wilcoxon(units, ["trial_id"], "d"))


@query(
    "holm_adjustment",
    f"""WITH {TRIAL_DIFF_SQL}, {wilcoxon_sql('diffs', 'trial_id', 'd')},
family AS (SELECT trial_id, trial_id % 2 AS family, CASE WHEN trial_id % 5 = 0 THEN NULL ELSE p_wilcoxon END AS p_wilcoxon FROM tested),
{holm_sql('family', 'family', 'trial_id')}
SELECT trial_id, family, round(p_wilcoxon, 6) AS p_wilcoxon, round(p_holm, 6) AS p_holm FROM adjusted""",
)
def _holm(spark, sf):
    tested = inference.wilcoxon(_trial_diffs(spark, sf), ["trial_id"], "d")
    family = tested.select(
        "trial_id",
        F.pmod("trial_id", F.lit(2)).alias("family"),
        F.when(F.pmod("trial_id", F.lit(5)) != 0, F.col("p_wilcoxon")).alias("p_wilcoxon"),
    )
    return rounded(inference.with_holm(family, ["family"], key=["trial_id"]))


# -- label statistics ---------------------------------------------------------------------------

TRIALS_SQL = f"""{RATING_SQL},
trials AS (SELECT subject_id, trial_id, arg_min(valence, row_index) AS rating FROM manifest GROUP BY ALL)"""


def _rated_trials(spark, sf):
    return distinct_trials(rated(spark, sf), ["subject_id", "trial_id"], ["valence"]).withColumnRenamed("valence", "rating")


@query(
    "threshold_sweep",
    f"""WITH {TRIALS_SQL}, th AS (SELECT 2.0 + i * 0.25 AS threshold FROM range(0, 9) r(i))
SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS n_trials, count(*) FILTER (rating <= threshold) AS low_count,
       count(*) FILTER (rating > threshold) AS high_count, round(count(*) FILTER (rating > threshold) / count(*), 6) AS high_fraction
FROM trials, th GROUP BY threshold""",
)
def _sweep(spark, sf):
    return rounded(label_stats.threshold_sweep(_rated_trials(spark, sf), "rating", 3.0))


def _boundary_sql(source: str, x: str, tau: float) -> str:
    return f"""SELECT CAST(delta AS DOUBLE) AS delta, count(*) AS n_trials, count(DISTINCT {x}) AS n_unique_ratings, round(avg({x}), 6) AS rating_mean,
       round(stddev_samp({x}), 6) AS rating_std, count(*) FILTER ({x} <= {tau}) AS nominal_low_count, count(*) FILTER ({x} > {tau}) AS nominal_high_count,
       round(count(*) FILTER ({x} > {tau}) / count(*), 6) AS nominal_high_fraction, count(*) FILTER ({x} = {tau}) AS at_threshold_count,
       round(count(*) FILTER ({x} = {tau}) / count(*), 6) AS at_threshold_fraction,
       count(*) FILTER (abs({x} - {tau}) <= delta AND {x} <> {tau}) AS boundary_excluding_ties_count,
       count(*) FILTER (abs({x} - {tau}) <= delta) AS boundary_count, round(count(*) FILTER (abs({x} - {tau}) <= delta) / count(*), 6) AS boundary_fraction,
       count(*) FILTER (({x} > {tau} - delta) <> ({x} > {tau} + delta)) AS shift_disagreement_count,
       round(count(*) FILTER (({x} > {tau} - delta) <> ({x} > {tau} + delta)) / count(*), 6) AS shift_disagreement_fraction
FROM {source}, (VALUES (0.25), (0.5), (1.0)) d(delta) GROUP BY delta"""


@query("boundary_statistics", f"WITH {TRIALS_SQL} {_boundary_sql('trials', 'rating', 3)}")
def _boundary(spark, sf):
    return rounded(label_stats.boundary_statistics(_rated_trials(spark, sf), "rating", 3.0))


@query("boundary_statistics_at_volume", _boundary_sql("lineitem", "l_quantity", 25))
def _boundary_volume(spark, sf):
    return rounded(label_stats.boundary_statistics(table(spark, sf, "lineitem"), "l_quantity", 25.0))


@query(
    "stimulus_agreement",
    """WITH per AS (
  SELECT l_partkey, count(*) AS n, count(*) FILTER (l_quantity > 25) AS h, count(*) FILTER (l_quantity <= 25) AS l,
         avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, n AS n_subject_trials, CASE WHEN h >= l THEN 'high_quantity' ELSE 'low_quantity' END AS dominant_label,
       round(greatest(h, l) / n, 6) AS dominant_fraction,
       round(abs(CASE WHEN h > 0 THEN -(h / n) * log2(h / n) ELSE 0 END + CASE WHEN l > 0 THEN -(l / n) * log2(l / n) ELSE 0 END), 6) AS label_entropy_bits,
       round(m, 6) AS rating_mean, round(sd, 6) AS rating_std FROM per""",
)
def _agreement(spark, sf):
    out = label_stats.stimulus_agreement(table(spark, sf, "lineitem"), "l_partkey", "l_quantity", 25.0, "quantity")
    return rounded(out.withColumn("label_entropy_bits", F.abs("label_entropy_bits")))


DETERMINISM_SQL = f"""{CODED_SQL},
trials AS (
  SELECT subject_key, session_key || '::trial_' || trial_id AS stimulus_key, arg_min(CASE WHEN value > 150 THEN 'outlier' ELSE target_label END, row_index) AS label
  FROM coded_keys GROUP BY subject_key, session_key, trial_id),
counts AS (SELECT stimulus_key, label, count(*) AS n FROM trials GROUP BY ALL),
per AS (
  SELECT stimulus_key, CAST(sum(n) AS BIGINT) AS n_subject_trials, count(*) AS n_labels, max(n) / sum(n) AS dominant_fraction,
         abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS label_entropy_bits FROM counts GROUP BY stimulus_key),
best AS (SELECT DISTINCT ON (stimulus_key) stimulus_key, label AS dominant_label FROM counts ORDER BY stimulus_key, n DESC, label)"""


def _coded_trials(spark, sf):
    label = F.when(F.col("value") > 150, "outlier").otherwise(F.col("target_label"))
    rows = coded(spark, sf).withColumn("label", label)
    trials = distinct_trials(rows, ["subject_key", "session_key", "trial_id"], ["label"])
    name = F.concat(F.col("session_key"), F.lit("::trial_"), F.col("trial_id").cast("string"))
    return trials.withColumn("stimulus_key", name)


@query(
    "stimulus_determinism",
    f"""WITH {DETERMINISM_SQL}
SELECT stimulus_key, n_subject_trials, n_labels, dominant_label, round(dominant_fraction, 6) AS dominant_fraction,
       round(label_entropy_bits, 6) AS label_entropy_bits FROM per JOIN best USING (stimulus_key)""",
)
def _determinism(spark, sf):
    out = label_stats.stimulus_determinism(_coded_trials(spark, sf), "stimulus_key", "label")
    return rounded(out.withColumn("label_entropy_bits", F.abs("label_entropy_bits")))


@query(
    "determinism_summary",
    f"""WITH {DETERMINISM_SQL}
SELECT CAST(sum(n_subject_trials) AS BIGINT) AS n_trials, count(*) AS n_stimulus_keys,
       round(avg(dominant_fraction), 6) AS mean_stimulus_dominant_fraction,
       round(avg(CASE WHEN dominant_fraction = 1 THEN 1.0 ELSE 0.0 END), 6) AS fully_deterministic_stimulus_fraction,
       (SELECT count(DISTINCT subject_key) FROM trials) AS n_subjects FROM per""",
)
def _determinism_summary(spark, sf):
    return rounded(label_stats.determinism_summary(_coded_trials(spark, sf), "stimulus_key", "label", "subject_key"))
