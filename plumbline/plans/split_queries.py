"""Split construction, audits and seeded samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.permute import permuted_sql
from plumbline.functions.settle import settle
from plumbline.operators import audits, folds, matching, probe_splits, sampling, shuffles
from plumbline.plans.bindings import (
    CODED_SQL,
    ORDERS_SQL,
    RATING_SQL,
    SEED,
    coded,
    nation_rated,
    rated,
)
from plumbline.plans.catalog import query

K = 5

# -- shared SQL -------------------------------------------------------------------------

SEGMENT_SQL = f"""{RATING_SQL},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY target_label ORDER BY md5('{SEED}:' || row_index), row_index) - 1 AS r
  FROM manifest),
spread AS (SELECT ranked.*, fold FROM ranked, range(1, {K} + 1) f(fold)),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY fold, target_label ORDER BY r) - 1 AS q,
         count(*) OVER (PARTITION BY fold, target_label) AS n_pool, count(*) OVER (PARTITION BY fold) AS n_all
  FROM spread WHERE r % {K} <> fold - 1),
sizes AS (SELECT DISTINCT fold, target_label, n_pool, n_all - CAST(ceil(n_all * 0.2) AS BIGINT) AS n_train, n_all FROM pool),
shares AS (
  SELECT *, n_pool * n_train / n_all AS share FROM sizes),
floors AS (
  SELECT *, floor(share) AS low,
         row_number() OVER (PARTITION BY fold ORDER BY share - floor(share) DESC, target_label) AS place FROM shares),
quotas AS (
  SELECT fold, target_label, n_pool - CAST(low + CASE WHEN place <= n_train - sum(low) OVER (PARTITION BY fold)
         THEN 1 ELSE 0 END AS BIGINT) AS n_val FROM floors),
assigned AS (
  SELECT row_index, fold, 'test' AS split FROM spread WHERE r % {K} = fold - 1
  UNION ALL
  SELECT row_index, pool.fold,
         CASE WHEN (q - CAST(floor(n_pool * (pool.fold - 1) / {K}) AS BIGINT) + n_pool) % n_pool < n_val THEN 'val' ELSE 'train' END
  FROM pool JOIN quotas USING (fold, target_label))"""

TRIAL_SQL = f"""{RATING_SQL},
groups AS (SELECT trial_key, count(*) AS size FROM manifest GROUP BY trial_key),
dealt AS (
  SELECT trial_key, row_number() OVER (ORDER BY size DESC, trial_key) - 1 AS r FROM groups),
tested AS (
  SELECT trial_key, CASE WHEN (r // {K}) % 2 = 0 THEN r % {K} + 1 ELSE {K} - r % {K} END AS test_fold FROM dealt),
spread AS (SELECT trial_key, test_fold, fold FROM tested, range(1, {K} + 1) f(fold)),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5(({SEED} + fold) || ':' || trial_key), trial_key) AS place,
         count(*) OVER (PARTITION BY fold) AS n FROM spread WHERE test_fold <> fold),
rules AS (
  SELECT trial_key, fold, CASE WHEN place <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM pool
  UNION ALL SELECT trial_key, fold, 'test' FROM spread WHERE test_fold = fold)"""


def circle_sql(source: str) -> str:
    return f"""subjects AS (SELECT DISTINCT subject_key FROM {source}),
circle AS (
  SELECT subject_key, row_number() OVER (ORDER BY subject_key) AS fold,
         row_number() OVER (ORDER BY md5('{SEED}:' || subject_key), subject_key) - 1 AS pos,
         count(*) OVER () AS n FROM subjects)"""


def roles_sql(n_val: str) -> str:
    return f"""roles AS (
  SELECT s.subject_key, t.fold, t.subject_key AS test_subject,
         CASE WHEN s.pos = t.pos THEN 'test' WHEN (s.pos - t.pos + s.n) % s.n <= {n_val} THEN 'val' ELSE 'train' END AS split
  FROM circle s, circle t)"""


LOSO_VAL = "CAST(ceil((s.n - 1) * 0.2) AS BIGINT)"
STIMULUS_VAL = "greatest(1, CAST(round_even((s.n - 1) * 0.2, 0) AS BIGINT))"
NATION_LOSO_SQL = f"{ORDERS_SQL}, {circle_sql('ordered')}, {roles_sql(LOSO_VAL)}"

STIMULUS_SQL = f"""{ORDERS_SQL}, {circle_sql('ordered')}, {roles_sql(STIMULUS_VAL)},
conditions AS (
  SELECT 'loso_stimulus_heldout' AS protocol, 0 AS shift UNION ALL SELECT 'loso_stimulus_seen', 1),
assigned AS (
  SELECT o.*, protocol, r.fold, r.split
  FROM ordered o JOIN roles r USING (subject_key), conditions c
  WHERE CASE WHEN r.split = 'test' THEN o.stimulus_group = (r.fold - 1) % 3
             ELSE o.stimulus_group <> ((r.fold - 1) % 3 + c.shift) % 3 END)"""


# -- plans used by several queries ------------------------------------------------------


def segment_rows(spark, sf, *carry: str):
    return folds.segment_random(rated(spark, sf), K, SEED, carry=carry)


def trial_rules(spark, sf):
    return folds.trial_grouped_rules(rated(spark, sf), K, SEED)


def nation_loso_rows(spark, sf):
    rows = nation_rated(spark, sf)
    rules = folds.subject_rules(folds.subject_circle(rows, SEED))
    return folds.assign_rows(rows, rules, ["subject_key"]).withColumn("protocol", F.lit("leave_one_subject_out"))


def stimulus_rows(spark, sf):
    rows = sampling.with_sample_hash(nation_rated(spark, sf), SEED)
    rules = folds.stimulus_rules(folds.subject_circle(rows, SEED), 3)
    return folds.assign_rows(rows, rules, ["subject_key", "stimulus_group"])


# -- protocols --------------------------------------------------------------------------


@query("segment_random_folds", f"WITH {SEGMENT_SQL} SELECT row_index, CAST(fold AS BIGINT) AS fold, split FROM assigned")
def _segment_random(spark, sf):
    return segment_rows(spark, sf).select("row_index", F.col("fold").cast("long").alias("fold"), "split")


@query(
    "segment_random_class_counts",
    f"""WITH {SEGMENT_SQL}
SELECT CAST(fold AS BIGINT) AS fold, split, target_label, count(*) AS n
FROM assigned JOIN manifest USING (row_index) GROUP BY ALL""",
)
def _segment_counts(spark, sf):
    return (
        segment_rows(spark, sf, "target_label")
        .groupBy(F.col("fold").cast("long").alias("fold"), "split", "target_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("trial_grouped_folds", f"WITH {TRIAL_SQL} SELECT trial_key, CAST(fold AS BIGINT) AS fold, split FROM rules")
def _trial_grouped(spark, sf):
    return trial_rules(spark, sf).select("trial_key", F.col("fold").cast("long").alias("fold"), "split")


@query(
    "trial_grouped_split_summary",
    f"""WITH {TRIAL_SQL}
SELECT 'dreamer' AS dataset, 'valence' AS target, 'trial_grouped' AS protocol, CAST(fold AS BIGINT) AS fold, split,
       count(*) AS chunks, count(DISTINCT subject_key) AS subjects, count(DISTINCT trial_key) AS trials,
       count(DISTINCT target_label) AS classes
FROM manifest JOIN rules USING (trial_key) GROUP BY fold, split""",
)
def _trial_summary(spark, sf):
    rows = rated(spark, sf).withColumn("protocol", F.lit(folds.protocol_name("trial_within_subject")))
    rules = trial_rules(spark, sf).withColumn("fold", F.col("fold").cast("long"))
    return audits.rule_summary(rows, rules, ["dataset", "target", "protocol"])


@query(
    "loso_rules",
    f"""WITH {NATION_LOSO_SQL} SELECT subject_key, fold, split, test_subject FROM roles""",
)
def _loso_rules(spark, sf):
    return folds.subject_rules(folds.subject_circle(nation_rated(spark, sf), SEED))


@query(
    "loso_assignments",
    f"""WITH {NATION_LOSO_SQL}
SELECT row_index, fold, split, target_label FROM ordered JOIN roles USING (subject_key)""",
)
def _loso_rows(spark, sf):
    return nation_loso_rows(spark, sf).select("row_index", "fold", "split", "target_label")


@query(
    "loso_fold_composition",
    f"""WITH {RATING_SQL}, {circle_sql('manifest')}, {roles_sql(LOSO_VAL)},
counts AS (SELECT subject_key, target_label, count(*) AS n FROM manifest GROUP BY ALL)
SELECT fold, test_subject AS subject_key, target_label,
       CAST(coalesce(sum(n) FILTER (split = 'test'), 0) AS BIGINT) AS test,
       CAST(coalesce(sum(n) FILTER (split = 'val'), 0) AS BIGINT) AS val,
       CAST(coalesce(sum(n) FILTER (split = 'train'), 0) AS BIGINT) AS train
FROM roles JOIN counts USING (subject_key) GROUP BY fold, test_subject, target_label""",
)
def _loso_composition(spark, sf):
    rows = rated(spark, sf)
    return folds.fold_composition(rows, folds.subject_circle(rows, SEED), ["target_label"])


@query(
    "subject_stimulus_holdout",
    f"WITH {STIMULUS_SQL} SELECT row_index, protocol, fold, split FROM assigned",
)
def _stimulus_rows(spark, sf):
    return stimulus_rows(spark, sf).select("row_index", "protocol", "fold", "split")


STIMULUS_COUNTS_SQL = f"""{RATING_SQL}, {circle_sql('manifest')}, {roles_sql(STIMULUS_VAL)},
conditions AS (
  SELECT 'loso_stimulus_heldout' AS protocol, 0 AS shift UNION ALL SELECT 'loso_stimulus_seen', 1),
counts AS (SELECT subject_key, target_label, stimulus_group, count(*) AS n FROM manifest GROUP BY ALL),
composed AS (
  SELECT protocol, fold, target_label,
       CAST(coalesce(sum(n) FILTER (split = 'test' AND stimulus_group = (fold - 1) % 3), 0) AS BIGINT) AS test,
       CAST(coalesce(sum(n) FILTER (split = 'val' AND stimulus_group <> ((fold - 1) % 3 + shift) % 3), 0) AS BIGINT) AS val,
       CAST(coalesce(sum(n) FILTER (split = 'train' AND stimulus_group <> ((fold - 1) % 3 + shift) % 3), 0) AS BIGINT) AS train
  FROM roles JOIN counts USING (subject_key), conditions GROUP BY protocol, fold, target_label)"""


@query("subject_stimulus_composition", f"WITH {STIMULUS_COUNTS_SQL} SELECT * FROM composed")
def _stimulus_composition(spark, sf):
    rows = rated(spark, sf)
    return folds.stimulus_composition(rows, folds.subject_circle(rows, SEED), 3)


@query(
    "stimulus_training_ratios",
    f"""WITH {STIMULUS_COUNTS_SQL},
pairs AS (
  SELECT fold, target_label, CAST(sum(train) FILTER (protocol = 'loso_stimulus_seen') AS BIGINT) AS seen,
         CAST(sum(train) FILTER (protocol = 'loso_stimulus_heldout') AS BIGINT) AS held FROM composed GROUP BY fold, target_label),
gaps AS (
  SELECT *, abs(seen / sum(seen) OVER (PARTITION BY fold) - held / sum(held) OVER (PARTITION BY fold)) AS gap FROM pairs)
SELECT fold, CAST(sum(seen) AS BIGINT) AS train_seen, CAST(sum(held) AS BIGINT) AS train_heldout,
       round(sum(held) / sum(seen), 6) AS ratio_heldout_to_seen,
       CAST(sum(least(seen, held)) AS BIGINT) AS train_matched, round(max(gap), 6) AS class_share_diff
FROM gaps GROUP BY fold""",
)
def _stimulus_ratios(spark, sf):
    rows = rated(spark, sf)
    comp = folds.stimulus_composition(rows, folds.subject_circle(rows, SEED), 3)
    out = sampling.condition_ratios(comp, folds.HELD_OUT, folds.SEEN)
    return out.withColumn("ratio_heldout_to_seen", F.round("ratio_heldout_to_seen", 6)).withColumn(
        "class_share_diff", F.round("class_share_diff", 6)
    )


MATCH_SQL = f"""{STIMULUS_SQL},
counts AS (SELECT protocol, fold, split, target_label, count(*) AS n FROM assigned WHERE split <> 'test' GROUP BY ALL),
quotas AS (
  SELECT fold, split, target_label, CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS quota FROM counts GROUP BY ALL),
placed AS (
  SELECT a.*, row_number() OVER (PARTITION BY protocol, fold, split, target_label
                                 ORDER BY
         (CAST('0x' || substr(md5('{SEED}:' || row_index), 1, 8) AS BIGINT) + fold * 2654435761) % 4294967296, row_index) AS place
  FROM assigned a WHERE split <> 'test'),
matched AS (
  SELECT protocol, fold, split, target_label, row_index FROM placed JOIN quotas USING (fold, split, target_label)
  WHERE place <= quota
  UNION ALL SELECT protocol, fold, split, target_label, row_index FROM assigned WHERE split = 'test')"""


@query("matched_conditions", f"WITH {MATCH_SQL} SELECT protocol, fold, split, row_index FROM matched")
def _matched(spark, sf):
    rows = nation_rated(spark, sf)
    return matching.match_rows(rows, folds.subject_circle(rows, SEED), 3, SEED).select("protocol", "fold", "split", "row_index")


@query(
    "matching_report",
    f"""WITH {MATCH_SQL},
hist AS (SELECT protocol, fold, split, target_label, count(*) AS n FROM assigned WHERE split <> 'test' GROUP BY ALL)
SELECT protocol, fold, split, CAST(sum(n) AS BIGINT) AS rows_original,
       '{{' || string_agg('"' || target_label || '":' || n, ',' ORDER BY target_label) || '}}' AS classes_original,
       CAST(sum(quota) AS BIGINT) AS rows_matched
FROM hist JOIN quotas USING (fold, split, target_label) GROUP BY protocol, fold, split""",
)
def _matching_report(spark, sf):
    rows = nation_rated(spark, sf)
    counts = settle(matching.matching_counts(rows, folds.subject_circle(rows, SEED), 3))
    original = sampling.class_histograms(counts, ["protocol", "fold", "split"])
    matched = sampling.matching_quotas(counts).groupBy("fold", "split").agg(F.sum("quota").alias("rows_matched"))
    return original.join(matched, ["fold", "split"]).select(
        "protocol", "fold", "split", F.col("rows").alias("rows_original"),
        F.col("classes").alias("classes_original"), "rows_matched",
    )


# -- samples ----------------------------------------------------------------------------


@query(
    "balanced_row_cap",
    f"""WITH {CODED_SQL},
sizes AS (SELECT target_label, count(*) AS n FROM coded_keys GROUP BY ALL),
plan AS (SELECT count(*) AS k, sum(n) AS total FROM sizes),
placed AS (
  SELECT c.*, row_number() OVER (PARTITION BY target_label ORDER BY md5('{SEED}:' || row_index), row_index) AS place FROM coded_keys c),
first AS (SELECT row_index, target_label FROM placed, plan WHERE place <= CASE WHEN total <= 3001 THEN total ELSE 3001 // k END),
rest AS (
  SELECT row_index, target_label,
         row_number() OVER (ORDER BY md5('{SEED + 1}:' || row_index), row_index) AS place
  FROM coded_keys WHERE row_index NOT IN (SELECT row_index FROM first))
SELECT row_index, target_label FROM first
UNION ALL SELECT row_index, target_label FROM rest WHERE place <= 3001 - (SELECT count(*) FROM first)""",
)
def _balanced_cap(spark, sf):
    return sampling.balanced_cap(coded(spark, sf), 3001, SEED).select("row_index", "target_label")


@query(
    "probe_sample",
    f"""WITH {RATING_SQL},
big AS (SELECT subject_key, count(*) AS n FROM manifest GROUP BY ALL HAVING count(*) >= 50),
kept AS (SELECT m.row_index, m.subject_key FROM manifest m JOIN big USING (subject_key)),
plan AS (SELECT count(*) AS k, sum(n) AS total FROM big),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY subject_key ORDER BY md5('{SEED}:' || row_index), row_index) AS place FROM kept),
first AS (
  SELECT row_index, subject_key FROM placed, plan
  WHERE place <= CASE WHEN total <= 8000 THEN total ELSE greatest(50, 8000 // k) END),
trimmed AS (
  SELECT *, row_number() OVER (ORDER BY md5('{SEED + 2}:' || row_index), row_index) AS place FROM first),
rest AS (
  SELECT *, row_number() OVER (ORDER BY md5('{SEED + 1}:' || row_index), row_index) AS place
  FROM kept WHERE row_index NOT IN (SELECT row_index FROM first))
SELECT row_index, subject_key FROM trimmed WHERE place <= 8000
UNION ALL SELECT row_index, subject_key FROM rest WHERE place <= 8000 - (SELECT count(*) FROM first)""",
)
def _probe_sample(spark, sf):
    return sampling.probe_sample(rated(spark, sf), "subject_key", 8000, SEED, 50).select("row_index", "subject_key")


@query(
    "subject_resplit",
    f"""WITH {NATION_LOSO_SQL},
pool AS (
  SELECT fold, subject_key, row_number() OVER (PARTITION BY fold ORDER BY md5(({SEED} + fold) || ':' || subject_key), subject_key) AS place,
         count(*) OVER (PARTITION BY fold) AS n
  FROM roles WHERE split <> 'test')
SELECT fold, subject_key, CASE WHEN place <= least(2, n - 1) THEN 'val' ELSE 'train' END AS split FROM pool""",
)
def _subject_resplit(spark, sf):
    # Roles of subjects, not of rows: the re-split is a fact of entities.
    rules = folds.subject_rules(folds.subject_circle(nation_rated(spark, sf), SEED))
    return sampling.resplit_subjects(rules, SEED, 2)


@query(
    "source_subject_holdout",
    f"""WITH {RATING_SQL}, s AS (SELECT DISTINCT subject_key FROM manifest),
placed AS (
  SELECT subject_key, row_number() OVER (ORDER BY md5('{SEED}:' || subject_key), subject_key) AS place, count(*) OVER () AS n FROM s)
SELECT subject_key, CASE WHEN place <= greatest(1, least(round_even(n * 0.15, 0), n - 1)) THEN 'val' ELSE 'train' END AS split FROM placed""",
)
def _subject_holdout(spark, sf):
    return sampling.subject_holdout(rated(spark, sf), SEED, 0.15)


@query(
    "window_random_holdout",
    f"""WITH {CODED_SQL},
placed AS (
  SELECT row_index, target_label, row_number() OVER (PARTITION BY target_label ORDER BY md5('{SEED}:' || row_index), row_index) AS place
  FROM coded_keys),
sizes AS (SELECT target_label, count(*) AS n FROM coded_keys GROUP BY ALL),
shares AS (
  SELECT *, sum(n) OVER () - CAST(ceil(sum(n) OVER () * 0.2) AS BIGINT) AS want, sum(n) OVER () AS total FROM sizes),
floors AS (
  SELECT *, floor(n * want / total) AS low,
         row_number() OVER (ORDER BY n * want / total - floor(n * want / total) DESC, target_label) AS pick FROM shares),
quotas AS (
  SELECT target_label, n - low - CASE WHEN pick <= want - sum(low) OVER () THEN 1 ELSE 0 END AS n_test FROM floors)
SELECT row_index, target_label, CASE WHEN place <= n_test THEN 'test' ELSE 'train' END AS split
FROM placed JOIN quotas USING (target_label)""",
)
def _window_random(spark, sf):
    return sampling.stratified_holdout(coded(spark, sf), SEED, "target_label")


@query(
    "first_rows_and_folds",
    f"""WITH {NATION_LOSO_SQL},
kept AS (SELECT o.row_index, r.fold, r.split FROM ordered o JOIN roles r USING (subject_key) WHERE r.fold <= 3)
SELECT fold, split, count(*) AS n, min(row_index) AS first_row, max(row_index) AS last_row FROM kept GROUP BY ALL""",
)
def _first_folds(spark, sf):
    return (
        sampling.first_folds(nation_loso_rows(spark, sf), 3)
        .groupBy("fold", "split")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"))
    )


# -- probe splits -----------------------------------------------------------------------


def crc32_sql(text: str) -> str:
    """CRC-32 of a text in SQL."""
    return (
        f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), "
        "lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
    )


def within_class_sql(label: str, source: str = "manifest") -> str:
    return f"""pairs AS (SELECT DISTINCT trial_key, {label} AS label FROM {source}),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {crc32_sql(f"'{SEED}:' || trial_key")}, trial_key) AS place,
         count(*) OVER (PARTITION BY label) AS n FROM pairs),
sides AS (
  SELECT trial_key, label, CASE WHEN n < 2 THEN NULL
         WHEN place <= greatest(1, least(round_even(n * 0.3, 0), n - 1)) THEN 'test' ELSE 'train' END AS side FROM placed)"""


BY_SUBJECT_SQL = f"""subjects AS (SELECT DISTINCT subject_key FROM manifest),
placed AS (
  SELECT *, row_number() OVER (ORDER BY {crc32_sql(f"'{SEED}:' || subject_key")}, subject_key) AS place, count(*) OVER () AS n
  FROM subjects),
held AS (SELECT subject_key, place <= least(greatest(1, round_even(n * 0.3, 0)), n - 1) AS test FROM placed),
pairs AS (SELECT DISTINCT subject_key, stimulus_key AS label FROM manifest),
shared AS (SELECT label FROM pairs JOIN held USING (subject_key) GROUP BY label HAVING min(test) <> max(test)),
sides AS (
  SELECT subject_key, label, CASE WHEN label NOT IN (SELECT label FROM shared) THEN NULL WHEN test THEN 'test' ELSE 'train' END AS side
  FROM pairs JOIN held USING (subject_key))"""


@query(
    "probe_group_order",
    f"""WITH {RATING_SQL}, g AS (SELECT DISTINCT subject_key FROM manifest)
SELECT subject_key, {crc32_sql(f"'{SEED}:' || subject_key")} AS crc FROM g""",
)
def _group_order(spark, sf):
    from plumbline.functions.hashing import crc_order

    return rated(spark, sf).select("subject_key").distinct().withColumn("crc", crc_order(SEED, "subject_key"))


@query("probe_within_class_split", f"WITH {RATING_SQL}, {within_class_sql('subject_key')} SELECT trial_key, label AS subject_key, side FROM sides")
def _within_class(spark, sf):
    return probe_splits.within_class_split(rated(spark, sf), "subject_key", SEED)


@query("probe_subject_holdout_split", f"WITH {RATING_SQL}, {BY_SUBJECT_SQL} SELECT subject_key, label AS stimulus_key, side FROM sides")
def _by_subject(spark, sf):
    return probe_splits.by_subject_split(rated(spark, sf), "stimulus_key", SEED)


def _report_sql(query_name: str, split: str, unit: str) -> str:
    return f"""SELECT '{query_name}' AS probe_query, '{split}' AS probe_split,
  (SELECT count(DISTINCT label) FROM sides WHERE side IS NOT NULL) AS n_eligible_classes,
  (SELECT count(DISTINCT label) FROM sides) - (SELECT count(DISTINCT label) FROM sides WHERE side IS NOT NULL) AS n_skipped_classes,
  (SELECT count(DISTINCT {unit}) FROM sides WHERE side = 'train') AS n_train_groups,
  (SELECT count(DISTINCT {unit}) FROM sides WHERE side = 'test') AS n_test_groups,
  CASE WHEN (SELECT count(DISTINCT label) FROM sides WHERE side IS NOT NULL) >= 2 THEN 'OK' ELSE 'NOT_ESTIMABLE' END AS status"""


@query(
    "probe_split_reports",
    f"""(WITH {RATING_SQL}, {within_class_sql('subject_key')} {_report_sql('subject_key', 'within_class_groups', 'trial_key')})
UNION ALL (WITH {RATING_SQL}, {BY_SUBJECT_SQL} {_report_sql('stimulus_key', 'subject_holdout', 'subject_key')})
UNION ALL (WITH {CODED_SQL}, {within_class_sql('session_key', 'coded_keys')} {_report_sql('session_key', 'within_class_groups', 'trial_key')})
UNION ALL (WITH {RATING_SQL}, {within_class_sql("'all'")} {_report_sql('everything', 'within_class_groups', 'trial_key')})""",
)
def _reports(spark, sf):
    rows, codes = rated(spark, sf), coded(spark, sf)
    constant = rows.withColumn("everything", F.lit("all"))
    asked = [(rows, "subject_key"), (rows, "stimulus_key"), (codes, "session_key"), (constant, "everything")]
    reports = []
    for meta, label in asked:
        reports.append(probe_splits.split_report(probe_splits.probe_sides(meta, label, SEED), label))
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


# -- audits -----------------------------------------------------------------------------


@query(
    "row_audit",
    f"""WITH {SEGMENT_SQL}, copies AS (SELECT fold, row_index, count(*) AS c FROM assigned GROUP BY ALL)
SELECT CAST(fold AS BIGINT) AS fold, count(*) AS n_rows, count(*) FILTER (c > 1) AS n_repeated,
       (SELECT count(*) FROM manifest) - count(*) AS n_missing FROM copies GROUP BY fold""",
)
def _row_audit(spark, sf):
    n = rated(spark, sf).agg(F.count(F.lit(1))).scalar()
    assigned = segment_rows(spark, sf).withColumn("fold", F.col("fold").cast("long"))
    copies = audits.row_audit(assigned)
    return copies.withColumn("n_missing", n - F.col("n_rows"))


@query(
    "leakage_by_entity",
    f"""WITH {SEGMENT_SQL}, rows AS (SELECT a.fold, a.split, m.* FROM assigned a JOIN manifest m USING (row_index)),
long AS (
  SELECT fold, split, 'trial_key' AS kind, trial_key AS entity FROM rows
  UNION ALL SELECT fold, split, 'subject_key', subject_key FROM rows
  UNION ALL SELECT fold, split, 'stimulus_key', stimulus_key FROM rows),
places AS (
  SELECT fold, kind, entity, bool_or(split = 'test') AS t, bool_or(split <> 'test') AS f FROM long GROUP BY ALL)
SELECT CAST(fold AS BIGINT) AS fold, count(*) FILTER (kind = 'trial_key' AND t AND f) AS leaked_trial_key,
       count(*) FILTER (kind = 'subject_key' AND t AND f) AS leaked_subject_key,
       count(*) FILTER (kind = 'stimulus_key' AND t AND f) AS leaked_stimulus_key
FROM places GROUP BY fold""",
)
def _leakage(spark, sf):
    rows = segment_rows(spark, sf, "trial_key", "subject_key", "stimulus_key")
    return audits.leak_counts(
        rows.withColumn("fold", F.col("fold").cast("long")), ["trial_key", "subject_key", "stimulus_key"]
    )


@query(
    "trial_leaks",
    f"""WITH {SEGMENT_SQL}
SELECT CAST(fold AS BIGINT) AS fold, trial_key FROM assigned JOIN manifest USING (row_index)
GROUP BY fold, trial_key HAVING bool_or(split = 'test') AND bool_or(split <> 'test')""",
)
def _trial_leaks(spark, sf):
    rows = segment_rows(spark, sf, "trial_key")
    return audits.leaks(rows, "trial_key").withColumn("fold", F.col("fold").cast("long"))


@query(
    "subject_leaks_of_trial_folds",
    f"""WITH {TRIAL_SQL}
SELECT CAST(fold AS BIGINT) AS fold, subject_key FROM manifest JOIN rules USING (trial_key)
GROUP BY fold, subject_key HAVING bool_or(split = 'test') AND bool_or(split <> 'test')""",
)
def _subject_leaks(spark, sf):
    rows = folds.assign_rows(rated(spark, sf).select("trial_key", "subject_key"), trial_rules(spark, sf), ["trial_key"])
    return audits.leaks(rows, "subject_key").withColumn("fold", F.col("fold").cast("long"))


@query(
    "stimulus_leaks_and_coverage",
    f"""WITH {STIMULUS_SQL},
places AS (
  SELECT protocol, fold, stimulus_key, bool_or(split = 'test') AS t, bool_or(split <> 'test') AS f FROM assigned GROUP BY ALL)
SELECT protocol, fold, count(*) FILTER (t AND f) AS shared, count(*) FILTER (t AND NOT f) AS uncovered FROM places GROUP BY ALL""",
)
def _stimulus_audit(spark, sf):
    rows = nation_rated(spark, sf)
    met = rows.select("subject_key", "stimulus_key", "stimulus_group").distinct()
    return folds.stimulus_sides(met, folds.subject_circle(rows, SEED), 3).groupBy("protocol", "fold").agg(
        F.count_if(F.col("in_test") & F.col("in_fit")).alias("shared"),
        F.count_if(F.col("in_test") & ~F.col("in_fit")).alias("uncovered"),
    )


@query(
    "condition_audit",
    f"""WITH {MATCH_SQL},
classes AS (SELECT protocol, fold, split, target_label, count(*) AS n FROM matched WHERE split <> 'test' GROUP BY ALL),
unequal AS (SELECT fold FROM classes GROUP BY fold, split, target_label HAVING min(n) <> max(n) OR count(*) <> 2),
tests AS (
  SELECT fold FROM (SELECT DISTINCT protocol, fold, row_index FROM matched WHERE split = 'test')
  GROUP BY fold, row_index HAVING count(*) <> 2)
SELECT (SELECT count(*) FROM tests) AS test_rows_differ, (SELECT count(*) FROM unequal) AS classes_differ,
       (SELECT count(*) FROM matched) AS n_rows""",
)
def _condition_audit(spark, sf):
    rows = nation_rated(spark, sf)
    return matching.match_audit(rows, folds.subject_circle(rows, SEED), 3, SEED)


@query(
    "split_summary",
    f"""WITH {NATION_LOSO_SQL}
SELECT 'dreamer' AS dataset, 'valence' AS target, 'leave_one_subject_out' AS protocol, fold, split, count(*) AS chunks,
       count(DISTINCT subject_key) AS subjects, count(DISTINCT trial_key) AS trials, count(DISTINCT target_label) AS classes
FROM ordered JOIN roles USING (subject_key) GROUP BY fold, split""",
)
def _split_summary(spark, sf):
    rows = nation_rated(spark, sf)
    counts = folds.fold_composition(folds.entity_counts(rows), folds.subject_circle(rows, SEED), ["kind", "value"], n="n")
    named = {"dataset": F.lit("dreamer"), "target": F.lit("valence"), "protocol": F.lit("leave_one_subject_out")}
    return audits.composed_summary(counts, ["fold"]).withColumns(named)


@query(
    "test_support_pivot",
    f"""WITH {STIMULUS_SQL}
SELECT fold, count(*) FILTER (target_label = 'high_valence') AS high_valence,
       count(*) FILTER (target_label = 'low_valence') AS low_valence
FROM assigned WHERE split = 'test' AND protocol = 'loso_stimulus_seen' GROUP BY fold""",
)
def _test_support(spark, sf):
    rows = nation_rated(spark, sf)
    seen = folds.stimulus_composition(rows, folds.subject_circle(rows, SEED), 3).where(F.col("protocol") == folds.SEEN)
    tested = seen.where("test > 0").groupBy("fold").pivot("target_label", ["high_valence", "low_valence"]).agg(F.sum("test"))
    return tested.fillna(0, ["high_valence", "low_valence"])


@query(
    "test_support_report",
    f"""WITH {NATION_LOSO_SQL}, a AS (SELECT * FROM ordered JOIN roles USING (subject_key)),
per AS (
  SELECT fold, count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split = 'train') AS train_rows,
         count(DISTINCT trial_key) FILTER (split = 'test') AS test_trials,
         count(DISTINCT target_label) FILTER (split = 'test') AS test_classes FROM a GROUP BY fold)
SELECT count(*) AS n_folds, count(*) FILTER (test_classes < 2) AS folds_missing_class, min(test_rows) AS min_test_rows,
       min(test_trials) AS min_test_trials, round(avg(train_rows), 6) AS mean_train_rows FROM per""",
)
def _support_report(spark, sf):
    rows = nation_rated(spark, sf)
    counts = folds.fold_composition(folds.entity_counts(rows), folds.subject_circle(rows, SEED), ["kind", "value"], n="n")
    out = audits.composed_support(audits.composed_summary(counts, ["fold"]), 2)
    return out.withColumn("mean_train_rows", F.round("mean_train_rows", 6))


# -- permutations -----------------------------------------------------------------------


@query(
    "segment_shuffle_within_trials",
    f"""WITH {RATING_SQL},
seg AS (SELECT row_index, trial_key, row_number() OVER (PARTITION BY trial_key ORDER BY row_index) - 1 AS segment_id FROM manifest),
a AS (SELECT *, row_number() OVER (PARTITION BY trial_key ORDER BY segment_id, row_index) AS p,
             row_number() OVER (PARTITION BY trial_key ORDER BY md5('{SEED}:' || row_index), row_index) AS h FROM seg)
SELECT x.row_index, x.trial_key, y.segment_id FROM a x JOIN a y ON x.trial_key = y.trial_key AND x.h = y.p""",
)
def _segment_shuffle(spark, sf):
    from plumbline.operators.windows import sequence_number

    rows = rated(spark, sf).select("row_index", "trial_key")
    numbered = sequence_number(rows, ["trial_key"], ["row_index"], "segment_id")
    return shuffles.shuffle_segments(numbered, ["trial_key"], "segment_id", SEED)


@query(
    "permuted_training_labels",
    f"""WITH RECURSIVE {SEGMENT_SQL},
train AS (SELECT fold, row_index, target_label FROM assigned JOIN manifest USING (row_index) WHERE split = 'train'),
turned AS (
  SELECT fold, p AS permutation, row_index, target_label, '{SEED}/' || fold || '/' || p AS perm_key, count(*) OVER (PARTITION BY fold, p) AS n,
         row_number() OVER (PARTITION BY fold, p ORDER BY md5('{SEED}:' || row_index), row_index) - 1 AS place
  FROM train, range(0, 2) r(p)),
{permuted_sql('turned', 'placed')},
blocks AS (
  SELECT fold, target_label AS permuted_label, sum(count(*)) OVER (PARTITION BY fold ORDER BY target_label) AS upto,
         sum(count(*)) OVER (PARTITION BY fold ORDER BY target_label) - count(*) AS before
  FROM train GROUP BY fold, target_label)
SELECT CAST(placed.fold AS BIGINT) AS fold, permutation, row_index, target_label, permuted_label
FROM placed JOIN blocks ON placed.fold = blocks.fold AND landed >= before AND landed < upto""",
)
def _permuted(spark, sf):
    rows = segment_rows(spark, sf, "target_label").where(F.col("split") == "train")
    out = shuffles.permute_labels(rows, 2, SEED)
    return out.withColumn("fold", F.col("fold").cast("long")).withColumn(
        "permutation", F.col("permutation").cast("long")
    )
