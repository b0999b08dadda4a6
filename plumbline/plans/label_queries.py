"""Keys, ratings and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import keys, labels, ratings
from plumbline.operators.audits import keyed_join_audit
from plumbline.plans.bindings import (
    CODED_SQL,
    ORDERS_SQL,
    RATING_SQL,
    coded,
    coded_manifest,
    nation_rated,
    orders_manifest,
    rated,
    rating_manifest,
    table,
)
from plumbline.plans.catalog import query

def count_rows():
    return F.count(F.lit(1))


@query(
    "standardized_keys",
    f"""WITH {RATING_SQL}
SELECT row_index, subject_key, session_key, trial_key,
       'dreamer::' || subject_key || '::' || trial_key || '::' || clip_id || '::' || row_index AS chunk_id FROM manifest""",
)
def _keys(spark, sf):
    return keys.with_keys(rating_manifest(spark, sf), "dreamer").select(
        "row_index", "subject_key", "session_key", "trial_key", "chunk_id"
    )


@query(
    "standardized_keys_with_sessions",
    f"""WITH {CODED_SQL}
SELECT row_index, subject_key, session_key, trial_key, target_label,
       'seed_iv::' || subject_key || '::' || trial_key || '::' || clip_id || '::' || row_index AS chunk_id FROM coded_keys""",
)
def _session_keys(spark, sf):
    return coded(spark, sf).select("row_index", "subject_key", "session_key", "trial_key", "target_label", "chunk_id")


@query(
    "stimulus_groups",
    f"""WITH {RATING_SQL} SELECT stimulus_key, stimulus_group, count(*) AS n_rows FROM manifest GROUP BY ALL""",
)
def _stimulus(spark, sf):
    return rated(spark, sf).groupBy("stimulus_key", "stimulus_group").agg(count_rows().alias("n_rows"))


@query(
    "stimulus_groups_by_class_rank",
    f"""WITH {CODED_SQL},
clips AS (SELECT DISTINCT session_id, trial_id, emotion FROM coded_keys),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, emotion ORDER BY trial_id) - 1 AS stimulus_group FROM clips)
SELECT 's' || session_id || '_t' || trial_id AS stimulus_key, stimulus_group, target_label, count(*) AS n_rows
FROM coded_keys JOIN ranked USING (session_id, trial_id, emotion) GROUP BY ALL""",
)
def _stimulus_rank(spark, sf):
    return coded(spark, sf).groupBy("stimulus_key", "stimulus_group", "target_label").agg(count_rows().alias("n_rows"))


@query(
    "stimulus_from_trial_key",
    f"""WITH {CODED_SQL}
SELECT 'trial_' || regexp_extract(trial_key, 'trial_(\\d+)$', 1) AS stimulus,
       session_key || '::trial_' || regexp_extract(trial_key, 'trial_(\\d+)$', 1) AS session_stimulus, count(*) AS n_rows
FROM coded_keys GROUP BY ALL""",
)
def _stimulus_regex(spark, sf):
    return (
        coded(spark, sf)
        .groupBy(
            keys.stimulus_from_trial("trial_key").alias("stimulus"),
            keys.stimulus_from_trial("trial_key", "session_key").alias("session_stimulus"),
        )
        .agg(count_rows().alias("n_rows"))
    )


# -- ratings ----------------------------------------------------------------------------


def _scored_documents(spark, sf):
    """``documents`` enriched with ``labels``, which covers only some of them."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.lit(-1).alias("quality"))
    scores = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("q"), "toxic")
    return ratings.enrich(docs, scores, ["doc_id"], {"quality": "q"}, "labels_table")


@query(
    "rating_enrichment",
    """SELECT d.doc_id, d.source, -1 AS quality_preprocessed, l.quality AS quality, 'labels_table' AS rating_source
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _enrichment(spark, sf):
    return _scored_documents(spark, sf)


@query(
    "rating_enrichment_audit",
    """SELECT count(*) AS n_rows, count(*) FILTER (l.doc_id IS NULL) AS n_unmatched,
       (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)) AS n_duplicate_keys
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _enrichment_audit(spark, sf):
    copies = ratings.duplicate_keys(table(spark, sf, "labels"), ["doc_id"]).agg(count_rows()).scalar()
    return ratings.enrichment_audit(_scored_documents(spark, sf), "quality").withColumn("n_duplicate_keys", copies)


@query(
    "rating_table_keys",
    """SELECT s_suppkey, printf('s%02d.dat', s_suppkey) AS subject_id, CAST(s_nationkey AS BIGINT) - 1 AS trial_id FROM supplier""",
)
def _rating_keys(spark, sf):
    out = ratings.rating_keys(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey")
    return out.select("s_suppkey", "subject_id", "trial_id")


@query(
    "tolerance_cross_check",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * p_retailprice, 6) AS derived, l_extendedprice
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE abs(l_quantity * p_retailprice - l_extendedprice) > 0.011 + 1e-5 * abs(l_extendedprice)""",
)
def _tolerance(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    joined = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    off = ratings.out_of_tolerance(
        joined.withColumn("derived", F.col("l_quantity") * F.col("p_retailprice")), "derived", "l_extendedprice"
    )
    return off.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("derived", 6).alias("derived"), "l_extendedprice"
    )


@query(
    "rating_provenance",
    f"""WITH {ORDERS_SQL},
trials AS (SELECT subject_id, trial_id, arg_min(valence, row_index) AS valence, arg_min(arousal, row_index) AS arousal
           FROM ordered GROUP BY ALL)
SELECT count(*) AS n_trials, min(valence) AS valence_min, max(valence) AS valence_max,
       round(avg(CASE WHEN valence > 3 THEN 1.0 ELSE 0.0 END), 6) AS high_valence_fraction,
       min(arousal) AS arousal_min, max(arousal) AS arousal_max,
       round(avg(CASE WHEN arousal > 3 THEN 1.0 ELSE 0.0 END), 6) AS high_arousal_fraction
FROM trials""",
)
def _provenance(spark, sf):
    trials = keys.distinct_trials(orders_manifest(spark, sf), ["subject_id", "trial_id"], ["valence", "arousal"])
    out = ratings.provenance(trials, ["valence", "arousal"], 3.0)
    for c in ("high_valence_fraction", "high_arousal_fraction"):
        out = out.withColumn(c, F.round(c, 6))
    return out


# -- labels -----------------------------------------------------------------------------


@query(
    "binary_labels",
    """SELECT event_id AS row_index, 'dreamer_valence_gt3_tie_low_v1' AS label_policy_id,
       CASE WHEN floor(value / 10) > 3 THEN 'high_valence' ELSE 'low_valence' END AS target_label FROM events""",
)
def _binary(spark, sf):
    rows = labels.with_labels(rating_manifest(spark, sf), "dreamer", "valence")
    return rows.select("row_index", "label_policy_id", "target_label")


@query(
    "tie_high_labels",
    """SELECT event_id AS row_index, 'dreamer_valence_gt3_tie_high_v1' AS label_policy_id,
       CASE WHEN floor(value / 10) >= 3 THEN 'high_valence' ELSE 'low_valence' END AS target_label FROM events""",
)
def _tie_high(spark, sf):
    rows = labels.with_labels(rating_manifest(spark, sf), "dreamer", "valence", labels.TIE_HIGH)
    return rows.select("row_index", "label_policy_id", "target_label")


@query(
    "exclude_ties_labels",
    """SELECT event_id AS row_index, 'dreamer_valence_gt3_ties_excluded_v1' AS label_policy_id,
       CASE WHEN floor(value / 10) > 3 THEN 'high_valence' ELSE 'low_valence' END AS target_label
FROM events WHERE floor(value / 10) <> 3""",
)
def _exclude(spark, sf):
    rows = labels.with_labels(rating_manifest(spark, sf), "dreamer", "valence", labels.EXCLUDE_TIES)
    return rows.select("row_index", "label_policy_id", "target_label")


@query(
    "categorical_labels",
    f"WITH {CODED_SQL} SELECT row_index, emotion, target_label FROM coded_keys",
)
def _categorical(spark, sf):
    return labels.with_labels(coded_manifest(spark, sf), "seed_iv", "emotion").select(
        "row_index", "emotion", "target_label"
    )


@query(
    "unknown_and_invalid_codes",
    """SELECT count(*) AS n_rows, count(*) FILTER (l_quantity IS NULL) AS n_missing,
       count(*) FILTER (l_quantity / 4 <> floor(l_quantity / 4)) AS n_non_integer,
       count(*) FILTER (l_quantity / 4 <> floor(l_quantity / 4) OR l_quantity / 4 > 3) AS n_unknown_code,
       CAST(0 AS BIGINT) AS n_unverified_source FROM lineitem""",
)
def _unknown(spark, sf):
    codes = table(spark, sf, "lineitem").select((F.col("l_quantity") / 4).alias("emotion"))
    return labels.source_audit(codes, "seed_iv", "emotion")


@query(
    "labels_of_missing_ratings",
    """WITH planted AS (SELECT doc_id AS row_index, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'NaN'::DOUBLE ELSE CAST(doc_id % 7 AS DOUBLE) END AS valence FROM documents)
SELECT row_index,
       CASE WHEN valence IS NULL OR isnan(valence) THEN NULL WHEN valence > 3 THEN 'high_valence' ELSE 'low_valence' END AS primary_label,
       CASE WHEN valence IS NULL OR isnan(valence) THEN NULL WHEN valence >= 3 THEN 'high_valence' ELSE 'low_valence' END AS tie_high_label,
       CASE WHEN valence IS NULL OR isnan(valence) OR valence = 3 THEN NULL WHEN valence > 3 THEN 'high_valence' ELSE 'low_valence' END AS exclude_ties_label
FROM planted""",
)
def _missing_ratings(spark, sf):
    """Planted null and NaN ratings have no label in any variant."""
    k = F.pmod("doc_id", F.lit(7))
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_index"), F.when(k == 0, None).when(k == 1, F.lit("NaN").cast("double")).otherwise(k.cast("double")).alias("valence")
    )
    return rows.select("row_index", *[labels.label_column(labels.policy("dreamer", "valence", v)).alias(f"{v}_label") for v in labels.VARIANTS])


@query(
    "policy_lookup",
    f"""WITH {RATING_SQL},
p(variant, policy_id) AS (VALUES ('primary', 'dreamer_valence_gt3_tie_low_v1'), ('tie_high', 'dreamer_valence_gt3_tie_high_v1'),
                          ('exclude_ties', 'dreamer_valence_gt3_ties_excluded_v1'))
SELECT variant, policy_id, 'high_valence,low_valence' AS classes, count(*) AS n_rows,
       count(*) FILTER (CASE variant WHEN 'tie_high' THEN valence >= 3 ELSE valence > 3 END) AS n_high,
       count(*) FILTER (variant = 'exclude_ties' AND valence = 3) AS n_removed
FROM manifest, p GROUP BY variant, policy_id""",
)
def _policies(spark, sf):
    """All variants of one (dataset, target) from the policy table, applied in one pass."""
    table_of_policies = labels.policy_table(spark).where("dataset = 'dreamer' and target = 'valence'")
    rows = rating_manifest(spark, sf).groupBy("valence").agg(count_rows().alias("n")).withColumn("dataset", F.lit("dreamer"))
    x, tau = F.col("valence"), F.col("threshold")
    high = F.when(F.col("variant") == labels.TIE_HIGH, x >= tau).otherwise(x > tau)
    removed = (F.col("variant") == labels.EXCLUDE_TIES) & (x == tau)
    joined = rows.join(F.broadcast(table_of_policies), "dataset")
    return joined.groupBy("variant", "policy_id", F.array_join("classes", ",").alias("classes")).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(high, F.col("n")).otherwise(0)).alias("n_high"),
        F.sum(F.when(removed, F.col("n")).otherwise(0)).alias("n_removed"),
    )


@query(
    "source_guard",
    """SELECT count(*) AS n_rows, count(*) FILTER (l.quality IS NULL) AS n_missing, CAST(0 AS BIGINT) AS n_non_integer, CAST(0 AS BIGINT) AS n_unknown_code,
       count(*) FILTER (d.source <> 'src0') AS n_unverified_source
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _guard(spark, sf):
    rows = (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id", "left")
        .select(
            F.col("quality").cast("double").alias("valence"),
            F.when(F.col("source") == "src0", labels.VERIFIED_SOURCE["deap"]).otherwise("other").alias("rating_source"),
        )
    )
    return labels.source_audit(rows, "deap", "valence")


@query(
    "split_contract_check",
    f"""WITH {RATING_SQL}
SELECT 'label_policy_id' AS "check", 'dreamer_valence_gt3_tie_high_v1' AS found, (SELECT count(*) FROM manifest) AS n_rows
UNION ALL SELECT 'target_label', 'high_arousal', (SELECT count(*) FROM manifest)
UNION ALL SELECT 'target_label', 'low_arousal', (SELECT count(*) FROM manifest)
UNION ALL SELECT 'target', 'arousal', (SELECT count(*) FROM manifest)""",
)
def _contract(spark, sf):
    """A table that mixes two targets and two tie rules is caught value by value."""
    base = rating_manifest(spark, sf)
    mixed = labels.with_labels(base, "dreamer", "valence").unionByName(
        labels.with_labels(base, "dreamer", "arousal").withColumn(
            "label_policy_id", F.lit(labels.policy("dreamer", "valence", labels.TIE_HIGH).policy_id)
        )
    )
    return labels.contract_audit(mixed, "dreamer", "valence").withColumn("n_rows", base.agg(count_rows()).scalar())


@query(
    "label_reverification",
    """WITH declared AS (
  SELECT event_id, CASE WHEN floor(value / 10) >= 3 THEN 'high_valence' ELSE 'low_valence' END AS label FROM events),
source AS (SELECT event_id, CASE WHEN floor(value / 10) > 3 THEN 'high_valence' ELSE 'low_valence' END AS label
           FROM events WHERE event_type <> 'error')
SELECT count(*) AS n_checked, count(*) FILTER (s.event_id IS NULL) AS n_missing,
       count(*) FILTER (s.label <> d.label) AS n_mismatched, 0 AS n_conflicting, 0 AS n_duplicate_source
FROM declared d LEFT JOIN source s USING (event_id)""",
)
def _recheck(spark, sf):
    base = rating_manifest(spark, sf)
    declared = labels.with_labels(base, "dreamer", "valence", labels.TIE_HIGH)
    return labels.label_recheck(declared, base.where(F.col("event_type") != "error"), "dreamer", "valence")


@query(
    "class_ids",
    f"""WITH {CODED_SQL}
SELECT target_label, CASE target_label WHEN 'fear' THEN 0 WHEN 'happy' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END AS class_id,
       count(*) AS n_rows FROM coded_keys GROUP BY ALL""",
)
def _class_ids(spark, sf):
    p = labels.policy("seed_iv", "emotion")
    rows = coded(spark, sf).groupBy("target_label").agg(count_rows().alias("n_rows"))
    return rows.withColumn("class_id", labels.class_id_column(p).cast("int"))


@query(
    "distinct_trials",
    f"""WITH {RATING_SQL}
SELECT subject_key, trial_key, arg_min(valence, row_index) AS valence, arg_min(arousal, row_index) AS arousal
FROM manifest GROUP BY subject_key, trial_key""",
)
def _trials(spark, sf):
    return keys.distinct_trials(rated(spark, sf), ["subject_key", "trial_key"], ["valence", "arousal"])


@query(
    "keyed_join_audit",
    """SELECT 0 AS n_duplicate_left, 0 AS n_duplicate_right, 0 AS n_missing_left,
       (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS n_missing_right,
       count(*) FILTER (l.quality <> CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END) AS n_label_mismatch, count(*) AS n_joined
FROM documents d JOIN labels l USING (doc_id)""",
)
def _keyed(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_index"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("label_id")
    )
    scores = table(spark, sf, "labels").select(F.col("doc_id").alias("row_index"), F.col("quality").alias("true_id"))
    return keyed_join_audit(docs, scores, label_pair=("label_id", "true_id"))


@query(
    "trial_label_consistency",
    f"""WITH {RATING_SQL}
SELECT trial_key, min(target_label) AS target_label, count(DISTINCT target_label) AS n_labels FROM manifest GROUP BY trial_key""",
)
def _trial_labels(spark, sf):
    return keys.trial_labels(rated(spark, sf), ["trial_key"])


@query(
    "mixed_label_trials",
    f"""WITH {RATING_SQL}
SELECT trial_key, min(target_label) AS lowest, max(target_label) AS highest FROM manifest
GROUP BY trial_key HAVING count(DISTINCT target_label) > 1""",
)
def _mixed(spark, sf):
    return keys.trial_label_audit(rated(spark, sf), ["trial_key"])


@query(
    "row_predicates",
    """SELECT event_type, count(*) AS n_rows, round(sum(value), 4) AS total FROM events
WHERE event_type IN ('click', 'error', 'view') AND value BETWEEN 10 AND 90 AND value IS NOT NULL AND value <> 0 AND NOT isnan(value)
GROUP BY event_type""",
)
def _predicates(spark, sf):
    x = F.col("value")
    kept = table(spark, sf, "events").where(
        F.col("event_type").isin("click", "error", "view") & x.between(10, 90) & x.isNotNull() & (x != 0) & ~F.isnan(x)
    )
    return kept.groupBy("event_type").agg(count_rows().alias("n_rows"), F.round(F.sum("value"), 4).alias("total"))
