import pytest
from pyspark.sql import functions as F

from plumbline.operators import keys, labels, ratings


def labelled(spark, values, variant, dataset="dreamer", target="arousal"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_index long, {target} double")
    out = df.withColumn("l", labels.label_column(labels.policy(dataset, target, variant)))
    return [r["l"] for r in out.orderBy("row_index").collect()]


def test_tie_rules(spark):
    high, low = "high_arousal", "low_arousal"
    values = [2.0, 3.0, 3.0, 4.0]
    assert labelled(spark, values, "primary") == [low, low, low, high]
    assert labelled(spark, values, "tie_high") == [low, high, high, high]
    assert labelled(spark, values, "exclude_ties") == [low, None, None, high]


@pytest.mark.parametrize("dataset,rating,expected", [("deap", 5.0, "low"), ("deap", 5.01, "high"), ("dreamer", 3.0, "low"), ("dreamer", 4.0, "high")])
def test_thresholds(spark, dataset, rating, expected):
    assert labelled(spark, [rating], "primary", dataset, "valence") == [f"{expected}_valence"]


def test_excluded_ties_keep_row_index(spark):
    df = spark.createDataFrame([(i, 0, i, "c", v) for i, v in enumerate([3.0, 3.0, 4.0, 1.0])], "row_index long, subject_id long, trial_id long, clip_id string, valence double")
    kept = keys.standardize(df, "dreamer", "valence", "exclude_ties").orderBy("row_index").collect()
    assert [r["row_index"] for r in kept] == [2, 3]
    assert kept[0]["subject_key"] == "s01" and kept[0]["chunk_id"].startswith("dreamer::s01::s01::session_1::trial_2")


def test_policy_ids():
    assert labels.policy("deap", "valence").policy_id == "deap_valence_gt5_tie_low_v2"
    assert labels.policy("deap", "valence", "tie_high").policy_id == "deap_valence_gt5_tie_low_v2_tie_high_v1"
    assert labels.policy("dreamer", "arousal", "exclude_ties").policy_id == "dreamer_arousal_gt3_ties_excluded_v1"
    assert labels.policy("seed_iv", "emotion").policy_id == "seed_iv_emotion_codes_v1"
    assert labels.class_ids(labels.policy("seed_iv", "emotion")) == {"fear": 0, "happy": 1, "neutral": 2, "sad": 3}
    for args in (("seed_iv", "emotion", "tie_high"), ("seed_iv", "valence"), ("deap", "emotion")):
        with pytest.raises(labels.ContractError):
            labels.policy(*args)


def test_invalid_sources_are_rejected(spark, manifest):
    labels.require_source(manifest, "deap", "valence")
    with pytest.raises(labels.ContractError):
        labels.require_source(manifest.withColumn("rating_source", F.lit("other")), "deap", "valence")
    with pytest.raises(labels.ContractError):
        labels.require_source(manifest.drop("rating_source"), "deap", "valence")
    with pytest.raises(labels.ContractError):
        labels.require_source(spark.sql("select cast(null as double) as valence"), "dreamer", "valence")
    for bad in ("7.0D", "1.5D"):
        with pytest.raises(labels.ContractError):
            labels.require_source(spark.sql(f"select {bad} as emotion"), "seed_iv", "emotion")


def test_missing_ratings_have_no_label(spark):
    rows = spark.sql("select * from values (1, cast(null as double)), (2, double('NaN')), (3, 3.0D), (4, 4.0D) t(row_index, valence)")
    for variant in labels.VARIANTS:
        got = {r["row_index"]: r["target_label"] for r in labels.with_labels(rows, "dreamer", "valence", variant, strict=False).collect()}
        assert got[1] is None and got[2] is None and got[4] == "high_valence"
        with pytest.raises(Exception, match="no label for"):
            labels.with_labels(rows, "dreamer", "valence", variant).collect()
    with pytest.raises(labels.ContractError):
        labels.require_source(rows.where("row_index = 2"), "dreamer", "valence")


def test_wrong_target_is_rejected(manifest):
    rows = keys.standardize(manifest, "deap", "valence")
    labels.require_contract(rows, "deap", "valence")
    for wrong in (("deap", "arousal", "primary"), ("dreamer", "valence", "primary"), ("deap", "valence", "tie_high")):
        with pytest.raises(labels.ContractError):
            labels.require_contract(rows, *wrong)


def test_recheck_counts(manifest):
    rows = keys.standardize(manifest, "deap", "valence")
    clean = labels.label_recheck(rows, manifest, "deap", "valence").first()
    assert clean.asDict() == {"n_checked": 72, "n_missing": 0, "n_mismatched": 0, "n_conflicting": 0, "n_duplicate_source": 0}
    arousal = keys.standardize(manifest, "deap", "arousal").withColumn(
        "target_label", F.regexp_replace("target_label", "arousal", "valence")
    )
    assert labels.label_recheck(arousal, manifest, "deap", "valence").first()["n_mismatched"] > 0


def test_enrichment_keeps_old_values(spark):
    rows = spark.createDataFrame([("s01.dat", 0, 1.0), ("s02.dat", 0, 2.0)], "subject_id string, trial_id long, valence double")
    table = ratings.rating_keys(spark.createDataFrame([(1, 1, 7.5)], "p long, e long, v double"), "p", "e")
    out = {r["subject_id"]: r for r in ratings.enrich(rows, table, ["subject_id", "trial_id"], {"valence": "v"}, "src").collect()}
    assert out["s01.dat"]["valence"] == 7.5 and out["s01.dat"]["valence_preprocessed"] == 1.0
    assert out["s02.dat"]["valence"] is None


def test_stimulus_groups_hold_one_clip_per_class(spark):
    rows = [(i, s, 1, t, t % 4, "c") for i, (s, t) in enumerate((s, t) for s in range(5) for t in range(24))]
    df = spark.createDataFrame(rows, "row_index long, subject_id long, session_id long, trial_id long, emotion long, clip_id string")
    out = keys.with_stimulus(keys.standardize(df, "seed_iv", "emotion"), "seed_iv")
    cells = out.select("stimulus_group", "target_label", "stimulus_key").distinct().groupBy("stimulus_group", "target_label").count()
    assert cells.count() == 24 and cells.where("count <> 1").count() == 0
