import pytest
from pyspark.sql import functions as F

from plumbline.functions import ranking
from plumbline.operators import audits, folds, keys, probe_splits, sampling, shuffles


@pytest.fixture(scope="module")
def rows(spark, manifest):
    return keys.with_stimulus(keys.standardize(manifest, "deap", "valence"), "deap").cache()


@pytest.fixture(scope="module")
def many(spark):
    """9 subjects x 6 stimuli x 5 windows."""
    return spark.range(270).select(
        F.col("id").alias("row_index"),
        F.format_string("s%02d", F.col("id") % 9).alias("subject_key"),
        F.concat(F.lit("t"), (F.col("id") % 9).cast("string"), F.lit("_"), (F.floor(F.col("id") / 9) % 6).cast("string")).alias("trial_key"),
        F.concat(F.lit("v"), (F.floor(F.col("id") / 9) % 6).cast("string")).alias("stimulus_key"),
        (F.floor(F.col("id") / 9) % 6 % 3).alias("stimulus_group"),
        F.when(F.floor(F.col("id") / 9) % 2 == 0, "a").otherwise("b").alias("target_label"),
    ).cache()


def counts(df, *by):
    return {tuple(r[c] for c in by): r["count"] for r in df.groupBy(*by).count().collect()}


def test_segment_random_is_stratified(rows):
    out = folds.segment_random(rows, 3, 1).join(rows.select("row_index", "target_label"), "row_index")
    n = counts(out, "fold", "split", "target_label")
    for fold in (1, 2, 3):
        assert n[fold, "test", "high_valence"] == 12 and n[fold, "test", "low_valence"] == 12
        assert n[fold, "val", "high_valence"] + n[fold, "val", "low_valence"] == 10  # ceil(0.2 * 48)
    assert audits.row_audit(out).where("n_repeated > 0 or n_rows <> 72").count() == 0


def test_segment_random_without_stratification(spark):
    rows = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "row_index long, target_label string")
    n = counts(folds.segment_random(rows, 5, 1), "fold", "split")
    assert all(n[f, "test"] == 4 and n[f, "val"] == 4 and n[f, "train"] == 12 for f in range(1, 6))


def test_trial_grouped_has_no_trial_leak(rows):
    rules = folds.trial_grouped_rules(rows, 5, 1)
    assigned = folds.assign_rows(rows, rules, ["trial_key"])
    assert audits.leaks(assigned, "trial_key").count() == 0
    assert audits.row_audit(assigned).where("n_rows <> 72 or n_repeated > 0").count() == 0
    tests = counts(rules.where("split = 'test'"), "fold")
    assert sorted(tests.values()) == [4, 5, 5, 5, 5]


def test_few_trials_give_one_fold(spark):
    rows = spark.createDataFrame([(i, f"t{i % 3}") for i in range(9)], "row_index long, trial_key string")
    n = counts(folds.trial_grouped_rules(rows, 5, 1), "fold", "split")
    assert n == {(1, "test"): 1, (1, "val"): 1, (1, "train"): 1}


def test_large_paths_agree_with_small_ones(many, monkeypatch):
    small = folds.trial_grouped_rules(many, 4, 3).collect()
    circle = folds.subject_circle(many, 3)
    composed = folds.fold_composition(many, circle, ["target_label"]).collect()
    monkeypatch.setattr(ranking, "PIECE_ROWS", 3)
    assert sorted(map(tuple, small)) == sorted(map(tuple, folds.trial_grouped_rules(many, 4, 3).collect()))
    assert sorted(map(tuple, circle.collect())) == sorted(map(tuple, folds.subject_circle(many, 3).collect()))
    again = folds.fold_composition(many, circle, ["target_label"]).collect()
    assert sorted(map(tuple, composed)) == sorted(map(tuple, again))


def test_loso(many):
    circle = folds.subject_circle(many, 3)
    rules = folds.subject_rules(circle)
    assert [r["subject_key"] for r in circle.orderBy("fold").collect()] == [f"s{i:02d}" for i in range(9)]
    n = counts(rules, "fold", "split")
    assert all(n[f, "test"] == 1 and n[f, "val"] == 2 and n[f, "train"] == 6 for f in range(1, 10))
    assigned = folds.assign_rows(many, rules, ["subject_key"])
    assert audits.leaks(assigned, "subject_key").count() == 0
    named = folds.subject_rules(circle, folds=[2, 5])
    assert sorted({r["fold"] for r in named.collect()}) == [2, 5]
    assert folds.protocol_name("strict_loso") == folds.protocol_name("loso") == "leave_one_subject_out"


def test_composition_equals_counting(many):
    circle = folds.subject_circle(many, 3)
    assigned = folds.assign_rows(many, folds.subject_rules(circle), ["subject_key"])
    counted = {
        (r["fold"], r["target_label"]): (r["test"], r["val"], r["train"])
        for r in assigned.groupBy("fold", "target_label")
        .agg(*[F.count_if(F.col("split") == s).alias(s) for s in ("test", "val", "train")])
        .collect()
    }
    got = folds.fold_composition(many, circle, ["target_label"]).collect()
    assert {(r["fold"], r["target_label"]): (r["test"], r["val"], r["train"]) for r in got} == counted


def test_stimulus_holdout_properties(many):
    circle = folds.subject_circle(many, 3)
    rows = folds.assign_rows(many, folds.stimulus_rules(circle, 3), ["subject_key", "stimulus_group"]).cache()
    held, seen = (rows.where(F.col("protocol") == c) for c in (folds.HELD_OUT, folds.SEEN))
    assert audits.leaks(rows, "subject_key", ("protocol", "fold")).count() == 0
    assert audits.leaks(held, "stimulus_key").count() == 0
    assert audits.uncovered(seen, "stimulus_key").count() == 0
    assert audits.test_set_differences(rows).count() == 0
    assert counts(held.where("split = 'train'"), "fold") == counts(seen.where("split = 'train'"), "fold")
    with pytest.raises(audits.AuditError):
        audits.require_empty(audits.leaks(seen, "stimulus_key"), "stimulus leakage")


def test_matching(spark):
    """Three folds whose class shares and sizes differ between two conditions."""
    rows = []
    for cond, share in (("loso_stimulus_seen", 0.3), ("loso_stimulus_heldout", 0.5)):
        for fold in (1, 2, 3):
            sizes = {"train": 200 + (30 * fold if share == 0.5 else 0), "val": 50, "test": 40}
            start = 0
            for split, n in sizes.items():
                for i in range(n):
                    rows.append((cond, fold, split, "a" if i < share * n and split != "test" else "b", start + i))
                start += 1000
    df = spark.createDataFrame(rows, "protocol string, fold long, split string, target_label string, row_index long")
    out = sampling.match_conditions(df, 1).cache()
    assert audits.unmatched_classes(out).count() == 0 and audits.test_set_differences(out).count() == 0
    assert out.where("split = 'test'").count() == 240
    n = counts(out, "protocol", "fold", "split", "target_label")
    assert n["loso_stimulus_seen", 1, "train", "a"] == 60 and n["loso_stimulus_heldout", 1, "train", "b"] == 115
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, sampling.match_conditions(df, 1).collect()))


@pytest.mark.parametrize("cap,expected", [(10, {"a": 3, "b": 3, "c": 4}), (40, None), (1000, {"a": 100, "b": 50, "c": 5})])
def test_balanced_cap(spark, cap, expected):
    rows = spark.createDataFrame(
        [(i, "a" if i < 100 else "b" if i < 150 else "c") for i in range(155)], "row_index long, target_label string"
    )
    out = sampling.balanced_cap(rows, cap, 3)
    assert out.count() == min(cap, 155) and out.select("row_index").distinct().count() == out.count()
    n = {k[0]: v for k, v in counts(out, "target_label").items()}
    if cap == 10:
        assert min(n.values()) >= 3
    elif expected:
        assert n == expected
    else:
        assert n["c"] == 5 and n["a"] >= 13 and n["b"] >= 13


def test_probe_sample_drops_rare_classes_and_trims(spark):
    rows = spark.createDataFrame([(i, f"c{i % 4}" if i < 80 else "rare") for i in range(83)], "row_index long, k string")
    out = sampling.probe_sample(rows, "k", 30, 1, 10)
    assert out.count() == 30 and out.where("k = 'rare'").count() == 0


def test_resplit_keeps_a_training_subject(many):
    rules = folds.subject_rules(folds.subject_circle(many, 3))
    out = sampling.resplit_subjects(rules.select("fold", "subject_key", "split"), 1, 50)
    n = counts(out, "fold", "split")
    assert all(n[f, "train"] == 1 and n[f, "val"] == 7 for f in range(1, 10))


def test_probe_splits(many):
    sides = probe_splits.probe_sides(many, "subject_key", 3)
    rows = probe_splits.probe_rows(many, sides, "subject_key")
    assert rows.groupBy("trial_key").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0
    per = counts(sides, "subject_key", "side")
    assert all(per[f"s{i:02d}", "test"] == 2 for i in range(9))
    sides = probe_splits.probe_sides(many, "stimulus_key", 3)
    assert {r["subject_key"] for r in sides.where("side = 'test'").collect()}.isdisjoint(
        {r["subject_key"] for r in sides.where("side = 'train'").collect()}
    )
    lonely = many.withColumn("everything", F.lit("x"))
    assert probe_splits.split_report(probe_splits.probe_sides(lonely, "everything", 3), "everything").first()["status"] == "NOT_ESTIMABLE"
    assert probe_splits.spanning_groups(many, "row_index").count() > 0


def test_permutation_keeps_histograms(rows):
    train = folds.segment_random(rows, 3, 1).where("split = 'train'").join(rows.select("row_index", "target_label"), "row_index")
    out = shuffles.permute_labels(train, 4, 9)
    before, after = counts(out, "fold", "permutation", "target_label"), counts(out, "fold", "permutation", "permuted_label")
    assert before == after
    assert out.where("target_label <> permuted_label").count() > 0


def test_role_audit_finds_what_three_audits_find(spark):
    rows = [(1, 0, "t0", "s0", "train"), (1, 1, "t0", "s0", "test"), (1, 2, "t1", "s1", "test"), (1, 2, "t1", "s1", "test"), (2, 0, "t0", "s0", "train"), (2, 1, None, "s0", "test"), (2, 3, None, "s2", "val")]
    df = spark.createDataFrame(rows, "fold int, row_index long, trial_key string, subject_key string, split string")
    got = {(r["fold"], r["kind"], r["value"]) for r in audits.role_audit(df, ["trial_key", "subject_key"]).collect()}
    want = {(r["fold"], "row_index", str(r["row_index"])) for r in df.groupBy("fold", "row_index").count().where("count > 1").collect()}
    for entity in ("trial_key", "subject_key"):
        want |= {(r["fold"], entity, r[entity]) for r in audits.leaks(df, entity).collect()}
    assert got == want and len(want) == 5
    assert audits.role_audit(df, ["trial_key", "subject_key"])._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1


def test_summaries_from_entities_equal_those_from_rows(many):
    circle = folds.subject_circle(many, 3)
    assigned = folds.assign_rows(many, folds.subject_rules(circle), ["subject_key"])
    counts_ = folds.fold_composition(folds.entity_counts(many), circle, ["kind", "value"], n="n")
    summary = audits.composed_summary(counts_, ["fold"])
    plain = audits.split_summary(assigned, ["fold", "split"])
    assert sorted(map(tuple, summary.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert tuple(audits.composed_support(summary, 2).first()) == tuple(audits.support_report(assigned, 2).first())


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_matching_by_intervals_equals_matching_of_rows(many, bits, monkeypatch):
    """Limits from counted pieces keep the same rows as ranking rows x folds, at any number of pieces."""
    from plumbline.operators import matching

    monkeypatch.setattr(matching, "PIECE_BITS", bits)
    circle = folds.subject_circle(many, 3)
    assigned = folds.assign_rows(many, folds.stimulus_rules(circle, 3), ["subject_key", "stimulus_group"])
    columns = ["protocol", "fold", "split", "target_label", "row_index"]
    want = sampling.match_conditions(assigned.select(*columns), 7)
    got = matching.match_rows(many, circle, 3, 7)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    audit = matching.match_audit(many, circle, 3, 7).first()
    assert (audit["n_rows"], audit["test_rows_differ"], audit["classes_differ"]) == (want.count(), 0, 0)


def test_rule_summary_counts_entities_before_folds(spark, manifest):
    rows = keys.standardize(manifest, "dreamer", "valence")
    rules = folds.trial_grouped_rules(rows, 3, 5)
    by = ["dataset", "target"]
    plain = audits.split_summary(folds.assign_rows(rows, rules, ["trial_key"]), [*by, "fold", "split"])
    found = audits.rule_summary(rows, rules, by)
    assert found.columns == plain.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 0
