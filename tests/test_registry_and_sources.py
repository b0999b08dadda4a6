import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import labels, registry
from plumbline.sources import digests, runs, sinks, tables


def run_row(run, **changes):
    base = {
        "run_id": run, "kind": "deep", "dataset": "dreamer", "target": "valence", "label_policy_id": "p", "label_variant": "primary",
        "protocol": "strict_loso", "split_variant": "primary", "model": "m_" + run, "transform": "none", "epochs": 5, "batch_size": 64,
        "early_stopping": False, "class_weighting": "none", "inject_snr": 0.0, "split_partition_sha256": "abc",
    }
    base.update(changes)
    return base


SCHEMA = (
    "run_id string, kind string, dataset string, target string, label_policy_id string, label_variant string, protocol string, "
    "split_variant string, model string, transform string, epochs int, batch_size int, early_stopping boolean, class_weighting string, "
    "inject_snr double, split_partition_sha256 string, seed long"
)


def tables_for(spark, runs_=None, rows=None, estimates=None):
    runs_ = runs_ or [run_row("A"), run_row("B")]
    rows = rows if rows is not None else [(r, s, f, ba) for r, bas in (("A", (0.6, 0.8)), ("B", (0.5, 0.5))) for s, ba in enumerate(bas) for f in range(1, 7)]
    estimates = estimates if estimates is not None else [("e", "contrast", "fam", role, r, s, f) for role, r in (("A", "A"), ("B", "B")) for s in (0, 1) for f in range(1, 7)]
    return (
        spark.createDataFrame([[{**r, "seed": None}[c.split()[0]] for c in SCHEMA.split(", ")] for r in runs_], SCHEMA),
        spark.createDataFrame(rows, "run_id string, seed long, fold long, balanced_accuracy double"),
        spark.createDataFrame(estimates, "estimate string, analysis string, holm_family string, role string, run_id string, seed long, fold long"),
    )


def rules(spark, **kw):
    return {r["rule"] for r in registry.violations(*tables_for(spark, **kw)).collect()}


def test_paired_estimate_averages_seeds(spark):
    joined = registry.validated(*tables_for(spark))
    row = registry.paired_estimates(joined).first()
    assert row["mean_diff"] == pytest.approx(0.2) and row["n_pairs"] == 6 and row["n_seeds"] == 2 and row["n_positive"] == 6
    assert row["p_wilcoxon"] == pytest.approx(2 / 2**6) and row["p_holm"] == row["p_wilcoxon"]


def test_only_shared_seeds_are_paired(spark):
    rows = [("A", s, f, 0.9 if s == 2 else 0.6) for s in (1, 2) for f in range(1, 6)] + [("B", 1, f, 0.5) for f in range(1, 6)]
    est = [("e", "c", "f", r, r, s, f) for r, s, f, _ in rows]
    row = registry.paired_estimates(registry.joined(*tables_for(spark, rows=rows, estimates=est))).first()
    assert row["mean_diff"] == pytest.approx(0.1) and row["n_seeds"] == 1


def test_missing_seeds_match_missing_seeds(spark):
    rows = [(r, None, f, 0.5) for r in "AB" for f in range(1, 6)]
    est = [("e", "c", "f", r, r, None, f) for r in "AB" for f in range(1, 6)]
    assert registry.joined(*tables_for(spark, rows=rows, estimates=est)).count() == 10


@pytest.mark.parametrize("column,value", [("transform", "time_shuffle"), ("epochs", 6), ("split_partition_sha256", None), ("inject_snr", 0.5)])
def test_every_condition_separates_runs(spark, column, value):
    mixed = [run_row("A", model="m"), run_row("B", model="m", **{column: value})]
    est = [("e", "c", "f", "single", r, 0, f) for r in "AB" for f in ((1, 2) if r == "A" else (3, 4))]
    assert "mixed conditions in a role" in rules(spark, runs_=mixed, estimates=est)


def test_registry_faults(spark):
    assert rules(spark) == set()
    same = [run_row("A", model="m"), run_row("B", model="m")]
    assert rules(spark, runs_=same) == {"roles have identical conditions"}
    assert rules(spark, runs_=[run_row("A"), run_row("B", target="arousal")]) == {"roles differ in dataset or target"}
    assert "duplicate run" in rules(spark, runs_=[run_row("A"), run_row("A"), run_row("B")])
    with pytest.raises(registry.InconsistentRegistry):
        registry.validated(*tables_for(spark, runs_=same))
    with pytest.raises(registry.InconsistentRegistry):
        r, w, e = tables_for(spark)
        registry.violations(r.drop("epochs"), w, e)


def test_digest_follows_its_definition(spark):
    df = spark.createDataFrame([(i, f"l{i % 2}") for i in range(101)], "row_index long, target_label string")
    hashes = [hashlib.sha256(f"{i}\tl{i % 2}".encode()).hexdigest() for i in range(101)]
    words = [sum(int(h[4 * k : 4 * k + 4], 16) for h in hashes) for k in range(16)]
    want = hashlib.sha256(":".join(map(str, [101, *words])).encode()).hexdigest()
    assert digests.label_digest(df).first()["digest"] == want == digests.label_digest(df.repartition(7)).first()["digest"]
    assert digests.duplicate_keys(df.unionByName(df.limit(1))).count() == 1 and digests.duplicate_keys(df).count() == 0


@pytest.mark.parametrize("second", ["l1", "l0"])
def test_label_digest_stops_on_repeated_keys(spark, second):
    """Also where the copies agree, and only inside one vector."""
    df = spark.createDataFrame([(1, "l1", "a"), (2, "l0", "a"), (1, second, "b")], "row_index long, target_label string, part string")
    with pytest.raises(Exception, match="repeats key 1"):
        digests.label_digest(df).collect()
    assert digests.label_digest(df, by=["part"]).count() == 2


def test_multiset_digest_ignores_order_only(spark):
    df = spark.range(500).select(F.col("id").alias("row_index"), (F.col("id") % 3).cast("string").alias("target_label"))
    base = digests.label_digest(df).first()["digest"]
    assert digests.label_digest(df.orderBy(F.desc("row_index")).repartition(5)).first()["digest"] == base
    changed = df.withColumn("target_label", F.when(F.col("row_index") == 7, "9").otherwise(F.col("target_label")))
    assert digests.label_digest(changed).first()["digest"] != base


def test_resume_needs_the_same_fingerprint(spark):
    planned = spark.createDataFrame([("m", f, 5) for f in (1, 2, 3)], "model string, fold long, epochs int").withColumn("fingerprint", runs.fingerprint(["model", "epochs"]))
    done = planned.where("fold < 3").select("fold", F.when(F.col("fold") == 1, F.col("fingerprint")).alias("fingerprint"))
    assert [r["fold"] for r in runs.pending_folds(planned, done).orderBy("fold").collect()] == [2, 3]
    changed = planned.withColumn("epochs", F.lit(6)).withColumn("fingerprint", runs.fingerprint(["model", "epochs"]))
    assert runs.pending_folds(changed, done).count() == 3


def test_run_documents(spark, tmp_path):
    policy = labels.policy("dreamer", "valence")
    fp = {"dataset": "dreamer", "target": "valence", "label_policy_id": policy.policy_id, "epochs": 5}
    fold = {"fold": 1, "balanced_accuracy": 0.6, "n_test_classes": 2, "classes": list(policy.classes)}
    meta = {"dataset": "dreamer", "target": "valence", "model": "m", "seed": 1, "is_smoke": False, "n_folds_expected": 1, "n_folds_completed": 1, "run_fingerprint": fp}
    docs = {
        "good": {"metadata": meta, "fold_metrics": [fold]},
        "struct": {"metadata": meta, "fold_metrics": fold},
        "empty": {"metadata": meta, "fold_metrics": []},
        "smoke": {"metadata": {**meta, "is_smoke": True}, "fold_metrics": [fold]},
        "two": {"metadata": meta, "fold_metrics": [{**fold, "model": "a"}, {**fold, "model": "b"}]},
        "partial": {"metadata": {**meta, "n_folds_expected": 2}, "fold_metrics": [fold]},
        "foreign": {"metadata": meta, "fold_metrics": [{**fold, "classes": ["high_arousal"]}]},
        "other": {"metadata": {**meta, "run_fingerprint": {**fp, "target": "arousal"}}, "fold_metrics": [fold]},
        "nameless": {"metadata": {k: v for k, v in meta.items() if k != "run_fingerprint"}, "fold_metrics": [fold]},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "x_fold_checkpoints").mkdir()
    (tmp_path / "x_fold_checkpoints" / "fold001.json").write_text(json.dumps(docs["good"]))
    read = tables.read_run_documents(spark, str(tmp_path)).cache()
    name = F.regexp_extract("path", r"([^/]+)\.json", 1).alias("name")
    rejects = {r["name"]: r["reason"] for r in tables.run_document_rejects(read).select(name, "reason").collect()}
    assert set(rejects) == {"struct", "empty", "smoke", "two", "fold001"}
    assert tables.runs_from_documents(read).count() == 5 == tables.fold_rows_from_documents(read).count()
    report = {r["name"]: r["reasons"] for r in runs.completeness_report(read, policy).select(name, "reasons").collect()}
    assert report["good"] == ""
    assert report["partial"] == report["empty"] == "missing folds"
    assert report["other"] == "other data"
    assert report["nameless"] == "no fingerprint"
    assert report["foreign"] == "unknown classes"


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    rows = spark.createDataFrame([(i, "a", "b", "m", i % 2) for i in range(10)], "row_index long, y_true string, y_pred string, model string, fold int")
    sinks.write_predictions(rows, str(tmp_path / "p"))
    assert (tmp_path / "p" / "model=m" / "fold=1").exists()
    copy = rows.withColumn("y_pred", F.when(F.col("row_index") == 3, "x").otherwise(F.col("y_pred"))).where("row_index <> 4")
    assert {r[0] for r in sinks.read_back_check(rows, copy, 10, 1).collect()} == {3, 4}
