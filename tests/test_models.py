"""Solvers against brute force, and the runners on planted signal and on noise."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import evaluation, labels, linear, metrics, probes
from plumbline.sources import runs


def vectors(spark, x, **columns):
    names = list(columns)
    rows = [(i, [float(v) for v in r], *[columns[n][i] for n in names]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ", ".join(["row_index long, features array<double>", *[f"{n} string" for n in names]]))


def descend(x, y, w, loss, steps=60_000):
    """Plain gradient descent on the stated objective."""
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    ridge = np.ones(z.shape[1])
    if loss == "logistic":
        ridge[-1] = 0
    scale = 2.0 if loss == "svm" else 0.25
    rate = 1.0 / (scale * np.linalg.eigvalsh(z.T @ (z * w[:, None])).max() + 1)
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        m = y * (z @ b)
        slope = -w / (1 + np.exp(m)) if loss == "logistic" else -2 * w * np.maximum(1 - m, 0)
        g = z.T @ (slope * y) + ridge * b
        if np.abs(g).max() < 1e-9:
            break
        b = b - rate * g
    raw = b[:-1] / x.std(0)
    return np.append(raw, b[-1] - (raw * x.mean(0)).sum())


@pytest.mark.parametrize("loss", ["logistic", "svm"])
def test_batched_solver_equals_brute_force(spark, rng, loss):
    """Two problems with different rows, labels and weights, solved together."""
    x = rng.normal(size=(120, 3)) * [1, 5, 0.2] + [0, 10, 1]
    y = np.sign(x[:, 0] + 0.1 * (x[:, 1] - 10) + rng.normal(size=120) * 0.8)
    members, inside = [], [np.arange(120) < 80, np.arange(120) >= 30]
    for p, rows in enumerate(inside):
        target = y if p == 0 else -y
        for i in np.flatnonzero(rows):
            members.append((p, int(i), float(target[i]), 1.5 if target[i] > 0 else 0.75))
    table = linear.training_table(
        vectors(spark, x), spark.createDataFrame(members, "problem int, row_index long, y double, w double"), 2
    )
    got = linear.solve(table, 2, loss)
    for p, rows in enumerate(inside):
        target = (y if p == 0 else -y)[rows]
        want = descend(x[rows], target, np.where(target > 0, 1.5, 0.75), loss)
        assert np.allclose(got.coefficients[p], want, atol=1e-5)
    assert got.gradient.max() < 1e-4


@pytest.mark.parametrize("balanced", [False, True])
def test_softmax_of_all_folds_is_optimal(spark, rng, balanced):
    """Three folds with their own rows and scales, solved in common passes, against gradient descent on each."""
    x = rng.normal(size=(90, 3)) * [1, 4, 0.5] + [0, 3, 1]
    names = np.array(["a", "b", "c"])
    y = names[np.argmax(((x - x.mean(0)) / x.std(0)) @ rng.normal(size=(3, 3)) + rng.normal(size=(90, 3)), axis=1)]
    rows = vectors(spark, x, label=list(y))
    assigned = rows.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        "fold", "row_index", F.when(F.col("row_index") % 3 == F.col("fold"), "test").otherwise("train").alias("split"), "label"
    )
    out = linear.fit_predict(assigned, rows.select("row_index", "features"), names, linear.LOGISTIC, label="label", balanced=balanced)
    got = {(r["fold"], r["row_index"]): (r["y_pred"], r["converged"]) for r in out.collect()}
    assert len(got) == 90 and all(c for _, c in got.values())
    for fold in range(3):
        train = np.arange(90) % 3 != fold
        z = (x - x[train].mean(0)) / x[train].std(0)
        t = (y[:, None] == names).astype(float)
        weight = (train.sum() / (3 * t[train].sum(0)))[t[train].argmax(1)] if balanced else np.ones(train.sum())
        w, b = np.zeros((3, 3)), np.zeros(3)
        for _ in range(20_000):
            e = np.exp(z[train] @ w + b)
            r = (e / e.sum(1, keepdims=True) - t[train]) * weight[:, None]
            w, b = w - 0.01 * (z[train].T @ r + w), b - 0.01 * r.sum(0)
        want = names[np.argmax(z @ w + b, axis=1)]
        assert [got[fold, i][0] for i in range(90) if i % 3 == fold] == [want[i] for i in range(90) if i % 3 == fold]


def test_softmax_gradient_vanishes(spark, rng):
    """At the returned coefficients the gradient of the stated objective is zero, 64 features and ten classes."""
    x = rng.normal(size=(300, 64))
    y = rng.integers(0, 10, 300)
    members = [(p, i, float(y[i]), 1.0 + p) for p in range(2) for i in range(300) if (i + p) % 4]
    table = linear.training_table(vectors(spark, x), spark.createDataFrame(members, "problem int, row_index long, y double, w double"), 2)
    got = linear.solve_softmax(table, 2, 10)
    assert got.converged.all() and got.steps < 300
    for p in range(2):
        rows = (np.arange(300) + p) % 4 > 0
        mean, sd = x[rows].mean(0), x[rows].std(0)
        raw = got.coefficients[p].reshape(10, 65)
        z = np.column_stack([(x[rows] - mean) / sd, np.ones(rows.sum())])
        w = np.column_stack([raw[:, :-1] * sd, raw[:, -1] + (raw[:, :-1] * mean).sum(1)])
        e = np.exp(z @ w.T)
        slope = (e / e.sum(1, keepdims=True) - np.eye(10)[y[rows]]) * (1.0 + p)
        g = slope.T @ z + np.column_stack([w[:, :-1], np.zeros(10)])
        assert np.abs(g).max() < 1e-4


def planted(spark, rng, strength):
    """6 subjects x 8 trials x 6 windows; subjects shift the features."""
    n = 288
    subject, trial = np.arange(n) % 6, np.arange(n) // 6 % 8
    centres = rng.normal(size=(6, 8)) * strength
    x = centres[subject] + rng.normal(size=(n, 8))
    return vectors(
        spark, x, subject_key=[f"s{s:02d}" for s in subject], session_key=["session_1"] * n,
        trial_key=[f"s{s:02d}::session_1::trial_{t}" for s, t in zip(subject, trial, strict=True)],
        stimulus_key=[f"trial_{t}" for t in trial],
    )


def test_probe_finds_subjects_and_not_stimuli(spark, rng):
    rows = planted(spark, rng, 3.0)
    out = {r["probe_query"]: r for r in probes.probe_suite(rows, rows.drop("features"), ["subject_key", "stimulus_key", "session_key"], 10_000, 5, 4).collect()}
    assert out["subject_key"]["balanced_accuracy"] > 0.9 and out["subject_key"]["status"] == "OK"
    assert abs(out["stimulus_key"]["balanced_accuracy"] - 1 / 8) < 0.1
    assert out["subject_key"]["n_trials"] == 48 and "session_key" not in out


def test_encoders_are_probed_apart(spark, rng):
    rows = planted(spark, rng, 3.0).withColumn("encoder_id", F.when(F.col("row_index") % 2 == 0, "e0").otherwise("e1"))
    out = probes.probe_spaces(rows.select("encoder_id", "row_index", "features"), rows.drop("features"), ["subject_key"], 5, ["encoder_id"])
    assert {r["encoder_id"] for r in out.collect()} == {"e0", "e1"}
    assert out.where("balanced_accuracy < 0.9").count() == 0


def test_noise_is_near_chance_and_one_class_is_not_estimable(spark, rng):
    rows = planted(spark, rng, 0.0)
    row = probes.probe(rows, rows.drop("features"), "subject_key", 5)
    assert abs(row["balanced_accuracy"] - 1 / 6) < 0.12
    one = rows.withColumn("subject_key", F.lit("s00"))
    assert probes.probe(one, one.drop("features"), "subject_key", 5)["status"] == "NOT_ESTIMABLE"


def labelled_folds(spark, rng, strength):
    n = 240
    y = np.where(rng.random(n) < 0.5, "high_valence", "low_valence")
    x = rng.normal(size=(n, 4)) + strength * (y == "high_valence")[:, None]
    rows = vectors(spark, x, target_label=list(y)).withColumn("alpha", F.col("features")).withColumn("spectral", F.col("features"))
    spread = rows.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(1, 4)])))
    mine = (F.col("row_index") % 3 + 1) == F.col("fold")
    assigned = spread.withColumn("split", F.when(mine, "test").otherwise("train")).select(
        "fold", "row_index", "split", "target_label", F.col("row_index").cast("string").alias("trial_key"), F.col("row_index").cast("string").alias("subject_key")
    )
    return assigned, rows.select("row_index", "alpha", "spectral")


def test_runner_beats_chance_on_signal_only(spark, rng):
    assigned, table = labelled_folds(spark, rng, 1.5)
    models = ["majority", "random_prior", "spectral_logistic", "spectral_svm"]
    out = evaluation.run_baselines(assigned, table, models, ("high_valence", "low_valence"), "segment_random", 3)
    ba = {m: [] for m in models}
    for r in out.collect():
        ba[r["model"]].append(r["balanced_accuracy"])
    assert all(v == 0.5 for v in ba["majority"]) and len(ba["majority"]) == 3
    assert min(ba["spectral_logistic"]) > 0.85 and min(ba["spectral_svm"]) > 0.85
    assert np.mean(ba["random_prior"]) < 0.65
    capped = evaluation.run_baselines(assigned, table, ["majority"], ("high_valence", "low_valence"), "segment_random", 3, 40, 20)
    assert {r["n_test"] for r in capped.collect()} == {20}


def rows_of(df):
    return sorted(tuple(r) for r in df.select("model", "fold", *[c for c in df.columns if c not in ("model", "fold")]).collect())


@pytest.mark.parametrize("null", [False, True])
def test_a_ledger_keeps_finished_folds(spark, rng, tmp_path, null):
    assigned, table = labelled_folds(spark, rng, 1.5)
    models, classes = ["majority", "spectral_logistic"], ("high_valence", "low_valence")

    def run(rows, seed=3, which=models, **more):
        if null:
            return evaluation.run_permutation_null(rows, table, which, classes, 2, seed, "segment_random", **more)
        return evaluation.run_baselines(rows, table, which, classes, "segment_random", seed, **more)

    path = str(tmp_path / "ledger")
    ledger = runs.Ledger(path, {"dataset": "made"})
    written = lambda: spark.read.parquet(path).groupBy("model", "fold").count().count()
    assert len(rows_of(run(assigned.where("fold < 3"), which=["majority"], ledger=ledger))) == (4 if null else 2)
    whole = rows_of(run(assigned, ledger=ledger))
    assert whole == rows_of(run(assigned)) and written() == 6
    files = spark.read.parquet(path).count()
    broken = assigned.withColumn("split", F.lit("train"))  # would score nothing
    assert rows_of(run(broken, ledger=ledger)) == whole and spark.read.parquet(path).count() == files
    run(assigned, seed=4, ledger=ledger)
    assert spark.read.parquet(path).select("fingerprint").distinct().count() == 2
    run(assigned, ledger=runs.Ledger(path, {"dataset": "other"}))
    assert spark.read.parquet(path).select("fingerprint").distinct().count() == 3


def test_a_wrong_policy_stops_the_runner(spark, rng, tmp_path):
    assigned, table = labelled_folds(spark, rng, 1.0)
    declared = assigned.select("*", F.lit("dreamer").alias("dataset"), F.lit("valence").alias("target"), F.lit("another").alias("label_policy_id"))
    for ledger in (None, runs.Ledger(str(tmp_path / "ledger"), {"dataset": "dreamer"})):
        with pytest.raises(labels.ContractError):
            evaluation.run_baselines(
                declared, table, ["majority"], ("high_valence", "low_valence"), "segment_random", 3, contract=("dreamer", "valence", labels.PRIMARY), ledger=ledger
            )
    with pytest.raises(ValueError):
        ledger.opened(evaluation.metrics_schema(assigned, ["model", "fold"]), {"dataset": "x"})


def test_random_windows_flatter_a_probe(spark, rng):
    """Trials differ at random, subjects do not: windows of a trial on both sides tell the subject, whole trials do not."""
    n, trials = 240, 24
    trial = np.arange(n) % trials
    x = rng.normal(size=(trials, 12))[trial] * 3 + rng.normal(size=(n, 12)) * 0.1
    keys = {"trial_key": [f"t{t:02}" for t in trial], "subject_key": [f"s{t % 2}" for t in trial]}
    meta = vectors(spark, x, **keys)
    features = meta.select("row_index", "features")
    meta = meta.drop("features")
    loose = probes.window_random_probe(features, meta, "subject_key", 1)
    strict = probes.probe(features, meta, "subject_key", 1)
    assert loose["n_test_groups"] == 48 and loose["probe_split"] == "window_random" and loose["converged"]
    assert loose["balanced_accuracy"] > strict["balanced_accuracy"] + 0.15
    one = probes.window_random_probe(features, meta.where("subject_key = 's0'"), "subject_key", 1)
    assert one["status"] == "NOT_ESTIMABLE"
    suite = probes.probe_suite(features, meta, ["subject_key"], 100, 1, 5, probes.window_random_probe).first()
    assert (suite["n_chunks"], suite["n_test_groups"]) == (100, 20)


def test_permuted_labels_are_near_chance(spark, rng):
    assigned, table = labelled_folds(spark, rng, 1.5)
    out = evaluation.run_permutation_null(assigned, table, ["spectral_logistic"], ("high_valence", "low_valence"), 4, 3, "segment_random")
    ba = [r["balanced_accuracy"] for r in out.collect()]
    assert len(ba) == 12 and abs(np.mean(ba) - 0.5) < 0.12


def test_partial_features_are_refused(spark, rng):
    assigned, table = labelled_folds(spark, rng, 1.0)
    with pytest.raises(ValueError):
        evaluation.run_baselines(assigned, table.where("row_index < 200"), ["majority"], ("a", "b"), "segment_random", 3)
    with pytest.raises(ValueError):
        evaluation.require_transfer("deap", "deap", "valence")


def test_trial_vote_takes_the_first_of_equal_classes(spark):
    df = spark.createDataFrame([("t", 1, [0.2, 0.8, 0.0]), ("t", 1, [0.8, 0.2, 0.0])], "trial string, y long, s array<double>")
    row = metrics.trial_predictions(df, "trial", "y", "s", 3).first()
    assert (row["y_true"], row["y_pred"], row["mixed"]) == (1, 0, False)


def test_predictions_copy_no_weights_per_row():
    draw = np.random.default_rng(3)
    weights, unit, x = draw.normal(size=(5, 10, 65)), draw.integers(0, 5, 10_000), np.empty(10_000, object)
    x[:] = list(draw.normal(size=(10_000, 64)))
    want = [(weights[u] @ np.append(v, 1.0)).argmax() for u, v in zip(unit, x, strict=True)]
    tracemalloc.start()
    got = linear._chosen(weights, unit, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == want
    assert peak < 10e6  # weights of 10,000 rows are 52 MB


def test_lists_of_several_lengths_are_an_error():
    assert linear._matrix(pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])[1:]).tolist() == [[3.0, 4.0], [5.0, 6.0]]
    with pytest.raises(ValueError):
        linear._matrix(pa.array([[1.0], [2.0, 3.0, 4.0]]))
