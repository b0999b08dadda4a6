import itertools
import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from plumbline.functions.tails import t_quantile
from plumbline.functions import ranking
from plumbline.operators import inference, label_stats, metrics


def score(spark, true, pred):
    df = spark.createDataFrame([(1, t, p) for t, p in zip(true, pred, strict=True)], "fold int, y_true int, y_pred int")
    counts = metrics.prediction_counts(df, ["fold"])
    return metrics.fold_metrics(counts, ["fold"]).first(), counts


def test_balanced_accuracy_by_hand(spark):
    row, counts = score(spark, [0, 0, 0, 1], [0, 0, 1, 1])
    assert row["balanced_accuracy"] == pytest.approx(5 / 6) and row["accuracy"] == 0.75
    assert row["macro_f1"] == pytest.approx((0.8 + 2 / 3) / 2)
    named = counts.selectExpr("fold", "cast(y_true as string) y_true", "cast(y_pred as string) y_pred", "n")
    grid = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(named, ["fold"], ["0", "1"]).collect()}
    assert grid == {("0", "0"): 2, ("0", "1"): 1, ("1", "0"): 0, ("1", "1"): 1}


def test_absent_class_shrinks_the_denominator(spark):
    row, _ = score(spark, [0, 0, 0], [0, 1, 0])
    assert row["n_test_classes"] == 1 and row["balanced_accuracy"] == pytest.approx(2 / 3)
    assert row["macro_f1"] == pytest.approx(0.4)


def test_class_weights(spark):
    counts = spark.createDataFrame([(1, "a", 6), (1, "b", 2), (1, "c", 0)], "fold int, l string, n long")
    w = {r["l"]: r["weight"] for r in metrics.balanced_weights(counts.where("n > 0"), ["fold"], "l", "n", 2).collect()}
    assert w == {"a": pytest.approx(2 / 3), "b": 2.0}
    zero = {r["l"]: r["weight"] for r in metrics.balanced_weights(counts, ["fold"], "l", "n", 3).collect()}
    assert zero["c"] == 0.0
    clipped = {r["l"]: r["weight"] for r in metrics.balanced_weights(counts, ["fold"], "l", "n", 3, "clip").collect()}
    assert clipped["c"] == pytest.approx(8 / 3)


@pytest.mark.parametrize("df,expected", [(4, 2.776445), (14, 2.144787), (22, 2.073873), (31, 2.039513), (1, 12.706205), (1000, 1.962339)])
def test_t_quantile(df, expected):
    assert t_quantile(df) == pytest.approx(expected, abs=2e-6)


def test_t_interval(spark):
    df = spark.createDataFrame(
        [("five", float(v)) for v in (1, 2, 3, 4, 5)] + [("five", math.nan), ("five", math.inf), ("one", 1.0)], "k string, v double"
    )
    out = {r["k"]: r for r in inference.t_interval(df, ["k"], "v").collect()}
    assert out["five"]["n"] == 5 and out["five"]["multiplier"] == pytest.approx(2.7764, abs=1e-4)
    assert out["five"]["low"] == pytest.approx(3 - 2.776445 * math.sqrt(2.5) / math.sqrt(5), abs=1e-5)
    assert out["one"]["n"] == 1 and out["one"]["low"] is None and out["one"]["sd"] is None


def brute_force_p(values):
    """All sign patterns of the mid-ranks."""
    v = np.asarray([x for x in values if x != 0])
    size = np.abs(v)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    w = ranks[v > 0].sum()
    sums = np.array([ranks[np.array(s, dtype=bool)].sum() for s in itertools.product([0, 1], repeat=len(v))])
    return min(1.0, 2 * min((sums <= w).mean(), (sums >= w).mean()))


def test_wilcoxon_exact(spark, rng, monkeypatch):
    groups = {"untied": rng.normal(0.4, 1, 11), "tied": np.round(rng.normal(0.4, 1, 12), 0), "few": np.array([1.0, 2, 3, 4, 0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, d double")
    out = {r["k"]: r["p_wilcoxon"] for r in inference.wilcoxon(df, ["k"], "d").collect()}
    assert out["untied"] == pytest.approx(brute_force_p(groups["untied"]))
    assert out["tied"] == pytest.approx(brute_force_p(groups["tied"]))
    assert out["few"] is None
    tiny = {r["k"]: (r["n_used"], r["p_wilcoxon"]) for r in inference.wilcoxon(df.withColumn("d", F.col("d") * 1e-13), ["k"], "d").collect()}
    assert tiny["untied"] == (11, pytest.approx(out["untied"])) and tiny["tied"][1] == pytest.approx(out["tied"])
    monkeypatch.setattr(ranking, "PIECE_ROWS", 3)
    cut = {r["k"]: r["p_wilcoxon"] for r in inference.wilcoxon(df, ["k"], "d").collect()}
    assert cut == out


def test_wilcoxon_published_form(spark):
    """n = 15, all but two smallest positive; and an untied n = 32, which is still exact."""
    d15 = [(-1.0 if i < 2 else 1.0) * (i + 1) for i in range(15)]
    d32 = [(-1.0 if i % 3 == 0 else 1.0) * (i + 1) for i in range(32)]
    d60 = [(-1.0 if i % 3 == 0 else 1.0) * (i + 1) for i in range(60)]
    df = spark.createDataFrame([(k, v) for k, vs in ((15, d15), (32, d32), (60, d60)) for v in vs], "n int, d double")
    p = {r["n"]: r["p_wilcoxon"] for r in inference.wilcoxon(df, ["n"], "d").collect()}
    assert p[15] == pytest.approx(2 * 5 / 2**15)  # rank sums of negatives 0, 1, 2, 3 and 3 again
    assert (p[32] * 2**31) % 1 == 0
    w, n = sum(v for v in d60 if v > 0), 60
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert p[60] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


# Published p-values and their adjusted values, by family.
PUBLISHED = {
    "transforms": [
        (0.00030517578125, 0.00152587890625),
        (0.5994873046875, 1.0),
        (0.803955078125, 1.0),
        (0.0002148151397705, 0.001288890838623),
        (0.988100528717041, 1.0),
        (0.7997725009918213, 1.0),
    ],
    "label_policy": [
        (0.5303222090005875, 1.0),
        (0.2913762927055359, 1.0),
        (0.3272097110748291, 1.0),
        (0.6570012671339999, 1.0),
        (0.04152512550354, 0.2491507530212402),
        (0.0111565589904785, 0.0780959129333496),
        (0.0054144859313964, 0.0433158874511718),
        (0.2226152420043945, 1.0),
    ],
}

# Published (n, mean, sd, low, high) of two interval estimates.
PUBLISHED_INTERVALS = [
    (23, 0.5765977974281961, 0.0567456118864599, 0.5520591547254653, 0.6011364401309268),
    (15, 0.3429452385447819, 0.065339852870241, 0.3067612340966782, 0.3791292429928856),
]


def test_holm_reproduces_published_families(spark):
    rows = [(f, i, p, want) for f, ps in PUBLISHED.items() for i, (p, want) in enumerate(ps)] + [("label_policy", 99, None, None)]
    df = spark.createDataFrame(rows, "family string, i int, p_wilcoxon double, want double")
    for r in inference.with_holm(df, ["family"], key=["i"]).collect():
        assert r["p_holm"] == (None if r["want"] is None else pytest.approx(r["want"], rel=1e-9))


@pytest.mark.parametrize("n,mean,sd,low,high", PUBLISHED_INTERVALS)
def test_t_multiplier_reproduces_published_intervals(n, mean, sd, low, high):
    half = t_quantile(n - 1) * sd / math.sqrt(n)
    assert mean - half == pytest.approx(low, abs=1e-9) and mean + half == pytest.approx(high, abs=1e-9)


def test_pairing(spark):
    a = spark.createDataFrame([(i, v) for i, v in enumerate([0.40, 0.42, 0.38, 0.45, 0.41, 0.39])], "fold int, v double")
    b = spark.createDataFrame([(i, v) for i, v in enumerate([0.30, 0.33, 0.31, 0.36, 0.30, 0.32])], "fold int, v double")
    pairs = inference.paired_differences(a, b, ["fold"], "v")
    d = np.array([0.10, 0.09, 0.07, 0.09, 0.11, 0.07])
    assert pairs.agg(inference.cohens_dz().alias("z")).first()["z"] == pytest.approx(d.mean() / d.std(ddof=1))
    assert inference.unmatched_units(a, b, ["fold"]).count() == 0
    assert inference.unmatched_units(a, b.where("fold < 5"), ["fold"]).first()["only_in"] == "a"
    constant = spark.createDataFrame([(1.0,), (1.0,)], "diff double")
    assert constant.agg(inference.cohens_dz().alias("z")).first()["z"] is None


def test_boundary_counts(spark):
    df = spark.createDataFrame([(v,) for v in (3.0, 3.0, 2.75, 3.25, 4.0, 1.0)], "valence double")
    row = label_stats.boundary_statistics(df, "valence", 3.0).where("delta = 0.25").first()
    assert (row["at_threshold_count"], row["boundary_count"], row["boundary_excluding_ties_count"], row["nominal_high_count"]) == (2, 4, 2, 2)
    assert label_stats.threshold_sweep(df, "valence", 3.0).count() == 9
