import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import features, signals, spectra


def frame(spark, arrays):
    return spark.createDataFrame([(i, [list(map(float, c)) for c in a]) for i, a in enumerate(arrays)], "row_index long, signal array<array<double>>")


def back(df):
    return [np.array(r["signal"]) for r in df.orderBy("row_index").collect()]


def wave(rng, n):
    t = np.arange(n) / 128
    return np.stack([np.sin(2 * np.pi * 10 * t + c) + 0.5 * np.sin(2 * np.pi * 3 * t) + 0.3 * rng.normal(size=n) for c in range(4)])


@pytest.mark.parametrize("n", [256, 255])
def test_phase_random_keeps_magnitude_and_cross_spectrum(spark, rng, n):
    x = [wave(rng, n), wave(rng, n)]
    once = back(frame(spark, x).withColumn("signal", signals.phase_random("signal", 3)))
    again = back(frame(spark, x).withColumn("signal", signals.phase_random("signal", 3)))
    for a, b, c in zip(x, once, again, strict=True):
        fa, fb = np.fft.rfft(a), np.fft.rfft(b)
        assert np.allclose(np.abs(fa), np.abs(fb), atol=1e-6) and not np.allclose(a, b, atol=1e-2)
        assert np.allclose(fa[0] * np.conj(fa[1]), fb[0] * np.conj(fb[1]), atol=1e-6)
        assert np.array_equal(b, c)


def test_phases_depend_on_seed_row_and_bin_alone():
    keys = np.arange(-300, 3000)
    a = signals.counter_uniform(3, keys, 129)
    assert np.array_equal(a[100:105], signals.counter_uniform(3, keys[100:105], 129)) and np.array_equal(a[:, :7], signals.counter_uniform(3, keys, 7))
    assert a.min() >= 0 and a.max() < 1 and abs(a.mean() - 0.5) < 0.002 and np.abs(np.exp(2j * np.pi * a).mean(axis=0)).max() < 0.08
    assert abs(np.corrcoef(a[:-1].ravel(), a[1:].ravel())[0, 1]) < 0.01 and not np.array_equal(a, signals.counter_uniform(4, keys, 129))


def test_reverse_and_shuffle(spark, rng):
    x = [wave(rng, 256), wave(rng, 256)]
    reversed_ = back(frame(spark, x).withColumn("signal", signals.apply_mode("signal", "time_reverse", 1)))
    shuffled = back(frame(spark, x).withColumn("signal", signals.apply_mode("signal", "time_shuffle", 1)))
    for a, r, s in zip(x, reversed_, shuffled, strict=True):
        assert np.allclose(r, a[:, ::-1])
        assert np.allclose(np.sort(s, axis=1), np.sort(a, axis=1))
        order = [int(np.flatnonzero(a[0] == v)[0]) for v in s[0]]
        assert np.allclose(s, a[:, order])  # one order for all channels
        change = np.abs(np.abs(np.fft.rfft(s)) - np.abs(np.fft.rfft(a))).sum() / np.abs(np.fft.rfft(a)).sum()
        assert change > 0.3
    with pytest.raises(ValueError):
        signals.apply_mode("signal", "no such mode", 1)


def test_zscore_and_injection(spark, rng):
    x = [wave(rng, 128)]
    z = back(frame(spark, x).withColumn("signal", signals.zscore("signal")))[0]
    assert np.allclose(z, (x[0] - x[0].mean(1, keepdims=True)) / (x[0].std(1, keepdims=True) + 1e-6))
    df = frame(spark, x).withColumn("k", F.lit(0))
    hot = back(df.withColumn("signal", signals.inject_signal("signal", "k", 0.5, 128.0)))[0]
    assert np.allclose(hot, x[0] + 0.5 * x[0].std(1, keepdims=True) * np.sin(2 * np.pi * 10 * np.arange(128) / 128))
    cold = back(df.withColumn("signal", signals.inject_signal("signal", F.lit(1), 0.5, 128.0)))[0]
    assert np.allclose(cold, x[0])


def direct_density(x, fs):
    """Welch by its definition, with explicit sums."""
    size = min(len(x), int(2 * fs))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    starts = range(0, len(x) - size + 1, size - size // 2)
    out = np.zeros(size // 2 + 1)
    for s in starts:
        seg = (x[s : s + size] - x[s : s + size].mean()) * w
        for k in range(len(out)):
            p = abs(np.sum(seg * np.exp(-2j * np.pi * k * np.arange(size) / size))) ** 2 / (fs * np.sum(w**2))
            out[k] += p * (1 if k == 0 or (size % 2 == 0 and k == size // 2) else 2)
    return out / len(list(starts))


@pytest.mark.parametrize("n,fs", [(128, 128.0), (800, 200.0)])
def test_band_power_at_stock_sizes(spark, rng, n, fs):
    x = [rng.normal(size=(2, n)), rng.normal(size=(2, n))]
    got = [np.array(r["p"]) for r in frame(spark, x).withColumn("p", spectra.band_power("signal", fs)).orderBy("row_index").collect()]
    freqs = np.arange(min(n, int(2 * fs)) // 2 + 1) * fs / min(n, int(2 * fs))
    for a, p in zip(x, got, strict=True):
        want = [direct_density(a[c], fs)[(freqs >= lo) & (freqs <= hi)].mean() for lo, hi in spectra.BANDS.values() for c in range(2)]
        assert np.allclose(p, want)
    assert len(spectra.feature_names(spectra.BANDS, 2)) == 10


def test_empty_band_is_an_error():
    with pytest.raises(ValueError):
        spectra.band_bins(16, 16.0, {"beta": (13.0, 30.0)})


def test_montage_and_pooling(spark, rng):
    assert len(features.CHANNELS["deap"]) == 32 and features.shared_positions("dreamer") == list(range(14))
    assert tuple(features.CHANNELS["deap"][p] for p in features.shared_positions("deap")) == features.SHARED
    v = rng.normal(size=2 * 32)
    df = spark.createDataFrame([(0, list(map(float, v)))], "row_index long, features array<double>")
    picked = df.select(features.select_feature_channels(F.col("features"), 2, 32, features.shared_positions("deap")).alias("f")).first()["f"]
    assert np.allclose(picked, v.reshape(2, 32)[:, features.shared_positions("deap")].ravel())
    pooled = df.select(features.pool_channels(F.col("features"), 2, 32).alias("f")).first()["f"]
    m = v.reshape(2, 32)
    assert np.allclose(pooled, np.concatenate([m.mean(1), m.std(1), m.min(1), m.max(1)]))


def test_alignment(spark, rng):
    a, b = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 3, rng.normal(size=(200, 4)) * [1, 2, 3, 4]
    make = lambda x: spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "row_index long, features array<double>")
    mean, cov = features.covariance(make(b), "features")
    assert np.allclose(mean, b.mean(0)) and np.allclose(cov, np.cov(b, rowvar=False))
    aligned = np.array([r["features"] for r in features.coral_align(make(a), make(b), "features").collect()])
    assert np.allclose(np.cov(aligned, rowvar=False), np.cov(b, rowvar=False), atol=1e-2)
    assert np.allclose(aligned.mean(0), b.mean(0), atol=1e-6)
    both = make(a).withColumn("d", F.lit("a")).unionByName(make(b).withColumn("d", F.lit("b")))
    z = features.znorm_by_domain(both, "d", "features").where("d = 'a'").orderBy("row_index").collect()
    assert np.allclose([r["features"] for r in z], (a - a.mean(0)) / (a.std(0) + 1e-6))
    scaled = features.standardize_on_train(make(np.column_stack([b, np.full(200, 7.0)])), "features", F.col("row_index") < 100)
    got = np.array([r["features"] for r in scaled.orderBy("row_index").collect()])
    assert np.allclose(got[:, :4], (b - b[:100].mean(0)) / b[:100].std(0)) and np.allclose(got[:, 4], 0)
