"""Windows, signal transforms and feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import as_channels
from plumbline.operators import features, signals, spectra, windows
from plumbline.plans.bindings import SEED, table
from plumbline.plans.catalog import query

CHANNELS, SAMPLES = 4, 16
TEST_BANDS = {"low": (0.5, 1.0), "alpha": (1.0, 2.0)}


def signal_windows(spark, sf) -> DataFrame:
    """``embeddings`` read as windows of 4 channels x 16 samples."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_index"), "label", as_channels("embedding", CHANNELS, SAMPLES).alias("signal")
    )


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_index"), "label", F.col("embedding").cast("array<double>").alias("features")
    )


def long_signal(df: DataFrame) -> DataFrame:
    """``row_index, channel, i, v`` with values rounded."""
    channels = df.select("row_index", F.posexplode("signal").alias("channel", "c"))
    return channels.select("row_index", "channel", F.posexplode("c").alias("i", "v")).select(
        "row_index", "channel", "i", (F.round("v", 5) + 0.0).alias("v")
    )


def long_features(df: DataFrame, key: str = "row_index", name: str = "features", digits: int = 5) -> DataFrame:
    return df.select(key, F.posexplode(name).alias("i", "v")).select(key, "i", (F.round("v", digits) + 0.0).alias("v"))


WINDOWS_SQL = """wide AS (SELECT vec_id AS row_index, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
long AS (
  SELECT row_index, label, CAST(p // 16 AS INTEGER) AS channel, CAST(p % 16 AS INTEGER) AS i, e[p + 1] AS v
  FROM wide, range(0, 64) r(p))"""


# -- windows --------------------------------------------------------------------------------


@query(
    "recording_windows",
    """WITH numbered AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
cut AS (SELECT user_id, i // 16 AS w, count(*) AS n, round(sum(value), 4) AS total, round(arg_min(value, i), 4) AS first_value,
               round(arg_max(value, i), 4) AS last_value FROM numbered GROUP BY ALL)
SELECT user_id, w AS "window", total, first_value, last_value FROM cut WHERE n = 16""",
)
def _recording(spark, sf):
    samples = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    numbered = windows.sequence_number(samples, ["user_id"], ["ts", "event_id"], "i")
    cut = windows.cut_windows(numbered, "user_id", "i", "value", 16)
    total = F.aggregate("samples", F.lit(0.0), lambda acc, v: acc + v)
    return cut.select(
        "user_id",
        "window",
        F.round(total, 4).alias("total"),
        F.round(F.element_at("samples", 1), 4).alias("first_value"),
        F.round(F.element_at("samples", -1), 4).alias("last_value"),
    )


@query(
    "overlapping_windows",
    """WITH numbered AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
starts AS (SELECT DISTINCT user_id, i // 6 AS w FROM numbered),
cut AS (
  SELECT s.user_id, s.w, count(*) AS n, round(sum(value), 4) AS total FROM starts s JOIN numbered n
  ON n.user_id = s.user_id AND n.i >= s.w * 6 AND n.i < s.w * 6 + 8 GROUP BY ALL)
SELECT user_id, w AS "window", total FROM cut WHERE n = 8""",
)
def _overlapping(spark, sf):
    samples = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    numbered = windows.sequence_number(samples, ["user_id"], ["ts", "event_id"], "i")
    cut = windows.cut_windows(numbered, "user_id", "i", "value", 8, overlap=2)
    total = F.aggregate("samples", F.lit(0.0), lambda acc, v: acc + v)
    return cut.select("user_id", "window", F.round(total, 4).alias("total"))


# -- transforms -------------------------------------------------------------------------------


@query("time_reverse", f"WITH {WINDOWS_SQL} SELECT row_index, channel, 15 - i AS i, round(v, 5) + 0.0 AS v FROM long")
def _reverse(spark, sf):
    return long_signal(signal_windows(spark, sf).withColumn("signal", signals.time_reverse("signal")))


@query(
    "time_shuffle",
    f"""WITH {WINDOWS_SQL}
SELECT row_index, channel, CAST(row_number() OVER (PARTITION BY row_index, channel ORDER BY md5(({SEED} + row_index) || ':' || i), i) - 1 AS INTEGER) AS i,
       round(v, 5) + 0.0 AS v FROM long""",
)
def _shuffle(spark, sf):
    return long_signal(signal_windows(spark, sf).withColumn("signal", signals.time_shuffle("signal", SEED)))


def _magnitude_sql(n: int) -> str:
    return f"""bins AS (
  SELECT row_index, channel, k, sum(v * cos(2 * pi() * k * i / {n})) AS re, -sum(v * sin(2 * pi() * k * i / {n})) AS im
  FROM long, range(0, {n // 2 + 1}) r(k) GROUP BY ALL)"""


@query(
    "phase_random_invariants",
    f"""WITH {WINDOWS_SQL}, {_magnitude_sql(SAMPLES)}
SELECT a.row_index, a.channel, CAST(a.k AS INTEGER) AS k, round(a.re * a.re + a.im * a.im, 4) + 0.0 AS power,
       round(a.re * b.re + a.im * b.im, 4) + 0.0 AS cross_re, round(a.im * b.re - a.re * b.im, 4) + 0.0 AS cross_im
FROM bins a JOIN bins b ON a.row_index = b.row_index AND a.k = b.k AND b.channel = 0""",
)
def _phase(spark, sf):
    """Power and cross-spectrum (with channel 0) of the surrogate equal those of the original window."""
    changed = signal_windows(spark, sf).withColumn("signal", signals.phase_random("signal", SEED))
    samples = changed.select("row_index", F.posexplode("signal").alias("channel", "c"))
    k = F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // 2)))

    def part(wave):
        return F.aggregate(
            F.zip_with("c", F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda v, i: v * wave(2 * 3.141592653589793 * F.col("k") * i / SAMPLES)),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )

    bins = samples.withColumn("k", k).select(
        "row_index", "channel", "k", part(F.cos).alias("re"), (-part(F.sin)).alias("im")
    )
    first = bins.where("channel = 0").select("row_index", "k", F.col("re").alias("re0"), F.col("im").alias("im0"))
    both = bins.join(first, ["row_index", "k"])
    return both.select(
        "row_index",
        "channel",
        "k",
        (F.round(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 4) + 0.0).alias("power"),
        (F.round(F.col("re") * F.col("re0") + F.col("im") * F.col("im0"), 4) + 0.0).alias("cross_re"),
        (F.round(F.col("im") * F.col("re0") - F.col("re") * F.col("im0"), 4) + 0.0).alias("cross_im"),
    )


@query(
    "injected_signal",
    f"""WITH {WINDOWS_SQL}, sd AS (SELECT row_index, channel, stddev_pop(v) AS sd FROM long GROUP BY ALL)
SELECT row_index, channel, i, round(v + CASE WHEN label = 0 THEN 0.5 * sd * sin(2 * pi() * 10 * i / 128) ELSE 0 END, 5) + 0.0 AS v
FROM long JOIN sd USING (row_index, channel)""",
)
def _inject(spark, sf):
    return long_signal(signal_windows(spark, sf).withColumn("signal", signals.inject_signal("signal", "label", 0.5, 128.0)))


@query(
    "window_zscore",
    f"""WITH {WINDOWS_SQL}, m AS (SELECT row_index, channel, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY ALL)
SELECT row_index, channel, i, round((v - m) / (sd + 1e-6), 5) + 0.0 AS v FROM long JOIN m USING (row_index, channel)""",
)
def _zscore(spark, sf):
    return long_signal(signal_windows(spark, sf).withColumn("signal", signals.zscore("signal")))


# -- band power -----------------------------------------------------------------------------------

# Segments of 8 samples, half overlapping: three per window at 4 Hz, bins 0.5 Hz apart.
BAND_SQL = f"""{WINDOWS_SQL},
segments AS (SELECT row_index, channel, s, i - s * 4 AS n, v FROM long, range(0, 3) g(s) WHERE i >= s * 4 AND i < s * 4 + 8),
tapered AS (
  SELECT *, (v - avg(v) OVER (PARTITION BY row_index, channel, s)) * (0.5 - 0.5 * cos(2 * pi() * n / 8)) AS x FROM segments),
dft AS (
  SELECT row_index, channel, s, k, sum(x * cos(2 * pi() * k * n / 8)) AS re, sum(x * sin(2 * pi() * k * n / 8)) AS im
  FROM tapered, range(0, 5) r(k) GROUP BY ALL),
density AS (
  SELECT row_index, channel, k, avg((re * re + im * im) / (4 * 3.0)) * max(CASE WHEN k IN (0, 4) THEN 1 ELSE 2 END) AS p FROM dft GROUP BY row_index, channel, k),
bands(band, name, low, high) AS (VALUES (0, 'low', 0.5, 1.0), (1, 'alpha', 1.0, 2.0)),
powers AS (
  SELECT row_index, band, name, channel, avg(p) AS p FROM density JOIN bands ON k * 0.5 BETWEEN low AND high GROUP BY ALL)"""


@query(
    "band_power",
    f"WITH {BAND_SQL} SELECT row_index, CAST(band * 4 + channel AS INTEGER) AS i, round(p, 6) + 0.0 AS v FROM powers",
)
def _band_power(spark, sf):
    rows = signal_windows(spark, sf).withColumn("features", spectra.band_power("signal", 4.0, TEST_BANDS))
    return long_features(rows, digits=6)


@query(
    "spectral_features",
    f"""WITH {BAND_SQL}
SELECT row_index, 'spectral' AS feature_set, CAST(band * 4 + channel AS INTEGER) AS i, round(ln(1 + p), 4) + 0.0 AS v FROM powers
UNION ALL SELECT row_index, 'alpha', channel, round(ln(1 + p), 4) FROM powers WHERE name = 'alpha'""",
)
def _spectral(spark, sf):
    out = spectra.extract_features(signal_windows(spark, sf), "signal", 4.0, CHANNELS, TEST_BANDS)
    sets = F.explode(
        F.array(*[F.struct(F.lit(n).alias("feature_set"), F.col(n).cast("array<double>").alias("x")) for n in ("spectral", "alpha")])
    )
    long = out.select("row_index", sets.alias("s")).select("row_index", "s.feature_set", F.posexplode("s.x").alias("i", "v"))
    return long.select("row_index", "feature_set", "i", F.round("v", 4).alias("v"))


# -- feature vectors --------------------------------------------------------------------------------


def _shared_sql() -> str:
    positions = features.shared_positions("deap")
    pairs = ", ".join(f"({b * 14 + j}, {b * 32 + p})" for b in range(2) for j, p in enumerate(positions))
    return f"shared(i, p) AS (VALUES {pairs})"


@query(
    "shared_montage",
    f"""WITH {WINDOWS_SQL}, {_shared_sql()} SELECT row_index, i, round(e[p + 1], 5) + 0.0 AS v FROM wide, shared""",
)
def _montage(spark, sf):
    """64 features as 2 bands x 32 channels, reduced to the 14 shared channels."""
    picked = features.select_feature_channels(F.col("features"), 2, 32, features.shared_positions("deap"))
    return long_features(vectors(spark, sf).withColumn("features", picked))


@query(
    "channel_pooling",
    f"""WITH {WINDOWS_SQL},
stats AS (SELECT row_index, channel AS b, avg(v) AS s0, stddev_pop(v) AS s1, min(v) AS s2, max(v) AS s3 FROM long GROUP BY ALL)
SELECT row_index, CAST(b AS INTEGER) AS i, round(s0, 5) + 0.0 AS v FROM stats UNION ALL SELECT row_index, 4 + b, round(s1, 5) + 0.0 FROM stats
UNION ALL SELECT row_index, 8 + b, round(s2, 5) + 0.0 FROM stats UNION ALL SELECT row_index, 12 + b, round(s3, 5) + 0.0 FROM stats""",
)
def _pooling(spark, sf):
    rows = vectors(spark, sf)
    return long_features(rows.withColumn("features", features.pool_channels(F.col("features"), 4, 16)))


@query(
    "trial_mean_features",
    """WITH wide AS (SELECT label || '_' || (vec_id % 7) AS trial, vec_id, embedding FROM embeddings)
SELECT trial, CAST(p AS INTEGER) AS i, round(avg(CAST(embedding[p + 1] AS DOUBLE)), 5) + 0.0 AS v FROM wide, range(0, 64) r(p) GROUP BY trial, p""",
)
def _trial_means(spark, sf):
    rows = vectors(spark, sf).withColumn("trial", F.concat_ws("_", "label", F.pmod("row_index", F.lit(7))))
    return long_features(features.trial_means(rows, ["trial"], "features", ["label"]), "trial")


@query(
    "independent_znorm",
    f"""WITH {WINDOWS_SQL},
flat AS (SELECT row_index, label < 5 AS d, channel * 16 + i AS i, v FROM long),
stats AS (SELECT d, i, avg(v) AS m, stddev_pop(v) AS sd FROM flat GROUP BY ALL)
SELECT row_index, i, round((v - m) / (sd + 1e-6), 5) + 0.0 AS v FROM flat JOIN stats USING (d, i)""",
)
def _znorm(spark, sf):
    rows = vectors(spark, sf).withColumn("domain", F.col("label") < 5)
    return long_features(features.znorm_by_domain(rows, "domain", "features"))


@query(
    "standardize_on_train",
    f"""WITH {WINDOWS_SQL},
flat AS (SELECT row_index, channel * 16 + i AS i, v FROM long),
stats AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM flat WHERE row_index % 3 <> 0 GROUP BY ALL)
SELECT row_index, i, round((v - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 5) + 0.0 AS v FROM flat JOIN stats USING (i)""",
)
def _standardize(spark, sf):
    return long_features(features.standardize_on_train(vectors(spark, sf), "features", F.col("row_index") % 3 != 0))


COV_SQL = f"""{WINDOWS_SQL}, flat AS (SELECT row_index, channel * 16 + i AS i, v FROM long WHERE label >= 5)
SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM flat a JOIN flat b USING (row_index) GROUP BY a.i, b.i"""


@query("feature_covariance", f"WITH {COV_SQL}")
def _covariance(spark, sf):
    target = vectors(spark, sf).where("label >= 5")
    return features.covariance_table(target, "features").select("i", "j", (F.round("cov", 6) + 0.0).alias("cov"))


@query("coral_alignment", f"WITH {COV_SQL.replace(', 6)', ', 2)')}")
def _coral(spark, sf):
    """The aligned source has the covariance of the target (up to the ridge)."""
    rows = vectors(spark, sf)
    aligned = features.coral_align(rows.where("label < 5"), rows.where("label >= 5"), "features")
    return features.covariance_table(aligned, "features").select("i", "j", (F.round("cov", 2) + 0.0).alias("cov"))
