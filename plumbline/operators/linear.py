"""Linear classifiers for many folds at once.

All folds, classes and label permutations of a design are solved together: each Newton
step is one Spark job in which every partition adds up loss, gradient and curvature of
all problems in one pass over its rows, and the sums (problems x d x d numbers) are
combined by a grouped vector sum.  Softmax models ask for loss and gradient only (problems x classes x d numbers).  Rows are never repeated per fold and never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import settle

LOGISTIC, SVM = "logistic", "svm"

#: Problems solved in one pass; more are solved in several passes.
BATCH = 64
#: Rows that a task holds as matrices at a time.
PIECE = 1024
#: Partial sums of a problem meet in this many tasks first.
BRANCHES = 16
#: Newton steps before a problem is reported as not converged, and the gradient that counts as zero.
MAX_STEPS, GRADIENT_TOLERANCE = 100, 1e-8


@dataclass(frozen=True)
class Solution:
    """Coefficients in the original feature space, one row per problem, intercept last."""

    coefficients: np.ndarray
    gradient: np.ndarray
    converged: np.ndarray
    steps: int


def training_table(features: DataFrame, members: DataFrame, n_problems: int, key: str = "row_index") -> DataFrame:
    """``features, y, w``: per row the target (+1 or -1) and weight in every problem (weight 0: not in it).

    ``members`` has ``problem, key, y, w`` with problems numbered from 0.
    """
    entry = F.struct(F.col("problem").cast("int"), F.struct("y", "w"))
    per_row = members.groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("_in"))
    numbers = F.sequence(F.lit(0), F.lit(n_problems - 1))
    table = features.select(key, F.col("features").cast("array<double>").alias("features")).join(per_row, key)
    return settle(
        table.select(
            "features",
            F.transform(numbers, lambda p: F.coalesce(F.try_element_at("_in", p)["y"], F.lit(0.0))).alias("y"),
            F.transform(numbers, lambda p: F.coalesce(F.try_element_at("_in", p)["w"], F.lit(0.0))).alias("w"),
        )
    )


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as a matrix."""
    numbers = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if (np.diff(column.offsets.to_numpy()) != numbers.shape[1]).any():
        raise ValueError("all lists must have one length")
    return numbers


def _summed(table: DataFrame, numbers: Sequence[int], width: int, of_rows: Callable) -> dict[int, np.ndarray]:
    """``of_rows(problem, x, y, w)`` added up over all rows of each problem: one Spark job, no row is copied.

    Every partition adds up its rows, ``BRANCHES`` tasks add up partitions (where there are more), then one row per problem is left.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((len(numbers), width))
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                x, y, w = (_matrix(batch.slice(start, PIECE).column(c)) for c in range(3))
                for a, p in enumerate(numbers):
                    rows = w[:, p] > 0
                    acc[a] += of_rows(p, x[rows], y[rows, p], w[rows, p])
            del batch
        branch = np.full(len(numbers), TaskContext.get().partitionId() % BRANCHES, np.int32)
        ends = pa.array(np.arange(len(numbers) + 1) * width, pa.int32())
        columns = [pa.array(numbers, pa.int32()), pa.array(branch), pa.ListArray.from_arrays(ends, acc.ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["problem", "branch", "sums"])

    def added(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))

    partial = table.select("features", "y", "w").mapInArrow(sums, "problem int, branch int, sums array<double>")
    if table.rdd.getNumPartitions() > BRANCHES:
        partial = added(partial, "problem", "branch")
    return {r["problem"]: np.asarray(r["sums"]) for r in added(partial, "problem").collect()}


def _scales(table: DataFrame, n_problems: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population sd of the training rows of each problem (constant columns: 1): two passes."""
    d = table.select(F.size("features")).first()[0]
    every = list(range(n_problems))
    first = _summed(table, every, d + 1, lambda p, x, y, w: np.append(x.sum(axis=0), len(x)))
    count = np.array([max(1.0, first[p][-1]) for p in every])
    mean = np.array([first[p][:-1] for p in every]) / count[:, None]
    second = _summed(table, every, d, lambda p, x, y, w: ((x - mean[p]) ** 2).sum(axis=0))
    sd = np.sqrt(np.array([second[p] for p in every]) / count[:, None])
    return mean, np.where(sd > 0, sd, 1.0)


def _pointwise(loss: str, margin: np.ndarray, weight: np.ndarray):
    """Loss, slope and curvature per row along the margin ``y * score``."""
    if loss == LOGISTIC:
        p = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))
        return weight * np.logaddexp(0.0, -margin), -weight * p, weight * p * (1.0 - p)
    gap = np.maximum(1.0 - margin, 0.0)
    return weight * gap**2, -2.0 * weight * gap, 2.0 * weight * (gap > 0)


def _pass(table: DataFrame, loss: str, points: np.ndarray, mean: np.ndarray, sd: np.ndarray, active: list[int]):
    """Summed loss, gradient and curvature of the active problems at ``points``: one Spark job."""
    d = points.shape[1]

    def of_rows(p: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - mean[p]) / sd[p], np.ones(len(x))])
        value, slope, bend = _pointwise(loss, y * (z @ points[p]), w)
        return np.concatenate([[value.sum()], z.T @ (slope * y), (z.T @ (z * bend[:, None])).ravel()])

    found = _summed(table, list(active), 1 + d + d * d, of_rows)
    return {p: (s[0], s[1 : 1 + d], s[1 + d :].reshape(d, d)) for p, s in found.items()}


def solve(table: DataFrame, n_problems: int, loss: str, c: float = 1.0, max_steps: int = MAX_STEPS, intercept_ridge: float | None = None) -> Solution:
    """Minimise ``0.5 |w|^2 + C * sum(weight * loss)`` on features standardised per problem.

    Logistic: log loss, free intercept.  SVM: squared hinge, the intercept is penalised
    like a weight.  ``intercept_ridge`` sets that penalty otherwise.  Newton steps with halving, until the gradient vanishes; a problem
    whose gradient does not vanish within ``max_steps`` is marked, never passed as solved.
    """
    mean, sd = _scales(table, n_problems)
    d = mean.shape[1] + 1
    ridge = np.ones(d)
    ridge[-1] = float(loss != LOGISTIC) if intercept_ridge is None else intercept_ridge
    here = np.zeros((n_problems, d))
    step = np.zeros((n_problems, d))
    value = np.full(n_problems, np.inf)
    gradient = np.full(n_problems, np.inf)
    converged = np.zeros(n_problems, bool)
    active, steps = list(range(n_problems)), 0
    while active and steps < max_steps:
        steps += 1
        at = _pass(table, loss, here + step, mean, sd, active)
        for p in list(active):
            point = here[p] + step[p]
            data_loss, data_gradient, data_curvature = at[p]
            f = c * data_loss + 0.5 * (ridge * point) @ point
            if f > value[p] + 1e-12 * abs(value[p]):
                step[p] *= 0.5
                if np.abs(step[p]).max() < 1e-14:  # rounding decides here: solved if the slope is small for the size of the loss
                    converged[p] = gradient[p] <= 1e-5 * max(1.0, abs(value[p]))
                    active.remove(p)
                continue
            g = c * data_gradient + ridge * point
            h = c * data_curvature + np.diag(ridge)
            here[p], value[p], gradient[p] = point, f, np.abs(g).max()
            step[p] = -np.linalg.lstsq(h, g, rcond=None)[0]
            if gradient[p] <= GRADIENT_TOLERANCE * max(1.0, abs(f)):
                step[p] = 0.0
                converged[p] = True
                active.remove(p)
    raw = here.copy()
    raw[:, :-1] /= sd
    raw[:, -1] -= (raw[:, :-1] * mean).sum(axis=1)
    return Solution(raw, gradient, converged, steps)


# -- designs ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Design:
    """Which problem scores which class in which fold (and permutation)."""

    units: list[tuple]
    classes: list[str]
    softmax: bool = False

    @property
    def one_per_unit(self) -> bool:
        return self.softmax or len(self.classes) == 2

    @property
    def n_problems(self) -> int:
        return len(self.units) * (1 if self.one_per_unit else len(self.classes))

    def members(self, train: DataFrame, unit: Sequence[str], label: str, balanced: bool) -> DataFrame:
        """``problem, row_index, y, w``: two classes and softmax are one problem (softmax: y is the class number), others one against the rest."""
        spark = train.sparkSession
        index = spark.createDataFrame(
            [(*u, i) for i, u in enumerate(self.units)],
            ", ".join(f"{c} {t}" for c, t in train.select(*unit).dtypes) + ", _unit int",
        )
        counts = train.groupBy(*unit, label).agg(F.count(F.lit(1)).alias("_n"))
        sizes = counts.groupBy(*unit).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
        weight = F.col("_all") / (F.col("_k") * F.col("_n")) if balanced else F.lit(1.0)
        weights = counts.join(sizes, list(unit)).select(*unit, label, weight.alias("w"))
        rows = train.join(F.broadcast(index), list(unit)).join(weights, [*unit, label])
        if self.one_per_unit:
            number = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(label)) - 1
            y = number.cast("double") if self.softmax else F.when(F.col(label) == self.classes[1], 1.0).otherwise(-1.0)
            return rows.select(F.col("_unit").alias("problem"), "row_index", y.alias("y"), "w")
        names = F.array(*[F.lit(c) for c in self.classes])
        spread = rows.select("*", F.posexplode(names).alias("_c", "_name"))
        y = F.when(F.col(label) == F.col("_name"), 1.0).otherwise(-1.0)
        return spread.select((F.col("_unit") * len(self.classes) + F.col("_c")).alias("problem"), "row_index", y.alias("y"), "w")


def fit_predict(
    assignments: DataFrame,
    features: DataFrame,
    classes: Sequence[str],
    loss: str,
    unit: Sequence[str] = ("fold",),
    label: str = "target_label",
    test_label: str | None = None,
    balanced: bool = True,
    on: str = "test",
    intercept_ridge: float | None = None,
) -> DataFrame:
    """``unit, row_index, y_true, y_pred, converged`` of a linear model per unit (fold, or fold and permutation).

    ``assignments`` has ``unit, row_index, split, label``; models see rows with split
    ``train`` and predict rows with split ``on``.
    """
    unit, classes = list(unit), sorted(classes)
    units = sorted(tuple(r) for r in assignments.select(*unit).distinct().collect())
    softmax = loss == LOGISTIC and len(classes) > 2
    per_unit = 1 if softmax or len(classes) == 2 else len(classes)
    width = max(1, BATCH // per_unit)
    out = None
    for start in range(0, len(units), width):
        design = Design(units[start : start + width], classes, softmax)
        mine = assignments
        if len(units) > width:
            index = assignments.sparkSession.createDataFrame(
                design.units, ", ".join(f"{c} {t}" for c, t in assignments.select(*unit).dtypes)
            )
            mine = assignments.join(F.broadcast(index), unit, "left_semi")
        train = mine.where(F.col("split") == "train")
        table = training_table(features, design.members(train, unit, label, balanced), design.n_problems)
        solution = solve_softmax(table, design.n_problems, len(classes)) if softmax else solve(table, design.n_problems, loss, intercept_ridge=intercept_ridge)
        part = _predict(mine.where(F.col("split") == on), features, design, solution, unit, test_label or label)
        out = part if out is None else out.unionByName(part)
    return out


def _chosen(weights: np.ndarray, unit: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Class numbers that ``weights`` (unit, class, feature and intercept) give to rows, piece by piece; no row gets a copy of its weights."""
    out = np.zeros(len(x), int)
    for start in range(0, len(x), PIECE):
        z = np.column_stack([np.stack(x[start : start + PIECE]).astype(float), np.ones(len(x[start : start + PIECE]))])
        mine = unit[start : start + PIECE]
        for u in np.unique(mine):
            scores = z[mine == u] @ weights[u].T
            chosen = (scores[:, 0] > 0).astype(int) if scores.shape[1] == 1 else scores.argmax(axis=1)
            out[start : start + PIECE][mine == u] = chosen
    return out


def _predict(test: DataFrame, features: DataFrame, design: Design, solution: Solution, unit: list[str], label: str) -> DataFrame:
    names = np.asarray(design.classes, dtype=object)
    place = {u: i for i, u in enumerate(design.units)}
    k = 1 if len(names) == 2 else len(names)
    weights = solution.coefficients.reshape(len(place), k, -1)
    solved = solution.converged.reshape(len(place), -1).all(axis=1)
    codes = test.sparkSession.createDataFrame(
        [(*u, i, bool(solved[i])) for u, i in place.items()],
        ", ".join(f"{c} {t}" for c, t in test.select(*unit).dtypes) + ", _unit int, converged boolean",
    )

    @F.pandas_udf("string")
    def predict(index: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(names[_chosen(weights, index.to_numpy(), x.to_numpy())])

    vectors = features.select("row_index", F.col("features").cast("array<double>").alias("_x"))
    joined = test.join(F.broadcast(codes), unit).join(vectors, "row_index")  # one code per unit of the batch
    return joined.select(
        *unit, "row_index", F.col(label).alias("y_true"), predict("_unit", "_x").alias("y_pred"), "converged"
    )


# -- softmax --------------------------------------------------------------------------------


def _softmax_pass(table: DataFrame, points: np.ndarray, mean: np.ndarray, sd: np.ndarray, active: list[int]) -> dict[int, tuple[float, np.ndarray]]:
    """Summed log loss and gradient of the active problems at ``points`` (problem, class, feature and intercept): one Spark job."""
    n_classes, d = points.shape[1:]

    def of_rows(p: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - mean[p]) / sd[p], np.ones(len(x))])
        scores = z @ points[p].T
        scores -= scores.max(axis=1, keepdims=True)
        mass = np.exp(scores)
        total = mass.sum(axis=1)
        own = y.astype(int)
        loss = w * (np.log(total) - scores[np.arange(len(x)), own])
        slope = mass / total[:, None]
        slope[np.arange(len(x)), own] -= 1.0
        return np.append((slope * w[:, None]).T @ z, loss.sum())

    found = _summed(table, list(active), n_classes * d + 1, of_rows)
    return {p: (s[-1], s[:-1].reshape(n_classes, d)) for p, s in found.items()}


class _Descent:
    """Limited-memory quasi-Newton search of one problem; values and gradients come from outside."""

    MEMORY = 12

    def __init__(self, size: int):
        self.here, self.value, self.gradient = np.zeros(size), np.inf, None
        self.step, self.pairs = np.zeros(size), []

    @property
    def asked(self) -> np.ndarray:
        return self.here + self.step

    def told(self, value: float, gradient: np.ndarray) -> bool | None:
        """Takes value and gradient at ``asked``; True: solved, False: stuck, None: go on."""
        if self.gradient is not None:
            if value > self.value + 1e-4 * (self.step @ self.gradient) + 1e-13 * abs(self.value):
                self.step = 0.5 * self.step
                if np.abs(self.step).max() > 1e-14:
                    return None
                return bool(np.abs(self.gradient).max() <= 1e-5 * max(1.0, abs(self.value)))
            change = gradient - self.gradient
            if self.step @ change > 1e-14 * (change @ change):
                self.pairs = [*self.pairs[1 - self.MEMORY :], (self.step, change)]
        self.here, self.value, self.gradient = self.asked, value, gradient
        self.step = np.zeros_like(self.here)
        if np.abs(gradient).max() <= 10 * GRADIENT_TOLERANCE * max(1.0, abs(value)):
            return True
        self.step = -self._inverse_times(gradient)
        return None

    def _inverse_times(self, g: np.ndarray) -> np.ndarray:
        q, kept = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append((s, y, a))
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).max())
        for s, y, a in reversed(kept):
            q += (a - (y @ q) / (s @ y)) * s
        return q


def solve_softmax(table: DataFrame, n_problems: int, n_classes: int, c: float = 1.0, max_passes: int = 1000) -> Solution:
    """Minimise ``0.5 |w|^2 + C * sum(weight * log loss)`` of softmax models, intercepts free, features standardised per problem.

    ``y`` of the table is the class number.  All problems move together: one pass over the rows
    gives every active problem the value and gradient it asked for; no second derivatives are summed.
    """
    mean, sd = _scales(table, n_problems)
    d = mean.shape[1] + 1
    ridge = np.ones((n_classes, d))
    ridge[:, -1] = 0.0
    searches = [_Descent(n_classes * d) for _ in range(n_problems)]
    converged, active, passes = np.zeros(n_problems, bool), list(range(n_problems)), 0
    while active and passes < max_passes:
        passes += 1
        points = np.stack([s.asked.reshape(n_classes, d) for s in searches])
        at = _softmax_pass(table, points, mean, sd, active)
        for p in list(active):
            loss, slope = at[p]
            done = searches[p].told(c * loss + 0.5 * (ridge * points[p] ** 2).sum(), (c * slope + ridge * points[p]).ravel())
            if done is not None:
                converged[p] = done
                active.remove(p)
    raw = np.stack([s.here.reshape(n_classes, d) for s in searches])
    raw[:, :, :-1] /= sd[:, None, :]
    raw[:, :, -1] -= (raw[:, :, :-1] * mean[:, None, :]).sum(axis=2)
    gradient = np.array([np.abs(s.gradient).max() if s.gradient is not None else np.inf for s in searches])
    return Solution(raw.reshape(n_problems, -1), gradient, converged, passes)
