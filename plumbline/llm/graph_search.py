"""Nearest neighbours by largest inner product, from robust-pruned directed graphs.

Distinct vectors are dealt to shards of about ``SHARD_ROWS``; every shard gets a graph and every
query is searched in every shard:

* **Reduction.**  Vectors of a shard whose lengths differ by less than the factor ``BAND`` are scaled to the unit ball
  and get one more coordinate, sqrt(1 - |x|^2); the nearest points of a query (whose extra
  coordinate is zero) are then those with the largest inner products.  Every such band has a graph of its own.  A query goes
  through them from the longest vectors on and leaves out a band whose longest vector cannot
  reach the worst result it has (Cauchy-Schwarz).
* **Graph.**  Points are inserted in a seeded order, in batches that double.  A greedy beam search
  over the graph so far proposes neighbours of the whole batch; relaxed pruning keeps the
  nearest proposal and drops every other that lies nearer, by the factor ``ALPHA``, to a kept one than to the
  point itself, until ``DEGREE`` edges are kept.  Every edge is also proposed to its target, whose
  list is pruned again when it overflows.
* **Search.**  A beam of ``BEAM`` points runs from the entry point (nearest the mean) until
  all of it is expanded.  The points of the beam are then scored on the original vectors in double precision.
* **Whole result.**  Per query the best of all shards are kept, and distinct vectors become the ids that
  hold them.  A result of k ids needs at most the k + 1 smallest ids of a vector and k + 1 distinct vectors a query.

Shards meet queries in blocks of ``QUERY_BLOCK``; a task holds one shard and one block.

Odd rows: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor
do null ids.  Vectors of different lengths are not comparable: a query finds only those of its own
length.  An id that holds several vectors stands for the smallest of them (arrays compare component by
component); repeated rows count once.  Vectors with equal scores are ordered by id.  Further columns are ignored.  An empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.settle import settle

#: Vectors in a shard and queries in a block, on average.
SHARD_ROWS, QUERY_BLOCK = 16_384, 4_096
#: Out-degree, relaxation of the pruning, beam widths of building and searching.
DEGREE, ALPHA, BUILD_BEAM, BEAM = 32, 1.2, 64, 192
#: Ratio of the lengths in one graph.
BAND = 1.25
#: Points handled side by side in one step.
STEP = 256
SEED = 20260926

NODES = "dim int, shard int, band int, node int, ids array<long>, vector array<double>, neighbours array<int>"


# -- one shard --------------------------------------------------------------------------


def unit_ball(x: np.ndarray) -> np.ndarray:
    """Rows scaled by the longest one, with the coordinate that makes them unit vectors."""
    x = x / np.abs(x).max()
    norms = np.sqrt((x * x).sum(axis=1))
    x, norms = x / norms.max(), norms / norms.max()
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - norms * norms))[:, None]], axis=1).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(points, squared distances) of the beam of every query, nearest first; -1 where there are fewer.

    ``edges`` holds the neighbours of every point, padded with -1.  ``width`` points a query are expanded in one step.
    """
    n, rows = len(points), len(queries)
    seen = np.zeros((rows, n + 1), bool)  # the last column stands for "no point"
    seen[:, n] = seen[:, entry] = True
    ids = np.full((rows, beam), -1, np.int64)
    far = np.full((rows, beam), np.inf, np.float32)
    open_ = np.zeros((rows, beam), bool)
    ids[:, 0], open_[:, 0] = entry, True
    far[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    active = np.arange(rows)
    while len(active):
        a_open, a_ids = open_[active], ids[active]
        # The nearest unexpanded points of the beam, which is sorted.
        rank = np.cumsum(a_open, axis=1)
        chosen = a_open & (rank <= width)
        open_[active] = a_open & ~chosen
        row, col = np.nonzero(chosen)
        slot = rank[row, col] - 1
        near = np.full((len(active), width, edges.shape[1]), -1, np.int64)
        near[row, slot] = edges[a_ids[row, col]]
        near = np.sort(near.reshape(len(active), -1), axis=1)
        new = (near >= 0) & ~seen[active[:, None], near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        found = near[row, col]
        seen[active[row], found] = True
        distance = np.full(near.shape, np.inf, np.float32)
        gap = points[found] - queries[active[row]]
        distance[row, col] = np.einsum("ij,ij->i", gap, gap)
        all_far = np.concatenate([far[active], distance], axis=1)
        keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam] if all_far.shape[1] > beam else np.tile(np.arange(beam), (len(active), 1))
        order = np.argsort(np.take_along_axis(all_far, keep, 1), axis=1, kind="stable")
        keep = np.take_along_axis(keep, order, 1)
        far[active] = np.take_along_axis(all_far, keep, 1)
        merged = np.concatenate([a_ids, np.where(new, near, -1)], axis=1)
        ids[active] = np.take_along_axis(merged, keep, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], new], axis=1), keep, 1)
        active = active[open_[active].any(axis=1)]
    return ids, far


def robust_prune(points: np.ndarray, centres: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of every centre from its row of candidates (-1: none)."""
    candidates = np.sort(candidates, axis=1)
    usable = (candidates >= 0) & (candidates != centres[:, None])
    usable[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    gap = points[candidates] - points[centres][:, None, :]  # small numbers in dense places, so nothing cancels
    own = np.einsum("rcd,rcd->rc", gap, gap)
    between = np.maximum(0, own[:, :, None] + own[:, None, :] - 2 * (gap @ gap.transpose(0, 2, 1)))
    out = np.full((len(centres), degree), -1, np.int64)
    rows = np.arange(len(centres))
    for k in range(degree):
        left = np.where(usable, own, np.inf)
        best = left.argmin(axis=1)
        real = usable[rows, best]
        if not real.any():
            break
        out[real, k] = candidates[rows, best][real]
        # Squared distances, so the factor is squared too.
        usable &= ~(alpha * alpha * between[rows, best] <= own) & real[:, None]
        usable[rows, best] = False
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, seed: int = SEED) -> tuple[np.ndarray, int]:
    """(edges padded with -1, entry point) of the graph over ``points``."""
    n = len(points)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, 2 * degree), -1, np.int64)  # room for proposals between two prunings
    fill = np.zeros(n, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    first = 1
    while first < n:
        batch = order[first : first + min(first, STEP)]
        proposed, _ = beam_search(points, edges, entry, points[batch], beam)
        # Points of the same batch cannot find each other; while the graph is small they are proposed directly.
        if first < STEP:
            proposed = np.concatenate([proposed, np.tile(batch, (len(batch), 1))], axis=1)
        kept = robust_prune(points, batch, proposed, degree, alpha)
        edges[batch, :degree] = kept
        fill[batch] = (kept >= 0).sum(axis=1)
        source, target = np.repeat(batch, degree), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        _propose(points, edges, fill, source, target, degree, alpha)
        first += len(batch)
    over = np.flatnonzero(fill > degree)
    for start in range(0, len(over), STEP):
        some = over[start : start + STEP]
        edges[some, :degree] = robust_prune(points, some, edges[some], degree, alpha)
    return edges[:, :degree], entry


def _propose(points: np.ndarray, edges: np.ndarray, fill: np.ndarray, source: np.ndarray, target: np.ndarray, degree: int, alpha: float) -> None:
    """Add the edges target -> source; lists that overflow are pruned together with what did not fit."""
    new = ~(edges[target] == source[:, None]).any(axis=1)
    source, target = source[new], target[new]
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    starts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(target)]]))
    place = np.arange(len(target)) - np.repeat(starts, counts)
    room = edges.shape[1]
    nodes = target[starts]
    tight = fill[nodes] + counts > room
    free = ~np.repeat(tight, counts)
    edges[target[free], fill[target[free]] + place[free]] = source[free]
    fill[nodes[~tight]] += counts[~tight]
    full = nodes[tight]
    if not len(full):
        return
    extra = np.full((len(full), int(counts[tight].max())), -1, np.int64)
    row = np.repeat(np.cumsum(tight) - 1, counts)[~free]
    extra[row, place[~free]] = source[~free]
    step = max(1, STEP * 128 // (room + extra.shape[1]))
    for start in range(0, len(full), step):
        some = full[start : start + step]
        kept = robust_prune(points, some, np.concatenate([edges[some], extra[start : start + step]], axis=1), degree, alpha)
        edges[some] = -1
        edges[some, :degree] = kept
        fill[some] = (kept >= 0).sum(axis=1)


def lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, keepdims=True)
    return most[:, 0] * np.sqrt(((x / most) ** 2).sum(axis=1))


def bands_of(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(number, mask) of the bands, longest vectors first."""
    size = np.log(lengths(x))
    band = np.floor((size.max() - size) / math.log(BAND)).astype(np.int64)
    for number in np.unique(band):
        yield int(number), band == number


def _band_graph(frame: pd.DataFrame, band: int) -> pd.DataFrame:
    """One row per point of a band with its neighbours; the entry point is number 0."""
    points = unit_ball(np.stack(frame["vector"]))
    edges, entry = build_graph(points)
    order = np.concatenate([[entry], np.delete(np.arange(len(points)), entry)])
    number = np.empty(len(points) + 1, np.int64)
    number[order], number[-1] = np.arange(len(points)), -1
    moved = number[edges[order]]
    return pd.DataFrame(
        {
            "dim": frame["dim"].to_numpy(), "shard": frame["shard"].to_numpy(), "band": band, "node": np.arange(len(points)), "ids": frame["ids"].to_numpy()[order],
            "vector": frame["vector"].to_numpy()[order], "neighbours": [e[e >= 0] for e in moved],
        }
    )


class ShardSearch:
    """The graphs of one shard, ready for queries."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["band", "node"], ignore_index=True)
        self.vectors = np.stack(nodes["vector"])
        self.smallest = np.array([i[0] for i in nodes["ids"]])
        self.bands = []
        for first, count in zip(*np.unique(nodes["band"], return_index=True, return_counts=True)[1:], strict=True):
            near = nodes["neighbours"].iloc[first : first + count]
            edges = np.full((count, max(1, max(map(len, near)))), -1, np.int64)
            for k, e in enumerate(near):
                edges[k, : len(e)] = e
            mine = self.vectors[first : first + count]
            self.bands.append((first, unit_ball(mine), edges, lengths(mine).max()))

    def best(self, asked: np.ndarray, most: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, scores) of the ``most`` largest inner products found, largest first, ties to smaller ids; -1 where there are fewer."""
        size = lengths(asked)
        # The length of a query does not change the order.
        unit = asked / np.abs(asked).max(axis=1, keepdims=True)
        unit = np.concatenate([unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True)), np.zeros((len(unit), 1))], axis=1).astype(np.float32)
        ids, scores = np.full((len(asked), most), -1, np.int64), np.full((len(asked), most), -np.inf)
        for first, points, edges, longest in self.bands:
            open_ = np.flatnonzero(~(longest * size * (1 + 1e-9) < scores[:, -1]))
            if not len(open_):
                continue
            found, _ = beam_search(points, edges, 0, unit[open_], max(beam, most))
            real = found >= 0
            found = np.where(real, found + first, -1)
            exact = np.where(real, (self.vectors[found] * asked[open_][:, None, :]).sum(axis=2), -np.inf)
            found, exact = np.concatenate([ids[open_], found], axis=1), np.concatenate([scores[open_], exact], axis=1)
            order = np.lexsort((self.smallest[found], -exact, found < 0), axis=1)[:, :most]
            ids[open_], scores[open_] = np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1)
        return ids, scores


# -- Spark ------------------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, vector`` (doubles), one row per id, of the vectors that take part."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    good = rows.where(F.col("id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    return good.groupBy("id").agg(F.min("vector").alias("vector"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """``dim, vector, ids``: every distinct vector with its ``k`` smallest ids.

    The rank inside a vector is limited before rows are shuffled, so a vector held by a third of all rows is no hot key.
    """
    # -0.0 equals 0.0 in every product.
    same = rows.select("id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    place = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    first = same.withColumn("_place", place).where(F.col("_place") <= k)
    return first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.size("vector").alias("dim"), "vector", "ids")


def graphs(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all shards as a table: one row per point with its neighbours; point 0 of a shard is its entry."""
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    shards = F.create_map(*[F.lit(x) for dim, n in sizes.items() for x in (dim, math.ceil(n / shard_rows))]) if sizes else F.map_from_arrays(F.array(), F.array())
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vector"), shards[F.col("dim")] if sizes else F.lit(1)).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(first=[i[0] for i in frame["ids"]]).sort_values("first", ignore_index=True)
        return pd.concat([_band_graph(frame[mine], band) for band, mine in bands_of(np.stack(frame["vector"]))])

    return dealt.groupBy("dim", "shard").applyInPandas(build, NODES)


def _search(nodes: pd.DataFrame, queries: pd.DataFrame, most: int, beam: int) -> Iterator[pd.DataFrame]:
    shard = ShardSearch(nodes)
    ids = nodes.sort_values(["band", "node"])["ids"].to_numpy()
    for start in range(0, len(queries), STEP):
        some = queries.iloc[start : start + STEP]
        found, scores = shard.best(np.stack(some["vector"]), most, beam)
        row, col = np.nonzero(found >= 0)
        point = found[row, col]
        yield pd.DataFrame({"query_id": some["id"].to_numpy()[row], "first": shard.smallest[point], "ids": ids[point], "score": scores[row, col]})


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """``query_id, rank`` (from 1), ``vec_id, score``: the ``k`` nearest found for each query, its own id left out.

    ``index``: a settled table of :func:`graphs` whose points carry at least ``k + 1`` ids each; ``queries``: ``id, vector``.
    """
    asked = queries.withColumn("dim", F.size("vector"))
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    shards = index.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard")).distinct()
    spread = asked.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).join(shards, F.col("dim") == F.col("_dim"))
    repeated = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    def pair(nodes: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "first": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        return pd.concat(list(_search(nodes, some, k + 1, beam))) if len(nodes) and len(some) else empty

    met = repeated.groupBy("dim", "shard", "block").cogroup(spread.groupBy("_dim", "_shard", "_block"))
    found = met.applyInPandas(pair, "query_id long, first long, ids array<long>, score double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "first"))
    vectors = found.withColumn("_place", best).where(F.col("_place") <= k + 1)
    single = vectors.select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, asked, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest of every row for which the condition ``asked`` on ``id`` holds, among all other rows."""
    rows = settle(usable(vectors, vec_id, embedding))
    index = settle(graphs(distinct_vectors(rows, k + 1)))
    return search(index, rows.where(asked), k)
