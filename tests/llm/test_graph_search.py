"""Graph search against all inner products."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.llm import graph_search, queries


def plain(vectors, asked, k):
    """``vectors``: id -> list; exact answers as query -> [(id, score)]."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    out = {}
    for q in asked:
        score = (x * x[ids.index(q)]).sum(axis=1)
        out[q] = [(ids[j], score[j]) for j in sorted(range(len(ids)), key=lambda j: (-score[j], ids[j])) if ids[j] != q][:k]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall(got, want):
    hit = total = 0
    for q, rows in want.items():
        worst = rows[-1][1] if rows else 0
        found = got.get(q, [])
        assert len(found) == len(rows) and len({v for v, _ in found}) == len(found) and q not in {v for v, _ in found}
        hit += sum(s >= worst - 1e-12 * abs(worst) for _, s in found)
        total += len(rows)
    return hit / max(1, total)


def as_table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors.items()], "vec_id long, embedding array<double>, id int, vector string")


SHAPES = {
    "round": lambda rng, n, d: rng.normal(size=(n, d)),
    "lengths far apart": lambda rng, n, d: rng.normal(size=(n, d)) * np.exp(2 * rng.normal(size=(n, 1))),
    "near copies": lambda rng, n, d: rng.normal(size=(n // 40, d))[rng.integers(0, n // 40, n)] + 0.01 * rng.normal(size=(n, d)),
    "huge and tiny": lambda rng, n, d: rng.normal(size=(n, d)) * 10.0 ** rng.integers(-150, 150, (n, 1)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_recall_in_one_shard(shape):
    rng = np.random.default_rng(3)
    x = SHAPES[shape](rng, 2000, 24)
    frame = pd.DataFrame({"dim": 24, "shard": 0, "vector": list(x), "ids": [[i] for i in range(len(x))]})
    shard = graph_search.ShardSearch(pd.concat([graph_search._band_graph(frame[m], b) for b, m in graph_search.bands_of(x)]))
    asked = x[rng.integers(0, len(x), 200)]
    _, scores = shard.best(asked, 21, graph_search.BEAM)
    true = -np.sort(-(asked @ x.T), axis=1)[:, :21]
    assert np.mean(scores >= true[:, -1:] * (1 - 1e-9 * np.sign(true[:, -1:]))) >= 0.95


def test_graphs_are_pruned_and_reachable():
    x = np.random.default_rng(5).normal(size=(1500, 16)).astype(np.float32)
    edges, entry = graph_search.build_graph(x)
    assert edges.shape == (1500, graph_search.DEGREE) and all(len(set(e[e >= 0])) == (e >= 0).sum() and k not in e for k, e in enumerate(edges))
    reached, last = {entry}, [entry]
    while last:
        last = [int(t) for s in last for t in edges[s] if t >= 0 and t not in reached and not reached.add(int(t))]
    assert len(reached) >= 0.99 * 1500


def test_many_shards_blocks_and_copies(spark, monkeypatch):
    """A third of the rows hold one vector; several shards and query blocks."""
    monkeypatch.setattr(graph_search, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8)).round(2)
    x[300:600] = x[0]
    x[600:640] = x[1]
    vectors = {int(3 * i - 500): x[i].tolist() for i in range(900)}
    table = as_table(spark, vectors)
    rows = graph_search.usable(table)
    index = graph_search.settle(graph_search.graphs(graph_search.distinct_vectors(rows, 11), shard_rows=150))
    assert index.select("shard").distinct().count() > 2
    got = answers(graph_search.search(index, rows.where(F.col("id") % 20 == 0), 10))
    want = plain(vectors, [i for i in vectors if i % 20 == 0], 10)
    assert set(got) == set(want) and recall(got, want) >= 0.97
    # ids of copies come in order
    some = next(q for q in want if len({round(s, 9) for _, s in want[q][:5]}) == 1)
    assert [v for v, _ in got[some]] == [v for v, _ in want[some]]


def test_odd_rows(spark):
    one, nan, inf = [1.0, 0.0], math.nan, math.inf
    rows = [(0, one), (20, [0.5, 0.5]), (1, [2.0, 0.0]), (2, None), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, one), (7, one), (7, one)]
    rows += [(8, [9.0, 9.0]), (8, [0.25, 0.0]), (40, [1.0, 2.0, 3.0]), (9, [1.0, 1.0, 1.0]), (60, [1.0]), (10, []), (80, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = answers(graph_search.nearest(table, F.col("id") % 20 == 0, 20))
    assert got == {0: [(1, 2.0), (7, 1.0), (20, 0.5), (8, 0.25)], 20: [(1, 1.0), (0, 0.5), (7, 0.5), (8, 0.125)], 40: [(9, 6.0)]}
    assert graph_search.nearest(table.where("vec_id < 0"), F.col("id") % 20 == 0, 20).count() == 0


def test_query(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = answers(queries.QUERIES["op11_graph_search"](spark, sf))
    want = plain(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    assert all(abs(s - float(np.dot(np.float64(vectors[q]), np.float64(vectors[v])))) < 1e-12 for q, rows in got.items() for v, s in rows)
