"""Packing: length buckets with least padding, and token-budget batches inside each.

The histogram of all lengths goes to the driver, one row per distinct length: L different lengths need at least
L (L + 1) / 2 tokens, so T tokens have less than sqrt(2 T) of them, 14 million for 100 TB of bytes.
Dynamic programming picks the ``buckets`` boundaries that minimise the padding of the whole corpus over all
lengths; the costs are Monge, so the best last cut moves one way with the length and
divide and conquer finds a layer in n log n steps.  Every document pads to the boundary of its bucket, and a batch takes as
many documents as the token budget allows at that boundary.  Places inside a
bucket follow a seeded draw and come from counted cuts (``ranks.gapless``), so a bucket
that holds a third of all documents is not one task.

Defined results: a null text has length 1 (its end token); a document longer than the
budget has a batch of its own and is marked ``over_budget``; nothing is cut or dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ranks import copies, gapless

BUCKETS = 32
TOKEN_BUDGET = 65_536


def byte_tokens(text: Column) -> Column:
    """Length under a byte-level vocabulary: UTF-8 bytes and an end token."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _layer(best: np.ndarray, lengths: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One more bucket: least padding of the first j lengths, and where its last bucket starts, for every j.

    All middles of one level of the recursion are searched side by side.
    """
    n = len(lengths)
    after, picked = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    low, high, first, last = np.array([1]), np.array([n]), np.array([0]), np.array([n - 1])
    while len(low):
        middle = (low + high) // 2
        tried = np.minimum(last, middle - 1) - first + 1
        starts = np.concatenate([[0], np.cumsum(tried)[:-1]])
        i = np.arange(tried.sum()) - np.repeat(starts - first, tried)
        j = np.repeat(middle, tried)
        padding = best[i] + lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
        least = np.minimum.reduceat(padding, starts)
        hit = np.flatnonzero(padding == np.repeat(least, tried))
        at = i[hit[np.searchsorted(hit, starts)]]
        after[middle], picked[middle] = least, at
        low, high, first, last = (
            np.concatenate(x) for x in ((low, middle + 1), (middle - 1, high), (first, at), (at, last))
        )
        some = low <= high
        low, high, first, last = low[some], high[some], first[some], last[some]
    return after, picked


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Boundaries (largest lengths) of at most ``buckets`` buckets with least padding, and that padding.

    ``lengths`` are distinct and ascending.
    """
    n = len(lengths)
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.full(n + 1, np.iinfo(np.int64).max // 4, np.int64)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        best, picked = _layer(best, lengths, rows, tokens)
        choice.append(picked)
    edges, j = [], n
    for picked in reversed(choice):
        if j:
            edges.append(int(lengths[j - 1]))
            j = picked[j]
    return edges[::-1], int(best[n])


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, seed: int = 11) -> DataFrame:
    """(doc_id, n_tokens, bucket, boundary, padding, batch_id, slot, over_budget) of every row of ``docs``.

    ``batch_id`` counts from 0 without gaps over all buckets; ``slot`` is the place in the batch.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (byte_tokens(F.col(text_column)) if length is None else length.cast("long")).alias("n_tokens"),
        F.xxhash64(F.col(text_column)).alias("_hash"),
    )
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    lengths, counts = (histogram.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "n"))
    edges = best_boundaries(lengths, counts, buckets)[0] if len(lengths) else [1]
    per_batch = [max(1, budget // e) for e in edges]
    in_bucket = [int(counts[(lengths <= e) & (lengths > before)].sum()) for before, e in zip([0, *edges], edges, strict=False)]
    batches = [-(-n // p) for n, p in zip(in_bucket, per_batch, strict=True)]
    first_batch = [sum(batches[:k]) for k in range(len(batches))]
    values = lambda x: F.array(*[F.lit(v).cast("long") for v in x])  # noqa: E731  at most ``buckets`` numbers
    numbered = copies(rows, ["doc_id", "n_tokens", "_hash"], "_copy").withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id", "_hash", "_copy"))
    dealt = numbered.withColumn("bucket", F.size(F.filter(values(edges), lambda e: e < F.col("n_tokens"))))
    ranked = gapless(dealt, "bucket", "_draw", ["doc_id", "n_tokens", "_copy"], "_rank", int(counts.sum()))
    each = F.get(values(per_batch), F.col("bucket"))
    boundary = F.get(values(edges), F.col("bucket"))
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        boundary.alias("boundary"),
        (boundary - F.col("n_tokens")).alias("padding"),
        (F.get(values(first_batch), F.col("bucket")) + F.floor(F.col("_rank") / each)).alias("batch_id"),
        (F.col("_rank") % each).alias("slot"),
        (F.col("n_tokens") > budget).alias("over_budget"),
    )
