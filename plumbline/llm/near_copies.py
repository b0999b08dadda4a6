"""Near copies by exact Jaccard similarity of word shingles.

A text is the set of the 64-bit hashes of its five-word shingles (of all its words, if it
has fewer).  Texts whose sets overlap by ``LEAST`` or more are linked, and linked texts form
a group.  Candidates come from SimHash: a fingerprint of ``BITS`` bits, each the majority of one bit of the mixed hashes of
the set.  At an overlap of 0.8 a bit differs with probability 0.15, about ten bits of 64, and pigeonhole tables for
such a radius would have keys too short to divide the texts.  So keys are drawn: each table reads some bits of
the fingerprint, about as many as leave ``BUCKET`` texts to a bucket, and there are as many tables as a pair
at 0.8 needs to miss all of them with probability ``MISS`` at most.  In a bucket the first ``COMPARED`` bits are
compared bit-sliced (``simhash.close_pairs``) within ``RADIUS``, which a pair at 0.8 exceeds with probability 3e-5,
and which unrelated texts meet with probability 4e-7.  Sets of few shingles have coarser bits: of five and four shingles a bit differs
with probability 0.19, and about 1 in 100 such pairs is missed.

Texts that close fingerprints connect are dealt together, each once; a set of more than ``TILE_SHINGLES``
shingles is cut into pairs of tiles that different tasks compare.  A task walks from text to
text: the overlaps of one text with all texts not yet reached come from one pass over
the postings of its shingles, so every step is confirmed, and no link that joins
two groups is left out.  It sends on each text's link to the smallest one that the walk reaches.
Buckets do the same, and links of one text are folded into one (``simhash.folded``) before groups are formed.

Defined results: a null text, an empty one and one without words are equal.  Columns other
than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.llm.arrow import blocks, give_back, named, pieces, words_of
from plumbline.llm.simhash import components, folded, in_tiles, linked, text_key

WORDS = 5
LEAST = 0.8
TILE_SHINGLES = 1 << 20
#: Bits of a fingerprint; the first of them are compared, within a radius, and keys are drawn from the rest.
BITS, COMPARED, RADIUS = 1024, 128, 36
#: Chance that no table holds a pair at ``LEAST``, and texts in a bucket on average.
MISS, BUCKET = 1e-4, 64
_DRAWN = np.random.default_rng(42).integers(0, 2**63, (2, BITS // 64), dtype=np.uint64)
FLIPS, FACTORS = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


# ---- shingles


def shingles(raw: bytes, words: int = WORDS, seed: int = 42) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, repeats included, piece by piece; at least one."""
    digest = xxhash.xxh64_intdigest
    carry, carried = [], False
    for block in words_of(raw.lower()):
        found = carry + block
        if len(found) < words:
            carry = found
            continue
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = [0, *(ends[: len(found) - words] + 1).tolist()]
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        carry, carried = found[len(found) - words + 1 :], True
    if not carried:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def shingle_set(raw: bytes) -> np.ndarray:
    return np.unique(np.concatenate(list(shingles(raw))))


# ---- fingerprints


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``BITS`` / 8 bytes: the majority of each bit of the mixed hashes of a set."""
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 255):  # counts of a piece fit a byte
        x = (hashes[start : start + 255, None] ^ FLIPS) * FACTORS
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


def tables(n_texts: int) -> np.ndarray:
    """(table, bit): the bits that make the keys of each table."""
    bits = max(8, math.ceil(math.log2(max(1, n_texts) / BUCKET)))
    agree = 1 - math.acos(2 * LEAST / (1 + LEAST)) / math.pi
    count = math.ceil(math.log(MISS) / math.log(1 - agree**bits))
    rng = np.random.default_rng(42)
    return np.stack([rng.choice(np.arange(COMPARED, BITS), bits, replace=False) for _ in range(count)])


def fingerprints(texts: DataFrame) -> DataFrame:
    """(node, bits) of every text."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            bits = [fingerprint(shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"")).tobytes() for t in named(batch, "text")]
            yield pa.RecordBatch.from_arrays([named(batch, "node"), pa.array(bits, pa.binary())], names=["node", "bits"])

    return texts.mapInArrow(signed, "node long, bits binary")


def keyed(prints: DataFrame, drawn: np.ndarray) -> DataFrame:
    """(at, node, high, low): the bucket of each text in each table, and the bits that are compared."""
    places = (1 << np.arange(drawn.shape[1])).astype(np.int64)
    table = np.arange(len(drawn)) << drawn.shape[1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(named(batch, "bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bits = np.unpackbits(raw, axis=1, bitorder="little")
            at = np.stack([bits[:, own] @ places for own in drawn], axis=1) + table
            words = np.ascontiguousarray(raw[:, : COMPARED // 8]).view(np.int64)
            rest = (np.repeat(c, len(drawn)) for c in (named(batch, "node").to_numpy(), words[:, 0], words[:, 1]))
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), *map(pa.array, rest)], names=["at", "node", "high", "low"])

    return prints.mapInArrow(spread, "at long, node long, high long, low long")


# ---- comparison


def links(nodes: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """From each set to the smallest node that similar sets lead to, those nodes themselves left out."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    starts, holders = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(tokens)))]), rows[order]
    open_, left, listed = np.ones(len(sets), bool), len(sets), len(sets)
    for first in range(len(sets)):
        if not open_[first]:
            continue
        open_[first], left, todo, reached = False, left - 1, [first], [first]
        while todo and left:
            x = todo.pop()
            if 2 * left < listed:  # postings of texts not yet reached
                keep = open_[holders]
                starts, holders, listed = np.concatenate([[0], np.cumsum(keep)])[starts], holders[keep], left
            own = ids[at[x] : at[x + 1]]
            n = starts[own + 1] - starts[own]
            where = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shared = np.bincount(holders[where], minlength=len(sets))
            near = np.flatnonzero(open_ & (shared >= LEAST * (sizes + sizes[x] - shared) - 1e-9) & (shared > 0))
            open_[near], left = False, left - len(near)
            todo += near.tolist()
            reached += near.tolist()
        least = nodes[reached].min()
        yield from ((int(x), int(least)) for x in nodes[reached] if x != least)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, tile, node, hashes) in order of (root, tile); one group is held at a time."""
    group, nodes, sets = None, [], []

    def found() -> pa.RecordBatch:
        pairs = np.array(list(links(np.array(nodes, np.int64), sets)) if len(nodes) > 1 else [], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        for root, tile, node, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, tile) != group:
                if nodes:
                    yield found()
                group, nodes, sets = (root, tile), [], []
            nodes.append(node)
            sets.append(np.frombuffer(hashes, np.uint64))
    if nodes:
        yield found()
    give_back()


def candidates(texts: DataFrame) -> DataFrame:
    """(node, root): texts that close fingerprints connect."""
    prints = settle(fingerprints(texts).dropDuplicates(["node"]))
    near = in_tiles(keyed(prints, tables(prints.count())), ["at"], "node").mapInArrow(linked(RADIUS, 2, 2, stars=True), "u long, v long")
    found = components(folded(near.distinct()))
    return settle(found.union(found.select(F.col("root").alias("node"), "root")).distinct())


def edges(texts: DataFrame, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """(u, v), u > v: links that connect what confirmed pairs of similar texts connect; ``texts`` has (node, text), equal rows allowed."""
    members = candidates(texts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            sets = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in named(batch, "text")]
            columns = [named(batch, "root"), named(batch, "node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "node", "n", "hashes"])

    rows = texts.join(members, "node").dropDuplicates(["node"]).select("root", "node", "text")
    sets = settle(rows.mapInArrow(hashed, "root long, node long, n long, hashes binary"))
    large = settle(sets.groupBy("root").agg(F.ceil(F.sum("n") / tile_shingles).cast("int").alias("tiles")).where("tiles > 1"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    others = F.transform(
        F.array_except(F.sequence(F.lit(0), F.col("tiles") - 1), F.array(own)),
        lambda x: (F.least(x, own) * F.col("tiles") + F.greatest(x, own)).cast("int"),
    )
    tiled = sets.join(large, "root", "left").select(
        "root", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(others)).alias("tile"), "node", "hashes"
    )
    dealt = tiled.repartition("root", "tile").sortWithinPartitions("root", "tile")
    return dealt.mapInArrow(_compared, "u long, v long").distinct()


# ---- groups


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row of ``docs`` for each group: of the smallest id; null ids come last, and of several rows the smallest text key stays."""
    text = F.col(text_column)
    missing, doc = F.col(id_column).isNull(), F.coalesce(F.col(id_column).cast("long"), F.lit(0))
    key: Column = F.struct(missing.alias("missing"), doc.alias("doc"), text_key(text).alias("text_key"))
    nodes = settle(docs.groupBy(text_key(text).alias("node")).agg(F.min(key).alias("key")))
    groups = components(folded(edges(docs.select(text_key(text).alias("node"), text.alias("text")), tile_shingles)))
    picked = nodes.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("key").alias("key")).select("key.*")
    marked = docs.select(F.struct(*docs.columns).alias("row"), missing.alias("missing"), doc.alias("doc"), text_key(text).alias("text_key"))
    return marked.join(picked, ["missing", "doc", "text_key"]).dropDuplicates(["missing", "doc", "text_key"]).select("row.*")
