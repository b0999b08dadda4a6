"""Trie of conversation prefixes, rolled up in bands of fixed height.

A node of depth d is a distinct sequence of the first d turns; conversations that start with it
are its members.  Every turn has a 128-bit digest of (position, role, text), held as four
numbers; the sums of these along a conversation, taken in blocks of ``HEIGHT`` turns
(:func:`running`), name its prefixes, so no task holds a conversation and no text is shuffled.
Prefixes are taken to be equal where depth and sums are.

Totals over subtrees come from bands of ``HEIGHT`` depths:

* inside a band a node adds its value to each of its ancestors there, at most ``HEIGHT`` rows a
  node; the ancestors are read along its smallest member, whose rows of a band are together anyway;
* the nodes at the top of each band form a trie of their own, ``HEIGHT`` times lower, with the sums of
  their bands as values; it is rolled up in the same way, so depth D takes log(D) / log(HEIGHT) rounds;
* completed totals of band roots are added to the value of their parents, and one explosion
  inside the bands completes all other nodes.

Members are counted, never listed; the ids of the conversations that end at a node are digested
as a stream of pieces of at most ``ID_BLOCK`` ids.

Odd rows: a null conv_id belongs to no conversation and is left out; a null role or text is empty; turns are
ordered by number (nulls first), then role, then text, so ties have one order; repeated rows
are turns of their own; further columns are ignored; an empty table gives an empty table
(no conversation, no root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.ranking import ranged_rank
from plumbline.functions.settle import settle

#: Depths in a band.
HEIGHT = 16
#: Range of conversation ids in one piece of an id list.
ID_BLOCK = 4096
#: Children above which a parent is looked up by salted keys, and the number of salts.
HEAVY, SALTS = 10_000, 64

PARTS = [f"p{k}" for k in range(4)]
SUMS = [f"s{k}" for k in range(4)]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 1), ``role, text`` of the turns of every conversation."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return ranged_rank(turns, ["conv_id"], ["turn", "role", "text"], "pos").select("conv_id", "pos", "role", "text")


def digested(turns: DataFrame, white: str = "[\\x20\\x09-\\x0D]+") -> DataFrame:
    """Turns with the number of their words and a digest of role and text in place of these."""
    words = F.size(F.array_remove(F.split("text", white), "")).cast("long")
    key = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return turns.select(*(c for c in turns.columns if c not in ("role", "text")), key.alias("turn_key"), words.alias("n_words"))


def running(rows: DataFrame, key: str, place: str, values: Sequence[str], out: Sequence[str], deepest: int, height: int) -> DataFrame:
    """Inclusive running sums along ``place`` (gapless from 0), in blocks of ``height`` rows, blocks of blocks and so on."""
    block = rows.withColumn("_block", F.floor(F.col(place) / height).cast("long"))
    upto = W.partitionBy(key, "_block").orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    inside = block.select("*", *(F.sum(v).over(upto).alias(o) for v, o in zip(values, out, strict=True)))
    if deepest < height:
        return inside.drop("_block")
    totals = block.groupBy(key, F.col("_block").alias("_place")).agg(*(F.sum(v).alias(v) for v in values))
    ahead = running(totals, key, "_place", values, out, deepest // height, height)
    before = ahead.select(key, (F.col("_place") + 1).alias("_block"), *(F.col(o).alias(f"_{o}") for o in out))
    joined = inside.join(before, [key, "_block"], "left")
    kept = [c for c in rows.columns if c not in out]
    return joined.select(*kept, *((F.col(o) + F.coalesce(f"_{o}", F.lit(0))).alias(o) for o in out))


def _name(depth: Column, sums: Sequence[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums))))


def steps(turns: DataFrame, conversations: DataFrame, height: int) -> tuple[DataFrame, int]:
    """One settled row per conversation and depth: ``conv_id, depth, node, parent, n_words, ends``; and the largest depth.

    ``turns``: ``conv_id, pos, turn_key, n_words``; ``conversations``: ``conv_id``, with or without turns.
    """
    digest = F.md5(F.concat_ws(":", F.col("pos").cast("string"), "turn_key"))
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(p) for k, p in enumerate(PARTS)]
    first = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_words"), *(F.lit(0).cast("long").alias(p) for p in PARTS))
    rows = settle(first.unionByName(turns.select("conv_id", F.col("pos").cast("long").alias("depth"), "n_words", *parts)))
    deepest = rows.agg(F.max("depth")).first()[0]
    if deepest is None:
        deepest = 0
    summed = running(rows, "conv_id", "depth", PARTS, SUMS, deepest, height)
    last = rows.groupBy("conv_id").agg(F.max("depth").alias("depth")).withColumn("_last", F.lit(True))
    named = summed.join(last, ["conv_id", "depth"], "left").select(
        "conv_id",
        "depth",
        _name(F.col("depth"), [F.col(s) for s in SUMS]).alias("node"),
        F.when(F.col("depth") > 0, _name(F.col("depth") - 1, [F.col(s) - F.col(p) for s, p in zip(SUMS, PARTS, strict=True)])).alias("parent"),
        "n_words",
        F.coalesce("_last", F.lit(False)).alias("ends"),
    )
    return settle(named), deepest


def nodes_of(rows: DataFrame) -> DataFrame:
    """``node, parent, depth, conv_id`` (smallest member), ``n_convs, n_words`` of every node."""
    return settle(
        rows.groupBy("node").agg(
            F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("n_words").alias("n_words")
        )
    )


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``n_children`` and ``parent_conv_id``.

    Children of a parent with more than ``HEAVY`` of them meet it under salted keys; of such
    parents there are at most one per ``HEAVY`` nodes.
    """
    children = settle(nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")))
    counted = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    counted = settle(counted)
    parents = counted.where(F.col("n_children") > 0).select(
        F.col("node").alias("_up"),
        F.col("conv_id").alias("parent_conv_id"),
        F.explode(F.when(F.col("n_children") > HEAVY, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"),
    )
    heavy = settle(children.where(F.col("n_children") > HEAVY).select(F.col("node").alias("_heavy")))
    if heavy.isEmpty():
        return counted.join(parents.drop("_salt"), counted["parent"] == F.col("_up"), "left").drop("_up")
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    split = heavy.select("_heavy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_any"))
    marked = counted.withColumn("_own", salt)
    marked = marked.join(split, (F.col("parent") == F.col("_heavy")) & (F.col("_own") == F.col("_any")), "left")
    marked = marked.withColumn("_own", F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(F.col("_own"))).drop("_heavy", "_any")
    return marked.join(parents, (F.col("parent") == F.col("_up")) & (F.col("_own") == F.col("_salt")), "left").drop("_up", "_own", "_salt")


def rolled_up(nodes: DataFrame, rows: DataFrame, values: Sequence[str], deepest: int, height: int) -> DataFrame:
    """``node`` and, for every column of ``values``, its total over the node's subtree.

    ``nodes``: ``node, parent, depth, conv_id`` and values; ``rows``: ``conv_id, depth, node`` of the members.
    """
    band = W.partitionBy("conv_id", F.floor(F.col("depth") / height)).orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    paths = rows.select("conv_id", "depth", F.collect_list("node").over(band).alias("path"))
    placed = settle(nodes.join(paths, ["conv_id", "depth"]).select("node", "parent", "depth", "conv_id", "path", *values))
    if deepest >= height:
        root = F.element_at("path", 1)
        sums = placed.groupBy(root.alias("_root")).agg(*(F.sum(v).alias(v) for v in values))
        lower = F.floor(F.col("depth") / height).cast("long")
        tops = placed.where(F.col("depth") % height == 0).select("node", "parent", "conv_id", lower.alias("depth"))
        above = rows.where(F.col("depth") % height == 0).select("conv_id", lower.alias("depth"), "node")
        # In the lower trie the parent is the root of the band above, read along the same member.
        over = above.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("_over"))
        bands = tops.join(sums, F.col("node") == F.col("_root")).join(over, ["conv_id", "depth"], "left")
        bands = bands.select("node", F.col("_over").alias("parent"), "depth", "conv_id", *values)
        done = settle(rolled_up(bands, above, values, deepest // height, height))
        joined = done.join(tops.select("node", "parent"), "node").where(F.col("parent").isNotNull())
        below = joined.groupBy("parent").agg(*(F.sum(v).alias(f"_{v}") for v in values)).withColumnRenamed("parent", "_up")
        placed = placed.join(below, F.col("node") == F.col("_up"), "left").select(
            "node", "path", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values)
        )
    spread = placed.select(F.explode("path").alias("node"), *values)
    return spread.groupBy("node").agg(*(F.sum(v).alias(v) for v in values))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of every node, joined by commas; pieces come sorted by node and order."""
    node, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for name, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if name != node:
                if state is not None:
                    yield row()
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if state is not None:
        yield row()


def end_digests(rows: DataFrame) -> DataFrame:
    """``node, ends_sha256``: the ids of conversations that end at a node, ascending, comma-joined.

    A digest of a list is a chain, so a node with many pieces is one stream of text pieces, held one at a time.
    """
    ends = rows.where("ends").select("node", "conv_id", F.floor(F.col("conv_id") / ID_BLOCK).cast("long").alias("_block"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = settle(ends.groupBy("node", "_block").agg(F.array_join(ids, ",").alias("ids")))
    counts = pieces.groupBy("node").agg(F.count(F.lit(1)).alias("_pieces"), F.min("ids").alias("ids"))
    single = counts.where("_pieces = 1").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    several = pieces.join(counts.where("_pieces > 1").select("node"), "node", "left_semi").select("node", "_block", "ids")
    streamed = several.repartition("node").sortWithinPartitions("node", "_block").mapInArrow(_digests, "node binary, ends_sha256 string")
    return single.unionByName(streamed)


def build(turns: DataFrame, conversations: DataFrame, height: int = HEIGHT) -> DataFrame:
    """All nodes: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns``: ``conv_id, pos`` (from 1), ``turn_key`` (equal for equal role and text), ``n_words``; ``conversations``: every ``conv_id``.
    ``saved_tokens`` are the words that need not be read again when all members share the prefix.
    """
    rows, deepest = steps(turns, conversations, height)
    nodes = settle(with_parents(nodes_of(rows)))
    own = nodes.select(
        "node",
        "parent",
        "depth",
        "conv_id",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"),
    )
    totals = rolled_up(own, rows.select("conv_id", "depth", "node"), ["n_leaves", "saved_tokens"], deepest, height)
    digests = end_digests(rows)
    return (
        nodes.join(totals, "node")
        .join(digests, "node", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
        )
    )
