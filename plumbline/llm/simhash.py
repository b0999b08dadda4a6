"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints within ``radius`` bits agree on two of ``radius + 2`` bit blocks, so every
close pair meets in at least one of the tables keyed by two blocks: no pair is lost.
Inside a bucket the 64 bits of all fingerprints are stored as 64 vertical planes; row i
is compared with row i + d for all i at once, and carry-save adders count the differing
bits of 64 pairs per machine word.  Words whose pairs all exceed the radius after the
first planes are abandoned.

Only distinct fingerprints are compared, buckets send on a spanning forest instead of
pairs, and a bucket of more than ``TILE_ROWS`` fingerprints is cut into pairs of tiles that
different tasks compare.  For groups a bucket sends each fingerprint's link to the smallest
one that it reaches there; what all tables say of a fingerprint is then folded into one link, so
that a group enters star contraction (on settled edge tables) with few links per
member instead of one per table and tile.

Defined results: a null or empty text has fingerprint zero, which links like any other;
documents with a null id join groups but never name one, unless the group has no other
id (then component_id is null).  Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.llm.arrow import blocks, named, words_of

TILE_ROWS = 20_000
CHUNK_ROWS = 1 << 17
FIRST_PLANES = 24
ALL_ONES = np.uint64(2**64 - 1)


# ---- fingerprints


def fingerprint(raw: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the hashes of all word shingles, repeats included."""
    ones, total, carry, carried = np.zeros(64, np.int64), 0, [], False
    for block in words_of(raw.lower()):
        found = carry + block
        if len(found) < words:
            carry = found
            continue
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = [0, *(ends[: len(found) - words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts)
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        carry, carried = found[len(found) - words + 1 :], True
    if carry and not carried:
        return xxhash.xxh64_intdigest(b" ".join(carry), seed)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view(np.uint64)[0]) if total else 0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            texts = named(batch, "text")
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([named(batch, "doc_id"), named(batch, "text_key"), pa.array(fps)], names=["doc_id", "text_key", "fp"])

    text = F.col(text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, text_key long, fp long")


def text_key(text: Column) -> Column:
    """Tells the rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


# ---- bit-sliced comparison


def bit_planes(fps: np.ndarray, spare: int) -> np.ndarray:
    """(bits, words + spare) uint64: bit r of word w of plane b is bit b of fingerprint 64 w + r, which is one number or a row of them."""
    width = fps.shape[1] if fps.ndim > 1 else 1
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8 * width), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    words = -(-len(fps) // 64) + spare
    out = np.zeros((64 * width, words * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def carry_save(levels: list[np.ndarray]) -> list[np.ndarray]:
    """Vertical counters: ``levels[w]`` holds planes of weight 2**w; returns one plane per weight."""
    levels, out, weight = list(levels), [], 0
    while weight < len(levels):
        planes, carries = levels[weight], []
        while len(planes) > 2:
            k = len(planes) // 3
            a, b, c = planes[:k], planes[k : 2 * k], planes[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            planes = np.concatenate([half ^ c, planes[3 * k :]])
        if len(planes) == 2:
            carries.append((planes[0] & planes[1])[None])
            planes = (planes[0] ^ planes[1])[None]
        if carries:
            if weight + 1 == len(levels):
                levels.append(np.zeros((0, planes.shape[1]), np.uint64))
            levels[weight + 1] = np.concatenate([levels[weight + 1], *carries])
        out.append(planes[0] if len(planes) else np.zeros(planes.shape[1], np.uint64))
        weight += 1
    return out


def at_most(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is ``radius`` or less."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL_ONES)
    for weight in range(len(counters) - 1, -1, -1):
        plane = counters[weight]
        if radius >> weight & 1:
            equal = equal & plane
        else:
            over |= equal & plane
            equal = equal & ~plane
    return ~over if radius >> len(counters) == 0 else np.full_like(over, ALL_ONES)


def close_pairs(fps: np.ndarray, room: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one bucket within the radius; ``room[i]``: rows of its bucket from i on."""
    longest = int(room.max(initial=0))
    planes = bit_planes(fps, longest // 64 + 2)
    lanes = np.zeros(-(-len(fps) // 64) * 64, room.dtype)
    lanes[: len(room)] = room
    lanes = lanes.reshape(-1, 64)
    alive = np.arange(len(lanes))
    for d in range(1, longest):
        valid = np.packbits(lanes[alive] > d, axis=1, bitorder="little").view(np.uint64)[:, 0]
        alive, valid = alive[valid != 0], valid[valid != 0]
        whole, part = divmod(d, 64)

        def differing(rows: slice, at: np.ndarray, whole: int = whole, part: int = part) -> np.ndarray:
            shifted = planes[rows, at + whole]
            if part:
                shifted = (shifted >> np.uint64(part)) | (planes[rows, at + whole + 1] << np.uint64(64 - part))
            return planes[rows, at] ^ shifted

        counters = carry_save([differing(slice(0, FIRST_PLANES), alive)])
        near = at_most(counters, radius) & valid
        left = np.flatnonzero(near)
        if not len(left):
            continue
        at = alive[left]
        levels = [c[left][None] for c in counters]
        levels[0] = np.concatenate([levels[0], differing(slice(FIRST_PLANES, len(planes)), at)])
        near = at_most(carry_save(levels), radius) & valid[left]
        hits = np.flatnonzero(near)
        if len(hits):
            bits = np.unpackbits(near[hits].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(bits)
            i = at[hits][word] * 64 + bit
            yield i, i + d


def forest(fps: np.ndarray, room: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (rows) that connect what the close pairs of all buckets connect, one per row at most, and the first row that each row reaches."""
    parent = np.arange(len(fps))
    kept: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for i, j in close_pairs(fps, room, radius):
        new = parent[i] != parent[j]
        before = len(kept)
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((a, b))
        if len(kept) > before:
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    a, b = np.array(kept, np.int64).reshape(-1, 2).T
    return a, b, parent


# ---- buckets


def block_masks(radius: int) -> list[int]:
    """Masks of every two of ``radius + 2`` bit blocks, as signed numbers."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(blocks, 2))]


def linked(radius: int, keys: int = 3, words: int = 1, stars: bool = False):
    """Links inside the buckets of sorted rows: ``keys`` columns name the bucket, the next one the row, the last ``words`` hold its fingerprint.

    Links are close pairs or, with ``stars``, lead from each row to the smallest name that it reaches in its bucket.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: list[np.ndarray]) -> pa.RecordBatch:
            new = np.ones(len(rows[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in rows[:keys]], axis=0)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(new))
            room = np.repeat(ends, ends - starts) - np.arange(len(new))
            again = np.repeat(ends - starts, ends - starts) > 1  # rows alone in their bucket link nothing
            name = rows[keys][again]
            a, b, first = forest(np.stack([c[again] for c in rows[-words:]], axis=1), room[again], radius)
            if stars:
                least = name.copy()
                np.minimum.at(least, first, name)
                a = np.flatnonzero(name != least[first])
                a, b = name[a], least[first[a]]
            else:
                a, b = name[a], name[b]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size < CHUNK_ROWS:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            same = np.ones(size, bool)
            for c in rows[:keys]:
                same &= c == c[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield links([c[:cut] for c in rows])
            held, size = [[c[cut:] for c in rows]], size - cut
        if size:
            yield links([np.concatenate(c) for c in zip(*held, strict=True)])

    return stream


def edges(fps: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS, stars: bool = False) -> DataFrame:
    """(u, v), u > v: links among distinct fingerprints ``fp`` that connect every close pair; ``stars`` as in ``linked``."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(block_masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("at")).select("at.t", "at.key", "fp")
    return in_tiles(keyed, ["t", "key"], "fp", tile_rows).mapInArrow(linked(radius, stars=stars), "u long, v long").where("u <> v").distinct()


def in_tiles(keyed: DataFrame, bucket: list[str], name: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``bucket, tile`` and the other columns, dealt and sorted; a bucket of more than ``tile_rows`` rows is cut into pairs of tiles."""
    rest = [c for c in keyed.columns if c not in bucket]
    large = settle(keyed.groupBy(*bucket).count().where(F.col("count") > tile_rows).withColumn("tiles", F.ceil(F.col("count") / tile_rows).cast("int")).drop("count"))
    own = F.pmod(F.xxhash64(name), F.col("tiles")).cast("int")
    others = F.transform(
        F.array_except(F.sequence(F.lit(0), F.col("tiles") - 1), F.array(own)),
        lambda x: (F.least(x, own) * F.col("tiles") + F.greatest(x, own)).cast("int"),
    )
    tile = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(others)).alias("tile")
    tiled = keyed.join(large, bucket, "left").select(*bucket, tile, *rest)
    return tiled.repartition(*bucket, "tile").sortWithinPartitions(*bucket, "tile")


# ---- groups


def folded(links: DataFrame) -> DataFrame:
    """(u, v), u > v, with the groups of ``links`` (u, v), u > v: a node keeps the link to its smallest v, under which its other v go.

    A node's v are held together, one per table and tile at most where links are ``stars``.
    """
    least = F.array_min("all")
    seen = links.groupBy("u").agg(F.collect_set("v").alias("all"))
    return seen.select(F.explode(F.transform("all", lambda v: F.struct(F.when(v == least, F.col("u")).otherwise(v).alias("u"), least.alias("v")))).alias("e")).select("e.*").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; star contraction, one settled table a round."""
    links = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())

    def star(pairs: DataFrame) -> DataFrame:
        """``pairs`` (x, y) seen from x: every y and x itself go under the smallest node seen."""
        least = pairs.groupBy("x").agg(F.min("y").alias("m"))
        return pairs.join(least, "x").select("x", "y", F.least("x", "m").alias("m"))

    while True:
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).union(links.select("v", "u"))
        large = star(both).where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.col("u").alias("x"), F.col("v").alias("y"))
        small = star(down).select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct(F.col("y").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = settle(small.select("e.u", "e.v").where("u <> v").distinct())
        changed = after.exceptAll(links).limit(1).count() + links.exceptAll(after).limit(1).count()
        links = after
        if not changed:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def roots(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, least, root): the smallest id of every distinct fingerprint, and the name of its group."""
    distinct = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(folded(edges(distinct.select("fp"), radius, stars=True)))
    return distinct.join(groups, distinct.fp == groups.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``."""
    fps = settle(fingerprints(docs, id_column, text_column, words))
    rooted = roots(fps, radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs`` for each group: of the smallest id; null ids come last, and of several rows the smallest text key stays."""
    fps = settle(fingerprints(docs, id_column, text_column, words))
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("doc"), "text_key")
    of_fp = fps.groupBy("fp").agg(F.min(key).alias("key"))
    picked = of_fp.join(roots(fps, radius), "fp").groupBy("root").agg(F.min("key").alias("key")).select("key.*")
    marked = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(id_column).isNull().alias("missing"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(0)).alias("doc"),
        text_key(F.col(text_column)).alias("text_key"),
    )
    found = marked.join(picked, ["missing", "doc", "text_key"])
    return found.dropDuplicates(["missing", "doc", "text_key"]).select("row.*")
