"""Line deduplication: one keep bitmap per document, text stays where it is.

Line keys are hashed to 128 bits, range-partitioned by (hash, document) and sorted by
(hash, document, position).  Each task streams its range and knows the first document of
every hash it meets; a hash that began in an earlier range gets its first document from
the table of range edges, which has two rows per range.  So a line that a third of all
documents share is spread over many ranges and no task holds it.

Defined results: a null text is one empty line; a null id counts as one document that
comes after all others; rows with equal id and equal text get equal bitmaps; rows with
equal id and different texts are one document for the choice of the first.  Columns other
than the id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.settle import checkpointed
from plumbline.llm.arrow import pieces

SPACES = " \t\n\u000b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST = 2**63 - 1


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_key(text: Column) -> Column:
    """Tells the rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sorted_lines(docs: DataFrame, id_column: str, text_column: str, least: int) -> DataFrame:
    """(h1, h2, doc, id_missing, text_key, pos) of lines with long keys, in ranges of (h1, h2, doc), checkpointed in that order."""
    exploded = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("doc"),
        F.col(id_column).isNull().alias("id_missing"),
        text_key(F.col(text_column)).alias("text_key"),
        F.posexplode(F.transform(lines_of(F.col(text_column)), line_key)).alias("pos", "line"),
    ).where(F.char_length("line") >= least)
    keyed = exploded.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "id_missing", "text_key", "pos"
    )
    ranged = keyed.repartitionByRange("h1", "h2", "doc", "id_missing")
    return checkpointed(ranged.sortWithinPartitions("h1", "h2", "doc", "id_missing", "text_key", "pos"))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    h1, h2, doc, missing, text, pos = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return h1, h2, doc, missing, text, pos


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first document that this range knows for its first and its last hash."""
    first = last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, missing, *_ = _columns(batch)
        at = (int(h1[0]), int(h2[0]))
        first = first or (*at, int(doc[0]), bool(missing[0]))
        end = (int(h1[-1]), int(h2[-1]))
        if last is None or last[:2] != end:
            k = int(np.flatnonzero((h1 == end[0]) & (h2 == end[1]))[0])
            last = (*end, int(doc[k]), bool(missing[k]))
    if first:
        rows = [(TaskContext.get().partitionId(), x == 0, *r) for x, r in enumerate((first, last))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*rows, strict=True)], names=["part", "is_first", "h1", "h2", "doc", "id_missing"]
        )


def _repeats(carried: dict[int, tuple[int, bool]]):
    """Streams one range; lines of other documents than the first of their hash go."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = carried.get(TaskContext.get().partitionId())
        last: tuple[int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, missing, text, pos = _columns(batch)
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            first_doc, first_missing = doc[starts].copy(), missing[starts].copy()
            if known is not None and (last is None or last == (int(h1[0]), int(h2[0]))):
                first_doc[0], first_missing[0] = known
            known, last = (int(first_doc[-1]), bool(first_missing[-1])), (int(h1[-1]), int(h2[-1]))
            gone = (doc != first_doc[run]) | (missing != first_missing[run])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[gone]) for x in (doc, missing, text, pos)], names=["doc", "id_missing", "text_key", "pos"]
            )

    return stream


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop positions of a text into its compressed keep bitmap (zlib over bits, line 0 first)."""
    for batch in batches:
        sizes = batch.column(3).to_pylist()
        maps = []
        for n, gone in zip(sizes, batch.column(4).to_pylist(), strict=True):
            keep = np.ones(-(-n // 8) * 8, np.uint8)  # lines past the last that goes stay
            keep[gone] = 0
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(maps, pa.binary())], names=["doc", "id_missing", "text_key", "n_lines", "keep_bitmap"])


def drop_positions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10) -> DataFrame:
    """(doc, id_missing, text_key, gone): ascending positions of the lines that go, for the texts that lose any."""
    lines = sorted_lines(docs, id_column, text_column, least)
    edges = lines.mapInArrow(_edges, "part long, is_first boolean, h1 long, h2 long, doc long, id_missing boolean").collect()
    firsts: dict[tuple[int, int], tuple[int, bool]] = {}
    for r in edges:  # two rows per range
        at, doc = (r["h1"], r["h2"]), (r["doc"], r["id_missing"])
        firsts[at] = min(firsts.get(at, doc), doc)
    carried = {r["part"]: firsts[r["h1"], r["h2"]] for r in edges if r["is_first"]}
    repeats = lines.mapInArrow(_repeats(carried), "doc long, id_missing boolean, text_key long, pos int")
    return repeats.groupBy("doc", "id_missing", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def with_bitmaps(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10) -> DataFrame:
    """(row, keep_bitmap): each row of ``docs`` as one struct, and its bitmap (null: every line stays).

    A key of ``least`` code points or more that two documents hold loses all its lines
    outside the smallest id that holds it.  The bitmap ends with the last line that goes.
    """
    gone = drop_positions(docs, id_column, text_column, least)
    key = ["doc", "id_missing", "text_key"]
    maps = gone.select(*key, (F.array_max("gone") + 1).alias("n_lines"), "gone").mapInArrow(
        _bitmaps, "doc long, id_missing boolean, text_key long, n_lines int, keep_bitmap binary"
    )
    marked = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("doc"),
        F.col(id_column).isNull().alias("id_missing"),
        text_key(F.col(text_column)).alias("text_key"),
    )
    return marked.join(maps, key, "left").select("row", "keep_bitmap")


def kept_text(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """(lines that stay, lines before, lines that went)."""
    if bitmap is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    keep = np.ones(len(lines), np.uint8)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)]
    keep[: len(bits)] = bits
    return "\n".join(compress(lines, keep.tolist())), len(lines), int((keep == 0).sum())


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 10) -> DataFrame:
    """(row, kept, n_lines, n_dropped): bitmaps applied to the texts."""
    marked = with_bitmaps(docs, id_column, text_column, least)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, maps = batch.columns
            texts = row.field(text_column).to_pylist()
            done = [kept_text(t or "", m) for t, m in zip(texts, maps.to_pylist(), strict=True)]
            kept, n_lines, n_dropped = zip(*done, strict=True) if done else ((), (), ())
            columns = [row, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "kept", "n_lines", "n_dropped"])

    schema = marked.select("row").schema.add("kept", "string").add("n_lines", "long").add("n_dropped", "long")
    return marked.mapInArrow(applied, schema)
