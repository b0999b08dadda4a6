"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a block of documents of bounded bytes.  Its words become symbols: the rank
of the word among the words of the benchmark, or a separator.  Words no item has, and
runs shorter than the shortest window, cannot take part in an occurrence and shrink to a
separator.  The Burrows-Wheeler transform of the symbols is kept in a wavelet matrix;
windows of benchmark words are found by backward search in its ranks, all at once, and
occurrences are located by walking to sampled suffix positions.  Found words are merged into spans.

Benchmark items are searched in blocks of bounded size: one pass over the documents for
each block, with the spans and items found so far carried along.  Nothing is shuffled.

Defined results: null texts have no words; an item without a word never occurs; an item
with a null id marks words but is not listed; repeated items count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.arrow import blocks, named, utf8

#: Benchmark text that one pass searches: what is sent to every task is bounded by this.
ITEM_BLOCK_BYTES = 16 << 20
#: Text bytes of a shard, which has an index of its own.
SHARD_BYTES = 4 << 20
SAMPLE_EVERY = 8

_CODES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
WORD_BYTE = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)
_RANDOM = np.random.default_rng(20240229)
BYTE_HASH = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64)[LOWER] * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


# ---- words


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word; no word crosses a document."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = WORD_BYTE[data]
    start, stop = inside[:-1].copy(), inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    stop &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each lower-cased word."""
    if not len(first):
        return np.zeros(0, np.uint64)
    sizes = last - first
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()) - 1, STEP)]), dtype=np.uint64)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
        at = place + np.repeat(first, sizes)
        return np.add.reduceat(BYTE_HASH[data[at]] * powers[place], starts) ^ (sizes.astype(np.uint64) << np.uint64(32))


# ---- wavelet matrix and FM-index


class BitRank:
    """Packed bits with the number of ones before every word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.zeros = len(bits) - int(counts.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            plane = (symbols >> b & 1).astype(np.uint8)
            self.levels.append((b, BitRank(plane)))
            symbols = np.concatenate([symbols[plane == 0], symbols[plane == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(at), at
        for b, level in self.levels:
            one = (symbol >> b & 1).astype(bool)
            ones_low, ones_high = level.ones(low), level.ones(high)
            low = np.where(one, level.zeros + ones_low, low - ones_low)
            high = np.where(one, level.zeros + ones_high, high - ones_high)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for b, level in self.levels:
            one = level.get(at).astype(bool)
            ones = level.ones(at)
            at = np.where(one, level.zeros + ones, at - ones)
            out |= one.astype(out.dtype) << b
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; symbol 0 ends a suffix and every 0 differs from every other."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        ordered = rank[order]
        if k == 1:
            changed = ordered[1:] != ordered[:-1]
        else:
            changed = keys[order][1:] != keys[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changed)])
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[:-k] = rank[k:] + 1
        keys = (rank << 32) | later
        order = np.argsort(keys, kind="stable")
        k *= 2


class FMIndex:
    """Of symbols in which 0 separates runs; the text begins and ends with 0."""

    def __init__(self, text: np.ndarray, top: int, every: int = SAMPLE_EVERY):
        suffixes = suffix_array(text)
        self.matrix = WaveletMatrix(text[suffixes - 1].astype(np.int64), max(1, int(top).bit_length()))
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # a run's first symbol is sampled too, so no walk crosses a separator
        sampled = (suffixes % every == 0) | (text[suffixes - 1] == 0)
        self.sampled = BitRank(sampled.astype(np.uint8))
        self.samples = suffixes[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of each pattern, one per line; symbols are 1 or more."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.smaller[-1])
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column]
            low[alive] = self.smaller[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.matrix.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            done = self.sampled.get(rows).astype(bool)
            out[todo[done]] = self.samples[self.sampled.ones(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            symbol = self.matrix.symbol(rows)
            rows = self.smaller[symbol] + self.matrix.rank(symbol, rows)
            steps += 1
        return out


# ---- the benchmark


@dataclass(frozen=True)
class Patterns:
    """Distinct windows of benchmark words, by length."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = place + 1
    windows: dict[int, np.ndarray]  # size -> (windows, size) symbols
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # size -> (window number, item number) pairs, by window
    ids: list[int | None]

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)


def patterns_of(ids: list[int | None], texts: list[str | None], size: int) -> Patterns:
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    first, last = word_bounds(data, offsets)
    hashes = word_hashes(data, first, last)
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    symbols = symbols + 1
    cuts = np.searchsorted(first, offsets)
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in range(len(ids)):
        words = symbols[cuts[k] : cuts[k + 1]]
        if len(words):
            n = min(size, len(words))
            views = np.lib.stride_tricks.sliding_window_view(words, n)
            found.setdefault(n, []).append((views, np.full(len(views), k)))
    windows, items = {}, {}
    for n, parts in found.items():
        distinct, which = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1), np.concatenate([i for _, i in parts])], axis=1), axis=0)
        windows[n], items[n] = distinct, (pairs[:, 0], pairs[:, 1])
    return Patterns(vocabulary, windows, items, ids)


# ---- one shard


def shard_text(symbols: np.ndarray, doc_of: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the shard and, for each, the number of its word (-1: separator).

    Runs of benchmark words inside one document stay if a window fits; the rest shrinks.
    """
    known = symbols > 0
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (doc_of[1:] != doc_of[:-1])
    starts = np.flatnonzero(begins)
    run = np.cumsum(begins) - 1
    sizes = np.bincount(run[known], minlength=len(starts))
    long = sizes >= shortest
    taken = known & long[run] if len(starts) else known
    words = np.flatnonzero(taken)
    head = np.flatnonzero(begins & taken)
    slot = np.arange(len(words)) + np.searchsorted(head, words, "right")  # a separator before each run
    text = np.zeros(len(words) + len(head) + 1, np.int64)
    word_at = np.full(len(text), -1, np.int64)
    text[slot], word_at[slot] = symbols[words], words
    return text, word_at


def occurrences(index: FMIndex, word_at: np.ndarray, patterns: Patterns) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, window number, number of its first word) of every occurrence."""
    for size, windows in patterns.windows.items():
        low, high = index.search(windows)
        counts = np.maximum(0, high - low)
        which = np.repeat(np.arange(len(windows)), counts)
        rows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
        yield size, which, word_at[index.locate(rows)]


def marked(data: np.ndarray, offsets: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, last byte, document, hit) of every word and the (document, item) pairs found."""
    first, last = word_bounds(data, offsets)
    doc_of = np.searchsorted(offsets, first, "right") - 1
    hit = np.zeros(len(first) + 1, np.int64)
    pairs = np.zeros((0, 2), np.int64)
    if not patterns.windows or not len(first):
        return first, last, doc_of, hit[:-1] > 0, pairs
    hashes = word_hashes(data, first, last)
    place = np.minimum(np.searchsorted(patterns.vocabulary, hashes), len(patterns.vocabulary) - 1)
    symbols = np.where(patterns.vocabulary[place] == hashes, place + 1, 0)
    text, word_at = shard_text(symbols, doc_of, patterns.shortest)
    if len(text) > 1:
        index = FMIndex(text, len(patterns.vocabulary))
        for size, which, word in occurrences(index, word_at, patterns):
            np.add.at(hit, word, 1)
            np.add.at(hit, word + size, -1)
            seen = np.unique(np.stack([which, doc_of[word]], axis=1), axis=0)
            window, item = patterns.items[size]
            start = np.searchsorted(window, seen[:, 0])
            n = np.searchsorted(window, seen[:, 0], "right") - start
            line = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
            pairs = np.unique(np.concatenate([pairs, np.stack([np.repeat(seen[:, 1], n), item[line]], axis=1)]), axis=0)
    return first, last, doc_of, np.cumsum(hit)[:-1] > 0, pairs


def merged(flags: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each stretch of true."""
    padded = np.concatenate([[False], flags, [False]])
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words long, hits array<struct<start:long,end:long>>, spans array<struct<start:long,end:long>>, items array<long>"


def _searched(patterns: Patterns, kept: list[str], again: bool):
    """Adds what the block finds to each document; ``again``: the columns of an earlier block are there."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", SHARD_BYTES):
            data, offsets = utf8(named(batch, "text"))
            first, last, doc_of, hit, pairs = marked(data, offsets, patterns)
            edges = np.searchsorted(doc_of, np.arange(batch.num_rows + 1))
            hits, spans = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            items: list[list[int]] = [[] for _ in range(batch.num_rows)]
            if again:
                items = named(batch, "items").to_pylist()
                for k, before in enumerate(named(batch, "hits").to_pylist()):
                    for s in before:
                        hit[edges[k] + s["start"] : edges[k] + s["end"]] = True
            for k, item in pairs.tolist():
                if patterns.ids[item] is not None:
                    items[k].append(patterns.ids[item])
            for k in np.unique(doc_of[hit]).tolist():
                lo, text = edges[k], data[offsets[k] : offsets[k + 1]]
                code_points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                for a, b in merged(hit[lo : edges[k + 1]]):
                    hits[k].append({"start": a, "end": b})
                    spans[k].append({"start": int(code_points[first[lo + a] - offsets[k]]), "end": int(code_points[last[lo + b - 1] - offsets[k]])})
            yield pa.RecordBatch.from_arrays(
                [
                    *(named(batch, c) for c in kept),
                    pa.array(np.diff(edges)),
                    pa.array(hits, SPANS),
                    pa.array(spans, SPANS),
                    pa.array([sorted(set(i)) for i in items], pa.list_(pa.int64())),
                ],
                names=[*kept, "n_words", "hits", "spans", "items"],
            )

    return stream


def item_blocks(items: DataFrame, id_column: str, text_column: str, size: int, most: int = ITEM_BLOCK_BYTES) -> Iterator[Patterns]:
    """The distinct items of the benchmark in blocks of about ``most`` bytes of text; equal rows would all meet in one block."""
    rows = items.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("text is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // most))
    for b in range(count):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b).collect()  # about ``most`` bytes
        if block:
            yield patterns_of([r["id"] for r in block], [r["text"] for r in block], size)


def decontaminate(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, most: int = ITEM_BLOCK_BYTES) -> DataFrame:
    """(row, text, n_words, hits, spans, items): each row of ``docs`` as a struct and what was found in it.

    ``hits``: spans of word numbers; ``spans``: the same in code points, ends exclusive;
    ``items``: ids of the items of which a window of ``size`` words (or all, if fewer) occurs.
    """
    found = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_column).alias("text"))
    again = False
    for patterns in item_blocks(items, item_id, item_text, size, most):
        found = found.mapInArrow(_searched(patterns, ["row", "text"], again), _with_found(found))
        again = True
    if not again:
        nothing = Patterns(np.zeros(0, np.uint64), {}, {}, [])
        found = found.mapInArrow(_searched(nothing, ["row", "text"], False), _with_found(found))
    return found


def _with_found(df: DataFrame) -> StructType:
    return StructType(df.select("row", "text").schema.fields + StructType.fromDDL(FOUND).fields)


def without_spans(text: str | None, spans: list[dict]) -> str | None:
    """``text`` less the code points of the spans, with one space in their place."""
    if not spans:
        return text
    pieces, at = [], 0
    for s in spans:
        pieces.append(text[at : s["start"]])
        at = s["end"]
    return " ".join([*pieces, text[at:]])
