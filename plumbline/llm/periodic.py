"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q)
words that no neighbour extends.  Words q apart agree over a stretch of at least 3 q, so for
2^k <= q < 2^(k+1) the stretch contains a whole aligned block of B = 2^k words, and the
block occurs again q words later.  At every scale k:

* blocks of which some word does not come back within 2 B words cannot lie in such a stretch and are left out;
* for the others, the sums of squared differences between block and following window at the distances
  B to 2 B - 1 are one convolution, taken exactly by a number-theoretic transform modulo a
  prime: where no word differs the sum is zero.  Blocks above ``BLOCK`` words are represented by
  their first ``BLOCK``, and their windows are cut into pieces;
* a zero at distance q is a seed.  Seeds are confirmed, extended to both sides by binary search on prefix
  hashes, and the stretch found is compared word by word.  Seeds inside a run of a smaller
  period say nothing new and are dropped.

A transform of more than 64 points is split in two factors, each a matrix product: with
residues below 2^23 and at most 128 terms all sums stay below 2^53, so double precision is exact.

Map only: a block of documents (``arrow.BLOCK_BYTES``, or one longer text) is one array of
word numbers with a word of its own between documents.  One document is read by one task, at about ten times its size.

Odd rows: a null text has no words and counts as empty; a text without runs keeps all its
words, joined by single spaces; repeated rows are treated alike; an empty table gives an empty
table.  Columns of the input come back inside ``row``, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.arrow import blocks, named

#: Repetitions and words that make a run.
REPEATS, LEAST = 4, 6
#: Longest block that is convolved.
BLOCK = 4096
#: Numbers in one batch of transforms.
BATCH = 1 << 20

# A prime with 2^20 | p - 1 and a generator of its multiplicative group.
PRIME, GENERATOR = 7 * 2**20 + 1, 3

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


# -- exact transforms -------------------------------------------------------------------


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for whole numbers below 2^53 held as doubles."""
    x = x - PRIME * np.floor(x * (1.0 / PRIME))
    x[x < 0] += PRIME
    x[x >= PRIME] -= PRIME
    return x


@lru_cache(maxsize=64)
def _powers(n: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    return np.array([pow(root, k, PRIME) for k in range(n)], np.float64)


@lru_cache(maxsize=64)
def _matrix(rows: int, columns: int, n: int, inverse: bool) -> np.ndarray:
    return _powers(n, inverse)[np.outer(np.arange(rows), np.arange(columns)) % n]


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of every row (a power of two long), not scaled."""
    rows, n = x.shape
    if n <= 64:
        return reduced(x @ _matrix(n, n, n, inverse))
    n1 = 1 << (n.bit_length() - 1) // 2
    n2 = n // n1
    inner = reduced(_matrix(n1, n1, n1, inverse) @ x.reshape(rows, n1, n2))
    inner = reduced(inner * _matrix(n1, n2, n, inverse))
    return reduced(inner @ _matrix(n2, n2, n2, inverse)).transpose(0, 2, 1).reshape(rows, n)


def squared_differences(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Sum over i of (short[i] - long[i + o])^2 modulo the prime for o < B, per row; B and 2 B columns."""
    rows, b = short.shape
    turned = np.zeros_like(long)
    turned[:, 0] = short[:, 0]
    turned[:, : 2 * b - b : -1] = short[:, 1:]
    cross = transform(reduced(transform(turned) * transform(long)), inverse=True)[:, :b]
    cross = reduced(cross * pow(2 * b, -1, PRIME))
    squares = np.concatenate([np.zeros((rows, 1)), np.cumsum(reduced(long * long), axis=1)], axis=1)
    own = reduced(short * short).sum(axis=1, keepdims=True)
    return reduced(own + squares[:, b : 2 * b] - squares[:, :b] + 2.0 * (PRIME - cross))


# -- words as numbers -------------------------------------------------------------------


def word_numbers(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word, first word of each text) of a string column."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    filled = pc.not_equal(lists.flatten(), "")
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    coded = lists.flatten().filter(filled).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), upto[bounds]


def separated(numbers: np.ndarray, starts: np.ndarray, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """One array with a word that occurs nowhere else after each text, and where each text starts in it."""
    texts = len(starts) - 1
    line = np.empty(len(numbers) + texts, np.int64)
    ends = starts[1:] + np.arange(texts)
    inside = np.ones(len(line), bool)
    inside[ends] = False
    line[inside] = numbers
    line[ends] = distinct + np.arange(texts)
    return line, starts[:-1] + np.arange(texts)


def gaps_to_next(line: np.ndarray) -> np.ndarray:
    """How far ahead the same word comes next; beyond the end where it does not."""
    gaps = np.full(len(line), 2 * len(line) + 2, np.int64)
    order = np.argsort(line, kind="stable")
    again = line[order[1:]] == line[order[:-1]]
    gaps[order[:-1][again]] = np.diff(order)[again]
    return gaps


class Prefixes:
    """Hashes of all prefixes (modulo 2^64), to tell how far two places agree."""

    def __init__(self, line: np.ndarray):
        self.line = line
        x = line.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        base = np.full(len(line) + 1, 0xD1342543DE82EF95, np.uint64)
        base[0] = 1
        self.powers = np.multiply.accumulate(base)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.powers[:-1])])

    def agree(self, at: np.ndarray, distance: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        near = self.sums[at + length] - self.sums[at]
        far = self.sums[at + distance + length] - self.sums[at + distance]
        return near * self.powers[distance] == far

    def stretches(self, at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest [start, end) around each place on which words ``distance`` apart agree."""
        n = len(self.line)
        low, high = np.zeros_like(at), n - at - distance
        while np.any(low < high):
            middle = (low + high + 1) // 2
            good = self.agree(at, distance, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        end = at + low
        low, high = np.zeros_like(at), at.copy()
        while np.any(low < high):
            middle = (low + high + 1) // 2
            good = self.agree(at - middle, distance, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return at - low, end

    def exact_stretch(self, at: int, start: int, end: int, q: int) -> tuple[int, int]:
        """The stretch, word by word; shorter than the hashes say only if two of them are equal by chance."""
        differ = np.flatnonzero(self.line[start:end] != self.line[start + q : end + q]) + start
        before, after = differ[differ < at], differ[differ >= at]
        return int(before[-1]) + 1 if len(before) else start, int(after[0]) if len(after) else end


# -- runs -------------------------------------------------------------------------------


def _seeds(values: np.ndarray, places: np.ndarray, width: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, distance) of blocks of ``width`` words that come again ``scale`` to 2 ``scale`` - 1 words later."""
    ahead = np.repeat(np.arange(0, scale, width)[None, :], len(places), axis=0).ravel()
    at = np.repeat(places, scale // width)
    step = max(1, BATCH // (2 * width))
    for first in range(0, len(at), step):
        block, offset = at[first : first + step], ahead[first : first + step]
        short = values[block[:, None] + np.arange(width)]
        follow = values[(block + scale + offset)[:, None] + np.arange(2 * width)]
        row, o = np.nonzero(squared_differences(short, follow) == 0)
        yield block[row], scale + offset[row] + o


def find(line: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs, by start, then period; ``longest``: words of the longest text."""
    n = len(line)
    runs = np.empty((0, 3), np.int64)
    if longest < LEAST:
        return runs
    prefixes = Prefixes(line)
    values = np.concatenate([((line * 2654435761 + 97) % PRIME).astype(np.float64), np.zeros(4 * longest + 4)])
    widest = gaps_to_next(line)
    scale = 1
    while REPEATS * scale <= longest:
        width = min(scale, BLOCK)
        places = np.flatnonzero(widest < 2 * scale) * width
        places = places[(places % scale == 0) & (places + scale + width <= n)]
        covering = runs[runs[:, 2] <= width]
        reach = np.maximum.accumulate(covering[:, 1]) if len(covering) else None
        found = set()
        for at, q in _seeds(values, places, width, scale):
            inside = at + q + width <= n
            at, q = at[inside], q[inside]
            if reach is not None:
                before = np.searchsorted(covering[:, 0], at, "right") - 1
                inside = (before < 0) | (reach[before] < at + q + width)
                at, q = at[inside], q[inside]
            same = prefixes.agree(at, q, width)
            at, q = at[same], q[same]
            start, end = prefixes.stretches(at, q)
            enough = end - start + q >= np.maximum(LEAST, REPEATS * q)
            found.update(zip(at[enough].tolist(), start[enough].tolist(), end[enough].tolist(), q[enough].tolist(), strict=True))
        runs = _with_runs(runs, prefixes, found)
        scale *= 2
        if scale <= BLOCK:
            widest = widest[: len(widest) // 2 * 2].reshape(-1, 2).max(axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _with_runs(runs: np.ndarray, prefixes: Prefixes, found: set[tuple[int, int, int, int]]) -> np.ndarray:
    """The runs with those found at one scale, confirmed, and without such that have a smaller period."""
    known = {(s, e) for s, e, _ in runs.tolist()}
    new, checked = set(), set()
    for at, start, end, q in found:
        if (start, end, q) in checked:
            continue
        checked.add((start, end, q))
        start, end = prefixes.exact_stretch(at, start, end, q)
        if end - start + q >= max(LEAST, REPEATS * q) and (start, end + q) not in known:
            new.add((start, end + q, q))
    if not new:
        return runs
    runs = np.concatenate([runs, np.array(sorted(new), np.int64)])
    return runs[np.argsort(runs[:, 0], kind="stable")]


def _block(batch: pa.RecordBatch) -> pa.RecordBatch:
    words, numbers, starts = word_numbers(named(batch, "text"))
    counts = np.diff(starts)
    line, firsts = separated(numbers, starts, len(words))
    runs = find(line, int(counts.max(initial=0)))
    owner = np.searchsorted(firsts, runs[:, 0], "right") - 1
    per_text = np.searchsorted(owner, np.arange(len(firsts) + 1))
    table = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - firsts[owner]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], names=["start", "length", "period"]
    )
    edges = np.zeros(len(line) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 1], -1)
    dropped = np.delete(np.cumsum(edges[:-1]) > 0, starts[1:] + np.arange(len(counts)))
    upto = np.concatenate([[0], np.cumsum(~dropped)])[starts]
    kept = words.take(pa.array(numbers[~dropped]))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), kept), pa.scalar(" ", pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [named(batch, "row"), pa.array(counts), pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), table), joined.cast(pa.string())],
        names=["row", "n_words", "runs", "collapsed"],
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        yield _block(batch)


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words``, ``runs`` (start, length, period by start, then period), ``collapsed``.

    ``collapsed`` is the text without the words of runs after their first period, joined by spaces.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            rows.schema["row"],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return rows.mapInArrow(_stream, schema)
