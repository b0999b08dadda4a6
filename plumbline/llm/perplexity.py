"""Quality rules with an n-gram perplexity band per language.

Spark counts the 5-grams of code points (any script, case and punctuation kept) of every
whole text, per language; a modified Kneser-Ney model is made from the counts by
aggregations and joins, one order after the other, and grows with the corpus.  Nothing of
it passes through the driver and no task holds a language.  Every language has a model of its own.

Texts are dealt by hash to two halves, equal texts to one; a text is scored by the model of
the other half, so it can't vouch for itself.  Both halves stand side by side in each row
of the model (``n0, n1``), and an n-gram that one half lacks has count 0 there, so the
probability of each n-gram of the corpus is at hand in both, backed off where need be.

Texts are scored in blocks of one language and about ``BLOCK`` bytes: a block asks for its
distinct n-grams once, a join answers, and the answer is kept as an array of sorted hashes
while the texts of the block stream past.  The n-grams themselves are compared exactly (105 bits in
two longs); 64 bits of hash tell them apart inside a block only.  Texts travel to their blocks twice,
to be counted and to be scored, each time as compressed Arrow streams that hold many rows of a block.

Documents whose log perplexity lies outside the band of their language go.  The band is
the median and a number of median deviations, taken from exact histograms of all documents.

Defined results: a null text has no words and fails; null languages form one language; an
empty table gives no rows; a language with texts in one half only is scored evenly over its characters,
and a band is around them all the same; very long texts are counted and scored in pieces.
Rows that are equal in all columns share a block, which streams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.settle import settle
from plumbline.llm.arrow import blocks, give_back, named, utf8

ORDER = 5
#: Bits of a code point, one added; 0 stands before a text.  A long holds three, so an n-gram has two longs.
BITS = 21
#: Text bytes of a block, and of a piece of a longer text.
BLOCK = 16 << 20
PIECE = 2 << 20
#: Bytes of rows that are sorted by block and compressed together, and how hard.
PACK = 32 << 20
LEVEL = 6
#: Distinct n-grams gathered in a task before they are summed.
GATHERED = 4 << 20
#: Width of a histogram bin of log perplexity, in nats.
BIN = 0.005
#: Half width of the band in median deviations, and its least half width in nats.
DEVIATIONS = 10.0
LEAST_HALF_WIDTH = 0.08
NO_LANGUAGE = "\u0000"


# ---- rows on their way to blocks


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, packed): the rows of each block as compressed Arrow streams, in parts of about ``PACK`` bytes of all blocks."""
    held, size = [], 0

    def packs() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        block = rows["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
        codec, streams = pa.Codec("zstd", compression_level=LEVEL), []
        for group in groups:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as stream:
                stream.write_table(rows.take(pa.array(group)))
            streams.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[[g[0] for g in groups]]), pa.array(streams, pa.binary())], names=["block", "packed"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK:
            yield packs()
            held, size = [], 0
            give_back()
    if held:
        yield packs()
    give_back()


def _unpacked(streams: pa.Array) -> Iterator[pa.RecordBatch]:
    for stream in streams:
        yield from pa.ipc.open_stream(stream.as_buffer())


# ---- n-grams of a text


def grams(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each code point, as (high, low) longs; ``starts`` bounds the texts."""
    parts = np.zeros((2, len(codes)), np.int64)
    for back in range(ORDER):
        before = np.zeros(len(codes), np.int64)
        before[back:] = codes[: max(len(codes) - back, 0)]
        for k in range(back):
            at = starts[:-1] + k
            before[at[at < starts[1:]]] = 0
        parts[0 if back >= 3 else 1] |= before << (BITS * (back % 3))
    return parts[0], parts[1]


def code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64) + 1


def hashes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """64 bits of hash of each n-gram."""
    with np.errstate(over="ignore"):
        x = high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ low.astype(np.uint64)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(32))


def text_grams(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each n-gram, high, low) of the texts of a batch; a longer text comes in pieces that know what stands before them."""
    data, offsets = utf8(named(batch, "text"))
    if len(data) <= 2 * PIECE or batch.num_rows > 1:
        first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])[offsets]
        yield np.repeat(np.arange(len(first) - 1), np.diff(first)), *grams(code_points(data.tobytes()), first)
        return
    before, start = np.zeros(0, np.int64), 0
    while start < len(data):
        stop = min(start + PIECE, len(data))
        while stop < len(data) and (data[stop] & 0xC0) == 0x80:
            stop += 1
        codes = np.concatenate([before, code_points(data[start:stop].tobytes())])
        high, low = (x[len(before) :] for x in grams(codes, np.array([0, len(codes)])))
        yield np.zeros(len(high), np.int64), high, low
        before, start = codes[-(ORDER - 1) :], stop


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(hash, high, low, n) by hash, of several such lists."""
    key, high, low, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    keys, first, which = np.unique(key, return_index=True, return_inverse=True)
    return keys, high[first], low[first], np.bincount(which, n, len(keys)).astype(np.int64)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each block with their counts; a list that outgrows ``GATHERED`` is sent in parts."""
    lists: dict[tuple[str, int, int], list] = {}

    def sent(key: tuple[str, int, int], parts: list) -> pa.RecordBatch:
        _, high, low, n = summed(parts)
        fixed = [pa.repeat(pa.scalar(v, kind), len(n)) for v, kind in zip(key, (pa.string(), pa.int32(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*fixed, *map(pa.array, (high, low, n))], names=["lang", "half", "block", "high", "low", "n"])

    rows = (row for batch in batches for row in _unpacked(named(batch, "packed")))
    for batch in blocks(rows, "text"):
        of_row = list(zip(*(named(batch, c).to_pylist() for c in ("lang", "half", "block")), strict=True))
        number = {key: k for k, key in enumerate(dict.fromkeys(of_row))}
        which = np.array([number[key] for key in of_row])
        for rows, high, low in text_grams(batch):
            for key, k in number.items():
                mine = slice(None) if len(number) == 1 else which[rows] == k
                found = hashes(high[mine], low[mine]), high[mine], low[mine]
                parts = lists.setdefault(key, [])
                parts.append(summed([(*found, np.ones(len(found[0]), np.int64))]))
                if len(parts) > 8:
                    parts[:] = [summed(parts)]
                if sum(len(p[0]) for p in lists[key]) > GATHERED:
                    yield sent(key, lists.pop(key))
    for key in list(lists):
        yield sent(key, lists.pop(key))


# ---- modified Kneser-Ney, as tables


def _last(k: int) -> tuple[Column, Column]:
    """The last ``k`` code points of an n-gram."""
    return (
        F.col("high").bitwiseAND(F.lit((1 << BITS * max(k - 3, 0)) - 1)).alias("high"),
        F.col("low").bitwiseAND(F.lit((1 << BITS * min(k, 3)) - 1)).alias("low"),
    )


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d0, d1): what the halves take off counts of 1, 2, and 3 or more; a half of the count where counts of counts are missing."""
    tallies = [F.count_if(F.col(f"n{h}") == k).alias(f"t{h}{k}") for h in (0, 1) for k in range(1, 5)]
    by_language = counts.groupBy("lang").agg(*tallies)

    def taken(h: int, k: int) -> Column:
        t = [F.col(f"t{h}{j}").cast("double") for j in range(1, 5)]
        d = k - (k + 1) * F.try_divide(t[0], t[0] + 2 * t[1]) * F.try_divide(t[k], t[k - 1])
        return F.when((d > 0) & (d < k), d).otherwise(F.lit(k / 2))

    return by_language.select("lang", *(F.array(*(taken(h, k) for k in (1, 2, 3))).alias(f"d{h}") for h in (0, 1)))


def model(counts: DataFrame) -> DataFrame:
    """(lang, high, low, p0, p1) of counts (lang, high, low, n0, n1): the probability of the last code point in both halves.

    Lower orders count distinct left neighbours; orders are interpolated down to an even
    chance over the characters of the language.
    """
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[-1].groupBy("lang", *_last(k)).agg(*(F.count_if(F.col(f"n{h}") > 0).alias(f"n{h}") for h in (0, 1)))
        levels.append(settle(shorter))
    lower = levels[-1].groupBy("lang").agg((1.0 / F.count("*")).alias("q0")).withColumn("q1", F.col("q0"))
    for k, level in enumerate(levels[::-1], 1):
        taken = level.join(discounts(level), "lang").withColumn("before", F.shiftright("low", BITS))
        for h in (0, 1):
            n = F.col(f"n{h}")
            taken = taken.withColumn(f"d{h}", F.when(n > 0, F.get(f"d{h}", F.least(n, F.lit(3)).cast("int") - 1)).otherwise(0.0))
        sums = [F.sum(f"{c}{h}").alias(f"{c}_all{h}") for c in "nd" for h in (0, 1)]
        context = ["lang", *(["high", "before"] if k > 1 else [])]
        whole = taken.join(taken.select(*context, "n0", "n1", "d0", "d1").groupBy(*context).agg(*sums), context)
        if k > 1:
            high, low = _last(k - 1)
            whole = whole.withColumns({"suffix_high": high, "suffix_low": low})
            lower = lower.select("lang", *(F.col(c).alias(f"suffix_{c}") for c in ("high", "low")), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
        whole = whole.join(lower, ["lang", *(["suffix_high", "suffix_low"] if k > 1 else [])])

        def probability(h: int) -> Column:
            n, d, n_all, d_all, q = (F.col(c.format(h)) for c in ("n{}", "d{}", "n_all{}", "d_all{}", "q{}"))
            return F.when(n_all > 0, (n - d + d_all * q) / n_all).otherwise(q).alias(f"p{h}")

        lower = settle(whole.select("lang", "high", "low", probability(0), probability(1)))
    return lower


# ---- bands


def bands(scored: DataFrame, deviations: float, least: float) -> DataFrame:
    """(lang, lowest, highest): median and median deviation of the log perplexities of each language, from a histogram."""
    bins = scored.where("nats is not null").groupBy("lang", ((F.floor(F.col("nats") / BIN) + 0.5) * BIN).alias("middle")).agg(F.count("*").alias("n"))
    each = Window.partitionBy("lang")

    def middle(value: Column) -> Column:
        return F.min(F.when(2 * F.col("up_to") >= F.col("all"), value)).over(each)

    found = bins.withColumns({"all": F.sum("n").over(each), "up_to": F.sum("n").over(each.orderBy("middle"))})
    found = found.withColumn("median", middle(F.col("middle")))
    found = found.withColumn("away", F.abs(F.col("middle") - F.col("median")))
    found = found.withColumn("up_to", F.sum("n").over(each.orderBy("away")))
    found = found.withColumn("half", F.greatest(F.lit(least), deviations * middle(F.col("away"))))
    return found.groupBy("lang").agg(F.min(F.col("median") - F.col("half")).alias("lowest"), F.min(F.col("median") + F.col("half")).alias("highest"))


# ---- rules


def rule_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    n_chars = len(raw) if raw.isascii() else len(raw.decode())
    word_chars = n_chars - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        last = 0  # words up to here are counted
        for k, w in enumerate(windows):
            if times[w] > 1:
                repeats += k + 3 - max(k, last)
                last = k + 3
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeats


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _scored(names: list[str]):
    """Rule counts and log perplexity of each text, the columns ``names``; the n-grams of a block come before its texts."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, arrays = None, [], None
        for whole in batches:
            edges = np.flatnonzero(np.diff(named(whole, "block").to_numpy(), prepend=np.nan)).tolist() if whole.num_rows else []
            for start, stop in zip(edges, [*edges[1:], whole.num_rows], strict=True):
                mine = whole.slice(start, stop - start)
                if named(mine, "block")[0].as_py() != block:
                    block, waiting, arrays = named(mine, "block")[0].as_py(), [], None
                n = int((named(mine, "kind").to_numpy() == 0).sum())
                if n:
                    high, low, log_p = (named(mine.slice(0, n), c).to_numpy() for c in ("high", "low", "log_p"))
                    waiting.append((hashes(high, low), log_p))
                if arrays is None and n < mine.num_rows:
                    keys, values = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros(0, np.uint64), np.zeros(0))
                    order = np.argsort(keys)
                    arrays, waiting = (keys[order], values[order]), []
                for batch in blocks(_unpacked(named(mine.slice(n), "packed")), "text"):
                    yield _judged(batch, *arrays).select(names)
            del whole
            give_back()

    return stream


def _judged(batch: pa.RecordBatch, keys: np.ndarray, log_p: np.ndarray) -> pa.RecordBatch:
    total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
    for rows, high, low in text_grams(batch):
        wanted = hashes(high, low)
        if len(wanted):
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            if (keys[place] != wanted).any():
                raise ValueError("a text has changed between counting and scoring")
            total += np.bincount(rows, log_p[place], batch.num_rows)
            size += np.bincount(rows, minlength=batch.num_rows)
    data, offsets = utf8(named(batch, "text"))
    raw = data.tobytes()
    counts = np.array([rule_counts(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    nats = pa.array(-total / np.maximum(size, 1), mask=size == 0)
    return pa.RecordBatch.from_arrays(
        [named(batch, "row"), named(batch, "lang"), *(pa.array(c) for c in counts.T), pa.array(failed), nats, named(batch, "text")],
        names=["row", "lang", *RULES, "base_failed", "nats", "text"],
    )


def score(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """(row, lang, rule counts, base_failed, nats): the columns ``keep`` (all) of each row as one struct, and its log perplexity per code point."""
    text, lang = F.col(text_column), F.coalesce(F.col(lang_column).cast("string"), F.lit(NO_LANGUAGE))
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keep = keep or docs.columns
    beside = [c for c in keep if c != text_column] or keep  # the text travels once
    rows = docs.select(
        F.struct(*beside).alias("row"), lang.alias("lang"), text.alias("text"),
        F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"), F.xxhash64(*hashed).alias("draw"),
    )
    n_blocks = rows.groupBy("lang", "half").agg((F.floor(F.sum(F.octet_length("text")) / BLOCK) + 1).alias("n_blocks"))
    n_blocks = n_blocks.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
    sizes = settle(n_blocks)
    tasks = max(1, sizes.agg(F.sum("n_blocks")).first()[0] or 1)
    block = F.xxhash64("lang", "half", F.pmod("draw", "n_blocks")).alias("block")
    rows = rows.join(sizes, ["lang", "half"]).select("row", "lang", "text", "half", block)

    asked = rows.select("lang", "text", "half", "block").mapInArrow(_packed, "block long, packed binary").repartition(tasks, "block")
    asked = settle(asked.mapInArrow(_requests, "lang string, half int, block long, high long, low long, n long"))
    halves = [F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0)).alias(f"n{h}") for h in (0, 1)]
    fitted = model(settle(asked.groupBy("lang", "high", "low").agg(*halves)))
    other = F.log(F.when(F.col("half") == 0, F.col("p1")).otherwise(F.col("p0"))).alias("log_p")
    answers = asked.join(fitted, ["lang", "high", "low"]).select("block", F.lit(0).alias("kind"), "high", "low", other)
    texts = rows.select("row", "lang", "text", "block").mapInArrow(_packed, "block long, packed binary")
    both = answers.unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    schema = rows.select("row", "lang").schema
    for c in RULES:
        schema = schema.add(c, T.LongType())
    schema = schema.add("base_failed", T.BooleanType()).add("nats", T.DoubleType())
    back = schema if beside == keep else T.StructType([*schema.fields, *rows.select("text").schema.fields])
    scored = both.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(_scored(back.names), back)
    whole = F.struct(*(F.col("text") if c == text_column and beside != keep else F.col("row")[c].alias(c) for c in keep)).alias("row")
    return scored.select(whole, *schema.names[1:])


def judge(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", deviations: float = DEVIATIONS, least: float = LEAST_HALF_WIDTH, keep: list[str] | None = None
) -> DataFrame:
    """(row, rule counts, base_failed, kept, perplexity): the columns ``keep`` (all) of each row as one struct, and its verdict."""
    scored = settle(score(docs, text_column, lang_column, keep))
    inside = F.coalesce(F.col("nats").between(F.col("lowest"), F.col("highest")), F.lit(False))
    judged = scored.join(bands(scored, deviations, least), "lang", "left")
    return judged.select("row", *RULES, "base_failed", (inside & ~F.col("base_failed")).alias("kept"), F.exp("nats").alias("perplexity"))
