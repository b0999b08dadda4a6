"""Language identification by cross-parsing.

For each language a suffix automaton of sampled labelled text is built.  A text is cut
greedily into the longest phrases that occur in the reference of a language; the language
that needs fewest phrases per byte wins.  References have the same bounded size, so phrase counts
are comparable.  Texts are lower-cased UTF-8 letters with one space between words; a byte that a
reference lacks is a phrase with what follows it.  Phrases do not cross the edges of
pieces of ``PIECE`` bytes, which lets all pieces of a block be parsed side by side; every byte of the text is parsed.

The sample: distinct texts, longer ones in pieces of ``TAUGHT`` code points, in the order of a seeded draw,
until ``REFERENCE`` bytes per language; the chance of a piece follows from the distinct bytes of its language.
Every label is learned.  Languages are taken in blocks of ``LANGUAGES``: one pass over the texts per block
carries on the best two rates, so a Python worker holds the automata of one block only.

Defined results: a text that is null or has no letter, or no learned language: ``und`` and 0.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.settle import settle
from plumbline.llm.arrow import blocks, named

REFERENCE = 65_536
LANGUAGES = 64
#: Code points of a piece that teaches.
TAUGHT = 8_192
PIECE = 1024
UNKNOWN = "und"

_between = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased words with one space before, between and after; empty without a letter."""
    words = _between.sub(" ", (text or "").lower()).strip()
    return f" {words} ".encode() if words else b""


# ---- suffix automaton


class Reference:
    """The automaton of one language as a table of moves; 2 x next state + 1 if a new phrase begins there."""

    def __init__(self, texts: list[bytes], most: int = REFERENCE):
        data = b"\n".join(texts)[:most]
        moves, link, length = [{}], [-1], [0]
        last = 0
        for byte in data:
            here = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and byte not in moves[p]:
                moves[p][byte] = here
                p = link[p]
            if p >= 0:
                q = moves[p][byte]
                if length[p] + 1 == length[q]:
                    link[here] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(byte) == q:
                        moves[p][byte] = twin
                        p = link[p]
                    link[q] = link[here] = twin
            last = here
        used = sorted(set(data) - {10})
        self.classes = np.full(256, len(used), np.int32)  # the last class: bytes that the reference lacks
        self.classes[used] = np.arange(len(used))
        self.width = len(used) + 1
        again = np.zeros(self.width, np.int32)
        for k, byte in enumerate(used):
            again[k] = moves[0][byte] * self.width
        table = np.tile(again * 2 + 1, (len(moves), 1))
        state = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        byte = np.fromiter((b for m in moves for b in m), np.int64, len(state))
        there = np.fromiter((t for m in moves for t in m.values()), np.int64, len(state))
        real = byte != 10
        table[state[real], self.classes[byte[real]]] = there[real] * self.width * 2
        self.table = table.reshape(-1).astype(np.int32)

    def phrases(self, data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each piece; the pieces come longest first."""
        state, count = np.zeros(len(first), np.int32), np.ones(len(first), np.int32)
        classes = self.classes[data]
        running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
        for t, n in enumerate(running.tolist()):
            moved = self.table[state[:n] + classes[first[:n] + t]]
            count[:n] += moved & 1
            state[:n] = moved >> 1
        return count


#: Automata of the last fit that this worker has seen.
_built: dict[str, list[tuple[str, Reference]]] = {}


def references(name: str, sample: dict[str, list[bytes]]) -> list[tuple[str, Reference]]:
    if name not in _built:
        _built.clear()
        _built[name] = [(lang, Reference(texts)) for lang, texts in sorted(sample.items())]
    return _built[name]


def rates(found: list[tuple[str, Reference]], texts: list[bytes]) -> np.ndarray:
    """(texts, languages): phrases per byte; nan for an empty text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    pieces = -(-sizes // PIECE)
    doc = np.repeat(np.arange(len(texts)), pieces)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(np.cumsum(sizes) - sizes, pieces) + inside * PIECE
    length = np.minimum(PIECE, np.repeat(sizes, pieces) - inside * PIECE)
    order = np.argsort(-length, kind="stable")
    out = np.full((len(texts), len(found)), np.nan)
    there = sizes > 0
    for k, (_, reference) in enumerate(found):
        if len(order):
            counts = np.bincount(doc[order], reference.phrases(data, first[order], length[order]), minlength=len(texts))
            out[there, k] = counts[there] / sizes[there]
    return out


# ---- jobs


def held_out(id_column: Column, folds: int = 5) -> Column:
    """One fold of the ids, by their CRC-32; a null id reads as an empty one."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == 0


def taught_pieces(labelled: DataFrame, reference: int, seed: int) -> DataFrame:
    """(lang, draw, text) of about 4 x ``reference`` bytes of distinct texts per language, cut into pieces."""
    rows = labelled.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    rows = rows.select("lang", "text", F.octet_length("text").cast("long").alias("bytes"), F.xxhash64(F.lit(seed), "text").alias("name"))
    totals = settle(rows.select("lang", "name", "bytes").distinct().groupBy("lang").agg((4.0 * reference / F.sum("bytes")).alias("rate")))
    chance = lambda k: F.shiftrightunsigned(F.xxhash64("name", k), 11).cast("double") * F.lit(2.0**-53)
    pieces = F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / TAUGHT).cast("int"))
    drawn = rows.join(totals, "lang").select("*", F.filter(pieces, lambda k: chance(k) < F.col("rate")).alias("pieces"))
    drawn = drawn.select("lang", "name", "text", F.explode("pieces").alias("k"))
    text = F.substring(F.col("text"), F.col("k") * TAUGHT + 1, F.lit(TAUGHT))
    return drawn.select("lang", F.xxhash64("name", "k").alias("draw"), text.alias("text")).distinct()


def sample_texts(labelled: DataFrame, reference: int = REFERENCE, seed: int = 5) -> dict[str, list[bytes]]:
    """Letters of the sampled texts by language, from a table (lang, text)."""
    out: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for r in taught_pieces(labelled, reference, seed).orderBy("draw", "text", "lang").toLocalIterator():  # what is kept: ``reference`` bytes a language and one piece
        text = letters(r["text"])
        if text and held.get(r["lang"], 0) < reference:
            out.setdefault(r["lang"], []).append(text)
            held[r["lang"]] = held.get(r["lang"], 0) + len(text)
    return out


def _parsed(name: str, sample: dict[str, list[bytes]]):
    """The best two rates of each text so far, and the language of the best; ties go to the name that sorts first."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = references(name, sample)
        names = np.array([lang for lang, _ in found], object)
        for batch in blocks(batches, "text"):
            texts = [letters(t) for t in named(batch, "text").to_pylist()]
            r = rates(found, texts)
            there = ~np.isnan(r[:, 0])
            best, lowest, second = (named(batch, c).to_numpy(zero_copy_only=False).copy() for c in ("best", "lowest", "second"))
            all_rates = np.column_stack([lowest, second, np.where(there[:, None], r, np.inf)])
            better = there & (all_rates[:, 2:].min(axis=1) < lowest)
            best[better] = names[np.argmin(all_rates[better, 2:], axis=1)]
            ranked = np.sort(all_rates, axis=1)
            yield pa.RecordBatch.from_arrays(
                [named(batch, "row"), named(batch, "text"), pa.array(best, pa.string()), pa.array(ranked[:, 0]), pa.array(ranked[:, 1])], names=["row", "text", "best", "lowest", "second"]
            )

    return stream


def predict(docs: DataFrame, sample: dict[str, list[bytes]], text_column: str = "text", at_once: int = LANGUAGES) -> DataFrame:
    """(row, lang_pred, score): score is the share of phrases that the second-best language needs more."""
    name, langs = uuid.uuid4().hex, sorted(sample)
    unknown = (F.lit(v).alias(c) for c, v in (("best", UNKNOWN), ("lowest", float("inf")), ("second", float("inf"))))
    told = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_column).cast("string").alias("text"), *unknown)
    schema = StructType(told.select("row").schema.fields + StructType.fromDDL("text string, best string, lowest double, second double").fields)
    for k in range(0, len(langs), at_once):
        told = told.mapInArrow(_parsed(f"{name}-{k}", {lang: sample[lang] for lang in langs[k : k + at_once]}), schema)
    inf = F.lit(float("inf"))
    score = F.when(F.col("lowest") == inf, 0.0).when(F.col("second") == inf, 1.0).otherwise(1 - F.col("lowest") / F.col("second"))
    return told.select("row", F.col("best").alias("lang_pred"), score.alias("score"))
