"""Secret scan with one deterministic automaton for all rules.

Rule patterns are parsed to byte sets, turned into one non-deterministic automaton,
determinised by subset construction over classes of equal bytes, and minimised into a
transition array.  The automaton reads the text backwards, so after each byte it knows
which rules have a match that starts there: one pass over the bytes serves all rules.
Many stretches of a block are read side by side; they are cut after bytes that bring every
state back to the first one.  Ends come from the small forward automaton of the
rule, run only from starts that were found.

Matches are leftmost and longest and do not overlap within a rule; a match that is too
short still uses up its text.  Spans are in code points, ends exclusive, by start and
then by the order of the rules.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.arrow import blocks, named, utf8


@dataclass(frozen=True)
class Rule:
    """``least``: bytes that a match must have, or must have after its ``head`` if there is one."""

    kind: str
    pattern: str
    least: int = 1
    head: str | None = None


ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: The first three are the base rules; sixteen characters in the pattern of ``hex`` find the same runs as one would.
RULES = (
    Rule("assign", ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", 12, ASSIGN_HEAD),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}", 16),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# ---- patterns: sets of bytes, sequences, choices and repeats


class Pattern:
    """Reads the part of the usual syntax that rules need: sets, groups, (?i: ), |, ?, *, +, {n,}, {n,m} and escapes."""

    def __init__(self, source: str):
        self.source, self.at, self.folded = source, 0, False
        self.tree = self.choice()
        if self.at != len(source):
            raise ValueError(f"{source!r} is not read beyond place {self.at}")

    def peek(self) -> str:
        return self.source[self.at : self.at + 1]

    def take(self, wanted: str = "") -> str:
        c = self.peek()
        if not c or wanted and c != wanted:
            raise ValueError(f"{self.source!r}: {wanted or 'more'} is expected at place {self.at}")
        self.at += 1
        return c

    def choice(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("any", options)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("all", parts)

    def repeated(self, node: tuple) -> tuple:
        c = self.peek()
        if c and c in "?*+":
            self.take()
            return ("repeat", node, int(c == "+"), 1 if c == "?" else None)
        if c == "{":
            close = self.source.index("}", self.at)
            low, comma, high = self.source[self.at + 1 : close].partition(",")
            self.at = close + 1
            return ("repeat", node, int(low), int(high) if high else (None if comma else int(low)))
        return node

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            before = self.folded
            if self.source.startswith("?i:", self.at):
                self.at, self.folded = self.at + 3, True
            node = self.choice()
            self.take(")")
            self.folded = before
            return node
        if c == "[":
            return self.byte_set(self.members())
        return self.byte_set({ord(self.escaped() if c == "\\" else c)})

    def escaped(self) -> str:
        c = self.take()
        if c != "x":
            return c
        self.at += 2
        return chr(int(self.source[self.at - 2 : self.at], 16))

    def members(self) -> set[int]:
        out: set[int] = set()
        while (c := self.take()) != "]":
            low = ord(self.escaped() if c == "\\" else c)
            high = low
            if self.peek() == "-" and self.source[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = ord(self.escaped() if c == "\\" else c)
            out |= set(range(low, high + 1))
        return out

    def byte_set(self, members: set[int]) -> tuple:
        if self.folded:
            members = members | {ord(chr(m).swapcase()) for m in members if chr(m).isascii()}
        return ("set", frozenset(members))


def reverse(node: tuple) -> tuple:
    match node:
        case ("any", options):
            return ("any", [reverse(x) for x in options])
        case ("all", parts):
            return ("all", [reverse(x) for x in parts[::-1]])
        case ("repeat", inner, low, high):
            return ("repeat", reverse(inner), low, high)
    return node


class Fragments:
    """A non-deterministic automaton: free moves and moves by byte set."""

    def __init__(self):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node: tuple, start: int) -> int:
        """The state after ``node``, read from ``start``."""
        match node:
            case ("set", members):
                end = self.state()
                self.moves[start].append((members, end))
                return end
            case ("all", parts):
                for part in parts:
                    start = self.add(part, start)
                return start
            case ("any", options):
                end = self.state()
                for option in options:
                    self.free[self.add(option, start)].append(end)
                return end
            case ("repeat", inner, low, high):
                for _ in range(low):
                    start = self.add(inner, start)
                if high is None:
                    loop, end = self.state(), self.state()
                    self.free[start].append(loop)
                    self.free[self.add(inner, loop)].append(loop)
                    self.free[loop].append(end)
                    return end
                end = self.state()
                for _ in range(high - low):
                    self.free[start].append(end)
                    start = self.add(inner, start)
                self.free[start].append(end)
                return end
        raise ValueError(node)

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``move[state * classes + class of the byte]`` is the next state times ``classes``; ``found[that]``: bits of rules."""

    classes: np.ndarray
    width: int
    move: np.ndarray
    found: np.ndarray

    def resets(self) -> np.ndarray:
        """By byte: does it lead every state to the first one?"""
        back = (self.move.reshape(-1, self.width) == 0).all(axis=0)
        return back[self.classes]


def determinised(trees: list[tuple], anywhere: bool) -> Automaton:
    """Subset construction and minimisation; ``anywhere``: a match may begin after any byte."""
    nfa = Fragments()
    start = nfa.state()
    ends = {nfa.add(tree, start): 1 << k for k, tree in enumerate(trees)}
    sets = sorted({m for moves in nfa.moves for m, _ in moves}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in m for m in sets), len(kinds)) for b in range(256)], np.int32)
    sample = {c: b for b, c in reversed(list(enumerate(classes.tolist())))}
    first = nfa.closure({start})
    known, rows, todo = {first: 0}, [], [first]
    while todo:
        here = todo.pop(0)
        row = []
        for c in range(len(kinds)):
            there = {t for s in here for m, t in nfa.moves[s] if sample[c] in m} | ({start} if anywhere else set())
            there = nfa.closure(there)
            if there not in known:
                known[there] = len(known)
                todo.append(there)
            row.append(known[there])
        rows.append(row)
    move = np.array(rows)
    found = np.array([sum({ends[s] for s in here if s in ends}) for here in known])
    block = np.unique(found, return_inverse=True)[1].reshape(-1)
    while True:  # states stay together as long as all their moves do
        finer = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    _, place = np.unique(block, return_index=True)
    order = np.argsort(place)  # the first state stays first
    rank = np.argsort(order)
    width = len(kinds)
    move = rank[block[move[place[order]]]] * width
    return Automaton(classes, width, move.reshape(-1).astype(np.int32), np.repeat(found[place[order]], width).astype(np.int32))


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    starts: Automaton
    whole: list[Automaton]
    heads: list[Automaton | None]


@cache
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    trees = [Pattern(r.pattern).tree for r in rules]
    return Scanner(
        rules,
        determinised([reverse(t) for t in trees], anywhere=True),
        [determinised([t], anywhere=False) for t in trees],
        [determinised([Pattern(r.head).tree], anywhere=False) if r.head else None for r in rules],
    )


def longest(automaton: Automaton, data: bytes, at: int, stop: int) -> int:
    """End of the longest match that begins at ``at``; a state that leads nowhere ends the search."""
    move, found, classes, width = _plain(automaton)
    state, end = 0, at
    while at < stop:
        state = move[state + classes[data[at]]]
        at += 1
        if found[state]:
            end = at
        elif state in _dead(automaton):
            break
    return end


_plain_parts: dict[int, tuple] = {}
_dead_states: dict[int, frozenset[int]] = {}


def _plain(a: Automaton) -> tuple:
    if id(a) not in _plain_parts:
        _plain_parts[id(a)] = (a.move.tolist(), a.found.tolist(), a.classes.tolist(), a.width)
    return _plain_parts[id(a)]


def _dead(a: Automaton) -> frozenset[int]:
    if id(a) not in _dead_states:
        rows = a.move.reshape(-1, a.width)
        states = np.arange(len(rows)) * a.width
        _dead_states[id(a)] = frozenset(states[(rows == states[:, None]).all(axis=1) & (a.found[states] == 0)].tolist())
    return _dead_states[id(a)]


# ---- scanning

LANES = 4096


def starts_of(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the bits of the rules that have a match beginning there; texts are read from their ends."""
    resets = automaton.resets()
    gap = int(np.flatnonzero(resets)[0])
    n_texts = len(offsets) - 1
    sizes = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(np.arange(1, n_texts + 1), sizes)  # a byte that resets before each text
    spaced = np.full(len(data) + n_texts + 1, gap, np.uint8)
    spaced[place] = data
    cuts = np.flatnonzero(resets[spaced])
    wanted = np.linspace(0, len(spaced), min(LANES, len(cuts)) + 1)[1:-1]
    edges = np.unique(np.concatenate([[0], cuts[np.minimum(np.searchsorted(cuts, wanted), len(cuts) - 1)], [len(spaced)]]))
    first, at = edges[:-1], edges[1:].copy()
    order = np.argsort(first - at, kind="stable")  # long stretches first
    at = at[order]
    lengths = at - first[order]
    ends_at = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), "right")
    classes = automaton.classes[spaced]
    state = np.zeros(len(at), np.int32)
    seen = np.zeros(len(spaced), np.int32)
    for n in ends_at.tolist():
        at[:n] -= 1
        here = at[:n]
        state[:n] = automaton.move[state[:n] + classes[here]]
        seen[here] = state[:n]
    return automaton.found[seen[place]]


def found_in(scanner: Scanner, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Of each text (start, rule number, end) in bytes of the text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    if not len(data):
        return out
    bits = starts_of(scanner.starts, data, offsets)
    raw = data.tobytes()
    some = np.flatnonzero(bits)
    for k, rule in enumerate(scanner.rules):
        starts = some[(bits[some] >> k & 1) == 1]
        doc_of = np.searchsorted(offsets, starts, "right") - 1
        last, i = 0, 0
        while i < len(starts):
            start, doc = int(starts[i]), int(doc_of[i])
            stop = int(offsets[doc + 1])
            last = longest(scanner.whole[k], raw, start, stop)
            begin = longest(scanner.heads[k], raw, start, stop) if scanner.heads[k] else start
            if last - begin >= rule.least:
                out[doc].append((start - int(offsets[doc]), k, last - int(offsets[doc])))
            i = int(np.searchsorted(starts, max(last, start + 1)))
    for spans in out:
        spans.sort()
    return out


def scan(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, spans): each row of ``docs`` as one struct, and array<struct<kind, start, end>> of its secrets."""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = compiled(rules)
        for batch in blocks(batches, "text"):
            data, offsets = utf8(named(batch, "text"))
            found = found_in(scanner, data, offsets)
            spans = []
            for k, mine in enumerate(found):
                if mine:
                    text = data[offsets[k] : offsets[k + 1]]
                    places = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                    mine = [{"kind": rules[r].kind, "start": int(places[a]), "end": int(places[b])} for a, r, b in mine]
                spans.append(mine)
            yield pa.RecordBatch.from_arrays([named(batch, "row"), pa.array(spans, spans_type)], names=["row", "spans"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_column).alias("text"))
    schema = StructType(rows.select("row").schema.fields + StructType.fromDDL("spans array<struct<kind:string,start:long,end:long>>").fields)
    return rows.mapInArrow(stream, schema)
