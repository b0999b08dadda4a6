"""The trie against one kept in dictionaries, at heights that make many bands."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plumbline.llm import prefix_trie, queries

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(conversations):
    """``conversations``: id -> list of (role, text)."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        own = (len(members[p]) - 1) * len(p[-1][1].split()) if p else 0
        saved[p] = own + sum(saved[q] for q in below)
        leaves[p] = sum(leaves[q] for q in below) if below else 1
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(conversations[c]) == len(p)))
        parent = min(members[p[:-1]]) if p else None
        rows.append((min(m), len(p), parent, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def built(spark, conversations, height):
    rows = [(c, d, role, text) for c, turns in conversations.items() for d, (role, text) in enumerate(turns, 1)]
    turns = prefix_trie.digested(spark.createDataFrame(rows, "conv_id long, pos long, role string, text string"))
    ids = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
    return sorted((tuple(r[f] for f in FIELDS) for r in prefix_trie.build(turns, ids, height).collect()), key=str)


def made(seed, count=60, longest=30):
    draw = random.Random(seed)
    out = {}
    for _ in range(count):
        turns = list(draw.choice(list(out.values()) or [[]]))[: draw.randrange(longest)]
        turns += [("user", " ".join("x" * draw.randrange(1, 3) for _ in range(draw.randrange(4)))) for _ in range(draw.randrange(5))]
        out[draw.randrange(-10_000, 10_000)] = turns[:longest]
    return out


@pytest.mark.parametrize("height", [2, 3, 16])
def test_equals_plain_trie(spark, height, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEAVY", 3)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 50)
    conversations = made(height)
    conversations |= {20_001 + k: [] for k in range(120)}
    assert built(spark, conversations, height) == plain(conversations)


def test_one_very_long_conversation(spark):
    long = [("user", f"w{k} w") for k in range(500)]
    conversations = {5: long, 7: long[:400] + [("user", "other")], 9: long[:401]}
    assert built(spark, conversations, 4) == plain(conversations)


def test_role_and_text_do_not_run_together(spark):
    conversations = {1: [("a", "b c")], 2: [("a b", "c")], 3: [("", "ab c")], 4: [("a", "b c"), ("", "")], 5: [("a", "b c"), ("", ""), ("", "")]}
    assert built(spark, conversations, 2) == plain(conversations)


def reopened_plain(rows):
    by_id = {}
    for c, turn, role, text in rows:
        if c is not None:
            by_id.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in by_id.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    family = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    return {c: own.get(family(c), [])[: h(c)] + own[c][h(c) :] for c in own}


def odd_rows():
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, None, "user", "late null"), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 5, None, "z")]
    rows += [(0, k, "user", f"shared {k % 2}") for k in range(6)] + [(40, k, "user", "w " * k) for k in range(2)]
    rows += [(c, k, "user", f"t{k} {c % 3}") for c in list(range(2, 30)) + [-3, -25, 41, 59] for k in range(c % 7)]
    return rows


def test_families_nulls_and_ties(spark, monkeypatch):
    monkeypatch.setattr(queries, "TURNS", 3)
    rows = [(*r, "clash", 1) for r in odd_rows()]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string, node int")
    turns, ids = queries.reopened(table)
    got = sorted((tuple(r[f] for f in FIELDS) for r in prefix_trie.build(turns, ids).collect()), key=str)
    assert got == plain(reopened_plain(odd_rows()))
    assert prefix_trie.build(*queries.reopened(table.where(F.lit(False)))).count() == 0


def test_query(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = sorted((tuple(r[f] for f in FIELDS) for r in queries.QUERIES["op12_prefix_trie"](spark, sf).collect()), key=str)
    assert got == plain(reopened_plain(rows))
