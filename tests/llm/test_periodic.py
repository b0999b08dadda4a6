"""Runs against a search of all periods, and the transform against plain sums."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import periodic, queries


def plain_runs(words):
    """Every maximal stretch for every period, smallest periods only."""
    n, runs, taken = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and (i, j + q) not in taken:
                taken.add((i, j + q))
                runs.append((i, j + q - i, q))
            i = j
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def runs_of(texts, monkeypatch=None):
    words, numbers, starts = periodic.word_numbers(pa.array(texts, pa.string()))
    line, firsts = periodic.separated(numbers, starts, len(words))
    out = [[] for _ in texts]
    for s, e, q in periodic.find(line, int(np.diff(starts).max(initial=0))).tolist():
        d = int(np.searchsorted(firsts, s, "right")) - 1
        out[d].append((s - int(firsts[d]), e - s, q))
    return out


def made_texts(seed, count=60):
    draw = random.Random(seed)
    texts = []
    for _ in range(count):
        words = []
        while len(words) < draw.choice([0, 5, 40, 200, 600]):
            q = draw.choice([1, 1, 2, 3, 5, 8, 13, 21, 40])
            unit = [f"w{draw.randrange(draw.choice([2, 3, 1000]))}" for _ in range(q)]
            words += (unit * 9)[: draw.randrange(1, 8 * q + 2)]
        texts.append("  ".join(words))
    return texts


@pytest.mark.parametrize("n", [2, 8, 64, 128, 1024, 8192])
def test_transform_is_exact(n):
    rng = np.random.default_rng(n)
    b = n // 2
    short, long = rng.integers(0, periodic.PRIME, (3, b)), rng.integers(0, periodic.PRIME, (3, n))
    long[1, : b] = short[1]
    got = periodic.squared_differences(short.astype(float), long.astype(float))
    for r in range(3):
        for o in {0, 1 % b, b - 1}:
            want = sum((int(x) - int(y)) ** 2 for x, y in zip(short[r], long[r, o : o + b], strict=True)) % periodic.PRIME
            assert got[r, o] == want
    assert got[1, 0] == 0


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("block", [4, 4096])
def test_all_runs_are_found(seed, block, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", block)
    texts = made_texts(seed)
    assert runs_of(texts) == [plain_runs(t.split()) for t in texts]


@pytest.mark.parametrize(
    "text",
    ["a " * 3000, "a b " * 1500, ("a " * 500 + "b ") * 9, ("a " * 300 + "b ") * 3 + "a " * 700, " ".join("ab"[bin(k).count("1") % 2] for k in range(4096)),
     " ".join(f"u{k}" for k in range(700)) * 1 + " " + (" ".join(f"v{k}" for k in range(701)) + " ") * 5],
)
def test_texts_that_repeat_throughout(text):
    assert runs_of(["x y", text, "z " * 6]) == [[], plain_runs(text.split()), [(0, 6, 1)]]


def test_long_periods():
    """Periods far above a block, and a text that is one repeated passage of 30,000 words."""
    unit = " ".join(f"w{k * k % 29989}x{k}" for k in range(30_000))
    assert runs_of([" ".join([unit] * 4), " ".join([unit] * 4 + ["end"])])[0] == [(0, 120_000, 30_000)]
    assert runs_of(["s " + " ".join([unit] * 5)]) == [[(1, 150_000, 30_000)]]


def test_query(spark, sf, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    found = 0
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        found += len(runs)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        r = got[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (None if best[0] is None else 1000 * best[1] // best[2])
        assert (r["runs_sha256"], r["collapsed_sha256"]) == (digest(text), digest(plain_collapse(words, runs)))
    assert found > 10


def test_odd_rows(spark, odd, empty):
    got = periodic.find_runs(odd).select("row.doc_id", F.col("n_words").alias("n"), "runs", "collapsed")
    rows = got.collect()
    assert len(rows) == odd.count() and periodic.find_runs(empty).count() == 0
    by_id = {r["doc_id"]: r for r in rows}
    assert [by_id[k]["n"] for k in (0, 1, 2, 3)] == [0, 0, 0, 1] and [by_id[k]["collapsed"] for k in (0, 1, 2)] == ["", "", ""]
    assert by_id[10]["n"] == 40_000 and by_id[10]["runs"] == []
    assert [tuple(x) for x in by_id[11]["runs"]] == [(1, 2000, 1)] and by_id[11]["collapsed"].endswith(" 日本語")
