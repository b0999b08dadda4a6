"""Plain, slow versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    def key(line):
        return line.strip(SPACE).translate(UPPER)

    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc]
        out[doc] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def fingerprint(text: str | None, size: int = 4) -> int:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(fps: dict[int, int], radius: int = 4) -> dict[int, int]:
    by_fp = defaultdict(list)
    for doc, fp in fps.items():
        by_fp[fp].append(doc)
    parent = {fp: fp for fp in by_fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(by_fp)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for fp, docs in by_fp.items():
        least[root(fp)] += docs
    return {doc: min(ds) for ds in least.values() for doc in ds}


def contamination(docs, items, size=10) -> dict[int, tuple[int, int, int, str, bool]]:
    windows = defaultdict(set)
    for item, text in items:
        words = BENCH_WORD.findall((text or "").translate(UPPER))
        n = min(size, len(words))
        for k in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[k : k + n])].add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words = BENCH_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        out[doc] = (len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit))
    return out


ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = Counter(k for k, _, _ in spans)
    order = ("assign", "access", "hex")
    spans.sort(key=lambda s: (s[1], order.index(s[0])))
    return kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            marked.update((k, k + 1, k + 2))
    n = len(words)
    return n, sum(map(len, words)), symbols, repeats, len(marked), n < 50 or 100 * len(marked) > 50 * n
