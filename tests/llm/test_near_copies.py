"""Near copies against all pairs of five-word shingle sets."""

import random
from itertools import combinations

import brute
import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import near_copies, simhash


def shingles(text):
    words = brute.WORD.findall((text or "").translate(brute.UPPER))
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def firsts(docs):
    """The smallest id of every group, and the number of links between unequal sets."""
    sets, parent, found = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}, 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            found += sets[a] != sets[b]
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {root(d) for d in sets}, found


@pytest.fixture(scope="module")
def made():
    rng, texts = random.Random(5), [None, "", " \t", "one two", "One  two", "one two three"]
    for _ in range(25):
        words = [f"w{rng.randrange(3_000)}" for _ in range(rng.randint(20, 300))]
        texts.append(" ".join(words))
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = "other"
            texts.append(" ".join(copy if rng.random() < 0.7 else copy[: len(copy) * 9 // 10]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("tile_shingles", [near_copies.TILE_SHINGLES, 300])
def test_every_similar_pair_is_linked_and_no_other(spark, made, tile_shingles):
    want, found = firsts(made)
    assert found > 50
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.representatives(docs, tile_shingles=tile_shingles).collect()} == want


def test_stage_links_at_the_similarity(spark, sf, made):
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, docs, sf).collect()} == firsts(made)[0]


def test_candidates_are_close_fingerprints(spark, made):
    """Bits of similar sets differ as their angle says, and tables keep the promised miss."""
    rng, far = np.random.default_rng(1), []
    for _ in range(200):
        drawn = rng.integers(0, 2**63, 110, dtype=np.uint64)
        a, b = near_copies.fingerprint(drawn[:99]), near_copies.fingerprint(drawn[11:])
        far.append((np.unpackbits(a[:16]) != np.unpackbits(b[:16])).sum())
    assert 15 < np.mean(far) < 24 and max(far) <= near_copies.RADIUS
    for n in (1, 10**5, 10**8):
        drawn = near_copies.tables(n)
        assert (1 - 0.848 ** drawn.shape[1]) ** len(drawn) < 1.2 * near_copies.MISS
    texts = spark.createDataFrame(made, "node long, text string")
    root = {r["node"]: r["root"] for r in near_copies.candidates(texts).collect()}
    sets = {d: shingles(t) for d, t in made}
    for a, b in combinations(sets, 2):
        overlap = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert overlap < 0.8 or root[a] == root[b]
        assert overlap > 0.0 or a not in root or root[a] != root.get(b)


@pytest.mark.parametrize("copies", [150, 300])
def test_groups_are_formed_from_few_links_per_text(spark, monkeypatch, copies):
    """Near copies meet in many tables and tiles; the joins that form groups do not see each meeting."""
    rng, seen = random.Random(6), []
    words = [f"w{rng.randrange(3_000)}" for _ in range(200)]
    docs = [(d, " ".join([*words[: (at := rng.randrange(200))], f"other{d}", *words[at + 1 :]])) for d in range(copies)]
    docs += [(copies + d, " ".join(f"w{rng.randrange(3_000)}" for _ in range(50))) for d in range(20)]
    components = near_copies.components

    def counted(links):
        seen.append(links.count())
        return components(links)

    monkeypatch.setattr(near_copies, "components", counted)
    got = near_copies.representatives(spark.createDataFrame(docs, "doc_id long, text string"), tile_shingles=10_000).collect()
    assert {r["doc_id"] for r in got} == firsts(docs)[0] == {0, *range(copies, copies + 20)}
    assert len(seen) == 2 and max(seen) <= 2 * copies


def test_folded_links_keep_groups(spark):
    rng = random.Random(7)
    pairs = [(u, v) for u, v in ((rng.randrange(300), rng.randrange(300)) for _ in range(200)) if u > v]
    links = spark.createDataFrame(pairs, "u long, v long")
    few = simhash.folded(links).collect()
    assert all(r["u"] > r["v"] for r in few)
    want, got = ({r["node"]: r["root"] for r in simhash.components(x).collect()} for x in (links, spark.createDataFrame(few)))
    assert want == got


@pytest.mark.parametrize("tile_rows", [20_000, 7])
def test_stars_connect_what_close_fingerprints_connect(spark, tile_rows):
    rng = random.Random(8)
    base = [rng.getrandbits(62) for _ in range(40)]
    fps = list({b ^ sum(1 << x for x in rng.sample(range(62), rng.randint(0, 6))) for b in base for _ in range(6)})
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    pairs, stars = (simhash.edges(table, 4, tile_rows, stars=s) for s in (False, True))
    want, got = ({r["node"]: r["root"] for r in simhash.components(x).collect()} for x in (pairs, simhash.folded(stars)))
    assert len(set(want.values())) > 20 and want == got
