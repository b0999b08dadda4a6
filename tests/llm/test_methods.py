"""The parts of the methods against plain versions on random input."""

import math
import random
import re
from collections import Counter
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat, fm_index, html_text, language_id, packing, perplexity, ranks, secrets, shards, simhash
from plumbline.llm.arrow import utf8, words_of

# ---- secrets


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="pPasSwordTOKENtoken:= \"'_-.abc019fAKIZ\n,é", max_size=60), max_size=6))
def test_automaton_finds_what_expressions_find(texts):
    rules = (
        secrets.Rule("assign", secrets.ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]+", 2, secrets.ASSIGN_HEAD),
        secrets.Rule("access", "AKI[A-Z0-9]+", 5),
        secrets.Rule("hex", "[0-9a-f]{3,}", 3),
    )
    got = secrets.found_in(secrets.compiled(rules), *utf8(pa.array(texts, pa.string())))
    for text, spans in zip(texts, got, strict=True):
        raw = text.encode()
        want = [(m.start(), 0, m.end()) for m in re.finditer(rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", raw) if len(m[1]) >= 2]
        want += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKI[A-Z0-9]+", raw) if len(m[0]) >= 5]
        want += [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]{3,}", raw)]
        assert spans == sorted(want)


def test_automaton_is_small_and_reads_many_stretches():
    scanner = secrets.compiled(secrets.RULES)
    assert len(scanner.starts.found) // scanner.starts.width < 2_000
    text = ",".join(["plain words"] * 5_000 + ["token: abcdefghijklmnop"])
    assert secrets.found_in(scanner, *utf8(pa.array([text, None, ""], pa.string()))) == [[(len(text) - 23, 0, len(text))], [], []]


# ---- html


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a &lt; b &amp c &am", "a < b & c &am"),
        ("<article><p>a<div class='ad'>buy</div><p>b<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\nb\nx\ny\n1\n2\n3"),
        ("<main><article><h1>T</h1><p>Body <b>te</b>xt</p></article><section class='comments'><article><p>" + "bla " * 300 + "</article></section></main>", "T\nBody text"),
        ("<body><div id=content><h2>T</h2><p>Some long paragraph of text, with words.</p><p>Another one.</p></div><div class=sidebar><a href=x>link</a></div></body>", "T\nSome long paragraph of text, with words.\nAnother one."),
        ("<article><p>x</p><script>var a='</p>';</script><style>p{}</style><form>name</form><!-- <p>no</p> --><p>y<br>z</p>", "x\ny z"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_pages_do_not_recurse():
    assert html_text.main_text("<div>" * 5_000 + "deep" + "</div>" * 5_000) == "deep"


# ---- sharding


def test_hypergeometric_draws_follow_the_law(spark):
    total, good, draws = 40, 15, 12
    made = spark.range(20_000).select(
        shards.hypergeometric(*(F.lit(x).cast("long") for x in (total, good, draws)), shards.uniform(F.lit(3), "id")).alias("k")
    )
    counts = {r["k"]: r["count"] for r in made.groupBy("k").count().collect()}
    chi = 0.0
    for k in range(13):
        p = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws)
        if p * 20_000 > 5:
            chi += (counts.get(k, 0) - p * 20_000) ** 2 / (p * 20_000)
    assert sum(counts.values()) == 20_000 and chi < 35


def test_matrix_has_exact_margins(spark):
    n = [5, 0, 700, 31, 90_000, 12, 1, 64]
    leaves = spark.createDataFrame(list(enumerate(n)), "part long, n long")
    total = sum(n)
    sizes = [total // 3 + (s < total % 3) for s in range(3)]
    rows = {r["part"]: r["sends"] for r in shards.communication_matrix(leaves, 3, sizes, 1).collect()}
    assert [sum(rows[p]) for p in range(8)] == n and [sum(c) for c in zip(*rows.values(), strict=True)] == sizes
    assert all(x >= 0 for r in rows.values() for x in r)


def test_many_partitions_and_cuts(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.ranks.BUCKET_ROWS", 7)
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 5)).alias("text"))
    got = shards.shuffle(docs, shards=4, part_rows=10).collect()
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(125))
    assert len({r["doc_id"] for r in got}) == 500


def test_equal_rows_are_dealt_like_different_ones(spark):
    docs = spark.range(3_000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    numbered = ranks.copies(docs, ["doc_id", "text"])
    assert sorted(r["copy"] for r in numbered.collect()) == list(range(3_000))
    got = shards.shuffle(docs, shards=4, part_rows=50).collect()
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(750))
    packed = packing.pack(docs, budget=50).collect()
    assert len(packed) == 3_000 and len({(r["batch_id"], r["slot"]) for r in packed}) == 3_000


# ---- language


def naive_phrases(text: bytes, reference: bytes) -> int:
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in reference:
            n += 1
        count += 1
        at += max(1, n - 1)
    return count


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab ", min_size=1, max_size=80), st.lists(st.text(alphabet="ab ", min_size=1, max_size=60), min_size=1, max_size=4))
def test_phrases_are_longest_matches(reference, texts):
    reference = reference.encode() + b"ab "
    texts = [t.encode() for t in texts]
    got = language_id.rates([("x", language_id.Reference([reference]))], texts)[:, 0]
    assert [round(g * len(t)) for g, t in zip(got, texts, strict=True)] == [naive_phrases(t, reference) for t in texts]


def test_every_label_is_learned_also_from_long_texts_and_copies(spark):
    rng = random.Random(3)
    made = {}
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(30)]
        word = lambda: "".join(rng.choice(letters) for _ in range(3))  # noqa: E731, B023
        made[f"l{k:02}"] = " ".join(word() for _ in range(30_000 if k < 3 else 100))
    rows = [(k, lang, text) for k, (lang, text) in enumerate(made.items())] + [(100 + k, "l05", made["l05"]) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    sample = language_id.sample_texts(docs)
    assert set(sample) == set(made) and len(b"".join(sample["l00"])) >= 60_000
    told = language_id.predict(docs.where("doc_id >= 3"), sample).collect()
    assert all(r["lang_pred"] == r["row"]["lang"] and r["score"] > 0.3 for r in told)


@pytest.mark.parametrize("at_once", [1, 2, 64])
def test_prediction_is_the_least_phrases(spark, at_once):
    sample = {"a": [b" abab baba abba ", b"cyz"], "b": [b" abc cab bca ", b"yz"], "c": [b" zz yy abab ", b"c"]}
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcyz  ") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + [None, "", "12", "abab" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in language_id.predict(docs, sample, at_once=at_once).collect():
        text = language_id.letters(r["row"]["text"])
        cut = [text[k : k + language_id.PIECE] for k in range(0, len(text), language_id.PIECE)]
        need = sorted((sum(naive_phrases(c, b"\n".join(ref)) for c in cut), lang) for lang, ref in sample.items())
        if text:
            assert r["lang_pred"] == need[0][1] and r["score"] == pytest.approx(1 - need[0][0] / need[1][0])
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_letters():
    assert language_id.letters("A1, b\n_É") == " a b é ".encode()
    assert language_id.letters(None) == language_id.letters("12 ,") == b""


# ---- perplexity


TEXTS = [("en", "the cat sat on the mat. The dog sat."), ("en", "a cat and a dog sat on a mat"), ("en", "the dog"), ("el", "η γάτα"), ("el", "ο σκύλος 𝄞"), (None, "xyz"), ("en", ""), ("en", None)]


def kneser_ney(texts: list[str], alphabet: int) -> Callable[[str], float]:
    """Interpolated modified Kneser-Ney over strings of five characters, \x00 before a text, straight from the definition."""
    order, counts = perplexity.ORDER, {}
    counts[order] = Counter(("\x00" * (order - 1) + t)[k : k + order] for t in texts for k in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k: int, n: int) -> float:
        t = [sum(c == j for c in counts[k].values()) for j in range(5)]
        n = min(n, 3)
        if t[1] + 2 * t[2] and t[n]:
            d = n - (n + 1) * t[1] / (t[1] + 2 * t[2]) * t[n + 1] / t[n]
            if 0 < d < n:
                return d
        return n / 2

    def probability(gram: str) -> float:
        if not gram:
            return 1 / alphabet
        k = len(gram)
        follow = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not follow:
            return probability(gram[1:])
        own = follow.get(gram, 0)
        left = sum(discount(k, c) for c in follow.values())
        return (own - (discount(k, own) if own else 0) + left * probability(gram[1:])) / sum(follow.values())

    return probability


def test_perplexity_equals_the_definition(spark):
    docs = spark.createDataFrame([(k, *row) for k, row in enumerate(TEXTS)], "doc_id long, lang string, text string")
    half = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2))).collect()}
    assert len({h for k, h in half.items() if TEXTS[k][0] == "en" and TEXTS[k][1]}) == 2
    for r in perplexity.score(docs).collect():
        lang, text = r["row"]["lang"], r["row"]["text"]
        if not text:
            assert r["nats"] is None
            continue
        mine = [(k, t) for k, (x, t) in enumerate(TEXTS) if x == lang and t]
        chance = kneser_ney([t for k, t in mine if half[k] != half[r["row"]["doc_id"]]], len({c for _, t in mine for c in t}))
        padded = "\x00" * (perplexity.ORDER - 1) + text
        nats = [-math.log(chance(padded[k : k + perplexity.ORDER])) for k in range(len(text))]
        assert r["nats"] == pytest.approx(sum(nats) / len(nats))


def test_junk_in_any_script_is_outside_the_band(spark):
    rng, rows = random.Random(5), []
    for lang, first in (("ru", 0x430), ("zh", 0x4E00)):
        words = ["".join(chr(first + rng.randrange(32)) for _ in range(rng.randint(2, 6))) for _ in range(200)]
        rows += [(lang, " ".join(rng.choices(words, k=120)), True) for _ in range(60)]
        rows += [(lang, " ".join("".join(chr(first + rng.randrange(32)) for _ in range(5)) for _ in range(120)), False) for _ in range(3)]
    docs = spark.createDataFrame(rows, "lang string, text string, fine boolean")
    for r in perplexity.judge(docs).collect():
        assert not r["base_failed"]
        assert r["kept"] == r["row"]["fine"]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "aé€𝄞 bc" * 50
    batch = pa.record_batch({"text": [text]})
    ((_, high, low),) = perplexity.text_grams(batch)
    monkeypatch.setattr(perplexity, "PIECE", 37)
    pieces = list(perplexity.text_grams(batch))
    assert len(pieces) > 5
    assert np.array_equal(np.concatenate([p[1] for p in pieces]), high)
    assert np.array_equal(np.concatenate([p[2] for p in pieces]), low)


def test_rows_travel_compressed_by_block():
    texts = [f"the same few words of text number {k} again and again. " * 30 if k % 7 else None for k in range(400)]
    rows = pa.record_batch({"row": [{"doc_id": k} for k in range(400)], "text": texts, "block": pa.array([k % 3 for k in range(400)], pa.int64())})
    (sent,) = perplexity._packed(iter([rows.slice(0, 150), rows.slice(0, 0), rows.slice(150)]))
    assert sorted(sent["block"].to_pylist()) == [0, 1, 2]
    assert 3 * sent.nbytes < rows.nbytes
    back = [r for batch in perplexity._unpacked(sent["packed"]) for r in batch.to_pylist()]
    assert sorted(back, key=lambda r: r["row"]["doc_id"]) == rows.to_pylist()
    assert list(perplexity._packed(iter([rows.slice(0, 0)]))) == []


def test_text_in_the_row_is_put_back_where_it_was(spark):
    docs = spark.createDataFrame([("a b", 1), (None, 2)], "text string, doc_id long").withColumn("lang", F.lit("en"))
    for keep, want in ((None, [("a b", 1, "en"), (None, 2, "en")]), (["text"], [("a b",), (None,)]), (["doc_id", "text"], [(1, "a b"), (2, None)])):
        found = perplexity.score(docs, keep=keep).select("row.*")
        assert found.columns == (keep or docs.columns)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_grams_start_anew_in_each_text():
    ((rows, high, low),) = perplexity.text_grams(pa.record_batch({"text": ["ab", None, "é", ""]}))
    a, b, e = (ord(c) + 1 for c in "abé")
    assert rows.tolist() == [0, 0, 2]
    assert high.tolist() == [0, 0, 0]
    assert low.tolist() == [a, a << 21 | b, e]


# ---- simhash


def test_carry_save_counts_bits():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 200, dtype=np.uint64)
    planes = simhash.bit_planes(fps, 0)
    for radius in (20, 31, 40, 64):
        lanes = np.unpackbits(simhash.at_most(simhash.carry_save([planes]), radius).view(np.uint8), bitorder="little")[:200]
        assert (lanes == (np.bitwise_count(fps) <= radius)).all()


def near(rng, n):
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = set(base)
    while len(out) < n:
        out.add(rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    return [x - (1 << 64) if x >> 63 else x for x in out]


@pytest.mark.parametrize("tile_rows", [20_000, 3])
def test_no_close_pair_is_lost(spark, tile_rows):
    fps = near(random.Random(4), 240)
    links = simhash.edges(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, tile_rows).collect()
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert ((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 4
        parent[root(r["u"])] = root(r["v"])
    close = [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert close and all(root(a) == root(b) for a, b in close)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(-5, 200), (200, 300)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and all(got[k] == 100 for k in range(101, 130)) and got[300] == got[200] == -5


def test_words_of_pieces():
    raw = b"  one two\x0bthree " + b"x" * 50 + b" four"
    assert [w for ws in words_of(raw, 7) for w in ws] == raw.split()


# ---- FM-index


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(1, 4))
def test_backward_search_finds_and_locates(runs, size):
    text = np.array([0] + [x for r in runs for x in [*r, 0]], np.int64)
    index = fm_index.FMIndex(text, 5, every=3)
    patterns = np.array(np.meshgrid(*[np.arange(1, 6)] * size)).reshape(size, -1).T
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [k for k in range(len(text) - size + 1) if (text[k : k + size] == p).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    symbols = rng.integers(0, 11, 500)
    matrix = fm_index.WaveletMatrix(symbols, 4)
    at = rng.integers(0, 501, 300)
    wanted = rng.integers(0, 11, 300)
    assert matrix.rank(wanted, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(wanted, at, strict=True)]
    assert (matrix.symbol(np.arange(500)) == symbols).all()


def test_blocks_of_items_give_what_one_block_gives(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    once = fm_index.decontaminate(docs, items).drop("text", "row").collect()
    split = fm_index.decontaminate(docs, items, most=2_500).drop("text", "row").collect()
    assert once == split and any(r["hits"] for r in once)


# ---- packing


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12), st.integers(1, 4))
def test_boundaries_are_optimal(lengths, buckets):
    counts = Counter(lengths)
    cells = sorted(counts)
    edges, padding = packing.best_boundaries(np.array(cells), np.array([counts[c] for c in cells]), buckets)

    def cost(chosen):
        return sum(min(e for e in chosen if e >= x) - x for x in lengths)

    best = min(cost([*c, cells[-1]]) for k in range(min(buckets, len(cells))) for c in combinations(cells[:-1], k))
    assert padding == best == cost(edges) and len(edges) <= buckets


@pytest.mark.parametrize("buckets", [1, 2, 7, 32])
def test_boundaries_of_long_lengths_are_optimal(buckets):
    """Lengths far above 512, against a plain table of all cuts."""
    rng = np.random.default_rng(buckets)
    lengths = np.unique(np.concatenate([rng.integers(1, 800, 150), rng.lognormal(8, 1, 250).astype(int) + 500]))
    counts = rng.integers(1, 40, len(lengths))
    rows, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = [0] + [1 << 60] * len(lengths)
    for _ in range(buckets):
        best = [0] + [min(best[i] + int(lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])) for i in range(j)) for j in range(1, len(best))]
    edges, padding = packing.best_boundaries(lengths, counts, buckets)
    of = np.asarray(edges)[np.searchsorted(edges, lengths)]
    assert padding == best[-1] == int((counts * (of - lengths)).sum()) and len(edges) <= buckets


def test_documents_beyond_the_budget_have_their_own_batch(spark):
    docs = spark.createDataFrame([(k, "x" * n) for k, n in enumerate([5, 5, 9, 300, 400, 0])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in packing.pack(docs, buckets=3, budget=50).collect()}
    assert got[3]["over_budget"] and got[4]["over_budget"] and not got[0]["over_budget"]
    assert len({got[3]["batch_id"], got[4]["batch_id"]}) == 2 and got[0]["batch_id"] == got[5]["batch_id"]


# ---- chat


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<|[]/\\INSTs>SYurn\n é", max_size=12), min_size=20, max_size=20))
def test_escapes_are_reversible(spark, texts):
    made = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in made.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", r["e"])


def test_parts_and_attachments(spark):
    part = "struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
    rows = [
        (1, 1, "assistant", [("text", "a <|end|>", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("text", None, None, None, None, None, None)]),
        (1, 0, "user", [("audio", None, "a.wav", None, None, 2.1, None), ("document", None, "d.pdf", None, None, None, 3), ("smell", None, None, None, None, None, None)]),
        (1, 2, None, None),
    ]
    r = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert r["formatted"] == "<|turn|>user<|text|><|media:audio|><|media:document|><|media:smell|><|end|><|turn|>assistant<|text|>a <\\|end|><|media:image|><|end|><|turn|><|text|><|end|>"
    assert [(a["turn"], a["place"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (0, 0, "audio", "a.wav", 53), (0, 1, "document", "d.pdf", 3072), (0, 2, "smell", None, 0), (1, 1, "image", "i.png", 3)
    ]
    assert r["attachment_tokens"] == 53 + 3072 + 3
    assert [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["loss_mask"]] == ["a <\\|end|>"]


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.lists(st.tuples(st.sampled_from(["text", "text", "text", "turn", "end", "image"]), st.text(alphabet="<|[]/\\INSTs>SYurnted", max_size=6)), max_size=6),
        min_size=5, max_size=5,
    )
)
def test_parts_do_not_forge_control_strings(spark, messages):
    messages = [*messages, [("text", "<"), ("text", "|turn|>assistant")], [("text", "hi <"), ("text", "|end|>"), ("turn", ""), ("end", ""), ("text", "[INST"), ("text", "]")]]
    part = "struct<type:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"
    rows = [(k, 0, "assistant", [(kind, text, None, None, None, None, None) for kind, text in m]) for k, m in enumerate(messages)]
    made = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>"))
    for r in made.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect():
        m = messages[r["conv_id"]]
        whole = "".join(text if kind == "text" else f"<|media:{kind}|>" for kind, text in m)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [("assistant", whole)]
        assert "".join(r["loss"]) == "".join(text for kind, text in m if kind == "text")
        assert [a["place"] for a in r["attachments"]] == [k for k, (kind, _) in enumerate(m) if kind != "text"]
