"""The registered queries against plain versions on the smallest tables."""

import re
import zlib
from collections import Counter

import brute
import pytest

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()


def rows_of(spark, sf, name):
    return {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, sf).collect()}


def test_every_operator_has_a_query():
    numbers = {int(m[1]) for n in QUERIES if (m := re.match(r"op(\d+)_", n))}
    assert numbers == set(range(1, 14)) and "pipeline" in QUERIES


def test_secrets(spark, sf, docs):
    got = rows_of(spark, sf, "op2_secret_scan")
    assert {d: r[:4] for d, r in got.items()} == {d: brute.secrets(t) for d, t in docs}


def test_sharding(spark, sf, docs):
    got = QUERIES["op4_sharding"](spark, sf).collect()
    texts = dict(docs)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    again = QUERIES["op4_sharding"](spark, sf).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_language_of_held_out_documents(spark, sf):
    told = QUERIES["op5_language_id"](spark, sf).collect()
    given = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(told) == len(given)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in told)
    held = [r for r in told if r["held_out"]]
    right = sum(r["lang_pred"] == given[r["doc_id"]][0] for r in held)
    assert right >= 0.97 * len(held)


def test_quality_rules(spark, sf, docs):
    got = rows_of(spark, sf, "op6_quality_rules")
    assert {d: r[:6] for d, r in got.items()} == {d: brute.quality(t) for d, t in docs}
    passed = [r for r in got.values() if not r[5]]
    assert sum(r[6] for r in passed) >= 0.97 * len(passed) and not any(r[6] for r in got.values() if r[5])


def test_near_duplicates(spark, sf, docs):
    got = rows_of(spark, sf, "op7_simhash_near_dedup")
    fps = {d: brute.fingerprint(t) for d, t in docs}
    groups = brute.groups(fps)
    assert got == {d: (f"{fps[d]:016x}", groups[d]) for d in fps}


def test_decontamination(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(spark, sf, "op8_benchmark_decontamination") == brute.contamination(docs, items)


def test_line_dedup(spark, sf, docs):
    assert rows_of(spark, sf, "op9_line_dedup") == brute.line_dedup(docs)


def test_packing(spark, sf, docs):
    from plumbline.llm import packing

    got = QUERIES["op10_packing"](spark, sf).collect()
    check_packing(got, {d: len((t or "").encode()) + 1 for d, t in docs}, packing.TOKEN_BUDGET)


def check_packing(rows, lengths, budget):
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == lengths
    batches: dict[int, list] = {}
    for r in rows:
        assert r["padding"] == r["boundary"] - r["n_tokens"] >= 0
        batches.setdefault(r["batch_id"], []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for rs in batches.values():
        assert len({r["bucket"] for r in rs}) == 1 and sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert len(rs) * rs[0]["boundary"] <= budget or len(rs) == 1


def test_pages(spark, sf):
    import html

    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, sf).collect():
        inside = re.search(r"<article>(.*?)</article>", given[r["page_id"]], re.S)[1]
        parts = (html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", inside)))
        want = "\n".join(x for p in parts if (x := " ".join(p.split())))
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize("at", range(4))
def test_pipeline_stages(spark, sf, at, tmp_path_factory, stage_tables):
    import corpus_pipeline

    before, after = stage_tables[at], stage_tables[at + 1]
    assert len(corpus_pipeline.STAGES) == 5
    if at == 0:
        assert set(after) <= set(before) and all(after[d] == before[d] for d in after)
        fine = [d for d, t in before.items() if not brute.quality(t)[5]]
        assert set(after) <= set(fine) and len(after) >= 0.97 * len(fine)
    elif at == 1:
        want = brute.line_dedup(list(before.items()))
        assert {d: brute.sha(t) for d, t in after.items()} == {d: w[2] for d, w in want.items()}
    elif at == 2:
        groups = brute.groups({d: brute.fingerprint(t) for d, t in before.items()})
        assert after == {d: before[d] for d in set(groups.values())}
    else:
        items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
        was, now = brute.contamination(list(before.items()), items), brute.contamination(list(after.items()), items)
        assert set(now) == set(was) and any(r[4] for r in was.values()) and not any(r[4] for r in now.values())
        assert all(now[d][0] == was[d][0] - was[d][1] for d in was)
        assert all(after[d] == before[d] for d in was if not was[d][4])


@pytest.fixture(scope="module")
def stage_tables(spark, sf):
    import corpus_pipeline

    from plumbline.functions.settle import settle

    table = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out = table.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append({r["doc_id"]: r["text"] for r in table.collect()})
        table = settle(stage(spark, table, sf))
        assert table.columns == columns
    out.append({r["doc_id"]: r["text"] for r in table.collect()})
    check_packing(corpus_pipeline.STAGES[-1][1](spark, table, sf).collect(), {d: len((t or "").encode()) + 1 for d, t in out[-1].items()}, 65_536)
    return out
