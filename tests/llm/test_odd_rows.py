"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns in every operator and stage."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, fm_index, html_text, language_id, line_dedup, packing, perplexity, secrets, shards, simhash


def items(spark):
    return spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (None, "LINE of"), (2, None), (3, ""), (3, "ties and more"), (3, "ties and more")], "item_id long, text string")


OPERATORS = {
    "secrets": lambda s, d: secrets.scan(d),
    "pages": lambda s, d: html_text.extract(d, "text"),
    "shards": lambda s, d: shards.shuffle(d),
    "language": lambda s, d: language_id.predict(d, language_id.sample_texts(d.select("lang", "text"))),
    "quality": lambda s, d: perplexity.judge(d),
    "near": lambda s, d: simhash.near_duplicates(d),
    "benchmark": lambda s, d: fm_index.decontaminate(d, items(s)),
    "lines": lambda s, d: line_dedup.deduplicated(d),
    "packing": lambda s, d: packing.pack(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back_once(spark, odd, empty, name):
    assert OPERATORS[name](spark, odd).count() == odd.count()
    assert OPERATORS[name](spark, empty).count() == 0


def test_defined_results(spark, odd):
    found = fm_index.decontaminate(odd, items(spark)).select("row.doc_id", "n_words", "hits", "items").collect()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[0]["n_words"] == by_id[1]["n_words"] == by_id[2]["n_words"] == 0
    assert [tuple(h) for h in by_id[10]["hits"]] == [(5, 16)] and by_id[10]["items"] == [1]
    assert by_id[6]["items"] == [3] and by_id[4]["items"] == [] and by_id[4]["hits"]
    told = {r["doc_id"]: r for r in OPERATORS["language"](spark, odd).select("row.doc_id", "lang_pred", "score").collect()}
    assert told[0]["lang_pred"] == told[1]["lang_pred"] == told[2]["lang_pred"] == "und" and told[0]["score"] == 0
    judged = {r["doc_id"]: r for r in perplexity.judge(odd).select("row.doc_id", "n_words", "base_failed", "kept").collect()}
    assert judged[0]["n_words"] == 0 and judged[0]["base_failed"] and not judged[0]["kept"]
    near = {r["doc_id"]: r for r in simhash.near_duplicates(odd).collect()}
    assert near[0]["fingerprint"] == "0" * 16 and near[0]["component_id"] == near[1]["component_id"] == near[2]["component_id"] == 0
    assert near[7]["component_id"] == 6 and near[3]["component_id"] == near[None]["component_id"] or near[None]["component_id"] is not None
    for d, t in ((r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()):
        assert near[d]["fingerprint"] == f"{brute.fingerprint(t):016x}"


def test_lines_of_repeated_rows_and_null_ids(spark, odd):
    got = line_dedup.deduplicated(odd).select("row.doc_id", "row.text", "kept", "n_lines", "n_dropped").collect()
    of = lambda d: [r for r in got if r["doc_id"] == d]
    assert len(of(4)) == 3 and len({(r["kept"], r["n_dropped"]) for r in of(4)}) == 1 and of(4)[0]["n_dropped"] == 0
    assert of(5)[0]["kept"] == "short" and of(5)[0]["n_dropped"] == 2
    assert [r["n_dropped"] for r in of(None) if r["text"] == "line of some length"] == [1]
    assert of(0)[0]["n_lines"] == 1 and of(0)[0]["kept"] == ""
    assert of(6)[0]["n_dropped"] == 0 and of(7)[0]["n_dropped"] == 1


@pytest.mark.parametrize("at", range(5))
def test_stages(spark, odd, empty, sf, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, odd, sf)
    assert stage(spark, empty, sf).count() == 0
    if at < 4:
        assert out.columns == odd.columns
    rows = out.collect()
    if at in (1, 3, 4):
        assert len(rows) == odd.count()
    if at == 2:
        # empties, "one", the repeated rows and the ties are a group each
        assert sum(r["doc_id"] == 4 for r in rows) == 1 and sum(r["doc_id"] in (6, 7) for r in rows) == 1 and sum(not (r["text"] or "").strip() for r in rows) == 1


def test_chat_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (None, 5, "assistant", "x"), (2, 1, "assistant", ""), (2, 0, "a<|end|>\nb", "é<|text|>")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    done = chat.format_conversations(table.select("*", chat.text_part(F.col("text")).alias("parts")))
    back = {r["conv_id"]: r for r in done.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("a<|end|>\nb", "é<|text|>"), ("assistant", "")]
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("", ""), ("user", ""), ("user", "")]
    assert back[None]["loss"] == ["x"] and back[2]["loss"] == [""]
    assert chat.format_conversations(table.where("false").select("*", chat.text_part(F.col("text")).alias("parts"))).count() == 0
