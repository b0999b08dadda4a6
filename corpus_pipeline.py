"""The training-data pipeline: quality rules, line dedup, near dedup, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
back as the next one's docs; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.settle import settle
from plumbline.llm import fm_index, line_dedup, near_copies, packing, perplexity
from plumbline.llm.arrow import pieces


def with_text(rows: DataFrame, text: Column) -> DataFrame:
    """The columns of the struct ``row`` with another text, and its length where the table keeps it; a null text stays null."""
    names = rows.schema["row"].dataType.names
    text = F.when(F.col("row.text").isNotNull(), text)
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return rows.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in names))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule or the perplexity band of their language rejects go."""
    return perplexity.judge(docs).where("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; every document stays, if need be with an empty text."""
    return with_text(line_dedup.deduplicated(docs), F.col("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: SimHash candidates whose five-word shingles overlap by 0.8."""
    return near_copies.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; the rest of the document stays."""
    found = fm_index.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, text, spans = batch.columns
            texts = [fm_index.without_spans(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string())], names=["row", "kept"])

    rows = found.select("row", "text", "spans")
    return with_text(rows.mapInArrow(cut, rows.select("row").schema.add("kept", "string")), F.col("kept"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near dedup", without_near_copies),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: Perplexity, fingerprints and the packing draw have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
