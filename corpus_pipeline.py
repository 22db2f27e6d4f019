"""The corpus pipeline: toxicity, near duplicates, decontamination, secrets, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``.  All
stages but the last return the columns of ``docs`` as they are; rows with a null or
repeated ``doc_id`` are treated as the stages' operators say.

* toxicity: documents that the model calls toxic go; empty ones stay.
* near_dedup: of each component of linked documents the one with the smallest id stays.
* decontaminate: documents that hold a benchmark item go, row by row, so ids may be null or
  repeated; a row is known by a 64-bit hash of its id and text.
* secrets: secrets are masked in the text; no document goes.
* packing: one row for each piece of each document, with its sequence and offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafledger.llm import decontam, neardup, packing, secrets, toxicity
from leafledger.llm.store import saved, shared_dir
from leafledger.llm.text import lean
from leafledger.llm.tokens import default_tokenizer

ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not in ``ids``; null ids stay."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), likelihoods=False)
    return toxicity.filter_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs, k=5, percent=80)
    return _without(docs, found.where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = "row"
    while row in docs.columns:
        row += "_"
    known = docs.withColumn(row, F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")))
    found = decontam.contaminated(known, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=row)
    return known.join(found.select(row).distinct(), row, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    at = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = secrets.Scanner()
        for b in batches:
            texts = [None if t is None else secrets.masked(t, scanner.spans(t)[1]) for t in (v.as_py() for v in b.column(at))]
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, b.column(at).type))

    return docs.mapInArrow(lean(mask), docs.schema)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
