"""Corpus pipeline: language ID, near-dedup, secret scans, mixing, packing; each stage one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next.

* language_id drops documents without a language (no letter, or null text), and keeps all others.
* near_dedup keeps, of each group of near copies, one row of the smallest doc_id (rows without one come last).  Rows that
  share a doc_id, or have none, but are in different groups are kept for each group.
* secret_scan replaces secrets by a mark, and sets n_chars to the new length; no document goes.
* mix_sources repeats each document as often as the mix takes it (0, 1 or 2 times).
* pack places each remaining copy into sequences; `copy` tells the copies of a document apart (equal pieces of rows that share
  a doc_id are told apart in the same way).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import langid, mixing, packing, secrets, simhash
from weftline.llm.shared import fresh


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(langid.train_rows(docs)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "piece", "start", "length", "ids_crc32").orderBy("sequence_id", "offset")) - 1
    return packed.withColumn("copy", copy)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
