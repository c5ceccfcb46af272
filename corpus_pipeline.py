"""The training-corpus pipeline: five stages over `documents`, each written as Parquet and read again.

toxicity      documents that score 0.5 or more go
near_copies   of each group of documents linked by 5-word shingles (0.75) the smallest doc_id stays
benchmark     documents that hold a benchmark window of 10 words go
secrets       secrets are replaced by a mark; n_chars follows the text
pieces        the ids of the SentencePiece encoding are added

Every stage keeps all rows that it has no reason to drop, rows without text or doc_id too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, jaccard_join, secret_scan, sentencepiece_codec
from llm import toxicity as toxicity_model
from llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of whole texts that travel to Python at once, in place of Spark's 10000: they bound the memory of a task on both sides.
BATCH_ROWS = 1000


def _in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    model = toxicity_model.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity_model.score_toxicity(docs, model, out="__score").where("__score < 0.5").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return jaccard_join.keep_one_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else clean


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _in_small_batches(spark)
    return sentencepiece_codec.encode_pieces(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secrets), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: The model, the near-copy components and the merges of pieces are not SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None
