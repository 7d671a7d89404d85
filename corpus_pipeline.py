"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage works on all rows that the one before kept and returns the columns of documents; the last returns
pieces of packed sequences. `run` applies them to the documents of a folder, each stage written as Parquet to the
folder that spark.checkpoint.dir names and read again. SQL cannot express the stages (a trained network, a trained
field, a tokenizer), so ORACLE_SQL is None and tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from labelmill.llm import common, decontaminate, langid, packing, secrets, simhash
from labelmill.llm.queries import tokenizer_path
from labelmill.session import ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on their labelled rows, finds to be in a learned language."""
    common.small_batches(spark)
    return langid.with_language(docs, *langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links (three-word shingles, two bits): the one with the smallest doc_id."""
    common.small_batches(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    common.small_batches(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with `[SECRET]` in the place of every span that the scan finds."""
    common.small_batches(spark)
    return secrets.redact(docs, secrets.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    common.small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
