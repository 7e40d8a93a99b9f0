"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe, exact_dedup, mixing, simhash, toxicity
from ledgerline.llm.common import documents, remove, shared_dir, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, learnt from sf_dir's labels, rejects go; null and empty texts stay, an empty table gives none."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the largest doc_id; null is the empty text, an empty table gives none."""
    ship(spark)
    return exact_dedup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts that share 0.8 of their five-word shingles stays, the one with the least doc_id.

    Null texts are empty and alike; an empty table gives none.
    """
    ship(spark)
    return simhash.dedup_similar_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows: a document comes once for each pass over its source that takes words of it; texts without words don't come, a null source is one, an empty table gives none."""
    ship(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text, for each row of the mix; a null text has no tokens, an empty table gives no rows."""
    ship(spark)
    return bpe.encode(docs, bpe.tokenizer_path(), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can't express the toxicity machine or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what is between them is written to the shared folder, and goes when the next stage is written.

    The last stage's input stays for as long as its result may be read.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
