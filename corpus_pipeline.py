"""A training corpus from raw documents: five stages, each one operator over all that the stage before kept.

Toxic documents go, then exact copies, then near copies but one of each class;
the sources are mixed to their target weights in whole documents, and the mix is
packed into sequences. Each stage but the last returns the columns of documents,
and ignores other columns that it does not need, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import remove, scratch
from tessella.llm.exact_dedup import drop_copies
from tessella.llm.mixing import mixed_documents
from tessella.llm.near_dedup import drop_near_copies
from tessella.llm.packing import packed_documents
from tessella.llm.toxicity import drop_toxic

VOCABULARY = "word_bpe_49k.json"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Null and empty texts score like texts without features; rows with
    null ids are scored too; repeated rows share their score. No labels: all stay. No rows: no rows."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, the one with the largest doc_id; rows with a null id stay. Null and empty texts are equal;
    of rows that share id and text, one stays. No rows: no rows."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts whose 5-word shingle sets are similar by 0.8 or more, the smallest doc_id; rows
    with a null id, and null and empty texts, stay; of rows that share id and text, one stays. No rows: no rows."""
    return drop_near_copies(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as its part of its source's target holds it. Null sources are one source; texts without
    words come once; rows that share id, source and text count together. No rows: no rows."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Null and empty texts have the end id alone; repeated rows are packed each;
    null ids stay null. No rows: no rows."""
    import public_tokenizers

    return packed_documents(docs, public_tokenizers.path(VOCABULARY), kept=50_000)  # the stages before have filled the executors' heaps


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Neither the toxicity model nor the tokenizer can be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the corpus; what stands between the stages is written to the shared folder and dropped."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark)
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)  # materialised: it no longer reads the folder
    finally:
        remove(spark, folder)
