"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that its predecessor kept, written as Parquet and read again. All but
the last keep the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kvlog.llm import decontam, packing, secrets, simhash, tokens, toxicity
from kvlog.llm.common import fresh_dir, remove, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text is judged as an empty one, a row without
    an id by its text, repeated rows each; without labels, or without documents, nothing goes."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays; of equal ids, or where
    none has an id, that of the least hash; of rows alike in all columns one. All texts that are
    null or wordless are one group."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none, null and empty items
    are in none; ids play no part, and repeated rows are searched each."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and n_chars set anew; every row stays, null texts and repeated rows too."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that are left; a null text is the end alone."""
    return packing.pack_documents(docs, public_tokenizers.path(tokens.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: Neither trained scores nor tokens can be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. A stage's table goes once the next one's is written."""
    docs, folder, last = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
