"""From raw documents to training tokens: language, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, langid, mixing, substrings, tokens
from tidemark.llm.common import drop, shared_folder, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those that language identification rejects go: null and empty texts, and texts without a letter, too. Ties go to the first language; rows repeated stay or go alike."""
    return langid.accepted(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity of 0.8 and more. The least doc_id stays, null ones last; texts without a word all stay; of rows with one id and text one stays."""
    return jaccard.representatives(docs, words=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any string of 200 bytes that starts twice in the documents that are left. Null texts stay null; texts of which nothing but white space is left go."""
    return substrings.cleaned(docs, length=200)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask, not at all, once or more. A null source is one; texts without a word have size 0 and are sampled like others; rows repeated are each sampled."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of their decoded text; no tokens for null or empty texts."""
    return tokens.encode_decode(docs, ids=True, keep=("doc_id", "source")).select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_class),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Shingle links, byte strings and tokens can't be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:  # the stage before is written for good, its own input is of no more use
            drop(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
