"""The corpus pipeline: quality, near duplicates, personal data, source mix, SentencePiece ids.

Each stage works on all documents that the one before it kept and returns rows with the columns of
``documents``; the last returns the digests of the ids. Between stages the documents are written as
Parquet to the folder that the cluster shares and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import mixing, pii, quality, sentencepiece_codec, simhash
from tesselon.lineage import remove
from tesselon.llm.common import shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null texts are scored as empty ones; null ids are rows like others; repeated rows have the same score.
    Without a single label of each kind nothing is known and all documents stay. An empty table gives none.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Of rows that repeat id and text one stays. Null and empty texts are alike. An empty table gives none.
    """
    return simhash.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null, repeated rows stay.

    ``n_chars`` becomes that of the new text. An empty table gives none.
    """
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it.

    Documents without words, null texts among them, are not taken; null sources are a source of their
    own. Equal places in the queue go by the documents' ids. An empty table gives none.
    """
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix, as often as it comes; null texts count as empty."""
    return sentencepiece_codec.digest_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL cannot express the classifier and the tokenizer; the tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    read = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if read:
            remove(spark, read)
        read = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
