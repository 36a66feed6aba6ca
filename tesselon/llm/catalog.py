"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import html_text, lexical, mixing, order_minhash, packing, phrases, pii, quality, sentencepiece_codec, simhash, token_counts, token_files, topk
from tesselon.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digest_documents(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.store_and_read(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_personal_data": op1_personal_data,
    "op2_mix_sources": op2_mix_sources,
    "op3_order_minhash": op3_order_minhash,
    "op4_top_k": op4_top_k,
    "op5_html_text": op5_html_text,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_files": op9_token_files,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_ranked_search": op11_ranked_search,
    "op12_phrases": op12_phrases,
    "op13_packing": op13_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": mixing.mix_sql(),
    "op4_top_k": topk.top_k_sql(),
    "op5_html_text": html_text.EXTRACT_SQL,
    "op11_ranked_search": lexical.search_sql(),
    "op12_phrases": phrases.mine_sql(),
}
