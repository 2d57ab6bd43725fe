"""Contract queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import read
from .embedding_dedup import embedding_near_duplicates
from .near_duplicates import near_duplicates
from .nearest_neighbours import nearest_neighbours
from .packing import pack_documents
from .pii import personal_data_report
from .pseudo_likelihood import pseudo_likelihood
from .quality import quality_report
from .secrets import report_sql, secrets_report
from .sentencepiece_codec import sentencepiece_digests
from .token_counts import count_tokens


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all vectors for every vector whose id is divisible by 50; unusable vectors take no part (see ``nearest_neighbours``)."""
    rows = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 50 = 0"), 5)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text, with spans; a null text is empty, repeated rows are searched each (see ``find_secrets``)."""
    return secrets_report(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under its language's trusted model, and whether it is kept (see ``quality_report`` for nulls and empty texts)."""
    return quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their labels; unusable vectors link with nothing (see ``embedding_near_duplicates``)."""
    return embedding_near_duplicates(read(spark, sf_dir, "embeddings"), 0.93)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text, plain and disguised; a null text is empty (see ``find_personal_data``)."""
    return personal_data_report(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text; a null text is empty, repeated rows are counted each (see ``count_tokens``)."""
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces, packed; a null text is its end id alone, repeated rows are packed each (see ``pack_documents``)."""
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pseudo-likelihood under a network of the whole corpus; a text without words scores 0 (see ``pseudo_likelihood``)."""
    return pseudo_likelihood(read(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by shingles of three words; texts without words are linked with nothing (see ``near_duplicates``)."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, over=85, under=100)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text, as digests; a null text is empty (see ``sentencepiece_digests``)."""
    return sentencepiece_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_nearest_neighbours, op2_secret_scan, op3_quality, op4_embedding_dedup, op5_personal_data, op6_token_counts, op7_best_fit_packing, op8_pseudo_likelihood, op9_near_duplicates, op10_sentencepiece)}
#: The others rest on models, tokenizer files or approximate search; tests hold them against libraries and brute force.
SQL: dict[str, str] = {
    "op2_secret_scan": report_sql(),
    "op4_embedding_dedup": sql.embedding_near_duplicates(0.93),
    "op9_near_duplicates": sql.near_duplicates(3, 85, 100),
}
