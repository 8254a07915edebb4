"""Queries that encode or split documents by a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm.encode import decode_corpus, encode_corpus
from subtide.llm.pieces import MAX_TOKENS, plan_pieces, split_documents


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_documents(spark, sf_dir))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text from its ids."""
    return decode_corpus(p7_ids(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A token has a byte at least, so shorter texts can't be over the limit.
    long = _documents(spark, sf_dir).where(F.octet_length("text") > MAX_TOKENS)
    return plan_pieces(long).where(F.size("pieces") > 1).select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(_documents(spark, sf_dir))


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip, "p9_found": p9_found, "p9_pieces": p9_pieces}
ORACLES = {"p7_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
