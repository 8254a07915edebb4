"""Queries over the speakers of talk files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subtide.llm.turns import find_turns, line_templates


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/cue.parquet"), spark.read.parquet(f"{sf_dir}/cast_member.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_turns(*_tables(spark, sf_dir)).select("file_id", "speaker_id", "first_seq", "last_seq").distinct()


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_turns(*_tables(spark, sf_dir))


def p4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates(*_tables(spark, sf_dir))


QUERIES = {"p4_found": p4_found, "p4_turns": p4_turns, "p4_templates": p4_templates}

ORACLES: dict[str, str] = {}
