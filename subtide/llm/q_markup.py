"""Queries over markup residue in captions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.llm.wrapper import clean_markup, find_markup

TABLES = ("cue", "bilibili_cue")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table_name"), "file_id", "seq", "content") for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_markup(_records(spark, sf_dir), ["table_name", "file_id", "seq"], host="table_name").select("table_name", "file_id", "seq")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(_records(spark, sf_dir), ["table_name", "file_id", "seq"], host="table_name").drop("host")


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}

ORACLES: dict[str, str] = {}
