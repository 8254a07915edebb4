"""Queries over wrongly decoded cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subtide.llm.garble import find_garbled


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = spark.read.parquet(f"{sf_dir}/cue.parquet")
    return find_garbled(cue, ["file_id", "seq"]).select("file_id", "seq").distinct()


QUERIES = {"p5_found": p5_found}

ORACLES: dict[str, str] = {}
