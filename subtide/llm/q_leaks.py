"""Queries over evaluation texts in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subtide.llm.leaks import find_leaks, scrub_leaks


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_item.parquet")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(*_tables(spark, sf_dir)).select("doc_id", "item_id").distinct()


def p8_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub_leaks(*_tables(spark, sf_dir))


QUERIES = {"p8_found": p8_found, "p8_scrubbed": p8_scrubbed}

ORACLES = {
    # Every 12 consecutive words of the items, met by those of the documents.
    "p8_found": """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents WHERE text IS NOT NULL),
      i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM eval_item),
      dg AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 11], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS p FROM d)),
      ig AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + 11], ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS p FROM i))
      SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)""",
}
