"""Builders of small caption files and cues for tests."""

from pyspark.sql import DataFrame, SparkSession

from subtide.operators.cues import as_cues
from subtide.sources.captions import cues_of, parse_captions

SCHEMA = "file_id long, seq long, idx int, start_ms long, end_ms long, content string"


def cues(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Cues of file 1 from (start, end, content)."""
    return spark.createDataFrame([(1, i, i, s, e, c) for i, (s, e, c) in enumerate(rows, 1)], SCHEMA)


def texts(spark: SparkSession, contents: list[str]) -> DataFrame:
    """Cues a minute apart."""
    return cues(spark, [(i * 60_000, i * 60_000 + 1000, c) for i, c in enumerate(contents)])


def parsed(spark: SparkSession, data: str | bytes, form: str | None) -> DataFrame:
    data = data.encode() if isinstance(data, str) else data
    return parse_captions(spark.createDataFrame([("f", bytearray(data))], "path string, content binary"), form=form)


def srt(spark: SparkSession, text: str) -> DataFrame:
    return as_cues(cues_of(parsed(spark, text, "srt")))


def rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.select("start_ms", "end_ms", "content").orderBy("start_ms", "end_ms", "seq").collect()] if "seq" in df.columns else []


def said(df: DataFrame) -> list[str]:
    return [r.content for r in df.orderBy("seq").collect()]
