"""Queries over intervals of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from subtide.operators.intervals import intervals_and_gaps, merge_intervals

#: A break longer than this is the end of a programme, not a gap.
MAX_GAP_MS = 600_000


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = spark.read.parquet(f"{sf_dir}/cue.parquet")
    return intervals_and_gaps(cue, ["file_id"], max_gap_ms=MAX_GAP_MS)


def p1_bilibili_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    cue = spark.read.parquet(f"{sf_dir}/bilibili_cue.parquet").selectExpr(
        "file_id", "cast(from_sec * 1000D as bigint) as start_ms", "cast(to_sec * 1000D as bigint) as end_ms"
    )
    return merge_intervals(cue, ["file_id"])


QUERIES = {"p1_found": p1_found, "p1_bilibili_periods": p1_bilibili_periods}

_MERGE = """
  {valid},
  marked AS (
    SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_e
    FROM valid),
  islands AS (
    SELECT *, sum(CASE WHEN before_e IS NULL OR s > before_e THEN 1 ELSE 0 END)
      OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
    FROM marked),
  periods AS (
    SELECT file_id, min(s) AS s, max(e) AS e FROM islands GROUP BY file_id, island)
"""

ORACLES = {
    "p1_found": "WITH "
    + _MERGE.format(
        valid="valid AS (SELECT DISTINCT file_id, start_ms AS s, end_ms AS e FROM cue WHERE end_ms > start_ms AND file_id IS NOT NULL)"
    )
    + """, following AS (SELECT *, lead(s) OVER (PARTITION BY file_id ORDER BY s) AS next_s FROM periods)
    SELECT file_id, 'period' AS kind, s AS from_ms, e AS to_ms FROM periods
    UNION ALL
    SELECT file_id, 'gap', e, next_s FROM following WHERE next_s - e <= 600000""",
    "p1_bilibili_periods": "WITH "
    + _MERGE.format(
        valid="""valid AS (
    SELECT DISTINCT file_id, trunc(from_sec * 1000)::BIGINT AS s, trunc(to_sec * 1000)::BIGINT AS e FROM bilibili_cue
    WHERE trunc(to_sec * 1000)::BIGINT > trunc(from_sec * 1000)::BIGINT AND file_id IS NOT NULL)"""
    )
    + " SELECT file_id, s AS period_start, e AS period_end FROM periods",
}
