"""Queries over the cue model: order, numbering, times, written text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions.encodings import encode_text
from subtide.functions.timecode import dot_stamp, seconds_to_ms, srt_stamp, stamp_to_ms
from subtide.operators import cues as c


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.as_cues(spark.read.parquet(f"{sf_dir}/cue.parquet"))


def _over(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(load(spark, sf_dir))


def ts_bilibili(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/bilibili_cue.parquet").where("to_sec is not null").distinct()
    return rows.select("file_id", "seq", seconds_to_ms(F.col("from_sec")).alias("from_ms"), dot_stamp(F.col("to_sec") * 1000.0).alias("to_stamp"))


def bilibili_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of JSON captions as cues: cut times, a position tag unless it is the usual one."""
    rows = spark.read.parquet(f"{sf_dir}/bilibili_cue.parquet").dropna(subset=["to_sec", "loc_code", "content"])
    tag = F.when(F.col("loc_code") == 2, "").otherwise(F.concat(F.lit("{\\an"), F.col("loc_code").cast("string"), F.lit("}")))
    return rows.select(
        "file_id", "seq", seconds_to_ms(F.col("from_sec")).alias("start_ms"), seconds_to_ms(F.col("to_sec")).alias("end_ms"), F.concat(tag, "content").alias("content")
    ).distinct()


def _export(df: DataFrame) -> DataFrame:
    return c.export_srt(df, "\r\n")


def _encoded(df: DataFrame) -> DataFrame:
    parts = c.export_srt(df)
    return parts.select("file_id", "part_no", F.hex(encode_text(F.col("text"), "utf-8-sig", F.col("part_no") == 0)).alias("data"))


QUERIES = {
    "cue_rows": load,
    "cue_sort_reindex": _over(c.sort_cues),
    "cue_exportable": _over(c.exportable),
    "cue_offset": _over(lambda d: c.shift(d, -1500)),
    "cue_duration": _over(lambda d: c.with_duration(d).select("file_id", "seq", "duration_ms")),
    "cue_count": _over(c.count_cues),
    "cue_at": _over(lambda d: c.cue_at(d, 2)),
    "cue_append": _over(lambda d: c.append(d, d.where("end_ms > start_ms"))),
    "cue_changed": _over(lambda d: c.changed_files(d, c.shift(d, F.when(F.col("seq") == 7, 1).otherwise(0)))),
    "srt_blocks": _over(c.block_text),
    "srt_export": _over(_export),
    "srt_encoded": _over(_encoded),
    "ts_format_srt": _over(lambda d: d.select("file_id", "seq", srt_stamp(F.col("start_ms") - 60_000).alias("stamp"))),
    "ts_parse": _over(lambda d: d.select("file_id", "seq", stamp_to_ms(srt_stamp(F.col("start_ms"))).alias("ms"))),
    "ts_bilibili": ts_bilibili,
    "bilibili_rows": bilibili_rows,
}

#: The cues of the table: delivered once each, as their earliest values.
CUES = """cues AS (
  SELECT file_id, seq, v.idx, v.start_ms, v.end_ms, v.content FROM (
    SELECT file_id, seq, min(struct_pack(idx := coalesce(idx, 0), start_ms := start_ms, end_ms := end_ms, content := coalesce(content, ''))) AS v
    FROM cue WHERE file_id IS NOT NULL AND seq IS NOT NULL AND start_ms IS NOT NULL AND end_ms IS NOT NULL GROUP BY file_id, seq))"""
_WITH = f"WITH {CUES} "


def stamp(ms: str, mark: str = ",") -> str:
    """SRT's time of a number of milliseconds; signs as truncating division gives them."""
    return f"printf('%02d:%02d:%02d{mark}%03d', trunc({ms} / 3600000.0)::BIGINT, trunc(({ms}) % 3600000 / 60000.0)::BIGINT, trunc(({ms}) % 60000 / 1000.0)::BIGINT, ({ms}) % 1000)"


def _block(eol: str) -> str:
    return (
        f"position::VARCHAR || {eol} || {stamp('start_ms')} || ' --> ' || {stamp('end_ms')} || {eol} || "
        f"replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), {eol}) || {eol} || {eol}"
    )


_LISTED = f"{_WITH}, listed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, idx, seq) AS position FROM cues WHERE start_ms < end_ms)"
_CRLF = "chr(13) || chr(10)"
_PARTS = "SELECT file_id, ((position - 1) // 2000)::BIGINT AS part_no, string_agg({block}, '' ORDER BY position) AS text FROM listed GROUP BY ALL"

ORACLES = {
    "cue_rows": f"{_WITH} SELECT * FROM cues",
    "cue_sort_reindex": f"{_WITH}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, idx, seq) AS n FROM cues) SELECT file_id, n AS seq, n::INTEGER AS idx, start_ms, end_ms, content FROM n",
    "cue_exportable": f"{_WITH} SELECT * FROM cues WHERE start_ms < end_ms",
    "cue_offset": f"{_WITH} SELECT file_id, seq, idx, start_ms - 1500 AS start_ms, end_ms - 1500 AS end_ms, content FROM cues",
    "cue_duration": f"{_WITH} SELECT file_id, seq, end_ms - start_ms AS duration_ms FROM cues",
    "cue_count": f"{_WITH} SELECT file_id, count(*) AS n_cues FROM cues GROUP BY file_id",
    "cue_at": f"{_WITH} SELECT * FROM cues QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seq) = 3",
    "cue_append": f"{_WITH} SELECT * FROM cues UNION ALL SELECT file_id, seq + (SELECT max(seq) FROM cues k WHERE k.file_id = cues.file_id) AS seq, idx, start_ms, end_ms, content FROM cues WHERE end_ms > start_ms",
    "cue_changed": f"{_WITH} SELECT file_id, bool_or(seq = 7 AND start_ms < end_ms) AS changed FROM cues GROUP BY file_id",
    "srt_blocks": f"{_LISTED} SELECT file_id, position, {_block('chr(10)')} AS block FROM listed",
    "srt_export": f"{_LISTED} {_PARTS.format(block=_block(_CRLF))}",
    "srt_encoded": f"{_LISTED}, parts AS ({_PARTS.format(block=_block('chr(10)'))}) SELECT file_id, part_no, CASE WHEN part_no = 0 THEN 'EFBBBF' ELSE '' END || hex(encode(text)) AS data FROM parts",
    "ts_format_srt": f"{_WITH} SELECT file_id, seq, {stamp('(start_ms - 60000)')} AS stamp FROM cues",
    "ts_parse": f"{_WITH} SELECT file_id, seq, start_ms AS ms FROM cues",
    "ts_bilibili": """WITH b AS (SELECT DISTINCT * FROM bilibili_cue WHERE to_sec IS NOT NULL), m AS (SELECT *, trunc(to_sec * 1000)::BIGINT AS t FROM b)
      SELECT file_id, seq, trunc(from_sec * 1000)::BIGINT AS from_ms, printf('%02d:%02d:%02d.%03d', t // 3600000, t // 60000 % 60, t // 1000 % 60, t % 1000) AS to_stamp FROM m""",
    "bilibili_rows": """SELECT DISTINCT file_id, seq, trunc(from_sec * 1000)::BIGINT AS start_ms, trunc(to_sec * 1000)::BIGINT AS end_ms,
      CASE WHEN loc_code = 2 THEN '' ELSE '{\\an' || loc_code || '}' END || content AS content
      FROM bilibili_cue WHERE to_sec IS NOT NULL AND loc_code IS NOT NULL AND content IS NOT NULL""",
}
