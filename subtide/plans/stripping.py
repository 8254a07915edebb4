"""Queries over annotations for the hard of hearing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions import sdhtext as s
from subtide.functions.textrules import Rule
from subtide.operators.sdh import strip_sdh
from subtide.plans import re2
from subtide.plans.model import CUES, load

#: A user's own pattern, as an example: codes such as QQ17.
EXTRA = [r"(?dU)\b[0-9]+ of them\b"]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir).select("file_id", "seq", "content")


def _changed(step):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _texts(spark, sf_dir).withColumn("new", step(F.col("content")))
        return rows.where("new != content").select("file_id", "seq", F.col("new").alias("content"))

    return query


def _kept(drop):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir).where(drop(F.col("content"))).select("file_id", "seq")

    return query


QUERIES = {
    "sdh_full_line": _kept(s.is_full_line),
    "sdh_music": _kept(s.is_music),
    "sdh_cc_only": _kept(lambda t: s.strip_cc(t).isNull()),
    "sdh_new_line": _changed(s.clean_new_lines),
    "sdh_inline": _changed(s.clean_inline),
    "sdh_speakers": _changed(s.clean_speakers),
    "sdh_cc": _changed(s.strip_cc),
    "sdh_hyphen": _changed(s.strip_lone_hyphen),
    "sdh_bleeps": _changed(s.protect_bleeps),
    "sdh_strip_tags": _changed(s.strip_tags),
    "sdh_strip": lambda spark, sf_dir: strip_sdh(load(spark, sf_dir)),
    "sdh_strip_extra": lambda spark, sf_dir: strip_sdh(load(spark, sf_dir), EXTRA),
}


def _sub(sql: str, pattern: str, to: str = "") -> str:
    return re2.replace(sql, Rule("", pattern, to))


def _tags(sql: str) -> str:
    return _sub(sql, s.TAGS)


def _full(sql: str) -> str:
    return f"({re2.matches(_tags(sql), s.FULL_LINE[0])} OR {re2.matches(_tags(sql), s.FULL_LINE[1])})"


def _music(sql: str) -> str:
    return f"replace({re2.trim(_sub(_tags(sql), r'\A♪+\z'))}, ' ', '') = ''"


def _chain(sql: str, rules: list[Rule]) -> str:
    for r in rules:
        sql = re2.replace(sql, r)
    return sql


def _new_lines(sql: str) -> str:
    position = f"regexp_extract({sql}, {re2.literal(re2.pattern(s.POSITION_TAGS))})"
    left = re2.trim(_chain(sql, s.NEW_LINE))
    return f"CASE WHEN NOT contains({left}, {position}) THEN {position} || {left} ELSE {left} END"


def _line(x: str) -> str:
    first = _sub(f"rtrim({x}, chr(13))", rf"(?dU){s.SPEAKER_PARENTHESES}", "$2$3")
    upto = _sub(f"regexp_extract({first}, {re2.literal(re2.pattern(rf'(?dU){s.SPEAKER}'))})", r"(?dU)\s+\z")
    return f"CASE WHEN regexp_matches(substr({first}, length({upto}) + 1, 2), '^[0-9][0-9]$') THEN {first} ELSE {_sub(first, rf'(?dU){s.SPEAKER}', '$2$3')} END"


def _speakers(sql: str) -> str:
    return re2.trim(f"array_to_string(list_transform(string_split({sql}, chr(10)), lambda x: {_line('x')}), chr(10))")


def _cc(sql: str) -> str:
    return _sub(sql, s._CC, "$1$2")


def _hyphen(sql: str) -> str:
    count = f"len(regexp_extract_all({sql}, {re2.literal(re2.pattern(s._LINE_HYPHEN))}))"
    return f"CASE WHEN {count} = 1 THEN {re2.trim(_sub(sql, s._FIRST_HYPHEN, '$1'))} ELSE {sql} END"


def _protect(sql: str) -> str:
    words = re2.trim(_sub(_tags(sql), r"\A-+"))
    return (
        f"CASE WHEN (contains({words}, '[bleep]') OR contains({words}, '(bleep)')) AND {words} NOT IN ('[bleep]', '(bleep)') "
        f"THEN replace(replace({sql}, '[bleep]', chr(57344)), '(bleep)', chr(57345)) ELSE {sql} END"
    )


_FROM = f"WITH {CUES}"


def _change(sql: str) -> str:
    return f"{_FROM}, c AS (SELECT file_id, seq, content AS old, {sql} AS content FROM cues) SELECT file_id, seq, content FROM c WHERE content <> old"


def _whole(extra: list[str]) -> str:
    own = "content"
    for p in extra:
        own = _sub(own, p)
    blank = "regexp_matches(content, '^[\\t-\\r \\x{85}\\p{Z}]*\\z')"
    return f"""{_FROM}, a AS (SELECT * REPLACE ({_protect('content')} AS content) FROM cues),
      b AS (SELECT * REPLACE ({_new_lines('content')} AS content) FROM a WHERE NOT {_full('content')}),
      d AS (SELECT * REPLACE ({_chain('content', s.INLINE)} AS content) FROM b),
      e AS (SELECT * REPLACE ({_speakers('content')} AS content) FROM d),
      f AS (SELECT * REPLACE ({_cc('content')} AS content) FROM e),
      g AS (SELECT * FROM f WHERE NOT {re2.matches('content', s._CC_ONLY)} AND NOT ({_music('content')})),
      h AS (SELECT * REPLACE ({_hyphen('content')} AS content) FROM g),
      i AS (SELECT * REPLACE ({own} AS content) FROM h),
      j AS (SELECT * REPLACE (replace(replace(content, chr(57344), '[bleep]'), chr(57345), '(bleep)') AS content) FROM i WHERE NOT {blank}),
      n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, idx, seq) AS n FROM j)
      SELECT file_id, n AS seq, n::INTEGER AS idx, start_ms, end_ms, content FROM n"""


ORACLES = {
    "sdh_full_line": f"{_FROM} SELECT file_id, seq FROM cues WHERE {_full('content')}",
    "sdh_music": f"{_FROM} SELECT file_id, seq FROM cues WHERE {_music('content')}",
    "sdh_cc_only": f"{_FROM} SELECT file_id, seq FROM cues WHERE {re2.matches(_cc('content'), s._CC_ONLY)}",
    "sdh_new_line": _change(_new_lines("content")),
    "sdh_inline": _change(_chain("content", s.INLINE)),
    "sdh_speakers": _change(_speakers("content")),
    "sdh_cc": f"{_FROM}, c AS (SELECT file_id, seq, content AS old, {_cc('content')} AS content FROM cues) SELECT file_id, seq, content FROM c WHERE content <> old AND NOT {re2.matches('content', s._CC_ONLY)}",
    "sdh_hyphen": _change(_hyphen("content")),
    "sdh_bleeps": _change(_protect("content")),
    "sdh_strip_tags": _change(_tags("content")),
    "sdh_strip": _whole([]),
    "sdh_strip_extra": _whole(EXTRA),
}
