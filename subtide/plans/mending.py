"""Queries over the repair of cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions.fixline import RULES
from subtide.functions.textrules import decode_references, fix_mojibake
from subtide.operators import mend as m
from subtide.operators.cues import sort_cues
from subtide.plans import re2
from subtide.plans.formats import decoded
from subtide.plans.model import CUES, load

_CHECKED = [r for r in RULES if re2.expressible(r)]


def fix_time_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.fix_time_codes(load(spark, sf_dir)).select("file_id", "seq", "start_ms", "end_ms")


def global_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file the cues that bear both tags, whole files of italics at the top."""
    cues = load(spark, sf_dir).where("content like '<i>%</i>' or content like '{\\\\\\\\an8}%'")
    return m.remove_global_tags(cues).select("file_id", "seq", "content")


def mend_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule, file_id, seq, content): every rewrite on its own, where it changes a text."""
    content = F.col("content")
    tried = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.regexp_replace(content, r.pattern, r.to).alias("new")) for r in _CHECKED))
    rows = load(spark, sf_dir).select("file_id", "seq", "content", F.explode(tried).alias("_r"))
    return rows.where(F.col("_r.new") != content).select("_r.rule", "file_id", "seq", F.col("_r.new").alias("content"))


def mend_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with all repairs."""
    return m.correct_texts(load(spark, sf_dir)).select("file_id", "seq", "content")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir).where(F.contains("content", F.lit("&")))
    return cues.select("file_id", "seq", decode_references(F.col("content")).alias("content"))


def mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir).withColumn("fixed", F.col("content"))
    return fix_mojibake(cues, "fixed").where("fixed != content").select("file_id", "seq", F.col("fixed").alias("content"))


def combine_timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.combine_timecodes(load(spark, sf_dir))


def combine_keeping_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.combine_timecodes(load(spark, sf_dir), remove_gaps=False)


def short_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.remove_short_gaps(sort_cues(load(spark, sf_dir)))


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/caption_file.parquet")
    return files.select("file_id", m.language_code(F.col("lang")).alias("code"))


def rtl_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mark_rtl(load(spark, sf_dir)).select("file_id", "seq", "content")


def compatibility_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = load(spark, sf_dir)
    return m.normalize_text(cues, F.col("content").rlike(r"[^\x00-\x7f]")).select("file_id", "seq", "content")


def mend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs, each file by its own language."""
    files = spark.read.parquet(f"{sf_dir}/caption_file.parquet").select("file_id", "lang")
    return m.mend(load(spark, sf_dir).join(files, "file_id", "left"), F.col("lang"))


QUERIES = {
    "fix_time_codes": fix_time_codes,
    "global_tags": global_tags,
    "mend_rules": mend_rules,
    "mend_texts": mend_texts,
    "mend_references": references,
    "mend_mojibake": mojibake,
    "combine_timecodes": combine_timecodes,
    "combine_keeping_gaps": combine_keeping_gaps,
    "short_gaps": short_gaps,
    "language_codes": language_codes,
    "rtl_marks": rtl_marks,
    "compatibility_forms": compatibility_forms,
    "mend": mend,
}

_BLANK = "regexp_matches({}, '^[\\t-\\r \\x{{85}}\\p{{Z}}]*\\z')".format


def _walk(source: str, same: str, keep: str) -> str:
    """A walk along each list with the last cue kept as its state; a cue pushed gives out the one before it.

    source gives (file_id, n, idx, seq, start_ms, end_ms, content); same and keep
    are cases of the row r against the state: what the state becomes, or null to
    push the row, and whether a row that is pushed is kept at all.
    """
    return f"""{source}, walk AS (
      SELECT file_id, n, seq AS ls, idx AS li, start_ms AS s, end_ms AS e, content AS t, NULL::STRUCT(seq BIGINT, idx INTEGER, s BIGINT, e BIGINT, t VARCHAR) AS done FROM listed WHERE n = 1
      UNION ALL
      SELECT file_id, n, CASE WHEN push THEN seq ELSE ls END, CASE WHEN push THEN idx ELSE li END, CASE WHEN push THEN start_ms ELSE s END,
        CASE WHEN push THEN end_ms ELSE new.e END, CASE WHEN push THEN content ELSE new.t END,
        CASE WHEN push THEN struct_pack(seq := ls, idx := li, s := s, e := cut, t := t) END
      FROM (SELECT r.file_id, r.n, r.seq, r.idx, r.start_ms, r.end_ms, r.content, w.ls, w.li, w.s, w.e, w.t, {same}, {keep}
            FROM walk w JOIN listed r ON r.file_id = w.file_id AND r.n = w.n + 1)),
    kept AS (
      SELECT file_id, done.seq AS seq, done.idx AS idx, done.s AS start_ms, done.e AS end_ms, done.t AS content FROM walk WHERE done IS NOT NULL
      UNION ALL SELECT file_id, ls, li, s, e, t FROM walk WHERE n = (SELECT max(n) FROM listed l WHERE l.file_id = walk.file_id)),
    again AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, idx, seq) AS m FROM kept)
    SELECT file_id, m AS seq, m::INTEGER AS idx, start_ms, end_ms, content FROM again"""


def _combine(gaps: bool) -> str:
    gap = "(r.start_ms - w.e)"
    equal = "r.start_ms = w.s AND r.end_ms = w.e"
    joins = f"{gap} < 10 AND r.content = w.t"
    grows = f"{gap} > 0 AND {gap} <= 85 AND starts_with(r.content, w.t)" if gaps else "false"
    same = f"""CASE WHEN {equal} THEN struct_pack(e := w.e, t := CASE WHEN w.t <> r.content THEN w.t || chr(10) || replace(r.content, '{{\\an8}}', '') ELSE w.t END)
      WHEN {joins} THEN struct_pack(e := r.end_ms, t := w.t) WHEN {grows} THEN struct_pack(e := r.end_ms, t := r.content) ELSE struct_pack(e := w.e, t := w.t) END AS new"""
    keep = f"""NOT ({equal}) AND NOT ({joins}) AND NOT ({grows}) AND ({gap} = 0 OR NOT {_BLANK('r.content')}) AS push,
      CASE WHEN {gap} = 0 THEN w.e - 1 ELSE w.e END AS cut"""
    source = f"WITH RECURSIVE {CUES}, listed AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq) AS n FROM cues)"
    return _walk(source, same, keep)


_GAP = "(r.start_ms - w.e)"
_GAPS = _walk(
    f"WITH RECURSIVE {CUES}, sorted AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, idx, seq) AS n FROM cues), listed AS (SELECT file_id, n, n AS seq, n::INTEGER AS idx, start_ms, end_ms, content FROM sorted)",
    "struct_pack(e := w.e, t := w.t) AS new",
    f"({_GAP} > 1 AND {_GAP} <= 85) OR NOT {_BLANK('r.content')} AS push, CASE WHEN {_GAP} > 1 AND {_GAP} <= 85 THEN r.start_ms - 1 ELSE w.e END AS cut",
)
_ALIASES = " ".join(f"WHEN {{x}} IN ({', '.join(re2.literal(n) for n in names)}) THEN '{code}'" for code, names in m.ALIASES.items())


def _alias(x: str) -> str:
    return f"CASE {_ALIASES.format(x=x)} END"


ORACLES = {
    "mend_references": f"WITH {CUES} SELECT file_id, seq, {decoded('content')} AS content FROM cues WHERE contains(content, '&')",
    "fix_time_codes": f"""WITH {CUES}, first AS (SELECT file_id, min(seq) AS at, arg_min(start_ms // 3600000, seq) AS h FROM cues WHERE start_ms // 3600000 > 23 GROUP BY file_id)
      SELECT c.file_id, c.seq, c.start_ms - CASE WHEN c.seq >= f.at THEN f.h * 3600000 ELSE 0 END AS start_ms, c.end_ms - CASE WHEN c.seq >= f.at THEN f.h * 3600000 ELSE 0 END AS end_ms
      FROM cues c LEFT JOIN first f USING (file_id)""",
    "global_tags": f"""WITH {CUES}, tagged AS (SELECT *, starts_with(content, '<i>') AND ends_with(content, '</i>') AS it FROM cues WHERE content LIKE '<i>%</i>' OR content LIKE '{{\\an8}}%'),
      flags AS (SELECT file_id, count(*) > 10 AND bool_and(it) AS strip, count(*) AS n FROM tagged GROUP BY file_id),
      bare AS (SELECT file_id, seq, n, CASE WHEN strip THEN substr(content, 4, length(content) - 7) ELSE content END AS content FROM tagged JOIN flags USING (file_id)),
      tops AS (SELECT file_id, n > 100 AND bool_and(starts_with(content, '{{\\an8}}')) AS top FROM bare GROUP BY file_id, n)
      SELECT file_id, seq, CASE WHEN top THEN substr(content, 7) ELSE content END AS content FROM bare JOIN tops USING (file_id)""",
    "mend_rules": f"WITH {CUES}, tried AS ("
    + " UNION ALL ".join(f"SELECT {re2.literal(r.name)} AS rule, file_id, seq, content AS old, {re2.replace('content', r)} AS content FROM cues" for r in _CHECKED)
    + ") SELECT rule, file_id, seq, content FROM tried WHERE content <> old",
    "combine_timecodes": _combine(True),
    "combine_keeping_gaps": _combine(False),
    "short_gaps": _GAPS,
    "language_codes": f"""WITH l AS (SELECT file_id, lower(trim(lang)) AS low FROM caption_file),
      b AS (SELECT file_id, low, trim(split_part(low, '(', 1)) AS bare FROM l),
      p AS (SELECT *, trim(regexp_extract(bare, '^([^-_]*)', 1)) AS prim, regexp_extract(bare, '^([^ ]*)', 1) AS word FROM b)
      SELECT file_id, CASE WHEN low <> '' AND prim <> '' THEN coalesce({_alias('bare')}, {_alias('prim')}, {_alias('word')}, prim) END AS code FROM p""",
    "rtl_marks": f"WITH {CUES} SELECT file_id, seq, chr(8235) || replace(regexp_replace(content, '[\\x{{200e}}\\x{{200f}}\\x{{202a}}-\\x{{202e}}]', '', 'g'), chr(10), chr(10) || chr(8235)) AS content FROM cues",
}
