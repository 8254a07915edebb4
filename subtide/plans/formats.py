"""Queries over raw caption files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.operators.mend import mend
from subtide.sources import captions as s
from subtide.sources.sink import converted_name, with_suffix


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/caption_file.parquet").select("file_id", "path", "content")


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detected format of every file with content, and its shown name."""
    form = s.detect_format(F.col("content"))
    return _files(spark, sf_dir).where("content is not null").select("file_id", form.alias("format"), s.display_name(form).alias("name"))


def _parse(form: str, chosen: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = _files(spark, sf_dir).where(chosen(F.col("content")) if form != "srt" else F.lower("path").endswith(".srt"))
        return s.cues_of(s.parse_captions(files, "file_id", form=form), "file_id")

    return query


def parse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file by its own format, SubRip by its name; files that can't be read with their error."""
    form = F.coalesce(s.detect_format(F.col("content")), F.when(F.lower("path").endswith(".srt"), "srt"))
    return s.parse_captions(_files(spark, sf_dir), "file_id", form=form)


def convert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files converted and repaired."""
    return mend(s.cues_of(parse_all(spark, sf_dir), "file_id"))


def _size(payload: Column) -> Column:
    return F.unhex(F.lpad(F.hex(F.octet_length(payload) + 8), 8, "0"))


def _box(kind: str, payload: Column) -> Column:
    return F.concat(_size(payload), F.lit(kind.encode()), payload)


def _word(value: Column, width: int = 8) -> Column:
    return F.unhex(F.lpad(F.hex(value), width, "0"))




def _mp4(*boxes: Column) -> Column:
    return F.concat(F.lit((28).to_bytes(4) + b"ftyp" + bytes(20)), *boxes)


def ismt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TTML files within MP4 fragments."""
    ttml = _files(spark, sf_dir).where(s.detect_format(F.col("content")) == "ttml")
    boxed = ttml.select("file_id", _mp4(_box("moof", F.lit(b"")), _box("mdat", F.col("content"))).alias("content"))
    return s.cues_of(s.parse_captions(boxed, "file_id"), "file_id")


def wvtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cue of the table as a file of two samples, an empty one before its own."""
    cues = spark.read.parquet(f"{sf_dir}/cue.parquet").where("start_ms >= 0 and end_ms > start_ms").select("file_id", "seq", "start_ms", "end_ms").distinct()
    run = F.concat(F.lit(bytes([0, 0, 1, 0])), _word(F.lit(2)), _word(F.col("start_ms")), _word(F.col("end_ms") - F.col("start_ms")))
    said = F.encode(F.concat(F.lit("cue "), F.col("seq").cast("string")), "UTF-8")
    media = F.concat(_box("vtte", F.lit(b"")), _box("vttc", _box("payl", said)))
    name = F.concat_ws(":", F.col("file_id").cast("string"), F.col("seq").cast("string"), F.col("start_ms").cast("string"), F.col("end_ms").cast("string"))
    moof = _box("moof", F.concat(_box("tfdt", F.concat(F.lit(bytes(4)), _word(F.lit(0)))), _box("trun", run)))
    files = cues.select(name.alias("name"), _mp4(moof, _box("mdat", media)).alias("content"))
    return s.cues_of(s.parse_captions(files, "name", form="wvtt"), "name").select("file_id", "start_ms", "end_ms", "content")


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _files(spark, sf_dir).select("file_id", converted_name(path).alias("converted"), with_suffix(path, "_mend").alias("mended"), with_suffix(path, "_sdh_stripped").alias("stripped"))


def _detected(form: str) -> Callable[[Column], Column]:
    return lambda c: s.detect_format(c) == form


QUERIES = {
    "detect_format": formats,
    "srt_parse": _parse("srt", _detected("srt")),
    "vtt_parse": _parse("webvtt", _detected("webvtt")),
    "sami_parse": _parse("sami", _detected("sami")),
    "ttml_parse": _parse("ttml", _detected("ttml")),
    "bilibili_parse": _parse("bilibili", _detected("bilibili")),
    "parse_all": parse_all,
    "convert_all": convert_all,
    "ismt_parse": ismt,
    "wvtt_parse": wvtt,
    "output_names": output_names,
}

_HAS = "contains(content::VARCHAR, '{}')".format
_MP4 = f"{_HAS('mdat')} AND {_HAS('moof')}"
_FORMAT = f"""CASE WHEN {_MP4} AND {_HAS('</tt>')} THEN 'ismt' WHEN {_MP4} AND {_HAS('vttc')} THEN 'wvtt' WHEN {_MP4} THEN NULL WHEN {_HAS('<SAMI>')} THEN 'sami'
  WHEN {_HAS('</tt>')} OR {_HAS('</tt:tt>')} THEN 'ttml' WHEN {_HAS('WEBVTT')} THEN 'webvtt'
  WHEN starts_with(content::VARCHAR, '{{') AND {_HAS('Stroke')} AND {_HAS('background_color')} THEN 'bilibili' END"""
_W = "[\\t-\\r \\x{85}\\p{Z}]"
_TIME = "([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3}) --> ([0-9]{2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{3})"


def _ms(group: int) -> str:
    h, m, s_, ms = (f"regexp_extract(bare, '{_TIME}', {group + i})::BIGINT" for i in range(4))
    return f"(({h} * 60 + {m}) * 60 + {s_}) * 1000 + {ms}"


_TEXTS = "SELECT file_id, TRY(decode(content)) AS text FROM caption_file WHERE content IS NOT NULL AND {} = '{}'"


def _trim(sql: str) -> str:
    return f"regexp_replace({sql}, '^{_W}+|{_W}+\\z', '', 'g')"


#: The references that stand in the data, each decoded once; the sign they begin with comes last.
_NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "hellip": "…", "#8211": "–", "amp": "&"}


def decoded(sql: str) -> str:
    """A text with its references decoded once."""
    for name, char in _NAMED.items():
        sql = f"replace({sql}, '&{name};', chr({ord(char)}))"
    return sql


def _clock(x: str) -> str:
    """Milliseconds of HH:MM:SS.mmm."""
    return f"((split_part({x}, ':', 1)::BIGINT * 60 + split_part({x}, ':', 2)::BIGINT) * 60 + split_part(split_part({x}, ':', 3), '.', 1)::BIGINT) * 1000 + split_part({x}, '.', 2)::BIGINT"


_TTML = f"""WITH f AS ({_TEXTS.format(_FORMAT, 'ttml')}),
  p AS (SELECT file_id, unnest(regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)), '(?s)<p [^>]*>.*?</p>')) AS p,
    generate_subscripts(regexp_extract_all(replace(text, chr(13) || chr(10), chr(10)), '(?s)<p [^>]*>.*?</p>'), 1) AS n FROM f),
  c AS (SELECT file_id, n, regexp_extract(p, 'begin="([^"]*)"', 1) AS b, regexp_extract(p, 'end="([^"]*)"', 1) AS e,
    {_trim(decoded("replace(regexp_extract(p, '(?s)^<p [^>]*>(.*)</p>$', 1), '<br/>', chr(10))"))} AS content FROM p)
  SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY n) AS seq, n::INTEGER AS idx, {_clock('b')} AS start_ms, {_clock('e')} AS end_ms, content FROM c WHERE content <> ''"""

ORACLES = {
    "ttml_parse": _TTML,
    "ismt_parse": _TTML,
    # The last tag that was opened routes each text; a blank sync ends the cue before it.
    "sami_parse": f"""WITH f AS ({_TEXTS.format(_FORMAT, 'sami')}),
      x AS (SELECT file_id, regexp_extract_all(replace(replace(replace(replace(replace(ltrim(text, chr(65279)), '<i/>', '<i>'), ';>', '>'), '<br>', chr(10)), '<br/>', chr(10)), '<br >', chr(10)), '<[^>]*>|[^<]+|<') AS ts FROM f),
      t AS (SELECT file_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM x),
      k AS (SELECT *, CASE WHEN tok LIKE '<%>' AND NOT tok LIKE '</%' THEN lower(regexp_extract(tok, '^<[ ]*([^ >]*)', 1)) END AS opened, tok LIKE '<%>' AS is_tag FROM t),
      g AS (SELECT *, last_value(opened IGNORE NULLS) OVER w AS tag, sum(CASE WHEN opened = 'sync' THEN 1 ELSE 0 END) OVER w AS n FROM k WINDOW w AS (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
      s AS (SELECT file_id, n, trunc(max(CASE WHEN opened = 'sync' THEN TRY_CAST(regexp_extract(tok, '(?i)start="?([0-9.]+)', 1) AS DOUBLE) END)) AS start,
        {_trim("coalesce(string_agg(CASE WHEN tag = 'br' THEN chr(10) WHEN tag = 'i' AND trim(tok) <> '' THEN '<i>' || tok || '</i>' ELSE tok END, '' ORDER BY pos) FILTER (NOT is_tag AND tag <> 'sync'), '')")} AS content
        FROM g WHERE n > 0 GROUP BY file_id, n),
      r AS (SELECT *, sum(CASE WHEN content <> '' AND start IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS m FROM s),
      e AS (SELECT file_id, m, max_by(start, n) FILTER (content = '' AND start IS NOT NULL) AS stop FROM r GROUP BY file_id, m)
      SELECT file_id, m::BIGINT AS seq, m::INTEGER AS idx, start::BIGINT AS start_ms, coalesce(stop, start + 4000)::BIGINT AS end_ms, content FROM r JOIN e USING (file_id, m) WHERE content <> '' AND start IS NOT NULL""",
    # A text belongs to the time line before it, up to the blank line behind its first text line.
    "vtt_parse": f"""WITH f AS ({_TEXTS.format(_FORMAT, 'webvtt')}),
      l AS (SELECT file_id, {_trim('unnest(string_split(text, chr(10)))')} AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM f),
      k AS (SELECT *, CASE WHEN line = '' THEN 'B' WHEN line LIKE '% --> %' THEN 'T' ELSE 'X' END AS kind FROM l
        WHERE NOT (starts_with(line, 'WEBVTT') OR starts_with(line, 'NOTE') OR starts_with(line, '/*') OR starts_with(line, 'X-TIMESTAMP-MAP'))),
      t AS (SELECT *, max(CASE WHEN kind = 'T' THEN pos END) OVER (PARTITION BY file_id ORDER BY pos) AS t FROM k),
      x AS (SELECT *, min(CASE WHEN kind = 'X' THEN pos END) OVER (PARTITION BY file_id, t) AS x1 FROM t WHERE t IS NOT NULL),
      b AS (SELECT *, min(CASE WHEN kind = 'B' AND pos > x1 THEN pos END) OVER (PARTITION BY file_id, t) AS b1 FROM x),
      h AS (SELECT file_id, t, max(CASE WHEN pos = t THEN line END) AS head FROM b GROUP BY file_id, t),
      p AS (SELECT *, TRY_CAST(regexp_extract(head, ' line:([0-9.]+)%', 1) AS DOUBLE) AS place FROM h),
      c AS (SELECT p.file_id, p.t, any_value(head) AS head, any_value(place) AS place,
        string_agg({_trim(f"CASE WHEN place < 25 AND pos = x1 THEN '{{\\an8}}' ELSE '' END || {decoded('line')}")}, chr(10) ORDER BY pos) FILTER (kind = 'X' AND (b1 IS NULL OR pos < b1)) AS said
        FROM p JOIN b USING (file_id, t) GROUP BY p.file_id, p.t),
      d AS (SELECT *, {_clock("split_part(head, ' ', 1)")} AS start_ms, {_clock("split_part(head, ' ', 3)")} AS end_ms,
        replace(replace(regexp_replace(replace(replace(coalesce(said, ''), '<i>', chr(57344)), '</i>', chr(57345)), '</?[^>\\s]+>', '', 'g'), chr(57344), '<i>'), chr(57345), '</i>') AS content FROM c),
      n AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, coalesce(place, 100), t) AS n FROM d)
      SELECT file_id, n AS seq, n::INTEGER AS idx, start_ms, end_ms, content FROM n""",
    "detect_format": f"""WITH f AS (SELECT file_id, {_FORMAT} AS format FROM caption_file WHERE content IS NOT NULL)
      SELECT file_id, format, CASE format {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in s.DISPLAY.items())} END AS name FROM f""",
    # The parse as windows over lines: a text belongs to the last time line, up to a line of digits behind its first text line.
    "srt_parse": rf"""WITH files AS (SELECT file_id, TRY(decode(content)) AS text FROM caption_file WHERE content IS NOT NULL AND lower(path) LIKE '%.srt'),
      lines AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM files WHERE text IS NOT NULL),
      kinds AS (SELECT file_id, pos, rtrim(line, chr(13)) AS line, regexp_replace(line, '^{_W}+|{_W}+$', '', 'g') AS bare FROM lines),
      typed AS (SELECT *, CASE WHEN regexp_full_match(bare, '[0-9]+') THEN 'I' WHEN regexp_matches(bare, '{_TIME}') THEN 'T' ELSE 'X' END AS kind FROM kinds WHERE bare <> ''),
      timed AS (SELECT *, max(CASE WHEN kind = 'T' THEN pos END) OVER (PARTITION BY file_id ORDER BY pos) AS t FROM typed),
      firsts AS (SELECT *, min(CASE WHEN kind = 'X' THEN pos END) OVER (PARTITION BY file_id, t) AS x1 FROM timed),
      ends AS (SELECT *, min(CASE WHEN kind = 'I' AND pos > x1 THEN pos END) OVER (PARTITION BY file_id, t) AS i1 FROM firsts WHERE t IS NOT NULL),
      blocks AS (SELECT file_id, t, x1, min(i1) AS i1, string_agg(line, chr(10) ORDER BY pos) FILTER (kind = 'X' AND (i1 IS NULL OR pos < i1)) AS content FROM ends WHERE x1 IS NOT NULL GROUP BY file_id, t, x1),
      flush AS (SELECT *, least(i1, lead(t) OVER (PARTITION BY file_id ORDER BY t)) AS f, row_number() OVER (PARTITION BY file_id ORDER BY t) AS seq FROM blocks),
      since AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY file_id ORDER BY t), 0) AS from_at FROM flush),
      stated AS (SELECT s.file_id, s.t, max_by(i.bare::BIGINT, i.pos) AS idx FROM since s JOIN typed i ON i.file_id = s.file_id AND i.kind = 'I' AND i.pos >= s.from_at AND i.pos < s.x1 GROUP BY ALL)
      SELECT s.file_id, s.seq, CASE WHEN coalesce(g.idx, 0) = 0 THEN s.seq ELSE g.idx END::INTEGER AS idx, {_ms(1)} AS start_ms, {_ms(5)} AS end_ms, s.content
      FROM since s JOIN typed k ON k.file_id = s.file_id AND k.pos = s.t LEFT JOIN stated g ON g.file_id = s.file_id AND g.t = s.t""",
    "bilibili_parse": f"""WITH f AS (SELECT file_id, TRY(decode(content))::JSON AS j FROM caption_file WHERE content IS NOT NULL AND {_FORMAT} = 'bilibili'),
      items AS (SELECT file_id, unnest((j->'$.body')::JSON[]) AS item, generate_subscripts((j->'$.body')::JSON[], 1) AS seq FROM f)
      SELECT file_id, seq, seq::INTEGER AS idx, trunc((item->>'from')::DOUBLE * 1000)::BIGINT AS start_ms, trunc((item->>'to')::DOUBLE * 1000)::BIGINT AS end_ms,
        CASE WHEN item->>'location' = '2' THEN '' ELSE '{{\\an' || (item->>'location') || '}}' END || (item->>'content') AS content FROM items""",
    "wvtt_parse": """SELECT DISTINCT file_id || ':' || seq || ':' || start_ms || ':' || end_ms AS file_id, trunc(start_ms::DOUBLE / 1000 * 1000)::BIGINT AS start_ms,
      trunc(end_ms::DOUBLE / 1000 * 1000)::BIGINT AS end_ms, 'cue ' || seq AS content FROM cue WHERE start_ms >= 0 AND end_ms > start_ms""",
    "output_names": r"""SELECT file_id, regexp_replace(path, '\.[^./]*$', '') || '.srt' AS converted, regexp_replace(path, '(\.[^./]+)$', '_mend\1') AS mended,
      regexp_replace(path, '(\.[^./]+)$', '_sdh_stripped\1') AS stripped FROM caption_file""",
}

_COLUMNS = "file_id, '{form}' AS format, seq, idx, start_ms, end_ms, content, NULL::VARCHAR AS error_kind, NULL::VARCHAR AS error"
ORACLES["parse_all"] = " UNION ALL ".join(
    [f"SELECT {_COLUMNS.format(form=form)} FROM ({ORACLES[query]})" for form, query in (("srt", "srt_parse"), ("webvtt", "vtt_parse"), ("sami", "sami_parse"), ("ttml", "ttml_parse"), ("bilibili", "bilibili_parse"))]
    + [
        "SELECT file_id, 'srt', NULL, NULL, NULL, NULL, NULL, 'io', 'the file is not valid UTF-8' FROM caption_file "
        "WHERE content IS NOT NULL AND lower(path) LIKE '%.srt' AND TRY(decode(content)) IS NULL"
    ]
)
