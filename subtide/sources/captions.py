"""Caption files as DataFrames: detection of the format, and parsing into cues."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.sources.formats import CaptionError, Cue, as_text
from subtide.sources.formats.mp4 import parse_ismt, parse_wvtt
from subtide.sources.formats.sami import parse_sami
from subtide.sources.formats.srt import parse_srt
from subtide.sources.formats.ttml import parse_ttml
from subtide.sources.formats.webvtt import parse_webvtt

#: Names of the formats as they are shown. SubRip is never detected, only asked for.
DISPLAY = {
    "ismt": "ISMT (DFXP in MP4)",
    "wvtt": "WVTT (WebVTT in MP4)",
    "sami": "SAMI",
    "ttml": "DFXP/TTML/TTML2",
    "webvtt": "WebVTT",
    "bilibili": "JSON (Bilibili)",
    "srt": "SubRip",
}
_PARSERS: dict[str, Callable[[bytes], list[Cue]]] = {
    "srt": lambda b: parse_srt(as_text(b)),
    "webvtt": lambda b: parse_webvtt(as_text(b)),
    "sami": lambda b: parse_sami(as_text(b)),
    "ttml": lambda b: parse_ttml(as_text(b)),
    "ismt": parse_ismt,
    "wvtt": parse_wvtt,
}
_BODY = "body array<struct<`from`:double,`to`:double,location:bigint,content:string>>"


def detect_format(content: Column) -> Column:
    """The format of a file's bytes; null for plain SubRip and anything else unknown."""

    def has(text: str) -> Column:
        return F.contains(content, F.lit(text.encode()))

    mp4 = has("mdat") & has("moof")
    return (
        F.when(mp4 & has("</tt>"), "ismt")
        .when(mp4 & has("vttc"), "wvtt")
        .when(mp4, F.lit(None).cast("string"))
        .when(has("<SAMI>"), "sami")
        .when(has("</tt>") | has("</tt:tt>"), "ttml")
        .when(has("WEBVTT"), "webvtt")
        .when(F.startswith(content, F.lit(b"{")) & has('"Stroke"') & has('"background_color"'), "bilibili")
    )


def display_name(form: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in DISPLAY.items() for x in pair)), form)


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of files, directories or globs; any length."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files that arrive in a directory, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "content")


def parse_bilibili(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Cues of JSON bodies, Java-side; a body or an item that lacks a field is an error of the file.

    Times are cut to milliseconds; a location but 2 becomes a position tag.
    """
    text = F.col(content).cast("string")
    parsed = df.select(F.col(key), F.from_json(text, _BODY, {"mode": "PERMISSIVE"}).alias("_j"))
    whole = F.col("_j.body").isNotNull() & F.forall(
        "_j.body", lambda c: c["from"].isNotNull() & c["to"].isNotNull() & c["content"].isNotNull() & c["location"].between(0, 2**32 - 1)
    )
    none = F.array(F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("from", "double"), ("to", "double"), ("location", "long"), ("content", "string")))))
    good = F.coalesce(whole, F.lit(False))
    rows = parsed.select(key, good.alias("_good"), F.posexplode(F.when(good, F.col("_j.body")).otherwise(none)).alias("_at", "_c"))
    at = F.when(F.col("_good"), F.col("_at") + 1)
    return rows.select(
        key,
        F.lit("bilibili").alias("format"),
        at.cast("long").alias("seq"),
        at.cast("int").alias("idx"),
        (F.col("_c.from") * 1000.0).cast("long").alias("start_ms"),
        (F.col("_c.to") * 1000.0).cast("long").alias("end_ms"),
        F.when(F.col("_c.location") == 2, F.col("_c.content")).otherwise(F.concat(F.lit("{\\an"), F.col("_c.location").cast("string"), F.lit("}"), F.col("_c.content"))).alias("content"),
        F.when(~F.col("_good"), "parse").alias("error_kind"),
        F.when(~F.col("_good"), "Invalid JSON format").alias("error"),
    )


def parse_captions(df: DataFrame, key: str = "path", content: str = "content", form: str | Column | None = None) -> DataFrame:
    """(key, format, seq, idx, start_ms, end_ms, content, error_kind, error): the cues of files.

    form names the format of all files, or is a column; left out, it is
    detected. A file that can't be read, or whose format is unknown, gives one
    row with an error and no cue; null contents and files without cues give no
    row. One pass over the files: a file is a row, so nothing is shuffled.
    """
    chosen = detect_format(F.col(content)) if form is None else (form if isinstance(form, Column) else F.lit(form))
    files = df.where(F.col(content).isNotNull()).select(key, chosen.alias("_form"), F.col(content).cast("binary").alias("_bytes"))
    schema = T.StructType(
        [
            df.schema[key],
            T.StructField("format", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("idx", T.IntegerType()),
            T.StructField("start_ms", T.LongType()),
            T.StructField("end_ms", T.LongType()),
            *(T.StructField(c, T.StringType()) for c in ("content", "error_kind", "error")),
        ]
    )
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def rows(form: str | None, data: bytes) -> Iterator[tuple]:
        try:
            if form not in _PARSERS:
                raise CaptionError("format", "Unknown subtitle format")
            for seq, (idx, start, end, text) in enumerate(_PARSERS[form](data), 1):
                yield form, seq, idx if idx < 2**31 else idx - 2**32, start, end, text, None, None
        except CaptionError as error:
            yield form, None, None, None, None, None, error.kind, error.message

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (form, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for row in rows(form, data):
                    at.append(i)
                    out.append(row)
            cols = list(zip(*out, strict=True)) or [()] * len(types)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=schema.names)

    json = F.col("_form").eqNullSafe(F.lit("bilibili"))
    return files.where(~json).mapInArrow(run, schema).unionByName(parse_bilibili(files.where(json), key, "_bytes"))


def cues_of(parsed: DataFrame, key: str = "path") -> DataFrame:
    """The cues of parsed files, by file_id."""
    return parsed.where("error_kind is null").select(F.col(key).alias("file_id"), "seq", "idx", "start_ms", "end_ms", "content")


def errors_of(parsed: DataFrame, key: str = "path") -> DataFrame:
    """(file_id, format, error_kind, error) of the files that couldn't be read."""
    return parsed.where("error_kind is not null").select(F.col(key).alias("file_id"), "format", "error_kind", "error")
