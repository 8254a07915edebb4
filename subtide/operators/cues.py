"""Cue sets: one row per cue (file_id, seq, idx, start_ms, end_ms, content).

seq is the place in the file's list, dense within a file. Operators keep the
files apart and leave other columns behind unless they say so. A file may own
any share of the rows, so nothing here orders a whole file in one task: order
is taken within slices of time or blocks of seq, and the slices are joined by
a small table with a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.functions.timecode import srt_stamp
from subtide.operators.stages import cut

COLUMNS = ["file_id", "seq", "idx", "start_ms", "end_ms", "content"]
#: Width of a slice of time, and size of a block of places.
SLICE_MS = 3_600_000
BLOCK = 1024
#: Cues in one part of an exported file.
PART = 2000


def as_cues(df: DataFrame) -> DataFrame:
    """The cues of a table: delivered once each, with file, seq and both times.

    A cue delivered again counts once, as its earliest values. A null idx is 0
    and a null content empty; rows without file, seq or a time are no cues.
    """
    return (
        df.dropna(subset=["file_id", "seq", "start_ms", "end_ms"])
        .groupBy("file_id", "seq")
        .agg(F.min(F.struct(F.coalesce("idx", F.lit(0)).alias("idx"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.coalesce("content", F.lit("")).alias("content"))).alias("_v"))
        .select("file_id", "seq", "_v.idx", "_v.start_ms", "_v.end_ms", "_v.content")
    )


def relist(df: DataFrame, order: list[str], seq: str = "seq", once: bool = False) -> DataFrame:
    """df with seq made dense from 1 within each file, in an order that begins with start_ms or seq.

    df is used twice, the second time for the counts of the slices; once
    writes it between (see ``cut``), for a df that costs more than a scan.
    """
    head = order[0]
    width = SLICE_MS if head == "start_ms" else BLOCK
    sliced = df.withColumn("_slice", F.floor(F.col(head) / F.lit(width)))
    inside = Window.partitionBy("file_id", "_slice").orderBy(*order)
    numbered = sliced.withColumn("_n", F.row_number().over(inside)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("file_id", "_slice")))
    if once:
        numbered = cut(numbered)
    # One row per slice: the cues of the file's earlier slices.
    before = Window.partitionBy("file_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.where("_n = 1").select("file_id", "_slice", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    )
    return numbered.join(starts, ["file_id", "_slice"]).withColumn(seq, F.col("_before") + F.col("_n")).drop("_slice", "_n", "_all", "_before")


def sort_cues(cues: DataFrame, once: bool = False) -> DataFrame:
    """Cues in order of (start, end, idx, place); seq and idx count from 1."""
    listed = relist(cues, ["start_ms", "end_ms", "idx", "seq"], "_place", once)
    return listed.withColumn("idx", F.col("_place").cast("int")).withColumn("seq", F.col("_place")).drop("_place")


def exportable(cues: DataFrame) -> DataFrame:
    """Cues that end after they start; the others are never written."""
    return cues.where(F.col("start_ms") < F.col("end_ms"))


def shift(cues: DataFrame, offset_ms: int | Column) -> DataFrame:
    """Both times moved by an offset."""
    by = offset_ms if isinstance(offset_ms, Column) else F.lit(offset_ms)
    return cues.withColumn("start_ms", F.col("start_ms") + by).withColumn("end_ms", F.col("end_ms") + by)


def with_duration(cues: DataFrame) -> DataFrame:
    """duration_ms = end - start, negative where a cue ends before it starts."""
    return cues.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def count_cues(cues: DataFrame) -> DataFrame:
    """(file_id, n_cues) of each file with a cue."""
    return cues.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_cues"))


def cue_at(cues: DataFrame, place: int, order: str = "seq") -> DataFrame:
    """The cue at a place (from 0) of each file's list; files without one give none."""
    return relist(cues, [order], "_place").where(F.col("_place") == place + 1).drop("_place")


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists, the second behind the first, file by file."""
    last = first.groupBy("file_id").agg(F.max("seq").alias("_last"))
    moved = second.join(last, "file_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")
    return first.unionByName(moved)


def block_text(cues: DataFrame, eol: str = "\n") -> DataFrame:
    """(file_id, position, block): each cue as it is written, in the order of writing."""
    listed = relist(exportable(cues), ["start_ms", "end_ms", "idx", "seq"], "position")
    content = F.regexp_replace("content", "\r\n|\r", "\n")
    content = content if eol == "\n" else F.replace(content, F.lit("\n"), F.lit(eol))
    line = F.concat(F.col("position").cast("string"), F.lit(eol), srt_stamp(F.col("start_ms")), F.lit(" --> "), srt_stamp(F.col("end_ms")), F.lit(eol), content, F.lit(eol * 2))
    return listed.select("file_id", "position", line.alias("block"))


def export_srt(cues: DataFrame, eol: str = "\n", part: int = PART) -> DataFrame:
    """(file_id, part_no, text): the files as SubRip text, in parts of so many cues.

    The text of a file is its parts in order; a part holds at most ``part``
    cues, so an endless file never becomes one value. Files without a cue to
    write give no row.
    """
    parts = block_text(cues, eol).withColumn("part_no", F.floor((F.col("position") - 1) / F.lit(part)))
    lines = F.array_sort(F.collect_list(F.struct("position", "block")))
    return parts.groupBy("file_id", "part_no").agg(F.array_join(F.transform(lines, lambda x: x["block"]), "").alias("text"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, changed): whether a file's written text differs; files of either side."""
    marks = [block_text(df).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("position", "block").cast("decimal(38,0)")).alias("h")) for df in (before, after)]
    files = before.select("file_id").union(after.select("file_id")).distinct()
    a, b = (m.select("file_id", F.col("n").alias(f"n{i}"), F.col("h").alias(f"h{i}")) for i, m in enumerate(marks))
    both = files.join(a, "file_id", "left").join(b, "file_id", "left")
    return both.select("file_id", (~(F.col("n0").eqNullSafe(F.col("n1")) & F.col("h0").eqNullSafe(F.col("h1")))).alias("changed"))
