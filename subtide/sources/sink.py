"""Writing of cues as SubRip files."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from subtide.functions.encodings import encode_text
from subtide.operators.cues import export_srt


def encoded_parts(cues: DataFrame, encoding: str = "utf-8", eol: str = "\n") -> DataFrame:
    """(file_id, part_no, data): the files' bytes, in parts; the mark of an encoding stands before the first."""
    parts = export_srt(cues, eol)
    return parts.select("file_id", "part_no", encode_text(F.col("text"), encoding, F.col("part_no") == 0).alias("data"))


def with_suffix(path: Column, suffix: str) -> Column:
    """A path with a suffix before its extension, if it has one."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    cut = F.when(name.rlike(r"[^/]\.[^./]+\z"), F.regexp_replace(path, r"(\.[^./]+)\z", f"{suffix}$1"))
    return F.coalesce(cut, F.concat(path, F.lit(suffix)))


def converted_name(path: Column) -> Column:
    """A path with ``.srt`` in place of its extension."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*\z", ""), F.lit(".srt"))


def write_srt(cues: DataFrame, paths: DataFrame, encoding: str = "utf-8", eol: str = "\n") -> None:
    """Writes the file of each (file_id, out) in paths; out is a path that all executors reach.

    A file's parts stream to one task in order and are appended under another
    name, which becomes the file's own when the last is written; so a task
    that fails and runs again leaves no half file. Files without a cue to
    write become empty files.
    """
    data = paths.select("file_id", "out").join(encoded_parts(cues, encoding, eol), "file_id", "left")

    def write(rows: Iterator[Row]) -> None:
        name, file = None, None
        for row in rows:
            if row.out != name:
                if file:
                    file.close()
                    os.replace(file.name, name)
                name = row.out
                os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
                file = open(f"{name}.{os.getpid()}.part", "wb")  # noqa: SIM115
            if row.data is not None:
                file.write(row.data)
        if file:
            file.close()
            os.replace(file.name, name)

    data.repartition("out").sortWithinPartitions("out", "part_no").foreachPartition(write)
