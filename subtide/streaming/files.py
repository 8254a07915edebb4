"""Conversion of files as they arrive.

A caption file is whole when it arrives, so parsing runs on the stream itself;
what orders or compares the cues of a file runs per batch, which holds whole
files. Offsets and output are kept by the checkpoint folder the caller names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from subtide.sources.captions import cues_of, parse_captions, stream_files


def stream_cues(spark: SparkSession, directory: str, form: str | None = None) -> DataFrame:
    """A stream of the cues of the files that arrive in a directory."""
    return cues_of(parse_captions(stream_files(spark, directory), form=form))


def process_stream(
    spark: SparkSession,
    directory: str,
    out: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame],
    form: str | None = None,
) -> StreamingQuery:
    """Writes the processed cues of arriving files as parquet, a folder per batch; a batch that runs again replaces its own."""

    def batch(cues: DataFrame, number: int) -> None:
        process(cues).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_cues(spark, directory, form).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
