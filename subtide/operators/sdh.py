"""Cues without annotations for the hard of hearing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.functions.sdhtext import with_stripped_text
from subtide.operators.cues import COLUMNS, sort_cues


def check_patterns(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """The patterns, if all are valid; else ValueError names the first that is not."""
    patterns = list(patterns)
    for p in patterns:
        try:
            spark.range(1).select(F.regexp_replace(F.lit("x"), p, "")).collect()
        except Exception as error:
            raise ValueError(f"invalid pattern: {p}") from error
    return patterns


def strip_sdh(cues: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Cues with their annotations taken out, those with nothing left gone, sorted and renumbered.

    extra are patterns whose matches go as well; an invalid one is an error
    before anything runs. Empty tables give empty tables.
    """
    extra = check_patterns(cues.sparkSession, extra)
    bare = with_stripped_text(cues.select(*COLUMNS), "content", extra)
    # explode drops the texts that are null, without a filter that would compute them again.
    left = F.explode(F.array_compact(F.array("content"))).alias("content")
    return sort_cues(bare.select(*COLUMNS[:-1], left), once=True)
