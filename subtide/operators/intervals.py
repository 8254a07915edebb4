"""Overlapping and gapped time intervals per entity.

Intervals of one entity overlap, nest, touch and leave holes.
``merge_intervals`` returns the longest stretches covered without a break,
``interval_gaps`` the holes between them.

The merge is Spark's own ``session_window`` with a duration per row: a row
opens the session [start, start + (end - start)) and overlapping sessions are
merged inside the sort-based session aggregation, without a buffer of rows.

An entity may own any share of the rows, so the session aggregation runs per
(entity, slice of time) and the slices are then stitched through a table with
one row per slice: a session joins its predecessor when an earlier slice ends
at or after its start. Beyond the first shuffle only sessions and slice rows
move, and no task ever sees a whole entity's intervals.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slice of time. It only sets the grain of parallelism.
SLICE_MS = 3_600_000


def valid_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows with both bounds and a positive length, as (keys, _s, _e)."""
    return df.select(
        *keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e")
    ).where(F.col("_s").isNotNull() & F.col("_e").isNotNull() & (F.col("_e") > F.col("_s")))


def _sessions(rows: DataFrame, keys: list[str], slice_ms: int) -> DataFrame:
    """Sessions per (keys, slice); touching sessions may still be apart."""
    sliced = rows.select(
        *keys,
        F.expr(f"cast(floor(_s / {slice_ms}D) as bigint)").alias("_slice"),
        F.timestamp_millis("_s").alias("_ts"),
        F.expr("make_interval(0, 0, 0, 0, 0, 0, (_e - _s) / 1000.0)").alias("_len"),
    )
    return (
        sliced.groupBy(*keys, "_slice", F.session_window("_ts", F.col("_len")).alias("_w"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_slice",
            F.unix_millis("_w.start").alias("_s"),
            F.unix_millis("_w.end").alias("_e"),
        )
    )


def _starts(rows: DataFrame, keys: list[str], slice_ms: int) -> DataFrame:
    """The session that opens each period: (keys, _slice, _s, _before, _last).

    _before is where the period before it ended (null for the first of the
    entity), _last the end of the entity's last period.
    """
    # Kept, so that the slices and the sessions come from one reading of the rows.
    sessions = _sessions(rows, keys, slice_ms).persist(StorageLevel.MEMORY_AND_DISK)
    over_slices = Window.partitionBy(*keys).orderBy("_slice")
    slices = (
        sessions.groupBy(*keys, "_slice")
        .agg(F.max("_e").alias("_top"))
        .select(
            *keys,
            "_slice",
            F.max("_top").over(over_slices.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"),
            F.max("_top").over(Window.partitionBy(*keys)).alias("_last"),
        )
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy("_s", "_e")
    known = F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        sessions.withColumn("_known", known)
        .join(slices, [*keys, "_slice"])
        .withColumn("_before", F.greatest("_known", "_carry"))
        .where(F.col("_before").isNull() | (F.col("_s") > F.col("_before")))
        .select(*keys, "_slice", "_s", "_before", "_last")
    )


def _periods(df: DataFrame, keys: list[str], start: str, end: str, slice_ms: int) -> DataFrame:
    """(keys, _s, _e, _next): each period and the start of the entity's next one."""
    starts = _starts(valid_intervals(df, keys, start, end), keys, slice_ms).persist(StorageLevel.MEMORY_AND_DISK)
    over_slices = Window.partitionBy(*keys).orderBy("_slice")
    inside = Window.partitionBy(*keys, "_slice").orderBy("_s")
    heads = (
        starts.groupBy(*keys, "_slice")
        .agg(F.min(F.struct("_s", "_before")).alias("_head"))
        .select(*keys, "_slice", F.lead("_head").over(over_slices).alias("_after"))
    )
    return (
        starts.withColumn("_follow", F.lead(F.struct("_s", "_before")).over(inside))
        .join(heads, [*keys, "_slice"])
        .withColumn("_follow", F.coalesce("_follow", "_after"))
        .select(
            *keys,
            "_s",
            F.coalesce(F.col("_follow._before"), F.col("_last")).alias("_e"),
            F.col("_follow._s").alias("_next"),
        )
    )


def merge_intervals(
    df: DataFrame,
    keys: list[str],
    start: str = "start_ms",
    end: str = "end_ms",
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Continuous periods per entity: (keys, period_start, period_end).

    Touching intervals belong together. Rows with a null bound or with
    end <= start are ignored; repeated rows change nothing; a null key is an
    entity of its own only for grouping and is left out, as it names nobody.
    An empty table gives an empty table; other columns are not read.
    """
    df = df.dropna(subset=keys)
    return _periods(df, keys, start, end, slice_ms).select(
        *keys, F.col("_s").alias("period_start"), F.col("_e").alias("period_end")
    )


def intervals_and_gaps(
    df: DataFrame,
    keys: list[str],
    start: str = "start_ms",
    end: str = "end_ms",
    max_gap_ms: int | None = None,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Periods and gaps as rows (keys, kind, from_ms, to_ms).

    A gap reaches from the end of a period to the start of the entity's next;
    gaps longer than max_gap_ms are left out. Empty cases as merge_intervals.
    """
    df = df.dropna(subset=keys)
    periods = _periods(df, keys, start, end, slice_ms)
    pieces = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_s").alias("from_ms"), F.col("_e").alias("to_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("_e").alias("from_ms"), F.col("_next").alias("to_ms")),
    )
    rows = periods.select(*keys, F.explode(pieces).alias("_p")).select(*keys, "_p.*")
    gap = F.col("to_ms").isNotNull()
    if max_gap_ms is not None:
        gap = gap & (F.col("to_ms") - F.col("from_ms") <= max_gap_ms)
    return rows.where((F.col("kind") == "period") | gap)


def interval_gaps(df: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms", max_gap_ms: int | None = None) -> DataFrame:
    """Only the gaps: (keys, gap_start, gap_end)."""
    return (
        intervals_and_gaps(df, keys, start, end, max_gap_ms)
        .where("kind = 'gap'")
        .select(*keys, F.col("from_ms").alias("gap_start"), F.col("to_ms").alias("gap_end"))
    )
