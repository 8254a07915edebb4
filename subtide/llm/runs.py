"""Runs of identical or nearly identical consecutive events.

Events of an entity carry a dense position. A run is a longest chain of events
at positions that follow on by one, each alike to the one before it.

Exact runs come from the difference between an event's position (its row
number within the entity) and its row number within (entity, canonical value):
the difference is constant exactly while the value repeats without a hole.
Exact runs whose canonical values differ by few letters are then linked end to
end. All windows run per (entity, block of positions); the last event of a
block is also handed to the next block, so runs of different blocks that
belong together share that event and are chained afterwards. Only such runs,
at most two per block, ever meet in a window over the whole entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
MIN_LETTERS = 12
MAX_EDITS = 2

_TAGS = r"</?i>|\{\\an[1-9]\}"


def canonical(content: str) -> tuple[Column, Column, Column]:
    """(value, letters, digits) of a content; value is null for null or blank."""
    plain = F.lower(F.regexp_replace(F.col(content), _TAGS, ""))
    letters = F.regexp_replace(plain, r"[^\p{L}]+", "")
    digits = F.regexp_replace(plain, r"[^\p{Nd}]+", "")
    blank = F.col(content).isNull() | F.col(content).rlike(r"^(?U)\s*\z")
    bare = (F.length(letters) == 0) & (F.length(digits) == 0)
    value = F.when(blank, F.lit(None)).when(bare, F.concat(F.lit("="), content)).otherwise(F.concat(F.lit("~"), digits, F.lit("~"), letters))
    return value, letters, digits


def collapse_runs(
    df: DataFrame,
    entity: str = "file_id",
    position: str = "seq",
    content: str = "content",
    start: str = "start_ms",
    end: str = "end_ms",
    block: int = BLOCK,
    min_events: int = 1,
) -> DataFrame:
    """One row per run of min_events or more, by default single events too.

    Columns: entity, first_seq, last_seq, n_events, from_ms, to_ms,
    duration_ms, content (of the first event).

    An event delivered again counts once (the first by start, end and content
    if deliveries differ). Null or blank content is alike to nothing and such
    an event is a run of its own without content. Null entity or position: the
    row names no event and is left out. Null times leave the run's bounds to
    its other events. Empty tables give empty tables.
    """
    at = F.col(position)
    home = F.floor(at / F.lit(block)).cast("long")
    last_of_block = F.pmod(at, F.lit(block)) == block - 1
    rows = df.dropna(subset=[entity, position]).select(
        F.col(entity).alias("_k"),
        at.cast("long").alias("_p"),
        F.col(content).alias("_c"),
        F.col(start).alias("_s"),
        F.col(end).alias("_e"),
        F.explode(F.when(last_of_block, F.array(home, home + 1)).otherwise(F.array(home))).alias("_b"),
    )
    inside = Window.partitionBy("_k", "_b")
    value, letters, digits = canonical("_c")
    events = (
        rows.withColumn("_before", F.lag("_p").over(inside.orderBy("_p", "_s", "_e", "_c")))
        .where(F.col("_before").isNull() | (F.col("_before") != F.col("_p")))
        .select("_k", "_b", "_p", "_c", "_s", "_e", value.alias("_v"))
    )
    # An event without a value is alike to nothing: its value is its own place.
    events = events.where(F.col("_v").isNotNull()) if min_events > 1 else events.withColumn("_v", F.coalesce("_v", F.concat(F.lit("!"), F.col("_p").cast("string"))))
    same = F.col("_p") - F.row_number().over(Window.partitionBy("_k", "_b", "_v").orderBy("_p"))
    exact = (
        events.withColumn("_d", same)
        .groupBy("_k", "_b", "_v", "_d")
        .agg(
            F.min("_p").alias("_first"),
            F.max("_p").alias("_last"),
            F.min("_s").alias("_s"),
            F.max("_e").alias("_e"),
            F.min(F.struct("_p", "_c")).alias("_c"),
        )
    )
    order = inside.orderBy("_first")
    parts = F.split("_v", "~", 3)
    exact = (
        exact.withColumn("_dig", F.when(F.col("_v").startswith("~"), parts[1]))
        .withColumn("_let", F.when(F.col("_v").startswith("~"), parts[2]))
        .withColumn("_plast", F.lag("_last").over(order))
        .withColumn("_pdig", F.lag("_dig").over(order))
        .withColumn("_plet", F.lag("_let").over(order))
    )
    near = (
        (F.col("_plast") + 1 == F.col("_first"))
        & (F.col("_dig") == F.col("_pdig"))
        & (F.length("_let") >= MIN_LETTERS)
        & (F.length("_plet") >= MIN_LETTERS)
        & (F.abs(F.length("_let") - F.length("_plet")) <= MAX_EDITS)
        & (F.levenshtein("_let", "_plet", MAX_EDITS) >= 0)
    )
    runs = (
        exact.withColumn("_opens", F.when(near, 0).otherwise(1))
        .withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_k", "_b", "_run")
        .agg(
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            F.min("_s").alias("_s"),
            F.max("_e").alias("_e"),
            F.min("_c").alias("_c"),
        )
    )
    low, high = F.col("_b") * block - 1, F.col("_b") * block + block - 1
    meets = (F.col("_first") == low) | (F.col("_last") == high)
    if min_events > 1:
        runs = runs.where(meets | (F.col("_last") > F.col("_first")))
    # Runs that reach a block's edge meet in one group of the entity, the others stay in their block's.
    runs = runs.withColumn("_at", F.when(meets, F.lit(None)).otherwise(F.col("_b")))
    across = Window.partitionBy("_k", "_at").orderBy("_first", "_last")
    whole = (
        runs.withColumn("_top", F.max("_last").over(across.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_opens", F.when(F.col("_first") <= F.col("_top"), 0).otherwise(1))
        .withColumn("_run", F.sum("_opens").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_k", "_at", "_run")
        .agg(
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            F.min("_s").alias("_s"),
            F.max("_e").alias("_e"),
            F.min("_c").alias("_c"),
        )
        .drop("_at", "_run")
    )
    return (
        whole.where(F.col("_last") - F.col("_first") + 1 >= min_events)
        .select(
            F.col("_k").alias(entity),
            F.col("_first").alias("first_seq"),
            F.col("_last").alias("last_seq"),
            (F.col("_last") - F.col("_first") + 1).alias("n_events"),
            F.col("_s").alias("from_ms"),
            F.col("_e").alias("to_ms"),
            (F.col("_e") - F.col("_s")).alias("duration_ms"),
            F.col("_c._c").alias(content),
        )
    )
