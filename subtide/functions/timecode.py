"""Time stamps as text and as milliseconds (BIGINT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_stamp(ms: Column) -> Column:
    """HH:MM:SS,mmm; division truncates, so a negative time shows a sign in each part."""
    def part(unit: int, modulus: int | None = None) -> Column:
        whole = F.floor(F.abs(ms) / unit) * F.signum(ms).cast("long") if modulus is None else ms % modulus
        return whole.cast("long") if modulus is None else (F.floor(F.abs(whole) / unit) * F.signum(whole).cast("long")).cast("long")

    return F.format_string("%02d:%02d:%02d,%03d", part(3_600_000), part(60_000, 3_600_000), part(1_000, 60_000), (ms % 1_000).cast("long"))


def dot_stamp(ms: Column) -> Column:
    """HH:MM:SS.mmm of a double in milliseconds, cut toward zero, then divided downward."""
    whole = ms.cast("long")
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(whole / 3_600_000),
        F.pmod(F.floor(whole / 60_000), F.lit(60)),
        F.pmod(F.floor(whole / 1_000), F.lit(60)),
        F.pmod(whole, F.lit(1_000)),
    )


def seconds_to_ms(seconds: Column) -> Column:
    """Milliseconds of a double in seconds, cut toward zero."""
    return (seconds * F.lit(1000.0)).cast("long")


def stamp_to_ms(stamp: Column) -> Column:
    """Milliseconds of HH:MM:SS and a fraction behind any of ``: ; . ,``; null for anything else.

    The digits of the fraction count as milliseconds as they stand: ``.5`` is 5 ms.
    """
    parts = F.split(F.translate(F.replace(stamp, F.lit("T:"), F.lit("")), ";.,", ":::"), ":")
    number = F.transform(parts, lambda p: F.when(p.rlike(r"\A[+-]?[0-9]+\z"), p.try_cast("long")))
    total = number[0] * 3_600_000 + number[1] * 60_000 + number[2] * 1_000 + number[3]
    return F.when(F.size(parts) == 4, total)
