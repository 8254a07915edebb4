"""Ordered text rewrites, character references and repair of UTF-8 read as windows-1252.

Everything is a Java-side expression. Java patterns start with ``(?dU)`` (only
``\\n`` ends a line; ``\\s \\w \\d`` are Unicode) and say ``\\z`` for the end.
Steps that use a text more than once bind it to a lambda variable, so that no
rewrite of a plan computes it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One rewrite: every match of pattern becomes to (``$1`` is a group)."""

    name: str
    pattern: str
    to: str = ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def rewrite(text: Column, rules: Iterable[Rule]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r.pattern, r.to), rules, text)


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?dU)\A\s+|\s+\z", "")


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?dU)\A\s*\z")


#: Names that end in a semicolon, from Python's table of HTML 5.
_NAMES = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}


def _of_code_point(digits: Column, base: int) -> Column:
    """The character of a number written in a base; null if there is none."""
    point = F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("long"))
    valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def decode_references(text: Column) -> Column:
    """Named (HTML 5) and numeric character references, each with its semicolon, once."""
    names = F.create_map(*(F.lit(x) for pair in _NAMES.items() for x in pair))

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, r"\A(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        value = (
            F.when(name.rlike("^#[xX]"), _of_code_point(F.substr(name, F.lit(3)), 16))
            .when(name.startswith("#"), _of_code_point(F.substr(name, F.lit(2)), 10))
            .when(name != "", F.try_element_at(names, name))
        )
        return F.coalesce(F.concat(value, F.substr(p, F.length(name) + 2)), F.concat(F.lit("&"), p))

    def whole(t: Column) -> Column:
        parts = F.split(t, "&", -1)
        rest = F.transform(F.slice(parts, 2, F.size(parts)), piece)
        return F.when(t.rlike("&[#A-Za-z]"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(t)

    return let(text, whole)


# Windows-1252: the characters of bytes 80..9F that are no control characters.
_SIGNS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BYTES = "".join(chr(c.encode("cp1252")[0]) for c in _SIGNS)
#: Controls that no byte of windows-1252 stands for, and private characters that hold their place.
_FOREIGN = _BYTES
_HELD = "".join(chr(0xF700 + ord(c)) for c in _FOREIGN)
_T = "[\\x80-\\xbf]"
#: One well-formed character of several bytes, over characters that stand for bytes.
_SEQUENCE = (
    f"(?:[\\xc2-\\xdf]{_T}|\\xe0[\\xa0-\\xbf]{_T}|[\\xe1-\\xec\\xee\\xef]{_T}{_T}|\\xed[\\x80-\\x9f]{_T}"
    f"|\\xf0[\\x90-\\xbf]{_T}{_T}|[\\xf1-\\xf3]{_T}{_T}{_T}|\\xf4[\\x80-\\x8f]{_T}{_T})"
)
#: Characters that tell wrong decoding, each one point of the score.
MARKERS = "¡¢£¯¼½¾ÂÃ×âðƒ⁄�"
#: Fixed value: how often a text is repaired at most.
ROUNDS = 4


def _as_bytes(text: Column) -> Column:
    return F.translate(text, _FOREIGN + _SIGNS, _HELD + _BYTES)


def _decode_spans(text: Column) -> Column:
    """Each well-formed sequence decoded, the rest as it was."""

    def spans(b: Column) -> Column:
        between = F.transform(F.split(b, _SEQUENCE, -1), lambda p: F.translate(p, _BYTES + _HELD, _SIGNS + _FOREIGN))
        good = F.transform(F.regexp_extract_all(b, F.lit(_SEQUENCE), F.lit(0)), lambda s: F.decode(F.encode(s, "ISO-8859-1"), "UTF-8"))
        return F.array_join(F.zip_with(between, good, lambda p, g: F.concat(p, F.coalesce(g, F.lit("")))), "")

    return let(_as_bytes(text), spans)


def mojibake_score(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"[^{MARKERS}\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""))


def repair_round(text: Column) -> Column:
    """A text whose UTF-8 was read as windows-1252, repaired once if its score falls.

    Tried are the text with its well-formed spans decoded, and that once more
    if the whole text was well-formed; the first of least score wins, the text
    itself before all others. A text that is not improved stays, so further
    rounds change nothing.
    """

    def better(t: Column) -> Column:
        once = let(_decode_spans(t), lambda one: F.struct(one.alias("one"), F.when(~F.regexp_replace(_as_bytes(t), _SEQUENCE, "").rlike(r"[^\x00-\x7f]"), _decode_spans(one)).alias("two")))

        def pick(c: Column) -> Column:
            tried = F.array(t, c["one"], F.coalesce(c["two"], c["one"]))
            scored = F.transform(tried, lambda x, i: F.struct(mojibake_score(x).alias("score"), i.alias("at"), x.alias("text")))
            return F.array_min(scored)["text"]

        return F.when(_as_bytes(t).rlike(_SEQUENCE), let(once, pick)).otherwise(t)

    return let(text, better)


def fix_mojibake(df: DataFrame, text: str) -> DataFrame:
    """df with a text repaired in ROUNDS rounds."""
    return reduce(lambda d, _: d.withColumn(text, repair_round(F.col(text))), range(ROUNDS), df)
