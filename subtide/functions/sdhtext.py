"""Annotations for the hard of hearing, taken out of one text at a time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.textrules import Rule, is_blank, let, rewrite, trim

# Fixed values from here on: the public catalogue of patterns. A bracket holds
# anything but its end, white space included.
TAGS = r"[<{][/\\]?[a-z0-9.]+[}>]"
POSITION_TAGS = r"\A\{\\an[0-9]\}"
FRONT_NOTES = r"(?:♪+\s+)"
BACK_NOTES = r"(?:\s+♪+)"
DESCRIPTION_BRACKET = r"\[[^\]]*\]"
DESCRIPTION_PARENTHESES = r"\([^)]*\)"
INLINE_DESCRIPTION = r"(?:<[a-z]+>)?[\[(][A-Za-z ]+[)\]](?:</[a-z]+>)?"
FRONT = rf"^\s*({TAGS})??\s*(-)??\s*({TAGS})??\s*"
_CAPS = r"[A-Z0-9&\[\].#' ]+\s*"
SPEAKER = rf"({FRONT})\s*(Mc[A-Z][a-zA-Z]+|{_CAPS}|[A-Z][a-z]+):\s*"
SPEAKER_PARENTHESES = rf"({FRONT})\s*(?:{_CAPS}|[A-Z][a-z]+)(?: \([a-zA-Z ]+\)):\s*"
FULL_LINE = [rf"(?dU)\A-?\s*{FRONT_NOTES}?\[[^\]]+\]{BACK_NOTES}?\z", rf"(?dU)\A-?\s*{FRONT_NOTES}?\([^)]+\){BACK_NOTES}?\z"]
NEW_LINE = [
    Rule("bracket_line", rf"(?dmU)^(?:{TAGS})?-?\s*{FRONT_NOTES}?{DESCRIPTION_BRACKET}(?:{TAGS})?{BACK_NOTES}?$"),
    Rule("parentheses_line", rf"(?dmU)^(?:{TAGS})?-?\s*{FRONT_NOTES}?{DESCRIPTION_PARENTHESES}{BACK_NOTES}?(?:{TAGS})?$"),
]
INLINE = [
    Rule("tagged_front_bracket", r"(?dmU)^((?:</?[a-z]+>|\{\\+an8\})?-?\s*)\[[^\]]+\]:?", "$1"),
    Rule("tagged_front_parentheses", r"(?dmU)^((?:</?[a-z]+>|\{\\+an8\})?-?\s*)\([^)]+\):?", "$1"),
    Rule("front_bracket", rf"(?dmU)^(?:{SPEAKER}|{SPEAKER_PARENTHESES})?({FRONT}){DESCRIPTION_BRACKET}:?", "$1"),
    Rule("front_parentheses", rf"(?dmU)^({FRONT})(?:{SPEAKER}|{SPEAKER_PARENTHESES})?{DESCRIPTION_PARENTHESES}:?", "$1"),
    Rule("end_bracket", rf"(?dmU)\s*{DESCRIPTION_BRACKET}\s*$"),
    Rule("end_parentheses", rf"(?dmU)\s*{DESCRIPTION_PARENTHESES}:?\s*$"),
    Rule("inline", rf"(?dmU){INLINE_DESCRIPTION}"),
    Rule("trim", r"(?dU)\A\s+|\s+\z"),
]
_CC = r"(?d)(\A|\n)(</?[a-z]>|\{\\an8\})?>> "
_CC_ONLY = r"(?d)(\A|\n)(</?[a-z]>|\{\\an8\})?>>(\z|\n)"
_LINE_HYPHEN = r"(?dU)(?:\A|\n)(?:<i>|\{\\an8\})?-\s*"
_FIRST_HYPHEN = r"(?dU)\A(<i>|\{\\an8\})?-\s*"
#: Bleeps and the private characters that stand for them meanwhile.
BLEEPS = {"[bleep]": "", "(bleep)": ""}


def linear(pattern: str) -> str:
    """The pattern of a line's name for Java's engine, which tries again where the catalogue's engine does not.

    White space before a name, and a name in capitals before its colon, are
    never given back: nothing behind them could use it, but for a name of
    blanks only, which is an empty one behind a blank here.
    """
    front = FRONT.replace(r"\s*", r"\s*+")
    held = pattern.replace(FRONT + r")\s*", front + ")").replace(FRONT, front)
    return held.replace(f"|{_CAPS}|[A-Z][a-z]+):", r"|[A-Z0-9&\[\].#' ]++\s*+|[A-Z][a-z]+|(?<= )):")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, TAGS, "")


def protect_bleeps(text: Column) -> Column:
    """Bleeps within other words hidden; a bleep alone is an annotation like any other."""
    words = trim(F.regexp_replace(strip_tags(text), r"\A-+", ""))
    held = reduce(lambda t, b: F.replace(t, F.lit(b[0]), F.lit(b[1])), BLEEPS.items(), text)

    def hide(w: Column) -> Column:
        return (F.contains(w, F.lit("[bleep]")) | F.contains(w, F.lit("(bleep)"))) & ~w.isin(*BLEEPS)

    return F.when(let(words, hide), held).otherwise(text)


def restore_bleeps(text: Column) -> Column:
    return reduce(lambda t, b: F.replace(t, F.lit(b[1]), F.lit(b[0])), BLEEPS.items(), text)


def is_full_line(text: Column) -> Column:
    """Whether a text is one annotation and nothing else."""
    return let(strip_tags(text), lambda t: t.rlike(FULL_LINE[0]) | t.rlike(FULL_LINE[1]))


def clean_new_lines(text: Column) -> Column:
    """Without the lines that are an annotation; the position tag of the text stays."""
    position = F.regexp_extract(text, POSITION_TAGS, 0)
    left = trim(rewrite(text, NEW_LINE))
    return let(F.struct(position.alias("p"), left.alias("t")), lambda s: F.when(~F.contains(s["t"], s["p"]), F.concat(s["p"], s["t"])).otherwise(s["t"]))


def clean_inline(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(r"[\[(]"), rewrite(t, INLINE)).otherwise(trim(t)))


def _without_speaker(line: Column, pattern: str, guard: bool) -> Column:
    """The line from behind a speaker's name; its tag and hyphen before it stay, the hyphen's space goes.

    With the guard a name behind whose colon two digits follow is a time, and stays.
    """
    bare = F.regexp_replace(line, pattern, "$2$3")
    if not guard:
        return bare
    upto = F.regexp_replace(F.regexp_extract(line, pattern, 0), r"(?dU)\s+\z", "")
    return let(upto, lambda m: F.when(F.substr(line, F.length(m) + 1, F.lit(2)).rlike(r"\A[0-9]{2}\z"), line).otherwise(bare))


def clean_speakers(text: Column) -> Column:
    """Lines without the names of their speakers."""

    def line(t: Column) -> Column:
        named = _without_speaker(F.regexp_replace(t, r"\r\z", ""), linear(rf"(?dU){SPEAKER_PARENTHESES}"), False)
        return let(named, lambda x: _without_speaker(x, linear(rf"(?dU){SPEAKER}"), True))

    return trim(F.array_join(F.transform(F.split(text, "\n", -1), line), "\n"))


def strip_cc(text: Column) -> Column:
    """Without the marks of a new speaker; null where a line is nothing else."""
    return let(F.regexp_replace(text, _CC, "$1$2"), lambda t: F.when(~t.rlike(_CC_ONLY), t))


def is_music(text: Column) -> Column:
    """Whether a text is notes only, or nothing."""
    bare = F.regexp_replace(strip_tags(text), r"\A♪+\z", "")
    return F.replace(trim(bare), F.lit(" "), F.lit("")) == ""


def strip_lone_hyphen(text: Column) -> Column:
    """Without the hyphen at its start, if no other line has one."""
    once = F.regexp_count(text, F.lit(_LINE_HYPHEN)) == 1
    return F.when(once, trim(F.regexp_replace(text, _FIRST_HYPHEN, "$1"))).otherwise(text)


def with_stripped_text(df: DataFrame, text: str, extra: Sequence[str] = ()) -> DataFrame:
    """df with a text stripped of annotations; null where nothing of it stays.

    Each step is a projection of its own, as an expression of all of them
    would be too deep for the analyzer. A null goes through every step.
    """
    steps = [
        protect_bleeps,
        lambda t: F.when(~is_full_line(t), t),
        clean_new_lines,
        clean_inline,
        clean_speakers,
        strip_cc,
        lambda t: let(t, lambda x: F.when(~is_music(x), x)),
        lambda t: let(t, strip_lone_hyphen),
        lambda t: reduce(lambda x, p: F.regexp_replace(x, p, ""), extra, t),
        lambda t: let(t, lambda x: F.when(~is_blank(x), restore_bleeps(x))),
    ]
    for step in steps:
        df = df.withColumn(text, step(F.col(text)))
    return df
