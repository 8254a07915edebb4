"""The line repairs of ``mend``: an ordered table of rewrites, as one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subtide.functions.textrules import ROUNDS, Rule, decode_references, let, repair_round, rewrite, trim

# Fixed values from here on: the patterns and their order decide the result, so they are as they must be.
_SPACES = [
    Rule("spaces", r" {2,}", " "),
    Rule("leading_white", r"(?dU)\A\s+", ""),
    Rule("white_after_newline", r"(?dU)\n\s*", "\n"),
]
_NOTES = [
    Rule("stray_a_circumflex", "Â", ""),
    Rule("hyphen_sign", "‐", "-"),
    Rule("beamed_note", "♫", "♪"),
    Rule("hash_start", r"(?dmU)^((?:\{\\an8\})?(?:<i>)?)(- ?)?[#*]+(\s+)", "$1$2♪$3"),
    Rule("hash_end", r"(?dmU)\s[#*]{1,3}(</i>$|$)", " ♪$1"),
    Rule("hash_only", r"(?dm)^[#*]+$", "♪"),
    Rule("note_before_italic", r"(?d)♪ <i>(.*)", "<i>♪ $1"),
    Rule("note_behind_italic", r"(?dU)(♪.*)</i>\s*♪", "$1 ♪</i>"),
    Rule("pound_start", r"\A£ ", "♪ "),
    Rule("pound_end", r" £\z", " ♪"),
    Rule("notes", "♪+", "♪"),
    Rule("note_then_letter", r"\A♪([A-Za-z])", "♪ $1"),
    Rule("letter_then_note", r"([A-Za-z])♪", "$1 ♪"),
    Rule("hard_space", r"(?:\\h)+", " "),
    Rule("trim", r"(?dU)\A\s+|\s+\z", ""),
]
_TAGS = [
    Rule("ampersands", "&(?:amp;)+", "&"),
    Rule("quotes", "'[`’]", "'"),
    Rule("positions", r"(?:\{\\an[0-9]\})+", r"{\\an8}"),
    Rule("space_after_position", r"\{\\an[0-9]\} +([A-Za-z-])", r"{\\an8}$1"),
    Rule("hanging_open_first", r"\A(<[a-z]>)\n", "$1"),
    Rule("close_newline_open", r"</[a-z]>\n<[a-z]>", "\n"),
    Rule("open_tags", "(?:<[a-z]>)*(<[a-z]>)", "$1"),
    Rule("close_tags", "(?:</[a-z]>)*(</[a-z]>)", "$1"),
    Rule("spaces_after_first_tag", r"\A(<[a-z]>) +", "$1"),
    Rule("leading_spaces", r"\A +", ""),
    Rule("other_tags", "(?!</?i>)</?[a-z]+>", ""),
    Rule("space_between_tags", r"(<[a-z]>|\{\\an8\}) (<[a-z]>|\{\\an8\})", "$1$2"),
    Rule("open_then_newline", r"(<[a-z]>)\n", "\n$1"),
    Rule("newline_then_close", r"\n(</[a-z]>)", "$1\n"),
    Rule("open_then_space", "(<[a-z]>) ", " $1"),
    Rule("space_then_close", " (</[a-z]>)", "$1 "),
    Rule("first_open_then_space", r"\A(<[a-z]>) ", "$1"),
    Rule("close_white_open", r"(?dU)</[a-z]>(\s*)<[a-z]>", "$1"),
    Rule("empty_element", r"(?dU)<[a-z]>\s*</[a-z]>", ""),
    Rule("position_then_newline", r"(\{\\an8\})\n", "$1"),
]
_LINES = [
    Rule("bracket_spaces", r"(?d)\( (.*) \)", "($1)"),
    Rule("line_break_tags", "<br ?/?>", "\n"),
    Rule("dot_line", r"(?dmU)^\.?\s*$", ""),
    Rule("dash_line", r"(?dmU)^-?\s*$", ""),
    Rule("tag_line", r"(?dmU)^(?:</?i>|\{\\an8\})?\s*$", ""),
    Rule("literal_token", r"\A\[A-Za-z0-9\]\z", ""),
    Rule("after_ellipsis", r"(?d)([a-z])(\.\.\.)([a-zA-Z][^.])", "$1$2 $3"),
    Rule("after_close_tag", r"(?dU)(</[a-z]>)(\w)", "$1 $2"),
    Rule("after_comma", "([a-z]),([a-zA-Z])", "$1, $2"),
    Rule("comma_newline", r"(?dU),\n([a-z]+[.?])\s*\z", ", $1"),
    Rule("front_dots", r"(?dU)\A(\s*(?:[<{][/\\]?[a-z0-9.]+[}>])?\s*(?:-)?\s*(?:[<{][/\\]?[a-z0-9.]+[}>])?\s*)\.+", "$1..."),
    Rule("end_dots", r"(?dU)\.{2,}([<{][/\\]?[a-z0-9.]+[}>])?\s*\z", "...$1"),
    Rule("return_before_newline", r"\r+\n", "\n"),
    Rule("last_newline", r"\n\z", ""),
    Rule("speaker_hyphen", r"""(?dmU)^(<i>|\{\\an8\})?-++(?=(?!')[\p{Alnum}"\[(<{.$¿¡…♪â]|'[\p{Alnum}"\[(<{.$¿¡…♪â])""", "$1- "),
    Rule("before_double_hyphen", r"(?dU)\s*--(\s*)", "--$1"),
    Rule("note_behind_tag", r"(?dmU)(</[a-z]>)(\s*♪+)$", "$2$1"),
    Rule("trailing_spaces", r"(?dm) +$", ""),
    Rule("trim_lines", r"(?dU)\A\s+|\s+\z", ""),
    Rule("after_bracket", r"(?dm)^(.*)([^.][\])])([A-Z][^.])", "$1$2\n$3"),
    Rule("glued_sentences", r"(?dUs)\A(.*?(?:\A|(?<![.A-Z\s]))[!.;:?])(?<!Mr\.)(?<!Ms\.)(?<!Mrs\.)(?=[A-Z](?!\.))(.*)\z", "- $1\n- $2"),
    Rule("lone_word_line", r"(?dU)(\A<[a-z]>|\n<[a-z]>)(\w+)\n", "$1$2 "),
    Rule("missing_hyphen", r"(?dU)\A[^\S\n]*+(?!-)([^\n]*?)[^\S\n]*\n- ([A-Z][a-z][^\n]*)\z", "- $1\n- $2"),
    Rule("return_newlines", r"\r\n+", "\r\n"),
    Rule("newlines", r"\n+", "\n"),
    Rule("italic_spaces", " +</i> +", "</i> "),
    Rule("italic_hyphen", "<i>-</i>([^<]+)", "-$1"),
    Rule("trim_end", r"(?dU)\A\s+|\s+\z", ""),
]
RULES = [*_SPACES, *_NOTES, *_TAGS, *_LINES]


def close_first_tag(text: Column) -> Column:
    """The text with its first tag closed at the end, if it is closed nowhere."""

    def closed(t: Column) -> Column:
        name = F.regexp_extract(t, r"\A(?:\{\\an8\})?<([a-z])>", 1)
        end = F.concat(F.lit("</"), name, F.lit(">"))
        return F.when((name != "") & ~F.contains(t, end), F.concat(t, end)).otherwise(t)

    return let(text, closed)


def steps() -> list[Callable[[Column], Column]]:
    """One pass of every repair in order, as expressions of a text to be applied one behind the other."""
    return [
        lambda t: rewrite(t, _SPACES),
        *[repair_round] * ROUNDS,
        lambda t: rewrite(t, [*_NOTES, *_TAGS]),
        close_first_tag,
        lambda t: trim(rewrite(t, _LINES)),
    ]


#: Plain sentences of ASCII words on one line, which no repair changes.
PLAIN = r"\A[A-Za-z0-9]++(?:'[A-Za-z]++)?(?:,? [A-Za-z0-9]++(?:'[A-Za-z]++)?)*+[.!?]?\z"


def with_fixed_text(df: DataFrame, text: str) -> DataFrame:
    """df with references in a text decoded twice and its lines repaired twice.

    Each step is a projection of its own: an expression of all of them would
    be too deep for the analyzer. They are evaluated in one stage, and texts
    that are plain to begin with go past them.
    """
    last = [lambda t: F.regexp_replace(t, r"\A\n+|\n+\z", "")]
    df = df.withColumn("_plain", F.col(text).rlike(PLAIN))
    for step in [decode_references] * 2 + steps() * 2 + last:
        df = df.withColumn(text, F.when(F.col("_plain"), F.col(text)).otherwise(step(F.col(text))))
    return df.drop("_plain")
