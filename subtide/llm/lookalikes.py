"""Texts that look the same and are made of other characters.

Equivalence classes by collation, all in SQL. A text is first mapped to its
shape: each look-alike character becomes the first member of its class, forms
of width, font, ligature and space are unfolded, characters without a glyph
and surplus white space go. Shapes are then grouped under Spark's ``UNICODE``
collation, which tells letters, case and accents apart but not how an accent
is spelt (composed or combining). Each class has one canonical member - an
agreed phrase, or else its commonest text, the least by code points of equals -
which is joined back to the members.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class representative and its equal-looking characters, beyond what Unicode decomposes.
_CLASSES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲᴄⲥ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іıιɩ", "j": "јϳյ", "l": "ӏƖ", "n": "ո", "o": "оοօᴏⲟ",
    "p": "рρⲣ", "q": "ԛզ", "r": "г", "s": "ѕꜱ", "u": "սυʋ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уүγ", "z": "ᴢ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟⅭꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈᎫꓙ", "K": "КΚᏦKꓗ", "L": "Ꮮꓡ",
    "M": "МΜᎷꓟ", "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "УΥҮꓬ", "Z": "ΖᏃꓜ",
    "ß": "β", "к": "κĸ", "т": "τᴛ", "П": "Π", "Г": "Γ", "Ф": "Φ", "ф": "φ",
    "-": "‐‑‒–−⁃˗", "'": "’‘ʼʹ′ˈ‛", ":": "∶ː˸։׃꞉", "!": "ǃ", "?": "Ɂʔ", ".": "․", ",": "‚", '"': "“”″ʺ",
    "カ": "力", "タ": "夕", "ト": "卜", "ー": "一—―─", "ロ": "口", "ニ": "二", "ハ": "八", "エ": "工", "オ": "才", "メ": "乄", "チ": "千", "ミ": "彡", "ム": "厶", "ヒ": "匕",
    "̸": "̵̷",
}
#: Characters that look like several.
_SPELT = {"ł": "l\u0338", "Ł": "L\u0338", "ø": "o\u0338", "Ø": "O\u0338", "\u2026": "...", "\u2025": "..", "\u2033": "''"}
_UNFOLDED = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>")
#: The accent-sensitive and case-sensitive collation of the root locale.
COLLATION = "UNICODE"
#: Fillers, variation selectors and the grapheme joiner have no glyph, though they are no format characters.
_GLYPHLESS = "[\\p{Cf}\\p{Cc}\u034f\u115f\u1160\u3164\uffa0\ufe00-\ufe0f]+"
_SPACE = "[\\p{Z}\\t-\\r\u0085]+"


def _character_maps() -> tuple[dict[str, str], dict[str, str]]:
    """(character to character, character to string), from the classes and Unicode's own decompositions."""
    one = {c: first for first, others in _CLASSES.items() for c in others if c != first}
    many = dict(_SPELT)
    for point in range(0x80, 0x20000):
        c = chr(point)
        form = unicodedata.decomposition(c)
        if c in one or c in many or not form.startswith(_UNFOLDED):
            continue
        to = "".join(chr(int(x, 16)) for x in form.split()[1:])
        if to.isspace():
            continue
        if len(to) == 1:
            one[c] = one.get(to, to)
        elif unicodedata.category(c)[0] == "L" and to.isalpha() and point < 0xFB50:
            many[c] = to
    for point in range(0xC0, 0x2000):
        # A letter with accents follows its base letter.
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if marks and base in one and chr(point) not in one:
            to = unicodedata.normalize("NFC", one[base] + "".join(marks))
            (one if len(to) == 1 else many)[chr(point)] = to
    return one, many


_ONE, _MANY = _character_maps()
_FROM, _TO = "".join(_ONE), "".join(_ONE.values())


def shape(content: str) -> Column:
    """What a text shows, in the first members of the classes; empty for null and for what shows nothing."""
    pairs = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(to).alias("to")) for c, to in _MANY.items()))

    # Each step is bound to a variable, so that no rewrite of the plan evaluates it twice.
    def spelt(text: Column) -> Column:
        # A table of characters is looked up far faster than a class of them is matched.
        return F.when(F.translate(text, "".join(_MANY), "") != text, F.aggregate(pairs, text, lambda t, p: F.replace(t, p["c"], p["to"]))).otherwise(text)

    def seen(text: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(text, _SPACE, " "), _GLYPHLESS, "")
        return F.when(text.rlike("[^ -~]"), spelt_in(F.translate(bare, _FROM, _TO))).otherwise(text)

    def spelt_in(text: Column) -> Column:
        return F.transform(F.array(text), spelt)[0]

    def narrow(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)

    shown = F.transform(F.transform(F.array(F.coalesce(F.col(content), F.lit(""))), seen), narrow)
    return F.coalesce(F.trim(shown[0]), F.lit(""))


def _classed(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """(columns, _said, _class) of the rows with a text; the class of what shows nothing is empty."""
    rows = df.select(*columns, F.col(text).cast("string").alias("_said")).where(F.length("_said") > 0)
    return rows.withColumn("_class", F.collate(shape("_said"), COLLATION))


def find_lookalikes(
    df: DataFrame, phrases: DataFrame, keys: list[str], content: str = "content", phrase_id: str = "phrase_id", phrase: str = "phrase"
) -> DataFrame:
    """(keys, content, phrase_id, phrase) of rows that look like a phrase and aren't it.

    phrase is the canonical member of the row's class. A row like several
    phrases comes out for each; repeated rows come out as often as they went
    in. Null, empty and invisible texts match nothing; a text is never changed
    unless its class holds a phrase. Other columns are not read.
    """
    agreed = (
        _classed(phrases, [phrase_id], phrase)
        .where(F.length("_class") > 0)
        .groupBy("_class", phrase_id)
        .agg(F.min("_said").alias(phrase))
        .withColumnRenamed("_class", "_of")
    )
    said = _classed(df, keys, content).withColumnRenamed("_said", content)
    joined = said.join(agreed, F.col("_class") == F.col("_of"))
    return joined.where(F.col(content) != F.col(phrase)).select(*keys, content, phrase_id, phrase)


def consistent_forms(df: DataFrame, content: str = "content") -> DataFrame:
    """(content, canonical, n_rows): each distinct text whose class has another member.

    canonical is the class's commonest text, of equally common ones the least
    by code points; n_rows counts the rows of the text. A class may hold any
    share of the rows: texts are counted before they meet, and a class holds
    one row for each of its spellings.
    """
    texts = df.select(F.col(content).cast("string").alias(content)).where(F.length(content) > 0).groupBy(content).agg(F.count(F.lit(1)).alias("n_rows"))
    each = _classed(texts, ["n_rows"], content)
    best = (
        each.groupBy("_class")
        .agg(F.min_by("_said", F.struct(-F.col("n_rows"), "_said")).alias("canonical"), F.count(F.lit(1)).alias("_spellings"))
        .where((F.col("_spellings") > 1) & (F.length("_class") > 0))
        .withColumnRenamed("_class", "_of")
    )
    return each.join(best, F.col("_class") == F.col("_of")).select(F.col("_said").alias(content), "canonical", "n_rows")
