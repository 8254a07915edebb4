"""Texts decoded with a wrong character encoding.

Two kinds of damage are found.

UTF-8 bytes read as a legacy encoding: the characters are mapped back to the
bytes of that encoding and an automaton of the UTF-8 byte structure (a regular
expression over the characters that stand for lead and continuation bytes)
finds the maximal well-formed multibyte spans. Only those spans are decoded,
so partly damaged texts keep their sound rest; rounds repeat while a span is
found, which undoes texts decoded wrongly more than once (each round shortens
the text, so they end). Double-byte encodings (GBK, Shift-JIS) go through their
bytes with the same automaton. Lines that hold few UTF-8 spans are read by the
automata of Shift-JIS and GBK, for text of theirs taken for Western.

Bytes of one single-byte encoding read as another: there is no multibyte
structure, so the automaton can't tell; what tells is a word that no language
writes - a long row of accented Latin letters, a digit-like sign within a
word, or inverted case.

Damage that lost characters (U+FFFD, C1 control characters) is found too, and
left where it can't be undone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legacy encodings whose reading of UTF-8 is undone, likeliest first.
SINGLE = ["cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1250", "cp1253", "cp852"]
DOUBLE = ["cp932", "gb18030"]

#: What a restored character may be: letters, signs and scripts that captions use.
_PLAUSIBLE = re.compile(
    "[ -ſƒƠơƯưȘ-țˆ˜̀-̄̆-̧̨̈̊̌Ͱ-ϿЀ-џҐґֿ-תء-ي"
    "Ḁ-ỹ -⁄₤-₿№™←-↙∀-≥─-╿■-♯✓-✗　-ヿ㇀-㏿一-鿿가-힣ﬀ-ﬆ️﻿-￯\U0001f300-\U0001faff]+"
)


def _bytes_of(codec: str) -> dict[str, int]:
    """character -> byte; undefined bytes stand for the C1 control of their number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":
        out |= {chr(b): b for b in range(128, 160) if chr(b) not in out}
    return out


def _structure(chars: dict[str, int]) -> re.Pattern[str]:
    """The UTF-8 automaton over the characters that stand for bytes."""

    def some(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in chars.items() if low <= b <= high) + "]"

    t = some(0x80, 0xBF)
    return re.compile(
        f"(?:{some(0xC2, 0xDF)}{t}|{some(0xE0, 0xE0)}{some(0xA0, 0xBF)}{t}|{some(0xE1, 0xEC)}{t}{t}|{some(0xED, 0xED)}{some(0x80, 0x9F)}{t}"
        f"|{some(0xEE, 0xEF)}{t}{t}|{some(0xF0, 0xF0)}{some(0x90, 0xBF)}{t}{t}|{some(0xF1, 0xF3)}{t}{t}{t}|{some(0xF4, 0xF4)}{some(0x80, 0x8F)}{t}{t})+"
    )


_TABLES = {codec: _bytes_of(codec) for codec in SINGLE}
_SPANS = {codec: _structure(_TABLES[codec]) for codec in SINGLE}
#: The same automaton over bytes.
_BYTE_SPANS = re.compile(
    rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
#: A lead and a continuation byte: without such a pair there is no span.
_PAIRS = {
    codec: re.compile(
        "[" + "".join(re.escape(c) for c, b in t.items() if 0xC2 <= b <= 0xF4) + "][" + "".join(re.escape(c) for c, b in t.items() if 0x80 <= b <= 0xBF) + "]"
    )
    for codec, t in _TABLES.items()
}
#: What sound texts hold anyway: spans of nothing else prove nothing by themselves.
_ORDINARY = {
    "cp1252": re.compile("[à-ï]\xa0»"),
    "cp1251": re.compile("[А-яЁёѕіјїєґЅІЈЇЄҐ\xa0\xad]{1,7}"),
    "koi8_r": re.compile("[А-яЁёѕіјїєґЅІЈЇЄҐ\xa0\xad]{1,7}"),
    "cp866": re.compile("[А-яЁё\xa0]{1,9}"),
    "cp1253": re.compile("[Ά-ώ\xa0\xad]+"),
    "mac_roman": re.compile("[À-ſ‘’“”–—…«»\xa0]+"),
    "cp850": re.compile("[À-ÿ¿¡«»\xa0]{2}"),
    "cp437": re.compile("[À-ÿ¿¡«»\xa0]{2}|[Α-ω]{2}"),
    "cp852": re.compile("[À-ž«»\xa0]{2}"),
    "cp1250": re.compile("[À-ž\xa0\xad]{2,3}"),
}
#: What a single pair of Cyrillic letters within a Latin text may stand for.
_WESTERN_SIGN = re.compile("[¡£§¿À-ÖØ-öø-ÿĄ-ćĘęŁ-ńŚśŹ-ž]+")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_FULLWIDTH = re.compile("[！-～]")
_CJK = re.compile("[⺀-鿿豈-﫿︰-￯가-힣-�々〆]+")
_KANA = re.compile("[ぁ-ヿ]")


def _undo_single(text: str, codec: str) -> tuple[str, int]:
    """The text with spans of one encoding decoded, and the characters saved."""
    table, ordinary, saved, proof, western = _TABLES[codec], _ORDINARY[codec], 0, False, codec == "cp1251"
    out, at = [], 0
    for m in _SPANS[codec].finditer(text):
        span = m.group()
        good = bytes([table[c] for c in span]).decode("utf-8", "replace")
        if not _PLAUSIBLE.fullmatch(good) and not (codec == "cp1252" and all("\x80" <= c <= "\x9f" or _PLAUSIBLE.match(c) for c in good)):
            continue
        proof = proof or not ordinary.fullmatch(span)
        western = western and bool(_WESTERN_SIGN.fullmatch(good))
        saved += len(span) - len(good)
        out += (text[at : m.start()], good)
        at = m.end()
    new = "".join(out) + text[at:]
    # Letters of Cyrillic that are Western signs to the last, in a text with none besides.
    return (new, saved) if proof or (western and saved and not _CYRILLIC.search(new)) else (text, 0)


def _undo_double(text: str, codec: str) -> tuple[str, int]:
    """The same through the bytes of a double-byte encoding, run of CJK by run."""
    saved = 0

    def decode(m: re.Match[str]) -> str:
        nonlocal saved
        run = m.group()
        if len(_FULLWIDTH.findall(run)) > 0.3 * len(run):
            return run
        out, n_good, raw = [], 0, run.encode(codec, "replace")
        at = 0
        for s in _BYTE_SPANS.finditer(raw):
            good = s.group().decode("utf-8")
            if not _PLAUSIBLE.fullmatch(good):
                continue
            out.append("\ufffd" * (s.start() > at) if not raw[at : s.start()].isascii() else raw[at : s.start()].decode())
            out.append(good)
            n_good += len(s.group())
            at = s.end()
        if at < len(raw):
            out.append(raw[at:].decode() if raw[at:].isascii() else "\ufffd")
        new = "".join(out)
        if len(run) < 3 or n_good < 6 or n_good < 0.6 * len(raw):
            # A short run proves damage only within a Latin word, as a sign or letter of Latin text.
            beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
            if not (n_good and beside.isascii() and any(c.isalpha() for c in beside) and _LATIN_SIGN.fullmatch(new)):
                return run
        saved += max(1, n_good // 3)
        return new

    return _CJK.sub(decode, text), saved


_LATIN_SIGN = re.compile("[A-Za-z]?[À-ÖØ-öø-ſ‘’“”–—…€£][A-Za-z]?")

#: Relative frequency of the letters а..я in Russian text, in per mille.
_RUSSIAN = dict(
    zip(
        "абвгдежзийклмнопрстуфхцчшщъыьэюя",
        [80, 16, 45, 17, 30, 85, 9, 17, 74, 12, 35, 44, 32, 67, 110, 28, 47, 55, 63, 26, 3, 10, 5, 14, 7, 4, 0.4, 19, 17, 3, 6, 20],
        strict=True,
    )
)


def _russian(text: str) -> float:
    """Mean frequency of the Cyrillic letters, lower for swapped alphabets."""
    f = [_RUSSIAN.get(c, 1) for c in text.lower() if "а" <= c <= "я"]
    return sum(f) / len(f) if f else 0.0


_LATIN_ROW = re.compile("[À-ÖØ-öø-ÿ¸¨¢]{4,}")
_HIGH = re.compile("[À-ÖØ-öø-ÿ]")
_LATIN_WORD = re.compile(r"[A-Za-z\x80-\xff¹³ŒœŠšŽžŸ]+")
_POLISH = re.compile("[A-Za-zÀ-ÿŒœŸŽž][¹³¿¯]+[a-zœê¹³]|[A-Za-zêœæñó]{2,}[¹³](?![A-Za-z0-9])|(?<![A-Za-z])[¹³¯¥£Ÿ¿](?=[a-zœóê]+[¹³])|(?<![A-Za-z0-9])[¯³][a-zœóê]{2}|(?<![A-Za-z])[Œœ][wrp]|\x8f[a-z]")
_INVERTED = re.compile("(?<![А-яЁё╦Ј])[а-я][А-ЯЁ╦Ј]{2,}|[А-Я][╦Ј][А-Я]|[А-Яа-я]╦|╦[А-Яа-я]")
_CAPS = re.compile("[А-ЯЁЈ╦]{2,}")


def _recode(text: str, was: str, should: str) -> str:
    """Characters of one single-byte encoding as those of another, where both have them."""
    out = []
    for c in text:
        try:
            out.append(c.encode(was).decode(should) if ord(c) > 127 else c)
        except (UnicodeEncodeError, UnicodeDecodeError):
            out.append(chr(ord(c)).encode("latin-1").decode(should, "replace") if 128 <= ord(c) < 160 else c)
    return "".join(out)


def _undo_swap(text: str) -> str | None:
    """A text whose single-byte encoding was taken for another, restored; else null."""
    if _LATIN_ROW.search(text):
        letters = [c for c in text if c.isalpha()]
        if len(letters) >= 8 and sum(bool(_HIGH.match(c)) for c in letters) >= 0.6 * len(letters):
            russian, greek = _recode(text, "cp1252", "cp1251"), _recode(text, "cp1252", "cp1253")
            accents = sum(c in "άέήίόύώ" for c in greek)
            if accents and _russian(russian) < 45:
                return greek
            if _russian(russian) >= 40:
                return russian
    if _POLISH.search(text):
        return _recode(text, "cp1252", "cp1250")
    if _INVERTED.search(text):
        a, b = _recode(text, "cp1251", "koi8_r"), _recode(text, "koi8_r", "cp1251")
        best = max((a, b), key=_russian)
        if _russian(best) > _russian(text):
            return best
    return None


#: A character that double-byte text shows when read as Western.
_WESTERN = re.compile("[\x80-\xffŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]")
_EAST = re.compile("[ぁ-ヿ一-鿿、。「」！？，：；]")
#: Whole lines of well-formed double-byte text, ASCII included.
_EASTERN = {
    "cp932": re.compile(rb"(?:[\x00-\x7f]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+"),
    "gb2312": re.compile(rb"(?:[\x00-\x7f]|[\xa1-\xf7][\xa1-\xfe])+"),
    "gbk": re.compile(rb"(?:[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\x80-\xfe])+"),
}


def _common(text: str) -> bool:
    """Whether most ideographs are of the first level of GB2312, the common ones."""
    lead = [c.encode("gb2312", "replace")[0] for c in text if "\u4e00" <= c <= "\u9fff"]
    return sum(0xB0 <= b <= 0xD7 for b in lead) >= 0.7 * len(lead)


def _undo_east(text: str) -> str | None:
    """Lines of Shift-JIS or GBK bytes that were read as Western, restored; else null.

    Lines whose Western signs nearly all stand in UTF-8 spans are no such lines;
    nor are those that come out in rare characters, outside the first level of GB2312.
    """
    out, any_line = [], False
    for line in text.split("\n"):
        new = line
        western = len(_WESTERN.findall(line))
        if western >= 4 and sum(len(m.group()) for m in _SPANS["cp1252"].finditer(line)) < 0.9 * western:
            try:
                raw = bytes([_TABLES["cp1252"].get(c, ord(c)) for c in line])
            except ValueError:
                raw = b""
            for codec, structure in _EASTERN.items():
                if not structure.fullmatch(raw):
                    continue
                try:
                    good = raw.decode(codec)
                except UnicodeDecodeError:
                    continue
                rest = [c for c in good if not c.isspace() and not c.isdigit()]
                if len(rest) >= 3 and sum(bool(_EAST.match(c)) for c in rest) >= 0.8 * len(rest) and (codec == "cp932" or _common(good)):
                    new, any_line = good, True
                    break
        out.append(new)
    return "\n".join(out) if any_line else None


#: Texts of one script and no sign of damage, told at a glance.
_SOUND = re.compile("[\\x00-\\x7f♪“”’…–—]*[А-яЁё][А-яЁё\\x00-\\x7f♪]*|[\\x00-\\x7f♪áéíóúñãõçàêôâüöäßèîûœąćęłńóśźżÉÀÓÚÁÍ¿¡’…–—]*")
_LOST = re.compile("\ufffd|[\x80-\x84\x86-\x9f]|锟斤|ï¿½")
#: Rows that hold neither of these are sound.
SUSPECT = r"[^\x00-\x7F]"


def restore(text: str | None) -> tuple[str | None, list[str]]:
    """The text with wrong decoding undone where possible, and what was found.

    Found are the names of the encodings undone, in order, ``east`` for
    double-byte text read as Western, ``swap`` for one single-byte encoding
    taken for another and ``lost`` for damage that remains. A sound, empty or null text comes back with no finding.
    """
    if not text or text.isascii():
        return text, []
    if _SOUND.fullmatch(text) and not _INVERTED.search(text) and not _POLISH.search(text):
        return text, []
    found: list[str] = []
    if (new := _undo_east(text)) is not None:
        return new, ["east", "lost"] if _LOST.search(new) else ["east"]
    while True:
        best, gain, name = text, 0, ""
        for codec in SINGLE:
            if _PAIRS[codec].search(text):
                new, saved = _undo_single(text, codec)
                if saved > gain:
                    best, gain, name = new, saved, codec
        if not gain:
            for codec in DOUBLE:
                new, saved = _undo_double(text, codec)
                if saved > gain:
                    best, gain, name = new, saved, codec
        if not gain or (name in DOUBLE and "\ufffd" in best):
            # Bytes were lost: what is left of such a run can't be read.
            found += [name, "lost"] if gain else []
            break
        text = best
        found.append(name)
    if not found and (new := _undo_swap(text)) is not None:
        text, found = new, ["swap"]
    if "lost" not in found and _LOST.search(text):
        found.append("lost")
    return text, found


def find_garbled(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, content, restored, damage) of the rows that show wrong decoding.

    damage lists what was found (see ``restore``); restored is null where no
    part could be restored. Null, empty and sound rows are left out; repeated
    rows come out as often as they went in. Other columns are not read.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField(content, T.StringType()),
            T.StructField("restored", T.StringType()),
            T.StructField("damage", T.ArrayType(T.StringType())),
        ]
    )
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, restored, damage = [], [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                new, found = restore(t)
                if found:
                    at.append(i)
                    restored.append(new if new != t else None)
                    damage.append(found)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(restored, pa.string()), pa.array(damage, pa.list_(pa.string()))],
                names=[*keys, content, "restored", "damage"],
            )

    return df.select(*keys, F.col(content).cast("string").alias(content)).where(suspect(content)).mapInArrow(run, schema)


def suspect(content: str) -> Column:
    return F.col(content).rlike(SUSPECT)
