"""Text as bytes of a named encoding."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels of the web that Python knows by another name, or that stand for a wider encoding there.
_LABELS = {
    "latin1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "x-cp1252": "cp1252", "windows-1252": "cp1252",
    "iso-8859-9": "cp1254", "latin5": "cp1254", "iso-8859-11": "cp874", "tis-620": "cp874", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "windows-31j": "cp932",
    "gb2312": "gbk", "gb_2312-80": "gbk", "x-gbk": "gbk", "euc-kr": "cp949", "ks_c_5601-1987": "cp949", "korean": "cp949", "big5": "big5hkscs", "unicode-1-1-utf-8": "utf-8", "koi": "koi8_r", "koi8": "koi8_r", "macintosh": "mac_roman", "x-sjis": "cp932",
}
_C1 = "\x81\x8d\x8f\x90\x9d"


class EncodingError(ValueError):
    """A label that names no encoding, or a text that an encoding can't write."""


def python_codec(label: str) -> str:
    """Python's name of a label's encoding."""
    name = label.strip().lower()
    try:
        return codecs.lookup(_LABELS.get(name, name.replace("windows-", "cp"))).name
    except LookupError:
        raise EncodingError(f"Unsupported encoding: {label}") from None


def encode_strict(text: str, codec: str, label: str) -> bytes:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        # The five controls that windows-1252 leaves open are bytes of their own on the web.
        if codec == "cp1252" and any(c in _C1 for c in text):
            return b"".join(bytes([ord(c)]) if c in _C1 else encode_strict(c, codec, label) for c in text)
        raise EncodingError(f"Content cannot be encoded as {label}") from None


def encode_text(text: Column, encoding: str = "utf-8", first: Column | None = None) -> Column:
    """Bytes of a text; the Unicode encodings stay Java-side.

    ``utf-8-sig`` and ``utf-16`` (little-endian) begin with a mark, where first
    is true or not given. A text that can't be written raises EncodingError
    when the row is computed, an unknown label at once.
    """
    name = encoding.strip().lower()
    marks = {"utf-8-sig": ("UTF-8", b"\xef\xbb\xbf"), "utf-16": ("UTF-16LE", b"\xff\xfe"), "utf-16le": ("UTF-16LE", b""), "utf-16be": ("UTF-16BE", b""), "utf-8": ("UTF-8", b""), "utf8": ("UTF-8", b"")}
    if name in marks:
        charset, mark = marks[name]
        body = F.encode(text, charset)
        lead = F.lit(mark) if first is None else F.when(first, F.lit(mark)).otherwise(F.lit(b""))
        return F.concat(lead, body) if mark else body
    codec = python_codec(encoding)

    @F.pandas_udf(T.BinaryType())
    def encoded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else encode_strict(t, codec, encoding))

    return encoded(text)
