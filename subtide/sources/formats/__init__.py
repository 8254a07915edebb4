"""Parsers of one file each: text or bytes to (idx, start_ms, end_ms, content) rows.

A file is one value of a row, so each parser sees all of it and no more. They
raise CaptionError where a file can't be read.
"""

from __future__ import annotations

import re
from html.entities import html5

#: Unicode's white space, without the separators that Python strips besides.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"

Cue = tuple[int, int, int, str]


class CaptionError(ValueError):
    """A file that can't be read; kind is io, parse or format."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message


def as_text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise CaptionError("io", "the file is not valid UTF-8") from None


def lines_of(text: str) -> list[str]:
    """Lines at ``\\n`` only, each without the return before it; a last newline opens no line."""
    lines = text.split("\n")
    if not lines[-1]:
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def stamp_ms(stamp: str) -> int:
    """Milliseconds of HH:MM:SS and a fraction whose digits count as they stand."""
    parts = re.split("[:;.,]", stamp.replace("T:", ""))
    if len(parts) != 4 or not all(re.fullmatch("[+-]?[0-9]+", p) for p in parts):
        raise CaptionError("parse", f"Invalid timestamp format: {stamp}")
    h, m, s, ms = map(int, parts)
    return h * 3_600_000 + m * 60_000 + s * 1_000 + ms


def number(text: str) -> float | None:
    return float(text) if re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text) else None


def _reference(m: re.Match[str]) -> str:
    name = m.group()[1:]
    if name[0] == "#":
        point = int(name[2:-1], 16) if name[1] in "xX" else int(name[1:-1])
        return chr(point) if 0 < point < 0x110000 and not 0xD800 <= point < 0xE000 else m.group()
    return html5.get(name, m.group())


def unescape(text: str) -> str:
    """Character references decoded, each with its semicolon; numbers as they stand."""
    return re.sub(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", _reference, text) if "&" in text else text


