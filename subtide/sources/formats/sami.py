"""SAMI."""

from __future__ import annotations

import re

from subtide.sources.formats import WHITE, CaptionError, Cue, number

# Fixed values.
_CORRECTIONS = [("<i/>", "<i>"), (";>", ">"), ("<br>", "\n"), ("<br/>", "\n"), ("<br >", "\n")]
_SHOWN_MS = 4000.0
_TOKEN = re.compile(r"<([^>]*)>|([^<]+|<)")
_ATTRIBUTE = re.compile(rf"[{WHITE}]*([^{WHITE}=]+)[{WHITE}]*(?:=[{WHITE}]*(?:\"([^\"]*)\"?|'([^']*)'?|([^{WHITE}]*)))?")


def _attributes(text: str) -> dict[str, str]:
    out, at = {}, 0
    while (m := _ATTRIBUTE.match(text, at)) and m.end() > at:
        out[m[1].lower()] = next((v for v in m.groups()[1:] if v is not None), "")
        at = m.end()
    return out


def parse_sami(text: str) -> list[Cue]:
    """A cue for each sync with text, shown until its end, a blank sync, or for four seconds.

    Tags are never closed: text goes by the last one opened. Behind ``sync``
    it is dropped, behind ``br`` it is a newline, behind ``i`` it is italic.
    """
    text = text.removeprefix("﻿")
    for wrong, right in _CORRECTIONS:
        text = text.replace(wrong, right)
    tag: str | None = None
    syncs: list[tuple[float | None, float | None, list[str]]] = []
    for m in _TOKEN.finditer(text):
        if m[1] is not None:
            inner = m[1].strip(WHITE)
            if inner.startswith("/"):
                continue
            name, *rest = re.split(f"[{WHITE}]+", inner, maxsplit=1)
            tag = name.lower()
            if tag == "sync":
                given = _attributes(rest[0] if rest else "")
                syncs.append((number(given.get("start", "")), number(given.get("end", "")), []))
            continue
        said = m[2]
        if tag is None:
            raise CaptionError("parse", "Invalid SAMI content before the first tag")
        if not syncs or tag == "sync":
            continue
        if tag == "br":
            said = "\n"
        elif tag == "i" and said.strip(WHITE):
            said = f"<i>{said}</i>"
        syncs[-1][2].append(said)
    shown: list[list] = []
    for start, end, parts in syncs:
        content = "".join(parts).strip(WHITE)
        if content and start is not None:
            shown.append([start, start + _SHOWN_MS if end is None else end, content])
        elif not content and start is not None and shown:
            shown[-1][1] = start
    return [(n, int(s), int(e), c) for n, (s, e, c) in enumerate(shown, 1)]
