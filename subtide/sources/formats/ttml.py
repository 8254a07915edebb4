"""TTML, DFXP and SMPTE-TT."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from subtide.sources.formats import WHITE, CaptionError, Cue, number, stamp_ms, unescape

_CLOCK = re.compile(r"([0-9]{2}):([0-9]{2}):([0-9]{2})[:.,]?([0-9]{0,3})")


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _value(element: ElementTree.Element, name: str) -> str | None:
    """The first attribute of a local name."""
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


class _Document:
    """One XML document: its clock, its styles and regions, and its cues."""

    def __init__(self, text: str):
        if "<!DOCTYPE" in text:
            raise ElementTree.ParseError("a document type is not allowed")
        self.root = ElementTree.fromstring(text)
        self.parent = {child: element for element in self.root.iter() for child in element}
        head = next((e for e in self.root.iter() if _local(e.tag) == "tt"), None)
        if head is None:
            raise ElementTree.ParseError("no tt element")
        ticks = _value(head, "tickRate") or "0"
        self.ticks = int(ticks) if re.fullmatch("[0-9]+", ticks) else 0
        self.frame_ms = self._frame(head)
        #: Bare spans turn italics over, unless the document marks italic spans itself.
        self.bare_spans = '<span tts:fontStyle="italic">' not in text
        self.italic: dict[str, bool] = {}
        self.ruby: set[str] = set()
        self.top: dict[str, bool] = {}
        for e in self.root.iter():
            name = _value(e, "id")
            if name is not None and _local(e.tag) == "style":
                self.italic[name] = self.is_italic(e)
                if _value(e, "ruby") == "text":
                    self.ruby.add(name)
        for e in self.root.iter():
            name = _value(e, "id")
            if name is not None and _local(e.tag) == "region":
                self.top[name] = self.is_top(e)

    @staticmethod
    def _frame(head: ElementTree.Element) -> float:
        """Milliseconds of a frame; 1 where no rate is given, so a fraction counts as milliseconds."""
        given = _value(head, "frameRate")
        if given is None:
            return 1.0
        rate = number(given)
        rate = 25.0 if rate is None else rate
        share = (_value(head, "frameRateMultiplier") or "1 1").split()
        if len(share) == 2:
            up, down = (1.0 if number(x) is None else number(x) for x in share)
            rate = rate * up / down if down else float("inf")
        return 1000.0 * (1.0 / rate) if rate else float("inf")

    def is_italic(self, e: ElementTree.Element) -> bool:
        style = _value(e, "fontStyle")
        if style is not None:
            return style == "italic"
        if e.get("style") in self.italic:
            return self.italic[e.get("style")]
        if _local(e.tag) == "span" and not e.attrib and self.bare_spans and e in self.parent:
            return not self.is_italic(self.parent[e])
        return False

    def is_top(self, e: ElementTree.Element) -> bool:
        align = _value(e, "displayAlign")
        return align == "before" if align is not None else self.top.get(e.get("region"), False)

    def is_ruby(self, e: ElementTree.Element) -> bool:
        return _value(e, "ruby") == "text" or e.get("style") in self.ruby

    def said(self, e: ElementTree.Element) -> str:
        parts = [e.text or ""]
        for child in e:
            parts += (self._inline(child), child.tail or "")
        return "".join(parts)

    def _inline(self, e: ElementTree.Element) -> str:
        if _local(e.tag) == "br":
            return "\n"
        text = self.said(e)
        if not text.strip(WHITE):
            return text
        if self.is_italic(e):
            text = f"<i>{_upright(text)}</i>"
        if self.is_top(e):
            text = "{\\an8}" + text
        return f"({text})" if self.is_ruby(e) else text

    def time(self, given: str) -> int:
        if given.endswith("t"):
            if not re.fullmatch("[0-9]+", given[:-1]):
                raise CaptionError("parse", f"Invalid tick value: {given[:-1]}")
            if not self.ticks:
                raise CaptionError("parse", "Tickrate is zero")
            return int(1.0 / self.ticks * int(given[:-1]) * 1000.0)
        if given.endswith("ms"):
            ms = number(given[:-2])
            if ms is None:
                raise CaptionError("parse", f"Invalid millisecond value: {given[:-2]}")
            return int(ms)
        clock = _CLOCK.search(given)
        if not clock:
            return stamp_ms(given)
        h, m, s, frames = clock.groups()
        return (int(h) * 3600 + int(m) * 60 + int(s)) * 1000 + (int(self.frame_ms * int(frames)) if frames else 0)

    def cues(self) -> list[Cue]:
        """The paragraphs of the first division of the body that have both times and a text."""
        body = next((e for e in self.root.iter() if _local(e.tag) == "body"), ())
        division = next((e for e in body if _local(e.tag) == "div"), ())
        out: list[Cue] = []
        for n, p in enumerate((e for e in division if _local(e.tag) == "p"), 1):
            begin, end = p.get("begin"), p.get("end")
            if begin is None or end is None:
                continue
            start, stop = self.time(begin), self.time(end)
            text = self.said(p)
            if text.strip(WHITE) and self.is_italic(p):
                text = f"<i>{_upright(text).strip(WHITE)}</i>"
            if text.strip(WHITE) and self.is_top(p):
                text = "{\\an8}" + text.strip(WHITE)
            if text.strip(WHITE):
                out.append((n, start, stop, text.strip(WHITE)))
        return out


def _upright(text: str) -> str:
    return text.replace("<i>", "").replace("</i>", "")


def _document(text: str) -> _Document:
    """The document as it is, or with references decoded, or with a stray span end mended besides."""
    decoded = unescape(text)
    for attempt in (text, decoded, decoded.replace("</span></p>", "</p>")):
        try:
            return _Document(re.sub(r"\A\s*<\?xml[^>]*\?>", "", attempt))
        except (ElementTree.ParseError, ValueError) as error:
            if isinstance(error, CaptionError):
                raise
            last = error
    raise CaptionError("parse", f"Failed to parse XML: {last}")


def parse_ttml(text: str) -> list[Cue]:
    """The cues of a file's documents, one behind the other."""
    text = text.removeprefix("﻿")
    if text.count("</tt>") == 1:
        return _document(text).cues()
    parts = [p.strip(WHITE) for p in text.strip(WHITE).split("</tt>")]
    return [cue for p in parts if p for cue in _document(p + "</tt>").cues()]
