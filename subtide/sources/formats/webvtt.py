"""WebVTT."""

from __future__ import annotations

import re

from subtide.sources.formats import WHITE, Cue, lines_of, number, stamp_ms, unescape

# Fixed values.
#: Lines that begin with one of these are no part of anything.
_SKIPPED = ("WEBVTT", "NOTE", "/*", "X-TIMESTAMP-MAP")
_TOP, _NO_POSITION = 25.0, 100.0
_VOICE = re.compile(r"<v\s+[^>]+>")
_STYLED = re.compile(r"<c(\.[^>]+)>([^<]+)</c>")
_RUBY = re.compile(r"<rt>([^<]+)</rt>")
_RUBY_PAREN = re.compile(r"<rp>([^<]+)</rp>")
_OTHER_TAGS = re.compile(r"<(?!/?i>)/?[^>\s]+>")


def _position(settings: list[str]) -> float | None:
    """The line setting in percent; counted lines but the first, and words, are none."""
    for setting in settings:
        key, colon, value = setting.partition(":")
        if key == "line" and colon and value:
            value = value.partition(",")[0]
            if value.endswith("%"):
                if (share := number(value[:-1])) is not None:
                    return share
            elif value == "0":
                return 0.0
    return None


def _italic_classes(css: str) -> dict[str, bool]:
    """class -> whether its last rule is italic."""
    classes = {}
    for selector, body in re.findall(r"([^{]*)\{([^}]*)\}", css):
        cue = selector.split("::cue(")
        name = re.search(r"[A-Za-z0-9_-]+", cue[1].partition(")")[0]) if len(cue) > 1 else None
        if name:
            rules = dict([x.strip(WHITE) for x in d.split(":", 1)] for d in body.split(";") if ":" in d)
            classes[name.group()] = rules.get("font-style") == "italic"
    return classes


def clean_text(text: str, italic: dict[str, bool]) -> str:
    """Italic classes as ``<i>``, ruby in parentheses, no other tags."""

    def styled(m: re.Match[str]) -> str:
        names = [n for n in m[1].split(".") if n]
        return f"<i>{m[2]}</i>" if any(italic.get(n) or n == "font-style_italic" for n in names) else m.group()

    # A class around other tags holds no bare text, so only the innermost one counts.
    text = _STYLED.sub(styled, text)
    return _OTHER_TAGS.sub("", _RUBY_PAREN.sub("", _RUBY.sub(r"(\1)", text)))


def parse_webvtt(text: str) -> list[Cue]:
    """Cues by (start, end, position), numbered from 1; no text is no reason to drop one."""
    found: list[list] = []
    pending: list[str] = []
    italic: dict[str, bool] = {}
    css: list[str] | None = None
    waiting, position = False, None
    for line in lines_of(text):
        line = line.strip(WHITE)
        if line.startswith(_SKIPPED):
            continue
        if not line:
            if css is not None:
                italic |= _italic_classes("\n".join(css))
                css = None
            if pending:
                found[-1][3] = "\n".join(pending)
                pending, waiting = [], False
        elif "STYLE" in line:
            css = css or []
        elif css is not None:
            css.append(line)
        elif " --> " in line:
            parts = re.split(f"[{WHITE}]+", line)
            position = _position([p for p in parts[3:] if ":" in p])
            start, end = (stamp_ms("00:" + p if p.count(":") == 1 else p) for p in (parts[0], parts[2]))
            found.append([start, end, _NO_POSITION if position is None else position, ""])
            waiting = True
        elif waiting:
            said = _VOICE.sub("", unescape(line))
            if position is not None and position < _TOP:
                said, position = "{\\an8}" + said, None
            pending.append(said.strip(WHITE))
    if pending:
        found[-1][3] = "\n".join(pending)
    found.sort(key=lambda c: c[:3])
    return [(n, s, e, clean_text(t, italic)) for n, (s, e, _, t) in enumerate(found, 1)]
