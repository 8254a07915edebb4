"""SubRip."""

from __future__ import annotations

import re

from subtide.sources.formats import WHITE, CaptionError, Cue, lines_of

_TIME = re.compile(r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3}) --> (\d{2}):(\d{2}):(\d{2})[,.](\d{3})")
#: The largest index a file can state.
_MOST = 2**32 - 1


def parse_srt(text: str) -> list[Cue]:
    """Each time line owns the text lines behind it, up to a line of digits below a text line.

    Blank lines end nothing. A text without a time line is lost, a time line
    without text gives no cue. The index is the last line of digits since the
    cue before was complete, or the count of cues where there is none.
    """
    indexes: list[tuple[int, str]] = []
    times: list[tuple[int, re.Match[str]]] = []
    texts: list[tuple[int, str]] = []
    for at, line in enumerate(lines_of(text)):
        line = line.rstrip("\r")
        bare = line.strip(WHITE)
        if not bare:
            continue
        if re.fullmatch(r"\d+", bare):
            indexes.append((at, bare))
        elif (m := _TIME.search(bare)) is not None:
            if not m.group().isascii():
                raise CaptionError("parse", "Invalid digits in a time line")
            times.append((at, m))
        elif times:
            texts.append((at, line))
    cues: list[Cue] = []
    i = x = 0
    stated = 0
    for k, (begin, m) in enumerate(times):
        end = times[k + 1][0] if k + 1 < len(times) else float("inf")
        while x < len(texts) and texts[x][0] < begin:
            x += 1
        if x == len(texts) or texts[x][0] > end:
            continue
        first = texts[x][0]
        # Lines of digits up to the first text line state the index; the next one ends the cue.
        while i < len(indexes) and indexes[i][0] < first:
            value = indexes[i][1]
            stated = int(value) if value.isascii() and int(value) <= _MOST else stated + 1
            i += 1
        stop = min(end, indexes[i][0] if i < len(indexes) else end)
        own = []
        while x < len(texts) and texts[x][0] < stop:
            own.append(texts[x][1])
            x += 1
        h, mi, s, ms, h2, mi2, s2, ms2 = map(int, m.groups())
        cues.append((stated or len(cues) + 1, ((h * 60 + mi) * 60 + s) * 1000 + ms, ((h2 * 60 + mi2) * 60 + s2) * 1000 + ms2, "\n".join(own)))
        stated = 0
    return cues
