"""TTML and WebVTT within MP4 fragments."""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

from subtide.sources.formats import CaptionError, Cue, as_text
from subtide.sources.formats.ttml import parse_ttml
from subtide.sources.formats.webvtt import parse_webvtt

# The first eight bytes of the boxes that open a file and a segment.
_FILE, _SEGMENT = b"\x00\x00\x00\x1cftyp", b"\x00\x00\x00\x18styp"
_TIMESCALE = 1000
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsd", b"traf", b"wvtt"}


def looks_like_mp4(data: bytes) -> bool:
    if len(data) < 8:
        return False
    if _FILE in data or _SEGMENT in data:
        return True
    size, kind = int.from_bytes(data[:4]), data[4:8]
    return all(chr(b).isalnum() and b < 128 or b == 32 for b in kind) and (size in (0, 1) or size <= len(data))


def segments(data: bytes) -> Iterator[bytes]:
    """The file cut before each segment; what stands behind the last segment's start is left out.

    Each search begins as far behind a segment's start as the piece before it
    was long, and at least one byte on.
    """
    if _SEGMENT not in data:
        yield data
        return
    begin = at = max(data.find(_FILE), 0)
    while (start := data.find(_SEGMENT, at)) >= 0:
        yield data[begin:start]
        at = start + max(start - begin, 1)
        begin = start


def boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, payload) of the boxes that stand in a row."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise CaptionError("parse", "MP4 parse error: truncated box")
        size, kind, head = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16]), 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            raise CaptionError("parse", "MP4 parse error: box size")
        yield kind, data[at + head : at + size]
        at += size


def parse_ismt(data: bytes) -> list[Cue]:
    """The TTML of each media box; a fragment that begins before the cues so far moves behind them."""
    if data and not looks_like_mp4(data):
        return []
    cues: list[Cue] = []
    failed: CaptionError | None = None
    for segment in segments(data):
        for kind, payload in boxes(segment):
            if kind != b"mdat" or failed:
                continue
            try:
                new = parse_ttml(as_text(payload))
            except CaptionError as error:
                failed = error
                continue
            if cues and new and cues[-1][1] > new[0][1]:
                by = cues[-1][2]
                new = [(i, s + by, e + by, c) for i, s, e, c in new]
            cues += new
    if failed:
        raise failed
    return cues


def _timings(fragment: bytes, base: int = 0, length: int | None = None) -> Iterator[tuple[float, float]]:
    """(start, end) in ms of the samples of a fragment's runs.

    Within a run both the composition offsets and the durations add up.
    """
    try:
        for kind, p in _flat(fragment):
            if kind == b"tfdt":
                base = struct.unpack_from(">Q" if p[0] == 1 else ">I", p, 4)[0]
            elif kind == b"tfhd":
                flags = int.from_bytes(p[1:4])
                at = 8 + (8 if flags & 1 else 0) + (4 if flags & 2 else 0)
                length = struct.unpack_from(">I", p, at)[0] if flags & 8 else None
            elif kind == b"trun":
                flags, count = int.from_bytes(p[1:4]), struct.unpack_from(">I", p, 4)[0]
                at = 8 + (4 if flags & 1 else 0) + (4 if flags & 4 else 0)
                start, spent = base, 0
                for _ in range(count):
                    own = length or 0
                    for flag in (0x100, 0x200, 0x400, 0x800):
                        if flags & flag:
                            value = struct.unpack_from(">i" if flag == 0x800 and p[0] else ">I", p, at)[0]
                            own = value if flag == 0x100 else own
                            start += value if flag == 0x800 else 0
                            at += 4
                    spent += own
                    yield start / _TIMESCALE * 1000.0, (start + spent) / _TIMESCALE * 1000.0
    except (struct.error, IndexError):
        raise CaptionError("parse", "MP4 parse error: truncated timing box") from None


def _flat(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The boxes of a fragment and of the containers in it."""
    for kind, payload in boxes(data):
        if kind in _CONTAINERS:
            yield from _flat(payload)
        else:
            yield kind, payload


def _stamp(ms: float) -> str:
    whole = int(ms)
    h, rest = divmod(whole, 3_600_000)
    return f"{h:02d}:{rest // 60_000:02d}:{rest // 1000 % 60:02d}.{rest % 1000:03d}"


def _samples(media: bytes, timings: deque[tuple[float, float]]) -> Iterator[str]:
    """The cues of a media box as WebVTT; each box takes the next timing, boxes beyond them none.

    A cue box begins where the sample before it in the media box ended, or at
    its own end if it is the first; an empty cue moves the next one to its end.
    """
    before = forced = None
    for kind, payload in boxes(media):
        if not timings:
            return
        start, end = timings.popleft()
        settings, said = "None", None
        if kind == b"vttc":
            start = end if before is None else before
            for inner, value in boxes(payload):
                if inner == b"sttg":
                    settings = as_text(value)
                elif inner == b"payl":
                    said = as_text(value)
        elif kind == b"payl":
            said = payload.decode("utf-8", "replace")
        before = end
        if kind == b"vtte":
            forced = end
            continue
        if forced is not None:
            start, forced = forced, None
        if said is not None:
            yield f"{_stamp(start)} --> {_stamp(end)} {settings}\n{said}\n\n"


def parse_wvtt(data: bytes) -> list[Cue]:
    """The WebVTT cues of the fragments, timed by their runs (in thousandths of a second)."""
    if data and not looks_like_mp4(data):
        return []
    timings: deque[tuple[float, float]] = deque()
    lines: list[str] = []
    for segment in segments(data):
        for kind, payload in boxes(segment):
            if kind == b"moof":
                timings.extend(_timings(payload))
            elif kind == b"mdat":
                lines += _samples(payload, timings)
    return parse_webvtt("".join(["WEBVTT\n\n", *lines]))
