"""Files of each format into cues: what a reader of captions relies on, on small files of our own."""

import pytest
from pyspark.sql import functions as F

from subtide.sources.captions import cues_of, detect_format, errors_of, parse_captions
from subtide.sources.formats.mp4 import segments
from tests.captions import parsed

VTT = "WEBVTT\n\nNOTE nothing\n\n1\n00:00:01.000 --> 00:00:03.000\nGood day!\n\n00:04.000 --> 00:06.000\n<i>Slanted words.</i>\n\n00:00:07.000 --> 00:00:09.000 position:50%\nTwo lines\nin one cue."
TTML = '<?xml version="1.0" encoding="UTF-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling" xmlns:ttp="http://www.w3.org/ns/ttml#parameter"{head}>\n<head><styling><style xml:id="it" tts:fontStyle="italic"/><style xml:id="rb" tts:ruby="text"/></styling><layout><region xml:id="up" tts:displayAlign="before"/></layout></head>\n<body><div>{cues}</div></body></tt>'


def box(kind: bytes, payload: bytes = b"") -> bytes:
    return (len(payload) + 8).to_bytes(4) + kind + payload


FTYP, STYP = box(b"ftyp", bytes(20)), box(b"styp", bytes(16))


def run(*samples: tuple[int, int]) -> bytes:
    return b"\x01\x00\x09\x00" + len(samples).to_bytes(4) + b"".join(d.to_bytes(4) + o.to_bytes(4, signed=True) for d, o in samples)


def read(spark, data, form):
    df = cues_of(parsed(spark, data, form))
    return [(r.idx, r.start_ms, r.end_ms, r.content) for r in df.orderBy("seq").collect()]


def ttml(*cues: str, head: str = "") -> str:
    return TTML.format(head=head, cues="".join(cues))


def p(begin: str, end: str, text: str, more: str = "") -> str:
    return f'<p begin="{begin}" end="{end}"{more}>{text}</p>'


CASES = {
    "srt": ("srt", "1\n00:00:01,000 --> 00:00:02,000\nOne\n\nmore of it\n\n7\n00:00:03.000 --> 00:00:04,000\nTwo\n1984\nlost\n\n\n00:00:05,000 --> 00:00:06,000\n\n00:00:07,000 --> 00:00:08,000\nThree",
            [(1, 1000, 2000, "One\nmore of it"), (7, 3000, 4000, "Two"), (1984, 7000, 8000, "Three")]),
    "srt without numbers": ("srt", "00:00:01,000 --> 00:00:02,000\r\nOne\r\n\r\n0\r\n00:00:03,000 --> 00:00:04,000\r\n Two \r\n", [(1, 1000, 2000, "One"), (2, 3000, 4000, " Two ")]),
    "vtt": ("webvtt", VTT, [(1, 1000, 3000, "Good day!"), (2, 4000, 6000, "<i>Slanted words.</i>"), (3, 7000, 9000, "Two lines\nin one cue.")]),
    "vtt voices": ("webvtt", "00:00:01.000 --> 00:00:03.000\n- <v A>ANN ANNSON:</v>\n<v Bob>Hi &amp; bye</v>\n", [(1, 1000, 3000, "- ANN ANNSON:\nHi & bye")]),
    "vtt classes": ("webvtt", "00:00:01.000 --> 00:00:03.000\n<c.mono><c.bg.font-style_italic>Up</c></c> <b>x</b>", [(1, 1000, 3000, "<i>Up</i> x")]),
    "vtt style": ("webvtt", "STYLE\n::cue(.told) { color: red; font-style: italic; }\n\n00:00:01.000 --> 00:00:02.000\n<c.told>Told</c>\n", [(1, 1000, 2000, "<i>Told</i>")]),
    "vtt ruby": ("webvtt", "00:00:01.000 --> 00:00:02.000 line:95%,end\n<ruby>漢<rp>(</rp><rt>かん</rt><rp>)</rp></ruby>字", [(1, 1000, 2000, "漢(かん)字")]),
    "vtt order": ("webvtt", "00:00:02.000 --> 00:00:03.000 line:80%\nB\n\n00:00:02.000 --> 00:00:03.000 line:20.5%\nA\n\n00:00:01.000 --> 00:00:03.000 line:0\nTop",
                  [(1, 1000, 3000, "{\\an8}Top"), (2, 2000, 3000, "{\\an8}A"), (3, 2000, 3000, "B")]),
    "vtt not one": ("webvtt", "just words", []),
    "sami": ("sami", '<SAMI><BODY>\n<SYNC Start="1000">\n<P Class="CC">One</P>\n<SYNC Start=4000><P>Two<br>lines <i>it</i>\n<SYNC Start=6000><P> \n<SYNC Start=7000 End=7500><P>Three</SAMI>',
             [(1, 1000, 5000, "One"), (2, 4000, 6000, "Two\nlines <i>it</i>"), (3, 7000, 7500, "Three")]),
    "sami blank": ("sami", "", []),
    "ttml": ("ttml", ttml(p("00:00:01.000", "00:00:03.000", "One"), p("00:00:04.000", "00:00:06.000", "It <span>no</span>", ' style="it"'), p("00:00:07", "00:00:09.5", "a<br/>b", ' region="up"'), p("1s", "", "x") .replace(' end=""', "")),
             [(1, 1000, 3000, "One"), (2, 4000, 6000, "<i>It no</i>"), (3, 7000, 9005, "{\\an8}a\nb")]),
    "ttml ruby": ("ttml", ttml(p("00:00:01.000", "00:00:02.000", '漢<span style="rb">かん</span>字')), [(1, 1000, 2000, "漢(かん)字")]),
    "ttml ticks": ("ttml", ttml(p("5t", "15t", "x"), head=' ttp:tickRate="10"'), [(1, 500, 1500, "x")]),
    "ttml frames": ("ttml", ttml(p("00:00:01:12", "00:00:02:00", "x"), p("1500ms", "2500.9ms", "y"), head=' ttp:frameRate="24"'), [(1, 1500, 2000, "x"), (2, 1500, 2500, "y")]),
    "ttml twice": ("ttml", ttml(p("00:00:01.000", "00:00:02.000", "x")) + "\n" + ttml(p("00:00:02.500", "00:00:03.500", "y")), [(1, 1000, 2000, "x"), (1, 2500, 3500, "y")]),
    "ttml escaped": ("ttml", "&lt;tt&gt;&lt;body&gt;&lt;div&gt;&lt;p begin=&quot;00:00:01&quot; end=&quot;00:00:02&quot;&gt;x&lt;/span&gt;&lt;/p&gt;&lt;/div&gt;&lt;/body&gt;</tt>", [(1, 1000, 2000, "x")]),
    "bilibili": ("bilibili", '{"body":[{"from":1.0,"to":3.0009,"location":2,"content":"a","x":1},{"from":1.001,"to":6.0,"location":8,"content":"b"}]}', [(1, 1000, 3000, "a"), (2, 1000, 6000, "{\\an8}b")]),
    "bilibili empty": ("bilibili", '{"body":[]}', []),
    "ismt": ("ismt", FTYP + box(b"moov") + box(b"mdat", ttml(p("00:00:01", "00:00:02", "x")).encode()) + box(b"mdat", ttml(p("00:00:00", "00:00:01", "y")).encode()), [(1, 1000, 2000, "x"), (1, 2000, 3000, "y")]),
    "ismt in segments": ("ismt", FTYP + box(b"moov") + STYP + box(b"mdat", ttml(p("00:00:01", "00:00:02", "x")).encode()) + STYP + box(b"mdat", b"never read"), [(1, 1000, 2000, "x")]),
    "wvtt": ("wvtt", FTYP + box(b"moof", box(b"traf", box(b"tfdt", bytes(4) + (1000).to_bytes(4)) + box(b"trun", run((500, 0), (400, 0))))) + box(b"mdat", box(b"vttc", box(b"sttg", b"line:0%") + box(b"payl", b"Top")) + box(b"vttc", box(b"payl", b"Low"))),
             [(1, 1500, 1500, "{\\an8}Top"), (2, 1500, 1900, "Low")]),
    "wvtt offsets": ("wvtt", FTYP + box(b"moof", box(b"trun", run((500, 200), (400, 100)))) + box(b"mdat", box(b"vtte") + box(b"vttc", box(b"payl", b"x")) + box(b"vttc", box(b"payl", b"y"))), [(1, 700, 1200, "x")]),
    "wvtt not one": ("wvtt", b"this is no such file", []),
}


@pytest.fixture(scope="module")
def found(spark):
    """All files in one reading."""
    rows = [(name, form, bytearray(data.encode() if isinstance(data, str) else data)) for name, (form, data, _) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, form string, content binary")
    out: dict = {}
    for r in parse_captions(df, "name", form=F.col("form")).orderBy("name", "seq").collect():
        out.setdefault(r.name, []).append((r.idx, r.start_ms, r.end_ms, r.content) if r.error is None else r.error)
    return out


@pytest.mark.parametrize("name", CASES)
def test_file(found, name):
    assert found.get(name, []) == CASES[name][2]


BROKEN = {
    "sami": ("words before any tag", "parse"), "ttml": ("<tt><body></tt>", "parse"), "webvtt": ("x --> y z", "parse"), "bilibili": ('{"body":[{"from":1.0}]}', "parse"), "srt": (b"\xff\xfe", "io"), "odd": ("x", "format"),
    "ismt": (FTYP + b"\x00\x00\x00\x40mdat", "parse"),
}


@pytest.mark.parametrize("form", BROKEN)
def test_broken_files_give_an_error(spark, form):
    data, kind = BROKEN[form]
    df = parsed(spark, data, form)
    assert [r.error_kind for r in errors_of(df).collect()] == [kind] and cues_of(df).collect() == []


def test_doctypes_and_ticks_without_a_rate(spark):
    for text in ("<!DOCTYPE tt><tt></tt>", ttml(p("1t", "2t", "x"))):
        assert [r.error_kind for r in errors_of(parsed(spark, text, "ttml")).collect()] == ["parse"]


def test_detection(spark):
    cases = {
        b"xx mdat moof </tt>": "ismt", b"moof mdat vttc": "wvtt", b"moof mdat": None, b"<SAMI>": "sami", b"<sami>": None, b"x</tt>": "ttml", b"</tt:tt>": "ttml",
        b"\xef\xbb\xbfWEBVTT": "webvtt", b'{"Stroke": 1, "background_color": 2}': "bilibili", b' {"Stroke": 1, "background_color": 2}': None, b"1\n00:00:01,000 --> 00:00:02,000": None, b"\xff\xfe\x00": None,
    }
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "c binary")
    assert {bytes(r.c): r.f for r in df.select("c", detect_format(F.col("c")).alias("f")).collect()} == cases


def test_segments_end():
    assert len(list(segments(STYP * 5))) == 5
    assert list(segments(b"no segment")) == [b"no segment"]
