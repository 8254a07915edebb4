"""The cue model: order, numbering, writing, encodings, streaming, command line, intervals."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from subtide import cli
from subtide.functions.encodings import EncodingError, encode_text, python_codec
from subtide.operators import cues as c
from subtide.operators.intervals import interval_gaps, intervals_and_gaps, merge_intervals
from subtide.operators.mend import mend
from subtide.sources.sink import converted_name, with_suffix
from subtide.streaming.files import process_stream, stream_cues
from tests.captions import cues, said, srt

SRT = "1\n00:00:01,000 --> 00:00:02,000\n[door] One\n\n2\n00:00:02,050 --> 00:00:03,000\n# La la #\n\n"


def text(df) -> str:
    return "".join(r.text for r in df.orderBy("part_no").collect())


def test_sorting_and_writing(spark):
    df = cues(spark, [(5000, 6000, "b"), (1000, 1000, "none"), (1000, 2000, "a\r\nx\ry")])
    assert said(c.sort_cues(df)) == ["none", "a\r\nx\ry", "b"]
    assert text(c.export_srt(df)) == "1\n00:00:01,000 --> 00:00:02,000\na\nx\ny\n\n2\n00:00:05,000 --> 00:00:06,000\nb\n\n"
    assert text(c.export_srt(df, "\r\n", part=1)).count("\r\n") == 10
    assert text(c.export_srt(srt(spark, SRT))) == SRT
    assert c.export_srt(df.limit(0)).collect() == [] and c.sort_cues(df.limit(0)).collect() == []


def test_long_files_are_numbered_across_slices(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("file_id"), (F.col("id") + 1).alias("seq"), F.lit(0).alias("idx"), ((F.col("id") * 7919) % 20_000 * 997).alias("start_ms"), F.lit(10**9).cast("long").alias("end_ms"), F.lit("x").alias("content"))
    rows = c.sort_cues(df).orderBy("start_ms").collect()
    assert [r.idx for r in rows] == list(range(1, 20_001))


def test_list_operators(spark):
    a, b = cues(spark, [(0, 1, "a"), (2, 5, "b")]), cues(spark, [(9, 9, "c")])
    assert said(c.append(a, b)) == ["a", "b", "c"] and [r.seq for r in c.append(a, b).orderBy("seq").collect()] == [1, 2, 3]
    assert [r.start_ms for r in c.shift(a, -5).orderBy("seq").collect()] == [-5, -3]
    assert [r.duration_ms for r in c.with_duration(a).orderBy("seq").collect()] == [1, 3]
    assert c.count_cues(a).collect()[0].n_cues == 2 and said(c.cue_at(a, 1)) == ["b"] and c.cue_at(a, 9).collect() == []
    assert [r.changed for r in c.changed_files(a, a).collect()] == [False]
    assert [r.changed for r in c.changed_files(a, c.shift(a, 1)).collect()] == [True]
    # What is never written is no change.
    assert [r.changed for r in c.changed_files(a, c.append(a, b)).collect()] == [False]


def test_nulls_and_deliveries(spark):
    rows = [(1, 1, None, 5, 6, None), (1, 1, None, 5, 6, None), (1, 2, 3, 7, 8, "x"), (1, 2, 3, 7, 9, "x"), (None, 1, 1, 1, 2, "x"), (1, None, 1, 1, 2, "x"), (1, 3, 1, None, 2, "x")]
    df = spark.createDataFrame(rows, "file_id long, seq long, idx int, start_ms long, end_ms long, content string")
    assert sorted(map(tuple, c.as_cues(df.withColumn("extra", F.lit(1))).collect())) == [(1, 1, 0, 5, 6, ""), (1, 2, 3, 7, 8, "x")]


def test_encodings(spark):
    df = spark.createDataFrame([("é♪",)], "t string")

    def as_bytes(encoding):
        return bytes(df.select(encode_text(F.col("t"), encoding)).collect()[0][0])

    assert as_bytes("utf-8") == "é♪".encode() and as_bytes("UTF-8-SIG") == b"\xef\xbb\xbf" + "é♪".encode()
    assert as_bytes("utf-16") == b"\xff\xfe" + "é♪".encode("utf-16-le") and as_bytes("utf-16be") == "é♪".encode("utf-16-be")
    assert bytes(df.select(encode_text(F.lit("é€\x81"), "latin1")).collect()[0][0]) == b"\xe9\x80\x81"
    with pytest.raises(EncodingError):
        python_codec("no-such")
    with pytest.raises(Exception, match="cannot be encoded"):
        df.select(encode_text(F.col("t"), "windows-1252")).collect()


def test_names(spark):
    cases = {"/a/b.vtt": ("/a/b.srt", "/a/b_x.vtt"), "/a.d/b": ("/a.d/b.srt", "/a.d/b_x"), "c.tar.gz": ("c.tar.srt", "c.tar_x.gz")}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: (r.a, r.b) for r in df.select("p", converted_name(F.col("p")).alias("a"), with_suffix(F.col("p"), "_x").alias("b")).collect()} == cases


def test_command_line(spark, tmp_path, capsys):
    vtt, sub = tmp_path / "a.vtt", tmp_path / "b.srt"
    vtt.write_text("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n# Hé #\n")
    sub.write_text(SRT)
    assert cli.main(["version"]) == 0
    assert cli.main(["convert", str(vtt), "-e", "utf-16"]) == 0
    assert (tmp_path / "a.srt").read_bytes() == b"\xff\xfe" + "1\n00:00:01,000 --> 00:00:02,000\n♪ Hé ♪\n\n".encode("utf-16-le")
    assert cli.main(["convert", str(vtt), "-n", "-o", str(tmp_path / "out.txt")]) == 0
    assert (tmp_path / "out.srt").read_text() == "1\n00:00:01,000 --> 00:00:02,000\n# Hé #\n\n"
    assert cli.main(["process", str(sub), "mend"]) == 0
    assert "♪ La la ♪" in (tmp_path / "b_mend.srt").read_text() and "00:00:02,049" in (tmp_path / "b_mend.srt").read_text()
    assert cli.main(["process", str(sub), "-n", "strip-sdh"]) == 0
    assert (tmp_path / "b_sdh_stripped.srt").read_text() == SRT.replace("[door] ", "")
    same = tmp_path / "c.srt"
    same.write_text("1\n00:00:01,000 --> 00:00:02,000\nPlain.\n\n")
    assert cli.main(["process", str(same), "mend"]) == 0 and not (tmp_path / "c_mend.srt").exists()
    odd = tmp_path / "d.txt"
    odd.write_text("nothing")
    assert cli.main(["convert", str(odd)]) == 0 and not (tmp_path / "d.srt").exists()
    assert "unrecognized" in capsys.readouterr().out
    bad = tmp_path / "e.vtt"
    bad.write_text("WEBVTT\n\n1 --> 2 x\n")
    assert cli.main(["convert", str(bad)]) == 1
    assert cli.main(["process", str(tmp_path / "none.srt"), "mend"]) == 1


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.vtt").write_text(f"WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n# {n} #\n")
    for _ in range(2):
        query = process_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), mend)
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["♪ 1 ♪", "♪ 2 ♪"]
    assert stream_cues(spark, str(tmp_path / "in")).isStreaming


def test_intervals(spark):
    rows = [(1, 0, 10), (1, 5, 20), (1, 20, 30), (1, 40, 50), (1, 41, 42), (1, None, 5), (1, 7, 7), (1, 9, 3), (2, 3_599_999, 3_600_001), (2, 3_600_001, 7_300_000), (None, 1, 2), (1, 0, 10)]
    df = spark.createDataFrame(rows, "k int, start_ms long, end_ms long").withColumn("_s", F.lit(0))
    assert sorted(map(tuple, merge_intervals(df, ["k"]).collect())) == [(1, 0, 30), (1, 40, 50), (2, 3_599_999, 7_300_000)]
    assert [tuple(r) for r in interval_gaps(df, ["k"]).collect()] == [(1, 30, 40)]
    assert interval_gaps(df, ["k"], max_gap_ms=9).collect() == [] and intervals_and_gaps(df.limit(0), ["k"]).collect() == []


def test_entry_without_the_text_package():
    code = "import sys; sys.modules['subtide.llm'] = None\nimport __spark_entry__ as e\nq = e.queries(); assert 'mend' in q and not any(n.startswith('p2') for n in q) and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
