"""Command line: convert and repair caption files, one or as many as a glob names."""

from __future__ import annotations

import argparse
import datetime
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide import __version__
from subtide.operators.cues import changed_files
from subtide.operators.mend import mend
from subtide.operators.sdh import strip_sdh
from subtide.sources.captions import cues_of, detect_format, display_name, errors_of, parse_captions, read_files
from subtide.sources.sink import converted_name, with_suffix, write_srt


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="subtide", description="Convert and repair caption files.")
    out.add_argument("-d", "--debug", action="store_true", help="show debug logs")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="show the version")
    for name in ("convert", "process"):
        c = commands.add_parser(name)
        c.add_argument("file", help="a file, directory or glob")
        c.add_argument("-o", "--out", help="the output; only for a single file")
        c.add_argument("-l", "--language")
        c.add_argument("-e", "--encoding", default="utf-8")
        c.add_argument("-n", "--no-post-processing", action="store_true")
        c.add_argument("-g", "--keep-short-gaps", action="store_true")
        if name == "process":
            c.add_argument("processor", choices=["mend", "strip-sdh"])
    return out


def _session(debug: bool) -> SparkSession:
    spark = SparkSession.builder.appName("subtide").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if debug else "ERROR")
    return spark


def _paths(files: DataFrame, column, out: str | None) -> DataFrame:
    local = F.regexp_replace("path", r"\Afile:/*(?=/)", "")
    return files.select(F.col("path").alias("file_id"), (F.lit(out) if out else column(local)).alias("out"))


def _fail(parsed: DataFrame) -> int:
    errors = errors_of(parsed).collect()
    for e in errors:
        print(f"{e.file_id}: {e.error}", file=sys.stderr)
    return 1 if errors else 0


def convert(spark: SparkSession, args: argparse.Namespace) -> int:
    """Converted files are always written, as .srt; files of no known format are only named."""
    files = read_files(spark, args.file).withColumn("format", detect_format(F.col("content")))
    for row in files.select("path", display_name(F.col("format")).alias("name")).toLocalIterator():
        print(f"Subtitle format: {row.name}" if row.name else "Subtitle format was unrecognized...")
    known = files.where("format is not null")
    parsed = parse_captions(known, form=F.col("format"))
    if _fail(parsed):
        return 1
    cues = cues_of(parsed)
    print("Converted subtitle to SubRip (SRT)")
    if not args.no_post_processing:
        fixed = mend(cues, args.language, not args.keep_short_gaps)
        _report(changed_files(cues, fixed), "Processed subtitle and repaired some issues!", "Processed subtitle but no issues were found...")
        cues = fixed
    out = str(os.path.splitext(args.out)[0] + ".srt") if args.out else None
    paths = _paths(known, converted_name, out)
    write_srt(cues, paths, args.encoding)
    _saved(paths)
    return 0


def process(spark: SparkSession, args: argparse.Namespace) -> int:
    """Processed files are written only if the processor changed them, beside the input with a suffix."""
    files = read_files(spark, args.file)
    parsed = parse_captions(files, form="srt")
    if _fail(parsed):
        return 1
    cues = cues_of(parsed)
    if args.processor == "mend":
        done = mend(cues, args.language, not args.keep_short_gaps)
        changed = changed_files(cues, done)
        _report(changed, "Processed subtitle and repaired some issues!", "Processed subtitle but no issues were found...")
        suffix = "_mend"
    else:
        done = strip_sdh(cues)
        changed = changed_files(cues, done)
        _report(changed, "Processed subtitle and removed SDH!", "Processed subtitle but no SDH descriptions were found...")
        if not args.no_post_processing:
            done = mend(done, args.language, not args.keep_short_gaps)
            _report(changed, "Processed stripped subtitle and repaired some issues!", "Processed stripped subtitle but no issues were found...")
        suffix = "_sdh_stripped"
    touched = files.join(changed.where("changed").select(F.col("file_id").alias("path")), "path", "left_semi")
    paths = _paths(touched, lambda p: with_suffix(p, suffix), args.out)
    write_srt(done, paths, args.encoding)
    _saved(paths)
    return 0


def _report(changed: DataFrame, yes: str, no: str) -> None:
    for row in changed.groupBy("changed").count().collect():
        print((yes if row["changed"] else no) + (f" ({row['count']} files)" if row["count"] > 1 else ""))


def _saved(paths: DataFrame) -> None:
    for row in paths.select("out").toLocalIterator():
        print(f"Saved to: {row.out}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"subtide version {__version__} ({datetime.date.today().year})")
        return 0
    try:
        return {"convert": convert, "process": process}[args.command](_session(args.debug), args)
    except Exception as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
