"""Repair of common defects of cues: time codes, texts, tags, duplicates, short gaps.

Rows are repaired on their own; what needs a file as a whole is aggregated to
a row per file; what needs neighbours looks at them within blocks of places
(see ``with_neighbours``). The merging of cues is a fold along the list, cut
into islands at cues that are kept whatever came before them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.functions.fixline import with_fixed_text
from subtide.functions.textrules import is_blank
from subtide.operators.cues import BLOCK, COLUMNS, sort_cues
from subtide.operators.stages import cut

# Fixed values.
#: Hours beyond which a time code counts from another day.
LAST_HOUR = 23
#: Cues a file must have more of before tags on all of them are dropped.
ITALIC_FILE, TOP_FILE = 10, 100
#: The longest gap in milliseconds that counts as short, and the gap below which equal texts join.
SHORT_GAP_MS, JOIN_GAP_MS = 85, 10
RTL_LANGUAGES = ["ar", "fa", "he", "ps", "syc", "ug", "ur"]
RTL_CONTROLS = "‎‏‪‫‬‭‮"
RTL_MARK = "‫"
ALIASES = {
    "en": ["en", "eng", "english"],
    "ar": ["ar", "ara", "arabic"],
    "fa": ["fa", "fas", "per", "persian", "farsi"],
    "he": ["he", "heb", "hebrew", "iw"],
    "ps": ["ps", "pus", "pashto", "pushto"],
    "syc": ["syc", "syr", "syriac"],
    "ug": ["ug", "uig", "uyghur", "uighur"],
    "ur": ["ur", "urd", "urdu"],
}


def language_code(language: Column) -> Column:
    """The code of a code, a name or ``Name (REGION)``; null for null, blank and what begins with a mark."""
    aliases = F.create_map(*(F.lit(x) for code, names in ALIASES.items() for name in names for x in (name, code)))
    low = F.lower(F.regexp_replace(language, r"(?U)\A\s+|\s+\z", ""))
    bare = F.when(F.contains(low, F.lit("(")), F.regexp_replace(F.substring_index(low, "(", 1), r"(?U)\A\s+|\s+\z", "")).otherwise(low)
    primary = F.regexp_replace(F.regexp_extract(bare, r"\A([^-_]*)", 1), r"(?U)\A\s+|\s+\z", "")
    word = F.regexp_extract(bare, r"(?U)\A\s*(\S*)", 1)
    known = F.coalesce(F.try_element_at(aliases, bare), F.try_element_at(aliases, primary), F.try_element_at(aliases, word), primary)
    return F.when((low != "") & (primary != ""), known)


def fix_time_codes(cues: DataFrame) -> DataFrame:
    """From the first cue beyond LAST_HOUR on, times go back by that cue's hours."""
    hours = F.expr("start_ms div 3600000")
    first = cues.where(hours > LAST_HOUR).groupBy("file_id").agg(F.min(F.struct("seq", hours.alias("hours"))).alias("_f"))
    late = F.col("seq") >= F.col("_f.seq")
    back = F.when(late, F.col("_f.hours") * 3_600_000).otherwise(0)
    joined = cues.join(first, "file_id", "left").withColumn("_back", F.coalesce(back, F.lit(0)))
    return joined.withColumn("start_ms", F.col("start_ms") - F.col("_back")).withColumn("end_ms", F.col("end_ms") - F.col("_back")).drop("_f", "_back")


def correct_texts(cues: DataFrame) -> DataFrame:
    """Each text with character references decoded twice and its lines repaired."""
    return with_fixed_text(cues, "content")


def remove_global_tags(cues: DataFrame) -> DataFrame:
    """Without italics, or the top position, where every cue of a long enough file has it."""
    content = F.col("content")
    italic = content.startswith("<i>") & content.endswith("</i>")
    inner = F.substr(content, F.lit(4), F.greatest(F.length(content) - 7, F.lit(0)))
    flags = cues.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(italic).alias("_italic"),
        F.bool_and(content.startswith("{\\an8}")).alias("_top"),
        F.bool_and(F.when(italic, inner).otherwise(content).startswith("{\\an8}")).alias("_inner_top"),
    )
    strip = (F.col("_n") > ITALIC_FILE) & F.col("_italic")
    text = F.when(strip, inner).otherwise(content)
    top = (F.col("_n") > TOP_FILE) & F.when(strip, F.col("_inner_top")).otherwise(F.col("_top"))
    return cues.join(flags, "file_id").withColumn("content", F.when(top, F.substr(text, F.lit(7))).otherwise(text)).select(*cues.columns)


def with_neighbours(cues: DataFrame, before: int, after: int, columns: list[str], block: int = BLOCK) -> tuple[DataFrame, Window, Column]:
    """(rows, window, own): rows with guests of the blocks beside them; own tells a block's own rows.

    seq must be dense, so the neighbours of a block's edge are the last and
    first rows of the blocks beside it.
    """
    place = F.pmod("seq", F.lit(block))
    home = F.floor(F.col("seq") / F.lit(block))
    blocks = F.array_compact(F.array(home, F.when(place >= block - before, home + 1), F.when(place < after, home - 1)))
    rows = cues.select(*columns, home.alias("_home"), F.explode(blocks).alias("_block"))
    return rows, Window.partitionBy("file_id", "_block").orderBy("seq"), F.col("_home") == F.col("_block")


def combine_timecodes(cues: DataFrame, remove_gaps: bool = True) -> DataFrame:
    """Cues merged along the list, in five rules against the last cue kept.

    Same times: texts are joined by a newline. Same text within JOIN_GAP_MS of
    its end, or an overlap: the last one reaches to this end. A text that
    begins with the last one after a short gap takes its place (only if gaps
    are removed). Directly behind the last one: that one ends 1 ms earlier.
    Otherwise a cue is kept unless blank; the first of a file is always kept.
    """
    rows, along, own = with_neighbours(cues.select(*COLUMNS), 2, 1, COLUMNS)
    blank = is_blank(F.col("content"))
    gap = F.col("start_ms") - F.col("_pe")
    extends = F.lit(remove_gaps) & (gap > 0) & (gap <= SHORT_GAP_MS) & F.col("content").startswith(F.col("_pc"))
    joins = (gap < JOIN_GAP_MS) & (F.col("content") == F.col("_pc"))
    # The last cue kept before this one ends and reads as the row before it, if that row and the one before are not blank and differ in end.
    known = ~F.col("_pb") & (F.col("_first_two") | (~F.col("_ppb") & (F.col("_pe") != F.col("_ppe")))) & (F.col("end_ms") != F.col("_pe"))
    seen = rows.select("*", blank.alias("_b")).select(
        "*",
        F.lag("end_ms").over(along).alias("_pe"),
        F.lag("content").over(along).alias("_pc"),
        F.lag("_b").over(along).alias("_pb"),
        F.lag("end_ms", 2).over(along).alias("_ppe"),
        F.lag("_b", 2).over(along).alias("_ppb"),
        F.lag("seq", 2).over(along).isNull().alias("_first_two"),
    )
    opens = F.col("_pe").isNull() | (known & ~F.col("_b") & ~joins & ~extends)
    forced = F.coalesce(known & (joins | extends), F.lit(False))
    marked = seen.withColumn("_opens", F.coalesce(opens, F.lit(False))).withColumn("_forced", ~F.col("_opens") & forced)
    marked = marked.withColumn("_cut", F.lead(F.struct((F.col("_opens") & (gap == 0)).alias("abuts"), F.col("_forced").alias("forced"))).over(along))
    kept = marked.where(own & ~(F.col("_forced") & F.coalesce("_cut.forced", F.lit(False))))
    # An island is known by the place of its first row; the last one of a block is handed on to the next.
    home = Window.partitionBy("file_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("_open_at", F.when(F.col("_opens"), F.col("seq"))).withColumn("_island", F.last("_open_at", ignorenulls=True).over(home))
    kept = cut(kept.select("file_id", "_block", "_island", "_open_at", *COLUMNS[1:], "_forced", "_cut"))
    ends = kept.groupBy("file_id", "_block").agg(F.max("_open_at").alias("_last"))
    earlier = Window.partitionBy("file_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file_id", "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    homed = kept.join(carried, ["file_id", "_block"]).withColumn("_island", F.coalesce("_island", "_carry"))
    item = F.struct("seq", "idx", "start_ms", "end_ms", "content", "_forced", F.coalesce("_cut.abuts", F.lit(False)).alias("abuts"))
    islands = homed.groupBy("file_id", "_island").agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    folded = islands.select("file_id", F.explode(_fold(F.col("_rows"), remove_gaps)).alias("_c"))
    return sort_cues(folded.select("file_id", "_c.seq", "_c.idx", "_c.start_ms", "_c.end_ms", "_c.content"), once=True)


def _fold(rows: Column, remove_gaps: bool) -> Column:
    """The cues kept of one island, the last of them 1 ms shorter if the next island abuts."""

    def cue(r: Column, **new: Column) -> Column:
        return F.struct(*(new.get(c, r[c]).alias(c) for c in ("seq", "idx", "start_ms", "end_ms", "content")))

    def step(kept: Column, r: Column) -> Column:
        last = F.element_at(kept, -1)
        rest = F.slice(kept, F.lit(1), F.size(kept) - 1)
        gap = r["start_ms"] - last["end_ms"]
        same = (r["start_ms"] == last["start_ms"]) & (r["end_ms"] == last["end_ms"])
        joined = F.when(last["content"] != r["content"], F.concat(last["content"], F.lit("\n"), F.replace(r["content"], F.lit("{\\an8}"), F.lit("")))).otherwise(last["content"])
        extends = F.lit(remove_gaps) & (gap > 0) & (gap <= SHORT_GAP_MS) & r["content"].startswith(last["content"])

        def put(c: Column) -> Column:
            return F.concat(rest, F.array(c))

        longer = cue(last, end_ms=r["end_ms"], content=r["content"])
        return (
            F.when(F.size(kept) == 0, F.array(cue(r)))
            .when(r["_forced"], put(longer))
            .when(same, put(cue(last, content=joined)))
            .when((gap < JOIN_GAP_MS) & (r["content"] == last["content"]), put(cue(last, end_ms=r["end_ms"])))
            .when(extends, put(longer))
            .when(gap == 0, F.concat(put(cue(last, end_ms=last["end_ms"] - 1)), F.array(cue(r))))
            .when(~is_blank(r["content"]), F.concat(kept, F.array(cue(r))))
            .otherwise(kept)
        )

    none = F.filter(F.transform(rows, lambda r: cue(r)), lambda r: F.lit(False))
    kept = F.aggregate(rows, none, step)
    abuts = F.element_at(rows, -1)["abuts"]
    return F.transform(kept, lambda c, i: cue(c, end_ms=F.when(abuts & (i == F.size(kept) - 1), c["end_ms"] - 1).otherwise(c["end_ms"])))


def remove_short_gaps(cues: DataFrame) -> DataFrame:
    """Sorted cues with gaps of 2 to SHORT_GAP_MS ms closed to 1 ms, and blank cues gone.

    A blank cue stays where it stands behind such a gap, and the first of a
    file always. seq must be dense, as sort_cues leaves it.
    """
    rows, along, own = with_neighbours(cues.select(*COLUMNS), 2, 2, COLUMNS)
    blank = is_blank(F.col("content"))
    gap = F.col("start_ms") - F.lag("end_ms").over(along)
    seen = rows.select("*", blank.alias("_b"), F.coalesce((gap > 1) & (gap <= SHORT_GAP_MS), F.lit(False)).alias("_short"), F.lag("seq").over(along).isNull().alias("_first"))
    seen = seen.withColumn("_gone", F.col("_b") & ~F.col("_short") & ~F.col("_first"))
    # A blank cue is settled by the row before it, unless that one is blank too: such files are scanned.
    seen = seen.withColumn("_open", F.coalesce(F.col("_b") & F.lag(F.col("_b") & ~F.col("_first")).over(along), F.lit(False)))
    ahead = along.rowsBetween(1, 2)
    seen = seen.withColumn("_next", F.first(F.when(~F.col("_gone"), F.col("start_ms")), ignorenulls=True).over(ahead)).where(own)
    seen = cut(seen.select(*COLUMNS, "_gone", "_open", "_next"))
    open_files = seen.where("_open").select("file_id").distinct()
    next_gap = F.col("_next") - F.col("end_ms")
    end = F.when((next_gap > 1) & (next_gap <= SHORT_GAP_MS), F.col("_next") - 1).otherwise(F.col("end_ms"))
    settled = seen.where(~F.col("_gone")).join(open_files, "file_id", "left_anti").withColumn("end_ms", end).select(*COLUMNS)
    return sort_cues(settled.unionByName(_close_with_blanks(cues.join(open_files, "file_id", "left_semi"))), once=True)


def _close_with_blanks(cues: DataFrame) -> DataFrame:
    """Short gaps of files with blank cues in a row: a scan along each list, with the last cue kept as its state.

    combine_timecodes leaves a blank cue only as a file's first or right behind
    another cue, so there is hardly such a file. The scan streams; it holds one row.
    """
    schema = cues.select(*COLUMNS).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, last = None, None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False, name=None):
                if row[0] != file:
                    if last is not None:
                        done.append(last)
                    file, last = row[0], list(row)
                    continue
                gap = row[3] - last[4]
                short = 1 < gap <= SHORT_GAP_MS
                if short:
                    last[4] = row[3] - 1
                if short or row[5].strip():
                    done.append(last)
                    last = list(row)
            yield pd.DataFrame(done, columns=COLUMNS)
        if last is not None:
            yield pd.DataFrame([last], columns=COLUMNS)

    return cues.select(*COLUMNS).repartition("file_id").sortWithinPartitions("file_id", "seq").mapInPandas(run, schema)


def rtl_text(text: Column) -> Column:
    """A text with a right-to-left mark before each line, and no other direction controls."""
    return F.concat(F.lit(RTL_MARK), F.replace(F.translate(text, RTL_CONTROLS, ""), F.lit("\n"), F.lit("\n" + RTL_MARK)))


def mark_rtl(cues: DataFrame) -> DataFrame:
    """Every text as rtl_text."""
    return cues.withColumn("content", rtl_text(F.col("content")))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_text(cues: DataFrame, where: Column | None = None) -> DataFrame:
    """Texts in Unicode's compatibility form; only texts beyond ASCII leave the Java side."""
    content = F.col("content")
    wanted = content.rlike(r"[^\x00-\x7f]") & (F.lit(True) if where is None else where)
    return cues.withColumn("_form", _nfkc(F.when(wanted, content))).withColumn("content", F.coalesce("_form", "content")).drop("_form")


def mend(cues: DataFrame, language: str | Column | None = None, remove_gaps: bool = True) -> DataFrame:
    """All repairs in order; language is a name for all files, or a column of cues.

    Right-to-left languages get their marks, English its compatibility form.
    Empty tables give empty tables.
    """
    coded = cues.withColumn("_lang", language_code(language if isinstance(language, Column) else F.lit(language).cast("string")))
    langs = coded.groupBy("file_id").agg(F.min("_lang").alias("_lang")) if isinstance(language, Column) else None
    done = remove_global_tags(cut(correct_texts(fix_time_codes(cues.select(*COLUMNS)))))
    done = combine_timecodes(done, remove_gaps)
    if remove_gaps:
        done = remove_short_gaps(done)
    if langs is None and language is None:
        return done
    done = done.join(langs, "file_id") if langs is not None else done.withColumn("_lang", language_code(F.lit(language)))
    done = done.withColumn("content", F.when(F.col("_lang").isin(RTL_LANGUAGES), rtl_text(F.col("content"))).otherwise(F.col("content")))
    return normalize_text(done, F.coalesce(F.col("_lang") == "en", F.lit(False))).drop("_lang")
