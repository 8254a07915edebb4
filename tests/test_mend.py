"""Repairs of cues: each case checks a property that a user of captions relies on."""

import random

import pytest
from pyspark.sql import functions as F

from subtide.functions.fixline import PLAIN, RULES, steps, with_fixed_text
from subtide.operators.cues import COLUMNS, sort_cues
from subtide.operators.mend import _close_with_blanks, combine_timecodes, fix_time_codes, language_code, mark_rtl, mend, remove_global_tags, remove_short_gaps
from tests.captions import cues, rows, said, texts

TOP = "{\\an8}"


def wrong(text: str) -> str:
    """A text whose UTF-8 was read as windows-1252."""
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())


LINES = {
    "#Tagged": "#Tagged",
    "# #Tagged #": "♪ #Tagged ♪",
    "# La la la #": "♪ La la la ♪",
    "Number #1!": "Number #1!",
    "# <i>La la</i>": "<i>♪ La la</i>",
    "# La la\nda da #": "♪ La la\nda da ♪",
    "ONE FM\n#1 for you": "ONE FM\n#1 for you",
    "♪ <i>Rain</i>♪": "<i>♪ Rain ♪</i>",
    "*Sigh*": "*Sigh*",
    "* Sigh *": "♪ Sigh ♪",
    "♫ Storm": "♪ Storm",
    "Here it is.Really?": "- Here it is.\n- Really?",
    "We won't wait.She's gone.": "- We won't wait.\n- She's gone.",
    "- One. Mr.Brown...\n- Two...": "- One. Mr.Brown...\n- Two...",
    "..whoooa........": "...whoooa...",
    "<i>No more..........</i>": "<i>No more...</i>",
    "<i>    One</i> <i>two</i>\n<i>Three </i>four": "<i>One two\nThree</i> four",
    "{\\an3}{\\an8}<i><i>One\nTwo</i>": TOP + "<i>One\nTwo</i>",
    "<b>bold</b>": "bold",
    "<i>   \nmiddle\n</i>": "<i>middle</i>",
    "<i>LATER:</i> <i>\nA made-up line.</i> <i>\nAnd the end.</i>": "<i>LATER:\nA made-up line.\nAnd the end.</i>",
    "-Yes.\n-$20?": "- Yes.\n- $20?",
    "[A-Za-z0-9]": "",
    "A": "A",
    wrong(wrong("café ♪")): "café ♪",
    wrong(wrong(wrong("ＡＢＣ"))): "ＡＢＣ",
    "It&amp;#39;s": "It's",
    "one,two": "one, two",
    "( low )": "(low)",
    "Wait--  what": "Wait-- what",
    "": "",
}


@pytest.fixture(scope="module")
def fixed(spark):
    df = spark.createDataFrame([(k,) for k in LINES], "t string")
    return {r.t: r.f for r in with_fixed_text(df.withColumn("f", F.col("t")), "f").collect()}


@pytest.mark.parametrize("text", LINES)
def test_line(fixed, text):
    assert fixed[text] == LINES[text]


def test_plain_texts_are_what_no_repair_changes(spark):
    rng = random.Random(3)
    words = ["I", "am", "Mr", "it's", "Don't", "42", "x", "McCoy", "I'm", "ABC", "the", "a1"]
    made = {"".join(rng.choice(words) + rng.choice([" ", ", ", " "]) for _ in range(rng.randint(0, 6))) + rng.choice(words) + rng.choice(["", ".", "!", "?"]) for _ in range(500)}
    df = spark.createDataFrame([(t,) for t in sorted(made)], "t string").where(F.col("t").rlike(PLAIN)).withColumn("f", F.col("t"))
    for step in steps() * 2:
        df = df.withColumn("f", step(F.col("f")))
    assert df.count() > 400 and df.where("t != f").collect() == []


def test_rules_are_named_once():
    assert len({r.name for r in RULES}) == len(RULES)


def test_time_codes_from_the_first_late_cue(spark):
    hour = 3_600_000
    df = cues(spark, [(0, 1, "a"), (27 * hour, 27 * hour + 1, "b"), (2 * hour, 2 * hour + 1, "c"), (28 * hour, 28 * hour + 1, "d")])
    assert [r.start_ms // hour for r in fix_time_codes(df).orderBy("seq").collect()] == [0, 0, -25, 1]


def test_global_tags(spark):
    assert said(remove_global_tags(texts(spark, ["<i>x</i>"] * 11))) == ["x"] * 11
    assert said(remove_global_tags(texts(spark, ["<i>x</i>"] * 10))) == ["<i>x</i>"] * 10
    assert said(remove_global_tags(texts(spark, [TOP + "x"] * 101))) == ["x"] * 101
    assert said(remove_global_tags(texts(spark, ["<i>" + TOP + "x</i>"] * 101))) == ["x"] * 101
    assert said(remove_global_tags(texts(spark, [TOP + "x"] * 100)))[0] == TOP + "x"


def test_merging(spark):
    assert rows(combine_timecodes(cues(spark, [(0, 105, "a"), (105, 1000, "b")]))) == [(0, 104, "a"), (105, 1000, "b")]
    assert rows(combine_timecodes(cues(spark, [(5, 9, TOP + "a"), (5, 9, TOP + "b")]))) == [(5, 9, TOP + "a\nb")]
    assert rows(combine_timecodes(cues(spark, [(0, 9, "a"), (0, 9, "a"), (20, 30, "b")]))) == [(0, 9, "a"), (20, 30, "b")]
    assert rows(combine_timecodes(cues(spark, [(0, 9, "a"), (12, 20, "a"), (90, 99, "ab"), (500, 600, " ")]))) == [(0, 99, "ab")]


def test_gaps(spark):
    df = cues(spark, [(0, 100, "a"), (183, 1000, "b"), (1001, 1002, ""), (1090, 1100, "c")])
    assert rows(remove_short_gaps(df)) == [(0, 182, "a"), (183, 1000, "b"), (1090, 1100, "c")]
    assert rows(mend(cues(spark, [(0, 100, "one"), (183, 1000, "two")]), remove_gaps=False)) == [(0, 100, "one"), (183, 1000, "two")]
    assert rows(mend(cues(spark, []))) == []


def _plain_merge(rows, remove_gaps):
    """The merging as one walk along a list."""
    kept = []
    for start, end, text in rows:
        if not kept:
            kept.append([start, end, text])
            continue
        last = kept[-1]
        gap = start - last[1]
        if (start, end) == (last[0], last[1]):
            if text != last[2]:
                last[2] += "\n" + text.replace(TOP, "")
        elif gap < 10 and text == last[2]:
            last[1] = end
        elif 0 < gap <= 85 and text.startswith(last[2]) and remove_gaps:
            last[1:] = [end, text]
        elif gap == 0:
            last[1] -= 1
            kept.append([start, end, text])
        elif text.strip():
            kept.append([start, end, text])
    return [tuple(k) for k in sorted(kept, key=lambda k: k[:2])]


@pytest.mark.parametrize("remove_gaps", [True, False])
def test_merging_equals_a_plain_walk(spark, remove_gaps):
    rng = random.Random(7)
    files = {}
    for f in range(400):
        at, own = 0, []
        for _ in range(rng.randint(1, 14)):
            start = at + rng.choice([-30, -3, 0, 0, 1, 5, 20, 85, 86, 300])
            end = start + rng.choice([0, 4, 40, 100])
            if own and rng.random() < 0.25:
                start, end = own[-1][:2]
            own.append((start, end, rng.choice(["a", "a", "ab", "b", "", " ", TOP + "a"])))
            at = end
        files[f] = own
    df = spark.createDataFrame([(f, i, i, *r) for f, own in files.items() for i, r in enumerate(own, 1)], "file_id long, seq long, idx int, start_ms long, end_ms long, content string")
    found = {}
    for r in combine_timecodes(df, remove_gaps).orderBy("file_id", "seq").collect():
        found.setdefault(r.file_id, []).append((r.start_ms, r.end_ms, r.content))
    expected = {f: _plain_merge(own, remove_gaps) for f, own in files.items()}
    assert {f: (own, found[f], expected[f]) for f, own in files.items() if found[f] != expected[f]} == {}
    # The closing of gaps, settled by neighbours, equals the scan of each list.
    merged = combine_timecodes(df, True)
    again = sort_cues(_close_with_blanks(merged))
    assert sorted(map(tuple, remove_short_gaps(merged).select(*COLUMNS).collect())) == sorted(map(tuple, again.select(*COLUMNS).collect()))


def test_long_files_are_cut_into_blocks(spark):
    n = 5000
    df = spark.range(1, n + 1).select(
        F.lit(1).cast("long").alias("file_id"), F.col("id").alias("seq"), F.col("id").cast("int").alias("idx"),
        (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 100).alias("end_ms"), F.concat(F.lit("x"), (F.col("id") / 3).cast("long")).alias("content"),
    )
    found = rows(combine_timecodes(df))
    assert found == _plain_merge([tuple(r) for r in df.select("start_ms", "end_ms", "content").orderBy("start_ms").collect()], True)


def test_languages(spark):
    cases = {"English (US)": "en", "eng": "en", " heb ": "he", "iw": "he", "fa-IR": "fa", "zh_CN": "zh", "Urdu": "ur", "": None, "-x": None, None: None, "fr": "fr"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    assert {r.l: r.c for r in df.select("l", language_code(F.col("l")).alias("c")).collect()} == cases


def test_right_to_left_and_compatibility_forms(spark):
    assert said(mark_rtl(texts(spark, ["‏שלום\nעולם"]))) == ["‫שלום\n‫עולם"]
    assert said(mend(texts(spark, ["‏שלום\nעולם"]), "Hebrew")) == ["‫שלום\n‫עולם"]
    assert said(mend(texts(spark, ["ＡＢＣ"]), "eng")) == ["ABC"]
    assert said(mend(texts(spark, ["ＡＢＣ"]), "fr")) == ["ＡＢＣ"]
    assert said(mend(texts(spark, ["ＡＢＣ"]).withColumn("lang", F.lit("English")), F.col("lang"))) == ["ABC"]


def test_long_texts_end(spark):
    rows = [" " * 3000 + "x", "é" * 60_000, "Ã©" * 30_000, "a." * 20_000, "<i>" * 3000, "&amp;" * 3000, "word " * 40_000]
    found = said(mend(texts(spark, rows)))
    assert found[0] == "x" and found[1] == "é" * 60_000 and found[2] == "é" * 30_000 and found[-1] == ("word " * 40_000).strip()
