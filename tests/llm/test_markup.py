"""Problem 2: trees, simple tree matching, templates, clean text."""

import pytest

from subtide.llm.dom import Tree, align, fragments, likeness, match, parse, render, skeleton, unskeleton
from subtide.llm.wrapper import clean_markup, find_markup

SOUND = [
    "<i>Go on.</i>", "{\\an8}Up here.", "- One.\n- Two.", ">> HOST: Hm.", "# la la #", "* la la *", "♪ la ♪", "[door slams] Oh.", "I <3 you",
    "~4 km, then left", "a/b_2 and run_no_3", "7 * 8 * 2", "100% & more", "R&D said", "It costs $5, not $10: fine.", "Save it to C:\\temp\\new7.",
    "You're the #7 fan.", "- What?\n- 9 > 8!", "If it is < 3 or > 7, stop.", "Wait... [7]", "",
]
MARKED = [
    ("<b>Bold</b> &amp; more", "Bold & more"), ("a<!-- take 9 --> b", "a b"), ("## Title\nText", "## Title\nText"), ("**a** __b__ ~~c~~ `d`", "a b c `d`"),
    ("[a](https://x.example/1)", "a"), ("![a](img/1.png) b", "b"), ("== Head ==\nText", "## Head\nText"), ("'''a''' ''b''", "a b"), ("[[A|b]] {{cite|1}}c", "b c"),
    ("* a\n* b", "- a\n- b"), ("1. a\n2. b", "1. a\n2. b"), ("```\nx = 1\n```\nb", "```\nx = 1\n```\nb"), ("\\emph{a b}~\\cite{q5}", "a b"),
    ("\\section{A}\nb", "## A\nb"), ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "- a\n- b"), ("so $k^3 + m^3$.", "so $k^3 + m^3$."),
    ("| a | 1 |\n|---|---|\n| b | 2 |", "a | 1\nb | 2"), ('{| class="t"\n|-\n| a || 1\n|}', "a | 1"), ("&amp;lt;em&amp;gt;", "<em>"),
]


@pytest.mark.parametrize("text", SOUND)
def test_plain_signs_are_text(text):
    assert fragments(parse(text)) == []


@pytest.mark.parametrize(("text", "clean"), MARKED)
def test_clean_text(text, clean):
    tree = parse(text)
    assert fragments(tree) and render(tree) == clean


def test_long_and_deep_texts_end():
    assert fragments(parse("<b>" * 5000 + "x"))
    assert fragments(parse("x" * 200_000 + "<br>" + "[" * 2000))


def test_simple_tree_matching():
    a, b = (unskeleton(s) for s in ("table(tr(td(#)+)+)", "table(tr(td(#)+ td) tr)"))
    assert match(a, a) == a.size() == 4 and likeness(a, a) == 1
    assert match(a, b) == 4 and match(a, Tree("ul")) == 0
    assert str(align(a, b)) == "table(tr(td(#)+ td?)+ tr?)"
    assert skeleton(fragments(parse("* a\n* b\n* c"))[0]) == "ul(li(#)+)"


def test_operators(spark):
    rows = [("a", 1, "<b>x</b>", 7), ("a", 1, "<b>x</b>", 7), ("a", 2, None, None), ("a", 3, "", 7), ("b", 1, "plain", 7), (None, 4, "x<br>y", 7)]
    df = spark.createDataFrame(rows, "page string, seq int, content string, skel int")
    found = find_markup(df, ["page", "seq"], host="page").collect()
    assert sorted((r.page or "", r.seq, r.n_regions, r.templates) for r in found) == [("", 4, 1, ["br"]), ("a", 1, 1, ["b(#)"])]
    assert sorted((r.page or "", r.clean) for r in clean_markup(df, ["page", "seq"]).collect()) == [("", "x\ny"), ("a", "x")]
    assert find_markup(df.limit(0), ["page", "seq"]).collect() == []


def test_boilerplate_goes(spark):
    df = spark.createDataFrame([(i, f"<b>Share this</b> <em>text {i}</em>") for i in range(30)], "id int, content string")
    assert {r.clean for r in clean_markup(df, ["id"]).collect()} == {f"text {i}" for i in range(30)}
