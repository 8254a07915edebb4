"""Annotations taken out of cues."""

import pytest

from subtide.operators.mend import mend
from subtide.operators.sdh import strip_sdh
from tests.captions import said, texts

SCENE = [
    'TV HOST:\n<i>"B" what?</i>', "- ♪ Oh, you ♪\n- ♪ Oh, you ♪", "[ Band's \"Roll'em\" playing ]", "♪", "- [whispering]\n- [distant thunder]", "It's time!\n[ Crowd cheering ]",
    "{\\an8}(EERIE MUSIC PLAYING) Scary!", "[Ann] Hm?\n<i>(Bob) Hi!</i>", "- I read that last summer.\n- (MACHINE HUMS)", "- Ha!\n- PUPIL: No, thanks.",
    ">> SO THIS IS MY DESK\nHERE. IN IT IS A LOT", ">>",
]


def test_scene(spark):
    bare = said(strip_sdh(texts(spark, SCENE)))
    assert bare == [
        '<i>"B" what?</i>', "- ♪ Oh, you ♪\n- ♪ Oh, you ♪", "It's time!", "{\\an8} Scary!", "Hm?\n<i> Hi!</i>", "I read that last summer.", "- Ha!\n-No, thanks.", "SO THIS IS MY DESK\nHERE. IN IT IS A LOT",
    ]
    mended = said(mend(strip_sdh(texts(spark, SCENE))))
    assert mended[3:5] == ["{\\an8}Scary!", "Hm?\n<i>Hi!</i>"] and mended[6] == "- Ha!\n- No, thanks."


def test_single_texts(spark):
    cases = ["[bleep]", "(bleep)", "[loud crowd] Run!", "PART:00:11:22", "GUIDE: Real words", "[bleep] happens.", "- Alone", "(a note)"]
    assert said(strip_sdh(texts(spark, cases))) == ["Run!", "PART:00:11:22", "Real words", "[bleep] happens.", "Alone"]
    assert said(mend(strip_sdh(texts(spark, ["We [people laughing loudly] won."])))) == ["We won."]


def test_extra_patterns(spark):
    assert said(strip_sdh(texts(spark, ["This is a WORD here.", "Plain."]), [r"\bWORD\b"])) == ["This is a  here.", "Plain."]
    assert said(strip_sdh(texts(spark, ["one  at  12:34"]), [r"\d{1,2}:\d{2}", r"\s+"])) == ["oneat"]
    assert said(strip_sdh(texts(spark, ["all of it"]), [".*"])) == []
    with pytest.raises(ValueError, match="unclosed"):
        strip_sdh(texts(spark, ["x"]), [r"\bfine\b", "[unclosed"])


def test_long_texts_end(spark):
    rows = [" " * 3000 + "x", "A " * 3000, "<i>" + " " * 3000 + ": b", "[" * 3000, "word " * 40_000]
    assert said(strip_sdh(texts(spark, rows)))[2] == "b"
