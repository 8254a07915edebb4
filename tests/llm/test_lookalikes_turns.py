"""p3_found and p4_found on a few rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from subtide.llm.lookalikes import COLLATION, consistent_forms, find_lookalikes, shape
from subtide.llm.linetrees import Tree, label, tokens
from subtide.llm.linetrees import shape as line_shape
from subtide.llm.turns import find_turns, heads, utterances

CAST = ((1, "Corvane Ludovarn", "professor"), (2, "Meriet Whistoff", None))


ALIKE = [
    ("The Offs\u0435t H\u043eur\u200b", "The Offset Hour"), ("re\u0301sume\u0301", "r\u00e9sum\u00e9"), ("\uff34\uff48\uff45\u3000\uff28\uff4f\uff55\uff52", "The Hour"),
    ("o\ufb03ce", "office"), ("\uff76\uff9e\uff97\uff7d", "\u30ac\u30e9\u30b9"), ("\u0451", "\u00eb"), ("m\u0142yn", "ml\u0338yn"), ("a\u00a0 b ", "a b"),
]
UNLIKE = [("resume", "r\u00e9sum\u00e9"), ("Offset", "offset"), ("a", "b"), ("\u0434", "g")]


@pytest.mark.parametrize(("pairs", "same"), [(ALIKE, True), (UNLIKE, False)])
def test_classes(spark, pairs, same):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (F.collate(shape("a"), COLLATION) == F.collate(shape("b"), COLLATION)).alias("same"))
    assert [r for r in rows.collect() if r.same is not same] == []


def test_forms_of_a_class(spark):
    df = spark.createDataFrame([("caf\u00e9",)] * 2 + [("cafe\u0301",), ("cafe",), (None,), ("",), ("\u200b",), ("\u200c",)], "content string")
    assert sorted(map(tuple, consistent_forms(df).collect())) == [("cafe\u0301", "caf\u00e9", 1), ("caf\u00e9", "caf\u00e9", 2)]
    agreed = spark.createDataFrame([(1, "caf\u00e9"), (2, None), (3, "")], "phrase_id long, phrase string")
    assert [tuple(r) for r in find_lookalikes(df.withColumn("k", F.lit(1)), agreed, ["k"]).collect()] == [(1, "cafe\u0301", 1, "caf\u00e9")]


def said(text):
    return utterances(text, [(at, end, by) for at, end, _, by in heads(text, CAST) if by])


def test_utterances():
    assert said("[00:17:43] >> Prof. Ludovarn (on phone): Um, here.") == [(1, "here.")]
    assert said("LUDRVARN: It is. Whistoff, Meriet：No.") == [(1, "It is."), (2, "No.")]
    assert said("- [Meriet] (sighs) Go.\n- <i>C. Ludovarn:</i> Stay.") == [(2, "Go."), (1, "Stay.")]
    assert said("Note: that is all.") == [(None, "Note: that is all.")]
    assert said("PROFESSOR: Uh-huh... [laughs]") == [] and said("") == []


def test_line_templates():
    assert line_shape(tokens("[00:17:43] >> <i>Ann B.</i>: Hi")) == "[ <time> ] >> <words> : <words>"
    assert label(tokens("Ann (off): x")) == (0, 5) and label(tokens("[Ann] x")) == (1, 3) and label(tokens("Ann said so.")) is None
    tree = Tree()
    keys = [tree.add(x) for x in ("<words> : <words> ( <words> )", "<words> : <words> ( <words> ]", "<words> : <words>", "[ <words> ] <words>")]
    assert keys[0] == keys[1] and len(set(keys)) == 3 and tree.template(keys[0]) == "<words> : <words> ( <words> *"


def test_turns_cross_blocks(spark):
    names = {1: "Corvane", 2: "Meriet"}
    rows, expected, who = [], [], None
    for seq in range(1, 200):
        by = {0: 1, 5: 2, 6: None}.get(seq % 17)
        rows.append((1, seq, f"{names[by]}: Word." if by else "More words." if seq % 4 else None))
        if not rows[-1][2]:
            continue
        if by and by != who:
            expected.append([by, seq, seq])
            who = by
        elif expected:
            expected[-1][2] = seq
    cue = spark.createDataFrame(rows, "file_id long, seq long, content string")
    cast = spark.createDataFrame([(1, *p) for p in CAST], "file_id long, speaker_id long, full_name string, role_label string")
    for block in (7, 64, 2048):
        found = find_turns(cue, cast, block=block).orderBy("first_seq").collect()
        assert [[r.speaker_id, r.first_seq, r.last_seq] for r in found] == expected
    assert find_turns(cue.limit(0), cast).collect() == [] and find_turns(cue, cast.limit(0)).collect() == []


def test_queries(spark, tmp_path):
    cue = [
        (1, 1, "Nobody yet."), (1, 2, "LUDOVARN: One."), (1, 2, "LUDOVARN: One."), (1, 3, "Meriet: Um."), (1, 4, "Two. Meriet: Three."), (1, 5, None),
        (2, 1, "Th\u0435 Hour"), (2, 2, "The Hour"), (2, 3, "the Hour"),
    ]
    spark.createDataFrame(cue, "file_id long, seq long, content string").write.parquet(f"{tmp_path}/cue.parquet")
    spark.createDataFrame([(1, *p) for p in CAST], "file_id long, speaker_id long, full_name string, role_label string").write.parquet(f"{tmp_path}/cast_member.parquet")
    spark.createDataFrame([(7, "The Hour")], "phrase_id long, phrase string").write.parquet(f"{tmp_path}/phrase.parquet")
    found = {n: sorted(map(tuple, __spark_entry__.queries()[n](spark, str(tmp_path)).collect())) for n in ("p3_found", "p4_found")}
    assert found == {"p3_found": [(2, 1, 7)], "p4_found": [(1, 1, 2, 4), (1, 2, 4, 4)]}
