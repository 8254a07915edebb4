"""p5_found on a few rows."""

import __spark_entry__


def test_garbled_cues_come_out_once(spark, tmp_path):
    bad = "Älter".encode().decode("cp1252")
    cue = [(1, 1, bad), (1, 1, bad), (1, 2, "Älter"), (1, 3, None), (1, 4, ""), (1, 5, "lost �")]
    spark.createDataFrame(cue, "file_id long, seq long, content string").write.parquet(f"{tmp_path}/cue.parquet")
    assert sorted(map(tuple, __spark_entry__.queries()["p5_found"](spark, str(tmp_path)).collect())) == [(1, 1), (1, 5)]


def test_long_cyrillic_words_end():
    # The pattern of sound texts took time exponential in the letters here.
    from subtide.llm.garble import restore

    assert restore("а" * 60 + "中") == ("а" * 60 + "中", [])


def test_restores():
    from subtide.llm.garble import restore

    again = "é"
    for _ in range(9):
        again = again.encode().decode("latin-1")
    cases = {
        "it鈥檚 fine": "it’s fine", "caf茅 noir": "café noir", "SchГјler": "Schüler", "cost ВЈ58": "cost £58", again: "é",
        "Ο γείτονας".encode().decode("cp1252"): "Ο γείτονας", "Учитель".encode().decode("latin-1"): "Учитель",
        "守夜人在河边".encode("gbk").decode("latin-1"): "守夜人在河边", "Óñòàâøèé âðà÷": "Уставший врач",
    }
    assert {t: restore(t)[0] for t in cases} == cases
    for sound in ("ÀÉÎÕ", "NAÏVE CAFÉ ÀÉÈÊ", "Вјера и нада", "Ｇéｎéｒｉｑｕｅ　ａ　ｃａｃｈé", "KTV茅台", "Сlub Соrаl-Ѕіх"):
        assert restore(sound) == (sound, [])
    assert restore("锟斤拷")[1] == restore("ï¿½ x")[1] == ["lost"]
