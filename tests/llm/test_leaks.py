"""Problem 8 against a plain search."""

import random

from subtide.llm.leaks import Automaton, cut_spans, find_leaks, scrub_leaks, word_spans, words_of


def _grams(words, n):
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_automaton_equals_a_plain_search():
    rng = random.Random(5)
    for _ in range(150):
        items = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 14))]) for i in range(4)]
        words = [rng.choice("abcd") for _ in range(40)]
        found = Automaton(items, 4).matches(words)
        assert set(found) == {i for i, own in items if _grams(own, 4) & _grams(words, 4)}
        for item, spans in found.items():
            covered = {p for a, b in spans for p in range(a, b)}
            own = _grams(dict(items)[item], 4)
            assert covered == {p for i in range(len(words) - 3) if tuple(words[i : i + 4]) in own for p in range(i, i + 4)}


def test_letters_that_grow():
    text = "KEEP Case İstanbul one two"
    assert len(words_of(text)) == len(word_spans(text))
    assert cut_spans(text, [[4, 6]], 1.0) == ("KEEP Case İstanbul ", 2, False)


def test_operators(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "Say: " + item.upper() + " İ!", "x"), (2, "nothing here", "x"), (3, None, "x"), (4, "", "x"), (None, "a b " + item + " c " * 60, "x"), (5, "İ" * 12, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([("q", item), ("q", item), ("r", "too short"), (None, item), ("s", None)], "item_id string, text string")
    for block in (200_000, 20):
        found = find_leaks(df, items, block_words=block)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, "q"), (None, "q")}
        clean = {r.doc_id: (r.text, r.dropped) for r in scrub_leaks(df, items, block_words=block).collect()}
        assert clean[1] == (None, True) and clean[2] == ("nothing here", False) and clean[3] == (None, False) and clean[4] == ("", False)
        assert clean[None][0].startswith("a b  c ") and clean[5][0] == "İ" * 12
    assert find_leaks(df.limit(0), items).collect() == [] and find_leaks(df, items.limit(0)).collect() == []
