"""Problem 9: sizes, overlaps, and where pieces end."""

from types import SimpleNamespace

import numpy as np

from subtide.llm.bpe import encoder
from subtide.llm.pieces import Splitter, _whole_characters, split_documents


def test_cohesion_counts_tokens_exactly():
    # Tokens of the second topic fell into the same buckets of 64 as those of the first.
    alike = [i for i in range(5000) if (i * 2654435761 >> 7) % 64 == 5]
    splitter = Splitter(SimpleNamespace(bytes_of={i: b"a" for i in range(5000)}))
    ids = np.array([alike[0]] * 700 + [alike[1]] * 700, np.int32)
    assert splitter.cuts(ids, np.arange(20, 1400, 20))[0] == (0, 700)


def test_pieces(spark):
    prose = "The cat sat there. " * 400
    texts = {1: prose, 2: "x" * 9000, 3: "日本語の長い文。" * 500, 4: "short", 5: "", 6: None, 7: "a=b;" * 1500, 8: "".join(f"line {i}\n" for i in range(900))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pieces: dict = {}
    for r in split_documents(df).orderBy("doc_id", "piece_no").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {1, 2, 3, 4, 7, 8}
    for doc, own in pieces.items():
        assert own[0].tok_start == 0 and all(len(p.ids) <= 1024 and p.tok_end - p.tok_start == len(p.ids) for p in own)
        assert all(b.tok_start == a.tok_end - 64 and b.ids[:64] == a.ids[-64:] for a, b in zip(own, own[1:]))
        whole = own[0].ids + [i for p in own[1:] for i in p.ids[64:]]
        assert encoder().decode(whole).decode() == texts[doc] and all("�" not in p.piece for p in own)
    assert all(p.piece.endswith(".") for p in pieces[1][:-1])
    assert all(p.piece.endswith(";") for p in pieces[7][:-1])
    assert all(p.piece[-1] in "0123456789\n" for p in pieces[8][:-1])


def test_characters_at_the_ends():
    data = "日a本".encode()
    assert _whole_characters(data[1:]) == "a本" and _whole_characters(data[:-1]) == "日a" and _whole_characters(data) == "日a本"


def test_very_long_texts_take_linear_time():
    text = "word one two\n" * 60_000
    (ids, cuts), = Splitter(encoder()).plan([text])
    assert len(cuts) > 100 and cuts[-1][1] == len(ids)
