"""Problem 7 against the public library, over all code points, long words and long blanks."""

import random
import time

import pytest
from tokenizers import Tokenizer

from subtide.llm.bpe import LONG_WORD, VOCABULARY, Encoder, _segments
from subtide.llm.encode import encode_corpus


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    e = Encoder()
    return lambda text: e.encode([text])[0].tolist()


def test_every_code_point(own, public):
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for at in range(0, len(points), 50_000):
        text = "".join(f"a{c}{c}1 {c}\n" for c in points[at : at + 50_000])
        assert own(text) == public(text)


def test_long_words_and_pieces_of_code(own, public):
    rng = random.Random(1)
    for n in (LONG_WORD - 1, LONG_WORD, LONG_WORD + 1, LONG_WORD + 2, 5000):
        for letters in ("ab", "etaoin", "=-"):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert own(text) == public(text)
    for _ in range(300):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "\r\n", "a", "the", "It's", "123", "é", "한", " ", "()", "<|endoftext|>"]) for _ in range(rng.randint(0, 60)))
        assert own(text) == public(text), repr(text)


def test_blanks_at_the_end_take_linear_time():
    start = time.time()
    assert "".join(_segments("x" + " " * 2_000_000)) == "x" + " " * 2_000_000
    assert "".join(_segments("\n" * 1_000_000)) == "\n" * 1_000_000
    assert time.time() - start < 3


def test_empty_and_missing_texts(spark):
    rows = [(1, "a b", 7), (2, "", 7), (3, None, 7), (None, "a b", 7), (1, "a b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    assert sorted(((r.doc_id or 0, r.ids) for r in encode_corpus(df).collect())) == [(0, [64, 275]), (1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert encode_corpus(df.limit(0)).collect() == []


def test_decoding(spark):
    from subtide.llm.encode import decode_corpus

    texts = [(1, "It's 한글 é\n\n  x"), (2, ""), (3, None), (4, "�")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted(map(tuple, decode_corpus(encode_corpus(df)).collect())) == [(k, t or "") for k, t in texts]
