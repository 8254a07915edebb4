"""Evaluation passages inside a training corpus.

The test items become one generalised suffix automaton over words. Documents
are streamed through it: the state tells the longest suffix of the words read
so far that stands in some item, and the state's ancestor whose lengths span
``min_words`` tells in which items. Words unknown to every item return the
automaton to its root, so only stretches of known words are walked.

The items are the stated set that all documents are held against. They are
split into blocks of at most BLOCK_WORDS words, longer items with an overlap of
min_words - 1 words; each block has its own automaton of a fixed bound, and the
documents pass the blocks one behind the other in a single reading.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 12
#: Words of items in one automaton (a state or two and as many transitions a word).
BLOCK_WORDS = 200_000

_WORDS = re.compile("[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    """Longest runs of ASCII letters and digits, after lower-casing."""
    return _WORDS.findall(text.lower()) if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of words_of stands in the text as it is."""
    low = text.lower()
    spans = [m.span() for m in _WORDS.finditer(low)]
    if len(low) == len(text):
        return spans
    # Some letters grow in lower case: each place there belongs to the letter it came from.
    home = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(home[a], home[b - 1] + 1) for a, b in spans]


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[object, list[str]]], min_words: int = MIN_WORDS):
        self.min_words = min_words
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set] = [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)), own)
                own[last].add(item)
        # Shorter states are never asked for their items.
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[s]] >= min_words:
                own[self.link[s]] |= own[s]
        #: The items of the state that holds the last min_words words, and that state.
        self.anchor = [-1] * len(self.link)
        self.items: dict[int, tuple] = {}
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if self.length[s] >= min_words:
                self.anchor[s] = s if self.length[self.link[s]] < min_words else self.anchor[self.link[s]]
                if self.anchor[s] == s:
                    self.items[s] = tuple(sorted(own[s]))

    def _new(self, length: int, own: list[set]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        own.append(set())
        return len(self.link) - 1

    def _extend(self, last: int, w: int, own: list[set]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q, own)
        cur = self._new(length[last] + 1, own)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q, own)
        return cur

    def _clone(self, p: int, w: int, q: int, own: list[set]) -> int:
        c = self._new(self.length[p] + 1, own)
        self.next[c] = dict(self.next[q])
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def walk(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(index of the word, matched length, anchor state) wherever min_words or more words match."""
        nxt, link, length, anchor, least = self.next, self.link, self.length, self.anchor, self.min_words
        state = matched = 0
        for i, w in enumerate(words.tolist()):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(w, 0)
            matched = matched + 1 if state else 0
            if matched >= least:
                yield i, matched, anchor[state]

    def matches(self, words: list[str]) -> dict[object, list[list[int]]]:
        """item -> [first word, end word) spans found in it, in order."""
        get = self.ids.get
        ids = np.array([get(w, -1) for w in words], np.int32)
        known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        found: dict[object, list[list[int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.min_words:
                continue
            for i, _, state in self.walk(ids[a:b]):
                end = a + i + 1
                for item in self.items[state]:
                    spans = found.setdefault(item, [])
                    if spans and spans[-1][1] >= end - self.min_words:
                        spans[-1][1] = end
                    else:
                        spans.append([end - self.min_words, end])
        return found


def blocks(items: DataFrame, item: str, text: str, min_words: int, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, list[str]]]]:
    """The words of the items, in blocks of at most block_words.

    A longer item is cut; its parts share min_words - 1 words, so no passage is lost.
    """
    block: list[tuple[object, list[str]]] = []
    size = 0
    rows = items.select(item, text).dropna().distinct().orderBy(item, text)
    for row in rows.toLocalIterator():
        words = words_of(row[1])
        step = block_words - min_words + 1
        for at in range(0, max(len(words) - min_words + 1, 0), step):
            part = words[at : at + block_words]
            if block and size + len(part) > block_words:
                yield block
                block, size = [], 0
            block.append((row[0], part))
            size += len(part)
    if block:
        yield block


_SPANS = pa.list_(pa.list_(pa.int32()))


def _with_leaks(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, min_words: int, block_words: int, all_rows: bool) -> DataFrame:
    """(key, _text, _leaks): the documents with their (item, spans), row by row in one reading.

    all_rows keeps the documents that can't hold a passage.
    """
    spark = docs.sparkSession
    item_type = items.schema[item].dataType
    leak = T.StructType([T.StructField("item", item_type), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])
    schema = T.StructType([docs.schema[key], T.StructField("_text", T.StringType()), T.StructField("_leaks", T.ArrayType(leak))])
    out = docs.select(key, F.col(text).cast("string").alias("_text"))
    if not all_rows:
        # A lower-cased letter is a word's at most, whatever it grows to.
        out = out.where(F.length("_text") >= min_words)
    out = out.withColumn("_leaks", F.array().cast(T.ArrayType(leak)))
    for block in blocks(items, item, item_text, min_words, block_words):
        sent = spark.sparkContext.broadcast(Automaton(block, min_words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            auto = sent.value
            for batch in batches:
                before = batch.column(2)
                leaks = before.to_pylist()
                for i, t in enumerate(batch.column(1)):
                    words = words_of(t.as_py())
                    if len(words) >= min_words and (found := auto.matches(words)):
                        leaks[i] = leaks[i] + [{"item": it, "spans": sp} for it, sp in found.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaks, before.type)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(key, item, n_words, spans): items of which a document holds min_words
    or more consecutive words; spans are word positions [first, end) of the
    document, n_words the words they cover.

    Null or empty texts, and items shorter than min_words, match nothing. A
    repeated document row gives its rows again; repeated items count once; an
    item cut into blocks may come out with several rows of spans for the same
    document. Null item ids are left out. Other columns are not read.
    """
    found = _with_leaks(docs, items, key, text, item, item_text, min_words, block_words, False)
    rows = found.where(F.size("_leaks") > 0).select(key, F.explode("_leaks").alias("_l"))
    n_words = F.aggregate("_l.spans", F.lit(0), lambda n, s: n + s[1] - s[0])
    return rows.select(key, F.col("_l.item").alias(item), n_words.alias("n_words"), F.col("_l.spans").alias("spans"))


def scrub_leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    max_words: int = MIN_WORDS,
    max_share: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents with leaked spans cut out: (key, text, n_removed, dropped).

    A span of max_words words or more is removed from the text, whose rest
    stays letter for letter; a document of whose words more than max_share
    would go is dropped (text null, dropped true). Untouched documents keep
    their text, null ones too. Spans are found and cut in one reading, row by
    row, so null and repeated keys are no matter.
    """
    schema = T.StructType(
        [docs.schema[key], T.StructField(text, T.StringType()), T.StructField("n_removed", T.IntegerType()), T.StructField("dropped", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, leaks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows.append(cut_spans(t, [s for x in leaks for s in x["spans"] if s[1] - s[0] >= max_words], max_share))
            texts, gone, dropped = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int32()), pa.array(dropped, pa.bool_())], names=schema.names
            )

    return _with_leaks(docs, items, key, text, item, item_text, min_words, block_words, True).mapInArrow(run, schema)


def cut_spans(text: str | None, spans: list[list[int]], max_share: float) -> tuple[str | None, int, bool]:
    """The text without the word spans, the number of words cut, and whether too much would go."""
    if not text or not spans:
        return text, 0, False
    at = word_spans(text)
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    n = sum(b - a for a, b in merged)
    if n > max_share * len(at):
        return None, n, True
    out, last = [], 0
    for a, b in merged:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join(out) + text[last:], n, False
