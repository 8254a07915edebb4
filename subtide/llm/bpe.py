"""Encoding of texts with a public byte-level BPE vocabulary.

Per batch of a partition, a text is cut into segments that end before white
space holding a line break (no token crosses such a place), distinct segments
into words, and each word not met before is encoded by one recursive DuckDB
query over all new words: rows of token and position join the merge table, the
leftmost pair of minimum rank of each word is contracted, until no pair of a
word is in the table. Ids of words and segments are kept between batches in
bounded memory, so a line or word that recurs in the corpus is encoded about
once per Python worker.

Words longer than LONG_WORD bytes (blobs without a break) would need as many
rounds as they have tokens; they are contracted through a heap with the same
ranks and the same order (minimum rank, leftmost first).
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

LONG_WORD = 512
KEPT_WORDS = 400_000
KEPT_SEGMENTS = 150_000
#: Characters of new words contracted by one query.
WORDS_BYTES = 2_000_000
#: Tokens decoded by one query.
DECODED = 500_000
#: Characters of text encoded in one go.
GULP = 4_000_000

#: Characters that the vocabulary's pattern counts as white space.
_WS = "\\t-\\r \x85\xa0  -     　"
_BLANKS = "".join(re.findall(f"[{_WS}]", "".join(map(chr, range(0x3001)))))
# Code points that the regex library knows as letters or numbers
# and the vocabulary's pattern (Unicode 16) doesn't.
_LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LETTER, _NUMBER = rf"[\p{{L}}--[{_LATER}]]", rf"[\p{{N}}--[{_LATER}]]"
#: The vocabulary's word pattern for texts of ASCII only.
_ASCII_WORD = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)
_OTHER = rf"[^{_WS}\p{{L}}\p{{N}}{_LATER}]"
_WORD = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{_LETTER}+| ?{_NUMBER}+| ?(?:{_OTHER}|[{_LATER}])+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

_CONTRACT = """
WITH RECURSIVE state(w, toks, done) AS (
  SELECT w, toks, false FROM fresh
  UNION ALL
  (WITH pairs AS (
     SELECT w, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b, unnest(range(1, len(toks))) AS p
     FROM state WHERE NOT done),
   best AS (
     SELECT w, min((rank << 24) | p) AS m
     FROM (SELECT w, p, a::BIGINT * 65536 + b AS pair FROM pairs) JOIN merges USING (pair) GROUP BY w)
   SELECT state.w,
     CASE WHEN m IS NULL THEN toks
          ELSE list_concat(list_concat(toks[:(m & 16777215) - 1], [((m >> 24) + 256)::INTEGER]), toks[(m & 16777215) + 2:]) END,
     m IS NULL
   FROM state LEFT JOIN best ON state.w = best.w WHERE NOT done)
)
SELECT w, toks FROM state WHERE done ORDER BY w
"""


_DECODE = """
SELECT d, string_agg(spelling, '' ORDER BY p)
FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM coded) JOIN vocabulary USING (id) GROUP BY d
"""


class Encoder:
    """Ids of texts by one vocabulary file, with memory between calls."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import duckdb
        import regex

        with open(vocabulary, encoding="utf-8") as f:
            stored = json.load(f)
        model = stored["model"]
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # The file spells each byte by a printable character: 188 printable ones stand for themselves, the rest for U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        spelled = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.bytes_of = {i: bytes(spelled[c] for c in s) for s, i in vocab.items() if all(c in spelled for c in s)}
        for token in stored.get("added_tokens", []):
            self.bytes_of.pop(token["id"], None)
        self.first = np.zeros(256, np.int32)
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.first[b[0]] = i
        a = np.array([vocab[m[0]] for m in merges], np.int64)
        b = np.array([vocab[m[1]] for m in merges], np.int64)
        new = np.array([vocab[m[0] + m[1]] for m in merges], np.int64)
        if not np.array_equal(new, np.arange(256, 256 + len(merges))):
            raise ValueError("the vocabulary must number its merges from 256 in order of rank")
        self.ranks = dict(zip((a * 65536 + b).tolist(), range(len(merges)), strict=True))
        # Nothing is spilled to the worker's own disk: the words of one call are bounded by WORDS_BYTES.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("source", pa.table({"pair": a * 65536 + b, "rank": np.arange(len(merges))}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM source")
        self.db.unregister("source")
        self.word = regex.compile(_WORD)
        # A word that is a token contracts to that token.
        self.fixed = {b.decode(): np.int32(i).tobytes() for i, b in self.bytes_of.items() if _decodes(b)}
        self.words: dict[str, bytes] = {}
        self.segments: dict[str, bytes] = {}
        self.spelled = False

    def _by_heap(self, data: bytes) -> list[int]:
        """Contracts one long word; rank first, then place, as the query does."""
        toks = self.first[np.frombuffer(data, np.uint8)].tolist()
        n = len(toks)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            r = ranks.get(toks[i] * 65536 + toks[i + 1])
            if r is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if toks[i] < 0 or j >= n or ranks.get(toks[i] * 65536 + toks[j]) != r:
                continue
            toks[i], toks[j] = r + 256, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    new = ranks.get(toks[x] * 65536 + toks[y])
                    if new is not None:
                        heapq.heappush(heap, (new, x))
        return [t for t in toks if t >= 0]

    def contract(self, words: list[str]) -> list[bytes]:
        """The ids of each word as bytes of int32, by the recursive query."""
        if len(words) > 1 and sum(map(len, words)) > WORDS_BYTES:
            half = len(words) // 2
            return self.contract(words[:half]) + self.contract(words[half:])
        if not words:
            return []
        data = [w.encode("utf-8", "replace") for w in words]
        short = [d if len(d) <= LONG_WORD else b"" for d in data]
        ends = np.zeros(len(data) + 1, np.int32)
        np.cumsum([len(d) for d in short], out=ends[1:])
        flat = self.first[np.frombuffer(b"".join(short), np.uint8)]
        self.db.register(
            "fresh",
            pa.table({"w": np.arange(len(data), dtype=np.int32), "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}),
        )
        found = self.db.sql(_CONTRACT).to_arrow_table()["toks"].combine_chunks()
        self.db.unregister("fresh")
        ids, at = found.flatten().to_numpy().astype(np.int32), found.offsets.to_numpy()
        out = [ids[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i, d in enumerate(data):
            if len(d) > LONG_WORD:
                out[i] = np.array(self._by_heap(d), np.int32).tobytes()
        return out

    def _split(self, segment: str) -> list[str]:
        return (_ASCII_WORD if segment.isascii() else self.word).findall(segment)

    def encode_segments(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each text the ids of its segments, in order."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        if len(self.segments) > KEPT_SEGMENTS:
            self.segments.clear()
        cut = [_segments(t) if t else [] for t in texts]
        kept, fixed, words = self.segments, self.fixed, self.words
        split = {s: self._split(s) for s in dict.fromkeys(s for segments in cut for s in segments) if s not in kept}
        fresh = list({w for ws in split.values() for w in ws if w not in fixed and w not in words})
        words.update(zip(fresh, self.contract(fresh), strict=True))
        for s, ws in split.items():
            kept[s] = b"".join([fixed[w] if w in fixed else words[w] for w in ws])
        return [[kept[s] for s in segments] for segments in cut]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for null or empty."""
        return [np.frombuffer(b"".join(x), np.int32) for x in self.encode_segments(texts)]

    def decode_many(self, ids: pa.Array) -> list[bytes]:
        """The bytes of each list of ids, by an ordered aggregation over its tokens; none for null."""
        if not self.spelled:
            known = pa.table({"id": pa.array(list(self.bytes_of), pa.int32()), "spelling": [b.hex() for b in self.bytes_of.values()]})
            self.db.register("source", known)
            self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM source")
            self.db.unregister("source")
            self.spelled = True
        out = [b""] * len(ids)
        sizes = np.cumsum([0 if n is None else n for n in pc.list_value_length(ids).to_pylist()])
        begin = 0
        while begin < len(ids):
            # So many rows that their tokens fit the query's memory; one row at least.
            done = int(sizes[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, done + DECODED, "right")))
            self.db.register("coded", pa.table({"d": np.arange(begin, end), "ids": ids.slice(begin, end - begin)}))
            for d, spelling in self.db.sql(_DECODE).fetchall():
                out[d] = bytes.fromhex(spelling)
            self.db.unregister("coded")
            begin = end
        return out

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        return b"".join([self.bytes_of[int(i)] for i in ids])


def _segments(text: str) -> list[str]:
    """The text cut before each white space that holds a line break; every character is looked at once."""
    at, begin = [0], 0
    for line in text.split("\n")[:-1]:
        shown = len(line.rstrip(_BLANKS))
        if shown:
            at.append(begin + shown)
        begin += len(line) + 1
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]


def _decodes(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The Python worker's own encoder, made once."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def gulps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of a batch of about GULP characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GULP:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
