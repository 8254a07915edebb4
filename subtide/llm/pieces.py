"""Oversized texts cut into pieces of at most a number of tokens.

Lexical-cohesion segmentation: at each line boundary the blocks of tokens
before and after it are compared (cosine of their bags of tokens); a topic
boundary is a valley of that similarity. Each piece ends at the deepest valley
within its window of sizes. Where the window holds no line boundary, the ends
of sentences and statements are searched in the same way; where it holds none
of those either, the piece ends at the last line before the window, or else
behind punctuation or a word, and within a single word only at the limit.
Every piece after the first repeats the last ``overlap`` tokens of the one
before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.llm.bpe import VOCABULARY, Encoder, encoder, gulps

MAX_TOKENS = 1024
OVERLAP = 64
#: A piece is sought to have at least this share of the limit.
LEAST_SHARE = 0.5
#: Tokens on either side of a boundary that are compared.
BLOCK = 96


class Splitter:
    def __init__(self, enc: Encoder, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP):
        if not 0 <= overlap < max_tokens // 2:
            raise ValueError("the overlap must be less than half the limit")
        self.enc, self.max, self.overlap = enc, max_tokens, overlap
        size = max(enc.bytes_of) + 1
        self.n_bytes = np.zeros(size, np.int64)
        self.counted = np.zeros(size, bool)  # has letters or digits, part of cohesion
        self.opens = np.zeros(size, bool)  # may start a piece by its own first byte
        self.inside = np.zeros(size, bool)  # starts in the middle of a character
        self.ends = np.zeros(size, bool)  # ends a sentence, before white space, or a statement
        self.statement = np.zeros(size, bool)  # ends a statement, whatever follows
        self.closes = np.zeros(size, bool)  # punctuation after which a cut is natural
        for i, b in enc.bytes_of.items():
            self.n_bytes[i] = len(b)
            self.inside[i] = 0x80 <= b[0] < 0xC0
            self.opens[i] = b[:1].isspace()
            self.statement[i] = b[-1:] in (b";", b"}", b"\n")
            self.ends[i] = self.statement[i] or b[-1:] in (b".", b"!", b"?") or b.endswith(("。".encode(), "！".encode(), "？".encode()))
            self.closes[i] = b[-1:] in (b";", b"}", b".", b",", b">", b")", b"!", b"?", b"\n")
            self.counted[i] = any(c >= 0x80 or chr(c).isalnum() for c in b)

    def _valley(self, ids: np.ndarray, gaps: np.ndarray, first: int, last: int) -> int:
        """The gap of first..last with the deepest valley of cohesion; the later one of equals."""
        low, high = max(0, first - 2 * BLOCK), min(len(ids), last + 2 * BLOCK)
        tokens = ids[low:high]
        counted = self.counted[tokens]
        own, number = np.unique(tokens, return_inverse=True)
        near = gaps[np.searchsorted(gaps, low, "right") : np.searchsorted(gaps, high, "left")] - low

        def bags(at: np.ndarray) -> np.ndarray:
            """The bag of the tokens at each row's positions, exact: a column for each distinct token."""
            there = (at >= 0) & (at < len(tokens))
            there &= counted[np.where(there, at, 0)]
            places = there.nonzero()[0] * len(own) + number[at[there]]
            return np.bincount(places, minlength=len(at) * len(own)).reshape(len(at), len(own)).astype(np.float32)

        before, behind = bags(near[:, None] - 1 - np.arange(BLOCK)), bags(near[:, None] + np.arange(BLOCK))
        size = np.sqrt((before**2).sum(1) * (behind**2).sum(1))
        like = np.where(size > 0, (before * behind).sum(1) / np.maximum(size, 1e-9), 0.0)
        best, at = -1.0, last
        for k in np.flatnonzero((near + low >= first) & (near + low <= last)).tolist():
            i = j = k
            while i > 0 and like[i - 1] >= like[i]:
                i -= 1
            while j < len(like) - 1 and like[j + 1] >= like[j]:
                j += 1
            depth = float(like[i] + like[j] - 2 * like[k])
            if depth >= best:
                best, at = depth, int(near[k]) + low
        return at

    def cuts(self, ids: np.ndarray, gaps: np.ndarray) -> list[tuple[int, int]]:
        """[first, end) of the pieces, in tokens; gaps are the positions of line boundaries."""
        n, out, start = len(ids), [], 0
        while n - start > self.max:
            limit = start + self.max
            first = start + max(self.overlap + 1, int(self.max * LEAST_SHARE))
            i, j = np.searchsorted(gaps, (first, limit + 1))
            if i == j:
                # No line ends in the window: the ends of sentences and statements in it are the candidates.
                near = self._ends(ids, first, limit)
                early = gaps[i - 1] if i and gaps[i - 1] > start + self.overlap else 0
                end = self._valley(ids, near, int(near[0]), int(near[-1])) if len(near) else int(early) or self._word(ids, first, limit)
            else:
                end = self._valley(ids, gaps, int(gaps[i]), int(gaps[j - 1])) if j - i > 1 else int(gaps[i])
            out.append((start, end))
            start = end - self.overlap
        out.append((start, n))
        return out

    def _ends(self, ids: np.ndarray, first: int, limit: int) -> np.ndarray:
        """The places in first..limit behind the end of a sentence or statement."""
        at = np.arange(first, limit + 1)
        before, behind = ids[at - 1], ids[np.minimum(at, len(ids) - 1)]
        return at[self.ends[before] & ~self.inside[behind] & (self.opens[behind] | self.statement[before])]

    def _word(self, ids: np.ndarray, first: int, limit: int) -> int:
        """The latest place in first..limit behind punctuation, else before a word, else between characters."""
        at = np.arange(first, limit + 1)
        for good in (self.closes[ids[at - 1]] & ~self.inside[ids[at]], self.opens[ids[at]], ~self.inside[ids[at]]):
            if good.any():
                return int(at[good][-1])
        return limit

    def plan(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
        """The ids of each text and its pieces; an empty text has none."""
        for segments in self.enc.encode_segments(texts):
            ids = np.frombuffer(b"".join(segments), np.int32)
            if len(ids) <= self.max:
                yield ids, [(0, len(ids))] if len(ids) else []
            else:
                gaps = np.cumsum([len(s) // 4 for s in segments])[:-1]
                yield ids, self.cuts(ids, gaps)


def _whole_characters(data: bytes) -> str:
    """The text of bytes, without the parts of characters at its ends."""
    begin = next((i for i, b in enumerate(data[:4]) if not 0x80 <= b < 0xC0), 0)
    data = data[begin:]
    for cut in range(1, min(4, len(data)) + 1):
        lead = data[-cut]
        if lead >= 0xC0:
            whole = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            data = data[:-cut] if cut < whole else data
            break
        if lead < 0x80:
            break
    return data.decode("utf-8", "replace")


_PIECE = T.ArrayType(
    T.StructType(
        [
            T.StructField("tok_start", T.IntegerType()),
            T.StructField("tok_end", T.IntegerType()),
            T.StructField("byte_start", T.LongType()),
            T.StructField("byte_end", T.LongType()),
        ]
    )
)
_ARROW_PIECE = pa.list_(pa.struct([("tok_start", pa.int32()), ("tok_end", pa.int32()), ("byte_start", pa.int64()), ("byte_end", pa.int64())]))


def plan_pieces(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(key, n_tokens, pieces) for each row whose text has a token.

    pieces: array of [tok_start, tok_end) and [byte_start, byte_end) in UTF-8.
    Null and empty texts give no row; repeated rows give their row again.
    Texts of any length are processed whole.
    """
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("pieces", _PIECE),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(encoder(vocabulary), max_tokens, overlap)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in gulps(texts):
                sizes, ends, spans = [], [0], []
                for ids, cuts in splitter.plan(texts[begin:end]):
                    sizes.append(len(ids))
                    if len(cuts) > 1:
                        at = np.concatenate(([0], np.cumsum(splitter.n_bytes[ids])))
                        spans += [(a, b, int(at[a]), int(at[b])) for a, b in cuts]
                    elif cuts:
                        spans.append((*cuts[0], 0, int(splitter.n_bytes[ids].sum())))
                    ends.append(len(spans))
                cols = list(zip(*spans, strict=True)) or [()] * 4
                struct = pa.StructArray.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                    names=["tok_start", "tok_end", "byte_start", "byte_end"],
                )
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(sizes, pa.int64()), lists.cast(_ARROW_PIECE)],
                    names=[key, "n_tokens", "pieces"],
                )

    source = df.select(key, F.col(text).cast("string").alias("_text")).where(F.length("_text") > 0)
    return source.mapInArrow(run, schema)


def split_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(key, piece_no, tok_start, tok_end, ids, piece): the pieces with their ids and text.

    piece_no counts from 1. The ids of a piece are exact; where it begins or
    ends inside a character, its text leaves that character to the piece that
    holds it whole. Empty cases as in plan_pieces.
    """
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            *(T.StructField(c, T.IntegerType()) for c in ("piece_no", "tok_start", "tok_end")),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("piece", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(encoder(vocabulary), max_tokens, overlap)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in gulps(texts):
                rows: list[tuple] = []
                for i, (ids, cuts) in enumerate(splitter.plan(texts[begin:end])):
                    for k, (a, b) in enumerate(cuts, 1):
                        rows.append((begin + i, k, a, b, ids[a:b], _whole_characters(splitter.enc.decode(ids[a:b]))))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(cols[0], pa.int64())),
                        *(pa.array(c, pa.int32()) for c in cols[1:4]),
                        pa.array(list(cols[4]), pa.list_(pa.int32())),
                        pa.array(cols[5], pa.string()),
                    ],
                    names=[key, "piece_no", "tok_start", "tok_end", "ids", "piece"],
                )

    source = df.select(key, F.col(text).cast("string").alias("_text")).where(F.length("_text") > 0)
    return source.mapInArrow(run, schema)
