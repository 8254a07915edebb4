"""Encoding of a whole corpus into token ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subtide.llm.bpe import VOCABULARY, encoder, gulps


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens.

    An empty list stands for an empty and for a null text; the strings of
    special tokens in a text are ordinary text. Rows stay one for one: repeated
    rows and null keys come out as they went in. No shuffle; other columns are
    not read.
    """
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in gulps(texts):
                ids = enc.encode(texts[begin:end])
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), lists], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of each row's ids, by an ordered aggregation over the tokens.

    An empty or null list gives an empty text; bytes that are no UTF-8 come out
    as U+FFFD. Rows stay one for one; other columns are not read.
    """
    schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in enc.decode_many(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return df.select(key, F.col(ids).cast("array<int>").alias("_ids")).mapInArrow(run, schema)
