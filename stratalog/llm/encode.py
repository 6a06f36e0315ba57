"""Encoding of a corpus by a public tokenizer."""

from __future__ import annotations

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from stratalog.llm.bpe import TOKENIZERS, StreamDecoder, encode, vocabulary_file, vocabulary_of
from stratalog.runtime import in_arrow, spread

#: Texts of a batch whose ids are held at a time.
ROWS = 256


_SENT: dict[tuple[str, str, str], Broadcast] = {}


def _sent(spark: SparkSession, name: str, folder: str) -> Broadcast:
    """The driver's vocabulary file, whose size is bounded, sent to the workers once per application."""
    key = (spark.sparkContext.applicationId, name, folder)
    if key not in _SENT:
        _SENT[key] = spark.sparkContext.broadcast(vocabulary_file(name, folder))
    return _SENT[key]


def _with_ids(df: DataFrame, id: str, text: str, name: str, folder: str, make, kind: str) -> DataFrame:
    sent = _sent(df.sparkSession, name, folder)

    def run(batches):
        v = vocabulary_of(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield make(v, part.column(0), part.column(1))

    rows = df.select(df[id].alias("id"), df[text].alias("text"))
    return in_arrow(spread(rows), run, f"id {dict(df.dtypes)[id]}, {kind}")


def token_ids(df: DataFrame, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id, ids)``: the token ids of each text, special tokens excluded, one row per row of ``df``.

    Empty and null texts have an empty list. Repeated ids and null ids stay as they are. Texts of any length are
    encoded whole, in constant memory beside the text and its ids. Other columns are ignored. No shuffle.
    """

    def make(v, ids, texts):
        values = [encode(t, v) for t in texts.to_pylist()]
        return pa.RecordBatch.from_arrays([ids, pa.array(values, pa.list_(pa.int32()))], ["id", "ids"])

    return _with_ids(df, id, text, name, folder, make, "ids array<int>").toDF(id, "ids")


def token_counts(df: DataFrame, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id, n_tokens)``; 0 for empty and null texts."""

    def make(v, ids, texts):
        return pa.RecordBatch.from_arrays([ids, pa.array([len(encode(t, v)) for t in texts.to_pylist()], pa.int64())], ["id", "n_tokens"])

    return _with_ids(df, id, text, name, folder, make, "n_tokens long").toDF(id, "n_tokens")


def decoded(df: DataFrame, id: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id, text)`` from token ids; a null list gives null, an empty one ''."""

    def text(v, one):
        decoder = StreamDecoder(v)
        return None if one is None else "".join([*(decoder.feed(one[i : i + 4096]) for i in range(0, len(one), 4096)), decoder.finish()])

    def make(v, keys, lists):
        return pa.RecordBatch.from_arrays([keys, pa.array([text(v, x) for x in lists.to_pylist()], pa.string())], ["id", "text"])

    return _with_ids(df, id, ids, name, folder, make, "text string").toDF(id, "text")
