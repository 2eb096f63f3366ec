"""Problem 7: the whole corpus as ids of a public tokenizer, by ``bpe.py`` inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Encoder

#: Default place of the vocabulary; always a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters that are cut and merged together; bounds a worker's memory where texts are long.
CHUNK = 1_000_000


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t or "")
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def encode_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``, one row for each row of ``df``: ids of the text, without special tokens.

    A null text and '' give the empty list; strings that look like special tokens are ordinary text; whole texts are
    encoded whatever their length. The file at ``path`` must exist on every executor."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for start, ids in _encoded(encoder, batch.column(1)):
                offsets = np.cumsum([0] + [len(x) for x in ids], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))], [id_column, "ids"])

    chosen = df.select(id_column, text_column)
    return chosen.mapInArrow(run, f"`{id_column}` {chosen.schema[id_column].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens)``, one row for each row of ``df``; 0 for null and ''."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            counts = [len(x) for _, ids in _encoded(encoder, batch.column(1)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], [id_column, "tokens"])

    chosen = df.select(id_column, text_column)
    return chosen.mapInArrow(run, f"`{id_column}` {chosen.schema[id_column].dataType.simpleString()}, tokens long")


def _encoded(encoder: Encoder, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    start = 0
    for chunk in _chunks(texts.to_pylist()):
        yield start, encoder.encode_batch(chunk)
        start += len(chunk)
