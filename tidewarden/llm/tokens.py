"""Operator 3: BPE encoding and decoding of whole texts (forced-boundary splitting).

``encode_documents`` returns one row per input row: doc_id, ids (array<int>) and
the text those ids decode to.  Null and empty texts give no ids and an empty
decoded text; repeated rows give repeated results; other columns, whatever their
names, take no part.  One narrow pass, no shuffle; a lost task is just repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forced_bpe import DEFAULT_VOCABULARY, encoder
from .storage import arrow_rows

#: Rows handed on at once; texts are long, their ids longer.
SLICE = 250


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    def run(batches):
        enc = encoder(vocabulary)
        for batch in slices(batches):
            ids = [np.frombuffer(b, enc.dtype) for b in enc.encode_batch(batch.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate([*ids, np.zeros(0, enc.dtype)]).astype(np.int32)
            texts = [enc.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Per document: number of ids and SHA-256 of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
