"""BPE encoding and decoding of whole documents, with tree concatenation of long unsplit text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, small_batches, texts_of
from orderpath.llm.vocab import JSON_FILE, RANK_FILE, load


def encode_documents(docs: DataFrame, json_file: str = JSON_FILE, rank_file: str = RANK_FILE) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit integers), ``decoded`` text of every row.

    One pass without a shuffle. A null or empty text gives no ids and an empty decoded text;
    repeated rows and null ids are kept as they are; an empty table gives an empty table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(json_file, rank_file)
        for batch in batches:
            ids, decoded = [], []
            for text in texts_of(batch.column(1)):
                tokens = vocabulary.encode(text)
                ids.append(tokens.tobytes())
                decoded.append(vocabulary.decode(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
            )

    return document_columns(small_batches(docs)).mapInArrow(work, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Length and digests of what :func:`encode_documents` returns."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
