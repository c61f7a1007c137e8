"""Token-id files: one concatenated id array with Elias-Fano document boundaries.

A data set is a folder of Parquet rows. Each row is a block of consecutive documents in
ascending order of doc_id: their ids as little-endian 16- or 32-bit integers one after the
other, and the ends of the documents inside the block as an Elias-Fano sequence. With n
documents and u ids it takes about 2 + log2(u / n) bits a document; there is no table of
64-bit offsets. ``part`` and ``block`` give the order of the blocks. A block names the ids
before it in its part, so only one total per part is needed to place it in the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns
from orderpath.llm.vocab import JSON_FILE, RANK_FILE, load

BLOCK_IDS = 1 << 18
SAMPLE = 64
FILE_SCHEMA = (
    "block long, before long, n_ids long, n_docs int, width int, doc_ids array<bigint>, ids binary, "
    "low_bits int, low binary, high binary, samples binary"
)


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space.

    The low bits of each value are packed; the high parts are a bit string in which value i
    sets bit ``high(i) + i``. ``select(i)`` finds the i-th set bit from the sample before it.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        ones = (values >> low_bits).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 1 if n else 0) + 7 & ~7, dtype=np.uint8)
        high[ones] = 1
        low = (values[:, None] >> np.arange(low_bits)) & 1
        return cls(
            n,
            low_bits,
            np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            ones[::SAMPLE].astype("<u4").tobytes(),
        )

    def parts(self) -> tuple[int, bytes, bytes, bytes]:
        return self.low_bits, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()

    def select(self, i: int) -> int:
        """The i-th value, reading from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        bits = np.arange(i * self.low_bits, (i + 1) * self.low_bits)
        low = (self.low[bits // 8] >> (bits % 8).astype(np.uint8)) & 1
        return (position - i << self.low_bits) | int((low.astype(np.int64) << np.arange(self.low_bits)).sum())

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return ((ones - np.arange(self.n)) << self.low_bits) | (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def block_row(number: int, before: int, doc_ids: list, pieces: list[np.ndarray], width: int) -> tuple:
    ids = np.concatenate(pieces).astype(f"<u{width}")
    ends = np.cumsum([len(piece) for piece in pieces])
    return (number, before, len(ids), len(pieces), width, doc_ids, ids.tobytes(), *EliasFano.encode(ends).parts())


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32()] + [pa.binary()] * 3
    names = [x.split()[0] for x in FILE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_ids(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    json_file: str = JSON_FILE,
    rank_file: str = RANK_FILE,
    block_ids: int = BLOCK_IDS,
    width: int = 2,
) -> None:
    """Encode all texts, append ``end_id`` to each, and write the blocks to ``path``.

    One range shuffle on doc_id orders the documents; a block closes once it holds
    ``block_ids`` ids. Null texts count as empty, null ids come first, repeated rows are
    written each. An empty table writes an empty data set. An id that does not fit ``width``
    bytes is an error.
    """
    if end_id >> (8 * width):
        raise ValueError(f"end_id {end_id} does not fit {width} bytes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(json_file, rank_file)
        end = np.array([end_id], dtype="<u4")
        number, before, held, doc_ids, pieces = 0, 0, 0, [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                piece = np.concatenate([vocabulary.encode(text), end])
                if int(piece.max()) >> (8 * width):
                    raise ValueError(f"id {piece.max()} does not fit {width} bytes")
                doc_ids.append(doc_id)
                pieces.append(piece.astype(f"<u{width}"))
                held += len(piece)
                if held >= block_ids:
                    yield to_batch([block_row(number, before, doc_ids, pieces, width)])
                    number, before, held, doc_ids, pieces = number + 1, before + held, 0, [], []
        if pieces:
            yield to_batch([block_row(number, before, doc_ids, pieces, width)])

    ordered = document_columns(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    blocks = ordered.mapInArrow(work, FILE_SCHEMA).withColumn("part", F.spark_partition_id())
    blocks.write.option("compression", "zstd").parquet(path)


def part_starts(blocks: DataFrame) -> DataFrame:
    """``part``, ``base``: ids in all parts before; one row per part of the data set."""
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids`` (little-endian 32-bit) of every document of a data set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['width']}").astype("<u4").tobytes()
                index = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                ends = index.values()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), row["part"], dtype=np.int32)),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["before"]),
                        pa.array(ends - starts),
                        pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
                    ],
                    ["part", "doc_id", "at", "n_tokens", "ids"],
                )

    blocks = spark.read.schema(FILE_SCHEMA + ", part int").parquet(path)
    rows = blocks.mapInArrow(work, "part int, doc_id long, at long, n_tokens long, ids binary")
    return rows.join(F.broadcast(part_starts(blocks)), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids"
    )


def read_some(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """As ``read_ids`` for the documents whose ``doc_id`` stands in ``wanted``.

    Each document costs two selects on the index of its block; other ends are not
    decoded, and blocks without a wanted document are not sent to Python. Repeated ids in
    ``wanted`` count once, every written row of a wanted id is returned, NULL matches nothing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['width']}")
                index = EliasFano(row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"])
                places = row["places"]
                starts = [index.select(p - 1) if p else 0 for p in places]
                ends = [index.select(p) for p in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(places), pa.int32()),
                        pa.array([row["doc_ids"][p] for p in places], pa.int64()),
                        pa.array([row["before"] + a for a in starts], pa.int64()),
                        pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                        pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    ["part", "doc_id", "at", "n_tokens", "ids"],
                )

    blocks = spark.read.schema(FILE_SCHEMA + ", part int").parquet(path)
    places = blocks.select("part", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    hits = (
        places.join(wanted.select("doc_id").distinct(), "doc_id")
        .groupBy("part", "block")
        .agg(F.sort_array(F.collect_list("place")).alias("places"))
    )
    rows = blocks.join(hits, ["part", "block"]).mapInArrow(
        work, "part int, doc_id long, at long, n_tokens long, ids binary"
    )
    return rows.join(F.broadcast(part_starts(blocks)), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids"
    )
