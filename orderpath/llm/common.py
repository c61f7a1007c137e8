"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderpath.session import stage_table

__all__ = ["document_columns", "fold", "keep_by", "labelled_sample", "map_batches", "read_table", "small_batches", "stage_table", "texts_of"]

ID, TEXT = "doc_id", "text"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_columns(docs: DataFrame) -> DataFrame:
    """Only the two columns the operators read, so that extra ones cannot clash; a null text is empty."""
    return docs.select(F.col(ID).cast("long").alias(ID), F.coalesce(F.col(TEXT), F.lit("")).alias(TEXT))


def keep_by(docs: DataFrame, chosen: DataFrame, how: str, **keys: Column) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` are (``left_semi``) or are not (``left_anti``) among the rows of ``chosen``.

    Rows travel as one struct beside the keys, so no column of theirs can clash with a key; nulls
    match each other.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document"), *[key.alias(name) for name, key in keys.items()])
    there = chosen.select(*[F.col(name).alias(f"{name}_there") for name in keys])
    same = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"{name}_there")) for name in keys])
    return rows.join(there, same, how).select("document.*")


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; the session hands whole texts to Python at most TEXT_ROWS at a time, not the usual 10,000."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(BATCH_ROWS)) <= TEXT_ROWS:
        conf.set(BATCH_ROWS, str(TEXT_ROWS))
    return docs


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a batch one after another, never all of them as Python strings."""
    return (value.as_py() for value in column)


def fold(key: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: dict[int, int]) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of at most ``per_class[c]`` labelled rows of each class.

    Rows are taken in the order of a hash of the id, so the sample does not depend on the
    partitioning. The id list has a fixed bound and is broadcast; the texts are only read here.
    """
    rows = labels.select(F.col(ID).cast("long").alias(ID), F.col(label).cast("int").alias("label")).where(
        F.col(ID).isNotNull() & F.col("label").isNotNull() & keep
    )
    chosen = None
    for value, most in per_class.items():
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64(ID), ID).limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    return document_columns(docs).join(F.broadcast(chosen.dropDuplicates([ID])), ID)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)
