"""Counts, means and centred products of column pairs under pairwise masks.

A block holds k x k arrays; entry (a, b) covers the rows where both a and b are known.
Blocks merge in any order, so tasks reduce Arrow batches to one block each, a shuffle
of blocks reduces those again, and the driver adds up what is left: at most one
block per shuffle partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

_SCHEMA = "part int, n binary, mean binary, square binary, product binary"


@dataclass
class Comoments:
    """``n`` rows, ``mean`` and ``square`` (centred sum of squares) of a, ``product`` of a and b."""

    n: np.ndarray
    mean: np.ndarray
    square: np.ndarray
    product: np.ndarray

    @classmethod
    def empty(cls, k: int) -> Comoments:
        return cls(*[np.zeros((k, k)) for _ in fields(cls)])

    @classmethod
    def of_rows(cls, rows: np.ndarray) -> Comoments:
        """Block of an array of rows; NaN stands for unknown."""
        known = ~np.isnan(rows)
        count = known.sum(axis=0)
        low = np.where(known, rows, np.inf).min(axis=0, initial=np.inf)
        high = np.where(known, rows, -np.inf).max(axis=0, initial=-np.inf)
        with np.errstate(invalid="ignore", over="ignore"):
            middle = np.where(known, rows, 0.0).sum(axis=0) / np.maximum(count, 1)
            # A constant is taken off exactly, so that rounding gives it no spread.
            centre = np.where(count == 0, 0.0, np.where(low == high, low, middle))
            shifted = np.where(known, rows - centre, 0.0)
            mask = known.astype(float)
            n = mask.T @ mask
            some = np.maximum(n, 1.0)
            sums = shifted.T @ mask
            return cls(
                n,
                np.where(n > 0, centre[:, None] + sums / some, 0.0),
                (shifted**2).T @ mask - sums**2 / some,
                shifted.T @ shifted - sums * sums.T / some,
            )

    def merge(self, other: Comoments) -> Comoments:
        n = self.n + other.n
        some = np.maximum(n, 1.0)
        # A side without rows says nothing about the mean.
        with np.errstate(invalid="ignore", over="ignore"):
            apart = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
            weight = self.n * other.n / some
            mean = np.where(self.n > 0, self.mean + apart * other.n / some, other.mean)
            return Comoments(
                n,
                mean,
                self.square + other.square + apart**2 * weight,
                self.product + other.product + apart * apart.T * weight,
            )

    def correlations(self) -> np.ndarray:
        """Pearson matrix; NaN where fewer than two rows or a constant side."""
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            spread = np.sqrt(self.square) * np.sqrt(self.square.T)
            matrix = np.where(spread > 0, np.clip(self.product / spread, -1.0, 1.0), np.nan)
        defined = ~np.isnan(np.diag(matrix))
        matrix[np.diag_indices_from(matrix)] = np.where(defined, 1.0, np.nan)
        return matrix

    def _batch(self, part: int) -> pa.RecordBatch:
        arrays = [pa.array([getattr(self, f.name).tobytes()], pa.binary()) for f in fields(self)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *arrays], ["part", *[f.name for f in fields(self)]])

    @classmethod
    def _read(cls, values: Iterable[bytes], k: int) -> Comoments:
        return cls(*[np.frombuffer(v, dtype=float).reshape(k, k) for v in values])


def of(df: DataFrame) -> Comoments:
    """Co-moments of all pairs of the columns of ``df``, which are doubles; NULL is unknown."""
    k = len(df.columns)

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Comoments.empty(k)
        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                total = total.merge(Comoments.of_rows(rows.astype(float)))
        yield total._batch(TaskContext.get().partitionId())

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Comoments.empty(k)
        for batch in batches:
            for row in zip(*[batch.column(f.name).to_pylist() for f in fields(Comoments)]):
                total = total.merge(Comoments._read(row, k))
        yield total._batch(TaskContext.get().partitionId())

    blocks = df.mapInArrow(of_batches, _SCHEMA).repartition("part").mapInArrow(of_blocks, _SCHEMA)
    total = Comoments.empty(k)
    for row in blocks.collect():
        total = total.merge(Comoments._read([row[f.name] for f in fields(Comoments)], k))
    return total
