"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpath.session import stage_table

HEAVY_ROWS = 1_000_000
MAX_LISTED_KEYS = 20_000
BROADCAST_ROWS = 200_000
SALTS = 64
_SAMPLED_HITS = 1_000


@dataclass(frozen=True)
class HeavyKeys:
    """Keys whose rows must not meet in one task, with an estimate of their rows.

    ``frame`` has one column, ``heavy_key``; ``listed`` says that it holds at most
    ``MAX_LISTED_KEYS`` rows, which makes it safe to broadcast.
    """

    frame: DataFrame
    rows: int
    listed: bool

    def keys(self) -> DataFrame:
        return F.broadcast(self.frame) if self.listed else self.frame


def heavy_keys(df: DataFrame, key: str, heavy_rows: int = HEAVY_ROWS) -> HeavyKeys | None:
    """Find keys with about ``heavy_rows`` rows or more, or None.

    Reads one column. Counting a Bernoulli sample is enough because the answer only
    selects the route of a key: both routes process every row and agree, so a key
    that is missed or listed needlessly costs time, never results.
    """
    fraction = min(1.0, _SAMPLED_HITS / heavy_rows)
    keys = df.select(F.col(key).alias("heavy_key"))
    if fraction < 1.0:
        keys = keys.sample(fraction, seed=7)
    threshold = heavy_rows if fraction == 1.0 else 0.8 * _SAMPLED_HITS
    counts = keys.groupBy("heavy_key").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= threshold)
    found = counts.limit(MAX_LISTED_KEYS + 1).collect()
    if not found:
        return None
    if len(found) <= MAX_LISTED_KEYS:
        listed = df.sparkSession.createDataFrame(
            [(row["heavy_key"],) for row in found], keys.schema
        )
        return HeavyKeys(listed, math.ceil(sum(row["hits"] for row in found) / fraction), True)
    table = stage_table(counts, "heavy-keys")
    hits = table.agg(F.sum("hits")).first()[0]
    return HeavyKeys(table.select("heavy_key"), math.ceil(hits / fraction), False)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the left key columns are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        match = left[k].eqNullSafe(renamed[f"_right_{k}"])
        condition = match if condition is None else condition & match
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def _salt(spread: Sequence[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")


def dimension_join(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    heavy: HeavyKeys | None,
    spread: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join facts to a dimension too large to broadcast.

    Rows of heavy keys are spread over ``salts`` tasks by a hash of ``spread``, and
    only the dimension rows of those keys are repeated to meet them. By default there
    are enough salts to leave about HEAVY_ROWS rows of a key in each task.
    """
    if heavy is None:
        return facts.join(dimension, key, how)
    salts = salts or max(SALTS, math.ceil(heavy.rows / HEAVY_ROWS))
    marks = heavy.keys().select(F.col("heavy_key").alias(key), F.lit(True).alias("_heavy"))
    salted = (
        facts.join(marks, key, "left")
        .withColumn("_salt", F.when(F.col("_heavy"), _salt(spread, salts)).otherwise(F.lit(0)))
        .drop("_heavy")
    )
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = (
        dimension.join(marks, key, "left").withColumn("_salt", F.explode(copies)).drop("_heavy")
    )
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    written: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Join a per-group table back to the rows it describes.

    The table is written once (unless it is cheap to read: ``written``) and counted (unless
    the caller knows its ``rows``). Up
    to ``max_rows`` it is broadcast, so the facts are not shuffled at all; beyond that
    both sides are salted, so no group has to fit in one task.
    """
    table = table if written else stage_table(table, "lookup")
    rows = table.limit(max_rows + 1).count() if rows is None else rows
    if rows <= max_rows:
        return facts.join(F.broadcast(table), list(keys), how)
    salted = facts.withColumn("_salt", _salt(spread, salts))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
