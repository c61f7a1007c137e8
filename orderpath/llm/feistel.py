"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0 .. n-1 in the order of (doc_id, text_crc32, size) without a single-task
window: they are range-partitioned and sorted, and the counts of the parts before are added.
A Feistel network over pairs (left < a, right < b) with a * b >= n permutes 0 .. a*b-1;
numbers outside 0 .. n-1 are fed back (cycle walking) until they are inside. a * b exceeds n
by less than a, about sqrt(n), so hardly any number walks. Position p goes to shard
p mod shards, slot p div shards: both follow from the row number, n and the key alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpath.llm.common import document_columns, stage_table

# The prime 2**31 - 1 and a published multiplier for it.
PRIME, MULTIPLIER = 2147483647, 48271
PAIRS_OF_ROUNDS = 4
WALK = 64
LOCAL_BITS = 33


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, max(1, -(-n // a))


def round_keys(key: int) -> list[tuple[int, int]]:
    keys, state = [], (key + 1) % PRIME or 1
    for _ in range(2 * PAIRS_OF_ROUNDS):
        state = state * MULTIPLIER % PRIME
        keys.append(state)
    return list(zip(keys[::2], keys[1::2]))


def mix(value: Column, key: Column) -> Column:
    """A number below PRIME; no product leaves 64 bits."""
    return ((value + key) % PRIME * ((value % PRIME * MULTIPLIER + key) % PRIME)) % PRIME


def permute(number: Column, n: int, key: int) -> Column:
    """One pass of the network, a bijection of 0 .. a*b-1."""
    a, b = sides(n)

    def rounds(state: Column, keys: Column) -> Column:
        left = (state["left"] + mix(state["right"], keys["one"])) % a
        right = (state["right"] + mix(left, keys["two"])) % b
        return F.struct(left.alias("left"), right.alias("right"))

    keys = F.array(*[F.struct(F.lit(x).cast("long").alias("one"), F.lit(y).cast("long").alias("two")) for x, y in round_keys(key)])
    low = (number % b).cast("long")
    start = F.struct((((number - low) / b).cast("long")).alias("left"), low.alias("right"))
    return F.aggregate(keys, start, rounds, lambda s: s["left"] * b + s["right"])


def shuffled_position(number: Column, n: int, key: int) -> Column:
    """Position of row ``number`` among ``n``: the network with cycle walking.

    A walk longer than WALK steps cannot happen for n <= WALK ** 2 and has a chance below
    ``n ** (-WALK / 2)`` beyond; it raises instead of giving a wrong position.
    """

    def step(at: Column, _: Column) -> Column:
        return F.when(at < n, at).otherwise(permute(at, n, key))

    walk = F.sequence(F.lit(1), F.lit(WALK))
    end = F.aggregate(walk, permute(number, n, key), step)
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def number_rows(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` from 0 in the given order (nulls first), and their count.

    The sorted parts are written once; only one count per part meets in one task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stage_table(placed, "numbered")
    part = F.shiftright("_at", LOCAL_BITS).alias("_part")
    totals = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    local = F.col("_at").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(base), "_part")
    return numbered.withColumn("row_number", F.col("_base") + local).drop("_at", "_part", "_base"), placed.count()


def shard_documents(docs: DataFrame, shards: int = 24, key: int = 20240229) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``row_number``, ``shard``, ``slot`` of every row.

    Shard counts differ by one at most and slots have no gaps. ``size`` is the UTF-8 bytes of
    the text plus 8; a null text has no bytes and crc32 0. Null ids come first; repeated rows
    are numbered one after the other. An empty table gives no rows.
    """
    rows = document_columns(docs).select(
        "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")
    )
    numbered, n = number_rows(rows, "doc_id", "text_crc32", "size")
    placed = numbered.withColumn("_p", shuffled_position(F.col("row_number"), n, key))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("_p") % shards).cast("int").alias("shard"),
        ((F.col("_p") - F.col("_p") % shards) / shards).cast("long").alias("slot"),
    )
