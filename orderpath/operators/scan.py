"""Running totals and exact quantiles by total sort, without one task per group.

A window partitioned by a group puts the whole group in one task. Here the rows are
range-partitioned by (group, value) instead: Spark samples the bounds, so a group of
any size is cut into pieces of similar size. Piece totals are few, a window over them
gives each piece its starting offset, and a window inside the piece does the rest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpath.operators.joins import null_safe_join
from orderpath.session import stage_table

PIECE = "_piece"


def ranged_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Cut the rows, sorted by keys and order, into contiguous pieces.

    The piece number is the range partition of the row. The result is written out,
    because two evaluations of a sampled partitioning need not agree.
    """
    columns = [F.col(c) for c in [*keys, *order]]
    ranged = df.repartitionByRange(pieces, *columns) if pieces else df.repartitionByRange(*columns)
    return stage_table(ranged.withColumn(PIECE, F.spark_partition_id()), "pieces")


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weights: Mapping[str, Column]
) -> DataFrame:
    """Add ``below_<name>`` (sum over the rows sorted before) and ``total_<name>``.

    Rows must be unique in (keys, order).
    """
    weighted = df.withColumns({f"_w_{name}": weight for name, weight in weights.items()})
    pieces = ranged_pieces(weighted, keys, order)
    per_piece = pieces.groupBy(*keys, PIECE).agg(
        *[F.sum(f"_w_{name}").alias(f"_p_{name}") for name in weights]
    )
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_piece.select(
        *keys,
        PIECE,
        *[F.coalesce(F.sum(f"_p_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in weights],
        *[F.sum(f"_p_{n}").over(Window.partitionBy(*keys)).alias(f"total_{n}") for n in weights],
    )
    inside = (
        Window.partitionBy(*keys, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = pieces.withColumns(
        {f"_l_{n}": F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)) for n in weights}
    )
    joined = null_safe_join(local, offsets, [*keys, PIECE])
    return joined.withColumns(
        {f"below_{n}": F.col(f"_l_{n}") + F.col(f"_o_{n}") for n in weights}
    ).drop(PIECE, *[f"_{k}_{n}" for k in "wlo" for n in weights])


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their row counts; NULL values are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with ``n``, ``below_n`` and ``total_n`` inside their group."""
    return running_totals(value_counts(df, keys, value), keys, [value], {"n": F.col("n")})


def quantiles_of_ranked(
    ranked: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles, one column per point.

    A distinct value covers the positions ``below_n .. below_n + n - 1``. Every point
    needs the values at two neighbouring positions, so the aggregate looks at each
    distinct value once and keeps two numbers per point.
    """
    first, last = F.col("below_n"), F.col("below_n") + F.col("n") - 1
    picks = []
    for name, point in points.items():
        position = F.lit(float(point)) * (F.col("total_n") - 1)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when((first <= at) & (at <= last), F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_part"))
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_{name}_lo").cast("double")
                + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_part")
            ).alias(name)
            for name in points
        ],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    return quantiles_of_ranked(ranked_values(df, keys, value), keys, value, points)


def rank_bin(bins: int) -> Column:
    """Equal-frequency bin from rank: equal values share a bin, 0 is the lowest."""
    return F.expr(f"CAST(least(below_n * {bins} div total_n, {bins - 1}) AS INT)")
