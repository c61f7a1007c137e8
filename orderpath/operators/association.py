"""Strength of association: information value, correlation, Cramér's V, VIF, selection."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpath.operators import comoments
from orderpath.operators.joins import lookup_join
from orderpath.operators.scan import rank_bin, running_totals
from orderpath.session import stage_table

MISSING = "MISSING"

# Relative rank error of the sketches that bracket bin edges, as 1 / ACCURACY.
ACCURACY = 1_000


def _entries(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(_event, _v, value) with one row per column of every row.

    A small number stands for the variable until the rows are few: names would make up
    most of what is shuffled and compared.
    """
    entries = [
        F.struct(F.lit(i).alias("_v"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns, 1)
    ]
    return df.select(F.col(target).alias("_event"), F.inline(F.array(*entries)))


def _brackets(values: DataFrame, k: int, bins: int, accuracy: int) -> tuple[Column, Column]:
    """Arrays of the lower and upper bounds around the bin edges of the row's variable.

    Sketches are combined per variable; the driver gets two numbers per edge.
    """
    edges = [i / bins for i in range(1, bins)]
    reach = 2.0 / accuracy
    points = [max(0.0, e - reach) for e in edges] + [min(1.0, e + reach) for e in edges]
    sketched = (
        values.groupBy("_v")
        .agg(F.percentile_approx(F.nullif("value", F.lit(float("nan"))), points, accuracy).alias("bounds"))
        .collect()
    )
    found = {row["_v"]: row["bounds"] for row in sketched}
    bounds = [found.get(i) or [None] * len(points) for i in range(1, k + 1)]

    def of_variable(part: slice) -> Column:
        rows = [F.array(*[F.lit(b).cast("double") for b in row[part]]) for row in bounds]
        return F.element_at(F.array(*rows), F.col("_v"))

    return of_variable(slice(0, len(edges))), of_variable(slice(len(edges), None))


def _counted(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    return values.groupBy(*keys).agg(
        F.min("value").alias("lower"),
        F.max("value").alias("upper"),
        F.sum("_event").cast("bigint").alias("n_event"),
        (F.count(F.lit(1)) - F.sum("_event")).cast("bigint").alias("n_other"),
    )


def _ranked(groups: DataFrame) -> DataFrame:
    # NULL keeps a piece of its own in the sort, so one pass serves known and unknown.
    known = groups.withColumn("_known", F.col("lower").isNotNull()).withColumn("n", F.col("n_event") + F.col("n_other"))
    return running_totals(known, ["_v", "_known"], ["lower"], {"n": F.col("n")})


def numeric_bins(
    df: DataFrame, columns: Sequence[str], target: str, bins: int, accuracy: int = ACCURACY
) -> DataFrame:
    """(variable, bin, lower, n_event, n_other) of equal-frequency bins.

    A quantile sketch per variable brackets every bin edge. One counted pass keeps the
    distinct values inside the brackets and one sum for each stretch between them, both
    combined before the shuffle; ranks over those give the exact edges. Where a sketch
    missed an edge, so that a stretch reaches over two bins, all distinct values of
    that variable are ranked. ``lower`` is the smallest value of a bin; NULL has its
    own bin, NaN counts as the largest value.
    """
    if not columns:
        raise ValueError("no columns to bin")
    values = _entries(df, columns, target)
    bounds = dict(zip(("_low", "_high"), _brackets(values, len(columns), bins, accuracy)))
    # Named once: written out at every edge, the bounds of all variables would make a huge plan.
    low, high, value, steps = F.col("_low"), F.col("_high"), F.col("value"), range(bins - 1)
    reached = reduce(
        Column.__add__, [F.when(value >= low[i], 1).otherwise(0) for i in steps], F.lit(0)
    )
    inside = reduce(
        Column.__or__, [F.coalesce((value >= low[i]) & (value <= high[i]), F.lit(False)) for i in steps], F.lit(False)
    )
    stretches = values.withColumns(bounds).withColumns(
        {"_slot": F.when(value.isNotNull(), reached), "_exact": F.when(inside, value)}
    )
    ranked = _ranked(_counted(stretches, ["_v", "_slot", "_exact"]))
    end = F.expr(f"CAST(least((below_n + n - 1) * {bins} div total_n, {bins - 1}) AS INT)")
    split = F.col("_known") & (F.col("lower") < F.col("upper")) & (end != rank_bin(bins))
    missed = sorted(row["_v"] for row in ranked.where(split).select("_v").distinct().collect())
    ranked = ranked.drop("_slot", "_exact")
    if missed:
        again = F.col("_v").isin(missed)
        ranked = ranked.where(~again).unionByName(
            _ranked(_counted(values.where(again).withColumn("_exact", value), ["_v", "_exact"])).drop("_exact")
        )
    slot = F.when(F.col("_known"), rank_bin(bins).cast("string")).otherwise(F.lit(MISSING))
    binned = ranked.groupBy("_v", slot.alias("bin")).agg(
        F.min("lower").alias("lower"),
        F.sum("n_event").alias("n_event"),
        F.sum("n_other").alias("n_other"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    return binned.select(
        F.element_at(names, F.col("_v")).alias("variable"), "bin", "lower", "n_event", "n_other"
    )


def category_bins(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(variable, bin, lower, n_event, n_other) with every level as its own bin."""
    entries = [
        F.struct(
            F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("bin")
        )
        for c in columns
    ]
    return (
        df.select(F.col(target).alias("_event"), F.inline(F.array(*entries)))
        .groupBy("variable", "bin")
        .agg(
            F.lit(None).cast("double").alias("lower"),
            F.sum("_event").cast("bigint").alias("n_event"),
            (F.count(F.lit(1)) - F.sum("_event")).cast("bigint").alias("n_other"),
        )
    )


def weigh_bins(binned: DataFrame, by: str = "variable") -> DataFrame:
    """Add weight of evidence and information value per bin; an empty cell adds 0."""
    binned = stage_table(binned, "bins")
    totals = binned.groupBy(by).agg(
        F.sum("n_event").alias("_events"), F.sum("n_other").alias("_others")
    )
    joined = lookup_join(binned, totals, [by], spread=["bin"], written=True)
    event, other = F.col("n_event") / F.col("_events"), F.col("n_other") / F.col("_others")
    filled = (F.col("n_event") > 0) & (F.col("n_other") > 0)
    woe = F.when(filled, F.log(other / event)).otherwise(F.lit(0.0))
    return joined.withColumn("woe", woe).withColumn(
        "iv", F.when(filled, (other - event) * F.col("woe")).otherwise(F.lit(0.0))
    ).drop("_events", "_others")


def iv_bins(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, bins: int
) -> DataFrame:
    parts = []
    if numeric:
        parts.append(numeric_bins(df, numeric, target, bins))
    if categorical:
        parts.append(category_bins(df, categorical, target))
    binned = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return weigh_bins(binned)


def information_value(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, bins: int = 10
) -> DataFrame:
    """Information value of every variable against a 0/1 target."""
    return (
        iv_bins(df, numeric, categorical, target, bins)
        .groupBy("variable")
        .agg(F.sum("iv").alias("iv"), F.count(F.lit(1)).alias("n_bins"))
    )


def _correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """k x k Pearson matrix; each pair uses the rows where both values are known.

    One read for all pairs, whatever columns have gaps. NaN where a side is constant.
    """
    known = [F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns]
    return comoments.of(df.select(*known)).correlations()


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable_a, variable_b, correlation) for all pairs; NULL where undefined."""
    matrix = _correlations(df, columns)
    rows = [
        (a, b, None if np.isnan(matrix[i, j]) else float(matrix[i, j]))
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows, "variable_a string, variable_b string, correlation double"
    )


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cramér's V of all pairs of category columns, from their contingency tables.

    One pass counts the cells of all pairs; chi-square then needs only the sum of
    ``cell^2 / (row total * column total)``, so no table is gathered anywhere.
    """
    level = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns}
    pairs = [
        F.struct(
            F.lit(a).alias("variable_a"),
            F.lit(b).alias("variable_b"),
            level[a].alias("level_a"),
            level[b].alias("level_b"),
        )
        for a, b in itertools.combinations_with_replacement(columns, 2)
    ]
    pair = ["variable_a", "variable_b"]
    cells = stage_table(
        df.select(F.inline(F.array(*pairs)))
        .groupBy(*pair, "level_a", "level_b")
        .agg(F.count(F.lit(1)).alias("n")),
        "cells",
    )
    side_a = cells.groupBy(*pair, "level_a").agg(F.sum("n").alias("n_a"))
    side_b = cells.groupBy(*pair, "level_b").agg(F.sum("n").alias("n_b"))
    terms = (
        cells.join(side_a, [*pair, "level_a"])
        .join(side_b, [*pair, "level_b"])
        .groupBy(*pair)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") / F.col("n_a") * (F.col("n") / F.col("n_b"))).alias("_q"),
        )
    )
    levels_a = side_a.groupBy(*pair).agg(F.count(F.lit(1)).alias("_ra"))
    levels_b = side_b.groupBy(*pair).agg(F.count(F.lit(1)).alias("_rb"))
    smaller = F.least("_ra", "_rb") - 1
    return (
        terms.join(levels_a, pair)
        .join(levels_b, pair)
        .select(
            *pair,
            F.when(smaller > 0, F.sqrt(F.greatest(F.col("_q") - 1, F.lit(0.0)) / smaller))
            .otherwise(F.lit(0.0))
            .alias("cramers_v"),
        )
    )


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """VIF per variable: the diagonal of the inverse k x k correlation matrix.

    A variable that others determine exactly has VIF infinity.
    """
    matrix = _correlations(df, columns)
    values = []
    for i in range(len(columns)):
        rest = [j for j in range(len(columns)) if j != i]
        if not rest:
            values.append(1.0)
            continue
        cross = matrix[np.ix_([i], rest)].ravel()
        weights, *_ = np.linalg.lstsq(matrix[np.ix_(rest, rest)], cross, rcond=None)
        unexplained = 1.0 - float(cross @ weights)
        values.append(float("inf") if unexplained < 1e-12 else 1.0 / unexplained)
    return df.sparkSession.createDataFrame(
        list(zip(columns, values)), "variable string, vif double"
    )


def _greedy(
    iv: Mapping[str, float], related: Mapping[tuple[str, str], float], iv_min: float, related_max: float
) -> list[str]:
    kept: list[str] = []
    # Values that differ by rounding noise only count as tied.
    for name in sorted(iv, key=lambda v: (-round(iv[v], 9), v)):
        if iv[name] < iv_min:
            break
        if all(abs(related.get((name, k), related.get((k, name), 0.0))) < related_max for k in kept):
            kept.append(name)
    return kept


def _selection(df: DataFrame, iv: Mapping[str, float], kept: Sequence[str]) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("rank", T.IntegerType()),
            T.StructField("variable", T.StringType()),
            T.StructField("iv", T.DoubleType()),
        ]
    )
    return df.sparkSession.createDataFrame([(i + 1, v, iv[v]) for i, v in enumerate(kept)], schema)


def select_numeric(
    df: DataFrame, columns: Sequence[str], target: str, iv_min: float = 0.01, corr_max: float = 0.5, bins: int = 10
) -> DataFrame:
    """Variables by falling information value, each little correlated with those kept.

    Statistics are distributed; the walk runs over one number per variable pair.
    """
    iv = {r["variable"]: r["iv"] for r in information_value(df, columns, [], target, bins).collect()}
    matrix = np.nan_to_num(_correlations(df, columns))
    related = {
        (a, b): float(matrix[i, j]) for i, a in enumerate(columns) for j, b in enumerate(columns)
    }
    return _selection(df, iv, _greedy(iv, related, iv_min, corr_max))


def select_categorical(
    df: DataFrame, columns: Sequence[str], target: str, iv_min: float = 0.01, v_max: float = 0.5
) -> DataFrame:
    iv = {r["variable"]: r["iv"] for r in information_value(df, [], columns, target).collect()}
    related = {(r["variable_a"], r["variable_b"]): r["cramers_v"] for r in cramers_v(df, columns).collect()}
    return _selection(df, iv, _greedy(iv, related, iv_min, v_max))
