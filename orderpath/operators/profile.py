"""Data profiles: the numbers behind every table and chart of an exploration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderpath.operators.joins import lookup_join
from orderpath.operators.scan import exact_quantiles, quantiles_of_ranked, ranked_values
from orderpath.session import stage_table

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
WHISKER = 1.5


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def with_share(counted: DataFrame, *by: str, name: str = "share") -> DataFrame:
    """Share of ``n`` within the rows that agree on ``by``.

    ``counted`` is already aggregated, so a window group holds one row per level.
    """
    return counted.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def null_profile(df: DataFrame, worst: int | None = None) -> DataFrame:
    """NULL count and share per column, in one pass without a shuffle of rows."""
    total = F.count(F.lit(1)).alias("_rows")
    nulls = df.agg(total, *[(F.count(F.lit(1)) - F.count(c)).alias(c) for c in df.columns])
    table = nulls.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(c).alias("null_count"),
                        F.when(F.col("_rows") > 0, F.col(c) / F.col("_rows")).otherwise(0.0).alias("null_share"),
                    )
                    for c in df.columns
                ]
            )
        )
    )
    if worst is None:
        return table
    return table.orderBy(F.desc("null_share"), "column_name").limit(worst)


def _long(
    df: DataFrame, columns: Sequence[str], kind: str, name: str, value: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, name, value): one narrow row per column of every row."""
    entries = [F.struct(F.lit(c).alias(name), F.col(c).cast(kind).alias(value)) for c in columns]
    return df.select(*keys, F.inline(F.array(*entries)))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes, exact quartiles and zeros per numeric column."""
    long = _long(df, columns, "double", "column_name", "value")
    value = F.col("value")
    moments = long.groupBy("column_name").agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.sum(F.when(value == 0, 1).otherwise(0)).alias("zeros"),
    )
    quartiles = exact_quantiles(long, ["column_name"], "value", QUARTILES)
    return moments.join(quartiles, "column_name", "left")


def category_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share of every value of every category column; NULL is a value."""
    long = _long(df, columns, "string", "column_name", "value")
    counted = stage_table(counts(long, "column_name", "value"), "levels")
    # Every column has the same number of rows, so one of them gives the total.
    rows = counted.where(F.col("column_name") == columns[0]).agg(F.sum("n")).first()[0]
    return counted.withColumn("share", F.col("n") / F.lit(rows or 1))


def crossed_counts(df: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    """Attribute x state counts for several attributes in one pass."""
    return counts(_long(df, by, "string", "attribute", "level", [state]), "attribute", "level", state)


def nested_counts(df: DataFrame, outer: str, inner: str, state: str) -> DataFrame:
    """State counts per inner level with the level's size and its rank in the outer one."""
    counted = counts(df, outer, inner, state)
    level = Window.partitionBy(outer, inner)
    sized = counted.withColumn("level_total", F.sum("n").over(level))
    ordered = Window.partitionBy(outer).orderBy(F.desc("level_total"), F.asc(inner))
    return sized.withColumn("level_rank", F.dense_rank().over(ordered))


def box_statistics(df: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers and outlier counts per group and measure.

    Works on distinct values with counts. Quartiles have one row per (measure, group).
    """
    long = _long(df, measures, "double", "measure", "value", [by])
    keys = ["measure", by]
    ranked = stage_table(ranked_values(long, keys, "value"), "ranked")
    quartiles = quantiles_of_ranked(ranked, keys, "value", QUARTILES)
    fenced = lookup_join(ranked, quartiles, keys, spread=["value"], how="inner", written=True)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    value, n = F.col("value"), F.col("n")
    inside = (value >= low) & (value <= high)
    return fenced.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        *[F.max(q).alias(q) for q in QUARTILES],
        F.min(F.when(inside, value)).alias("whisker_low"),
        F.max(F.when(inside, value)).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(n)).alias("outliers"),
    )


def entity_frequency(df: DataFrame, entity: str, state: str) -> DataFrame:
    """Box statistics, by state, of how often an entity uses the state."""
    return box_statistics(
        counts(df, entity, state).withColumnRenamed("n", "events_per_entity"), state, ["events_per_entity"]
    )


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins over the value range, the last one closed on both sides.

    The data are read once, into distinct values with counts; the range is two numbers
    of that table. Empty bins are kept.
    """
    values = stage_table(
        counts(df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value")), "value"),
        "values",
    )
    low, high = values.agg(F.min("value"), F.max("value")).first()
    frame = df.sparkSession.range(0 if low is None else bins).select(F.col("id").cast("int").alias("bin"))
    if low is None or low == high:
        low, high = (low or 0.0) - 0.5, (low or 0.0) + 0.5
    width = (high - low) / bins
    slot = F.least(F.floor((F.col("value") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    filled = values.groupBy(slot.alias("bin")).agg(F.sum("n").alias("n"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def distribution(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of one column."""
    return numeric_profile(df, [value]).drop("zeros")


def transition_matrix(pairs: DataFrame, current: str, following: str) -> DataFrame:
    """Counts of (current, next) with their share of the current state."""
    return with_share(counts(pairs, current, following), current)


def state_mix(df: DataFrame, segments: Sequence[str], state: str) -> DataFrame:
    """State counts and shares inside every level of several segment columns."""
    counted = crossed_counts(df, segments, state).withColumnsRenamed({"attribute": "segment"})
    return with_share(counted, "segment", "level")


def state_columns(df: DataFrame, segment: str, state: str, levels: Sequence[str]) -> DataFrame:
    """One row per segment level, one count column per state, absent states as 0."""
    return df.groupBy(segment).agg(
        *[F.sum(F.when(F.col(state) == level, 1).otherwise(0)).alias(level) for level in levels]
    )


def balance_report(matrix: DataFrame, period: str, columns: Sequence[str]) -> DataFrame:
    """Share of the periods, and of every level of the given columns inside a period."""
    renamed = matrix.withColumnRenamed(period, "period")
    long = _long(renamed, columns, "string", "variable", "level", ["period"])
    counted = stage_table(counts(long, "period", "variable", "level"), "balance")
    inside = with_share(counted, "period", "variable")
    one = counted.where(F.col("variable") == columns[0])
    split = with_share(one.groupBy(F.col("period").alias("level")).agg(F.sum("n").alias("n")))
    return split.select(
        F.lit("ALL").alias("period"), F.lit("period").alias("variable"), "level", "n", "share"
    ).unionByName(inside)


def distinct_levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long(df, columns, "string", "column_name", "level").distinct()


def lump_rare(df: DataFrame, column: str, keep: int = 20, other: str = "OTHER") -> DataFrame:
    """Keep the most frequent values of a column and name all others, and NULL, ``other``.

    Ties are kept in value order. The list has ``keep`` values, so it travels as a
    constant and the rows are not joined.
    """
    known = counts(df.where(F.col(column).isNotNull()), column)
    top = [r[0] for r in known.orderBy(F.desc("n"), F.asc(column)).limit(keep).collect()]
    return df.withColumn(
        column, F.when(F.col(column).isin(top), F.col(column)).otherwise(F.lit(other))
    )

