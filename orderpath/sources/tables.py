"""Order and event histories read from parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpath.operators.joins import HEAVY_ROWS, HeavyKeys, dimension_join, heavy_keys

# Expected column kinds of a flat order history.
ORDER_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("channel", T.StringType()),
        T.StructField("billed_usd", T.DoubleType()),
        T.StructField("distinct_items", T.LongType()),
        T.StructField("boxes", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("sales_region", T.StringType()),
        T.StructField("agency_id", T.StringType()),
        T.StructField("route_id", T.StringType()),
        T.StructField("customer_type", T.StringType()),
        T.StructField("maturity", T.StringType()),
        T.StructField("stars_txt", T.StringType()),
        T.StructField("visit_code", T.StringType()),
    ]
)

# How order priorities stand for channels.
CHANNELS = {
    "1-URGENT": "DIGITAL",
    "2-HIGH": "DIGITAL",
    "3-MEDIUM": "REP",
    "4-NOT SPECIFIED": "PHONE",
}
OTHER_CHANNEL = "STORE"


def read_orders(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str] | None = None,
    time: str = "order_date",
    schema: T.StructType = ORDER_SCHEMA,
) -> DataFrame:
    """Read a flat order table: rename, bring the time to a date, check and cast.

    ``columns`` maps our names to the names in the file. A missing column is an error
    at once; a value that does not fit its type becomes NULL.
    """
    raw = spark.read.parquet(path)
    names = dict(columns or {})
    missing = [f.name for f in schema if names.get(f.name, f.name) not in raw.columns]
    if missing:
        raise ValueError(f"order table lacks columns for: {', '.join(missing)}")
    picked = []
    for field in schema:
        source = F.col(names.get(field.name, field.name))
        value = F.to_date(source) if field.name == time else source.try_cast(field.dataType)
        picked.append(value.alias(field.name))
    return raw.select(*picked)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy_customers(spark: SparkSession, sf_dir: str, heavy_rows: int = HEAVY_ROWS) -> HeavyKeys | None:
    return heavy_keys(_table(spark, sf_dir, "orders"), "o_custkey", heavy_rows)


def order_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order id, customer, date, channel and amount: everything that needs no join."""
    channel = F.lit(OTHER_CHANNEL)
    for priority, name in CHANNELS.items():
        channel = F.when(F.col("o_orderpriority") == priority, name).otherwise(channel)
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"),
        channel.alias("channel"),
        F.col("o_totalprice").alias("billed_usd"),
    )


def customer_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the descriptive columns of its orders."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    customer = _table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    balance = F.col("c_acctbal")
    return customer.join(places, customer.c_nationkey == places.n_nationkey, "left").select(
        key.alias("customer_id"),
        F.col("r_name").alias("country"),
        F.col("n_name").alias("sales_region"),
        F.when(key % 17 == 0, "UNASSIGNED")
        .otherwise(
            F.concat(
                F.lit("N"), F.col("n_regionkey").cast("string"), F.lit("-A"), F.col("n_nationkey").cast("string")
            )
        )
        .alias("agency_id"),
        F.when(key % 19 == 0, "UNASSIGNED")
        .otherwise(F.concat(F.lit("Z-R"), (key % 60).cast("string")))
        .alias("route_id"),
        F.col("c_mktsegment").alias("customer_type"),
        F.when(balance < 0, F.lit(None).cast("string"))
        .when(balance < 3000, "LOW")
        .when(balance < 6500, "MEDIUM")
        .otherwise("HIGH")
        .alias("maturity"),
        F.when(key % 11 == 0, "N/A").otherwise((key % 5 + 1).cast("string")).alias("stars_txt"),
        F.substring(F.lit("LMXJVS"), F.lit(1), (key % 6 + 1).cast("int")).alias("visit_code"),
    )


def line_totals(spark: SparkSession, sf_dir: str, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Distinct parts and boxes per order.

    Lines of one order are few, so they are brought together once and counted in place.
    Where some order is heavy, its distinct parts are left to Spark's own plan, which
    shuffles on (order, part) first and again on the order.
    """
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    if heavy_keys(lines, "l_orderkey", heavy_rows) is None:
        lines = lines.repartition("l_orderkey")
    return lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.count_distinct("l_partkey").alias("distinct_items"), F.sum("l_quantity").alias("boxes")
    )


def order_history(
    spark: SparkSession, sf_dir: str, heavy: HeavyKeys | None = None, items: bool = True, attributes: bool = True
) -> DataFrame:
    """One row per order with its line totals and its customer's attributes.

    An order without a customer, nation or region keeps NULL attributes. Parts nobody asks for are not joined. ``heavy`` lists customers whose orders must
    be spread over several tasks in the customer join.
    """
    orders = order_core(spark, sf_dir)
    if items:
        lines = line_totals(spark, sf_dir)
        orders = orders.join(lines, "order_id", "left").fillna({"distinct_items": 0, "boxes": 0.0})
    if attributes:
        orders = dimension_join(
            orders, customer_attributes(spark, sf_dir), "customer_id", heavy, spread=["order_id"], how="left"
        )
    return orders.select(*[f.name for f in ORDER_SCHEMA if f.name in orders.columns])


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")


def preview(df: DataFrame, order: str, rows: int = 5) -> DataFrame:
    return df.orderBy(order).limit(rows)


def columns_by_kind(df: DataFrame) -> DataFrame:
    """Name, type and kind of every column with its count of known values."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    entries = []
    for field in df.schema:
        if isinstance(field.dataType, T.NumericType):
            kind = "numeric"
        elif isinstance(field.dataType, T.StringType):
            kind = "category"
        else:
            kind = "other"
        entries.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(kind).alias("kind"),
                F.col(field.name).alias("known_values"),
            )
        )
    return counts.select(F.inline(F.array(*entries)))
