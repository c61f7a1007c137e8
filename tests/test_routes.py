"""The route for long histories gives what the plain windows give."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, close_rows
from orderpath.operators.history import History
from orderpath.operators.joins import dimension_join, heavy_keys, lookup_join
from orderpath.plans import matrices as X
from orderpath.sources import tables as S
from orderpath.spec import EVENTS, ORDERS

# Customers with 8 orders or more count as heavy, in blocks of 4 rows.
LONG = dict(heavy_rows=8, block_rows=4)


@pytest.fixture(scope="module")
def full(spark):
    return S.order_history(spark, SMALL).cache()


def test_heavy_keys_are_found(full):
    found = heavy_keys(full, "customer_id", 8)
    exact = full.groupBy("customer_id").count().where("count >= 8")
    assert {r[0] for r in found.frame.collect()} == {r[0] for r in exact.collect()}
    assert found.rows == exact.agg(F.sum("count")).first()[0]
    assert heavy_keys(full, "customer_id", 1000) is None


@pytest.mark.parametrize("target", ["transition", "binary"])
def test_order_matrix(full, target):
    plain = X.order_matrix(full, "2000-01-01", target, heavy=None)
    long = X.order_matrix(full, "2000-01-01", target, **LONG)
    close_rows(plain, long, ["order_id"])


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_customer_binary_matrix(full, block_rows):
    plain = X.customer_binary_matrix(full, heavy=None)
    long = X.customer_binary_matrix(full, heavy_rows=8, block_rows=block_rows)
    close_rows(plain, long, ["customer_id"])


@pytest.mark.parametrize("ties", ["drop", "fanout"])
def test_customer_transition_matrix(full, ties):
    plain = X.customer_transition_matrix(full, ties=ties, heavy=None)
    long = X.customer_transition_matrix(full, ties=ties, **LONG)
    close_rows(plain, long, ["customer_id", "target"])


def test_one_entity_holds_every_row(spark):
    """A single history cut into many blocks, large values included."""
    rows = spark.range(500).select(
        F.lit(1).cast("bigint").alias("user_id"),
        F.col("id").alias("event_id"),
        F.timestamp_seconds(1_700_000_000 + (F.col("id") * 37) % 500 * 3600).alias("ts"),
        F.when(F.col("id") % 3 == 0, "purchase").when(F.col("id") % 7 == 0, F.lit(None)).otherwise("view").alias("event_type"),
        (F.lit(1e9) + F.sin("id")).alias("value"),
    )
    stats = {"value": ("mean", "sum", "std")}
    plain = X.with_running_features(X.with_next_state(History.of(rows, EVENTS, None)), stats).rows()
    cut = History.of(rows, EVENTS, heavy_rows=100, block_rows=16)
    assert cut.long is not None and cut.ordinary.count() == 0
    long = X.with_running_features(X.with_next_state(cut), stats).rows()
    close_rows(plain.select(sorted(plain.columns)), long.select(sorted(plain.columns)), ["event_id"], 1e-6)


def test_null_entity_is_a_history_too(orders):
    rows = orders([(None, i, i, "DIGITAL" if i % 2 else "REP") for i in range(1, 12)])
    plain = History.of(rows, ORDERS, None).annotate(lag={"p": "channel"}, position="n").rows()
    long = History.of(rows, ORDERS, heavy_rows=5, block_rows=3).annotate(lag={"p": "channel"}, position="n").rows()
    close_rows(plain, long, ["order_id"])


def test_entity_totals(full):
    def marked(**route):
        history = X.history_rows(History.of(full, ORDERS, **route))
        return history.with_totals(n_last=F.sum("is_last")).rows().select("order_id", "n_last")

    close_rows(marked(heavy=None), marked(**LONG), ["order_id"])


def test_salted_dimension_join(spark):
    core, customers = S.order_core(spark, SMALL), S.customer_attributes(spark, SMALL)
    heavy = heavy_keys(core, "customer_id", 10)
    plain = core.join(customers, "customer_id")
    salted = dimension_join(core, customers, "customer_id", heavy, ["order_id"], salts=5)
    close_rows(plain, salted.select(plain.columns), ["order_id"])


def test_lookup_join_past_the_broadcast_bound(full):
    table = full.groupBy("route_id").agg(F.avg("billed_usd").alias("m")).where("route_id <> 'UNASSIGNED'")
    small = lookup_join(full, table, ["route_id"], ["order_id"])
    large = lookup_join(full, table, ["route_id"], ["order_id"], max_rows=3, salts=4)
    close_rows(small, large.select(small.columns), ["order_id"])
    assert small.where("m IS NULL").count() > 0


def test_line_totals_of_heavy_orders(spark):
    plain, heavy = S.line_totals(spark, SMALL), S.line_totals(spark, SMALL, heavy_rows=4)
    close_rows(plain, heavy, ["order_id"])
