"""Histories written by entity: same results, no shuffle on the entity."""

import re

import pytest

from conftest import SMALL, close_rows
from orderpath.operators.history import History
from orderpath.plans import matrices as X
from orderpath.sources import tables as S
from orderpath.sources.layout import open_entity_layout, write_entity_layout
from orderpath.spec import EVENTS, ORDERS

MATRICES = {
    "order binary": (lambda h, **o: X.order_matrix(h, "2000-01-01", "binary", **o), ["order_id"]),
    "order classes": (lambda h, **o: X.order_matrix(h, "2000-01-01", "transition", **o), ["order_id"]),
    "customer binary": (X.customer_binary_matrix, ["customer_id"]),
    "customer classes": (X.customer_transition_matrix, ["customer_id"]),
    "customer fanout": (lambda h, **o: X.customer_transition_matrix(h, ties="fanout", **o), ["customer_id", "target"]),
}


@pytest.fixture(scope="module")
def full(spark):
    return S.order_history(spark, SMALL).cache()


@pytest.fixture(scope="module")
def plain(spark, full, tmp_path_factory):
    return write_entity_layout(full, ORDERS, str(tmp_path_factory.mktemp("plain") / "t"), buckets=8, heavy=None)


@pytest.fixture(scope="module")
def mixed(spark, full, tmp_path_factory):
    """Customers with 8 orders or more count as heavy, in blocks of 4 rows."""
    path = str(tmp_path_factory.mktemp("mixed") / "t")
    return write_entity_layout(full, ORDERS, path, buckets=8, heavy_rows=8, block_rows=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", MATRICES)
def test_results_are_those_of_the_flat_table(full, plain, mixed, name):
    build, key = MATRICES[name]
    expected = build(full, heavy=None)
    close_rows(expected, build(plain), key)
    close_rows(expected, build(mixed), key)


@pytest.mark.parametrize("name", ["order binary", "customer binary", "customer classes"])
def test_no_shuffle_at_all(plain, name):
    text = plan(MATRICES[name][0](plain))
    assert "Exchange" not in text
    assert re.search(r"Bucketed: true", text)


def test_only_light_customers_lie_in_buckets(full, mixed):
    light, heavy = full.groupBy("customer_id").count().where("count < 8"), mixed.long
    assert mixed.ordinary.select("customer_id").distinct().count() == light.count()
    assert heavy.count() + mixed.ordinary.count() == full.count()
    assert mixed.heavy.rows == heavy.count() > 0


def test_opened_again(spark, full, tmp_path):
    path = str(tmp_path / "t")
    written = write_entity_layout(full, ORDERS, path, buckets=3, heavy_rows=8, block_rows=4)
    again = open_entity_layout(spark, ORDERS, path, block_rows=4)
    key = ["customer_id"]
    close_rows(X.customer_binary_matrix(written), X.customer_binary_matrix(again), key)
    with pytest.raises(ValueError):
        open_entity_layout(spark, EVENTS, path)
    with pytest.raises(Exception):
        write_entity_layout(full, ORDERS, path, buckets=3, heavy=None)


def test_null_customers_ties_and_an_empty_table(spark, orders, tmp_path):
    rows = orders(
        [
            (None, 1, 1, "DIGITAL"),
            (None, 2, 1, "STORE"),
            (None, 3, None, "DIGITAL"),
            (5, 4, 2, "PHONE"),
            (5, 5, 2, "DIGITAL"),
            (5, 6, 9, "DIGITAL"),
        ]
    )
    history = write_entity_layout(rows, ORDERS, str(tmp_path / "a"), buckets=2, heavy=None)
    close_rows(X.order_matrix(rows, "2000-01-05", "binary", heavy=None), X.order_matrix(history, "2000-01-05", "binary"), ["order_id"])
    split = write_entity_layout(rows, ORDERS, str(tmp_path / "b"), buckets=2, heavy_rows=3, block_rows=2)
    close_rows(X.customer_binary_matrix(rows, heavy=None), X.customer_binary_matrix(split), ["customer_id"])
    empty = write_entity_layout(rows.limit(0), ORDERS, str(tmp_path / "c"))
    assert X.customer_binary_matrix(empty).collect() == []


def test_layout_of_events(spark, tmp_path):
    events = S.event_history(spark, SMALL)
    history = write_entity_layout(events, EVENTS, str(tmp_path / "e"), buckets=4, heavy=None)
    stats = {"value": ("mean", "sum")}
    flat = X.with_running_features(History.of(events, EVENTS, None), stats).rows()
    laid = X.with_running_features(history, stats).rows()
    assert "Exchange" not in plan(laid)
    close_rows(flat, laid.select(*flat.columns), ["event_id"])
