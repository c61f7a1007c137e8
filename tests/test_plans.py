"""Shapes of the physical plans."""

import re

from conftest import SMALL
from orderpath.plans import catalog
from orderpath.plans import matrices as X
from orderpath.sources import tables as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def customer_exchanges(text):
    return len(re.findall(r"Exchange hashpartitioning\(customer_id#", text))


def test_matrices_shuffle_once_on_the_customer(spark, tmp_path):
    path = str(tmp_path / "flat")
    S.order_history(spark, SMALL).write.parquet(path)
    flat = S.read_orders(spark, path)
    for df in (
        X.order_matrix(flat, "2000-01-01", "binary", heavy=None),
        X.customer_binary_matrix(flat, heavy=None),
        X.customer_transition_matrix(flat, heavy=None),
    ):
        text = plan(df)
        assert text.count("Exchange") == customer_exchanges(text) == 1
        assert text.count("Sort [") == 1
        assert "Python" not in text and "ArrowEval" not in text


def test_scan_reads_only_what_is_asked(spark):
    text = plan(X.with_next_state(X.History.of(S.order_core(spark, SMALL), X.ORDERS, None)).rows().select("channel", "next_state"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "o_totalprice" not in schema and "o_orderstatus" not in schema


def test_unused_tables_are_not_joined(spark):
    text = plan(S.order_history(spark, SMALL, attributes=False).select("order_id", "channel"))
    assert "Join" not in text and text.count("FileScan") == 1


def test_group_shares_do_not_shuffle_the_matrix(spark, tmp_path):
    path = str(tmp_path / "flat")
    S.order_history(spark, SMALL).write.parquet(path)
    text = plan(X.order_matrix(S.read_orders(spark, path), "2000-01-01", "transition", heavy=None))
    assert text.count("BroadcastHashJoin") == 2
    assert "hashpartitioning(agency_id" not in text and "hashpartitioning(route_id" not in text


def test_line_totals_shuffle_once(spark):
    assert plan(S.line_totals(spark, SMALL)).count("Exchange") == 1
    assert plan(S.line_totals(spark, SMALL, heavy_rows=4)).count("Exchange") == 2


def test_customer_queries_join_only_what_they_need(spark):
    def joins(name):
        return plan(catalog.QUERIES[name](catalog.Tables(spark, SMALL))).count("Join ")

    for name in ("customer_counts", "customer_gap_stats", "customer_recency_windows", "latest_state"):
        assert joins(name) == 0
    assert joins("customer_measures") == joins("last3_trends") == 1
    assert joins("customer_attributes") == 3
