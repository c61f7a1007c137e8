"""Faults of the first round that must not come back."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from orderpath.modeling.boosting import BoostSettings, fit_boosted, rounds_to_keep
from orderpath.modeling.scorecard import WoeEncoder
from orderpath.operators.association import pearson_matrix, variance_inflation
from orderpath.sources.tables import customer_attributes, order_history


def test_pearson_uses_the_rows_each_pair_has(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 5.0), (3.0, 5.0, None), (4.0, 3.0, float("nan")), (5.0, 4.0, 1.0), (6.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.variable_a, r.variable_b): r.correlation for r in pearson_matrix(df, ["a", "b", "c"]).collect()}
    db = duckdb.connect()
    db.execute("CREATE TABLE t (a DOUBLE, b DOUBLE, c DOUBLE)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(a, b, None if c is None or math.isnan(c) else c) for a, b, c in rows])
    for x, y in got:
        assert got[x, y] == pytest.approx(db.execute(f"SELECT corr({x}, {y}) FROM t").fetchone()[0])
    assert variance_inflation(df, ["a", "b"]).count() == 2


def test_pearson_of_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {(r.variable_a, r.variable_b): r.correlation for r in pearson_matrix(df, ["a", "b"]).collect()}
    assert got["a", "a"] == 1.0 and got["a", "b"] is None


def test_orders_without_customer_nation_or_region_stay(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("orders", [(1, 1, "2000-01-01", "2-HIGH", 5.0), (2, 9, "2000-01-02", "5-LOW", 6.0), (3, None, "2000-01-03", "5-LOW", 7.0), (4, 2, "2000-01-04", "5-LOW", 8.0)],
          "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string, o_totalprice double")
    write("customer", [(1, 0, "A", 10.0), (2, 77, "B", 10.0)], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double")
    write("nation", [(0, "N", 5)], "n_nationkey int, n_name string, n_regionkey int")
    write("region", [(0, "R")], "r_regionkey int, r_name string")
    write("lineitem", [(1, 1, 2.0)], "l_orderkey long, l_partkey long, l_quantity double")
    rows = {r.order_id: r for r in order_history(spark, str(tmp_path)).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1].sales_region == "N" and rows[1].country is None
    assert rows[2].customer_type is None and rows[4].customer_type == "B"
    assert customer_attributes(spark, str(tmp_path)).count() == 2


def test_rounds_to_keep():
    assert rounds_to_keep([5, 4, 3, 3.5, 3.6], 10) == 3
    assert rounds_to_keep([5, 6, 6, 1], 2) == 1
    assert rounds_to_keep([5, 6, 6, 1], 10) == 4


@pytest.mark.parametrize("levels", [63, 64, 65])
def test_the_number_of_levels_changes_nothing(spark, levels):
    """A category is split by sets of levels whether it shares the arrays of the numbers or not."""
    rows = spark.range(levels * 20).select(
        "id", (F.col("id") % levels).cast("string").alias("c"), (F.col("id") % levels % 2).cast("int").alias("target"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") / levels).cast("int")).alias("day"),
    )
    settings = BoostSettings(trees=1, depth=1, min_rows=5, row_share=1.1, l1=0.0)
    model = fit_boosted(rows, "target", "day", ["id"], settings)
    assert model.features.categories == ["c_code"] and model.features.narrow == (levels < settings.bins)
    assert model.transform(rows).where("prediction != target").isEmpty()


def test_no_variable_in_range_is_an_error():
    with pytest.raises(ValueError):
        WoeEncoder(["a"], [], None, {"a": 0.0}).selected()
