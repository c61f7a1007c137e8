"""Bin edges from bracketing sketches and pairwise co-moments, against plain computations."""

import math

import numpy as np
import pytest

from orderpath.operators.association import _correlations, numeric_bins, pearson_matrix
from orderpath.operators.comoments import Comoments


def bins_by_hand(rows, column, bins):
    known = sorted((r[column] for r in rows if r[column] is not None), key=lambda v: (math.isnan(v), v))
    out = {}
    for r in rows:
        v = r[column]
        if v is None:
            name = "MISSING"
        else:
            below = sum(1 for o in known if (o < v) or (math.isnan(v) and not math.isnan(o)))
            name = str(min(below * bins // len(known), bins - 1))
        low, event, other = out.get(name, (None, 0, 0))
        if v is not None and (low is None or v < low):
            low = v
        out[name] = (low, event + r["y"], other + 1 - r["y"])
    return out


def table():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        rows.append(
            {
                "y": int(rng.integers(0, 2)),
                "wide": float(rng.normal()),
                "tied": float(rng.integers(0, 4)),
                "heavy": 0.0 if i % 3 else float(rng.exponential()),
                "gaps": None if i % 4 == 0 else float(rng.integers(-50, 50)),
                "constant": 7.0,
                "unknown": None,
            }
        )
    return rows


COLUMNS = ["wide", "tied", "heavy", "gaps", "constant", "unknown"]
SCHEMA = "y int, " + ", ".join(f"{c} double" for c in COLUMNS)


# At 2 and 5 the sketches are too rough to bracket an edge, at 1000 they are exact on these rows.
@pytest.mark.parametrize("accuracy", [2, 5, 30, 1000])
@pytest.mark.parametrize("bins", [1, 4, 10])
def test_bins_do_not_depend_on_the_sketch(spark, accuracy, bins):
    rows = table()
    df = spark.createDataFrame([tuple(r[c] for c in ["y", *COLUMNS]) for r in rows], SCHEMA).repartition(5)
    got = {}
    for r in numeric_bins(df, COLUMNS, "y", bins, accuracy).collect():
        got.setdefault(r.variable, {})[r.bin] = (r.lower, r.n_event, r.n_other)
    assert got == {c: bins_by_hand(rows, c, bins) for c in COLUMNS}


def test_bins_of_nan_and_of_an_empty_table(spark):
    rows = [{"y": i % 2, "x": float("nan") if i < 4 else float(i)} for i in range(20)]
    df = spark.createDataFrame([(r["y"], r["x"]) for r in rows], "y int, x double")
    got = {r.bin: (r.n_event, r.n_other) for r in numeric_bins(df, ["x"], "y", 5).collect()}
    assert got == {name: cell[1:] for name, cell in bins_by_hand(rows, "x", 5).items()}
    assert numeric_bins(df.limit(0), ["x"], "y", 5).collect() == []


def gapped(n=400, k=5):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) + 1e6
    x[rng.random((n, k)) < 0.2] = np.nan
    return x


def test_pairs_use_rows_where_both_are_known(spark):
    x = gapped()
    columns = [f"c{i}" for i in range(x.shape[1])]
    rows = [tuple(None if math.isnan(v) else float(v) for v in row) for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(7)
    got = _correlations(df, columns)
    for i in range(len(columns)):
        for j in range(len(columns)):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)


def test_merging_in_any_order_is_the_whole():
    x = gapped()
    whole = Comoments.of_rows(x).correlations()
    for cuts in ([100, 101, 102], [1, 399], [200]):
        parts = np.split(x, cuts)
        total = Comoments.empty(x.shape[1])
        for part in reversed(parts):
            total = total.merge(Comoments.of_rows(part))
        assert np.allclose(total.correlations(), whole, atol=1e-10)
        assert np.array_equal(total.n, Comoments.of_rows(x).n)


def test_constant_lone_and_unknown_columns_have_no_correlation(spark):
    df = spark.createDataFrame(
        [(0.1, 1.0, None, 5.0), (0.1, 2.0, None, None), (0.1, 4.0, None, None)], "a double, b double, c double, d double"
    ).repartition(3)
    got = {(r.variable_a, r.variable_b): r.correlation for r in pearson_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16
    assert {pair for pair, value in got.items() if value is not None} == {("b", "b")}
    assert pearson_matrix(df.limit(0), ["a", "b"]).where("correlation IS NOT NULL").count() == 0


def test_one_read_for_all_pairs(spark, tmp_path):
    columns = [f"c{i}" for i in range(40)]
    x = gapped(200, 40)
    rows = [tuple(None if math.isnan(v) else float(v) for v in row) for row in x]
    spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("comoments", "one read")
    _correlations(df, columns)
    jobs = tracker.getJobIdsForGroup("comoments")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 1 <= len(jobs) <= 2  # the map stage and the collected rest
