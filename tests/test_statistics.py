"""Ranks, quantiles, association and metrics against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderpath.modeling import metrics as M
from orderpath.operators import association as A
from orderpath.operators import profile as P
from orderpath.operators.scan import exact_quantiles, running_totals


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", rng.choice([rng.random(), 0.5, 2.0])) for i in range(3000)]
    rows += [("one", 4.0), (None, 1.0), (None, 3.0), ("empty", None)]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(6).cache()


def test_running_totals(spark):
    rows = [("a" if i % 4 else "b", i, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, w double")
    out = running_totals(df, ["k"], ["o"], {"w": F.col("w")}).collect()
    for r in out:
        assert r.below_w == sum(w for k, o, w in rows if k == r.k and o < r.o)
        assert r.total_w == sum(w for k, o, w in rows if k == r.k)


def test_exact_quantiles(numbers):
    rows, df = numbers
    out = exact_quantiles(df, ["g"], "x", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()
    groups = {g: [x for h, x in rows if h == g and x is not None] for g, _ in rows}
    assert {r.g for r in out} == {g for g, xs in groups.items() if xs}
    for r in out:
        expected = np.quantile(groups[r.g], [0.25, 0.5, 0.9])
        assert np.allclose([r.q1, r.q2, r.q9], expected, rtol=0, atol=1e-12)


def test_box_statistics(numbers):
    rows, df = numbers
    out = {r.g: r for r in P.box_statistics(df, "g", ["x"]).collect()}
    xs = [x for g, x in rows if g == "hot"]
    q1, q3 = np.quantile(xs, [0.25, 0.75])
    inside = [x for x in xs if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    assert (out["hot"].whisker_low, out["hot"].whisker_high) == (min(inside), max(inside))
    assert (out["hot"].n, out["hot"].outliers) == (len(xs), len(xs) - len(inside))


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 4, None or 4]], "x double")
    out = P.histogram(df, "x", 4).orderBy("bin").collect()
    expected, edges = np.histogram([0, 1, 2, 3, 4, 4, 4], bins=4)
    assert [r.n for r in out] == list(expected)
    assert [r.lower for r in out] == list(edges[:-1])
    flat = P.histogram(spark.createDataFrame([(7.0,)] * 3, "x double"), "x", 2).orderBy("bin").collect()
    assert [r.n for r in flat] == list(np.histogram([7.0] * 3, bins=2)[0])


def test_histogram_of_nothing(spark):
    assert P.histogram(spark.createDataFrame([(None,)], "x double"), "x", 3).count() == 0


def brute_auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(600)] + [("c", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    for r in M.auc(df, "y", "s", ["g"]).collect():
        expected = brute_auc([(y, s) for g, y, s in rows if g == r.g])
        assert (r.auc is None and expected is None) or math.isclose(r.auc, expected)
        assert r.auc is None or math.isclose(r.gini, 2 * expected - 1)
    assert math.isclose(M.auc(df, "y", "s").first().auc, brute_auc([(y, s) for _, y, s in rows]))


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    matrix = M.confusion(df, "y", "p", [0, 1, 2])
    assert matrix.count() == 9
    report = {r.entry: r for r in M.classification_report(matrix).collect()}
    assert report["2"].precision == 0.0 and report["2"].f1 == 0.0 and report["2"].support == 1
    assert math.isclose(report["accuracy"].f1, 0.5)
    assert math.isclose(report["macro avg"].recall, 0.5)
    assert math.isclose(report["weighted avg"].precision, (1 * 2 + (1 / 3) * 1) / 4)
    assert math.isclose(M.balanced_accuracy(matrix).first()[0], 0.5)


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r.y: r.weight for r in M.class_weights(df, "y").collect()} == {0: 8 / 12, 1: 2.0}


@pytest.fixture(scope="module")
def planted(spark):
    """``signal`` decides the target, ``copy`` repeats it, ``noise`` does not matter."""
    u = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return spark.range(2000).select(
        "id",
        u.alias("signal"),
        (u * 3 + 1).alias("copy"),
        (F.pmod(F.xxhash64(F.col("id") + 9999), F.lit(1000)) / 1000.0).alias("noise"),
        F.when(u > 0.6, "hi").otherwise("lo").alias("level"),
        F.when(F.pmod(F.xxhash64(F.col("id") + 77), F.lit(3)) == 0, "p").otherwise("q").alias("letter"),
        F.when(u + F.pmod(F.xxhash64(F.col("id") + 5), F.lit(100)) / 1000.0 > 0.65, 1).otherwise(0).alias("target"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("day"),
    ).cache()


def test_information_value_ranks_the_signal(planted):
    iv = {r.variable: r.iv for r in A.information_value(planted, ["signal", "noise"], ["level", "letter"], "target").collect()}
    assert iv["signal"] > 10 * iv["noise"] and iv["level"] > 10 * iv["letter"]


def test_selection_drops_the_copy(planted):
    kept = [r.variable for r in A.select_numeric(planted, ["copy", "signal", "noise"], "target", iv_min=0.0, corr_max=0.5).collect()]
    assert kept == ["copy", "noise"]
    kept = [r.variable for r in A.select_categorical(planted, ["level", "letter"], "target", iv_min=0.01).collect()]
    assert kept == ["level"]


def test_variance_inflation_of_a_copy(planted):
    vif = {r.variable: r.vif for r in A.variance_inflation(planted, ["signal", "copy", "noise"]).collect()}
    assert vif["signal"] > 1e6 and vif["copy"] > 1e6 and 0.99 < vif["noise"] < 1.1


def test_cramers_v(planted):
    v = {(r.variable_a, r.variable_b): r.cramers_v for r in A.cramers_v(planted, ["level", "letter"]).collect()}
    assert math.isclose(v["level", "level"], 1.0) and v["level", "letter"] < 0.1
