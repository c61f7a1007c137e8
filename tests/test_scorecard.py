"""Optimal cuts against all cuts, quality, and the grouped logistic fit against dense Newton steps."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderpath.modeling.scorecard import WoeEncoder, fit_woe_logistic
from orderpath.operators import optimal_bins as O
from test_statistics import planted  # noqa: F401

draw = np.random.default_rng(8)


def all_cuts(event, other, bins, monotone):
    """(value, cuts) of the best cut by trying every one."""
    best = (-np.inf, [])
    for k in range(bins):
        for cuts in itertools.combinations(range(1, len(event)), k):
            parts = [(sum(event[i:j]), sum(other[i:j])) for i, j in zip([0, *cuts], [*cuts, len(event)])]
            rates = [e / (e + o) if e + o else 0 for e, o in parts]
            if monotone and rates not in (sorted(rates), sorted(rates, reverse=True)):
                continue
            value = sum((o / sum(other) - e / sum(event)) * np.log((o / sum(other)) / (e / sum(event))) for e, o in parts if e and o)
            if value > best[0] + 1e-10:
                best = (value, list(cuts))
    return best


@pytest.mark.parametrize("monotone", [False, True])
@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_cuts_are_the_best_of_all(n, monotone):
    for trial in range(3):
        event, other = draw.integers(0, 9, size=n) + (trial == 0), draw.integers(1, 30, size=n)
        if not event.sum():
            event[0] = 1
        assert O.optimal_cuts(event.tolist(), other.tolist(), 5, monotone) == all_cuts(event.tolist(), other.tolist(), 5, monotone)[1]


def test_quality_of_bins():
    good = O.quality_score([10, 30, 60], [90, 70, 40], 0.4)
    assert 0.9 < good <= 1 and O.quality_score([10], [90], 0.4) == 0
    assert O.quality_score([30, 30], [70, 70], 0.0) == 0 and O.quality_score([10, 30, 60], [90, 70, 40], 0.1) < good
    assert O.quality_score([1, 30, 60], [9, 1000, 40], 0.4) < good and O.quality_score([0, 0], [5, 5], 0.1) == 0


def test_bins_of_a_table(spark):
    rows = [(float(i % 50), int(i % 50 > 30) if i % 7 else 1 - int(i % 50 > 30)) for i in range(1000)] + [(None, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y int")
    found = sorted(O.optimal_bins(df, ["x"], "y", 5).collect(), key=lambda r: (r["lower"] is None, r["lower"]))
    assert 2 <= len(found) <= 6 and found[-1]["bin"] == "MISSING" and found[-1]["lower"] is None
    assert sum(r["n_event"] + r["n_other"] for r in found) == 1040
    rates = [r["n_event"] / (r["n_event"] + r["n_other"]) for r in found[:-1]]
    assert rates == sorted(rates)
    assert O.optimal_bins(df.limit(0), ["x"], "y", 5).count() == 0


def test_grouped_fit_has_no_gradient(planted):  # noqa: F811
    model = fit_woe_logistic(planted, ["signal", "level", "letter"], "target", ["id"])
    assert model.gradient < 1e-8
    rows = model.encoder.transform(planted, ["id"]).select("target", *[f"{v}_woe" for v in model.variables]).collect()
    y, x = np.array([r[0] for r in rows], float), np.array([[1.0, *r[1:]] for r in rows])
    share = y.mean()
    w = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    p = 1 / (1 + np.exp(-x @ model.beta))
    gradient = x.T @ (w * (p - y)) + np.array([0.0, *model.beta[1:]])
    assert np.abs(gradient).max() < 1e-7
    scored = {r["id"]: r["score"] for r in model.transform(planted, ["id"]).collect()}
    assert sorted(scored.values()) == pytest.approx(sorted(p))


def test_low_quality_is_left_out():
    encoder = WoeEncoder(["a", "b"], [], None, {"a": 0.2, "b": 0.2}, {"a": 0.5, "b": 0.0})
    assert encoder.selected() == ["a"]


def test_no_useful_variable_leaves_the_intercept(spark):
    """A target that no variable tells apart: every row is scored all the same."""
    rows = spark.range(1200).select("id", (F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("c"),
        (F.floor(F.col("id") / 15) % 4 == 0).cast("int").alias("target"))
    model = fit_woe_logistic(rows, ["x", "c"], "target", ["id"])
    assert max(model.encoder.iv.values()) < 0.01 and model.variables == [] and len(model.beta) == 1
    scored = model.transform(rows, ["id"]).collect()
    assert len(scored) == 1200 and {r["prediction"] for r in scored} == {0}
    assert [r["score"] for r in scored] == pytest.approx([0.5] * 1200)
    with pytest.raises(ValueError, match="fewer than two classes"):
        fit_woe_logistic(rows.where("target = 0"), ["x", "c"], "target", ["id"])
