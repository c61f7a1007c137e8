import pytest
from pyspark.sql import functions as F

from orderpath.modeling import metrics as M
from orderpath.modeling.boosting import WEIGHTED, BoostSettings, fit_boosted
from orderpath.plans import catalog
from orderpath.modeling.features import balanced, category_indexer, validation_slice
from orderpath.modeling.scorecard import WoeEncoder, fit_woe_logistic
from test_statistics import planted  # noqa: F401

QUICK = BoostSettings(trees=5, step=0.3, depth=3, min_rows=20)


def test_boosted_binary_finds_the_signal(planted):  # noqa: F811
    train = planted.drop("copy")
    model = fit_boosted(train, "target", "day", ["id"], QUICK)
    scored = model.transform(train)
    assert M.auc(scored, "target", "score_1").first().auc > 0.9
    assert scored.where("score_1 < 0 OR score_1 > 1").count() == 0
    assert scored.count() == train.count()
    ranked = model.importance(train, 3).collect()
    assert ranked[0].feature in ("signal", "level") and len(ranked) == 3
    again = fit_boosted(train, "target", "day", ["id"], QUICK).transform(train)
    same = scored.select("id", F.col("score_1").alias("a")).join(again.select("id", "score_1"), "id")
    assert same.where(F.abs(F.col("a") - F.col("score_1")) > 1e-12).count() == 0


def test_boosted_multiclass(planted):  # noqa: F811
    three = planted.withColumn("target", F.floor(F.col("signal") * 2.999).cast("int")).drop("copy")
    model = fit_boosted(three, "target", "day", ["id"], QUICK)
    scored = model.transform(three)
    assert scored.where(F.abs(F.col("score_0") + F.col("score_1") + F.col("score_2") - 1) > 1e-9).count() == 0
    areas = M.auc_one_vs_rest(scored, "target", model.score_columns())
    assert M.average_auc(areas).first().auc_macro > 0.9
    assert {r[0] for r in scored.select("prediction").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize(
    "query",
    [catalog.q_boosted_binary, catalog.q_importance, catalog.q_boosted_classes, catalog.q_boosted_customer_classes],
)
def test_registered_queries_have_the_default_budget(monkeypatch, query):
    class Asked(Exception):
        pass

    def ask(*args, **_):
        raise Asked(args[4].trees)

    class Any:
        def __getattr__(self, name):
            return lambda *_, **__: self

    monkeypatch.setattr(catalog, "fit_boosted", ask)
    monkeypatch.setattr(catalog, "stage_table", lambda df, name: Any())
    monkeypatch.setattr(catalog, "_customer_periods", lambda df: df)
    monkeypatch.setattr(catalog.X, "customer_transition_matrix", lambda *_, **__: Any())
    with pytest.raises(Asked, match=str(WEIGHTED.trees)):
        query(Any())


def test_one_class_is_refused(planted):  # noqa: F811
    with pytest.raises(ValueError, match="1 class"):
        fit_boosted(planted.where("target = 1"), "target", "day", ["id"], QUICK)


def test_woe_logistic(planted):  # noqa: F811
    model = fit_woe_logistic(planted, ["signal", "noise", "level"], "target", ["id"], iterations=50)
    assert set(model.variables) >= {"signal"} and "noise" not in model.variables
    assert M.auc(model.transform(planted, ["id"]), "target", "score").first().auc > 0.9


def test_woe_of_unseen_and_missing(spark):
    train = spark.createDataFrame(
        [(i, float(i), "a" if i < 5 else "b", int(i in (1, 2, 3, 7, 8))) for i in range(10)], "id int, x double, c string, y int"
    )
    encoder = WoeEncoder.fit(train, ["x", "c"], "y", bins=2)
    out = encoder.transform(
        spark.createDataFrame([(1, -5.0, "a"), (2, 99.0, "zzz"), (3, None, None)], "id int, x double, c string"), ["id"]
    )
    rows = {r.id: r for r in out.collect()}
    assert rows[1].x_woe < 0 < rows[2].x_woe and rows[1].c_woe < 0
    assert rows[2].c_woe == 0.0 and rows[3].x_woe == 0.0 and rows[3].c_woe == 0.0


def test_one_indexer_for_train_and_test(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    test = spark.createDataFrame([("c",), ("z",)], "v string")
    codes = [r.v_code for r in category_indexer(train, ["v"]).transform(test).collect()]
    assert codes == [2.0, 3.0]


def test_balanced_and_validation(planted):  # noqa: F811
    totals = balanced(planted, "target").groupBy("target").agg(F.sum("weight").alias("w")).collect()
    assert abs(totals[0].w - totals[1].w) < 1e-6
    marked = validation_slice(planted, "day")
    held = marked.where("is_validation")
    assert 0 < held.count() < 0.3 * marked.count()
    assert held.agg(F.min("day")).first()[0] > marked.where("NOT is_validation").agg(F.max("day")).first()[0]
