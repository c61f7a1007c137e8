"""Classification metrics as aggregates over scored rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderpath.operators.scan import running_totals


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """n / (number of classes * n of the class): one row per class."""
    every = Window.partitionBy(F.lit(1))  # over one row per class
    counted = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn(
        "weight", F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    )


def confusion(
    scored: DataFrame, label: str, prediction: str, classes: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """(by, actual, predicted, n) with all class pairs present.

    The zero cells are added to the aggregated counts, a few rows per group.
    """
    counted = scored.groupBy(
        *by, F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.lit(0).cast("bigint").alias("n"))
            for a in classes
            for p in classes
        ]
    )
    own = F.array(F.struct("actual", "predicted", "n"))
    return (
        counted.select(*by, F.inline(F.concat(own, cells)))
        .groupBy(*by, "actual", "predicted")
        .agg(F.sum("n").alias("n"))
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def per_class(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class of a confusion matrix."""
    entries = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("actual_n"), F.lit(0).cast("bigint").alias("predicted_n"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).cast("bigint").alias("hit_n")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("actual_n"), F.col("n").alias("predicted_n"), F.lit(0).cast("bigint").alias("hit_n")),
    )
    sums = (
        matrix.select(*by, F.inline(entries))
        .groupBy(*by, "class")
        .agg(F.sum("actual_n").alias("support"), F.sum("predicted_n").alias("_predicted"), F.sum("hit_n").alias("hits"))
    )
    precision, recall = _ratio(F.col("hits"), F.col("_predicted")), _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(2 * precision * recall, precision + recall)
    return sums.select(
        *by,
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "support",
        "hits",
    )


def classification_report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per class, then accuracy, plain mean and support-weighted mean."""
    classes = per_class(matrix, by)
    support = F.col("support")
    overall = classes.groupBy(*by).agg(
        F.sum("support").alias("support"),
        F.sum("hits").alias("_hits"),
        *[F.avg(m).alias(f"_macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.sum(F.col(m) * support).alias(f"_sum_{m}") for m in ("precision", "recall", "f1")],
    )
    accuracy = _ratio(F.col("_hits"), support)
    summary = overall.select(
        *by,
        "support",
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("entry"), *[accuracy.alias(m) for m in ("precision", "recall", "f1")]),
                F.struct(F.lit("macro avg").alias("entry"), *[F.col(f"_macro_{m}").alias(m) for m in ("precision", "recall", "f1")]),
                F.struct(F.lit("weighted avg").alias("entry"), *[_ratio(F.col(f"_sum_{m}"), support).alias(m) for m in ("precision", "recall", "f1")]),
            )
        ),
    )
    columns = [*by, "entry", "precision", "recall", "f1", "support"]
    return (
        classes.withColumn("entry", F.col("class").cast("string")).select(*columns)
        .unionByName(summary.select(*columns))
    )


def balanced_accuracy(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur."""
    seen = per_class(matrix, by).where(F.col("support") > 0)
    return seen.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def auc(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve and Gini per group, ties counted half.

    Rows are combined into distinct scores first; the ranks come from a total sort of
    those, so neither a large group nor a long list of scores meets in one task. The
    area is NULL where only one class occurs.
    """
    hit = F.col(label).cast("int")
    points = scored.groupBy(*by, score).agg(
        F.sum(hit).cast("bigint").alias("_pos"), F.sum(1 - hit).cast("bigint").alias("_neg")
    )
    ranked = running_totals(points, list(by), [score], {"neg": F.col("_neg")})
    sums = ranked.groupBy(*by).agg(
        F.sum("_pos").alias("positives"),
        F.sum("_neg").alias("negatives"),
        F.sum(F.col("_pos") * (F.col("below_neg") + F.col("_neg") / 2)).alias("_area"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    area = F.when(pairs > 0, F.col("_area") / pairs)
    return sums.select(*by, "positives", "negatives", area.alias("auc"), (2 * area - 1).alias("gini"))


def one_vs_rest(scored: DataFrame, label: str, scores: Mapping[int, str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, class, hit, score): one narrow row per class of every scored row."""
    entries = [
        F.struct(
            F.lit(k).alias("class"),
            F.when(F.col(label) == k, 1).otherwise(0).alias("hit"),
            F.col(column).alias("score"),
        )
        for k, column in scores.items()
    ]
    return scored.select(*keep, F.inline(F.array(*entries)))


def auc_one_vs_rest(
    scored: DataFrame, label: str, scores: Mapping[int, str], by: Sequence[str] = ()
) -> DataFrame:
    return auc(one_vs_rest(scored, label, scores, by), "hit", "score", [*by, "class"])


def average_auc(per_class_auc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain and support-weighted mean of the class areas, with their Gini."""
    known = per_class_auc.where(F.col("auc").isNotNull())
    means = known.groupBy(*by).agg(
        F.avg("auc").alias("auc_macro"),
        (F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("auc_weighted"),
    )
    return means.withColumns(
        {"gini_macro": 2 * F.col("auc_macro") - 1, "gini_weighted": 2 * F.col("auc_weighted") - 1}
    )
