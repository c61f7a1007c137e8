"""Weight-of-evidence binning and logistic regression on it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderpath.modeling.features import balanced
from orderpath.operators.association import MISSING, category_bins, weigh_bins
from orderpath.operators.joins import lookup_join
from orderpath.operators.optimal_bins import optimal_bins, quality_score
from orderpath.session import stage_table

# Bins per variable, the accepted range of information value, the least quality.
MAX_BINS = 5
IV_RANGE = (0.01, 10.0)
LEAST_QUALITY = 0.0001


@dataclass(frozen=True)
class WoeEncoder:
    """Weight of evidence per bin, learnt on training rows."""

    numeric: list[str]
    categorical: list[str]
    bins: DataFrame
    iv: dict[str, float]
    quality: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, variables: Sequence[str], target: str, bins: int = MAX_BINS) -> WoeEncoder:
        text = {f.name for f in train.schema if isinstance(f.dataType, T.StringType)}
        categorical = [v for v in variables if v in text]
        numeric = [v for v in variables if v not in text]
        parts = [optimal_bins(train, numeric, target, bins)] if numeric else []
        parts += [category_bins(train, categorical, target)] if categorical else []
        table = stage_table(weigh_bins(reduce(DataFrame.unionByName, parts)), "woe")
        iv = {r[0]: r[1] for r in table.groupBy("variable").agg(F.sum("iv")).collect()}
        # Only the few bins of numbers are judged by their neighbours; levels have no order.
        ordered: dict[str, list] = {v: [] for v in numeric}
        for row in table.where(F.col("variable").isin(numeric) & (F.col("bin") != MISSING)).orderBy("lower").collect():
            ordered[row["variable"]].append(row)
        quality = {v: quality_score([r["n_event"] for r in rows], [r["n_other"] for r in rows], iv.get(v, 0.0)) for v, rows in ordered.items()}
        return cls(numeric, categorical, table, iv, quality)

    def useful(self, low: float = IV_RANGE[0], high: float = IV_RANGE[1]) -> list[str]:
        """Variables inside the accepted range; there may be none."""
        within = [v for v in [*self.numeric, *self.categorical] if low <= self.iv[v] <= high]
        return [v for v in within if self.quality.get(v, 1.0) >= LEAST_QUALITY]

    def selected(self, low: float = IV_RANGE[0], high: float = IV_RANGE[1]) -> list[str]:
        """As :meth:`useful`; none at all is an error, not a reason to widen the range."""
        kept = self.useful(low, high)
        if not kept:
            raise ValueError(f"no variable has an information value in [{low}, {high}]: {self.iv}")
        return kept

    def _numeric(self) -> dict[str, Column]:
        """A CASE over the few bin edges; values past the ends fall to the end bins."""
        bins = self.bins.where(F.col("variable").isin(self.numeric)).collect()
        columns = {}
        for variable in self.numeric:
            rows = [r for r in bins if r["variable"] == variable]
            value = F.col(variable).cast("double")
            missing = next((r["woe"] for r in rows if r["bin"] == MISSING), 0.0)
            edges = sorted((r["lower"], r["woe"]) for r in rows if r["bin"] != MISSING)
            result = F.lit(edges[0][1] if edges else missing)
            for lower, woe in edges[1:]:
                result = F.when(value >= F.lit(lower), F.lit(woe)).otherwise(result)
            columns[f"{variable}_woe"] = F.when(value.isNull(), F.lit(missing)).otherwise(result)
        return columns

    def transform(self, df: DataFrame, spread: Sequence[str]) -> DataFrame:
        """Add ``<variable>_woe``; a level not seen in training weighs 0."""
        out = df.withColumns(self._numeric())
        for v in self.categorical:
            table = self.bins.where(F.col("variable") == v).select(
                F.col("bin").alias("_level"), F.col("woe").alias(f"{v}_woe")
            )
            keyed = out.withColumn("_level", F.coalesce(F.col(v), F.lit(MISSING)))
            out = lookup_join(keyed, table, ["_level"], spread=spread, written=True).drop("_level")
            out = out.fillna(0.0, subset=[f"{v}_woe"])
        return out


def _log_odds(beta: np.ndarray, variables: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(b)) * F.col(f"{v}_woe") for b, v in zip(beta[1:], variables)], F.lit(float(beta[0])))


@dataclass(frozen=True)
class WoeLogistic:
    """``beta`` holds the intercept and one coefficient a variable; ``gradient`` is the largest entry left."""

    encoder: WoeEncoder
    variables: list[str]
    beta: np.ndarray
    gradient: float

    def transform(self, df: DataFrame, spread: Sequence[str]) -> DataFrame:
        """Add ``score`` (probability of class 1) and ``prediction``."""
        scored = self.encoder.transform(df, spread).withColumn("score", 1 / (1 + F.exp(-_log_odds(self.beta, self.variables))))
        return scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))


def newton_logistic(cells: DataFrame, variables: Sequence[str], iterations: int, l2: float = 1.0, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Coefficients (intercept first, without a penalty) and the largest gradient entry left.

    ``cells`` holds one row per pattern of ``<variable>_woe``, ``label`` and its total ``weight``. A step
    is one aggregate over it: loss, gradient and Hessian; a step that raises the loss is halved.
    """
    x = [F.lit(1.0), *[F.col(f"{v}_woe") for v in variables]]
    k = len(x)
    ridge = l2 * np.array([0.0] + [1.0] * (k - 1))

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z, y, w = _log_odds(beta, variables), F.col("label"), F.col("weight")
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
        parts = [F.sum(w * loss)] + [F.sum(w * (p - y) * a) for a in x]
        parts += [F.sum(w * p * (1 - p) * x[i] * x[j]) for i in range(k) for j in range(i, k)]
        row = cells.agg(*[part.alias(f"s{i}") for i, part in enumerate(parts)]).first()
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = row[1 + k :]
        hessian = hessian + np.triu(hessian, 1).T + np.diag(ridge)
        return row[0] + 0.5 * float(ridge @ beta**2), np.array(row[1 : 1 + k]) + ridge * beta, hessian

    beta = np.zeros(k)
    loss, gradient, hessian = sums(beta)
    for _ in range(iterations):
        if np.abs(gradient).max() < tolerance:
            break
        step = np.linalg.solve(hessian + 1e-12 * np.eye(k), gradient)
        for _ in range(30):
            following = sums(beta - step)
            if following[0] <= loss + 1e-12 * abs(loss):
                break
            step = step / 2
        beta = beta - step
        loss, gradient, hessian = following
    return beta, float(np.abs(gradient).max())


def fit_woe_logistic(
    train: DataFrame,
    variables: Sequence[str],
    target: str,
    spread: Sequence[str],
    iterations: int = 1000,
    written: bool = False,
) -> WoeLogistic:
    """Class-balanced logistic regression with a unit L2 penalty on the coefficients.

    A few bins a variable leave few patterns: rows are combined to (pattern, class, weight) once,
    and Newton steps run on that table. ``written`` says that the training rows come from a table.
    Where no variable tells the classes apart, the model has its intercept alone.
    """
    train = train.select(*variables, target, *spread)
    train = train if written else stage_table(train, "train")
    encoder = WoeEncoder.fit(train, variables, target)
    kept = encoder.useful()
    coded = encoder.transform(train, spread).select(*[f"{v}_woe" for v in kept], target)
    weighed = balanced(coded, target).withColumnRenamed(target, "label")
    cells = weighed.groupBy(*[f"{v}_woe" for v in kept], "label").agg(F.sum("weight").alias("weight"))
    cells = stage_table(cells, "cells")
    if not kept and len(cells.where("label is not null").select("label").distinct().take(2)) < 2:
        raise ValueError(f"training rows hold fewer than two classes of {target}")
    beta, gradient = newton_logistic(cells, kept, iterations)
    return WoeLogistic(encoder, kept, beta, gradient)
