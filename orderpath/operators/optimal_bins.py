"""Bins of a number with the best information value, from counts of fine equal-frequency bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from orderpath.operators.association import MISSING, numeric_bins

FINE_BINS = 20
# Two values that differ by less are equal; then fewer bins, then earlier cuts.
TIE = 1e-10
# The information value from which on the quality score gains no more.
ENOUGH = 0.4


def segment_values(event: np.ndarray, other: np.ndarray, events: float, others: float) -> tuple[np.ndarray, np.ndarray]:
    """Information value and event rate of every segment [i, j); a segment with an empty cell adds 0."""
    e, o = (np.concatenate([[0], np.cumsum(x)]).astype(float) for x in (event, other))
    e, o = e[None, :] - e[:, None], o[None, :] - o[:, None]
    value = np.zeros(e.shape)
    filled = (e > 0) & (o > 0)
    a, b = o[filled] / others, e[filled] / events
    value[filled] = (a - b) * np.log(a / b)
    rate = np.divide(e, e + o, out=np.zeros(e.shape), where=e + o > 0)
    return value, rate


def optimal_cuts(
    event: Sequence[int], other: Sequence[int], bins: int, monotone: bool = True, events: float | None = None, others: float | None = None
) -> list[int]:
    """Where to cut the fine bins so that at most ``bins`` segments have the largest information value.

    A dynamic programme over (segments left, segment): the value of a cut is the sum over its
    segments. ``monotone`` asks for event rates that only rise or only fall. ``events`` and
    ``others`` are totals that may include rows outside the fine bins.
    """
    n = len(event)
    if n == 0:
        return []
    value, rate = segment_values(np.asarray(event), np.asarray(other), events or sum(event), others or sum(other))
    best_value, best_cuts = -math.inf, []
    found = []
    for direction in (1, -1) if monotone else (0,):
        # tails[i, j]: the best value and cuts of what starts with the segment [i, j).
        tails = {(i, n): (value[i, n], []) for i in range(n)}
        found.append((1, *tails[0, n]))
        for count in range(2, min(bins, n) + 1):
            longer = {}
            for i in range(n):
                for j in range(i + 1, n):
                    top = None
                    for k in range(j + 1, n + 1):
                        if (j, k) in tails and direction * (rate[j, k] - rate[i, j]) >= 0:
                            total = value[i, j] + tails[j, k][0]
                            if top is None or total > top[0] + TIE:
                                top = (total, [j, *tails[j, k][1]])
                    if top is not None:
                        longer[i, j] = top
            tails = longer
            starts = [tails[0, j] for j in range(1, n) if (0, j) in tails]
            found += [(count, total, cuts) for total, cuts in starts]
    for count, total, cuts in sorted(found, key=lambda f: (f[0], f[2])):
        if total > best_value + TIE:
            best_value, best_cuts = total, cuts
    return best_cuts


def quality_score(event: Sequence[int], other: Sequence[int], iv: float) -> float:
    """Between 0 and 1: a useful information value, neighbours that differ, and rows spread over the bins.

    The product of the information value's share of ENOUGH (1 at most), of 1 - p of a
    two-sided test of equal rates for each pair of neighbours, and of 1 - the normalised
    concentration of rows. One bin has quality 0.
    """
    event, n = np.asarray(event, dtype=float), np.asarray(event, dtype=float) + np.asarray(other, dtype=float)
    if len(n) < 2 or not n.all():
        return 0.0
    score = min(1.0, iv / ENOUGH)
    for a, b, m, k in zip(event, event[1:], n, n[1:]):
        rate = (a + b) / (m + k)
        spread = math.sqrt(rate * (1 - rate) * (1 / m + 1 / k))
        score *= 1 - (math.erfc(abs(a / m - b / k) / spread / math.sqrt(2)) if spread > 0 else 1.0)
    share = n / n.sum()
    return float(score * (1 - ((share**2).sum() - 1 / len(n)) / (1 - 1 / len(n))))


def optimal_bins(df: DataFrame, columns: Sequence[str], target: str, bins: int, fine: int = FINE_BINS, monotone: bool = True) -> DataFrame:
    """As ``numeric_bins`` with at most ``bins`` bins of the best information value; NULL has its own bin.

    The rows are counted in ``fine`` bins on Spark; at most ``fine`` + 1 counts a column are cut here.
    """
    counted: dict[str, list] = {}
    for row in numeric_bins(df, columns, target, fine).collect():
        counted.setdefault(row["variable"], []).append(row)
    out = []
    for variable, rows in counted.items():
        known = sorted((r for r in rows if r["bin"] != MISSING), key=lambda r: int(r["bin"]))
        events, others = sum(r["n_event"] for r in rows), sum(r["n_other"] for r in rows)
        cuts = optimal_cuts([r["n_event"] for r in known], [r["n_other"] for r in known], bins, monotone, events, others)
        for k, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(known)])):
            if i < j:
                part = known[i:j]
                out.append((variable, str(k), part[0]["lower"], sum(r["n_event"] for r in part), sum(r["n_other"] for r in part)))
        out += [(variable, MISSING, None, r["n_event"], r["n_other"]) for r in rows if r["bin"] == MISSING]
    return df.sparkSession.createDataFrame(out, "variable string, bin string, lower double, n_event long, n_other long")
