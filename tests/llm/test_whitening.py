"""Whitening against a dense eigendecomposition, on full, deficient and awkward tables."""

import math

import numpy as np
import pytest

from orderpath.llm import whitening
from orderpath.llm.queries import op11

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, x double"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "clash", 0.5) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def dense(vectors, wanted):
    """Kept rows as whole numbers, whitened rows, shares, deviations of the contract."""
    keep = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([vectors[i] for i in keep], dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    rows = (n * x - total) / n
    cov = rows.T @ rows / n
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    k = int((np.sqrt(np.maximum(values[:wanted], 0)) > 1e-9 * math.sqrt(values[0])).sum()) if values[0] > 0 else 0
    z = rows @ directions[:, :k] / np.sqrt(values[:k]) if k else np.zeros((n, 0))
    return keep, z, values[:k] / max(np.trace(cov), 1e-300), ((n * x - total) ** 2).sum(axis=1)


def check(df, vectors, wanted, tolerance=1e-9):
    keep, z, shares, deviation = dense(vectors, wanted)
    rows = df.collect()
    assert len(rows) == z.size
    got = np.full(z.shape, np.nan)
    where = {vec_id: i for i, vec_id in enumerate(keep)}
    for r in rows:
        i = where[r["vec_id"]]
        got[i, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(keep) and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
    signs = np.sign((got * z).sum(axis=0))
    assert np.abs(got - signs * z).max(initial=0) < tolerance


def test_query_of_the_small_table(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
    by_id = {r["vec_id"]: r["embedding"] for r in rows}
    check(op11(spark, path), [by_id.get(i) for i in range(max(by_id) + 1)], 32)


def test_awkward_vectors(spark):
    draw = np.random.default_rng(5)
    vectors = [list(v) for v in draw.normal(size=(60, 5)) * [9, 5, 3, 2, 1]]
    vectors += [None, [], [1, None, 2, 3, 4], [math.nan, 0, 0, 0, 0], [0, math.inf, 0, 0, 0], [0, 0, 0, 0, -math.inf]]
    vectors += [vectors[0]] * 30
    check(whitening.whiten(table(spark, vectors), 3), vectors, 3)
    check(whitening.whiten(table(spark, vectors), 32), vectors, 32)


def test_fewer_directions_than_dimensions(spark):
    draw = np.random.default_rng(6)
    few = draw.integers(-3, 4, size=(40, 3)).astype(float)
    vectors = [list(v) for v in np.column_stack([few * [4, 2, 1], few[:, 0] * 4, np.ones(40)])]
    check(whitening.whiten(table(spark, vectors)), vectors, 32)


def test_early_end_gives_the_leading_components(spark):
    draw = np.random.default_rng(7)
    vectors = [list(v) for v in draw.normal(size=(300, 40)) * (0.6 ** np.arange(40) * 100 + 0.5)]
    check(whitening.whiten(table(spark, vectors), 2), vectors, 2)


def test_equal_deviations(spark):
    vectors = [[s * 8.0 if i == j else 0.0 for i in range(4)] for j in range(4) for s in (1, -1)]
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert len(rows) == 32 and {round(r["explained"], 12) for r in rows} == {0.25}
    assert max(r["identity_error"] for r in rows) < 1e-9


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 9])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten(table(spark, vectors)).collect() == []


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(df).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in rows) == [(-1, 1), (-1, 2), (3, 1), (3, 1), (3, 2), (3, 2)]


def test_errors_are_named(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.whiten(table(spark, [[1.0], [1.0, 2.0]], 1)).collect()
    with pytest.raises(Exception, match="does not fit"):
        whitening.whiten(table(spark, [[3e38], [1.0]], 1)).collect()


def test_exact_deviation_of_large_numbers():
    x = np.array([[2**40, 0], [0, 1]])
    assert whitening.exact_deviation(x, 2, x.sum(axis=0)) == [2**80 + 1, 2**80 + 1]
