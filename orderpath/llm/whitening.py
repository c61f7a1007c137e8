"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

With X the centred rows, X V = U B for an upper bidiagonal B. Step j takes v, the next right
vector. A left vector is kept as the combination w with u = X w, so rows hold no state and a lost
task is only read again. The expected part of X v along earlier left vectors is known from their
products X'u and leaves w before the pass; the pass over the rows then forms U and the new u,
and returns U'u, X'u and u'u: what is left along U is taken out (full reorthogonalisation), and
alpha, X'u and the next v, reorthogonalised against all right vectors, follow. The singular
value decomposition of the small B gives components and deviations.

Rows are integers x = floor(64 c) + OFFSET. They are centred exactly, as (n x - S) / n in whole
numbers, and written once in blocks that every pass reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderpath.llm.common import stage_table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 4096
# A direction is null below this share of the largest deviation; a step ends below the other.
RANK_TOLERANCE, BREAKDOWN = 1e-9, 1e-12
RESIDUAL = 1e-13
SEED = 20240229
BLOCK = "ids binary, known binary, rows long, width int, x binary"


def usable(vector: Column) -> Column:
    """The vector is there, not empty, and all its entries are finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(64 c) of equally long vectors as long rows."""
    entries = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    scaled = np.floor(SCALE * entries)
    if np.abs(scaled).max(initial=0) >= 2.0**62:
        raise ValueError("an entry does not fit a long")
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors of different lengths")
    return scaled.astype(np.int64).reshape(len(vectors), -1)


def smallest_type(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if x.size == 0 or (np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def to_blocks(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The usable rows as blocks of floor(64 c), written once. OFFSET drops out in centring."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                x = smallest_type(quantised(part.column(1)))
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                row = [ids.tobytes()], [known.tobytes()], [len(x)], [x.dtype.itemsize], [x.tobytes()]
                kinds = pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["ids", "known", "rows", "width", "x"])

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    return stage_table(rows.mapInArrow(work, BLOCK), "vectors")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, width = batch.column("rows")[i].as_py(), batch.column("width")[i].as_py()
            x = np.frombuffer(batch.column("x")[i].as_buffer(), dtype=f"<i{width}").astype(np.int64).reshape(n, -1)
            yield batch, i, x


def summed(blocks: DataFrame, measure) -> list[np.ndarray]:
    """Element-wise sums over all blocks of the arrays that ``measure(x)`` returns, floats or whole numbers.

    A task adds its own; one number per element and task is shuffled, never a row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, x in rows_of(batches):
            parts = [np.atleast_1d(p) for p in measure(x)]
            total = parts if total is None else [a + b for a, b in zip(total, parts)]
        for k, part in enumerate(total or []):
            whole = part.dtype.kind == "i"
            size = len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k] * size, pa.int32()),
                    pa.array(range(size), pa.int32()),
                    pa.array(part if whole else [None] * size, pa.int64()),
                    pa.array([None] * size if whole else part, pa.float64()),
                ],
                ["part", "place", "whole", "real"],
            )

    partial = blocks.mapInArrow(work, "part int, place int, whole long, real double")
    rows = partial.groupBy("part", "place").agg(F.sum("whole").alias("whole"), F.sum("real").alias("real")).collect()
    parts: dict[int, dict[int, float]] = {}
    for row in rows:
        parts.setdefault(row["part"], {})[row["place"]] = row["whole"] if row["whole"] is not None else row["real"]
    return [np.array([parts[k][i] for i in range(len(parts[k]))]) for k in sorted(parts)]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n x - S) / n: whole numbers up to the division."""
    if float(np.abs(x).max(initial=0)) * n >= 2.0**62:
        raise ValueError("an entry times the number of rows does not fit a long")
    return (n * x - sums) / n


def spread(blocks: DataFrame, n: int, sums: np.ndarray) -> float:
    """trace(V): the mean squared distance from the mean."""
    return float(summed(blocks, lambda x: [np.square(centred(x, n, sums)).sum()])[0][0]) / n


def bidiagonalise(blocks: DataFrame, n: int, sums: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (columns) and singular values of the centred rows, falling.

    It ends when the space is used up, or when the residuals of the wanted components are
    small. Where a right vector has no rest, the next one is any direction not yet used, so
    equal deviations and null directions are found too.
    """
    d = len(sums)
    draw = np.random.default_rng(SEED)

    def direction(v: np.ndarray, against: np.ndarray) -> tuple[np.ndarray, float]:
        for _ in range(2):
            v = v - against @ (against.T @ v)
        return v, float(np.linalg.norm(v))

    right = np.zeros((d, 0))
    combos, images = np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas = [], []
    v = draw.normal(size=d)
    v /= np.linalg.norm(v)
    scale = 0.0
    while True:
        w = v - combos @ (images.T @ v)
        basis = np.column_stack([combos, w])

        def measure(x: np.ndarray) -> list[np.ndarray]:
            rows = centred(x, n, sums)
            left = rows @ basis
            u = left[:, -1]
            return [left.T @ u, rows.T @ u]

        along, image = summed(blocks, measure)
        inside, square = along[:-1], along[-1]
        rest = square - inside @ inside
        alpha = float(np.sqrt(max(rest, 0.0)))
        scale = max(scale, alpha)
        if alpha > BREAKDOWN * scale:
            w = (w - combos @ inside) / alpha
            image = (image - images @ inside) / alpha
        else:
            alpha, w, image = 0.0, np.zeros(d), np.zeros(d)
        right, combos, images = np.column_stack([right, v]), np.column_stack([combos, w]), np.column_stack([images, image])
        alphas.append(alpha)
        v, beta = direction(image - alpha * v, right)
        scale = max(scale, beta)
        done = len(alphas) == d
        small = np.diag(alphas) + np.diag(betas, 1)
        p, sigma, qt = np.linalg.svd(small)
        if not done and len(alphas) > wanted and beta > BREAKDOWN * scale:
            done = bool((beta * np.abs(p[-1, :wanted]) <= RESIDUAL * sigma[0]).all())
        if done:
            return right @ qt.T, sigma
        if beta <= BREAKDOWN * scale:
            beta, v = 0.0, direction(draw.normal(size=d), right)[0]
        v = direction(v / np.linalg.norm(v), right)[0]
        v /= np.linalg.norm(v)
        betas.append(beta)


def fit(blocks: DataFrame, wanted: int = COMPONENTS) -> dict | None:
    """``n``, ``sums`` (of floor(64 c)), ``components`` (columns), ``deviations`` (roots of the eigenvalues), ``trace``, ``identity_error``.

    Directions without spread are left out, so there may be fewer components than wanted.
    None for no rows.
    """
    counted = summed(blocks, lambda x: [np.array([len(x)]), x.sum(axis=0), np.array([x.shape[1] * len(x)])])
    if not counted:
        return None
    n, sums = int(counted[0][0]), counted[1]
    if counted[2][0] != n * len(sums):
        raise ValueError("vectors of different lengths")
    trace = spread(blocks, n, sums)
    wanted = min(wanted, len(sums))
    if trace > 0:
        vectors, sigma = bidiagonalise(blocks, n, sums, wanted)
        keep = np.flatnonzero(sigma[:wanted] > RANK_TOLERANCE * sigma[0])
    else:
        vectors, sigma, keep = np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0, dtype=int)
    fitted = {"n": n, "sums": sums, "components": vectors[:, keep], "deviations": sigma[keep] / np.sqrt(n), "trace": trace}
    return {**fitted, "identity_error": identity_error(blocks, fitted)}


def projected(x: np.ndarray, fitted: dict) -> np.ndarray:
    return centred(x, fitted["n"], fitted["sums"]) @ fitted["components"] / fitted["deviations"]


def identity_error(blocks: DataFrame, fitted: dict) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(fitted["deviations"])
    if not k:
        return 0.0

    def measure(x: np.ndarray) -> list[np.ndarray]:
        z = projected(x, fitted)
        return [z.sum(axis=0), (z.T @ z).ravel()]

    total, square = summed(blocks, measure)
    mean = total / fitted["n"]
    return float(np.abs(square.reshape(k, k) / fitted["n"] - np.outer(mean, mean) - np.eye(k)).max())


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Per row, the sum of (n x - S) ** 2 in whole numbers of any size."""
    far = n * x - sums
    if np.square(far.astype(np.float64)).sum() < 2.0**62:
        return (far * far).sum(axis=1).tolist()
    return [sum(int(e) * int(e) for e in row) for row in far]


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row and component: ``vec_id``, ``component`` (from 1, by falling deviation),
    ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Null vectors, empty ones and those with null or non-finite entries give no rows and are not
    fitted; null ids and repeated rows are rows like others. Directions without spread have no
    component: equal rows alone give no rows. Of equal deviations, any basis is a result. Vectors of
    different lengths and numbers that do not fit a long raise an error. Extra columns are not
    read. An empty table gives no rows.
    """
    blocks = to_blocks(vectors, key, vector)
    fitted = fit(blocks, wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(fitted["deviations"])
        explained = fitted["deviations"] ** 2 / fitted["trace"] if k else np.zeros(0)
        for batch, i, x in rows_of(batches):
            if not k:
                continue
            rows = len(x)
            ids = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype="<i8")
            known = np.frombuffer(batch.column("known")[i].as_buffer(), dtype=bool)
            far = np.repeat(np.array(exact_deviation(x, fitted["n"], fitted["sums"]), dtype=np.int64), k)
            columns = [
                pa.array(np.repeat(ids, k), mask=~np.repeat(known, k)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, fitted["n"], dtype=np.int64)),
                pa.array(far),
                pa.array(projected(x, fitted).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, fitted["identity_error"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WHITENED.split(", ")])

    if fitted is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    return blocks.mapInArrow(work, WHITENED)
