"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

1. Sound vectors become exact numbers x = floor(scale * c) + shift and are written once. A first pass adds up x for the mean; sums of numbers are exact.
2. A block of orthonormal columns Q, the wanted components and some more, is improved in rounds. The covariance V is never built: a pass over all vectors
   gives V Q as the sum of Z'(Z Q) over blocks of rows, Z being centred before it is multiplied. Rayleigh-Ritz on the block gives values and vectors;
   the smallest value bounds the unwanted spectrum from above, zero from below, and the Chebyshev recurrence, a pass for each degree, damps
   what lies between while it raises the rest. QR makes the block orthonormal again. The degree is as high as the spread of the values lets rounding bear.
3. The rounds end with a certificate: every wanted residual |V q - e q| is within rounding of the largest value, or does not shrink any more and is within
   ENOUGH of it. Rounds that run out raise an error.
4. Vectors are projected on the components, over the root of their values; one more pass measures how far the result's covariance is from the identity.

Tasks send a matrix of dimension times block for each partition; these are added up by row of the matrix, in the order of the partitions, so that reruns agree,
and the driver holds one such matrix. Its size follows the dimension, never the number of vectors.

Defined cases: vectors that are null or hold null or non-finite entries are left out, zero vectors stay; shorter vectors, empty ones too, count as padded with
zeros; x is held within 2^40 of the shift; components without variance (beyond rounding) are left out, so a table of equal vectors or of a single one has none; ``deviation``
is null where it exceeds a long; equal rows and ids are treated row by row; all columns but the vector stay, and a result's name that is taken gets an
underscore; an empty table gives an empty table.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import fields, free_name, stored
from tideline.session import ship

LOG = logging.getLogger(__name__)
COMPONENTS, GUARD, SCALE, SHIFT, WIDEST = 32, 16, 64, 1_000_000, 2**40
#: Highest degree of a filter, and how much more than the weakest wanted direction the strongest may be raised in one round.
DEGREE, GROWTH, MOST_ROUNDS, SEED = 12, 1e8, 60, 13
#: A residual within rounding; one that may remain where it shrinks no more, and the share that counts as shrinking; both relative to the largest value.
CERTAIN, ENOUGH, SHRINKS = 2e-15, 1e-11, 0.5
#: A value below this share of the largest is no variance.
NOTHING = 1e-13
NUMBERS = "x_"


@dataclass(frozen=True)
class Whitening:
    """Of the fit: how many vectors, exact sums by dimension, components as columns, their values, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return self.sums / self.n


def exact_numbers(df: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``df`` without ``vector``, with the numbers ``x_`` of each sound one."""
    entry = lambda c: c.cast("double")
    sound = F.col(f"`{vector}`").isNotNull() & F.forall(F.col(f"`{vector}`"), lambda c: F.coalesce(F.abs(entry(c)) < float("inf"), F.lit(False)))  # NaN is above infinity
    held = lambda c: F.greatest(F.least(entry(c) * scale, F.lit(float(WIDEST))), F.lit(-float(WIDEST)))
    numbers = F.transform(F.col(f"`{vector}`"), lambda c: F.floor(held(c)) + F.lit(shift))
    return df.where(sound).select(*[F.col(f"`{c}`") for c in df.columns if c != vector], numbers.alias(free_name(df, NUMBERS)))


def matrix(column: pa.Array, dim: int, shift: int) -> np.ndarray:
    """A list column as rows of ``dim`` whole numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(flat) == len(sizes) * dim and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.full((len(sizes), dim), shift, np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def folded(table: DataFrame, name: str, part: Callable[[np.ndarray], np.ndarray], dim: int, shift: int, whole: bool = False) -> np.ndarray | None:
    """The sum of ``part`` over blocks of rows, a matrix; None without rows. ``whole``: exact numbers."""
    kind, listed = (pa.int64(), "array<long>") if whole else (pa.float64(), "array<double>")

    def add(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                block = part(matrix(batch[name], dim, shift))
                total = block if total is None else total + block
        if total is not None:
            rows = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rows)), pa.array(np.full(rows, TaskContext.get().partitionId())), pa.array(list(total), pa.list_(kind))], names=["row_", "task_", "part_"]
            )

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task_")
        parts = np.stack([x.values.to_numpy() for x in rows["part_"]])
        return pa.table([rows["row_"].slice(0, 1), pa.array([parts.sum(0)], pa.list_(kind))], names=["row_", "part_"])

    # rows of one matrix row: as many as tasks, each as wide as the block
    parts = table.select(f"`{name}`").mapInArrow(add, f"row_ long, task_ long, part_ {listed}")
    rows = parts.groupBy("row_").applyInArrow(meet, f"row_ long, part_ {listed}").collect()  # one matrix
    return np.array([r["part_"] for r in sorted(rows, key=lambda r: r["row_"])]) if rows else None


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and vectors of V within the block, by falling value, and V times the vectors."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, guard: int = GUARD, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` greatest eigenvalues of a positive matrix given by its products, their vectors as columns, and the largest relative residual."""
    wanted = min(wanted, dim)
    width = min(dim, wanted + guard)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))
    vq, before = product(q), math.inf
    for _ in range(MOST_ROUNDS):
        values, q, vq = ritz(q, vq)
        top = values[0]
        if top <= 0:
            return np.zeros(0), np.zeros((dim, 0)), 0.0
        residual = float(np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / top)
        LOG.info("largest residual %.3g of %d wanted components", residual, wanted)
        if residual <= CERTAIN or width == dim or (residual <= ENOUGH and residual > SHRINKS * before):
            return values[:wanted], q[:, :wanted], residual
        before, half = residual, values[-1] / 2
        if half <= NOTHING * top:  # nothing is left to damp: the block holds all that V reaches
            raised = vq
        else:
            one, two = q, (vq - half * q) / half
            rise = math.acosh(max(top / half - 1, 1 + 1e-9))
            for _ in range(min(DEGREE, max(2, int(math.acosh(GROWTH) / rise))) - 1):
                one, two = two, 2 * (product(two) - half * two) / half - one
            raised = two
        q, _ = np.linalg.qr(raised / np.maximum(np.linalg.norm(raised, axis=0), 1e-300))
        vq = product(q)
    raise RuntimeError(f"no certificate within {MOST_ROUNDS} rounds; the last residual was {before:.3g}")


def fit_whitening(table: DataFrame, name: str, components: int = COMPONENTS, guard: int = GUARD, shift: int = SHIFT) -> Whitening | None:
    """The whitening of all rows of a table of exact numbers; None without rows."""
    ship(table.sparkSession)
    dim = table.agg(F.max(F.size(f"`{name}`"))).first()[0]
    if dim is None:
        return None
    if not dim:
        return Whitening(table.count(), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    totals = folded(table, name, lambda x: np.concatenate((x.sum(0), [len(x)]))[None], dim, shift, whole=True)[0]
    sums, n = totals[:-1], int(totals[-1])
    mean, done = sums / n, []

    def product(q: np.ndarray) -> np.ndarray:
        done.append(1)

        def part(x: np.ndarray) -> np.ndarray:
            z = x - mean
            return z.T @ (z @ q)

        return folded(table, name, part, dim, shift) / n

    trace = float(folded(table, name, lambda x: np.square(x - mean).sum(0)[None], dim, shift).sum() / n)
    values, vectors, residual = leading(product, dim, components, guard)
    real = values > NOTHING * max(trace, 1e-300)
    values, vectors = values[real], vectors[:, real]
    if vectors.shape[1]:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])  # one sign for all runs
    LOG.info("%d components of %d dimensions after %d passes, residual %.3g", len(values), dim, len(done), residual)
    return Whitening(n, sums, vectors, values, trace, len(done))


def whitened(fit: Whitening, x: np.ndarray) -> np.ndarray:
    return (x - fit.mean) @ (fit.vectors / np.sqrt(fit.values))


def identity_error(table: DataFrame, name: str, fit: Whitening, shift: int = SHIFT) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    if not len(fit.values):
        return 0.0

    def part(x: np.ndarray) -> np.ndarray:
        w = whitened(fit, x)
        return np.column_stack((w.T @ w, w.sum(0)))

    total = folded(table, name, part, len(fit.sums), shift) / fit.n
    return float(np.abs(total[:, :-1] - np.outer(total[:, -1], total[:, -1]) - np.eye(len(fit.values))).max())


def deviation(fit: Whitening, x: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    rough = np.square(fit.n * (x - fit.mean)).sum(1)
    if (rough < 2.0**62).all() and fit.n * float(np.abs(x).max(initial=0)) < 2.0**62:
        return np.square(fit.n * x - fit.sums).sum(1).tolist()
    exact = [sum((fit.n * a - s) ** 2 for a, s in zip(row, fit.sums.tolist())) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(df: DataFrame, vector: str = "embedding", into: str = "white", components: int = COMPONENTS, guard: int = GUARD) -> DataFrame:
    """The sound rows of ``df`` without ``vector``, with a struct of ``n, deviation, whitened, explained, identity_error``; arrays go by component."""
    result = T.StructType([*fields(("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.ArrayType(T.DoubleType())), ("explained", T.ArrayType(T.DoubleType())), ("identity_error", T.DoubleType()))])
    name, out = free_name(df, NUMBERS), free_name(df, into)
    table = stored(exact_numbers(df, vector))
    kept = [f for f in table.schema if f.name != name]
    schema = T.StructType([*kept, T.StructField(out, result)])
    fit = fit_whitening(table, name, components, guard)
    if fit is None:
        return df.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(table, name, fit), (fit.values / fit.trace).tolist() if len(fit.values) else []

    def apply(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(result)
        for batch in batches:
            rows, dim = batch.num_rows, len(fit.sums)
            x = matrix(batch[name], dim, SHIFT)
            columns = [pa.array(np.full(rows, fit.n)), pa.array(deviation(fit, x), pa.int64()), pa.array(list(whitened(fit, x)), pa.list_(pa.float64())), pa.array([explained] * rows, pa.list_(pa.float64())), pa.array(np.full(rows, error))]
            columns = [c.cast(kind.field(i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*[batch[f.name] for f in kept], pa.StructArray.from_arrays(columns, fields=list(kind))], names=[*[f.name for f in kept], out])

    return table.mapInArrow(apply, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    parts = F.arrays_zip(F.col("white.whitened").alias("whitened"), F.col("white.explained").alias("explained"))
    return found.select("vec_id", "white.n", "white.deviation", "white.identity_error", F.posexplode(parts).alias("at", "part")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"), F.col("part.explained").alias("explained"), "identity_error"
    )
