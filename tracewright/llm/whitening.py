"""Whitening of embeddings by the leading eigenvectors of their covariance, found by LOBPCG.

The covariance is never formed. Tasks multiply their centred rows with a block of columns, and the products are summed
by dimension; the driver holds dimensions x block numbers only. Each round solves the Rayleigh-Ritz problem on the span
of the iterate, its residuals and the last directions, until the residuals of a product made anew are certified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import stored

#: Columns of the iterate beyond the wanted ones, which hasten the last of these.
GUARD = 8
#: Residuals, as a share of the largest eigenvalue, that are aimed at, and that are accepted where rounding lets them fall no further.
AIM, ACCEPTED, ROUNDS, PATIENCE = 1e-13, 1e-11, 500, 5
#: Eigenvalues below this share of the largest count as zero: their directions hold rounding only.
FLOOR = 1e-11
#: A component whose scaled value reaches this is an error: its square has no place in 64 bits.
LIMIT = 2.0**52


@dataclass
class Whitening:
    """n rows of width integers with these sums; column k of vectors is the unit eigenvector of eigenvalue values[k]."""

    n: int
    width: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float = 0.0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return self.sums.astype(float) / max(self.n, 1)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum of (n * x - S)^2 of each row, exactly; one beyond 64 bits is an error, as in SQL."""
        most = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        if self.width * most * most < 2**63:
            return ((self.n * x - self.sums) ** 2).sum(axis=1)
        if most < 2**63:
            t = self.n * x - self.sums
            if self.width * int(np.abs(t).max(initial=0)) ** 2 < 2**63:
                return (t**2).sum(axis=1)
        t = self.n * x.astype(object) - self.sums.astype(object)
        found = [sum(v * v for v in row) for row in t]
        if any(v >= 2**63 for v in found):
            raise OverflowError("a deviation does not fit 64 bits")
        return np.array(found, np.int64)


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of each component, of the rows whose vector and components are finite."""
    each = F.col(f"`{vector_col}`")
    sane = F.forall(each, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    long = lambda v: F.when(F.abs(scaled(v)) < LIMIT, F.floor(scaled(v)) + F.lit(shift).cast("long")).otherwise(F.raise_error("a component is too large to whiten"))
    return vectors.where(each.isNotNull() & sane).select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(each, long).alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: type) -> np.ndarray:
    """The sum of part(matrix of a batch's rows) over all batches; each task sends one row a row of the result."""
    name = "long" if kind is int else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64 if kind is int else np.float64)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch, width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0]), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64() if kind is int else pa.float64()))], names=["at", "part"])

    parts = rows.select("x").mapInArrow(run, f"at int, part array<{name}>")
    found = np.zeros(shape, np.int64 if kind is int else np.float64)
    for r in parts.groupBy("at").agg(F.array(*(F.sum(F.col("part")[j]) for j in range(shape[1]))).alias("total")).collect():
        found[r["at"]] = r["total"]
    return found


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """block made orthonormal to the columns of against and in itself, without directions that vanish."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(3):
        if block.shape[1]:
            block = block - against @ (against.T @ block)
            size, turn = np.linalg.eigh(block.T @ block)
            keep = size > 1e-8  # the rest would be rounding, enlarged
            block = block @ (turn[:, keep] / np.sqrt(size[keep]))
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The wanted largest eigenvalues, their unit eigenvectors and the largest residual as a share of the first.

    product(block) is the matrix times the block. The residuals are those of a product made for the result itself.
    """
    size = min(width, wanted + GUARD)
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    ax, fresh = product(x), True
    p = np.zeros((width, 0))
    least, waited = np.inf, 0
    for _ in range(ROUNDS):
        g = x.T @ ax
        values, turn = np.linalg.eigh((g + g.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        if values[0] <= 0:  # all rows are equal
            return np.zeros(0), np.zeros((width, 0)), 0.0
        residual = ax - x * values
        norms = np.linalg.norm(residual, axis=0) / values[0]
        worst = norms[:wanted].max()
        least, waited = (worst, 0) if worst < 0.5 * least else (least, waited + 1)
        if worst <= AIM or (worst <= ACCEPTED and waited > PATIENCE) or size == width:
            if fresh:
                if worst > ACCEPTED:
                    raise ArithmeticError(f"residual {worst} of an exact solution")
                return values[:wanted], x[:, :wanted], float(worst)
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            p = np.zeros((width, 0))
            continue
        w = _orthonormal(residual[:, norms > AIM / 10], x)
        new = np.hstack((w, _orthonormal(p, np.hstack((x, w)))))
        basis, a_basis = np.hstack((x, new)), np.hstack((ax, product(new) if new.shape[1] else new))
        g = basis.T @ a_basis
        _, turn = np.linalg.eigh((g + g.T) / 2)
        turn = turn[:, ::-1][:, :size]
        step = turn.copy()
        step[:size] = 0
        x, ax, p = basis @ turn, a_basis @ turn, basis @ step
        upright = np.linalg.inv(np.linalg.cholesky(x.T @ x)).T  # rounding would add up over the rounds
        x, ax, fresh = x @ upright, ax @ upright, False
    raise ArithmeticError("the residuals did not fall to what can be certified")


def fit(rows: DataFrame, components: int = 32) -> Whitening:
    """The whitening of rows, those of integer_rows, whose vectors all have the same length.

    Components are numbered by falling eigenvalue; there are as many as eigenvalues above FLOOR, components at most.
    """
    first = rows.select(F.size("x").alias("width")).head()
    width = first["width"] if first else 0
    if not width:
        return Whitening(0, 0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    counted = _summed(rows, width, lambda x: np.vstack((x.sum(axis=0), np.full(width, len(x)))), (2, width), int)
    n, sums = int(counted[1, 0]), counted[0]
    mean = sums.astype(float) / n

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(rows, width, part, block.shape, float) / n

    trace = float(_summed(rows, width, lambda x: ((x - mean) ** 2).sum(axis=0)[None, :], (1, width), float).sum() / n)
    if not trace > 0:
        return Whitening(n, width, sums, np.zeros(0), np.zeros((width, 0)), 0.0)
    values, vectors, residual = lobpcg(product, width, min(components, width))
    kept = values > FLOOR * values[0] if len(values) else np.zeros(0, bool)
    found = Whitening(n, width, sums, values[kept], vectors[:, kept], trace, residual)
    k = int(kept.sum())
    if k:
        def squares(x: np.ndarray) -> np.ndarray:
            w = found.whitened(x)
            return np.vstack((w.T @ w, w.sum(axis=0)))

        total = _summed(rows, width, squares, (k + 1, k), float) / n
        found.identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    return found


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> tuple[DataFrame, Whitening]:
    """(vec_id, deviation, whitened) of each remaining row, and the whitening.

    Rows whose vector is null or holds null or non-finite components are left out; so are those whose length is not the
    one that most remaining rows have (of equally frequent ones, the longest). Null, repeated and tied ids are ids like
    others, repeated rows count each time. Where all rows are equal, and where there are none, whitened is empty, and it
    is shorter than components where the rows span fewer dimensions. Eigenvectors of equal eigenvalues are any of their
    span. Other columns are not read.
    """
    rows = stored(integer_rows(vectors, id_col, vector_col))
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head()
    if common:
        rows = rows.where(F.size("x") == common["width"])
    found = fit(rows, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, found.width)
            w = found.whitened(x) if found.width else np.zeros((len(x), 0))
            ends = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(found.deviations(x) if found.width else np.zeros(len(x), np.int64), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel(), pa.float64()))], names=["vec_id", "deviation", "whitened"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>"), found


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    rows, found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shares = F.array(*(F.lit(float(v / found.trace)) for v in found.values)) if len(found.values) else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(found.identity_error).alias("identity_error"), F.lit(found.residual).alias("residual"),
    )
