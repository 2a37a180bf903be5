"""Embedding whitening (operator 13): matrix-free block subspace iteration.

Vectors become integers floor(scale * c). The fit list, each distinct vector
once, is written as packed blocks of the smallest integer type. One pass of Spark
over it gives V Q = X'(X Q) / n for a thin block Q, on rows centred first: each
task holds one block of rows and sends one sum of dimensions x block. The driver
holds Q, makes it orthonormal (QR) and takes Ritz values and vectors in its span
(Rayleigh-Ritz). Passes go on until the residual |V q - e q| certifies each of
the components wanted. Where residuals fall so slowly that many passes would
follow (a flat spectrum), the block is widened, at most to all dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.common import materialise, table

SCALE, COMPONENTS = 256, 4
#: Columns of the first block beyond the components wanted, the passes that are waited for before it is doubled, and its widest.
OVERSAMPLE, PATIENCE, WIDEST = 12, 6, 2048
#: A component is certified by a residual below this part of the largest eigenvalue; its eigenvalue counts as 0 below this part of the trace.
CERTIFIED, NOTHING = 1e-12, 1e-13
#: Passes without a residual half as large after which rounding is taken to be the rest of it, if it is below the second number (of the largest eigenvalue).
STALLED, ROUNDING = 50, 1e-8
#: Vectors of one block of the fit list.
BLOCK = 8192
#: Integers beyond this are not exact in double precision.
EXACT = 1 << 53


def integers(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x: the integer vectors of usable rows.

    Rows whose vector is null, empty, holds null or non-finite entries or entries
    of 2^53 and more after scaling take no part; nor do those of another length
    than most have (of equally common lengths the greatest counts).
    """
    c = F.col("_v")
    fine: Column = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) * scale < float(EXACT)))
    d = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v")).where(c.isNotNull() & (F.size(c) > 0) & fine)
    lengths = d.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return d.where(F.size("_v") == (lengths[0].n if lengths else 0)).select("vec_id", F.transform("_v", lambda e: F.floor(e * scale)).alias("x"))


def rows_of(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_list(x: DataFrame) -> DataFrame:
    """kind, data: the distinct vectors as packed blocks of the smallest integer type that holds them."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                m = rows_of(b.column(0))
                for part in np.split(m, range(BLOCK, len(m), BLOCK)):
                    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= part.min() and part.max() <= np.iinfo(k).max)
                    yield pa.RecordBatch.from_arrays([pa.array([np.dtype(kind).str]), pa.array([part.astype(kind).tobytes()], pa.binary())], names=["kind", "data"])

    return x.select("x").distinct().mapInArrow(run, "kind string, data binary")


def summed(blocks: DataFrame, width: int, part) -> np.ndarray:
    """The sum over all blocks of part(matrix), a matrix of `width` columns.

    A task adds up its blocks and sends one row for each row of the sum; these
    are added by their number, in part before they are shuffled.
    """

    def run(batches):
        total = None
        for b in batches:
            for kind, data, d in zip(*(b.column(c).to_pylist() for c in ("kind", "data", "d")), strict=True):
                got = part(np.frombuffer(data, kind).reshape(-1, d))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(width)]], names=["i", *[f"c{j}" for j in range(width)]])

    kind = "bigint" if part is sums else "double"
    out = blocks.mapInArrow(run, ", ".join(["i int", *[f"c{j} {kind}" for j in range(width)]]))
    number = (lambda c: F.sum(F.col(c).cast("decimal(38,0)"))) if part is sums else F.sum
    found = out.groupBy("i").agg(*[number(f"c{j}").alias(f"c{j}") for j in range(width)]).orderBy("i").collect()
    return np.array([r[1:] for r in found], object if part is sums else np.float64)


def sums(m: np.ndarray) -> np.ndarray:
    """The sums of each dimension, and the number of rows."""
    return np.append(m.sum(axis=0, dtype=np.int64), len(m))[:, None]


class Whitening:
    """Mean, eigenvectors and eigenvalues of the fit list; `passes` and `residuals` tell how they were found."""

    def __init__(self, components: int = COMPONENTS, *, scale: int = SCALE, seed: int = 0):
        self.components, self.scale, self.seed = components, scale, seed

    def fit(self, x: DataFrame) -> Whitening:
        """Learns from integer vectors `x`. Without two different vectors there are no components."""
        lengths = x.select(F.size("x")).limit(1).collect()
        self.d = lengths[0][0] if lengths else 0
        self.n, self.sums, self.passes = 0, [], 0
        self.vectors, self.values, self.residuals, self.trace, self.identity_error = np.zeros((self.d, 0)), np.zeros(0), np.zeros(0), 0.0, 0.0
        if not self.d:
            return self
        blocks = materialise(fit_list(x).withColumn("d", F.lit(self.d)))
        *s, n = (int(v) for v in summed(blocks, 1, sums)[:, 0])
        self.n, self.sums = n, s
        mean = np.array([v / n for v in s])
        self.mean = mean

        def power(q: np.ndarray):
            """Of one block of rows: Z'(Z Q), and beside it the sums of squares."""

            def part(m):
                z = m - mean
                return np.column_stack((z.T @ (z @ q), (z * z).sum(axis=0)))

            return part

        k = min(self.components, self.d)
        rng = np.random.default_rng(self.seed)
        q = np.linalg.qr(rng.standard_normal((self.d, min(self.d, k + OVERSAMPLE))))[0]
        last, best, stalled = None, np.inf, 0
        while True:
            got = summed(blocks, q.shape[1] + 1, power(q)) / n
            y, self.trace = got[:, :-1], float(got[:, -1].sum())
            self.passes += 1
            values, u = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
            values, u = values[::-1], u[:, ::-1]
            ritz = q @ u
            residual = np.linalg.norm(y @ u[:, :k] - ritz[:, :k] * values[:k], axis=0)
            self.vectors, self.values, self.residuals = ritz[:, :k], values[:k], residual
            goal = CERTIFIED * max(values[0], 0.0)
            worst = residual.max()
            if worst <= goal or (q.shape[1] == self.d and self.passes > 1 and last is not None and worst >= last / 2):
                break
            best, stalled = (worst, 0) if worst < best / 2 else (best, stalled + 1)
            if stalled >= STALLED:
                if best > ROUNDING * values[0]:
                    raise ArithmeticError(f"residuals stay at {best / values[0]:.1e} of the largest eigenvalue")
                break
            new = y @ u
            rate = min(worst / last, 1.0) if last else 0.5
            slow = last is not None and (rate >= 1.0 or np.log(goal / worst) / np.log(rate) > PATIENCE)
            width = min(q.shape[1] * 2, self.d, max(WIDEST, q.shape[1])) if slow else q.shape[1]
            q = np.linalg.qr(np.column_stack((new, rng.standard_normal((self.d, width - q.shape[1])))))[0]
            last = None if width > got.shape[1] - 1 and width < self.d else worst
        fine = self.values > NOTHING * max(self.trace, 1e-300)
        self.vectors, self.values, self.residuals = self.vectors[:, fine], self.values[fine], self.residuals[fine]
        c = len(self.values)
        if c:
            axes = self.axes()

            def spread(m):
                w = (m - mean) @ axes
                return np.vstack((w.T @ w, w.sum(axis=0)))

            got = summed(blocks, c, spread) / n
            self.identity_error = float(np.abs(got[:c] - np.outer(got[c], got[c]) - np.eye(c)).max())
        return self

    def axes(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def transform(self, x: DataFrame) -> DataFrame:
        """vec_id, component, n, deviation, whitened, explained, identity_error, residual of integer vectors (vec_id, x)."""
        c, mean, axes = len(self.values), getattr(self, "mean", None), self.axes()
        n, s, explained, error, residual = self.n, np.array(self.sums, object), self.values / (self.trace or 1.0), self.identity_error, self.residuals / max(self.values[:1].tolist() + [1e-300])
        id_type = x.schema["vec_id"].dataType.simpleString()
        schema = f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, residual double"
        if not c:
            return x.sparkSession.createDataFrame([], schema)

        def run(batches):
            for b in batches:
                m = rows_of(b.column("x"))
                far = deviations(m, n, s)
                w = ((m - mean) @ axes).ravel() if len(m) else np.zeros(0)
                times = np.repeat(np.arange(len(m)), c)
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id").take(pa.array(times)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(m))), pa.array(np.full(len(times), n, np.int64)),
                    pa.array([far[i] for i in times], pa.int64()), pa.array(w), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(times), error)), pa.array(np.tile(residual, len(m))),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

        return x.select("vec_id", "x").mapInArrow(run, schema)


def deviations(m: np.ndarray, n: int, s: np.ndarray) -> list:
    """Sums over dimensions of (n x - S)^2, exact; null where 64 bits do not hold one."""
    if not len(m):
        return []
    most = max(n * int(np.abs(m).max()) + int(max(abs(v) for v in s)), 1)
    if most * most * m.shape[1] < 1 << 63:
        return ((n * m - s.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * m.astype(object) - s) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual: a row for each usable row and component.

    Rows with an unusable vector (see `integers`) have no result. Repeated
    vectors count once in the fit and each get their rows, as do rows that share
    an id or have none. Components with eigenvalue 0 (fewer different vectors
    than dimensions) are left out, so a table of equal vectors, or an empty one,
    gives an empty table. Extra columns are left alone. A deviation beyond 64
    bits is null.
    """
    x = integers(embeddings, id_col=id_col, vector_col=vector_col, scale=scale)
    return Whitening(components, scale=scale).fit(x).transform(x)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
