"""Whitening of embeddings by a block Jacobi-Davidson method.

Vectors are read as long integers x = floor(64 c) + 1000000, so that counts, sums and
deviations are exact. The covariance is never built: every product of it with a block of
directions is one distributed pass in which each task centres its vectors, projects them and
adds up. On the driver lie only blocks of as many columns as there are components, and the
subspace of at most `width` columns.

Each round does a Rayleigh-Ritz step in the subspace, locks leading pairs whose residuals
are at rounding level (number of dimensions times machine epsilon times the largest
eigenvalue), and widens the subspace by the others' corrections: the equation
(1 - QQ')(V - e)(1 - QQ') t = -r, with Q the locked and the current vectors, is solved
roughly by a few MINRES steps, all columns in the same passes. At the end the residuals are
taken anew from a fresh pass.

Rows whose vector is null or holds null, NaN or infinite entries are left out; the rest must
have one length, else ValueError. Components without variance beyond rounding are not given,
so equal vectors, or none, give no rows. Repeated rows count as often as they occur; of
equal eigenvalues any basis is right, and all rows use the same. OverflowError is raised
where an exact figure would not fit a long.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import bounded_rows, shared_stage

SCALE, SHIFT = 64, 1_000_000
MOST_DIMENSIONS = 1 << 16
EPS = float(np.finfo(np.float64).eps)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    c = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).where(F.col("c").isNotNull())
    whole = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(whole).select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, d)


def _added(rows: DataFrame, part: Callable[[Iterator[np.ndarray]], np.ndarray], d: int, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all tasks of the matrix that `part` makes of a task's vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = part(_matrix(b, d) for b in batches if b.num_rows)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], ["cell", "v"])

    out = np.zeros(shape[0] * shape[1])
    found = rows.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(shape)


class Moments:
    """Exact count, sums and extremes of every dimension."""

    def __init__(self, rows: DataFrame):
        sizes = [r[0] for r in bounded_rows(rows.select(F.size("x")).distinct().limit(2), 2)]
        if len(sizes) > 1:
            raise ValueError("vectors of different lengths")
        self.d = sizes[0] if sizes else 0
        if self.d > MOST_DIMENSIONS:
            raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
        self.n, d = 0, self.d
        if not d:
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, d)
                if not len(x):
                    continue
                if max(-int(x.min()), int(x.max())) >= 1 << 62 - len(x).bit_length():
                    raise OverflowError("entries too large for exact sums")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(d, dtype=np.int32)), pa.array(x.sum(0)), pa.array(x.min(0)), pa.array(x.max(0)), pa.array(np.full(d, len(x)))],
                    ["i", "s", "low", "high", "n"])

        found = rows.select("x").mapInArrow(run, "i int, s long, low long, high long, n long").groupBy("i").agg(
            F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        found = found.orderBy("i").toArrow().to_pydict()
        self.n = found["n"][0]
        self.sums = np.array(found["s"], np.int64)
        far = max(max(self.n * h - s, s - self.n * l) for s, l, h in zip(found["s"], found["low"], found["high"]))
        high = max(abs(v) for v in found["low"] + found["high"]) * self.n
        if max(d * far * far, high) >= 1 << 63:
            raise OverflowError("deviations do not fit a long")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the numerator is exact."""
        return (self.n * x - self.sums) / float(self.n)


def covariance_product(rows: DataFrame, moments: Moments) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance times a block of directions, as a distributed pass."""
    sc = rows.sparkSession.sparkContext

    def product(block: np.ndarray) -> np.ndarray:
        sent = sc.broadcast((moments.n, moments.sums, block))

        def part(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
            n, sums, q = sent.value
            total = None
            for x in matrices:
                y = (n * x - sums) / float(n)
                add = y.T @ (y @ q)
                total = add if total is None else total + add
            return total

        return _added(rows, part, moments.d, block.shape) / moments.n

    return product


def _orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what `block` adds to `basis`."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * max(s.max(initial=0.0), 1e-300)]
    return block[:, :max(0, len(basis) - basis.shape[1])]


def minres(operator: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """A few MINRES steps for every column at once; one call of `operator` a step serves all."""
    beta = np.linalg.norm(right, axis=0)
    solid = lambda v: np.where(v > 0, v, 1.0)
    v_old, v = np.zeros_like(right), right / solid(beta)
    w_old, w, x = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta, c_old, c = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    s_old, s, b = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    live = beta > 0
    for _ in range(steps):
        u = operator(v)
        alpha = np.sum(v * u, axis=0)
        u = u - alpha * v - b * v_old
        b_next = np.linalg.norm(u, axis=0)
        # The two rotations before act on the new column of the tridiagonal matrix, a third one clears it.
        r3, middle = s_old * b, c_old * b
        r2, diagonal = c * middle + s * alpha, c * alpha - s * middle
        r1 = np.hypot(diagonal, b_next)
        live = live & (r1 > 1e-14 * beta.max(initial=1.0))
        c_old, s_old, c, s = c, s, diagonal / solid(r1), b_next / solid(r1)
        w_old, w = w, (v - r3 * w_old - r2 * w) / solid(r1)
        x = x + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        v_old, v, b = v, u / solid(b_next), b_next
        live = live & (b_next > 0)
        if not live.any():
            break
    return x


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = 32, steps: int = 4,
               width: int | None = None, rounds: int = 100, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and unit eigenvectors of the symmetric operator behind `product`."""
    wanted = min(wanted, d)
    width = min(d, width or 4 * wanted + 16)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, wanted + 8))))[0]
    image = product(basis)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    scale, best, stuck = 0.0, np.inf, 0
    for _ in range(rounds):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        take = min(wanted - locked.shape[1], len(theta))
        scale = max(scale, float(np.abs(theta).max(initial=0.0)))
        residual = image[:, :take] - basis[:, :take] * theta[:take]
        size = np.linalg.norm(residual, axis=0)
        full = locked.shape[1] + basis.shape[1] >= d
        stuck = stuck + 1 if size.max(initial=0.0) > 0.5 * best else 0
        best = min(best, size.max(initial=0.0))
        good = size <= max(d, 16) * EPS * scale
        if full or stuck > 8 and best <= 1e-11 * scale:  # nothing is left to add, or rounding lies above the goal
            good[:] = True
        k = int(np.argmin(np.append(good, False)))
        locked, values = np.hstack([locked, basis[:, :k]]), np.append(values, theta[:k])
        basis, image, residual, theta = basis[:, k:], image[:, k:], residual[:, k:take], theta[k:]
        if locked.shape[1] >= wanted:
            break
        if k:
            best, stuck = np.inf, 0
        if basis.shape[1] + residual.shape[1] > width:
            keep = max(residual.shape[1], width // 2)
            basis, image = basis[:, :keep], image[:, :keep]
        fixed = np.hstack([locked, basis[:, :residual.shape[1]]])
        free = lambda t: t - fixed @ (fixed.T @ t)
        shift = theta[:residual.shape[1]]
        more = minres(lambda t: free(product(t) - t * shift), -free(residual), steps)
        more = _orthogonal(more, np.hstack([locked, basis]))
        if not more.shape[1]:
            more = _orthogonal(np.random.default_rng(seed + 1).normal(size=(d, 8)), np.hstack([locked, basis]))
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    else:
        raise ArithmeticError("residuals did not reach rounding level")
    order = np.argsort(-values, kind="stable")
    locked, values = locked[:, order], values[order]
    check = np.linalg.norm(product(locked) - locked * values, axis=0).max(initial=0.0)
    if check > 1e-10 * scale:
        raise ArithmeticError(f"residual {check:g} of {scale:g}")
    signs = np.sign(locked[np.abs(locked).argmax(0), np.arange(locked.shape[1])])
    return values, locked * np.where(signs == 0, 1.0, signs)


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = shared_stage(usable(vectors))
    moments = Moments(rows)
    d, n = moments.d, moments.n
    if not n or not d:
        return spark.createDataFrame([], ddl)
    values, axes = eigenpairs(covariance_product(rows, moments), d, components)
    spread = spark.sparkContext.broadcast((n, moments.sums))

    def squares(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in matrices:
            count, sums = spread.value
            add = (((count * x - sums) / float(count)) ** 2).sum(0)[None]
            total = add if total is None else total + add
        return total

    trace = float(_added(rows, squares, d, (1, d)).sum()) / n
    kept = values > max(d, 16) * EPS * max(trace, 0.0)
    values, axes = values[kept], axes[:, kept] / np.sqrt(values[kept])
    k = len(values)
    if not k:
        return spark.createDataFrame([], ddl)
    model = spark.sparkContext.broadcast((n, moments.sums, axes))

    def mean_part(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in matrices:
            count, sums, q = model.value
            add = (((count * x - sums) / float(count)) @ q).sum(0)[None]
            total = add if total is None else total + add
        return total

    centre = spark.sparkContext.broadcast(_added(rows, mean_part, d, (1, k)) / n)

    def square_part(matrices: Iterator[np.ndarray]) -> np.ndarray | None:
        total = None
        for x in matrices:
            count, sums, q = model.value
            z = ((count * x - sums) / float(count)) @ q - centre.value
            add = z.T @ z
            total = add if total is None else total + add
        return total

    error = float(np.abs(_added(rows, square_part, d, (k, k)) / n - np.eye(k)).max())
    explained = values / trace

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, q = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                off = count * _matrix(part, d) - sums
                z = (off / float(count)) @ q
                m = len(z)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, count)), pa.array(np.repeat((off * off).sum(1), k)), pa.array(z.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(give, ddl)
