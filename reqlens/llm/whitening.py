"""Embedding whitening by a block Jacobi-Davidson method.

The covariance V of the integer vectors x = floor(64 c) + 1000000 is never formed:
a pass over the rows gives ``V W = sum((x - S/n) ((x - S/n)' W)) / n`` for a block
W of columns, from blocks of rows that are multiplied in the tasks and added up by a
grouped sum. ``n x - S`` is an exact integer, so rows are centred before anything
is rounded. Only blocks of (components x columns) numbers reach the driver.

A search space Q, orthogonal to the locked eigenvectors X, gives Ritz pairs
(Rayleigh-Ritz on Q' V Q). Leading pairs whose residual is at rounding level are
locked. For the others, all at once, the correction equation
``(I - U U')(V - theta I)(I - U U') t = -r``, where U holds X and the Ritz vectors, is solved
by a few MINRES steps, each one pass for all columns; the corrections widen Q,
which is cut back to its best Ritz vectors when it gets large. At the end the
residuals are computed anew from a pass over the data.

Defined results: rows whose vector is null or holds a null or non-finite entry
are dropped; null ids and repeated rows each keep their rows; other columns are
ignored. Components whose eigenvalue is zero up to rounding (fewer rows than
dimensions, constant or repeated rows) can't be scaled to unit variance and are
left out; so one row, equal rows and an empty table give none. A deviation
that no long can hold is null. Vectors of several lengths, or with entries beyond
2**40, are refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.llm.vector_codes import finite, matrix

EPS = np.finfo(np.float64).eps
#: a residual of this many roundings of the largest eigenvalue counts as converged
ROUNDINGS = 64
BLOCK = 4096
SCALE, SHIFT = 64.0, 1_000_000


def integers(batch: pa.RecordBatch, dim: int) -> Iterator[np.ndarray]:
    """Blocks of a batch's vectors as integers."""
    values = matrix(batch.column("v"), dim)
    for i in range(0, len(values), BLOCK):
        yield (np.floor(SCALE * values[i:i + BLOCK]) + SHIFT).astype(np.int64)


class Rows:
    """The usable vectors, their number, sums and products with V."""

    def __init__(self, vectors: DataFrame, vec_id: str, vector: str) -> None:
        self.rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(finite("v"))
        n, shortest, dim, top = self.rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")),
                                              F.max(F.array_max(F.transform("v", F.abs)))).first()
        self.n, self.dim = n, dim or 0
        if n and shortest != dim:
            raise ValueError(f"vectors of {shortest} to {dim} components")
        if n * ((top or 0.0) * SCALE + SHIFT + 1) >= 2.0 ** 62 or (top or 0.0) > 2.0 ** 40:
            raise ValueError("entries too large for 64-bit sums")
        self.sums = np.zeros(self.dim, np.int64)
        if n and self.dim:
            self.sums = self.summed(lambda x: x.sum(axis=0)[:, None], 1, "bigint")[:, 0]

    def summed(self, part: Callable[[np.ndarray], np.ndarray], columns: int, kind: str = "double", height: int | None = None) -> np.ndarray:
        """The sum of ``part(x)`` over blocks x of rows: added up in the tasks, then
        by a grouped sum that gives one row for each of ``height``."""
        dim, height = self.dim, self.dim if height is None else height

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x in integers(batch, dim):
                    y = part(x)
                    total = y if total is None else total + y
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), pa.array(list(total))], ["i", "s"])

        found = self.rows.select("v").mapInArrow(run, f"i int, s array<{kind}>").groupBy("i") \
            .agg(F.array(*[F.sum(F.col("s")[j]) for j in range(columns)]).alias("s")).collect()
        out = np.zeros((height, columns), np.int64 if kind == "bigint" else np.float64)
        for r in found:
            out[r.i] = r.s
        return out

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        n, sums = self.n, self.sums
        return lambda x: (n * x - sums) / n

    def times(self, w: np.ndarray) -> np.ndarray:
        """V w, by one pass over the rows."""
        centre, n = self.centred(), self.n

        def part(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return c.T @ (c @ w) / n
        return self.summed(part, w.shape[1])

    def trace(self) -> float:
        centre, n = self.centred(), self.n
        return float(self.summed(lambda x: np.array([[(centre(x) ** 2).sum() / n]]), 1, height=1)[0, 0])


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns that span what ``new`` adds to the bases."""
    for _ in range(2):
        for b in bases:
            new = new - b @ (b.T @ new)
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 0] / norms[norms > 0]
    q, r = np.linalg.qr(new)
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    for b in bases:
        q = q - b @ (b.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """MINRES for a block of right sides with an operator of their own each, in
    lockstep: one call of ``apply`` a step."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v_old, v = np.zeros_like(b), b / first
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    k = b.shape[1]
    c_old, c, s_old, s = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    eta, b_now = beta.copy(), np.zeros(k)
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - b_now * v_old
        b_next = np.linalg.norm(p, axis=0)
        delta, rho2, rho3 = c * alpha - c_old * s * b_now, s * alpha + c_old * c * b_now, s_old * b_now
        rho1 = np.hypot(delta, b_next)
        live = (rho1 > EPS * first) & (eta != 0)
        rho = np.where(live, rho1, 1.0)
        c_old, c, s_old, s = c, np.where(live, delta / rho, 1.0), s, np.where(live, b_next / rho, 0.0)
        w_old, w = w, np.where(live, (v - rho3 * w_old - rho2 * w) / rho, 0.0)
        x = x + c * eta * w * live
        eta = np.where(live, -s * eta, 0.0)
        v_old, v, b_now = v, p / np.where(b_next > 0, b_next, 1.0), b_next
        if (np.abs(eta) <= tolerance * first).all():
            break
    return x


def leading_eigenpairs(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, inner: int = 6, most: int | None = None,
                       rounds: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns, residual norms) of the largest
    ``wanted`` eigenvalues of the symmetric operator ``times``."""
    wanted = min(wanted, dim)
    most = min(dim, most or 3 * wanted)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, wanted)))[0]
    aq = times(q)
    x, ax = np.zeros((dim, 0)), np.zeros((dim, 0))
    best, stalled = np.inf, 0
    for turn in range(rounds):
        h = q.T @ aq
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        left = wanted - x.shape[1]
        u, au = q @ y[:, :left], aq @ y[:, :left]
        res = au - u * theta[:left]
        if x.shape[1]:
            res = res - x @ (x.T @ res)
        norms = np.linalg.norm(res, axis=0)
        top = max(theta[0] if len(theta) else 0.0, np.linalg.norm(ax, axis=0).max(initial=0.0))
        done = norms <= ROUNDINGS * EPS * top
        stalled = 0 if norms.max() < best / 2 else stalled + 1
        best = min(best, norms.max())
        if stalled >= 3 and norms.max() <= 1e-11 * top:
            done[:] = True  # rounding of very long sums
        lock = int(np.argmin(done)) if not done.all() else len(done)
        if lock:
            x, ax = np.hstack([x, u[:, :lock]]), np.hstack([ax, au[:, :lock]])
            q, aq = q @ y[:, lock:], aq @ y[:, lock:]
            if x.shape[1] == wanted:
                break
            u, res, theta, norms, done = u[:, lock:], res[:, lock:], theta[lock:], norms[lock:], done[lock:]
        else:
            q, aq = q @ y, aq @ y
        frame = np.hstack([x, u])
        todo = np.flatnonzero(~done)

        def project(t: np.ndarray) -> np.ndarray:
            return t - frame @ (frame.T @ t)

        def apply(t: np.ndarray) -> np.ndarray:
            t = project(t)
            return project(times(t) - t * theta[todo])

        t = project(minres(apply, project(-res[:, todo]), inner, 0.5 ** (turn + 1)))
        keep = max(u.shape[1], most - x.shape[1] - len(todo))
        q, aq = q[:, :keep], aq[:, :keep]
        new = _orthonormal(t, x, q)
        if new.shape[1] == 0:  # nothing left to add: a random direction, if there is any
            new = _orthonormal(np.random.default_rng(seed + turn + 1).standard_normal((dim, 1)), x, q)
        if new.shape[1]:
            q, aq = np.hstack([q, new]), np.hstack([aq, times(new)])
        else:
            aq = times(q)
    else:
        raise RuntimeError("the eigenvectors have not converged")
    x = np.linalg.qr(x)[0]
    ax = times(x)
    theta, y = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
    theta, y = theta[::-1], y[:, ::-1]
    x, ax = x @ y, ax @ y
    return theta, x, np.linalg.norm(ax - x * theta, axis=0)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of
    every usable row and component."""
    data = Rows(vectors, vec_id, vector)
    n, sums = data.n, data.sums
    values, basis, trace = np.zeros(0), np.zeros((data.dim, 0)), 1.0
    if n > 1 and data.dim and (t := data.trace()) > 0:
        trace = t
        values, basis, _ = leading_eigenpairs(data.times, data.dim, components)
        real = values > data.dim * ROUNDINGS * EPS * values[0]
        values, basis = values[real], basis[:, real]
        basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    k = len(values)
    scaled, centre, dim = basis / np.sqrt(values), data.centred(), data.dim
    error = 0.0
    if k:
        def moments(x: np.ndarray) -> np.ndarray:
            z = centre(x) @ scaled
            return np.vstack([z.T @ z, z.sum(axis=0)]) / n
        m = data.summed(moments, k, height=k + 1)
        error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())
    explained = values / trace

    def deviations(x: np.ndarray) -> pa.Array:
        d = n * x - sums
        if d.size == 0 or float(np.abs(d).max()) ** 2 * d.shape[1] < 2.0 ** 62:
            return pa.array((d * d).sum(axis=1), pa.int64())
        exact = (sum(v * v for v in row) for row in d.tolist())
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in integers(batch, dim):
                row = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(x)).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(row), n, np.int64)), deviations(x).take(pa.array(row)), pa.array((centre(x) @ scaled).ravel()),
                     pa.array(np.tile(explained, len(x))), pa.array(np.full(len(row), error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += len(x)

    kind = dict(data.rows.dtypes)["id"]
    return data.rows.mapInArrow(project, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
                                         "explained double, identity_error double")
