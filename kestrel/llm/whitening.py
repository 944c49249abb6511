"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without ever forming it: the only
access to the data is the product of the centred vectors with a thin block, X'X Q, summed
over the blocks of all tasks.  A sweep applies a Chebyshev polynomial of that operator,
which stays small on the unwanted part of the spectrum and grows fast above it; QR makes
the block orthonormal again, and a Rayleigh-Ritz step rotates it to eigenvector estimates.
The result is certified: the residuals of the wanted pairs are tiny, and the last sweep,
which like all others took in fresh random directions, found nothing larger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import by_slices, cut

SCALE = 256
COMPONENTS, GUARD, FRESH, DEGREE = 4, 28, 4, 10
TOLERANCE, LEAST_SHARE = 1e-13, 1e-12
MAX_SWEEPS, LEAST_GAIN = 60, 10.0
BLOCK_BYTES, TASK_BYTES = 2_000_000, 32_000_000
SEED = 3


def integer_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``k, x`` (id and whole-number vector) of the usable rows, and the dimension: the
    longest vector's; shorter ones are filled up with zeros."""
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.select(F.col("vec_id").alias("k"), "embedding").where(F.col("embedding").isNotNull()).where(~odd)
    x = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")).cast("long"))
    size = rows.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if size["low"] != size["high"]:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size["high"]) - F.size("embedding")))
    return rows.select("k", x.alias("x")), size["high"] or 0


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def blocks_of(distinct: DataFrame, d: int) -> DataFrame:
    """The vectors packed into binary blocks of at most about ``BLOCK_BYTES``, so that a
    pass reads matrices instead of rows; checkpointed."""
    step = max(1, BLOCK_BYTES // (8 * d))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                x = _matrix(batch.column(0).slice(at, step), d)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["block"])
    return cut(distinct.mapInArrow(run, "block binary"))


def _each(batches, d: int):
    for batch in batches:
        for block in batch.column(0):
            yield np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d)


def totals(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors, and the exact sum of each dimension."""
    def run(batches):
        n, sums = 0, [0] * d
        for x in _each(batches, d):
            n += len(x)
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            sums = [s + (h << 32) + v for s, h, v in zip(sums, high, low)]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([str(s) for s in [*sums, n]]).cast(kind)],
                                         names=["dim", "s"])
    rows = blocks.mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    by = {r["dim"]: int(r["s"]) for r in rows}
    return by.get(d, 0), [by.get(i, 0) for i in range(d)]


class Covariance:
    """The covariance of the blocks as an operator: ``apply(Q)`` is V Q from one pass.
    ``trace`` is known after the first pass, ``passes`` counts them.  A task reads blocks
    of about ``TASK_BYTES``, as a pass is short, and each core has one at least."""

    def __init__(self, blocks: DataFrame, n: int, sums: list[int]):
        self.n, self.d, cores = n, len(sums), blocks.sparkSession.sparkContext.defaultParallelism
        self.tasks = max(cores, -(-8 * n * self.d // TASK_BYTES))
        self.blocks = blocks.coalesce(self.tasks)
        self.mean = np.array([s / n for s in sums])
        self.trace, self.passes = None, 0

    def apply(self, q: np.ndarray) -> np.ndarray:
        d, m, mean = self.d, q.shape[1], self.mean

        def run(batches):
            out = np.zeros((d + 1, m))
            for x in _each(batches, d):
                x = x - mean
                out[:d] += x.T @ (x @ q)
                out[d, 0] += np.einsum("ij,ij->", x, x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out.ravel())], names=["at", "s"])
        found = (self.blocks.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s"))
                 .coalesce(self.tasks).toArrow())  # (d + 1) x the block's width
        out = np.zeros((d + 1) * m)
        out[found.column("at").to_numpy()] = found.column("s").to_numpy()
        out = out.reshape(d + 1, m)
        self.trace, self.passes = out[d, 0] / self.n, self.passes + 1
        return out[:d] / self.n


def chebyshev_sweep(v: Covariance, q: np.ndarray, low: float, high: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """p(V) q for the Chebyshev polynomial that is small on [low, high] and scaled to 1
    at ``top``, in ``degree`` passes."""
    half, centre = (high - low) / 2, (high + low) / 2
    first = sigma = half / (top - centre)
    before, now = q, (v.apply(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        new = 1 / (2 / first - sigma)
        before, now = now, (v.apply(now) - centre * now) * (2 * new / half) - sigma * new * before
        sigma = new
    return now


@dataclass
class Spectrum:
    values: np.ndarray        # leading eigenvalues, falling
    vectors: np.ndarray       # their unit eigenvectors as columns
    trace: float
    residual: float           # largest residual over the largest eigenvalue
    passes: int


def _ritz(v: Covariance, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = np.linalg.qr(block)[0]
    vq = v.apply(q)
    values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def leading_pairs(v: Covariance, wanted: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE,
                  seed: int = SEED) -> Spectrum:
    """The ``wanted`` leading eigenpairs.

    Each sweep starts from the block found so far, with ``FRESH`` of its last columns new
    random directions, so that nothing can stay hidden.  A sweep that does not shrink the
    residual ``LEAST_GAIN``-fold (eigenvalues close together at the block's edge) doubles the
    block; a block as wide as the space is exact after one Rayleigh-Ritz step.  Residuals
    stop falling at rounding level; that is accepted from 100 x ``tolerance``.
    """
    rng, d = np.random.default_rng(seed), v.d
    wanted, width = min(wanted, d), min(d, wanted + guard)
    lead, last, before = slice(0, wanted), np.inf, None
    values, q, vq = _ritz(v, rng.standard_normal((d, width)))
    for _ in range(MAX_SWEEPS):
        top = values[0]
        if top <= 0:
            return Spectrum(values[lead], q[:, lead], v.trace, 0.0, v.passes)
        residual = float(np.linalg.norm(vq[:, lead] - q[:, lead] * values[lead], axis=0).max() / top)
        settled = residual <= tolerance or (residual <= 100 * tolerance and residual > last / 2)
        if width == d or settled and before is not None and np.all(values[lead] <= before + 1e-10 * top):
            return Spectrum(values[lead], q[:, lead], v.trace, residual, v.passes)
        if residual > last / LEAST_GAIN and not settled:
            width = min(d, 2 * width)
        if width == d:
            values, q, vq = _ritz(v, np.eye(d))
            continue
        edge, kept = max(values[-1], 1e-3 * top), max(wanted, q.shape[1] - FRESH)
        before, last = values[lead].copy(), residual
        block = np.linalg.qr(np.hstack([q[:, :kept], rng.standard_normal((d, width - kept))]))[0]
        values, q, vq = _ritz(v, chebyshev_sweep(v, block, 0.0, edge, top * (1 + 1e-9)))
    raise RuntimeError(f"eigenpairs not certified after {v.passes} passes: residual {last:.1e}")


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each
    usable row of ``vectors(vec_id, embedding)`` and component.

    Rows whose vector is null or holds null or non-finite entries are left out.  The
    covariance is that of the distinct whole-number vectors, so copies and repeated rows
    count once; they still get their rows.  Components without variance (fewer distinct
    vectors than components, equal vectors, an empty table) give no rows.  A deviation
    beyond 64 bits is null.  A null vec_id stays; extra columns are left out.
    """
    rows, d = integer_vectors(vectors)
    kind = rows.schema["k"].dataType.simpleString()
    out = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")
    if not d:
        return vectors.sparkSession.createDataFrame([], out)
    blocks = blocks_of(rows.select("x").distinct(), d)
    n, sums = totals(blocks, d)
    v = Covariance(blocks, n, sums)
    found = leading_pairs(v, wanted)
    keep = found.values > LEAST_SHARE * found.trace
    if not keep.any():
        return vectors.sparkSession.createDataFrame([], out)
    axes = found.vectors[:, keep] / np.sqrt(found.values[keep])
    error = float(np.abs(axes.T @ v.apply(axes) - np.eye(axes.shape[1])).max())
    share, mean = found.values[keep] / found.trace, v.mean

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = _matrix(batch.column(1), d)
            y, m = (x - mean) @ axes, axes.shape[1]
            again = np.repeat(np.arange(len(x)), m)
            far = deviations(x, n, sums)
            return pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(again)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(again), n)), pa.array(far, pa.int64()).take(pa.array(again)), pa.array(y.ravel()),
                pa.array(np.tile(share, len(x))), pa.array(np.full(len(again), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        return work
    return rows.mapInArrow(by_slices(make, "x"), out)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the exact sum over dimensions of (n x - sum)^2; None beyond 64 bits."""
    if not len(x):
        return []
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if x.shape[1] * most ** 2 < 2 ** 63:
        return ((n * x - np.array(sums)) ** 2).sum(1).tolist()
    far = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [f if f < 2 ** 63 else None for f in far]
