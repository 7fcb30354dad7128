"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass over the vectors gives ``(V - shift) Q`` for a few columns
``Q``: every task centres its vectors and adds up ``X'(XQ)``, and the sums are added pairwise on
the way. A polynomial of the covariance that is small on the unwanted part of the spectrum and
large above it is applied to the columns by its three-term recurrence, a pass a step; then QR
and Rayleigh-Ritz. Rounds go on until the residuals of the wanted pairs certify them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import fresh, staged

#: Columns iterated beside the wanted ones, steps of the recurrence in a round, rounds at most.
GUARD, DEGREE, ROUNDS = 28, 8, 40
#: Vectors in one stored chunk; partial sums that reach the driver in a pass.
CHUNK, SUMS = 1024, 16
#: A pair is certified if its residual is this part of the largest eigenvalue; at most ``LOOSE`` if rounding stops it before.
TIGHT, LOOSE = 1e-14, 1e-11
#: Components whose eigenvalue is below this part of the trace are numerically zero: they cannot be scaled to variance one.
RANK = 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite entries."""
    real = vector.cast("array<double>")
    bad = F.exists(real, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * c)`` of each entry, as long."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * scale).cast("long"))


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The lists of the first column as rows."""
    for b in batches:
        yield b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)


def _packed(dim: int) -> Callable:
    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _chunks(batches, dim):
            parts = [x[i:i + CHUNK] for i in range(0, len(x), CHUNK)]
            yield pa.RecordBatch.from_pydict({"n": [len(p) for p in parts], "sum": [p.sum(axis=0).tolist() for p in parts],
                                              "x": [p.tobytes() for p in parts]})
    return in_task


@dataclass
class FitList:
    """Distinct vectors in chunks, their number, sums per dimension (exact) and the mean."""

    chunks: DataFrame
    n: int
    sums: list[int]

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(self.dim)

    def add_up(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all chunks of ``part`` of their centred vectors, in a fixed order."""
        mean, dim = self.mean, self.dim

        def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slot = None, 0
            for b in batches:
                for raw, k in zip(b.column(0), b.column(1).to_pylist()):
                    x = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, dim) - mean
                    total = part(x) if total is None else total + part(x)
                    slot = k
            if total is not None:
                yield pa.RecordBatch.from_pydict({"slot": [slot % SUMS], "task": [slot], "total": [total.tobytes()]})

        def add(table: pa.Table) -> pa.Table:
            order = np.argsort(table.column("task").to_numpy())
            totals = [np.frombuffer(table.column("total")[int(i)].as_buffer(), np.float64) for i in order]
            return pa.Table.from_pydict({"slot": table.column("slot")[:1].to_pylist(), "total": [sum(totals).tobytes()]})

        shape = part(np.zeros((0, dim))).shape
        tasks = self.chunks.select("x", F.spark_partition_id().alias("task")).mapInArrow(in_task, "slot long, task long, total binary")
        rows = tasks.groupBy("slot").applyInArrow(add, "slot long, total binary").collect()  # ``SUMS`` rows at most
        out = np.zeros(shape)
        for r in sorted(rows, key=lambda r: r.slot):
            out += np.frombuffer(r.total, np.float64).reshape(shape)
        return out


def fit_list(vectors: DataFrame, dim: int) -> FitList:
    """The distinct vectors of the only column (arrays of long), each once."""
    schema = "n long, sum array<long>, x binary"
    chunks = staged(vectors.distinct().mapInArrow(_packed(dim), schema), "whitening-fit", free_shuffles=True)
    wide = [F.sum(F.col("sum")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    got = chunks.agg(F.sum("n"), *wide).first()
    return FitList(chunks, int(got[0] or 0), [int(s or 0) for s in got[1:]])


@dataclass
class Components:
    """Unit eigenvectors (columns) of the covariance by falling eigenvalue, its trace, and how far whitening is from the identity."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def leading_components(fit: FitList, k: int = 4, guard: int = GUARD, degree: int = DEGREE, seed: int = 11) -> Components:
    """The ``k`` leading components, or as many as the vectors span."""
    dim, passes = fit.dim, 0
    none = Components(np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, 0)
    if not dim or not fit.n:
        return none

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return fit.add_up(lambda x: x.T @ (x @ q)) / fit.n

    trace = float(fit.add_up(lambda x: np.array([np.square(x).sum()]))[0]) / fit.n
    if trace <= 0:
        return none
    k, m = min(k, dim), min(dim, k + guard)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, m)))[0]
    best = np.inf
    for _ in range(ROUNDS):
        values, q, vq = _ritz(q, times(q))
        residual = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max() / values[0]
        if residual <= TIGHT or (residual <= LOOSE and residual > best / 2):
            break
        best = min(best, residual)
        cut = values[-1]
        if cut <= RANK * trace or m == dim:  # the columns hold all of the spectrum: nothing to damp
            q = np.linalg.qr(vq if cut > RANK * trace else np.where(values > RANK * trace, vq, q))[0]
            continue
        # eigenvalues are at least 0, the unwanted ones at most about ``cut``: Chebyshev on [0, cut], scaled by its size at the top
        centre = half = cut / 2
        scale = first = half / (values[0] - centre)
        old, new = q, (vq - centre * q) * (scale / half)
        for _ in range(degree - 1):
            after = 1 / (2 / first - scale)
            old, new = new, (times(new) - centre * new) * (2 * after / half) - old * (scale * after)
            scale = after
        q = np.linalg.qr(new)[0]
    else:
        raise ArithmeticError(f"components not certified after {ROUNDS} rounds: residual {residual:.2e}")
    rank = int((values[:k] > RANK * trace).sum())
    u, e = q[:, :rank], values[:rank]
    if not rank:
        return none
    white = u / np.sqrt(e)
    spread = fit.add_up(lambda x: (x @ white).T @ (x @ white)) / fit.n
    return Components(u, e, trace, float(np.abs(spread - np.eye(rank)).max()), passes)


def _scores(dim: int, n: int, sums: list[int], mean: np.ndarray, white: np.ndarray) -> Callable:
    safe = 2 ** 62 // max(dim, 1)

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
        if most ** 2 < safe:
            return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
        exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
        return [d if d < 2 ** 63 else None for d in exact]

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = next(_chunks([b], dim))
            w = (x - mean) @ white
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(deviations(x), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))],
                [*b.schema.names[1:], "deviation", "whitened"])
    return in_task


def whiten(rows: DataFrame, vector: str = "embedding", k: int = 4, scale: int = 256) -> DataFrame:
    """The columns of ``rows`` but the vector, a row for each component: ``component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null or holds null or non-finite entries are left out; entries become
    ``floor(scale * c)``. The components are those of the distinct vectors (each once).
    ``deviation``: sum over dimensions of ``(n * x - S) ** 2``, exact (null if no long can hold
    it); ``whitened``: the centred vector on the component, over the root of its eigenvalue.

    Vectors shorter than the longest one end in zeros. Components whose eigenvalue is zero
    (fewer independent vectors than ``k``) have no whitened form and no rows; equal vectors, or
    one only, give no rows at all. Repeated rows get equal results. Columns named like a result
    column in any case are replaced.
    """
    new = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    rest = [c for c in rows.columns if c != vector and c.lower() not in new]
    names = fresh(rows, *[f"_{i}" for i in range(len(rest))])
    v = F.col(f"`{vector}`")
    x = rows.filter(usable(v)).select(quantised(v, scale).alias("x"), *[F.col(f"`{c}`").alias(a) for c, a in zip(rest, names)])
    dim = int(x.agg(F.max(F.size("x"))).first()[0] or 0)
    x = x.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))))
    fit = fit_list(x.select("x"), dim)
    c = leading_components(fit, k)
    schema = T.StructType([*[T.StructField(a, rows.schema[r].dataType) for r, a in zip(rest, names)],
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    white = c.vectors / np.sqrt(c.values)
    out = x.mapInArrow(_scores(dim, fit.n, fit.sums, fit.mean, white), schema)
    share = F.lit([float(e / c.trace) for e in c.values] if len(c.values) else []).cast("array<double>")
    return out.select(*[F.col(a).alias(r) for r, a in zip(rest, names)], "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        *[F.col(f"`{r}`") for r in rest], (F.col("_at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(share, F.col("_at")).alias("explained"), F.lit(c.identity_error).alias("identity_error"))
