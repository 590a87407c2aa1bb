"""Operator 13: embedding whitening by matrix-free block subspace iteration.

A vector's entries c become whole numbers x = floor(64 * c) + 1000000.  The fit list,
every distinct x vector once, is written to the shared folder; its size n and the sums S
of each dimension are exact whole numbers, so a centred entry (n * x - S) / n is computed
in whole numbers and rounded once, however far the mean is from zero.

The covariance V of the fit list is never built.  Each pass over the list computes
Y = V Q = X'(X Q) / n of the centred rows for a block Q of orthonormal columns, one
partial sum of d x p numbers a task, added up by cell in Spark.  The small rest is done
on the driver: Rayleigh-Ritz (the eigenvectors of Q'Y turn Q and Y), and QR of Y for the
next block.  The work ends when a pass over Ritz vectors finds every one of the first k
residuals |V q - e q| at most ``TOLERANCE`` of the largest eigenvalue: that pass is the certificate, and gives
the eigenvalues and the identity error of what is returned.  Where eigenvalues lie close
together the residuals fall slowly; if, at the rate of the last pass, more than
``PATIENCE`` passes would be needed, the block is doubled by new directions, up to the
dimension, where one Rayleigh-Ritz step is exact.

Rows whose vector is null, or holds null or non-finite entries, are left out; so are
those of another length than the most frequent one (ties: the longer), empty vectors
always.  Vectors and ids may repeat: each row is returned, vectors count once in the fit.
Components whose eigenvalue is zero to double precision (fewer distinct vectors than
dimensions, constant dimensions) cannot be whitened and are left out; equal eigenvalues
keep one basis, the same for all rows.  A null vec_id stays.  Other columns, whatever
their names, take no part.  A table without a usable row, or with one distinct vector,
gives no rows.  Entries beyond 2^56 / 64 are an error: they have no exact whole number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .forced_bpe import release
from .storage import materialise

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Columns of the first block beyond the components asked for.
SPARE = 8
TOLERANCE = 1e-13
#: Passes that the slowest component may still need before the block grows.
PATIENCE = 6
MAX_PASSES = 400
#: Rows centred and multiplied at once.
ROWS = 4096


def usable(vector: Column) -> Column:
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


def whole(vector: Column) -> Column:
    """x of a vector: whole numbers."""
    most = F.lit(float(1 << 50))
    checked = lambda c: F.when(F.abs(c) <= most, c).otherwise(F.raise_error(F.lit("an embedding entry is too large to be a whole number")).cast("double"))
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * checked(c.cast("double"))).cast("long") + F.lit(SHIFT))


def usable_rows(rows: DataFrame) -> DataFrame:
    """vec_id, x of the rows that take part."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).filter(usable(F.col("v")))
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return own.filter(F.size("v") == (sizes[0]["d"] if sizes else 0)).select("vec_id", whole(F.col("v")).alias("x"))


@dataclass
class Whitening:
    centre: Centre
    vectors: np.ndarray  # a column for each component
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int
    block: int


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


@dataclass
class Centre:
    """Mean of n vectors whose dimensions sum to n * base + rest, 0 <= rest < n."""

    n: int
    base: np.ndarray
    rest: np.ndarray

    def away(self, x: np.ndarray) -> np.ndarray | None:
        """n * x - S in whole numbers, None where they need more than 64 bits."""
        near = x - self.base
        return self.n * near - self.rest if len(x) == 0 or float(np.abs(near).max()) * self.n < 2.0**62 else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        away = self.away(x)
        return (x - self.base) - self.rest / self.n if away is None else away / self.n


def _centre(fit_list: DataFrame) -> Centre | None:
    """Exact sums of the dimensions: the two halves of every entry are added up apart, a partial sum a task."""

    def run(batches):
        release()
        n, high, low = 0, 0, 0
        for batch in batches:
            x = _matrix(batch.column(0))
            n, high, low = n + len(x), high + (x >> 28).sum(0), low + (x & ((1 << 28) - 1)).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    each = fit_list.select("x").mapInArrow(run, "i long, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()  # a row a dimension
    if not each:
        return None
    sums = [(r.high << 28) + r.low for r in each]
    n = each[0].n
    return Centre(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))


def _product(fit_list: DataFrame, centre: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q over the fit list, and the trace of V: one pass, one partial sum a task, added up cell by cell."""
    d, p = q.shape

    def run(batches):
        release()
        total, trace = np.zeros((d, p)), 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                c = centre.centred(x[at : at + ROWS])
                total += c.T @ (c @ q)
                trace += float((c * c).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * p + 1)), pa.array(np.append(total.ravel(), trace))], ["cell", "part"])

    cells = fit_list.select("x").mapInArrow(run, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()  # d x p + 1 numbers
    found = np.zeros(d * p + 1)
    for r in cells:
        found[r.cell] = r.part
    return found[:-1].reshape(d, p) / centre.n, float(found[-1]) / centre.n


def _grown(q: np.ndarray, size: int, rng) -> np.ndarray:
    """Orthonormal columns that span ``q`` and new directions, ``size`` in all."""
    return np.linalg.qr(np.concatenate([q, rng.normal(size=(len(q), size - q.shape[1]))], 1))[0]


def fit(fit_list: DataFrame, components: int = COMPONENTS, block: int | None = None, tolerance: float = TOLERANCE, seed: int = 7) -> Whitening | None:
    """Of a table of distinct x vectors (written: every pass reads it); None where there is nothing to whiten."""
    centre = _centre(fit_list)
    if centre is None or centre.n < 2:
        return None
    d = len(centre.base)
    k = min(components, d)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(d, min(d, block or k + SPARE))))[0]
    last = None  # worst residual of the pass before
    for done in range(1, MAX_PASSES + 1):
        y, trace = _product(fit_list, centre, q)
        t = q.T @ y
        theta = np.diag(t)
        kept = int((theta[:k] > max(trace, 0.0) * d * 1e-14).sum())  # eigenvalues that are not zero to double precision
        size = max(float(np.abs(theta).max(initial=0.0)), 1e-300)
        ordered = bool((np.diff(theta[:k]) <= 1e-12 * size).all()) and float(np.abs(t - np.diag(theta))[:k].max(initial=0.0)) <= tolerance * size
        if ordered and trace > 0 and float(np.linalg.norm(y[:, :k] - q[:, :k] * theta[:k], axis=0).max()) <= tolerance * size * d**0.5:
            if not kept:
                return None
            own = t[:kept, :kept] / np.sqrt(np.outer(theta[:kept], theta[:kept]))
            return Whitening(centre, q[:, :kept], theta[:kept], theta[:kept] / trace, float(np.abs(own - np.eye(kept)).max()), done, q.shape[1])
        if trace <= 0:
            return None
        values, turn = np.linalg.eigh((t + t.T) / 2)
        q, y, values = q @ turn[:, ::-1], y @ turn[:, ::-1], values[::-1]
        worst = float(np.linalg.norm(y[:, :k] - q[:, :k] * values[:k], axis=0).max()) / size
        if worst <= tolerance * d**0.5 or q.shape[1] == d:
            q = np.linalg.qr(q)[0]  # Ritz vectors: the next pass certifies them
            continue
        rate = worst / last if last else 0.5
        last = worst
        need = np.log(tolerance / worst) / np.log(rate) if rate < 1 else np.inf
        q = np.linalg.qr(y)[0]
        if need > PATIENCE and done > 1:
            q, last = _grown(q, min(d, 2 * q.shape[1]), rng), None
    raise RuntimeError("the subspace did not settle")


def deviations(x: np.ndarray, centre: Centre) -> list[int]:
    """Sums over dimensions of (n * x - S)^2, exact whole numbers of any size."""
    away = centre.away(x)
    if away is None:
        n, base, rest = centre.n, centre.base.tolist(), centre.rest.tolist()
        return [sum((n * (v - b) - r) ** 2 for v, b, r in zip(row, base, rest)) for row in x.tolist()]
    if not len(away) or float(np.abs(away).max()) ** 2 * x.shape[1] < 2.0**62:
        return (away * away).sum(1).tolist()
    high, low = away >> 20, away & ((1 << 20) - 1)  # away = high * 2^20 + low
    if float(np.abs(high).max()) ** 2 * x.shape[1] < 2.0**62:
        parts = [((u * v).sum(1)).tolist() for u, v in ((high, high), (high, low), (low, low))]
        return [(a << 40) + (b << 21) + c for a, b, c in zip(*parts)]
    return [sum(v * v for v in row) for row in away.tolist()]


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error of every row that takes part."""
    own = usable_rows(rows)
    fit_list = materialise(own.select("x").distinct(), "whitening-fit")
    found = fit(fit_list, components)
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    if found is None:
        own, centre, turn = own.filter("false"), Centre(1, np.zeros(1, np.int64), np.zeros(1, np.int64)), np.zeros((1, 1))
    else:
        centre, turn = found.centre, found.vectors / np.sqrt(found.values)

    def run(batches):
        from decimal import Decimal

        release()
        for batch in batches:
            x = _matrix(batch.column(1))
            for at in range(0, len(x), ROWS):
                part = x[at : at + ROWS]
                z = centre.centred(part) @ turn
                ends = np.arange(0, z.size + 1, z.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, ROWS), pa.array(list(map(Decimal, deviations(part, centre))), pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()))],
                    ["vec_id", "deviation", "whitened"],
                )

    each = own.select("vec_id", "x").mapInArrow(run, schema).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    shares = F.array(*[F.lit(float(e)) for e in (found.explained if found else [0.0])])
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(found.identity_error if found else 0.0).alias("identity_error"),
    )


def digest(whitened: DataFrame) -> DataFrame:
    """The rows with the deviation as long; one that no long holds is an error, not another number."""
    return whitened.withColumn("deviation", F.col("deviation").cast("long"))
