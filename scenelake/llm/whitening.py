"""Whitening of embeddings by shifted Cholesky QR.

Vectors become whole numbers (`WhiteningParameters.scale`, `offset`), each different one once in the list the fit is
made on. Sums are exact. Rows are centred by them before anything is multiplied.

A pass over the list adds up the Gram matrix of the rows, each task its part. Its Cholesky factor orthogonalises the
rows: every later pass brings them there by triangular solves with all factors so far, and finds what is missing.
The first factor, and any that would fail, is of the matrix with a small multiple of the identity added, so that
dependent and constant dimensions do no harm. The product of the factors is the R of the rows; its singular value
decomposition gives components and variances without ever squaring their condition.

What a task sends on is one matrix of the number of dimensions, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import table
from scenelake.session import cut_lineage


@dataclass(frozen=True)
class WhiteningParameters:
    """A component c becomes floor(scale * c) + offset. `components`: most that are returned. `passes`: most Gram
    passes; `orthogonal`: largest entry of the Gram matrix less the identity at which they end. `merge`: tasks that
    add up the parts of all others. `least_share`: share of the total variance below which a component has none."""

    scale: int = 64
    offset: int = 1_000_000
    components: int = 16
    passes: int = 6
    orthogonal: float = 1e-12
    merge: int = 8
    least_share: float = 1e-18


@dataclass(frozen=True)
class Whitening:
    """A fit: `n` vectors with exact `sums` by dimension, unit `axes` by rows, their `variances`, and the trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    def kept(self, p: WhiteningParameters) -> np.ndarray:
        return self.variances > p.least_share * self.trace


def whole_vectors(vector: Column, p: WhiteningParameters) -> Column:
    """Whole numbers of a vector; null where it is null or empty, or holds a null, a value that isn't finite, or one
    whose whole number passes 64 bits."""
    values = F.transform(vector, lambda c: F.floor(c.cast("double") * p.scale))
    limit = float(1 << 62)
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * p.scale) < limit, F.lit(False)))
    return F.when((F.size(vector) > 0) & fits, F.transform(values, lambda v: v.cast("long") + F.lit(p.offset)))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column in which all lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _exact_sums(x: np.ndarray) -> list[int]:
    """Sums by dimension; halves of numbers are summed apart, so nothing overflows."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(v) for h, v in zip(high, low)]


def _scaled(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where they hold it, else as numbers of any size."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if n * largest < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _scaled(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums over dimensions of (n * x - sums)^2, exactly; none where a sum passes 64 bits."""
    d = _scaled(x, n, sums)
    if d.dtype != object:
        if x.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        d = d.astype(object)
    return [v if v < 1 << 63 else None for v in map(int, (d * d).sum(axis=1))]


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """`rows` times the inverse of an upper triangular matrix, by substitution."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _shift(gram: np.ndarray, n: int) -> float:
    """What makes the Cholesky factor of a Gram matrix of n rows exist in spite of rounding."""
    d = len(gram)
    return 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * float(np.trace(gram))


def factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper triangular R with R'R the Gram matrix, shifted if it is the first or has no factor otherwise."""
    if not first:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    # Many rows would make the bound larger than the matrix.
    shift = min(_shift(gram, n), 1e-6 * float(np.trace(gram)))
    return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T


def _added(parts: DataFrame, p: WhiteningParameters) -> np.ndarray | None:
    """The sum of the matrices in a column of bytes, first within `merge` tasks."""

    def add(batches):
        total = None
        for batch in batches:
            for data in batch.column(0):
                part = np.frombuffer(data.as_py(), np.float64)
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    rows = parts.repartition(p.merge).mapInArrow(add, "part binary").collect()
    matrices = [np.frombuffer(bytes(r[0]), np.float64) for r in rows]
    return sum(matrices) if matrices else None


def _gram(vectors: DataFrame, width: int, transform, p: WhiteningParameters) -> np.ndarray:
    """Gram matrix of `transform(rows)`, whose rows have `width` columns."""

    def part(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                rows = transform(_matrix(batch.column(0)))
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    total = _added(vectors.select("x").mapInArrow(part, "part binary"), p)
    return np.zeros((width, width)) if total is None else total.reshape(width, width)


def _count_and_sums(vectors: DataFrame) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums by dimension."""

    def part(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                own = _exact_sums(_matrix(batch.column(0)))
                n, total = n + batch.num_rows, own if total is None else [a + b for a, b in zip(total, own)]
        if n:
            # As text: sums may pass 64 bits.
            columns = [[n] * len(total), list(range(len(total))), list(map(str, total))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string()))], names=["n", "at", "s"]
            )

    parts = vectors.select("x").mapInArrow(part, "n bigint, at int, s string")
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return (sums[0]["n"], tuple(int(r["s"]) for r in sorted(sums, key=lambda r: r["at"]))) if sums else (0, ())


def fit_whitening(vectors: DataFrame, p: WhiteningParameters = WhiteningParameters()) -> Whitening:
    """The fit over (x), different vectors of whole numbers, all of one length. Without any it is empty."""
    n, sums = _count_and_sums(vectors)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    d = len(sums)
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        rows = centred(x, n, sums)
        for upper in factors:
            rows = solved(rows, upper)
        return rows

    trace = 0.0
    for _ in range(p.passes):
        gram = _gram(vectors, d, orthogonal, p)
        if not factors:
            trace = float(np.trace(gram)) / n
            if not trace:
                break
        elif np.abs(gram - np.eye(d)).max() <= p.orthogonal:
            break
        factors.append(factor(gram, n, not factors))
    if not factors:
        return Whitening(n, sums, np.eye(d), np.zeros(d), 0.0)
    r = np.eye(d)
    for upper in factors:
        r = upper @ r
    _, singular, axes = np.linalg.svd(r)
    return Whitening(n, sums, axes, singular**2 / n, trace)


def identity_error(vectors: DataFrame, fit: Whitening, p: WhiteningParameters = WhiteningParameters()) -> float | None:
    """Largest entry of the covariance of the whitened vectors less the identity, over components with a variance;
    none without such a component."""
    some = int(fit.kept(p)[: p.components].sum())
    if not some:
        return None
    to = (fit.axes[:some] / np.sqrt(fit.variances[:some])[:, None]).T

    # A column of ones beside them gives their sums in the same pass.
    def rows_of(x):
        return np.column_stack([centred(x, fit.n, fit.sums) @ to, np.ones(len(x))])

    gram = _gram(vectors, some + 1, rows_of, p)
    means = gram[:-1, -1] / fit.n
    return float(np.abs(gram[:-1, :-1] / fit.n - np.outer(means, means) - np.eye(some)).max())


def prepared(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", p: WhiteningParameters = WhiteningParameters()
) -> tuple[DataFrame, DataFrame]:
    """(k, x) of all rows that take part, and (x), each different vector once."""
    whole = df.select(df[key].alias("k"), whole_vectors(df[vector], p).alias("x")).where("x is not null")
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    rows = whole.where(F.size("x") == (lengths[0]["d"] if lengths else 0))
    return rows, cut_lineage(rows.select("x").distinct())


def whiten(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", p: WhiteningParameters = WhiteningParameters()
) -> DataFrame:
    """A row for each vector that takes part and each component: key, `component` (from 1, by falling variance), `n`,
    `deviation`, `whitened`, `explained` and `identity_error`.

    No part take vectors that are null or empty, hold a null or a value that isn't finite, or one so large that its
    whole number passes 64 bits; and, since rows of other lengths have no common space, those that are not of the
    most frequent length (of two as frequent, the longer). Null keys stay; repeated rows are each returned, and count
    once in the fit. With fewer dimensions than components there are as many components as dimensions. A component
    without variance (constant or dependent dimensions, a single vector) has a null `whitened` and explains 0; if
    there is no variance at all, `explained` and `identity_error` are null. A deviation past 64 bits is null. An
    empty table gives an empty result. Only the two named columns are read.
    """
    rows, different = prepared(df, key, vector, p)
    fit = fit_whitening(different, p)
    error = identity_error(different, fit, p)
    some = min(p.components, len(fit.sums))
    kept = fit.kept(p)[:some]
    spread = np.sqrt(np.where(kept, fit.variances[:some], 1.0))
    to = (fit.axes[:some] / spread[:, None]).T
    explained = [float(v) / fit.trace if fit.trace else None for v in np.where(kept, fit.variances[:some], 0.0)]
    kind = dict(rows.dtypes)["k"]

    def out(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column("x"))
            values = (centred(x, fit.n, fit.sums) @ to).ravel()
            each = pa.array(np.repeat(np.arange(m), some))
            dead = np.tile(~kept, m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k").take(each), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * some, fit.n, np.int64)),
                    pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(each),
                    pa.array(values, pa.float64(), mask=dead), pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * some), pa.float64()),
                ],
                names=["k", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"k {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(out, schema).withColumnRenamed("k", key)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
