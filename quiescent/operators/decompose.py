"""Decompositions of tables of vectors: principal components, sphering and k-means.

Rows are as many as there are; a vector has some hundreds of numbers. What is small is
a matrix of vector length by vector length, or of centres: tasks sum theirs over
Arrow blocks of rows, the sums meet in a row for each cell, and the driver solves the
small problem alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed

#: Longest vector whose matrix of products is made.
MOST_DIMS = 4096


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a batch as rows, and which of its rows are vectors of ``dim`` finite numbers."""
    ok = np.zeros(len(column), bool)
    rows = []
    for k, v in enumerate(column.to_numpy(zero_copy_only=False)):
        if v is not None and len(v) == dim:
            x = np.asarray(v, float)
            if np.isfinite(x).all():
                ok[k] = True
                rows.append(x)
    return (np.stack(rows) if rows else np.zeros((0, dim))), ok


def _dim(df: DataFrame, vec: str) -> int:
    n = df.agg(F.max(F.size(vec))).first()[0]  # type: ignore[index]
    if not n or n < 1:
        raise ValueError("no vectors")
    if n > MOST_DIMS:
        raise ValueError(f"vectors of more than {MOST_DIMS} numbers")
    return int(n)


def _summed(df: DataFrame, vec: str, dim: int, part, size: int, *sent: np.ndarray) -> np.ndarray:  # noqa: ANN001
    """Sum over all rows of ``part(matrix, *sent)``, an array of ``size`` numbers for a batch; a task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            m, _ = _matrix(b[vec], dim)
            if len(m):
                total += part(m, *sent)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "x"])

    out = np.zeros(size)
    # at most ``size`` rows, whatever the table's size
    for r in df.select(vec).mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).toArrow().to_batches():
        out[np.asarray(r["cell"])] = np.asarray(r["x"])
    return out


@dataclass(frozen=True)
class Moments:
    """Number, mean and covariance (over ``n - 1``) of vectors."""

    n: int
    mean: np.ndarray
    cov: np.ndarray


def moments(df: DataFrame, vec: str = "vec") -> Moments:
    """Moments of ``df(vec)`` in two passes: means first, products of what is left after them second, so that large means cost no digits.

    Rows that are null, of another length than the longest, or not finite do not count.
    """
    dim = _dim(df, vec)
    first = _summed(df, vec, dim, lambda m: np.concatenate([[len(m)], m.sum(0)]), dim + 1)
    n, mean = int(first[0]), first[1:] / max(1.0, first[0])
    gram = _summed(df, vec, dim, lambda m, c: ((m - c).T @ (m - c)).ravel(), dim * dim, mean).reshape(dim, dim)
    return Moments(n, mean, gram / max(1, n - 1))


@dataclass(frozen=True)
class Components:
    """``axes`` as columns in falling order of ``variances``, the vectors' ``mean``, and their share of all variance."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def shares(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros(len(self.variances))


def principal_components(df: DataFrame, k: int, vec: str = "vec") -> Components:
    """The first ``k`` principal components. An axis points to where its largest entry is positive, so that reruns agree."""
    m = moments(df, vec)
    values, axes = np.linalg.eigh(m.cov)
    order = np.argsort(-values, kind="stable")[:k]
    axes = axes[:, order]
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Components(m.mean, axes * np.where(sign == 0, 1.0, sign), np.maximum(values[order], 0.0), float(np.maximum(values, 0).sum()))


def sphering(df: DataFrame, vec: str = "vec", twice: bool = True) -> np.ndarray:
    """The symmetric matrix after which vectors have the unit covariance, twice that by default; directions without variance become 0."""
    values, axes = np.linalg.eigh(moments(df, vec).cov)
    good = values > values.max(initial=0.0) * 1e-12
    return (2.0 if twice else 1.0) * (axes[:, good] / np.sqrt(values[good])) @ axes[:, good].T


def projected(df: DataFrame, matrix: np.ndarray, mean: np.ndarray, vec: str = "vec", out: str = "vec") -> DataFrame:
    """``df`` with ``out``, its vectors less ``mean`` times ``matrix``, block by block; null where a row is no vector of that length."""
    kinds, names = dict(df.dtypes), [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ok = _matrix(b[vec], len(mean))
            y = (m - mean) @ matrix
            rows: list[np.ndarray | None] = [None] * len(ok)
            for k, r in zip(np.flatnonzero(ok).tolist(), y, strict=True):
                rows[k] = r
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pa.array(rows, pa.list_(pa.float64()))], [*names, out])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), f"`{out}` array<double>"]))


@dataclass(frozen=True)
class Clusters:
    """Centres, their numbers of rows, the sum of squared distances and the rounds it took."""

    centres: np.ndarray
    sizes: np.ndarray
    error: float
    rounds: int


def _assign(m: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row, of equal ones the first, and the squared distance to it."""
    d = ((m[:, None, :] - centres[None]) ** 2).sum(-1) if m.size * len(centres) <= 1 << 24 else np.stack([((m - c) ** 2).sum(1) for c in centres], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(m)), at]


def kmeans(df: DataFrame, k: int, id_col: str = "id", vec: str = "vec", most_rounds: int = 100, tol: float = 0.0) -> Clusters:
    """Lloyd's algorithm from the ``k`` vectors of the smallest ids, until no centre moves by more than ``tol``.

    A round reads the table once; tasks send sums and counts for each centre. A centre
    that loses all rows stays where it is. With fewer than ``k`` vectors there are as
    many centres. Rows that are no finite vector of the common length do not count.
    """
    dim = _dim(df, vec)
    rows = checkpointed(df.select(id_col, F.col(vec).cast("array<double>").alias(vec)).where(F.col(vec).isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), "vectors")
    start = rows.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(vec)).limit(k).collect()
    centres = np.array([r[vec] for r in start], float).reshape(len(start), dim)

    def part(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        at, d = _assign(m, c)
        sums = np.zeros((len(c), dim))
        np.add.at(sums, at, m)
        return np.concatenate([sums.ravel(), np.bincount(at, minlength=len(c)), [d.sum()]])

    for round_ in range(1, most_rounds + 1):
        got = _summed(rows, vec, dim, part, len(centres) * (dim + 1) + 1, centres)
        sums, sizes, error = got[: centres.size].reshape(centres.shape), got[centres.size : -1], float(got[-1])
        new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        moved = float(np.sqrt(((new - centres) ** 2).sum(1)).max(initial=0.0))
        if moved <= tol:
            return Clusters(centres, sizes.astype(int), error, round_)
        centres = new
    return Clusters(centres, sizes.astype(int), error, most_rounds)


def clustered(df: DataFrame, clusters: Clusters, vec: str = "vec") -> DataFrame:
    """``df`` with ``cluster``, the nearest centre from 0 on, and ``d2``, the squared distance to it; null where a row is no vector."""
    kinds, names = dict(df.dtypes), df.columns
    centres = clusters.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ok = _matrix(b[vec], centres.shape[1])
            at, d = _assign(m, centres)
            where = np.full(len(ok), -1)
            where[ok] = np.arange(len(m))
            none = ~ok
            pick = lambda x: pa.array(x[np.maximum(where, 0)] if len(x) else np.zeros(len(ok), x.dtype), mask=none)
            yield pa.RecordBatch.from_arrays([*[b[c] for c in names], pick(at.astype(np.int32)), pick(d)], [*names, "cluster", "d2"])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "cluster int", "d2 double"]))
