"""Whitening of embeddings along their leading components.

Nulls: rows without a whole, finite vector are dropped, a null id stays. Repeated
rows each get their results; in the fit an equal vector counts once. Vectors of
another length than the commonest are dropped. An empty table gives an empty
result. Other columns are never read, so their names can't clash. A component
without variance (fewer distinct vectors than components) has a null ``whitened``.

The fit list and the sums over it are distributed; the driver holds a matrix of
dimensions squared and the leading vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.spectrum import EPS, leading_pairs
from trellium.llm.vectors import integer_vectors, matrix, reach
from trellium.llm.work import lasting

SLICE = 4096
LOW_BITS = 48


@dataclass(frozen=True)
class Fit:
    """Distinct vectors, their exact sums per dimension, and the leading components."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: np.ndarray
    trace: float
    identity_error: float | None


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y'y without rounding."""
    bound = reach(y) ** 2 * max(1, len(y))
    if bound < 1 << 53:
        y = y.astype(float)
        return (y.T @ y).astype(np.int64)
    if bound >= 1 << 63:
        y = y.astype(object)
    return y.T @ y


def _summed(rows: DataFrame, table) -> dict[tuple[int, int], int]:
    """Exact sums over all rows of tables of whole numbers that ``table`` makes of slices of vectors.

    Numbers travel in two parts, so that no sum leaves the range of its type.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                made = table(matrix(batch.column(0).slice(at, SLICE)))
                for i, row in enumerate(made.tolist()):
                    for j, number in enumerate(row[i:] if len(made) > 1 else row, i if len(made) > 1 else 0):
                        total[i, j] = total.get((i, j), 0) + number
        if total:
            kind = pa.decimal128(38, 0)
            mask = (1 << LOW_BITS) - 1
            yield pa.RecordBatch.from_pydict({
                "i": pa.array([i for i, _ in total], pa.int32()), "j": pa.array([j for _, j in total], pa.int32()),
                "high": pa.array([v >> LOW_BITS for v in total.values()], kind), "low": pa.array([v & mask for v in total.values()], kind),
            })

    parts = rows.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    sums = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r.i, r.j): (int(r.high) << LOW_BITS) + int(r.low) for r in sums.collect()}


def _covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance, divisor n, each entry rounded once.

    Vectors are centred at the whole number next to the mean before they are
    multiplied; what is left of the mean is taken off in exact arithmetic.
    """
    centre = [round(Fraction(s, n)) for s in sums]
    dims = len(sums)

    def table(x: np.ndarray) -> np.ndarray:
        if reach(x) + max(map(abs, centre)) >= 1 << 62:
            return _exact_product(x.astype(object) - np.array(centre, dtype=object))
        return _exact_product(x - np.array(centre))

    products = _summed(rows, table)
    left = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((dims, dims))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = float(Fraction(n * p - left[i] * left[j], n * n))
    return v


def whitened_by(fit: Fit):
    """A function from vectors to their whitened coordinates, a row for each component."""
    floor = 64 * EPS * len(fit.sums) * max([*fit.values, 0.0])
    kept = [e > floor for e in fit.values]
    n, sums = fit.n, fit.sums

    def project(x: np.ndarray) -> list[np.ndarray | None]:
        mean_whole = np.array([s // n for s in sums], dtype=object if max(map(abs, sums)) >= n << 62 else np.int64)
        mean_rest = np.array([(s % n) / n for s in sums])
        centred = (x - mean_whole).astype(float) - mean_rest
        return [centred @ v / e**0.5 if good else None for e, v, good in zip(fit.values, fit.vectors, kept)]

    return project


def _whitened_covariance_error(rows: DataFrame, fit: Fit) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    project = whitened_by(fit)
    names = [f"w{k}" for k, w in enumerate(project(np.zeros((1, len(fit.sums)), np.int64))) if w is not None]
    if not names:
        return None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                made = [w for w in project(matrix(batch.column(0))) if w is not None]
                yield pa.RecordBatch.from_arrays([pa.array(w) for w in made], names=names)

    made = rows.mapInArrow(run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = made.agg(*[F.covar_pop(a, b) for a, b in pairs]).first()
    return max(abs(c - (a == b)) for c, (a, b) in zip(got, pairs))


def fit_components(rows: DataFrame, components: int) -> Fit | None:
    """Fit on the distinct vectors ``x`` of ``rows``; None if there is no row.

    The distinct vectors are written to the shared folder once and read for the
    sums, the products, and the check of the result.
    """
    folder = lasting(rows.sparkSession, "whiten")
    distinct = folder.save(rows.select("x").distinct(), "vectors")
    n = distinct.count()
    if not n:
        return None
    sums_at = _summed(distinct, lambda x: (x.astype(object) if reach(x) * len(x) >= 1 << 62 else x).sum(axis=0, keepdims=True))
    sums = [sums_at[0, j] for j in range(len(sums_at))]
    v = _covariance(distinct, n, sums)
    pairs = leading_pairs(v, components)
    fit = Fit(n, sums, [p.value for p in pairs], np.array([p.vector for p in pairs]), float(np.trace(v)), None)
    error = _whitened_covariance_error(distinct, fit)
    folder.drop("vectors")
    return Fit(fit.n, fit.sums, fit.values, fit.vectors, fit.trace, error)


SCHEMA = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = 4, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """A row for each whole vector of ``df`` and leading component.

    ``n`` counts the distinct vectors, ``deviation`` is the squared distance of n
    times the vector from the sum of all, exact (null beyond 38 digits),
    ``whitened`` the coordinate on the component over its standard deviation,
    ``explained`` the component's share of the variance, ``identity_error`` the
    largest entry of the whitened covariance minus the identity.
    """
    rows = integer_vectors(df, vector, {"id": F.col(f"`{id_column}`")})
    fit = fit_components(rows, components)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_column}` {kind}, {SCHEMA}"
    if fit is None:
        return df.sparkSession.createDataFrame([], schema)
    project = whitened_by(fit)
    k = len(fit.values)
    explained = [max(e, 0.0) / fit.trace if fit.trace > 0 else None for e in fit.values]

    def deviations(x: np.ndarray) -> list[int | None]:
        bound = (fit.n * reach(x) + max(map(abs, fit.sums))) ** 2 * len(fit.sums)
        sums = np.array(fit.sums, dtype=object if bound >= 1 << 63 else np.int64)
        apart = (x.astype(sums.dtype) if bound >= 1 << 63 else x) * fit.n - sums
        return [v if v < 10**38 else None for v in (apart * apart).sum(axis=1).tolist()]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                x = matrix(part.column(1))
                far = pa.array(deviations(x), pa.decimal128(38, 0))
                for c, w in enumerate(project(x)):
                    size = len(x)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0), pa.array([c + 1] * size, pa.int32()), pa.array([fit.n] * size, pa.int64()), far,
                        pa.nulls(size, pa.float64()) if w is None else pa.array(w), pa.array([explained[c]] * size, pa.float64()),
                        pa.array([fit.identity_error] * size, pa.float64()),
                    ], names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema) if k else df.sparkSession.createDataFrame([], schema)
