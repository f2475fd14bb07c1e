"""Distance metrics as column expressions and as an Arrow scorer; all arithmetic is in double precision over float32 inputs.

Two scorers give the same numbers up to rounding in the last digits. ``expression`` stays in the JVM and
suits columns against columns; ``arrow`` hands whole batches of vectors to numpy without copying and is the
faster one for scans against one constant vector (see the benchmark).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import refuse

COSINE, EUCLIDEAN, DOT = "cosine_distance", "euclidean_squared", "dot_product"
METRICS = (COSINE, EUCLIDEAN, DOT)


def check_metric(metric: object) -> str:
    if metric not in METRICS:
        refuse(f"there is no metric {metric!r}; there are {', '.join(METRICS)}")
    return metric


def lower_is_better(metric: str) -> bool:
    return metric != DOT


def best_first(metric: str, dist: str = "dist") -> Column:
    return F.col(dist).asc() if lower_is_better(metric) else F.col(dist).desc()


def _column(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2sq(a: Column | str, b: Column | str) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum(F.zip_with(_column(a), _column(b), square))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_column(v), lambda x: x.cast("double") * x.cast("double"))))


def normalized(v: Column | str) -> Column:
    """Unit vector in float32; a zero vector stays as it is."""
    v = _column(v)
    size = norm(v)
    return F.when(size == 0, v.cast("array<float>")).otherwise(F.transform(v, lambda x: (x.cast("double") / size).cast("float")))


def cosine(a: Column | str, b: Column | str, b_norm: Column | None = None) -> Column:
    """1 - cos, at least 0; 1 where a vector is zero."""
    scale = norm(a) * (norm(b) if b_norm is None else b_norm)
    return F.when(scale == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - dot(a, b) / scale))


def distance(a: Column | str, b: Column | str, metric: str) -> Column:
    """Metric of two vector columns."""
    return {COSINE: cosine, EUCLIDEAN: l2sq, DOT: dot}[check_metric(metric)](a, b)


def expression(vector: str, query: list[float], metric: str) -> Column:
    """Metric of a vector column against a constant; the constant's norm is computed here, as Catalyst would not fold it."""
    if check_metric(metric) == COSINE:
        size = float(np.sqrt(np.square(np.asarray(query, np.float64)).sum()))
        return cosine(vector, literal(query), F.lit(size))
    return distance(vector, literal(query), metric)


def matrix(vectors: pa.Array) -> np.ndarray:
    """(rows, dim) doubles of a list array without nulls."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1).astype(np.float64)


def numpy_distances(m: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Rows of m against rows of q: (len(m), len(q))."""
    if metric == EUCLIDEAN:
        return np.stack([np.square(m - one).sum(axis=1) for one in q], axis=1) if len(q) else np.zeros((len(m), 0))
    products = m @ q.T
    if metric == DOT:
        return products
    scale = np.sqrt(np.square(m).sum(axis=1))[:, None] * np.sqrt(np.square(q).sum(axis=1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale == 0, 1.0, np.maximum(0.0, 1.0 - products / scale))


def arrow(vector: str, query: list[float], metric: str) -> Column:
    """Like ``expression``, by Arrow batches."""
    check_metric(metric)
    q = np.asarray([query], np.float64)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            yield pa.array(numpy_distances(matrix(vectors), q, metric)[:, 0] if len(vectors) else np.zeros(0), pa.float64())

    return score(F.col(vector))


SCORERS = {"arrow": arrow, "expression": expression}


def summary(vector: str) -> list[Column]:
    """dims, mean, min, max and norm of a vector column."""
    mean = _sum(F.transform(vector, lambda x: x.cast("double"))) / F.size(vector)
    return [
        F.size(vector).alias("dims"),
        mean.alias("mean"),
        F.array_min(vector).cast("double").alias("min"),
        F.array_max(vector).cast("double").alias("max"),
        norm(vector).alias("norm"),
    ]
