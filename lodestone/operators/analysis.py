"""Projections and summaries of stored rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import refuse
from ..functions.attributes import scalar_keys
from ..functions.metrics import matrix
from ..session import scratch_root

PCA_ROWS = 1_000
PCA_STEPS = 60
# Where the power iteration starts, sin(a j + b c) for dimension j and component c.
START_A, START_B = 12.9898, 78.233
#: Price of a stored GiB and month.
STORAGE_PRICE = 0.015


def pca2d(vectors: np.ndarray) -> np.ndarray:
    """First two principal components by power iteration with deflation, from a fixed start."""
    x = vectors - vectors.mean(axis=0)
    found: list[np.ndarray] = []
    for c in range(2):
        w = np.sin(np.arange(x.shape[1]) * START_A + c * START_B)
        for _ in range(PCA_STEPS):
            w = x.T @ (x @ w)
            whole = np.sqrt(np.square(w).sum())
            for p in found:
                w = w - (w @ p) * p
            size = np.sqrt(np.square(w).sum())
            # What deflation leaves of rows on one line is rounding noise: no second component.
            w = w / size if size > 1e-9 * whole else np.zeros_like(w)
        found.append(w)
    return x @ np.stack(found, axis=1)


def pca2d_rows(rows: DataFrame, n: int = 600) -> DataFrame:
    """(id, x, y) of the first n rows by id; n is at most PCA_ROWS."""
    picked = rows.select("id", "vector").orderBy("id").limit(min(n, PCA_ROWS)).toArrow()
    if len(picked) < 3:
        refuse("need at least 3 rows to project")
    points = pca2d(matrix(picked["vector"].combine_chunks()))
    return rows.sparkSession.createDataFrame([(i, float(x), float(y)) for i, (x, y) in zip(picked["id"].to_pylist(), points)], "id string, x double, y double")


def category_keys(rows: DataFrame) -> DataFrame:
    """(key) of all attributes with string, number or boolean values."""
    return rows.select(F.explode(scalar_keys("attrs")).alias("key")).distinct()


def percentile_nearest(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(p, value) for each share p: the element at place floor((n - 1) p) in order; no rows if there are no values.

    Values are put in range-partitioned order and numbered within their partitions, so no task holds all of them. The
    numbered values are written once: a second sort could draw other borders.
    """
    spark = values.sparkSession
    rows = values.select(F.col(column).alias("value")).filter(F.col("value").isNotNull())
    ordered = rows.repartitionByRange("value").sortWithinPartitions("value")
    # A monotonic id holds the partition in its upper bits and the place within it in the lower 33.
    numbered = ordered.select("value", F.monotonically_increasing_id().alias("n"))
    path = f"{scratch_root(spark)}/percentile"
    numbered.select("value", F.shiftright("n", 33).alias("part"), F.expr("n & 8589934591L").alias("place")).write.parquet(path)
    written = spark.read.parquet(path)
    sizes = sorted((r["part"], r["count"]) for r in written.groupBy("part").count().collect())
    total = sum(n for _, n in sizes)
    wanted = []
    for p in shares if total else ():
        place = math.floor((total - 1) * p)
        for part, n in sizes:
            if place < n:
                wanted.append((float(p), part, place))
                break
            place -= n
    asked = spark.createDataFrame(wanted, "p double, part long, place long")
    return written.join(F.broadcast(asked), ["part", "place"]).select("p", "value")


def storage_cost(size: Column) -> Column:
    """Monthly price of a number of bytes."""
    return size / float(1 << 30) * STORAGE_PRICE
