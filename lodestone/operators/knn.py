"""Nearest neighbours: one query as a plan, many queries by bounded batches, and recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attributes import pick
from ..functions.metrics import SCORERS, best_first, check_metric, lower_is_better, matrix, numpy_distances

#: Bytes of query vectors that one pass over the rows carries.
QUERY_BYTES = 16 << 20
#: Elements of a distance matrix that a task holds at once.
TILE = 1 << 21


def projection(include_attributes: bool | list[str] | None, include_vectors: bool) -> list[Column]:
    """Columns beside id and dist."""
    out = []
    if isinstance(include_attributes, (list, tuple)):
        out.append(pick("attrs", list(include_attributes)).alias("attributes"))
    elif include_attributes:
        out.append(F.coalesce("attrs", F.lit("{}")).alias("attributes"))
    if include_vectors:
        out.append(F.col("vector"))
    return out


def top_k(
    rows: DataFrame,
    query: list[float],
    k: int,
    metric: str,
    include_attributes: bool | list[str] | None = False,
    include_vectors: bool = False,
    scorer: str = "arrow",
) -> DataFrame:
    """The k best rows (id, dist, and what is included), best first, ties by id.

    Every task keeps k rows and only those travel. Attributes are read only if they are asked for, and picked from the
    k rows that are left.
    """
    wants_attributes = include_attributes is not None and include_attributes is not False
    raw = (["attrs"] if wants_attributes else []) + (["vector"] if include_vectors else [])
    scored = rows.select("id", SCORERS[scorer]("vector", query, check_metric(metric)).alias("dist"), *raw)
    best = scored.orderBy(best_first(metric), F.col("id")).limit(k)
    return best.select("id", "dist", *projection(include_attributes, include_vectors)) if raw else best


class Best:
    """The k smallest costs of each query and their ids, as rows are offered; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.cost, self.ids = k, np.full((queries, k), np.inf), np.full((queries, k), "", dtype=object)

    def offer(self, which: np.ndarray, cost: np.ndarray, ids: np.ndarray) -> None:
        """``cost[i, j]`` of query ``which[i]`` and row ``ids[j]``."""
        new = np.broadcast_to(ids, cost.shape)
        if cost.shape[1] > self.k:
            # Everything up to the k-th smallest cost, ties included, cut to equal width below.
            near = np.partition(cost, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            order = np.argsort(cost, axis=1, kind="stable")[:, : int((cost <= near).sum(axis=1).max())]
            cost, new = np.take_along_axis(cost, order, 1), np.take_along_axis(new, order, 1)
        better = (cost < self.cost[which, -1:]).any(axis=1) | (cost == self.cost[which, -1:]).any(axis=1)
        which, cost, new = which[better], cost[better], new[better]
        if len(which):
            cost, new = np.concatenate([self.cost[which], cost], axis=1), np.concatenate([self.ids[which], new], axis=1)
            rank_of_id = np.unique(new, return_inverse=True)[1].reshape(new.shape)
            order = np.lexsort((rank_of_id, cost), axis=1)[:, : self.k]
            self.cost[which], self.ids[which] = np.take_along_axis(cost, order, 1), np.take_along_axis(new, order, 1)


def knn_join(rows: DataFrame, queries: DataFrame, k: int, metric: str, query_bytes: int = QUERY_BYTES, routes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, rank, id, dist): the k nearest rows (id, vector) of every query (id, vector).

    Queries are a stated set. They go in batches of at most ``query_bytes``, each broadcast to one pass over the rows. A task keeps
    its k best rows of each query as it reads and hands on nothing else; a window then ranks what the tasks kept.
    With ``routes``, rows also have a ``cluster``, and a query sees those whose cluster is true in its row of ``routes(queries)``, and rows of
    cluster -1.
    """
    check_metric(metric)
    spark = rows.sparkSession
    sign = 1.0 if lower_is_better(metric) else -1.0
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    batches = max(1, -(-(size["n"] or 0) * (size["d"] or 0) * 8 // query_bytes))
    schema = "query_id string, id string, dist double"
    found = spark.createDataFrame([], schema)
    for part in range(batches):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == part).select("id", "vector").toArrow()
        if not len(own):
            continue
        q = matrix(own["vector"].combine_chunks())
        shared = spark.sparkContext.broadcast((np.array(own["id"].to_pylist(), dtype=object), q, None if routes is None else routes(q)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, seen = shared.value
            kept, every = Best(len(q), k), np.arange(len(q))
            step = max(1, TILE // max(1, len(q)))
            for b in batches:
                for at in range(0, b.num_rows, step):
                    piece = b.slice(at, step)
                    m, ids = matrix(piece.column("vector")), np.array(piece.column("id").to_pylist(), dtype=object)
                    if seen is None:
                        kept.offer(every, sign * numpy_distances(m, q, metric).T, ids)
                        continue
                    cluster = piece.column("cluster").to_numpy(zero_copy_only=False)
                    for c in np.unique(cluster).tolist():
                        which, here = every if c < 0 else np.flatnonzero(seen[:, c]), cluster == c
                        if len(which):
                            kept.offer(which, sign * numpy_distances(m[here], q[which], metric).T, ids[here])
            for at in range(0, len(q), max(1, (1 << 16) // k)):
                cost, ids = kept.cost[at : at + max(1, (1 << 16) // k)], kept.ids[at : at + max(1, (1 << 16) // k)]
                row, column = np.nonzero(np.isfinite(cost))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at + row], pa.string()), pa.array(ids[row, column], pa.string()), pa.array(sign * cost[row, column], pa.float64())],
                    names=["query_id", "id", "dist"],
                )

        found = found.unionByName(rows.select("id", "vector", *([] if routes is None else ["cluster"])).mapInArrow(best, schema))
    order = Window.partitionBy("query_id").orderBy(best_first(metric), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def recall_at_k(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of the exact neighbours that were found; both inputs have query_id and id."""
    a = found.groupBy("query_id").agg(F.collect_set("id").alias("a"))
    b = exact.groupBy("query_id").agg(F.collect_set("id").alias("b"))
    return b.join(a, "query_id", "left").select("query_id", (F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0)) / k).alias("recall"))
