"""How a nearest-neighbour query is answered: a filter first, the index where there is one, else everything."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import COSINE, check_metric, matrix
from ..operators.filters import compile_filter
from ..operators.kmeans import nearest_centroids, unit
from ..operators.knn import knn_join, projection, top_k
from ..sources.store import Store
from ..validate import check_vector, clamp_nprobe, clamp_top_k


@dataclass
class QueryPlan:
    """A planned query; ``rows`` is lazy."""

    kind: str  # empty, filtered, exhaustive or probed
    rows: DataFrame
    scanned: DataFrame | None = None
    exhaustive: bool = True
    index_version: int = 0
    segments: int = 0
    bytes: int = 0  # of the files that the plan may read
    clusters: list[int] = field(default_factory=list)


def plan_query(
    store: Store,
    state: dict,
    vector: list[float],
    *,
    top_k_rows: object = None,
    filters: object = None,
    include_attributes: bool | list[str] | None = False,
    include_vectors: bool = False,
    metric: str | None = None,
    nprobe: int | None = None,
    scorer: str = "arrow",
) -> QueryPlan:
    if state["dim"] is None:
        rows = store.current(state).select("id", F.lit(0.0).alias("dist"), *projection(include_attributes, include_vectors)).limit(0)
        return QueryPlan("empty", rows)
    query = check_vector(vector, state["dim"])
    k = clamp_top_k(top_k_rows)
    metric = check_metric(metric if metric is not None else state["metric"])
    clamp_nprobe(nprobe)  # refused with an index and without
    plan = QueryPlan("exhaustive", None, index_version=state["index_version"])  # type: ignore[arg-type]
    read = state["segments"]
    if filters is not None:
        plan.kind = "filtered"
        source = store.current(state).filter(compile_filter(filters))
    elif state["index_version"]:
        wanted = min(clamp_nprobe(nprobe), state["clusters"])
        q = np.asarray(query)
        routed = unit(q[None, :])[0] if metric == COSINE else q
        plan.clusters = nearest_centroids(np.asarray(store.centroids(state)), routed, wanted)
        plan.exhaustive = len(plan.clusters) == state["clusters"]
        plan.kind = "exhaustive" if plan.exhaustive else "probed"
        read = [s for s in read if s["kind"] == "wal" or s["cluster"] in plan.clusters]
        source = store.current(state, None if plan.exhaustive else plan.clusters)
    else:
        source = store.current(state)
    plan.scanned, plan.segments, plan.bytes = source, len(read), sum(s["bytes"] for s in read)
    plan.rows = top_k(source, query, k, metric, include_attributes, include_vectors, scorer)
    return plan


def routing(store: Store, state: dict, metric: str) -> Callable[[np.ndarray], np.ndarray]:
    """Clusters in order of distance of each query (rows of a matrix), as a plan of its own would probe them."""
    c = np.asarray(store.centroids(state))
    return lambda q: np.array([nearest_centroids(c, v, len(c)) for v in (unit(q) if metric == COSINE else q)]).reshape(-1, len(c))


def probed_join(store: Store, state: dict, queries: DataFrame, k: int, metric: str, nprobe: int) -> DataFrame:
    """``knn_join`` where each query sees the log tail and its ``nprobe`` nearest clusters only, as in a plan of its own; one pass."""
    if clamp_nprobe(nprobe) >= (state["clusters"] if state["index_version"] else 0):
        return knn_join(store.current(state), queries, k, metric)
    nearest = routing(store, state, metric)

    def routes(q: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(q), state["clusters"]), bool)
        seen[np.arange(len(q))[:, None], nearest(q)[:, : clamp_nprobe(nprobe)]] = True
        return seen

    return knn_join(store.current(state, with_cluster=True), queries, k, metric, routes=routes)


def nprobe_for(store: Store, state: dict, recall: float, k: int, metric: str, sample: int = 256) -> int:
    """Clusters that a query has to probe to find this share of its k nearest rows, measured on ``sample`` stored rows as queries.

    The exact neighbours of these rows are found once; a neighbour is found by probing as many clusters as its own is away in order of
    distance. The share is to be reached less two standard errors over the sample, so that other queries reach it too. Rows of the log tail are always found.
    """
    if not state["index_version"]:
        return 1
    rows = store.current(state, with_cluster=True)
    asked = rows.select("id", "vector").orderBy(F.xxhash64("id", F.lit("nprobe")), "id").limit(sample)
    # A stored row is its own nearest one, which other queries do not have.
    near = knn_join(rows.select("id", "vector"), asked, k + 1, metric).filter("id <> query_id").select(F.col("query_id").alias("q"), "id")
    pairs = near.join(rows.select("id", "cluster"), "id").groupBy("q").agg(F.collect_list("cluster").alias("clusters"))  # k a query
    got = pairs.join(asked.withColumnRenamed("id", "q"), "q").select("vector", "clusters").toArrow()
    if not len(got):
        return 1
    order = routing(store, state, metric)(matrix(got["vector"].combine_chunks()))
    place = np.argsort(order, axis=1)
    depth = [np.array([0 if c < 0 else place[i, c] + 1 for c in own]) for i, own in enumerate(got["clusters"].to_pylist())]
    shares = np.array([[(d <= p).mean() for p in range(1, state["clusters"] + 1)] for d in depth])  # a row for each query
    sure = shares.mean(axis=0) - 2 * shares.std(axis=0) / np.sqrt(len(shares))
    enough = np.flatnonzero(sure >= recall)
    return int(enough[0]) + 1 if len(enough) else state["clusters"]
