"""Building an index version: sample, k-means, assignment, partitioned write, publication."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.metrics import COSINE, matrix
from ..sources.store import Store
from .kmeans import MAX_CLUSTERS, TARGET_CLUSTER_ROWS, cluster_count, kmeans, nearest, sample_size, unit

# The log size that makes an automatic build worthwhile.
AUTO_ROWS = 2_000
AUTO_BYTES = 32 << 20

_guard = threading.Lock()
_building: set[str] = set()


def below_threshold(state: dict) -> bool:
    wal = [s for s in state["segments"] if s["kind"] == "wal"]
    return sum(s["rows"] for s in wal) < AUTO_ROWS and sum(s["bytes"] for s in wal) < AUTO_BYTES


def sample(rows: DataFrame, n: int, seed: int = 1) -> np.ndarray:
    """n rows by the smallest hashes of their ids: the same rows for the same data. At most 8 MB, or a row for each cluster if there are more."""
    picked = rows.select("id", "vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).toArrow()
    vectors = picked["vector"].combine_chunks() if len(picked) else pa.array([], pa.list_(pa.float32()))
    return matrix(vectors) if len(picked) else np.zeros((0, 1))


def assigned(vector: str, centroids: np.ndarray) -> Column:
    """Number of the nearest centroid (squared distance for every metric, ties to the first)."""
    c = np.asarray(centroids, np.float64)

    @F.arrow_udf("int")
    def number(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            yield pa.array(nearest(matrix(vectors), c)[0] if len(vectors) else [], pa.int32())

    return number(F.col(vector))


def centroids_of(rows: DataFrame, live: int, dim: int, metric: str, max_clusters: int | None = MAX_CLUSTERS, cluster_rows: int = TARGET_CLUSTER_ROWS) -> np.ndarray:
    count = cluster_count(live, dim, max_clusters, cluster_rows)
    data = sample(rows, max(sample_size(live, dim), count))
    if metric == COSINE:
        data = unit(data)
    made = kmeans(data, min(count, len(data)))
    return (unit(made) if metric == COSINE else made).astype(np.float32).astype(np.float64)


def build_index(store: Store, force: bool = True, max_clusters: int | None = MAX_CLUSTERS, cluster_rows: int = TARGET_CLUSTER_ROWS) -> dict:
    """Index everything that is live now. Readers keep the old version until the new one is published; writes that
    commit meanwhile stay in the log tail. A failed build leaves the old version as it was. One build of a namespace
    runs at a time in a process, and one that would only be skipped keeps no other from running."""
    state = store.state()
    if state["dim"] is None:
        return {"status": "skipped", "reason": "empty"}
    if not force and below_threshold(state):
        return {"status": "skipped", "reason": "below threshold"}
    with _guard:
        if store.home in _building:
            return {"status": "already_running"}
        _building.add(store.home)
    try:
        return _build(store, max_clusters, cluster_rows)
    finally:
        with _guard:
            _building.discard(store.home)


def _build(store: Store, max_clusters: int | None, cluster_rows: int) -> dict:
    started = time.time()
    state = store.state()
    rows = store.current(state)
    live = store.count(state)
    if not live:
        return {"status": "skipped", "reason": "empty"}
    centroids = centroids_of(rows, live, state["dim"], state["metric"], max_clusters, cluster_rows)
    number = 0

    def reserve(s: dict) -> dict:
        nonlocal number
        number = s["build_seq"] + 1
        return s | {"build_seq": number}

    store.change(reserve)
    path = f"index/v={number}-{uuid.uuid4().hex[:8]}"
    try:
        # Rebalancing by cluster gives files of one cluster each and splits clusters that are too large for a task.
        dealt = rows.withColumn("cluster", assigned("vector", centroids)).hint("rebalance", "cluster")
        # In order of id within a file, so that fetches by id skip row groups by their statistics.
        dealt = dealt.sortWithinPartitions("cluster", "id")
        dealt.write.partitionBy("cluster").parquet(f"{store.home}/{path}")
        sizes: dict[int, int] = {}
        for p, n in store.files.files_below(f"{store.home}/{path}"):
            if "/cluster=" in p and p.endswith(".parquet"):
                c = int(p.split("/cluster=")[1].split("/")[0])
                sizes[c] = sizes.get(c, 0) + n
        counts = {r["cluster"]: r["count"] for r in store.spark.read.parquet(f"{store.home}/{path}").groupBy("cluster").count().collect()}
    except Exception:
        store.files.delete(f"{store.home}/{path}")
        raise
    store.files.create(f"{store.home}/{path}/_centroids.json", json.dumps(centroids.tolist()))
    segments = [{"key": f"{path}/cluster={c}", "kind": "cluster", "version": number, "cluster": c, "seq": state["seq"], "rows": counts.get(c, 0), "bytes": b} for c, b in sorted(sizes.items())]
    garbage: list[str] = []

    def finish(s: dict) -> dict:
        if s["number"] == 0 or s["index_version"] > number:
            raise EngineError(409, "the namespace was destroyed, or a later build finished first")
        gone = [x["key"] for x in s["segments"] if x["kind"] == "wal" and x["seq"] <= state["seq"]]
        gone += [s["index_path"]] if s["index_path"] else []
        garbage[:] = s["retired"]
        later = [x for x in s["segments"] if x["kind"] == "wal" and x["seq"] > state["seq"]]
        return s | {"index_version": number, "clusters": len(centroids), "centroids": f"{path}/_centroids.json", "index_path": path, "segments": segments + later, "retired": gone}

    try:
        store.change(finish)
    except Exception:
        store.files.delete(f"{store.home}/{path}")
        raise
    for key in garbage:
        store.files.delete(f"{store.home}/{key}")
    return {"status": "built", "version": number, "clusters": len(centroids), "rows": live, "took_ms": int(1000 * (time.time() - started))}
