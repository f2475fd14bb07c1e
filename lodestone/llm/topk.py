"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors become integers, floor(1024 x) per component. They are ordered by a coarse cell (signs of the
first components), which makes neighbours in that order alike, and cut into document-range blocks of BLOCK vectors. A
block keeps a forward index (its integer matrix) and each term's maximum and minimum; a shard is one row with up to
SHARD_BLOCKS blocks. For a query, the sum over terms of q * max (q * min for negative q) bounds every score
in a block. Within a shard each query visits blocks from the highest bound down and stops when bounds
fall below its k-th best score so far; that score starts at the k-th best over a bounded sample, which is
a valid lower bound everywhere. Shards return what can still be among the k best, and a window ranks it.

Components travel as doubles, which hold floor(1024 x) of every finite float32 exactly. Products are taken in doubles or longs where
those are exact, and in integers of any size where they would not be.

Queries are a stated set and travel in batches of at most QUERY_BYTES, each broadcast to one pass over the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

BLOCK = 64
SHARD_BLOCKS = 64
CELL_TERMS = 12
QUERY_BYTES = 16 << 20
#: Vectors that the first thresholds are taken from.
SEED_ROWS = 2048
#: Below these, sums of integer products are exact in doubles and in longs.
EXACT, LONG = 1 << 53, 1 << 62
#: Below every score: of longs, and of integers of any size (float32 components give less than 2**320).
NONE, LEAST = -LONG, -(1 << 320)
_SHARD = "dim int, kind string, ids binary, forward binary, high binary, low binary"
_HITS = "query bigint, query_row bigint, id bigint, score bigint, beyond binary"


def quantised(vector: str) -> Column:
    def whole(x: Column) -> Column:
        scaled = x.cast("double") * 1024
        return F.when(F.abs(scaled) < float(EXACT), F.floor(scaled).cast("double")).otherwise(scaled)  # larger doubles are whole

    return F.transform(F.col(vector), whole)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: an id, and components that are all there and finite."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), quantised(vec_col).alias("vec"))


def largest(*parts: np.ndarray) -> int:
    return max((int(np.abs(x).max()) for x in parts if x.size), default=0)


def whole_numbers(m: np.ndarray) -> np.ndarray:
    """A matrix of whole doubles as longs where they fit, else as it is."""
    return m.astype(np.int64) if largest(m) < LONG else m


def _any_size(m: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(m)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of whole numbers: longs, or an array of Python integers where a sum might not fit into 62 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = largest(a) * largest(b) * a.shape[1]
    if top < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < LONG:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    return _any_size(a) @ _any_size(b).T


def best_columns(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row the places of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:  # which lexsort does not take
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    return np.lexsort((ids, -scores), axis=1)[:, :k]


def as_longs(scores: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Scores as the nearest longs, and for those beyond a long a key of bytes in the order of their exact values."""
    if scores.dtype != object:
        return scores, [None] * len(scores)
    low, high = -(1 << 63), (1 << 63) - 1
    keys = [(int(s) - LEAST).to_bytes(41, "big") if not low < s < high else None for s in scores]
    return np.array([min(max(int(s), low), high) for s in scores], np.int64), keys


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, vec) in order of (dimension, cell, id) in, shards out."""
    ids: list[int] = []
    vecs: list[np.ndarray] = []

    def cut() -> pd.DataFrame:
        m = whole_numbers(np.array(vecs, np.float64))
        starts = np.arange(0, len(m), BLOCK)
        high, low = np.maximum.reduceat(m, starts, axis=0), np.minimum.reduceat(m, starts, axis=0)
        kind = "<f8" if m.dtype != np.int64 else "<i4" if largest(m) < 1 << 31 else "<i8"
        return pd.DataFrame({
            "dim": [m.shape[1]], "kind": [kind], "ids": [np.array(ids, "<i8").tobytes()],
            **{k: [x.astype(kind).tobytes()] for k, x in (("forward", m), ("high", high), ("low", low))},
        })

    for b in batches:
        for i, v in zip(b["id"].tolist(), b["vec"]):
            if ids and (len(ids) == BLOCK * SHARD_BLOCKS or len(v) != len(vecs[0])):
                yield cut()
                ids, vecs = [], []
            ids.append(i)
            vecs.append(v)
    if ids and len(vecs[0]):
        yield cut()


def build_index(rows: DataFrame) -> DataFrame:
    """One row per shard; ``rows`` as ``usable`` returns them. Vectors of no components are left out."""
    cell = sum((F.when(F.get("vec", F.lit(j)) > 0, 1 << (CELL_TERMS - 1 - j)).otherwise(0) for j in range(CELL_TERMS)), F.lit(0))
    keyed = rows.filter(F.size("vec") > 0).select("id", "vec", F.size("vec").alias("dim"), cell.alias("cell"))
    ordered = keyed.repartitionByRange("dim", "cell", "id").sortWithinPartitions("dim", "cell", "id").select("id", "vec")
    return ordered.mapInPandas(_shards, _SHARD)


class Queries:
    """A batch of queries of one dimension: ids, their integer matrix, and lower bounds of their k-th best scores."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, floor: np.ndarray):
        self.ids, self.matrix, self.floor = ids, matrix, floor


def kth_best(q: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, k: int) -> np.ndarray:
    """k-th best score of each query over the given vectors but its own; below every score where there are fewer."""
    if len(other) < k:
        return np.full(len(q), LEAST, dtype=object)
    s = products(q, other)
    s[ids[:, None] == other_ids[None, :]] = LEAST if s.dtype == object else NONE
    kth = np.sort(s, axis=1)[:, len(other) - k].astype(object)
    return np.where(kth == NONE, LEAST, kth) if s.dtype != object else kth


def search_shard(q: Queries, ids: np.ndarray, forward: np.ndarray, high: np.ndarray, low: np.ndarray, k: int):
    """(query row, vector id, score) of what may be among the k best of each query, and the number of blocks scored."""
    n = len(q.ids)
    none, kind = (NONE, np.int64) if largest(q.matrix) * largest(forward, high, low) * forward.shape[1] < LONG else (LEAST, object)
    bounds = products(np.maximum(q.matrix, 0), high) + products(np.minimum(q.matrix, 0), low)
    # Thresholds beyond what this shard can reach rule all of it out.
    floor = q.floor.astype(object) if kind is object else np.array([min(max(int(x), NONE), LONG) for x in q.floor], np.int64)
    order = np.argsort(-bounds, axis=1, kind="stable")
    scores, found = np.full((n, k), none, dtype=kind), np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.copy()
    active, visited = np.arange(n), 0
    for r in range(order.shape[1]):
        block = order[active, r]
        going = bounds[active, block] >= kth[active]
        active, block = active[going], block[going]
        if not len(active):
            break
        for b in np.unique(block).tolist():
            qs = active[block == b]
            at = slice(b * BLOCK, (b + 1) * BLOCK)
            s = products(q.matrix[qs], forward[at]).astype(kind)
            own = np.broadcast_to(ids[at], s.shape)
            s[own == q.ids[qs][:, None]] = none
            s, own = np.concatenate([scores[qs], s], axis=1), np.concatenate([found[qs], own], axis=1)
            best = best_columns(s, own, k)
            scores[qs], found[qs] = np.take_along_axis(s, best, 1), np.take_along_axis(own, best, 1)
            visited += len(qs)
        kth[active] = np.maximum(kth[active], scores[active, -1])
    row, col = np.nonzero((scores > none) & (scores >= floor[:, None]))
    return row, found[row, col], scores[row, col], visited


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the k highest integer inner products of every query over all
    vectors but those with its own id; ties to the smaller id, all if there are fewer.

    Rows with a null id, a null vector or null or non-finite components take no part; vectors are compared with queries of
    their own dimension. Every finite component has an exact product: scores beyond a long are ranked by their exact values and
    returned as the nearest long. Repeated query rows are answered once, repeated vectors appear as often as they
    are there. Extra columns are ignored; empty tables give an empty result.
    """
    rows = usable(vectors, id_col, vec_col)
    index = scratch(build_index(rows), "topk-index")
    asked = scratch(usable(queries, id_col, vec_col).filter(F.size("vec") > 0).distinct(), "topk-queries")
    seeds = rows.orderBy(F.xxhash64("id"), "id").limit(SEED_ROWS).toArrow()
    by_dim: dict[int, tuple[list, list]] = {}
    for i, v in zip(seeds["id"].to_pylist(), seeds["vec"].to_pylist()):
        own = by_dim.setdefault(len(v), ([], []))
        own[0].append(i)
        own[1].append(v)
    spark = vectors.sparkSession
    sizes = {r["dim"]: r["count"] for r in asked.groupBy(F.size("vec").alias("dim")).count().collect()}
    found = spark.createDataFrame([], _HITS)
    for dim, n in sorted(sizes.items()):
        batches = -(-n * dim * 8 // QUERY_BYTES)
        of_dim = asked.filter(F.size("vec") == dim)
        for part in range(batches):
            own = of_dim.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(batches)) == part).toArrow()  # about QUERY_BYTES at most
            if not len(own):
                continue
            ids, matrix = np.array(own["id"].to_pylist(), np.int64), whole_numbers(np.array(own["vec"].to_pylist(), np.float64))
            seed_ids, seed_vecs = by_dim.get(dim, ([], []))
            floor = kth_best(matrix, ids, whole_numbers(np.array(seed_vecs, np.float64).reshape(-1, dim)), np.array(seed_ids, np.int64), k)
            shared = spark.sparkContext.broadcast(Queries(ids, matrix, floor))

            def run(shards: Iterator[pd.DataFrame], shared=shared, dim=dim) -> Iterator[pd.DataFrame]:
                q = shared.value
                for b in shards:
                    for s in b.itertuples():
                        own, *parts = np.frombuffer(s.ids, "<i8"), *(np.frombuffer(x, s.kind).reshape(-1, dim) for x in (s.forward, s.high, s.low))
                        row, vec, score, _ = search_shard(q, own, *(x if s.kind == "<f8" else x.astype(np.int64) for x in parts), k)
                        score, beyond = as_longs(score)
                        yield pd.DataFrame({"query": q.ids[row], "query_row": row, "id": vec, "score": score, "beyond": beyond})

            hits = index.filter(F.col("dim") == dim).mapInPandas(run, _HITS)
            found = found.unionByName(hits.withColumn("query_row", F.col("query_row") + F.lit(part) * F.lit(1 << 32)))
    best = Window.partitionBy("query", "query_row").orderBy(F.desc("score"), F.desc("beyond"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
