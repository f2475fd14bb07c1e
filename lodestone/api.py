"""The engine and its namespaces: every request of the data model as a Python call."""

from __future__ import annotations

import json
import time
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import __version__, validate
from .errors import EngineError, refuse
from .functions.attributes import merged
from .functions.metrics import check_metric
from .operators import ivf
from .operators.filters import compile_filter
from .operators.knn import knn_join, projection
from .plans.planner import QueryPlan, nprobe_for, plan_query, probed_join
from .sources.catalog import namespaces
from .sources.store import DELETE, UPSERT, Store, by_id

#: From this many stored rows on, attributes are fetched for the results of a query or a page only.
LATE_ROWS = 1_000_000
_VECTOR = pa.list_(pa.float32())
_BATCH = pa.schema([("id", pa.string()), ("op", pa.string()), ("vector", _VECTOR), ("attrs", pa.string()), ("pos", pa.int64())])
_PATCH = pa.schema([("id", pa.string()), ("new_vector", _VECTOR), ("patch", pa.string()), ("pos", pa.int64())])


class Engine:
    """Namespaces under a root folder of any file system that Spark can write to."""

    version = __version__

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def namespace(self, name: str) -> Namespace:
        return Namespace(self.spark, self.root, name)

    def namespaces(self) -> DataFrame:
        return namespaces(self.spark, self.root)

    def list_namespaces(self) -> list[dict]:
        return [r.asDict() for r in self.namespaces().collect()]


class Namespace:
    """Rows of an id, a float32 vector and JSON attributes; unknown namespaces read as empty ones."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self.store = Store(spark, root, name)

    # Reading

    def rows(self) -> DataFrame:
        """All live rows (id, vector, attrs as JSON text) as a lazy DataFrame."""
        return self.store.current(self.store.state())

    def get(self, ids: list[str], include_vectors: bool = False) -> list[dict]:
        """Rows of up to 1000 ids, in order of id; unknown ids are left out, repeated ones come once."""
        ids = validate.check_batch(ids, "ids", validate.MAX_FETCH_IDS)
        wanted = self.rows().filter(F.col("id").isin(sorted({str(i) for i in ids})))
        found = wanted.select("id", "attrs", *(["vector"] if include_vectors else [])).collect()
        return [_stored(r) for r in sorted(found, key=lambda r: r.id)]

    def get_one(self, row_id: str, include_vectors: bool = False) -> dict:
        found = self.get([row_id], include_vectors)
        return found[0] if found else refuse(f"no row {row_id!r}", 404)

    def list(self, cursor: str | None = None, limit: object = None) -> dict:
        """A page of rows after ``cursor`` in order of id, without vectors, and the next cursor or None."""
        limit = validate.clamp_page(limit)
        state = self.store.state()
        rows = self.store.current(state).select("id", "attrs")
        after = rows.filter(F.col("id") > cursor) if cursor else rows
        if sum(s["rows"] for s in state["segments"]) >= LATE_ROWS:
            # Over many rows, only ids are read for the order, and then the row groups that hold the page's.
            ids = [r.id for r in after.select("id").orderBy("id").limit(limit + 1).collect()]
            after = rows.filter(F.col("id").isin(ids))
        page = [_stored(r) for r in after.orderBy("id").limit(limit + 1).collect()]
        return {"rows": page[:limit], "next_cursor": page[limit - 1]["id"] if len(page) > limit else None}

    def plan(self, vector: list[float], **options) -> QueryPlan:
        return plan_query(self.store, self.store.state(), vector, **options)

    def query(
        self,
        vector: list[float],
        top_k: object = None,
        filters: object = None,
        include_attributes: bool | list[str] | None = False,
        include_vectors: bool = False,
        distance_metric: str | None = None,
        nprobe: int | None = None,
    ) -> dict:
        """Nearest rows, best first, and how they were found."""
        started = time.time()
        seen = Observation(f"scored-{uuid.uuid4().hex}")
        state = self.store.state()
        if state["dim"] is None:
            return {"rows": [], "stats": _query_stats(0, 0, 0, True, 0, 0, 0)}
        hits, misses = self.store.hits, self.store.misses
        # Over many rows, attributes are fetched afterwards for the rows found, not read for every row scored.
        late = include_attributes is not None and include_attributes is not False and sum(s["rows"] for s in state["segments"]) >= LATE_ROWS
        options = {"top_k_rows": top_k, "filters": filters, "include_attributes": False if late else include_attributes, "include_vectors": include_vectors, "metric": distance_metric, "nprobe": nprobe}
        plan = plan_query(_Observed(self.store, seen), state, vector, **options)
        rows = [_found(r) for r in plan.rows.collect()]
        scored = seen.get.get("n", 0)
        if late and rows:
            near = self.store.current(state, plan.clusters if plan.kind == "probed" else None).filter(F.col("id").isin([r["id"] for r in rows]))
            attributes = {r.id: json.loads(r.attributes) for r in near.select("id", *projection(include_attributes, False)).collect()}
            rows = [r | {"attributes": attributes[r["id"]]} for r in rows]
        took, hits, misses = int(1000 * (time.time() - started)), self.store.hits - hits, self.store.misses - misses
        return {"rows": rows, "stats": _query_stats(took, plan.segments, scored, plan.exhaustive, plan.index_version, hits, misses)}

    def query_many(self, queries: DataFrame, top_k: int = 10, filters: object = None, distance_metric: str | None = None, nprobe: int | None = None) -> DataFrame:
        """(query_id, rank, id, dist) for a DataFrame of queries (id, vector), over all live rows or, with ``nprobe`` and no filter, by the index."""
        state = self.store.state()
        if nprobe is not None and filters is None and state["dim"] is not None:
            return probed_join(self.store, state, queries, validate.clamp_top_k(top_k), distance_metric or state["metric"], nprobe)
        rows = self.store.current(state)
        rows = rows if filters is None else rows.filter(compile_filter(filters))
        return knn_join(rows, queries, validate.clamp_top_k(top_k), distance_metric or state["metric"])

    def similar(self, row_id: str, top_k: object = None, **options) -> dict:
        """Nearest rows of a stored row, the row itself included."""
        return self.query(self.get_one(row_id, include_vectors=True)["vector"], top_k, **options)

    def stats(self) -> dict:
        state = self.store.state()
        kinds = {"wal": 0, "cluster": 0}
        for s in state["segments"]:
            kinds[s["kind"]] += 1
        empty = state["dim"] is None
        return {
            "name": self.store.name,
            "dim": state["dim"],
            "distance_metric": state["metric"],
            "rows": 0 if empty else self.store.count(state),
            "unindexed_rows": 0 if empty else self.store.unindexed(state).count(),
            "segments": kinds,
            "storage_bytes": sum(s["bytes"] for s in state["segments"]),
            "index": {"version": state["index_version"], "clusters": state["clusters"]} if state["index_version"] else None,
            "created_at": state["created_at"],
        }

    def segments(self) -> DataFrame:
        """The segments that the current state names: key, kind, version, cluster, seq, rows, bytes."""
        schema = "key string, kind string, version long, cluster long, seq long, rows long, bytes long"
        return self.spark.createDataFrame([tuple(s.get(c.split()[0]) for c in schema.split(", ")) for s in self.store.state()["segments"]], schema)

    # Writing

    def configure(self, distance_metric: str | None = None) -> dict:
        """Create the namespace, or choose its metric while it has no vectors."""
        if distance_metric is not None:
            check_metric(distance_metric)
        created = False

        def make(state: dict) -> dict | None:
            nonlocal created
            created = state["number"] == 0
            return _with_metric(state, distance_metric) if created or (distance_metric or state["metric"]) != state["metric"] else None

        self.store.change(make)
        return {"created": created}

    def upsert(
        self,
        rows: list[dict] | DataFrame,
        distance_metric: str | None = None,
        applied: tuple[str, int] | None = None,
        limit: int | None = validate.MAX_BATCH_ROWS,
        unique: bool | None = None,
    ) -> dict:
        """Insert or replace rows, vector and attributes both; of rows with one id the last counts.

        Up to 10,000 dicts (id, vector, attributes), or a DataFrame of any size with ``id``, ``vector`` and optionally
        ``attributes`` (JSON text, struct, map or variant) and ``pos``, which orders rows with one id. Whether ids repeat is
        found out from the ids alone, so that vectors are shuffled only if they do; ``unique`` tells it beforehand.
        """
        if distance_metric is not None:
            check_metric(distance_metric)
        created, count = False, 0
        prepared = None if isinstance(rows, DataFrame) else self.checked(validate.check_batch(rows, limit=limit or len(rows)))
        batch = _from_frame(rows, unique) if prepared is None else None

        def make(state: dict) -> tuple[DataFrame, dict]:
            nonlocal created
            created = state["number"] == 0
            changes = {"metric": _with_metric(state, distance_metric)["metric"]}
            if prepared is None:
                return batch, changes
            checked = {i: (i, UPSERT, validate.check_vector(v, state["dim"] or len(prepared[0][1])), a, n) for n, (i, v, a) in enumerate(prepared)}
            return self._frame(list(checked.values()), _BATCH), changes

        state = self.store.append(make, applied)
        count = len(prepared) if prepared is not None else (state["segments"][-1]["rows"] if state["segments"] else 0)
        return {"upserted": count, "created": created}

    def _frame(self, rows: list[tuple], schema: pa.Schema) -> DataFrame:
        """A small batch as one partition, handed over as Arrow columns."""
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
        return self.spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema)).coalesce(1)

    def checked(self, rows: list, dim: int | None = None) -> list[tuple[str, list[float], str | None]]:
        """Rows as (id, float32 vector, JSON text); all vectors as long as ``dim`` or as the first."""
        out = []
        for r in rows:
            if not isinstance(r, dict):
                refuse(f"a row is a JSON object, not {type(r).__name__}")
            vector = validate.check_vector(r.get("vector"), dim)
            dim = dim or len(vector)
            out.append((validate.check_id(r.get("id")), vector, validate.check_attributes(r.get("attributes"))))
        return out

    def patch(self, rows: list[dict]) -> dict:
        """Merge attributes shallowly (null removes a key) and replace vectors where given; ids that are not there are named."""
        rows = validate.check_batch(rows)
        folded: dict[str, dict] = {}
        order: list[str] = []
        for r in rows:
            if not isinstance(r, dict):
                refuse(f"a row is a JSON object, not {type(r).__name__}")
            row_id = validate.check_id(r.get("id"))
            order.append(row_id)
            own = folded.setdefault(row_id, {"vector": None, "attributes": None})
            if r.get("vector") is not None:
                own["vector"] = validate.check_vector(r["vector"], self.store.state()["dim"])
            elif "vector" in r:
                refuse("a patch may leave a vector out but not remove it")
            if "attributes" in r:
                if validate.check_attributes(r["attributes"]) is None:
                    refuse("a patch may leave attributes out but not remove them all at once")
                own["attributes"] = {**(own["attributes"] or {}), **r["attributes"]}
        found: set[str] = set()

        def make(state: dict) -> tuple[DataFrame, dict] | None:
            found.clear()
            given = [(i, p["vector"], None if p["attributes"] is None else json.dumps(p["attributes"], ensure_ascii=False), n) for n, (i, p) in enumerate(folded.items())]
            patches = self._frame(given, _PATCH)
            near = self.store.current(state).filter(F.col("id").isin(list(folded)))  # skips row groups by their ids
            both = near.join(F.broadcast(patches), "id")  # at most 10,000 patches
            attrs = F.when(F.col("patch").isNull(), F.col("attrs")).otherwise(merged(F.col("attrs"), F.col("patch")))
            done = both.select("id", F.lit(UPSERT).alias("op"), F.coalesce("new_vector", "vector").alias("vector"), attrs.alias("attrs"), "pos").collect()
            found.update(r.id for r in done)
            changed = [tuple(r) for r in done if folded[r.id]["vector"] is not None or folded[r.id]["attributes"] is not None]
            return (self._frame(changed, _BATCH), {}) if changed else None

        self.store.append(make)
        return {"patched": sum(i in found for i in order), "missing": [i for i in order if i not in found]}

    def delete(self, ids: list[str] | None = None, filters: object = None) -> dict:
        """Delete by ids, or else by filter; the number of rows that were there."""
        if ids is not None:
            wanted = sorted({validate.check_id(i) for i in validate.check_batch(ids, "ids")})
            test = F.col("id").isin(wanted)
        elif filters is not None:
            test = compile_filter(filters)
        else:
            refuse("nothing says which rows to delete: give ids, or a filter")
        before = self.store.state()

        def make(state: dict) -> tuple[DataFrame, dict] | None:
            if state["dim"] is None:
                return None
            gone = self.store.current(state).filter(test).select("id", F.lit(DELETE).alias("op"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("attrs"), F.lit(0).cast("long").alias("pos"))
            return gone, {}

        state = self.store.append(make)
        return {"deleted": state["segments"][-1]["rows"] if state["seq"] > before["seq"] and state["segments"] and state["segments"][-1]["seq"] == state["seq"] else 0}

    def delete_where(self, filters: object) -> dict:
        return self.delete(filters=filters)

    def build_index(self, force: bool = True, **clusters: int | None) -> dict:
        """Index all rows; ``max_clusters`` (None: no bound) and ``cluster_rows`` change the number of clusters."""
        return ivf.build_index(self.store, force, **clusters)

    def nprobe_for(self, recall: float, top_k: int = 10, distance_metric: str | None = None) -> int:
        """The ``nprobe`` with which queries like the stored rows find this share of their nearest rows."""
        state = self.store.state()
        return nprobe_for(self.store, state, recall, validate.clamp_top_k(top_k), distance_metric or state["metric"])

    def maybe_build(self) -> dict:
        """Build only if the log has grown enough."""
        return self.build_index(force=False)

    def destroy(self) -> dict:
        return {"deleted_objects": self.store.destroy()}


class _Observed:
    """A store whose live rows are counted as they are scored."""

    def __init__(self, store: Store, seen: Observation):
        self.store, self.seen = store, seen

    def current(self, state: dict, clusters: list[int] | None = None) -> DataFrame:
        return _Counted(self.store.current(state, clusters), self.seen)

    def centroids(self, state: dict) -> list[list[float]]:
        return self.store.centroids(state)


class _Counted:
    """Stands for a DataFrame until its filter is known: the count belongs after it."""

    def __init__(self, rows: DataFrame, seen: Observation):
        self.rows, self.seen = rows, seen

    def filter(self, test) -> _Counted:
        return _Counted(self.rows.filter(test), self.seen)

    def select(self, *columns) -> DataFrame:
        return self.rows.observe(self.seen, F.count(F.lit(1)).alias("n")).select(*columns)


def _with_metric(state: dict, metric: str | None) -> dict:
    if metric is not None and metric != state["metric"]:
        if state["dim"] is not None:
            refuse(f"the namespace holds vectors under {state['metric']}, so its metric stays", 409)
        state["metric"] = metric
    return state


def _from_frame(rows: DataFrame, unique: bool | None) -> DataFrame:
    """A batch from a DataFrame: one row per id, attributes as JSON text."""
    kinds = dict(rows.dtypes)
    if "attributes" not in kinds or kinds["attributes"] == "void":
        attrs = F.lit(None).cast("string")
    else:
        attrs = F.col("attributes") if kinds["attributes"] == "string" else F.to_json("attributes")
    pos = F.col("pos").cast("long") if "pos" in kinds else F.monotonically_increasing_id()
    batch = rows.select(F.col("id").cast("string").alias("id"), F.lit(UPSERT).alias("op"), F.col("vector").cast("array<float>").alias("vector"), attrs.alias("attrs"), pos.alias("pos"))
    if unique is None:
        unique = batch.groupBy("id").count().filter("count > 1").isEmpty()
    return batch if unique else by_id(batch, F.col("pos")).select("id", "op", "vector", "attrs", "pos")


def _stored(row) -> dict:
    out = {"id": row.id, "attributes": None if row.attrs is None else json.loads(row.attrs)}
    return out | ({"vector": list(row.vector)} if "vector" in row else {})


def _found(row) -> dict:
    out = row.asDict()
    return out | ({"attributes": json.loads(out["attributes"])} if "attributes" in out else {})


def _query_stats(took: int, segments: int, scored: int, exhaustive: bool, version: int, hits: int, misses: int) -> dict:
    """Cache figures count file listings and centroids that the store remembers or not; candidates are live before they are scored."""
    return {
        "took_ms": took, "segments_scanned": segments, "vectors_scored": scored, "cache_hits": hits, "cache_misses": misses,
        "exhaustive": exhaustive, "index_version": version, "stale_candidates": 0,
    }


__all__ = ["Engine", "EngineError", "Namespace"]
