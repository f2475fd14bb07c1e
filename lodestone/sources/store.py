"""Log-structured Parquet store of one namespace.

Layout under ``<root>/<name>/``::

    _meta/000000000007.json     state after the 7th commit; the highest number is current
    log/<seq>-<id>/             one committed batch: id, op, vector, attrs, seq, pos
    index/v=<n>-<id>/cluster=<c>/  rows of an index version: id, vector, attrs

A commit writes its data first and then publishes the next state under a name that must not exist yet, so
writers are serialised, a failed write leaves only files that no state names, and a reader sees one state for its
whole query. Current rows are the index version without ids that the log tail mentions, and the last
write of each id in the tail. Files that a state stops naming are deleted one build later, so queries that
started before still find them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import refuse
from ..functions.metrics import COSINE
from ..validate import bad_row, check_name, wrong_size
from .files import Files

LOG = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("op", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("attrs", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("pos", T.LongType()),
])
ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("attrs", T.StringType())])
INDEX = T.StructType([*ROW.fields, T.StructField("cluster", T.IntegerType())])
UPSERT, DELETE = "upsert", "delete"
KEPT_STATES = 20
ATTEMPTS = 8
#: Ids of the log tail that are broadcast to the index rows (at most 256 bytes each); a longer tail is joined by shuffling.
BROADCAST_IDS = 100_000
#: Readers that a store remembers; files never change once a state names them, so their listing stays true.
READERS = 8


class Store:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), check_name(name)
        self.files = Files(spark)
        self.home = f"{self.root}/{name}"
        self.readers: dict[tuple[str, ...], DataFrame] = {}
        self.routes: tuple[str, list[list[float]]] | None = None
        self.known: tuple[int, dict] | None = None  # when the last state that was read was written, and the state
        self.hits = self.misses = 0  # of file listings and centroids that are remembered

    # States

    def _file(self, number: int) -> str:
        return f"{self.home}/_meta/{number:012d}.json"

    def _empty(self) -> dict:
        return {
            "number": 0, "name": self.name, "dim": None, "metric": COSINE, "seq": 0, "created_at": None, "index_version": 0,
            "build_seq": 0, "clusters": 0, "centroids": None, "index_path": None, "segments": [], "retired": [], "applied": {},
        }

    def state(self) -> dict:
        """The current state; that of an unknown namespace is empty, and reading it creates nothing.

        States are numbered without gaps, so the last one seen is current if it is still there and has no successor.
        """
        if self.known:
            written, state = self.known
            if self.files.written(self._file(state["number"])) == written and not self.files.exists(self._file(state["number"] + 1)):
                return dict(state)
        states = [n for n in self.files.names(f"{self.home}/_meta") if n.endswith(".json") and not n.startswith(".")]
        if not states:
            self.known = None
            return self._empty()
        state = json.loads(self.files.read(f"{self.home}/_meta/{states[-1]}"))
        self.known = (self.files.written(self._file(state["number"])), state)
        return dict(state)

    @property
    def exists(self) -> bool:
        return self.state()["number"] > 0

    def publish(self, state: dict) -> bool:
        """Make ``state`` the successor of the state it was made from; False if another writer was first."""
        state = state | {"number": state["number"] + 1, "created_at": state["created_at"] or int(time.time() * 1000)}
        done = self.files.create(self._file(state["number"]), json.dumps(state))
        if done and state["number"] % KEPT_STATES == 0:
            for old in self.files.names(f"{self.home}/_meta")[:-KEPT_STATES]:
                self.files.delete(f"{self.home}/_meta/{old}")
        return done

    def change(self, make: Callable[[dict], dict | None]) -> dict:
        """Apply a change of state, again on a newer state if another writer commits in between; None changes nothing."""
        for _ in range(ATTEMPTS):
            state = self.state()
            wanted = make(dict(state))
            if wanted is None or self.publish(wanted):
                return wanted or state
        refuse(f"other writers were first {ATTEMPTS} times; try again", 409)

    # Reading

    def _count(self, hit: bool) -> None:
        self.hits, self.misses = self.hits + hit, self.misses + (not hit)

    def _read(self, schema: T.StructType, *paths: str) -> DataFrame:
        """Files that a state names; they are listed once."""
        self._count(paths in self.readers)
        if paths not in self.readers:
            while len(self.readers) >= READERS:
                del self.readers[next(iter(self.readers))]
            self.readers[paths] = self.spark.read.schema(schema).parquet(*paths)
        return self.readers[paths]

    def tail(self, state: dict) -> DataFrame:
        """All log rows that the index does not hold yet."""
        paths = [f"{self.home}/{s['key']}" for s in state["segments"] if s["kind"] == "wal"]
        return self._read(LOG, *paths) if paths else self.spark.createDataFrame([], LOG)

    def latest_tail(self, state: dict) -> DataFrame:
        """The last write of each id in the tail, tombstones included; a batch holds an id once."""
        tail = self.tail(state)
        if sum(s["kind"] == "wal" for s in state["segments"]) < 2:
            return tail
        order = F.struct("seq", "pos")
        # Aggregated on the map side first; the row travels with its order.
        last = tail.groupBy("id").agg(F.max_by(F.struct("op", "vector", "attrs", "seq", "pos"), order).alias("r"))
        return last.select("id", "r.op", "r.vector", "r.attrs", "r.seq", "r.pos")

    def indexed(self, state: dict, clusters: list[int] | None = None) -> DataFrame:
        """Rows of the index version, or of some of its clusters (a partition filter)."""
        if not state["index_version"]:
            return self.spark.createDataFrame([], INDEX)
        rows = self._read(INDEX, f"{self.home}/{state['index_path']}")
        return rows if clusters is None else rows.filter(F.col("cluster").isin(clusters))

    def current(self, state: dict, clusters: list[int] | None = None, with_cluster: bool = False) -> DataFrame:
        """Live rows (id, vector, attrs and, if asked for, cluster: -1 in the log tail); with ``clusters``, those of the index only from these."""
        has_tail = any(s["kind"] == "wal" for s in state["segments"])
        tail = self.latest_tail(state)
        live = tail.filter(F.col("op") == UPSERT).select("id", "vector", "attrs", *([F.lit(-1).alias("cluster")] if with_cluster else []))
        if not state["index_version"]:
            return live
        rows = self.indexed(state, clusters).select(*live.columns)
        if not has_tail:
            return rows
        ids = tail.select("id")
        if sum(s["rows"] for s in state["segments"] if s["kind"] == "wal") <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        return rows.join(ids, "id", "left_anti").select(*live.columns).unionByName(live)

    def count(self, state: dict) -> int:
        """Number of live rows; without a log tail the state knows it."""
        if any(s["kind"] == "wal" for s in state["segments"]):
            return self.current(state).count()
        return sum(s["rows"] for s in state["segments"])

    def centroids(self, state: dict) -> list[list[float]]:
        """Centroids of the index version, read once."""
        path = f"{self.home}/{state['centroids']}"
        self._count(self.routes is not None and self.routes[0] == path)
        if self.routes is None or self.routes[0] != path:
            self.routes = (path, json.loads(self.files.read(path)))
        return self.routes[1]

    def unindexed(self, state: dict) -> DataFrame:
        return self.latest_tail(state).filter(F.col("op") == UPSERT).select("id", "vector", "attrs")

    # Writing

    def write_batch(self, rows: DataFrame, seq: int) -> dict:
        """Write (id, op, vector, attrs, pos) as a log segment that no state names yet, checking every row on the way."""
        key = f"log/{seq:012d}-{uuid.uuid4().hex[:8]}"
        size = F.when(F.col("op") == UPSERT, F.size("vector"))
        fault = F.when(F.col("op") == UPSERT, bad_row(F.size("vector")))
        seen = Observation(f"batch-{uuid.uuid4().hex}")
        checked = rows.select("id", "op", F.col("vector").cast("array<float>").alias("vector"), "attrs", F.lit(seq).cast("long").alias("seq"), F.col("pos").cast("long").alias("pos"))
        checked = checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(fault).alias("fault"), F.min(size).alias("least"), F.max(size).alias("most"))
        checked.write.parquet(f"{self.home}/{key}")
        got = seen.get
        return {"key": key, "kind": "wal", "version": 0, "cluster": None, "seq": seq, "rows": got["rows"], "fault": got["fault"], "least": got["least"], "most": got["most"],
                "bytes": sum(n for p, n in self.files.files_below(f"{self.home}/{key}") if p.endswith(".parquet"))}

    def append(self, make: Callable[[dict], tuple[DataFrame, dict] | None], applied: tuple[str, int] | None = None) -> dict:
        """Commit one batch. ``make`` gets the state it will follow and returns the batch and changes of state.

        The whole batch is checked before anything is published; on a fault nothing changes. ``applied`` names a
        stream and its batch number; a batch that was applied before is skipped.
        """
        for _ in range(ATTEMPTS):
            state = self.state()
            if applied and state["applied"].get(applied[0], -1) >= applied[1]:
                return state
            made = make(dict(state))
            if made is None:
                return state
            rows, changes = made
            segment = self.write_batch(rows, state["seq"] + 1)
            dim = state["dim"] or segment["least"]
            fault = segment.pop("fault")
            least, most = segment.pop("least"), segment.pop("most")
            if fault or (most is not None and not least == most == dim):
                self.files.delete(f"{self.home}/{segment['key']}")
                refuse(fault or wrong_size(most if most != dim else least, dim))
            wanted = state | changes | {"dim": dim, "seq": segment["seq"]}
            if segment["rows"]:
                wanted["segments"] = [*state["segments"], segment]
            if applied:
                wanted["applied"] = state["applied"] | {applied[0]: applied[1]}
            if self.publish(wanted):
                return wanted
            self.files.delete(f"{self.home}/{segment['key']}")
        refuse(f"other writers were first {ATTEMPTS} times; try again", 409)

    def destroy(self) -> int:
        """Delete the namespace; the number of data files that went."""
        n = sum(p.endswith(".parquet") for p, _ in self.files.files_below(self.home))
        self.files.delete(self.home)
        return n


def by_id(rows: DataFrame, order: Column) -> DataFrame:
    """The last row of each id."""
    others = [c for c in rows.columns if c != "id"]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("r"))
    return last.select("id", *[F.col(f"r.{c}").alias(c) for c in others])
