"""Structured Streaming into and out of a namespace."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..api import Namespace
from ..functions.metrics import check_metric
from ..operators.knn import SCORERS


def upsert_sink(namespace: Namespace, stream: str, build: bool = False) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch is one commit that remembers its number, so a replayed batch is skipped."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            namespace.upsert(batch, applied=(stream, number))
            if build:
                namespace.maybe_build()

    return write


def write_stream(rows: DataFrame, namespace: Namespace, stream: str, checkpoint: str, build: bool = False) -> DataStreamWriter:
    """A writer of a streaming DataFrame (id, vector, attributes) into a namespace; set a trigger and start it."""
    return rows.writeStream.foreachBatch(upsert_sink(namespace, stream, build)).option("checkpointLocation", checkpoint)


def read_changes(spark: SparkSession, namespace: Namespace) -> DataFrame:
    """A stream of the namespace's log rows (id, op, vector, attrs, seq, pos) as commits write them."""
    from ..sources.store import LOG

    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{namespace.store.home}/log")


def score_stream(rows: DataFrame, query: list[float], metric: str, limit: float, scorer: str = "arrow") -> DataFrame:
    """Streaming rows within ``limit`` of a standing query: dist at most it, or at least it for the dot product."""
    from ..functions.metrics import lower_is_better

    scored = rows.withColumn("dist", SCORERS[scorer]("vector", query, check_metric(metric)))
    return scored.filter(scored.dist <= limit if lower_is_better(metric) else scored.dist >= limit)
