"""Streams into and over a namespace."""

import pytest
from pyspark.sql import functions as F

from lodestone.api import Engine
from lodestone.streaming.ingest import read_changes, score_stream, upsert_sink, write_stream


@pytest.fixture()
def namespace(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store").namespace("streamed")


def source(spark, tmp_path, batches):
    folder = tmp_path / "in"
    for rows in batches:
        spark.createDataFrame(rows, "id string, vector array<float>, attributes string").coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("id string, vector array<float>, attributes string").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_micro_batches_are_commits(spark, tmp_path, namespace):
    stream = source(spark, tmp_path, [[("a", [1.0, 0.0], '{"n":1}')], [("b", [0.0, 1.0], None)], [("c", [1.0, 1.0], None)]])
    q = write_stream(stream, namespace, "s", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert namespace.stats()["rows"] == 3 and namespace.store.state()["seq"] == 3
    changes = read_changes(spark, namespace).filter(F.col("op") == "upsert").writeStream.format("memory").queryName("changes").trigger(availableNow=True).start()
    changes.awaitTermination(120)
    assert spark.sql("select count(distinct id) from changes").first()[0] == 3


def test_replayed_batches_are_skipped(spark, namespace):
    sink = upsert_sink(namespace, "s")
    one = spark.createDataFrame([("a", [1.0])], "id string, vector array<float>")
    two = spark.createDataFrame([("a", [2.0])], "id string, vector array<float>")
    sink(one, 0)
    sink(two, 1)
    sink(one, 0)
    sink(one.limit(0), 2)
    assert namespace.get_one("a", True)["vector"] == [2.0] and namespace.store.state()["seq"] == 2


def test_standing_query(spark, tmp_path):
    stream = source(spark, tmp_path, [[("a", [1.0, 0.0], None), ("b", [0.0, 1.0], None)]])
    near = score_stream(stream, [1.0, 0.0], "cosine_distance", 0.5)
    q = near.writeStream.format("memory").queryName("near").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.id for r in spark.sql("select id from near").collect()] == ["a"]
