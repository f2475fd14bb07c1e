"""Metrics, attributes, JSON helpers, k-means and analysis."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.errors import EngineError
from lodestone.functions import attributes as A
from lodestone.functions import jsontext as J
from lodestone.functions import metrics as M
from lodestone.operators import analysis, knn
from lodestone.operators import kmeans as km
from lodestone.operators.kmeans import cluster_count, kmeans, nearest_centroids, sample_size, unit


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [2.0, 0.0]), ("z", [0.0, 0.0])]
    return spark.createDataFrame(data, "id string, vector array<float>")


@pytest.mark.parametrize("scorer", ["arrow", "expression"])
def test_metrics(rows, scorer):
    want = {M.COSINE: {"a": 1, "b": 0, "c": 0, "z": 1}, M.EUCLIDEAN: {"a": 2, "b": 0, "c": 1, "z": 1}, M.DOT: {"a": 0, "b": 1, "c": 2, "z": 0}}
    for metric, dists in want.items():
        got = {r.id: r.d for r in rows.select("id", M.SCORERS[scorer]("vector", [1.0, 0.0], metric).alias("d")).collect()}
        assert got == pytest.approx(dists)
        assert {r.d for r in rows.select(M.SCORERS[scorer]("vector", [0.0, 0.0], M.COSINE).alias("d")).collect()} == {1.0}
    with pytest.raises(EngineError):
        M.expression("vector", [1.0], "manhattan")


def test_metrics_agree_on_random_vectors(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 33)).astype(np.float32)
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(m)], "id string, vector array<float>")
    q = m[3].astype(float).tolist()
    for metric in M.METRICS:
        a, b = (dict(df.select("id", M.SCORERS[s]("vector", q, metric)).collect()) for s in ("arrow", "expression"))
        assert a == pytest.approx(b, abs=1e-9)
        own = M.numpy_distances(m.astype(float), np.array([q]), metric)[:, 0]
        assert [b[str(i)] for i in range(50)] == pytest.approx(own.tolist(), abs=1e-9)


def test_top_k_order_and_plan(rows):
    assert [r.id for r in knn.top_k(rows, [1.0, 0.0], 3, M.COSINE).collect()] == ["b", "c", "a"]
    best = knn.top_k(rows, [1.0, 0.0], 2, M.DOT)
    assert [r.id for r in best.collect()] == ["c", "b"]
    assert "TakeOrderedAndProject" in best._jdf.queryExecution().executedPlan().toString()


def test_knn_join_batches_and_ties(spark):
    data = [(f"{i:03}", [float(i // 3), 0.0]) for i in range(90)]
    df = spark.createDataFrame(data, "id string, vector array<float>").repartition(5)
    asked = df.filter(F.col("id").isin("000", "045", "089"))
    want = {q: sorted((((i // 3) - int(q) // 3) ** 2, f"{i:03}") for i in range(90))[:4] for q in ("000", "045", "089")}
    for size in (1, 1 << 20):
        got = {}
        for r in knn.knn_join(df, asked, 4, M.EUCLIDEAN, query_bytes=size).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append((r.dist, r.id))
        assert got == want
    assert knn.knn_join(df.limit(0), asked, 3, M.DOT).count() == 0 and knn.knn_join(df, asked.limit(0), 3, M.DOT).count() == 0


def test_norms(rows):
    got = {r.id: r for r in rows.select("id", M.norm("vector").alias("n"), M.normalized("vector").alias("u"), *M.summary("vector")).collect()}
    assert got["c"].n == 2 and got["c"].u == [1.0, 0.0] and got["z"].u == [0.0, 0.0]
    assert (got["a"].dims, got["a"].mean, got["a"].min, got["a"].max, got["a"].norm) == (2, 0.5, 0, 1, 1)


def test_attributes(spark):
    df = spark.createDataFrame([('{"a":1,"b":null,"c.d":[1,"x"],"e":{"f":null}}', '{"a":null,"b":2,"g":{"h":null}}'), (None, '{"k":true}')], "attrs string, patch string")
    merged = [json.loads(r[0]) for r in df.select(A.merged(F.col("attrs"), F.col("patch"))).collect()]
    assert merged == [{"b": 2, "c.d": [1, "x"], "e": {"f": None}, "g": {"h": None}}, {"k": True}]
    picked = [json.loads(r[0]) for r in df.select(A.pick("attrs", ["b", "c.d", "none"])).collect()]
    assert picked == [{"b": None, "c.d": [1, "x"]}, {}]
    assert sorted(r.key for r in analysis.category_keys(df).collect()) == ["a"]


def test_json_text():
    bad = J.lint('{"a": 1,\n "b": }')
    assert not bad.ok and (bad.line, bad.column) == (2, 7) and bad.offset == 15
    assert J.lint("[1, NaN]").ok is False and J.lint("3").value == 3
    for text, value in (("5", 5), (" true ", True), ("null", None), ('"5"', "5"), ("[1]", [1]), ("abc", "abc"), ("", ""), ("1.5x", "1.5x")):
        assert J.infer_value(text) == value
    for value in (5, "5", "abc", True, None, [1, {"a": 2}], "true", '"q"', ""):
        assert J.infer_value(J.value_to_field(value)) == value
    assert [J.describe(v) for v in ([1, 2], {"a": 1}, {}, "s", 1, 2.5, True, None)] == ["list (2)", "object (1)", "object (0)", "text", "number", "number", "truth value", "null"]
    assert J.attribute_patch({"a": 1, "b": 2}, {"a": 3}) == {"a": 3, "b": None} and J.attribute_patch(None, {"x": 1}) == {"x": 1}


def test_kmeans():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.random((50, 2)) + 10, rng.random((50, 2)) - 10])
    c = kmeans(data, 2)
    assert sorted(np.sign(c[:, 0]).tolist()) == [-1, 1] and np.abs(np.abs(c) - 10).max() < 1
    assert nearest_centroids(c, np.array([10.0, 10.0]), 1) == [int(c[:, 0].argmax())]
    assert cluster_count(20_000, 768) == 79 and cluster_count(1, 8) == 1 and cluster_count(10**9, 768) == 256
    assert sample_size(100, 8) == 100 and sample_size(10**6, 8192) == 256
    same = kmeans(np.ones((8, 3)), 4)
    assert np.isfinite(same).all() and unit(np.zeros((1, 3))).tolist() == [[0, 0, 0]]


def test_clusters_without_a_bound(monkeypatch):
    """The number of clusters follows the rows and bytes at any size; nearest centroids are the same for a few rows at a time."""
    assert cluster_count(120_000, 64, None) == 469 and cluster_count(10**9, 768, None) == 3_906_250 and cluster_count(1, 8, None) == 1
    rng = np.random.default_rng(2)
    rows, centroids = rng.random((100, 4)), rng.random((30, 4))
    whole = km.nearest(rows, centroids)
    monkeypatch.setattr(km, "DISTANCES", 200)
    assert whole[0].tolist() == km.nearest(rows, centroids)[0].tolist() and np.allclose(whole[1], km.nearest(rows, centroids)[1])


def test_analysis(spark):
    values = spark.createDataFrame([(float(i),) for i in [5, 1, 3, 2, 4, 9, 7, 8, 6, 10]] + [(None,)], "v double")
    shares = [0.0, 0.5, 0.9, 0.99, 1.0]
    assert dict(analysis.percentile_nearest(values.repartition(3), "v", shares).collect()) == {p: 1 + math.floor(9 * p) for p in shares}
    assert analysis.percentile_nearest(values.limit(0), "v", [0.5]).count() == 0
    line = np.array([[t, 2 * t, 0.0] for t in range(-5, 6)])
    points = analysis.pca2d(line)
    assert np.abs(points[:, 1]).max() < 1e-9 and np.abs(points[:, 0]) == pytest.approx(np.abs(np.arange(-5, 6)) * math.sqrt(5))
    with pytest.raises(EngineError):
        analysis.pca2d_rows(spark.createDataFrame([("a", [1.0])], "id string, vector array<float>"))
    found = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, id string")
    exact = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "a")], "query_id string, id string")
    assert dict(knn.recall_at_k(found, exact, 2).collect()) == {"q": 0.5, "r": 0.0}
