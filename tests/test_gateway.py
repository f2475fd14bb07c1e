"""Routes, errors, authorisation, group commit and the HTTP server."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from lodestone.api import Engine
from lodestone.gateway import Gateway, server
from lodestone.operators import ivf


@pytest.fixture(scope="module")
def gateway(spark, tmp_path_factory):
    return Gateway(Engine(spark, f"file://{tmp_path_factory.mktemp('gateway')}"), api_key="secret", auto_index=False)


def call(gateway, method, path, body=None, key="Bearer secret"):
    return gateway.handle(method, path, "" if body is None else json.dumps(body), key)


def test_routes(gateway):
    ok = lambda *a: (lambda r: r[1] if r[0] == 200 else pytest.fail(str(r)))(call(gateway, *a))
    ns = "/v1/namespaces/demo"
    assert ok("PUT", ns, {"distance_metric": "euclidean_squared"}) == {"name": "demo", "created": True}
    rows = [{"id": "a", "vector": [1, 0], "attributes": {"n": 1}}, {"id": "ü/ñ", "vector": [0, 1]}, {"id": "c", "vector": [3, 4], "attributes": {"n": 3}}]
    assert ok("POST", f"{ns}/upsert", {"rows": rows}) == {"upserted": 3}
    found = ok("POST", f"{ns}/query", {"vector": [1, 0], "top_k": 2, "filters": ["n", "Gt", 0], "include_attributes": True})
    assert [(r["id"], r["dist"], r["attributes"]) for r in found["rows"]] == [("a", 0, {"n": 1}), ("c", 20, {"n": 3})]
    assert found["stats"]["exhaustive"] is True
    assert ok("POST", f"{ns}/patch", {"rows": [{"id": "a", "attributes": {"n": 2}}, {"id": "x", "attributes": {}}]}) == {"patched": 1, "missing": ["x"]}
    assert ok("GET", f"{ns}/rows/a?include_vectors=true") == {"id": "a", "attributes": {"n": 2}, "vector": [1, 0]}
    assert ok("GET", f"{ns}/rows/%C3%BC%2F%C3%B1") == {"id": "ü/ñ", "attributes": None}
    assert [r["id"] for r in ok("POST", f"{ns}/rows", {"ids": ["c", "a", "zz"]})["rows"]] == ["a", "c"]
    page = ok("GET", f"{ns}/rows?limit=2")
    assert [r["id"] for r in page["rows"]] == ["a", "c"] and page["next_cursor"] == "c"
    assert [r["id"] for r in ok("GET", f"{ns}/rows?cursor=c&limit=x")["rows"]] == ["ü/ñ"]
    assert ok("POST", f"{ns}/index")["status"] == "built"
    assert ok("POST", f"{ns}/index", {"force": False}) == {"status": "skipped", "reason": "below threshold"}
    assert ok("POST", f"{ns}/delete", {"ids": ["a", "zz"]}) == {"deleted": 1}
    assert ok("POST", f"{ns}/delete", {"filters": ["n", "Eq", 3]}) == {"deleted": 1}
    assert ok("GET", ns)["rows"] == 1 and [x["name"] for x in ok("GET", "/v1/namespaces")["namespaces"]] == ["demo"]
    assert ok("DELETE", ns)["name"] == "demo" and ok("GET", "/v1/namespaces") == {"namespaces": []}


def test_errors(gateway):
    assert gateway.handle("GET", "/")[0] == 200
    for status, method, path, body, key in [
        (401, "GET", "/v1/namespaces", None, "Bearer wrong"), (401, "GET", "/v1/namespaces", None, None), (404, "GET", "/nothing", None, "Bearer secret"),
        (404, "GET", "/v1/namespaces/x/what", None, "Bearer secret"), (400, "GET", "/v1/namespaces/-x", None, "Bearer secret"), (404, "GET", "/v1/namespaces/x/rows/none", None, "Bearer secret"),
        (400, "POST", "/v1/namespaces/x/upsert", None, "Bearer secret"), (400, "POST", "/v1/namespaces/x/upsert", {"rows": []}, "Bearer secret"), (400, "POST", "/v1/namespaces/x/delete", {}, "Bearer secret"),
        (400, "POST", "/v1/namespaces/x/rows", {}, "Bearer secret"), (400, "PUT", "/v1/namespaces/x", {"distance_metric": "z"}, "Bearer secret"),
    ]:
        got = call(gateway, method, path, body, key)
        assert got[0] == status and "error" in got[1], (path, got)
    assert gateway.handle("POST", "/v1/namespaces/x/query", "{", "Bearer secret")[0] == 400


def test_odd_numbers(gateway):
    ns = "/v1/namespaces/numbers"
    call(gateway, "POST", f"{ns}/upsert", {"rows": [{"id": f"{i}", "vector": [i, 1]} for i in range(3)]})
    for limit, n in (("Infinity", 3), ("-Infinity", 1), ("nan", 3), ("2.9", 2), ("0", 3)):
        status, found = call(gateway, "GET", f"{ns}/rows?limit={limit}")
        assert (status, len(found["rows"])) == (200, n), limit
    for _ in range(2):  # without an index and with one
        for nprobe in ("many", [1], True):
            assert call(gateway, "POST", f"{ns}/query", {"vector": [1, 0], "nprobe": nprobe})[0] == 400
        assert len(call(gateway, "POST", f"{ns}/query", {"vector": [1, 0], "nprobe": 0.5})[1]["rows"]) == 3
        call(gateway, "POST", f"{ns}/index")


def test_no_key_serves_nobody(gateway):
    shut = Gateway(gateway.engine)
    assert shut.handle("GET", "/")[0] == 200
    assert [shut.handle("GET", "/v1/namespaces", "", key)[0] for key in (None, "Bearer ", "Bearer x")] == [500] * 3


def test_skipped_builds_do_not_hold_up_others(gateway, monkeypatch):
    """An automatic build that will be skipped neither waits for the lock nor takes it."""
    ns = gateway.engine.namespace("waits")
    ns.upsert([{"id": "a", "vector": [1.0]}])
    monkeypatch.setattr(ivf, "_building", {ns.store.home})
    assert ns.maybe_build() == {"status": "skipped", "reason": "below threshold"}
    assert ivf._building == {ns.store.home}


def test_failed_background_builds_are_logged(gateway, monkeypatch, caplog):
    ns = gateway.engine.namespace("fails")
    monkeypatch.setattr(type(ns), "maybe_build", lambda self: 1 / 0)
    gateway._index(ns)
    assert "fails" in caplog.text and "ZeroDivisionError" in caplog.text


def test_group_commit(gateway):
    done = []

    def write(i):
        done.append(call(gateway, "POST", "/v1/namespaces/grouped/upsert", {"rows": [{"id": f"r{i}", "vector": [i, 1]}, {"id": "same", "vector": [i, i]}]}))

    call(gateway, "POST", "/v1/namespaces/grouped/upsert", {"rows": [{"id": "first", "vector": [0, 0]}]})
    threads = [threading.Thread(target=write, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {s for s, _ in done} == {200} and all(r == {"upserted": 2} for _, r in done)
    ns = gateway.engine.namespace("grouped")
    assert ns.stats()["rows"] == 10 and ns.store.state()["seq"] < 9
    assert call(gateway, "POST", "/v1/namespaces/grouped/upsert", {"rows": [{"id": "z", "vector": [1]}]})[0] == 400


def test_one_build_at_a_time(gateway, monkeypatch):
    ns = gateway.engine.namespace("single")
    ns.upsert([{"id": "a", "vector": [1.0]}])
    monkeypatch.setattr(ivf, "_building", {ns.store.home})
    assert ns.build_index() == {"status": "already_running"}


def test_server(gateway):
    http = server(gateway, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    try:
        request = urllib.request.Request(f"{base}/v1/namespaces/web/upsert", json.dumps({"rows": [{"id": "a", "vector": [1, 2]}]}).encode(), {"Authorization": "Bearer secret"})
        assert json.loads(urllib.request.urlopen(request, timeout=60).read()) == {"upserted": 1}
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{base}/v1/namespaces", timeout=60)
        assert e.value.code == 401
    finally:
        http.shutdown()
