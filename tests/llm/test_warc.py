"""WARC archives: round trip, revisits and lookups."""

import gzip
import hashlib
from pathlib import Path

import pytest

from lodestone.llm import warc
from lodestone.llm.warc import lookup, parse, read_archives, record, search, surt, write_archives

BIG, OTHER = "x" * 1000, "é" * 500
ROWS = [
    (1, "http://b.example.com/2", BIG), (5, "http://a.example.com/1?q=1", BIG), (3, None, BIG), (2, "http://a.example.com/1?q=1", OTHER),
    (9, "https://c.org", OTHER), (4, "http://c.org", "x" * 999), (6, "http://c.org", "x" * 999), (7, "no scheme", None), (8, "", ""),
    (None, "http://n.org/a\r\nb", BIG), (10, "http://big.org/", "y" * 3_000_000), (5, "http://a.example.com/1?q=1", BIG),
    (11, "http://d.org/\u2028", "\r\n\r\nWARC/1.1\r\n\r\n" * 100), (None, None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "z", 7) for r in rows], "page_id long, url string, html string, digest string, key int")


def want(rows):
    keep = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            keep[h] = max(keep.get(h, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        k = keep.get(h)
        same = k is None or k == i
        out.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "response" if same else "revisit", None if same else str(k)))
    return sorted(out, key=str)


def test_round_trip_through_the_index(pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    monkeypatch.setattr(warc, "READ_BYTES", 2000)
    root, directory = write_archives(pages(ROWS))
    got = read_archives(root, directory).collect()
    assert sorted(((str(r.id), r.bytes, r.digest, r.type, r.refers) for r in got), key=str) == want(ROWS)
    texts = {(r.id, hashlib.sha1(bytes(r.payload)).hexdigest()) for r in got if r.type == "response"}
    assert texts == {(r.id, r.digest) for r in got if r.type == "response"}
    blocks = directory.collect()
    assert sum(b.lines for b in blocks) == len(ROWS) and all(b.first <= b.last for b in blocks)
    # Every key once, or several times, finds every record once; so does a walk of the directory.
    keys = pages(ROWS).select(surt("url").alias("key"))
    for payloads in (True, False):
        found = search(root, directory, keys, payloads).collect()
        assert sorted(((str(r.id), r.bytes, r.digest, r.type, r.refers) for r in found), key=str) == want(ROWS)
        assert all((r.payload is not None) == (payloads and r.type == "response") for r in found)
    found = lookup(root, directory, ["HTTP://A.example.com/1?q=1", "http://c.org", "http://absent.org/"]).collect()
    assert sorted(int(r.id) for r in found) == [2, 4, 5, 5, 6, 9]
    assert lookup(root, directory, []).count() == 0
    # Archives are plain gzip files of WARC records.
    for path in Path(root.removeprefix("file://")).glob("*.warc.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_empty_table(pages):
    root, directory = write_archives(pages([]))
    assert directory.count() == 0 and read_archives(root, directory).count() == 0
    assert lookup(root, directory, ["http://c.org"]).count() == 0


def test_one_url_over_many_archives_and_blocks(pages, monkeypatch, spark):
    """A URL of most rows is cut into several archives and blocks, and a search finds all of them."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(i, "http://hot.org/" if i % 4 else f"http://h{i}.org/a b", f"<p>{i}") for i in range(200)]
    root, directory = write_archives(pages(rows))
    hot = directory.filter("first <= 'org,hot)/' and last >= 'org,hot)/'")
    assert hot.select("archive").distinct().count() > 1
    found = lookup(root, directory, ["http://hot.org/", "http://h8.org/a b", "http://h8.org/"]).collect()
    assert sorted(int(r.id) for r in found) == sorted([8, *(i for i in range(200) if i % 4)])
    assert {r.url for r in found} == {"http://hot.org/", "http://h8.org/a%20b"}


def test_surt(pages):
    urls = ["http://www.Example.com:80/A?b#c", "https://x.org", None, "plain", "a://?q"]
    got = pages([(i, u, None) for i, u in enumerate(urls)]).orderBy("page_id").select(surt("url")).collect()
    assert [r[0] for r in got] == ["com,example,www):80/a?b#c", "org,x)", "", "plain", ")?q"]


def test_damaged_record_is_noticed():
    raw = record(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert parse(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        parse(raw.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))
