"""WARC archives with a two-level capture index.

Pages are put in the order of their reversed-host (SURT) keys, range by range. Each task writes one archive, a gzip member per
record, and beside it a capture file: sorted capture lines in compressed blocks of BLOCK_LINES. The sparse
block directory has one row per block (first and last key, where the block is, which archive it points
into) and is an ordinary table. A search bisects the archives' key ranges, then the directory rows of an archive, reads one block by its
byte range, bisects its lines, and reads records by their byte ranges, neighbours in one read.

Digests and keys are written once, without payloads; groups of equal payloads and the borders of the ranges come from there.

Files go to a folder that all executors share, through pyarrow's file systems. An attempt of a task
names its files by a fresh id and only the directory rows of successful attempts are kept (in a written
table), so retried tasks and lost executors leave at worst files that nothing points to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, fresh_path, scratch, spread_join, with_maybe

BLOCK_LINES = 256
#: Records whose payloads have fewer bytes are always responses.
MIN_REVISIT_BYTES = 1000
BITMAP_BITS = 24
DATE = "2000-01-01T00:00:00Z"
#: Keys that the borders of each archive's range are drawn from.
SAMPLE_KEYS = 64
#: Bytes that a reader holds of an archive at once, unless one record is larger.
READ_BYTES = 8 << 20
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def surt(url: str) -> Column:
    """Sort key: host labels in reverse, then ``)`` and the rest; "" for null, the lower-cased text where there is no ``://``."""
    text = F.coalesce(F.lower(F.col(url)), F.lit(""))
    rest = F.when(F.locate("://", text) > 0, F.substr(text, F.locate("://", text) + 3)).otherwise(F.lit(""))
    host, tail = F.regexp_extract(rest, r"^([^/?#:]*)", 1), F.regexp_extract(rest, r"(?s)^[^/?#:]*(.*)$", 1)
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(rest == "", text).otherwise(F.concat(reversed_host, F.lit(")"), tail))


def hashed_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (``id``, ``url``, ``payload``, ``digest``, ``bytes``, ``key``, ``spread``: a hash of the id)."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    return rows.select("id", "url", "payload", F.sha1("payload").alias("digest"), size.alias("bytes"), surt("url").alias("key"), F.xxhash64(F.col("id").cast("string")).alias("spread"))


def plan_revisits(rows: DataFrame, digests: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``rows`` with ``refers``, which is null for responses; ``digests`` holds their ``id``, ``digest`` and ``bytes``.

    Of equal payloads of at least ``min_bytes`` the row with the largest id is the response (null ids are no
    candidates unless all are null, and then all are responses); rows that repeat that id and payload are responses too.
    """
    keys = ["digest", "bytes"]
    groups = digests.filter(F.col("bytes") >= min_bytes).groupBy(*keys).agg(F.max("id").alias("keep"), F.count("*").alias("n"))
    groups = scratch(groups.filter((F.col("n") > 1) & F.col("keep").isNotNull()).select(*keys, "keep"), "warc-groups")
    # Only rows whose payload may repeat go through the join.
    made = bitmap(groups, keys, BITMAP_BITS)
    marked = with_maybe(rows, made, keys, BITMAP_BITS)
    alone = marked.filter(~F.col("__maybe")).withColumn("keep", F.col("id"))
    maybe = marked.filter("__maybe")
    all_groups = with_maybe(digests, made, keys, BITMAP_BITS).filter("__maybe").select(*keys).distinct().join(groups, keys, "left")
    joined = spread_join(maybe, all_groups, keys, "spread")
    both = joined.select(*alone.columns).unionByName(alone)
    revisit = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    return both.select(*rows.columns, F.when(revisit, F.col("keep")).alias("refers"))


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers: object, date: str = DATE) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit has HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record: id, url, type, refers, payload (None for revisits), payload bytes and SHA-1 of the full payload.

    A response's size and digest are computed from its payload, a revisit's come from its headers.
    """
    head, rest = raw.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    urn = lambda x: None if x is None or x == "<urn:page:null>" else x[len("<urn:page:") : -1]
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    out = {"id": urn(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "type": fields["WARC-Type"], "refers": urn(fields.get("WARC-Refers-To"))}
    if out["type"] == "response":
        own = hashlib.sha1(payload).hexdigest()
        if own != digest:
            raise ValueError(f"digest of record {out['id']} differs")
        return out | {"payload": payload, "bytes": len(payload), "digest": own}
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return out | {"payload": None, "bytes": size, "digest": digest}


def _gzip(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


_DIRECTORY = "first string, last string, captures string, at bigint, size bigint, lines int, archive string"


def _write(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    """Archive and capture file of one partition, whose rows come in key order; returns the directory rows."""
    archive = captures = None
    lines: list[dict] = []
    directory: list[tuple] = []
    place = block_at = 0

    def flush() -> None:
        nonlocal block_at, lines
        if lines:
            data = _gzip("\n".join(json.dumps(x, separators=(",", ":")) for x in lines).encode())
            captures.write(data)
            directory.append((lines[0]["k"], lines[-1]["k"], names[1], block_at, len(data), len(lines), names[0]))
            block_at += len(data)
            lines = []

    for b in batches:
        for key, page_id, url, payload, digest, refers in zip(*(b[c].tolist() for c in ("key", "id", "url", "payload", "digest", "refers"))):
            if archive is None:
                system, base = fs.FileSystem.from_uri(root)
                system.create_dir(base, recursive=True)
                stem = uuid.uuid4().hex
                names = (f"{stem}.warc.gz", f"{stem}.cdx.gz")
                archive, captures = (system.open_output_stream(f"{base}/{n}", compression=None) for n in names)
            data = _gzip(record(page_id, url, payload, digest, refers))
            archive.write(data)
            lines.append({"k": key, "at": place, "size": len(data), "id": page_id, "sha1": digest, "type": "response" if refers is None else "revisit"})
            place += len(data)
            if len(lines) == BLOCK_LINES:
                flush()
    if archive is not None:
        flush()
        archive.close()
        captures.close()
    yield pd.DataFrame(directory, columns=[c.split()[0] for c in _DIRECTORY.split(", ")])


def borders(keyed: DataFrame, parts: int) -> list[tuple[str, int]]:
    """At most ``parts`` - 1 values of (key, spread) that cut the rows into ranges of about the same size; rows of one key may be cut
    apart, since their hashes of ids differ."""
    picked = keyed.select("key", "spread").orderBy(F.xxhash64("key", "spread", F.lit("border")), "key").limit(SAMPLE_KEYS * parts)
    cut = sorted((r.key, r.spread) for r in picked.collect())  # at most SAMPLE_KEYS for each task that writes
    return sorted({cut[len(cut) * i // parts] for i in range(1, parts)}) if cut else []


def write_archives(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Write archives and capture files under ``root`` (a URI; default: a fresh folder in the shared scratch folder).

    Returns the folder and the block directory. Null pages have an empty payload; rows of any number may share a URL; an empty table
    writes nothing. Blanks and control characters of a URL are percent-encoded in its record, which is how it is read back; the
    index has them as they are. Null URLs have no target URI and the key of an empty one.
    """
    spark = pages.sparkSession
    root = root or fresh_path(spark, "warc")
    rows = hashed_pages(pages, id_col, url_col, html_col)
    digests = scratch(rows.drop("url", "payload"), "warc-digests")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = borders(digests, parts)

    @F.pandas_udf("int")
    def place(key: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(key, spread)], dtype="int32")

    planned = plan_revisits(rows, digests).withColumn("place", place("key", "spread"))
    ordered = planned.repartitionById(parts, "place").sortWithinPartitions("key", "id")
    # Ids travel as text, so that a null among numbers does not turn them into floats.
    ready = ordered.select("key", F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.col("refers").cast("string").alias("refers"))
    return root, scratch(ready.mapInPandas(lambda it: _write(it, root), _DIRECTORY), "warc-directory")


def _read_at(system, path: str, at: int, size: int) -> bytes:
    with system.open_input_file(path) as f:
        f.seek(at)
        return f.read(size)


def _block(system, base: str, row) -> list[dict]:
    data = zlib.decompress(_read_at(system, f"{base}/{row.captures}", int(row.at), int(row.size)), 31)
    return [json.loads(x) for x in data.decode().split("\n")]


_RECORD = "id string, url string, type string, refers string, payload binary, bytes bigint, digest string"


def read_archives(root: str, directory: DataFrame, payloads: bool = True) -> DataFrame:
    """All records, block by block of the directory: id, url, type, refers, payload (null for revisits), bytes, digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for row in b.itertuples():
                captures = _block(system, base, row)
                begin = 0
                while begin < len(captures):
                    stop, size = begin + 1, captures[begin]["size"]
                    while stop < len(captures) and size + captures[stop]["size"] <= READ_BYTES:
                        size += captures[stop]["size"]
                        stop += 1
                    raw, start = _read_at(system, f"{base}/{row.archive}", captures[begin]["at"], size), captures[begin]["at"]
                    found = []
                    for c in captures[begin:stop]:
                        r = parse(zlib.decompress(raw[c["at"] - start : c["at"] - start + c["size"]], 31))
                        found.append(r if payloads else r | {"payload": None})
                    yield pd.DataFrame(found, columns=[c.split()[0] for c in _RECORD.split(", ")])
                    begin = stop

    parts = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return directory.repartition(parts).mapInPandas(run, _RECORD)


def search(root: str, directory: DataFrame, keys: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of some keys (column ``key``; repeated ones count once), through the index, as ``read_archives`` returns them.

    The key ranges of the archives, one row for each task that wrote, are what the driver holds. Every archive that holds
    asked keys is one task, which gets its directory rows and then its keys in order, and holds one block and one read at a time.
    """
    spark = directory.sparkSession
    ranges = sorted((r.first, r.last, r.archive) for r in directory.groupBy("archive").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect())
    if not ranges:
        return spark.createDataFrame([], _RECORD)
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(lasts, k), bisect_right(firsts, k))) for k in key])

    numbers = spark.createDataFrame([(r[2], i) for i, r in enumerate(ranges)], "archive string, place int")
    asked = keys.select("key").distinct().select(F.explode(places("key")).alias("place"), F.col("key").alias("first"))
    both = directory.join(F.broadcast(numbers), "archive").unionByName(asked, allowMissingColumns=True)
    # Directory rows come before keys, which have no capture file.
    dealt = both.repartitionById(len(ranges), "place").sortWithinPartitions("place", F.col("captures").isNull(), "first", "at")
    return dealt.mapInPandas(lambda it: _find(it, root, payloads), _RECORD)


def _find(batches: Iterator[pd.DataFrame], root: str, payloads: bool) -> Iterator[pd.DataFrame]:
    """Directory rows of an archive, then the keys asked from it, in order; archive after archive."""
    system, base = fs.FileSystem.from_uri(root)
    place, blocks, firsts, lasts = None, [], [], []
    opened: tuple[int, list[dict], list[str]] | None = None
    waiting: list[dict] = []

    def read() -> pd.DataFrame:
        nonlocal waiting
        start, stop = waiting[0]["at"], waiting[-1]["at"] + waiting[-1]["size"]
        raw = _read_at(system, f"{base}/{blocks[0].archive}", start, stop - start)
        found = [parse(zlib.decompress(raw[c["at"] - start : c["at"] - start + c["size"]], 31)) for c in waiting]
        waiting = []
        return pd.DataFrame([r if payloads else r | {"payload": None} for r in found], columns=[c.split()[0] for c in _RECORD.split(", ")])

    for b in batches:
        for row in b.itertuples():
            if row.place != place:
                if waiting:
                    yield read()
                place, blocks, firsts, lasts, opened = row.place, [], [], [], None
            if row.captures is not None:
                blocks.append(row)
                firsts.append(row.first)
                lasts.append(row.last)
                continue
            for n in range(bisect_left(lasts, row.first), bisect_right(firsts, row.first)):
                if opened is None or opened[0] != n:
                    lines = _block(system, base, blocks[n])
                    opened = (n, lines, [c["k"] for c in lines])
                for c in opened[1][bisect_left(opened[2], row.first) : bisect_right(opened[2], row.first)]:
                    if waiting and (c["at"] != waiting[-1]["at"] + waiting[-1]["size"] or c["at"] + c["size"] - waiting[0]["at"] > READ_BYTES):
                        yield read()
                    waiting.append(c)
    if waiting:
        yield read()


def lookup(root: str, directory: DataFrame, urls: list[str]) -> DataFrame:
    """The records of some URLs."""
    return search(root, directory, directory.sparkSession.createDataFrame([(u,) for u in urls], "url string").select(surt("url").alias("key")))
