"""Near-duplicate detection with SimHash fingerprints and a binary-trie self-join.

Fingerprints of 64 bits are computed per document, then only distinct fingerprints are joined. Two
fingerprints within k = 3 bits agree on at least one of k + 1 bands of 16 bits, so each band's groups
are joined apart. Inside a task the fingerprints of all its groups are sorted, which makes every binary
trie node a range of the array; pairs of nodes are traversed together one bit at a time, differing
bits are accumulated, and pairs above the error budget are pruned. Bands with very many different
fingerprints are split once more by four sub-bands of the remaining 48 bits (again, one must agree).
A task takes its groups in order, TASK_ROWS fingerprints at a time; a larger group is split inside the task, again and again, by four parts of
the bits in which its members differ at all. Links inside a task shrink to a spanning forest before they leave it, so that a ball of m near copies
yields m - 1 edges, not m * m. Components are found by distributed min-label propagation with pointer
jumping; every round is a written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, row_key, scratch, spread_join

SEED = 42
#: Shingles hashed at once; longer documents are summed over several blocks.
BLOCK = 1 << 16
#: Band groups of more different fingerprints than this are split by sub-bands.
SPLIT_OVER = 256
#: Fingerprints that one traversal holds at most.
TASK_ROWS = 1 << 16
#: Node pairs that one traversal step holds at most.
FRONTIER = 1 << 19


def fingerprint(text: str | None, n: int = 3) -> int:
    """64-bit SimHash over n-word shingles, repeats included; 0 for no words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(n, len(words)) - 1 :].tolist()
    total, counts = len(ends), np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        parts = [joined[a:b] for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << j for j in np.flatnonzero(2 * counts > total).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(``__id``, row keys, ``fp``) per row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, n) for t in b["__text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"__id": b["__id"], "__key": b["__key"], "__hash": b["__hash"], "fp": fp})

    # Ids travel as text, since pandas has no integers with nulls.
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), *row_key(id_col, text_col), F.col(text_col).alias("__text"))
    made = rows.mapInPandas(run, "__id string, __key string, __hash bigint, fp bigint")
    return made.withColumn("__id", F.col("__id").cast(docs.schema[id_col].dataType))


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest index of each component, given the labels so far and more links."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        la, lb = la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label[:] = jumped
        a, b = a[differ], b[differ]


def trie_pairs(groups: np.ndarray, fps: np.ndarray, k: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs within groups that differ in at most k bits, part by part.

    ``groups`` and ``fps`` (uint64) are sorted by group, then fingerprint; fingerprints are distinct in a group.
    """
    n = len(fps)
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(d: int) -> np.ndarray:
        if d not in zeros:
            bit = (fps >> np.uint64(63 - d)) & np.uint64(1)
            zeros[d] = np.concatenate([[0], np.cumsum(bit == 0)])
        return zeros[d]

    cut = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
    lo, hi = cut, np.append(cut[1:], n)
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((d, *(x[half:] for x in (alo, ahi, blo, bhi, err))))
            stack.append((d, *(x[:half] for x in (alo, ahi, blo, bhi, err))))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= k)
            if near.any():
                yield a[near], b[near]
            rest = ~single
            alo, ahi, blo, bhi, err = (x[rest] for x in (alo, ahi, blo, bhi, err))
        if not len(alo) or d == 64:
            continue
        z = zeros_before(d)
        am, bm = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        other = alo != blo
        nexts = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1)]
        nexts.append(tuple(x[other] for x in (am, ahi, blo, bm, err + 1)))
        parts = []
        for pa, pb, qa, qb, e in nexts:
            keep = (pb > pa) & (qb > qa) & (e <= k)
            keep &= ~((pa == qa) & (pb - pa == 1))
            parts.append(tuple(x[keep] for x in (pa, pb, qa, qb, e)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))


def _linked(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component labels (index of the first member) of n places under links that come part by part."""
    label = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for a, b in pairs:
        found.append((a, b))
        waiting += len(a)
        if waiting > 1 << 20:
            label = _roots(n, *map(np.concatenate, zip(*found)), label)
            found, waiting = [], 0
    return _roots(n, *map(np.concatenate, zip(*found)), label) if found else label


def trie_links(groups: np.ndarray, fps: np.ndarray, k: int = 3) -> np.ndarray:
    """Component labels of ``trie_pairs``."""
    return _linked(len(fps), trie_pairs(groups, fps, k))


def _groups_by(fps: np.ndarray, mask: np.uint64) -> Iterator[np.ndarray]:
    """Places of the members of each group of two or more that agree on the bits of ``mask``, in order of fingerprints."""
    key = fps & mask
    order = np.lexsort((fps, key))
    cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    for a, b in zip(cut, np.append(cut[1:], len(fps))):
        if b - a > 1:
            yield order[a:b]


def large_group_pairs(fps: np.ndarray, k: int = 3, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``trie_pairs`` of one group of any size (sorted, distinct), with at most ``most`` fingerprints in a traversal; pairs may repeat.

    Members within k bits agree on one of k + 1 parts of the bits that vary in the group. Each part leaves fewer bits to vary, and
    b bits tell 2**b fingerprints apart, so groups become small enough.
    """
    most = most or TASK_ROWS
    waiting = [np.arange(len(fps))]
    while waiting:
        places = waiting.pop()
        own = fps[places]
        if len(places) <= max(2, most):
            for a, b in trie_pairs(np.zeros(len(own), np.int64), own, k):
                yield places[a], places[b]
            continue
        varying = int(np.bitwise_or.reduce(own ^ own[0]))
        bits = [b for b in range(64) if varying >> b & 1]
        for part in np.array_split(np.array(bits), min(k + 1, len(bits))):
            mask = np.uint64(sum(1 << int(b) for b in part))
            waiting += [places[g] for g in _groups_by(own, mask)]


def large_group_links(fps: np.ndarray, k: int = 3, most: int | None = None) -> np.ndarray:
    """``trie_links`` of one group of any size."""
    return _linked(len(fps), large_group_pairs(fps, k, most))


def _link_partition(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """All groups of a partition, in order: (group, fp) in, spanning edges (u, v) with v < u as signed longs out."""

    def edges(g: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((fp, g))
        g, fp = g[order], fp[order]
        label = large_group_links(fp, k) if len(fp) > TASK_ROWS and g[0] == g[-1] else trie_links(g, fp, k)
        linked = np.flatnonzero(label != np.arange(len(label)))
        signed = fp.view(np.int64)
        return pd.DataFrame({"u": signed[linked], "v": signed[label[linked]]})

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append((b["g"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).view(np.uint64)))
        rows += len(b)
        if rows > TASK_ROWS:
            g, fp = (np.concatenate(x) for x in zip(*held))
            last = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on
            if last:
                yield from _by_size(g[:last], fp[:last], edges)
            held, rows = [(g[last:], fp[last:])], len(g) - last
    if rows:
        g, fp = (np.concatenate(x) for x in zip(*held))
        yield from _by_size(g, fp, edges)


def _by_size(g: np.ndarray, fp: np.ndarray, edges: Callable[[np.ndarray, np.ndarray], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``edges`` of whole groups: those of more than TASK_ROWS members alone, the others together."""
    cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(cut, len(g)))
    small = np.repeat(size <= TASK_ROWS, size)
    if small.any():
        yield edges(g[small], fp[small])
    for a, n in zip(cut[size > TASK_ROWS].tolist(), size[size > TASK_ROWS].tolist()):
        yield edges(g[a : a + n], fp[a : a + n])


def near_links(fps: DataFrame, k: int = 3, split_over: int = SPLIT_OVER) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints connected by links of at most k = 3 bits.

    ``fps`` has one column ``fp`` of distinct longs.
    """
    if k != 3:
        raise ValueError("the bands are laid out for at most 3 differing bits")
    bands = F.array(*[F.struct(F.lit(i).alias("b"), F.expr(f"shiftrightunsigned(fp, {48 - 16 * i}) & 65535L").alias("v")) for i in range(4)])
    keyed = fps.select("fp", F.explode(bands).alias("x")).select("fp", F.col("x.b").alias("b"), F.col("x.v").alias("v"))
    sizes = keyed.groupBy("b", "v").agg(F.count("*").alias("m"))
    large = sizes.filter(F.col("m") > split_over).select(F.col("b").alias("lb"), F.col("v").alias("lv"))
    # At most 4 n / split_over groups are large; the join's hot keys are few rows wide and Spark splits them.
    marked = keyed.join(large, (keyed.b == large.lb) & (keyed.v == large.lv), "left")
    # The 48 bits outside band b, then four sub-bands of 12.
    rest = F.expr(
        "case b when 0 then fp & 281474976710655L "
        "when 1 then (shiftleft(shiftrightunsigned(fp, 48), 32)) | (fp & 4294967295L) "
        "when 2 then (shiftleft(shiftrightunsigned(fp, 32), 16)) | (fp & 65535L) "
        "else shiftrightunsigned(fp, 16) end"
    )
    subs = F.array(*[F.struct(F.lit(i).alias("s"), F.expr(f"shiftrightunsigned(__rest, {36 - 12 * i}) & 4095L").alias("w")) for i in range(4)])
    whole = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("w")))
    grouped = (
        marked.withColumn("__rest", rest)
        .select("fp", "b", "v", F.explode(F.when(F.col("lb").isNull(), whole).otherwise(subs)).alias("y"))
        .select(
            "fp",
            # Band (2 bits), sub-band or none (3), their values (16 and 12): one long names the group.
            F.expr("b + 4L * (1 + y.s) + 32L * (v * 4096L + y.w)").alias("g"),
        )
    )
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grouped.repartition(parts, "g").sortWithinPartitions("g")
    return dealt.mapInPandas(lambda it: _link_partition(it, k), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex reachable from each vertex that has an edge (signed order)."""
    both = scratch(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    label = scratch(both.groupBy("u").agg(F.least("u", F.min("v")).alias("root")), "cc-label")
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("near"))
        hooked = label.join(near, "u").select("u", "root", F.least("root", "near").alias("next"))
        jump = label.select(F.col("u").alias("next"), F.col("root").alias("far"))
        moved = hooked.join(jump, "next").select("u", F.col("root").alias("was"), F.least("next", "far").alias("root"))
        moved = scratch(moved, "cc-label")
        label = moved.select("u", "root")
        if moved.filter("was != root").isEmpty():
            return label.select(F.col("u").alias("v"), "root")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, k: int = 3) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long), ``component_id`` (smallest id reachable).

    Null and blank texts have fingerprint 0 and are linked like any other. Texts of fewer than ``n`` words are
    one shingle. Null ids are ignored when the smallest id is taken (null if a component has no other).
    Repeated rows are kept. Extra columns are ignored; an empty table gives an empty result.
    """
    return _find(docs, id_col, text_col, n, k).select(F.col("__id").alias(id_col), "fp", "component_id")


def _find(docs: DataFrame, id_col: str, text_col: str, n: int = 3, k: int = 3) -> DataFrame:
    """Rows (``__id``, row keys, ``fp``, ``root``: a fingerprint that names the component, ``component_id``)."""
    rows = scratch(fingerprints(docs, id_col, text_col, n), "simhash-fp")
    fps = scratch(rows.groupBy("fp").agg(F.min("__id").alias("least")), "simhash-distinct")
    label = components(near_links(fps.select("fp"), k))
    rooted = fps.join(label.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")
    return spread_join(rows, of_fp, ["fp"], "__key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id (null ids last)."""
    found = scratch(_find(docs, id_col, text_col), "simhash-found")
    names = [F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__hash"), F.col("__key")]
    first = found.groupBy("root").agg(F.min(F.struct(*names)).alias("s")).select("s.__key", "s.__hash")
    return keep_rows(docs, found, first, id_col, text_col)
