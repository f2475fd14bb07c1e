"""Near duplicates by similarity: SimHash tables, trie self-joins within an error budget, and an exact check.

The similarity of two texts is that of their sets of n-word shingles (Jaccard). A pair of the least similarity differs in about 15 % of the bits of
its SimHash fingerprints, too many for one fingerprint to be looked up by the bits that agree. Therefore a text gets TABLES independent fingerprints of
TABLE_BITS bits; every table is joined with itself by the binary trie within BUDGET differing bits, band by band. What a table finds must also be near
in the next two tables. A pair of similarity 0.8 is found by one table with probability 0.25 and by any of them with 0.99, a pair of 0.9 with 0.99999.
Found pairs only say which texts are compared: all pairs of a component of found pairs are checked exactly, whether a table found them or not, by sets
of shingles made anew from the whole texts. Components of checked pairs are the groups.

Texts with equal sets of shingles are one class from the beginning, so groups of copies of any size are one member. Where a group of a table has
more pairs than members, it hands on a spanning forest of them, which has the components of all of them, and so no pair is lost.

Members of a component are checked in blocks, all pairs of a block by one matrix product. A component of several blocks is dealt into blocks twice; what
these link need not be compared again, so at last only pairs of blocks are taken that are not of one linked part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, keep_rows, row_key, scratch, spread_join, with_maybe
from .simhash import TASK_ROWS, _roots, components, large_group_pairs, trie_pairs
from .tokens import mix, word_hashes

WORDS = 5
SIMILARITY = 0.8
TABLES = 16
TABLE_BITS = 32
BUDGET = 3
#: Of BUDGET + 1 bands of a table's bits one agrees.
BAND_BITS = TABLE_BITS // (BUDGET + 1)
#: Differing bits at most of the next two tables: 1.5 standard deviations above those of a pair of similarity 0.8.
FAR = 14
#: Found pairs for each member of a group beyond which a minimum spanning forest of them is handed on.
PAIRS_A_MEMBER = 1
#: Shingles of a block, and those that a member counts as at least: up to 512 members and 8 MB.
BLOCK, LEAST = 1 << 20, 1 << 11
#: Shingles of one matrix product.
COLUMNS = 1 << 13
BITMAP_BITS = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, A-Z lower-cased; of fewer words the whole sequence is one, of none there is one of nothing."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())[1]
    n = min(n, len(h))
    made = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        made = mix((made ^ h[i : len(h) - n + 1 + i]) * _ODD + np.uint64(i))
    return np.unique(made)


def fingerprints(sets: np.ndarray, words: int) -> np.ndarray:
    """``words`` fingerprints of 64 bits of a set of hashes: a bit is 1 if set in over half of the set's hashes, mixed anew for each word."""
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(sets), 1 << 14):
        part = sets[at : at + (1 << 14)]
        mixed = np.stack([mix((part + np.uint64(j)) * _ODD ^ (part >> np.uint64(31))) for j in range(1, words + 1)])
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(words, len(part), 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > len(sets), axis=1, bitorder="little").view("<u8").ravel()


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(``__id``, row keys, ``sig``: a hash of the set of shingles, ``size``: their number, ``tables``: TABLES integers) per row."""
    words = TABLES * TABLE_BITS // 64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, n) for t in b["__text"]]
            made = [fingerprints(s, words) for s in sets]
            sig = np.array([np.bitwise_xor.reduce(mix(s * _ODD)) + np.uint64(len(s)) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({
                "__id": b["__id"], "__key": b["__key"], "__hash": b["__hash"], "sig": sig, "size": [len(s) for s in sets],
                "tables": [m.view("<u4").astype(np.int64) for m in made],
            })

    rows = docs.select(F.col(id_col).cast("string").alias("__id"), *row_key(id_col, text_col), F.col(text_col).alias("__text"))
    made = rows.mapInPandas(run, "__id string, __key string, __hash bigint, sig bigint, size bigint, tables array<bigint>")
    return made.withColumn("__id", F.col("__id").cast(docs.schema[id_col].dataType))


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of pairs that make a minimum spanning forest: every component takes its lightest pair to another one, until there are none."""
    label, chosen = np.arange(n), []
    left = np.argsort(weight, kind="stable")
    while len(left := left[label[a[left]] != label[b[left]]]):
        ends = np.concatenate([label[a[left]], label[b[left]]])
        lightest = np.full(n, len(left))
        np.minimum.at(lightest, ends, np.tile(np.arange(len(left)), 2))
        picked = left[np.unique(lightest[lightest < len(left)])]
        chosen.append(picked)
        label = _roots(n, a[picked], b[picked], label)
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def group_pairs(g: np.ndarray, table: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within groups whose members are near in the table and in ``fp``; of groups with many pairs a minimum spanning forest.

    A pair that agrees on several bands of a table is left to the first of these; ``g`` holds the band above the band's value.
    """
    order = np.lexsort((table, g))
    g, own = g[order], table[order]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    group = np.cumsum(new) - 1
    members = np.bincount(group)
    first = np.flatnonzero(new | np.concatenate([[True], own[1:] != own[:-1]]))
    head = np.repeat(first, np.diff(np.append(first, len(own))))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def take(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal waiting
        far, differ = np.bitwise_count(fp[order[a]] ^ fp[order[b]]), own[a] ^ own[b]
        band = (g[a] >> BAND_BITS) % (BUDGET + 1)
        keep = far <= FAR
        for j in range(BUDGET):
            keep &= (band <= j) | (differ >> np.uint64(j * BAND_BITS) & np.uint64((1 << BAND_BITS) - 1) != 0)
        held.append((a[keep], b[keep], far[keep] + np.bitwise_count(differ[keep])))
        waiting += int(keep.sum())
        if waiting > 1 << 20:
            shrink()

    def shrink() -> None:
        nonlocal waiting
        a, b, far = map(np.concatenate, zip(*held))
        many = (np.bincount(group[a], minlength=len(members)) > PAIRS_A_MEMBER * members)[group[a]]
        if many.any():
            heavy = np.flatnonzero(many)
            kept = np.concatenate([np.flatnonzero(~many), heavy[spanning(len(own), a[heavy], b[heavy], far[heavy])]])
            a, b, far = a[kept], b[kept], far[kept]
        held[:], waiting = [(a, b, far)], 0

    # Members of equal tables hang on the first of them; the trie joins the first ones, small groups all together. (Where a first one is
    # equal by chance, in one of 2**TABLE_BITS, the other tables are left.)
    hung = np.flatnonzero(head != np.arange(len(own)))
    take(hung, head[hung])
    distinct = np.bincount(group[first])
    bits = own << np.uint64(64 - TABLE_BITS)
    small = first[(distinct <= TASK_ROWS)[group[first]]]
    for a, b in trie_pairs(g[small], bits[small], BUDGET):
        take(small[a], small[b])
    for large in np.flatnonzero(distinct > TASK_ROWS):
        these = first[group[first] == large]
        for a, b in large_group_pairs(bits[these], BUDGET):
            take(these[a], these[b])
    shrink()
    return order[held[0][0]], order[held[0][1]]


def _pair_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(group, sig, fp, table value), in order of groups, in; pairs (u, v) with u < v out. Whole groups of about TASK_ROWS rows are taken at once."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = group_pairs(rows["g"].to_numpy(np.int64), rows["value"].to_numpy(np.int64).view(np.uint64), rows["fp"].to_numpy(np.int64).view(np.uint64))
        sig = rows["sig"].to_numpy(np.int64)
        return pd.DataFrame({"u": np.minimum(sig[a], sig[b]), "v": np.maximum(sig[a], sig[b])})

    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size > TASK_ROWS:
            rows = pd.concat(held)
            g = rows["g"].to_numpy()
            last = int(np.flatnonzero(g == g[-1])[0])  # the last group may go on
            if last:
                yield pairs(rows.iloc[:last])
            held, size = [rows.iloc[last:]], len(rows) - last
    if size:
        yield pairs(pd.concat(held))


def stars(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    """Pairs (u, v) of each component's smallest member and another one, for all links."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = _roots(len(names), at[: len(u)], at[len(u) :], np.arange(len(names)))
    linked = np.flatnonzero(label != np.arange(len(names)))
    return pd.DataFrame({"u": names[label[linked]], "v": names[linked]})


def _star_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (u, v) in, ``stars`` of all of them out."""
    held: list[pd.DataFrame] = []
    waiting = 0
    for b in batches:
        held.append(b)
        waiting += len(b)
        if waiting > 1 << 20:
            rows = pd.concat(held)
            held, waiting = [stars(rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64))], 0
    if held:
        rows = pd.concat(held)
        yield stars(rows["u"].to_numpy(np.int64), rows["v"].to_numpy(np.int64))


def candidates(classes: DataFrame) -> DataFrame:
    """Links (u, v) that connect just the classes (``sig``, ``tables``) connected by pairs that a table finds and the next two confirm.

    Rows are dealt by table, band and the band's value. A class has a link in each of its groups; those of a task, and then those to the
    same classes, shrink to the links that connect them.
    """
    bands = F.array(*[F.lit(i) for i in range(BUDGET + 1)])
    after = [F.get("tables", F.pmod(F.col("t") + i, F.lit(TABLES))) for i in (1, 2)]
    single = classes.select("sig", "tables", F.posexplode("tables").alias("t", "value"))
    single = single.select("sig", "t", "value", F.shiftleft(after[0], 32).bitwiseOR(after[1]).alias("fp"), F.explode(bands).alias("band"))
    value = F.expr(f"shiftright(value, band * {BAND_BITS}) & {(1 << BAND_BITS) - 1}L")
    rows = single.select(((F.col("t") * (BUDGET + 1) + F.col("band")) * (1 << BAND_BITS) + value).cast("long").alias("g"), "sig", "fp", "value")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "g").sortWithinPartitions("g")
    links = dealt.mapInPandas(lambda batches: _star_partition(_pair_partition(batches)), "u bigint, v bigint")
    return links.repartition(parts, "v").mapInPandas(_star_partition, "u bigint, v bigint")


def blocks(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` (``sig``, ``weight``) with the number of blocks that the rows of a key fill."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.sum("weight") / BLOCK).alias(name))
    return spread_join(rows, sizes, keys, "sig")


def member_sets(docs: DataFrame, links: DataFrame, classes: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(``sig``, ``blob``: the component of links, ``weight``, ``k``: the component's blocks, ``set``) per linked class. Only their texts are read into sets."""
    names = ["__key", "__hash"]
    blob = components(links).select(F.col("v").alias("sig"), F.col("root").alias("blob"))
    members = classes.join(blob, "sig").select("sig", "blob", F.greatest("size", F.lit(LEAST)).alias("weight"), *names)
    wanted = scratch(blocks(members, ["blob"], "k"), "similar-wanted")
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("__text"))
    near = with_maybe(rows, bitmap(wanted, names, BITMAP_BITS), names, BITMAP_BITS).filter("__maybe").select(*names, "__text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__key": b["__key"], "__hash": b["__hash"], "set": [shingles(t, n).tobytes() for t in b["__text"]]})

    made = near.mapInPandas(sets, "__key string, __hash bigint, set binary").join(wanted, names)
    first = made.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("blob", "weight", "k", "set")])
    return scratch(first, "similar-sets")


def similar_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets of at least that similarity."""
    size = np.array([len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[at] > 1
    column, owner = (np.cumsum(count > 1) - 1)[at[shared]], np.repeat(np.arange(len(sets)), size)[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, total - at)), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        common += (has @ has.T).astype(np.int64)
    return np.nonzero(np.triu(common >= similarity * (size[:, None] + size[None, :] - common), 1))


def linked_in_groups(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that connect the members (``g``, ``sig``, ``set``) of each group as all its pairs of at least that similarity do."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        sig = rows["sig"].to_numpy(np.int64)
        a, b = similar_sets([np.frombuffer(s, np.uint64) for s in rows["set"]], similarity)
        return stars(sig[a], sig[b])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            rows = b if held is None else pd.concat([held, b])
            cut = np.flatnonzero(np.diff(rows["g"].to_numpy())) + 1
            for lo, hi in zip(np.concatenate([[0], cut]), cut):
                if hi - lo > 1:
                    yield links(rows.iloc[lo:hi])
            held = rows.iloc[cut[-1] :] if len(cut) else rows  # the last group may go on
        if held is not None and len(held) > 1:
            yield links(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("g", "sig", "set").repartition(parts, "g").sortWithinPartitions("g")
    return dealt.mapInPandas(run, "u bigint, v bigint")


def checked(own: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that connect the members of each component as all its pairs of at least that similarity do."""

    def dealt(rows: DataFrame, salt: int) -> DataFrame:
        return rows.withColumn("g", F.xxhash64("blob", F.pmod(F.xxhash64("sig", F.lit(salt)), F.col("k"))))

    links = scratch(linked_in_groups(dealt(own, 0), similarity), "similar-links")
    large = own.filter("k > 1")
    if large.isEmpty():
        return links
    links = scratch(links.union(linked_in_groups(dealt(large, 1), similarity)), "similar-links")
    across = linked_in_groups(large.join(block_pairs(large, components(links)), "sig"), similarity)
    return links.union(scratch(across, "similar-links"))


def block_pairs(large: DataFrame, label: DataFrame) -> DataFrame:
    """(``sig``, ``g``): the members of each pair of blocks of a component (``blob``) that may hold pairs not connected by ``label`` (v, root).

    Parts that are connected and fill a block have blocks of their own, all others share some.
    """
    rows = large.select("sig", "blob", "weight").join(label.withColumnRenamed("v", "sig"), "sig", "left")
    sized = blocks(rows.withColumn("root", F.coalesce("root", "sig")), ["blob", "root"], "own")
    alone = sized.withColumn("alone", F.col("own") > 1).withColumn("part", F.when(F.col("own") > 1, F.col("root")).otherwise(F.col("blob")))
    names = ["blob", "alone", "part", "block"]
    placed = blocks(alone, names[:3], "n").withColumn("block", F.pmod(F.xxhash64("sig", F.lit(2)), F.col("n")))
    placed = scratch(placed.select("sig", *names), "similar-placed")
    each = placed.select("blob", F.struct(*names[1:]).alias("at")).distinct()
    two = each.withColumnRenamed("at", "one").join(each.withColumnRenamed("at", "other"), "blob").filter("one <= other")
    two = two.filter("not (one.alone and other.alone and one.part = other.part)").withColumn("g", F.xxhash64("blob", "one", "other"))
    ends = two.select("blob", "one.*", "g").union(two.filter("one < other").select("blob", "other.*", "g"))
    return placed.join(ends, names).select("sig", "g")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, ``component_id`` (smallest id reachable by pairs of at least that similarity, itself included).

    Null and blank texts are one class; texts of fewer than n words are one shingle. Null ids are ignored when the smallest id is taken
    (null if a component has no other). Repeated rows are kept. Extra columns are ignored; an empty table gives an empty result.
    """
    found = _find(docs, id_col, text_col, n, similarity)
    return found.select(F.col("__id").alias(id_col), "component_id")


def _smallest(*order: str) -> Column:
    return F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), *order))


def _find(docs: DataFrame, id_col: str, text_col: str, n: int, similarity: float) -> DataFrame:
    """Rows (``__id``, row keys, ``root``: the class that names the component, ``component_id``)."""
    rows = scratch(signatures(docs, id_col, text_col, n), "similar-rows")
    first = rows.groupBy("sig").agg(_smallest("__hash", "__key", "size", "tables").alias("s"))
    classes = scratch(first.select("sig", F.col("s.id").alias("least"), "s.__key", "s.__hash", "s.size", "s.tables"), "similar-classes")
    own = member_sets(docs, scratch(candidates(classes), "similar-candidates"), classes, id_col, text_col, n)
    label = components(checked(own, similarity))
    rooted = classes.join(label.withColumnRenamed("v", "sig"), "sig", "left").select("sig", "least", F.coalesce("root", "sig").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.select("sig", "root").join(smallest, "root").select("sig", "root", "component_id")
    return spread_join(rows.select("__id", "__key", "__hash", "sig"), of_class, ["sig"], "__key")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id (null ids last)."""
    found = scratch(_find(docs, id_col, text_col, n, similarity), "similar-found")
    kept = found.groupBy("root").agg(_smallest("__hash", "__key").alias("s")).select("s.__key", "s.__hash")
    return keep_rows(docs, found, kept, id_col, text_col)
