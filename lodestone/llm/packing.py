"""Best-fit packing of documents into sequences by bin completion.

The only thing that the packing depends on is how many pieces there are of each length, at most
``capacity`` numbers whatever the corpus. The driver packs that histogram: a best-fit-decreasing solution
is the first incumbent, then branch and bound takes the largest piece, enumerates the undominated fillings
of what is left beside it, applies each as often as the counts and the waste of a better solution allow, then fewer times, and prunes
branches whose waste exceeds what a better solution may have. The search is complete with no bound on fillings and nodes; by default it
tries a few fillings a node and ends after a number of nodes that grows with the number of lengths, unless it meets the lower bound
before: the packing is valid either way, and ``lower_bound`` tells how far from optimal it can be. The result is a list of at most some thousand bin patterns with
multiplicities. Pieces find their place from their rank among the pieces of their length, which is
counted with salted groups, so no task holds all pieces of a length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_chars
from .common import scratch

CAPACITY = 2048
#: Nodes that branch and bound visits at most before the best incumbent is taken, in all and for each length, and fillings tried at a node.
NODES, NODES_PER_LENGTH = 4000, 4
WIDTH = 6
#: Pieces and states that a bounded search tells apart to find out whether a filling dominates another one.
DOMINANCE_STATES = 8
#: Rows of one length that a rank group holds about.
GROUP_ROWS = 1 << 18
SALTS = 256

Pattern = tuple[tuple[int, int], ...]
Packing = list[tuple[Pattern, int]]

# Fixed value: how the byte-level vocabulary cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Token ids of a byte-level BPE file; Latin-1 texts go through a faster encoder with the same ranks."""

    def __init__(self, source: str):
        spec = json.loads(source)
        self.source = source
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        bytes_of = {c: b for b, c in enumerate(byte_chars())}
        ranks = {bytes(bytes_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self) -> Tokenizer:
        """The library's tokenizer, which most workers never need."""
        made = Tokenizer.from_str(self.source)
        made.no_truncation()
        made.no_padding()
        return made

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        try:
            text.encode("latin-1")
            return self.fast.encode_ordinary(text)
        except (UnicodeEncodeError, ValueError):  # other scripts; texts that the fast encoder's pattern matcher gives up on
            return self.library.encode(text, add_special_tokens=False).ids


_encoders: dict[int, ByteBpe] = {}


def _encoder(source: str) -> ByteBpe:
    key = hash(source)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ByteBpe(source)
    return _encoders[key]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which takes the rest."""
    first = length % capacity or capacity
    return [(0, min(first, length))] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = 0, payload: str = "ids"
) -> DataFrame:
    """Rows (id, ``piece``, ``start``, ``length`` and ``ids`` or, for ``payload="digest"``, ``ids_crc32``).

    A document's tokens are its ids and then ``end``; null counts as empty. Whole texts are encoded.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value)
        for b in batches:
            out = []
            for at, text in enumerate(b["__text"]):
                ids = np.array([*(encoder.encode(text) if isinstance(text, str) else ()), end], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + length]
                    out.append((at, k, start, length, own.astype(np.int32) if payload == "ids" else zlib.crc32(own.tobytes())))
            made = pd.DataFrame(out, columns=["at", "piece", "start", "length", name])
            made.insert(0, id_col, b["__id"].to_numpy()[made.pop("at")] if len(made) else b["__id"])
            yield made

    name, kind = ("ids", "array<int>") if payload == "ids" else ("ids_crc32", "bigint")
    # Ids travel as text, since pandas has no integers with nulls.
    rows = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__text"))
    made = rows.mapInPandas(run, f"`{id_col}` string, piece int, start bigint, length bigint, {name} {kind}")
    return made.withColumn(id_col, F.col(f"`{id_col}`").cast(docs.schema[id_col].dataType))


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing on a histogram: equal bins are kept as one pattern with a multiplicity."""
    open_bins: dict[int, list[list]] = {}  # free space -> [pattern, multiplicity]
    free: list[int] = []

    def put(space: int, pattern: Pattern, number: int) -> None:
        if number:
            if space not in open_bins:
                open_bins[space] = []
                insort(free, space)
            open_bins[space].append([pattern, number])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(free, length)
            if at == len(free):
                break
            space = free[at]
            runs = open_bins[space]
            pattern, number = runs.pop()
            if not runs:
                del open_bins[space], free[at]
            each = space // length
            full = min(number, n // each)
            put(space - each * length, (*pattern, (length, each)), full)
            n -= full * each
            number -= full
            if number and n:  # fewer than a bin's worth is left
                put(space - n * length, (*pattern, (length, n)), 1)
                n, number = 0, number - 1
            put(space, pattern, number)
        if n:
            each = capacity // length
            put(capacity - each * length, ((length, each),), n // each)
            if n % each:
                put(capacity - n % each * length, ((length, n % each),), 1)
    return [(p, m) for runs in open_bins.values() for p, m in runs]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bounds that count pieces above half and what fits beside them."""
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return 0
    number = np.array([counts[x] for x in lengths.tolist()], np.int64)
    volume = np.concatenate([[0], np.cumsum(lengths * number)])
    many = np.concatenate([[0], np.cumsum(number)])
    best = -(-int(volume[-1]) // capacity)
    half = np.searchsorted(lengths, capacity // 2, side="right")
    for least in {0, *lengths[lengths <= capacity // 2].tolist()}:
        above = np.searchsorted(lengths, capacity - least, side="right")
        low = np.searchsorted(lengths, least)
        above = max(above, half)
        single = int(many[-1] - many[above])
        large = int(many[above] - many[half])
        spare = large * capacity - int(volume[above] - volume[half])
        small = int(volume[half] - volume[low])
        best = max(best, single + large + max(0, -(-(small - spare) // capacity)))
    return best


def dominates(a: Pattern, b: Pattern, most: int | None = None) -> bool:
    """Whether the pieces of filling b can be shared out among the pieces of filling a, each part no longer than its piece.

    With ``most`` the answer is no where there are more pieces or states than that: both fillings are then kept.
    """
    if most and max(sum(k for _, k in a), sum(k for _, k in b)) > most:
        return False
    holes = sorted((x for x, k in a for _ in range(k)), reverse=True)
    items = sorted((x for x, k in b for _ in range(k)), reverse=True)
    if sum(items) > sum(holes) or (items and (not holes or items[0] > holes[0])):
        return False

    # Longest items first; states are what is left of the holes, so that equal ones are tried once.
    states = {tuple(holes)}
    for item in items:
        after = set()
        for left in states:
            for hole in set(left):
                if hole >= item:
                    rest = list(left)
                    rest.remove(hole)
                    after.add(tuple(sorted([*rest, hole - item], reverse=True)))
        states = after
        if most and len(states) > most:
            return False
    return bool(states)


def exact_sums(lengths: list[int], counts: dict[int, int], space: int, pieces: int, top: int, width: int) -> list[Pattern]:
    """Up to ``width`` fillings of exactly ``space`` by that many pieces no longer than ``top``, longest pieces first."""
    if pieces == 1:
        return [((space, 1),)] if 0 < space <= top and counts.get(space, 0) > 0 else []
    found: list[Pattern] = []
    at = bisect_left(lengths, min(top, space - (pieces - 1) * lengths[0]) + 1) - 1
    while at >= 0 and len(found) < width and lengths[at] * pieces >= space:
        x = lengths[at]
        if counts.get(x, 0) > 0:
            counts[x] -= 1
            for rest in exact_sums(lengths, counts, space - x, pieces - 1, x, 1):
                number = dict(rest)
                number[x] = number.get(x, 0) + 1
                found.append(tuple(sorted(number.items(), reverse=True)))
            counts[x] += 1
        at -= 1
    return found


def fillings(lengths: list[int], counts: dict[int, int], space: int, width: int | None = WIDTH) -> list[Pattern]:
    """Undominated ways to fill ``space`` with the pieces on hand, least waste first; ``lengths`` ascending.

    Fillings without waste by one, two or three pieces are looked up by their sums; others come from a walk that takes
    longest pieces first and goes on until nothing left over would still fit, cut off at ``width`` pieces tried a step. Without
    ``width`` the walk tries all pieces in all numbers, and all undominated fillings are returned.
    """
    if not lengths or space < lengths[0]:
        return [()]
    found: list[tuple[int, Pattern]] = []
    for pieces in (1, 2, 3) if width else ():
        if len(found) < width and (pieces < 3 or not found):
            found += [(0, f) for f in exact_sums(lengths, counts, space, pieces, space, width)]
    steps = 0

    def walk(top: int, space: int, chosen: Pattern) -> None:
        nonlocal steps
        at = bisect_left(lengths, min(top, space) + 1) - 1
        tried = 0
        fits = False
        while at >= 0 and (not width or tried < width):
            x = lengths[at]
            if counts.get(x, 0) > 0:
                if width and fits and (steps >= 40 * width or len(found) >= 4 * width):
                    break  # every filling that has been begun is still filled up
                fits = True
                steps += 1
                most = min(counts[x], space // x)
                for k in {most, 1} if width else range(1, most + 1):
                    walk(x - 1, space - x * k, (*chosen, (x, k)))
                tried += 1
            at -= 1
        if not fits:
            found.append((space, chosen))

    walk(space, space, ())
    found.sort(key=lambda f: (f[0], [(-x, -k) for x, k in f[1]]))
    kept: list[Pattern] = []
    for _, f in found:
        if f not in kept and not any(dominates(o, f, DOMINANCE_STATES if width else None) for o in kept):
            kept.append(f)
            if len(kept) == width:
                break
    return kept


def with_top(top: int, filling: Pattern) -> Pattern:
    """The whole bin: one piece of length ``top`` and a filling that may hold more of that length."""
    number = dict(filling)
    number[top] = number.get(top, 0) + 1
    return tuple(sorted(number.items(), reverse=True))


def bin_completion(counts: dict[int, int], capacity: int, nodes: int | None = NODES, width: int | None = WIDTH) -> Packing:
    """The packing with the fewest bins that the search finds; optimal when it meets ``lower_bound``, or without bounds (None)."""
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    best_bins = sum(m for _, m in best)
    bound = lower_bound(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    left = float("inf") if nodes is None else max(nodes, NODES_PER_LENGTH * len(counts)) if nodes == NODES else nodes

    # Depth first with an explicit stack of choices, as the depth can be some thousand. A choice is a filled bin and how often it is
    # applied at most; when it comes back it has been applied and is to be undone.
    rest = dict(counts)
    path: Packing = []
    stack: list[tuple[list[tuple[Pattern, int]], bool]] = []
    bins = waste = 0
    descend = best_bins > bound
    while descend or stack:
        if descend:
            descend = False
            left -= 1
            live = sorted(x for x, n in rest.items() if n)
            if not live:
                if bins < best_bins:
                    best, best_bins = list(path), bins
                    if best_bins == bound:
                        break
            elif left > 0 and bins + -(-sum(x * rest[x] for x in live) // capacity) < best_bins:
                top = live[-1]
                rest[top] -= 1
                options = [with_top(top, f) for f in fillings(live, rest, capacity - top, width)]
                rest[top] += 1
                stack.append(([(f, min(rest[x] // k for x, k in f)) for f in options], False))
        if not stack:
            break
        options, applied = stack.pop()
        if applied:  # undo the choice made here
            pattern, m = path.pop()
            spare = capacity - sum(x * k for x, k in pattern)
            for x, k in pattern:
                rest[x] += k * m
            bins -= m
            waste -= m * spare
            # The same bin fewer times: what follows then is another bin around the same longest piece. With a bounded search half as often.
            fewer = m - 1 if width is None else m // 2
            options = [(pattern, fewer), *options] if fewer else options
        if not options or left <= 0:
            continue
        pattern, m = options[0]
        spare = capacity - sum(x * k for x, k in pattern)
        if spare:
            m = min(m, ((best_bins - 1) * capacity - total - waste) // spare)
        if m <= 0:
            stack.append((options[1:], False))
            continue
        for x, k in pattern:
            rest[x] -= k * m
        path.append((pattern, m))
        bins += m
        waste += spare * m
        stack.append((options[1:], True))
        descend = True
    return best


class Layout:
    """Where the r-th piece of a length goes: intervals of ranks per length, as sorted arrays."""

    def __init__(self, packing: Packing):
        starts: Counter[int] = Counter()
        rows, sequence = [], 0
        for pattern, m in packing:
            offset = 0
            for x, k in pattern:
                rows.append(((x << 44) + starts[x], x, k, sequence, offset))
                starts[x] += k * m
                offset += x * k
            sequence += m
        rows.sort()
        self.key, self.length, self.each, self.sequence, self.offset = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 5))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(length):
            return length, rank
        at = np.searchsorted(self.key, (length << 44) + rank, side="right") - 1
        inside = (length << 44) + rank - self.key[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (any columns, one of them ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Every piece gets a place, repeated rows one each; sequences are filled from offset 0 without gaps. An empty table
    gives an empty result.
    """
    rows = scratch(pieces.withColumn("__row", F.monotonically_increasing_id()), "pack-pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    layout = rows.sparkSession.sparkContext.broadcast(Layout(bin_completion(counts, capacity, nodes)))
    salts = max(SALTS, sum(counts.values()) // GROUP_ROWS)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    by_length = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "__salt", F.coalesce(F.sum("__n").over(by_length), F.lit(0)).alias("__before"))
    own = Window.partitionBy("length", "__salt").orderBy("__row")
    ranked = salted.withColumn("__own", F.row_number().over(own) - 1).join(before.hint("merge"), ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__own")).drop("__salt", "__before", "__own", "__row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = layout.value.find(*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank")))
            others = [n for n in b.schema.names if n != "__rank"]
            yield pa.RecordBatch.from_arrays([*map(b.column, others), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*others, "sequence_id", "offset"])

    kept = ranked.select(*pieces.columns, "__rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__rank")
    return kept.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
