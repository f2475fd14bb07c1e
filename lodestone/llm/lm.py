"""Language-model scoring with a weighted backoff automaton.

Tasks turn chunks of documents into tokens, written once, and into sorted hashes of their n-grams up to ``order``
with their counts in training texts. These blobs are dealt by hash to buckets, where totals are summed and each
chunk's share of the totals is sent back. Every n-gram of the training texts counts, whatever the corpus; neither
the vocabulary nor the n-grams leave the buckets but as counts for the chunks that hold them. A frequent n-gram is one entry
per chunk, and as n-grams are dealt by all of their words, no bucket holds all continuations of a frequent word.

States of the automaton are contexts h that training texts continue. The arc of a word w that follows h carries
log10((1 - m) c(h, w) / c(h) + m P(w | h')), where h' is h without its first word; the failure arc to h' carries log10(m).
The mass m that a context leaves to words it has not been followed by is learnt from all training texts, for each order
and each power of two of c(h), by leaving one out: of the tokens whose context comes r + 1 times, the share that follow it
nowhere else is the mass of contexts that come r times. At the root a word has (1 - u) c / N, and all words never seen in
training share u, the share of words seen once (Good-Turing). A document is traversed once from left to right; as a step
depends on the last ``order`` words alone, a chunk takes the steps of all its positions at once.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, scratch
from .tokens import mix, word_hashes

ORDER = 3
#: Bytes of text that a task handles at once (a longer document is a chunk of its own).
CHUNK_BYTES = 6 << 20
CHUNK_DOCS = 20_000
#: Tokens of the corpus for each bucket: the size of a counting task stays the same at every size.
BUCKET_TOKENS = 1 << 20
#: Hashes of n-grams have that many bits more than the number of tokens, 64 at most: fewer than one n-gram in 2**SPARE_BITS shares
#: its hash with another one. Words always have all 64 bits.
SPARE_BITS = 20
#: Powers of two of a context's count.
LEVELS = 48
#: The end of a text as a token; it is also the context before the first word.
END = np.uint64(0x5BD1E9955BD1E995)

Chunk = tuple[pd.DataFrame, np.ndarray, np.ndarray]


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[Chunk]:
    """(rows, hash of each token, row number of each token); every row's tokens end with END."""
    waiting: list[pd.DataFrame] = []
    size = docs = 0

    def cut() -> Chunk:
        rows = pd.concat(waiting, ignore_index=True)
        texts = [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in rows.pop("__text")]
        starts, h = word_hashes(b"\n".join(texts))
        edges = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(edges, starts, side="right")
        last = np.cumsum(np.bincount(doc, minlength=len(rows)))
        return rows, np.insert(h, last, END), np.insert(doc, last, np.arange(len(rows)))

    for b in batches:
        sizes = b["__text"].map(lambda t: len(t) if isinstance(t, str) else 0).tolist()
        begin = 0
        for i, n in enumerate(sizes):
            if docs and (size + n > CHUNK_BYTES or docs >= CHUNK_DOCS):
                waiting.append(b.iloc[begin:i])
                yield cut()
                waiting, size, docs, begin = [], 0, 0, i
            size, docs = size + n, docs + 1
        waiting.append(b.iloc[begin:])
    if docs:
        yield cut()


def _packed(n: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes, as many as the largest one needs."""
    width = np.min_scalar_type(int(n.max(initial=0))).itemsize
    planes = n.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(packed[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{packed[0]}").ravel()


def _pack_hashes(h: np.ndarray) -> bytes:
    return _packed(np.diff(h, prepend=np.uint64(0)))  # modulo 2**64; sorted hashes have small differences


def _unpack_hashes(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed).astype(np.uint64), dtype=np.uint64)


def hash_bits(tokens: int) -> int:
    """Bits of the hashes of n-grams of two words and more."""
    return min(64, max(40, tokens.bit_length() + SPARE_BITS))


def grams_of(h: np.ndarray, doc: np.ndarray, order: int, bits: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n up to ``order``: positions where an n-gram ends, and its hash (64 bits for words, else ``bits``).

    END before a document counts as its first word. ``h`` holds tokens, so n-grams of n > 1 end at each document's first or a later one.
    """
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    place = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    at, key = np.arange(len(h)), h
    yield at, key
    before = np.full(len(h), END)  # the hash of the (n - 1)-gram that ends just before each position
    for n in range(2, order + 1):
        if n == 2:
            before[~first] = h[:-1][~first[1:]]
        else:
            last = np.zeros(len(h), np.uint64)
            last[at] = key
            at = np.flatnonzero(place >= n - 2)
            before = last[at - 1]
        key = mix((mix(before + np.uint64(n)) ^ h[at]) * np.uint64(0x9FB21C651E98DF25))
        yield at, key >> np.uint64(64 - bits)


def _deal(key: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Bucket of each hash; it grows with the hash, so that sorted hashes are in order of buckets."""
    return (((key >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


_TOKENS = "chunk bigint, trained bigint, n_tokens bigint, ids array<string>, held array<boolean>, sizes array<int>, words binary, tokens binary"
_BLOBS = "chunk bigint, n int, bucket int, keys binary, times binary"
_COUNTS = "chunk bigint, n int, bucket int, words bigint, once bigint, counts binary"
_COUNTED = "ids array<string>, held array<boolean>, sizes array<int>, counts array<binary>, starts bigint, words bigint, once bigint, every array<bigint>, alone array<bigint>"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per chunk: its documents' ids, whether they are held out, their sizes, and their tokens as places among its words."""
    part = TaskContext.get().partitionId()
    for seq, (rows, h, doc) in enumerate(chunks(batches)):
        held = rows["__held"].to_numpy(bool)
        sizes = np.bincount(doc, minlength=len(rows))
        words, tokens, times = np.unique(h, return_inverse=True, return_counts=True)
        common = np.argsort(-times, kind="stable")  # small numbers for common words
        place = np.empty(len(words), np.int64)
        place[common] = np.arange(len(words))
        row = ((part << 32) | seq, int(sizes[~held].sum()), len(h), rows["__id"].tolist(), held.tolist(), sizes.tolist(), _pack_hashes(words[common]), _packed(place[tokens]))
        yield pd.DataFrame([row], columns=_columns(_TOKENS))


def _read(r: object) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, row number of each token) of a row of ``_tokens``."""
    return _unpack_hashes(r.words)[_unpacked(r.tokens)], np.repeat(np.arange(len(r.sizes)), r.sizes)


def _blobs(batches: Iterator[pd.DataFrame], order: int, bits: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Per chunk, n and bucket the distinct n-grams, sorted, and how often training texts hold them."""
    for r in (r for b in batches for r in b.itertuples()):
        h, doc = _read(r)
        train = ~np.asarray(r.held, bool)
        for n, (at, key) in enumerate(grams_of(h, doc, order, bits), start=1):
            if not len(at):
                break
            key, back = np.unique(key, return_inverse=True)
            times = np.bincount(back[train[doc[at]]], minlength=len(key))
            bucket = _deal(key, bits if n > 1 else 64, buckets)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            out = [(r.chunk, n, int(bucket[a]), _pack_hashes(key[a:b]), _packed(times[a:b])) for a, b in zip(cut, np.append(cut[1:], len(key)))]
            yield pd.DataFrame(out, columns=_columns(_BLOBS))


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """For one n and bucket: per chunk the counts of its n-grams; with the first chunk the numbers of words seen, and seen once."""
    n, bucket = int(group["n"].iloc[0]), int(group["bucket"].iloc[0])
    parts = [_unpack_hashes(k) for k in group["keys"]]
    every, back = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, back, np.concatenate([_unpacked(t) for t in group["times"]]).astype(np.int64))
    out, at = [], 0
    for i, (chunk, keys) in enumerate(zip(group["chunk"].tolist(), parts)):
        own = back[at : at + len(keys)]
        at += len(keys)
        words, once = (int((total > 0).sum()), int((total == 1).sum())) if i == 0 and n == 1 else (0, 0)
        out.append((chunk, n, bucket, words, once, _packed(total[own])))
    return pd.DataFrame(out, columns=_columns(_COUNTS))


def _dealt(own: DataFrame, order: int, bits: int, buckets: int) -> DataFrame:
    """For every chunk the counts of its n-grams: rows of ``_tokens`` in, of ``_totals`` out."""
    blobs = own.select("chunk", "held", "sizes", "words", "tokens").mapInPandas(lambda it: _blobs(it, order, bits, buckets), _BLOBS)
    return blobs.groupBy("n", "bucket").applyInPandas(_totals, _COUNTS)


def _contexts(c: list[np.ndarray], first: np.ndarray, starts: int, n: int) -> np.ndarray:
    """Count of the context of the n-gram that ends at each position, from the counts of n-grams by order; 0 where there is none."""
    before = np.zeros(len(first), np.int64)
    before[1:] = c[n - 2][:-1]
    # The context of a document's first word is END alone; there is no longer one.
    return np.where(first, starts if n == 2 else 0, before)


def _level(count: np.ndarray) -> np.ndarray:
    """Power of two of a count of at least 1."""
    return np.frexp(count.astype(np.float64))[1] - 1


def _counted(chunk: pd.DataFrame, counts: pd.DataFrame, order: int, bits: int) -> pd.DataFrame:
    """One chunk with the counts of the n-grams at its positions, and what it tells about the mass of contexts."""
    r = next(chunk.itertuples())
    h, doc = _read(r)
    counts = counts.sort_values(["n", "bucket"])
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    train = ~np.asarray(r.held, bool)[doc]
    c: list[np.ndarray] = []
    for n, (at, key) in enumerate(grams_of(h, doc, order, bits), start=1):
        c.append(np.zeros(len(h), np.int64))
        if len(at):
            back = np.unique(key, return_inverse=True)[1]
            c[-1][at] = np.concatenate([_unpacked(x) for x in counts["counts"][counts["n"] == n]]).astype(np.int64)[back]
    starts = int(c[0][h == END][0])
    every, alone = np.zeros((order + 1, LEVELS), np.int64), np.zeros((order + 1, LEVELS), np.int64)
    for n in range(2, order + 1):
        rest = _contexts(c, first, starts, n) - 1
        use = train & (rest > 0)
        level = _level(rest[use])
        every[n], alone[n] = np.bincount(level, minlength=LEVELS), np.bincount(level[c[n - 1][use] == 1], minlength=LEVELS)
    row = (r.ids, r.held, r.sizes, [_packed(x) for x in c], starts, int(counts["words"].sum()), int(counts["once"].sum()), every.ravel(), alone.ravel())
    return pd.DataFrame([row], columns=_columns(_COUNTED))


def masses(every: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Mass of contexts by order (rows) and power of two of their count, strictly between 0 and 1; 1/2 where nothing is known."""
    return (alone + 1) / (every + 2)


def _scored(r: object, order: int, tokens: int, unseen: float, mass: np.ndarray) -> pd.DataFrame:
    """Sums per document of one chunk: the automaton's steps at all positions, from the root's arcs to those of the longest contexts."""
    doc = np.repeat(np.arange(len(r.sizes)), r.sizes)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    c = [_unpacked(x).astype(np.int64) for x in r.counts]
    p = np.where(c[0] > 0, (1 - unseen) / max(1, tokens) * c[0], unseen)
    for n in range(2, order + 1):
        context = _contexts(c, first, r.starts, n)
        at = np.flatnonzero(context > 0)  # elsewhere there is no such state
        m = mass[n, _level(context[at])]
        # Without an arc this is the failure arc: m times what the shorter context gives.
        p[at] = (1 - m) * c[n - 1][at] / context[at] + m * p[at]
    docs = len(r.sizes)
    return pd.DataFrame({
        "id": list(r.ids),
        "held": list(r.held),
        "n_tokens": np.asarray(r.sizes, np.int64),
        "known": np.bincount(doc, c[0] > 0, minlength=docs).astype(np.int64),
        "base": np.bincount(doc, np.log10(c[0] + 0.5), minlength=docs),
        "score": np.bincount(doc, np.log10(p), minlength=docs),
    })


class Automaton:
    """The whole automaton of a model that fits into memory; ``score`` takes the same steps without building it.

    ``counts[n - 1]`` maps n-grams (tuples) to their counts, ``end`` is the token before a text and after it, and ``mass`` gives
    the mass of a context from the length of its n-grams and its count. States are contexts; ``arcs`` lead from (state, word) to
    (weight, next state), ``fail`` from a state to (weight, state of the context without its first word).
    """

    def __init__(self, counts: list[dict[tuple, int]], end: Hashable, tokens: int, unseen: float, mass: Callable[[int, int], float]):
        self.unseen = float(np.log10(unseen))
        states = {()} | {g[:-1] for own in counts[1:] for g in own}
        suffix = lambda g: next(g[i:] for i in range(len(g) + 1) if g[i:] in states)
        self.fail: dict[tuple, tuple[float, tuple]] = {}
        longest = len(counts)
        self.arcs = {((), g[0]): (float(np.log10((1 - unseen) * c / tokens)), suffix(g if longest > 1 else ())) for g, c in counts[0].items()}
        for n, own in enumerate(counts[1:], start=2):
            for context in {g[:-1] for g in own}:
                self.fail[context] = (float(np.log10(mass(n, counts[n - 2][context]))), suffix(context[1:]))
            for g, c in own.items():
                context, count = g[:-1], counts[n - 2][g[:-1]]
                m = mass(n, count)
                lower = 10 ** self.weigh(self.fail[context][1], g[-1])[0]
                self.arcs[context, g[-1]] = (float(np.log10((1 - m) * c / count + m * lower)), suffix(g if n < longest else g[1:]))
        self.start = suffix((end,))

    def weigh(self, state: tuple, word: Hashable) -> tuple[float, tuple]:
        """(log10 probability of a word in a state, next state): failure arcs until there is an arc; unseen words end at the root."""
        total = 0.0
        while (arc := self.arcs.get((state, word))) is None:
            if not state:
                return total + self.unseen, ()
            weight, state = self.fail[state]
            total += weight
        return total + arc[0], arc[1]

    def traverse(self, words: list) -> float:
        """Log10 probability of a text (with its end), by one traversal from left to right."""
        state, total = self.start, 0.0
        for w in words:
            weight, state = self.weigh(state, w)
            total += weight
        return total


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", *, order: int = ORDER, buckets: int | None = None) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    The model learns from all rows where ``held_out`` is false. Null texts are empty, an empty text is the
    end token alone. Without training rows every score is 0. Repeated rows are all scored and all count.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).cast("string").alias("__id"),  # as text, since pandas has no integers with nulls
        F.coalesce(held_out, F.lit(False)).alias("__held"),
        F.col(text_col).alias("__text"),
    )
    own = scratch(rows.mapInPandas(_tokens, _TOKENS), "lm-tokens")
    sums = own.agg(F.sum("trained").alias("trained"), F.sum("n_tokens").alias("n")).first()
    tokens, whole = int(sums.trained or 0), int(sums.n or 0)
    bits, buckets = hash_bits(whole), buckets or max(16, whole // BUCKET_TOKENS)
    counts = scratch(_dealt(own, order, bits, buckets), "lm-counts")
    free(docs.sparkSession)  # the n-grams themselves are most of what is shuffled
    both = own.groupBy("chunk").cogroup(counts.groupBy("chunk"))
    counted = scratch(both.applyInPandas(lambda chunk, c: _counted(chunk, c, order, bits), _COUNTED), "lm-counted")
    # As many rows as orders and levels, whatever the corpus.
    levels = counted.select(F.posexplode(F.arrays_zip("every", "alone")).alias("place", "x")).groupBy("place").agg(F.sum("x.every").alias("every"), F.sum("x.alone").alias("alone"))
    every, alone = np.zeros((order + 1) * LEVELS), np.zeros((order + 1) * LEVELS)
    for r in levels.collect():
        every[r.place], alone[r.place] = r.every, r.alone
    mass = masses(every, alone).reshape(order + 1, LEVELS)
    sums = counted.agg(F.sum("words").alias("words"), F.sum("once").alias("once")).first()
    unseen = min(max(int(sums.once or 0), 0.5) / tokens, 0.5) if tokens else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield _scored(r, order, tokens, unseen, mass)

    scored = counted.select("ids", "held", "sizes", "counts", "starts").mapInPandas(run, "id string, held boolean, n_tokens bigint, known bigint, base double, score double")
    return scored.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(tokens + 0.5 * (int(sums.words or 0) + 1))))).alias("base_score"),
        "score",
    )
