"""Bin completion against exact search, and whole packings of documents."""

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.packing import best_fit, bin_completion, cut, dominates, fillings, lower_bound, pack, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


def used(packing):
    got = Counter()
    for pattern, m in packing:
        for x, k in pattern:
            got[x] += k * m
    return got


def fewest(items, capacity):
    @cache
    def solve(rest):
        if not rest:
            return 0
        best, (top, *others) = len(rest), rest
        n = len(others)
        for mask in range(1 << n):
            chosen = [others[i] for i in range(n) if mask >> i & 1]
            if top + sum(chosen) <= capacity:
                best = min(best, 1 + solve(tuple(others[i] for i in range(n) if not mask >> i & 1)))
        return best

    return solve(tuple(sorted(items, reverse=True)))


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(9)
    better = 0
    for _ in range(60):
        items = [rng.randrange(10, 60) for _ in range(rng.randrange(1, 10))]
        counts = Counter(items)
        got = bin_completion(counts, 100)
        assert used(got) == counts and all(sum(x * k for x, k in p) <= 100 for p, _ in got)
        want = fewest(items, 100)
        assert lower_bound(counts, 100) <= want == sum(m for _, m in got)
        better += sum(m for _, m in best_fit(counts, 100)) > want
    # Known case in which best fit needs four bins.
    counts = Counter([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    assert sum(m for _, m in bin_completion(counts, 61)) == fewest(list(counts.elements()), 61)


def test_complete_search_is_optimal_whatever_the_multiplicities():
    """Without bounds on nodes and fillings, on histograms with pieces that come often, also where a bin must not be used as often as it could."""
    rng = random.Random(12)
    better = 0
    for _ in range(40):
        items = [x for x in (rng.randrange(15, 61) for _ in range(4)) for _ in range(rng.randrange(1, 4))]
        counts = Counter(items[:10])
        got = bin_completion(counts, 100, None, None)
        assert used(got) == counts and all(sum(x * k for x, k in p) <= 100 for p, _ in got)
        want = fewest(list(counts.elements()), 100)
        assert sum(m for _, m in got) == want
        better += sum(m for _, m in best_fit(counts, 100)) > want
    assert better


def test_dominance_by_brute_force():
    rng = random.Random(3)

    def shared(holes, items):
        return not items or any(h >= items[0] and shared([*holes[:i], h - items[0], *holes[i + 1 :]], items[1:]) for i, h in enumerate(holes))

    seen = set()
    for _ in range(300):
        a, b = (Counter(rng.randrange(1, 12) for _ in range(rng.randrange(0, n))) for n in (6, 9))
        want = shared(sorted(a.elements()), sorted(b.elements(), reverse=True))
        assert dominates(tuple(a.items()), tuple(b.items())) == want
        seen.add(want)
    assert seen == {True, False}


def test_large_histograms():
    rng = random.Random(4)
    counts = Counter(min(2047, int(rng.paretovariate(0.7) * 40)) for _ in range(30_000))
    counts[700] += 9_000_000
    got = bin_completion(counts, 2048)
    assert used(got) == counts and all(sum(x * k for x, k in p) <= 2048 for p, _ in got)
    bins = sum(m for _, m in got)
    assert lower_bound(counts, 2048) <= bins <= sum(m for _, m in best_fit(counts, 2048))
    assert best_fit({}, 10) == bin_completion({}, 10) == []


def test_fillings_and_dominance():
    assert dominates(((5, 1),), ((3, 1), (2, 1))) and not dominates(((3, 1), (2, 1)), ((5, 1),))
    assert fillings([2, 3, 5], {2: 1, 3: 1, 5: 1}, 5)[0] == ((5, 1),)
    assert fillings([4], {4: 0}, 3) == [()]


def test_cut():
    assert cut(1, 8) == [(0, 1)] and cut(8, 8) == [(0, 8)] and cut(9, 8) == [(0, 1), (1, 8)] and cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_documents(docs):
    rng = random.Random(1)
    words = ["alpha", "beta", "Gamma", "δέλτα", "e", "\n", "日本", "<|endoftext|>"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 900, 3000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "x"), (3, rows[3][1]), (102, " " * 5000), (103, "a" * 20_000)]
    df = docs(rows)
    library = Tokenizer.from_file(PATH)
    got = pack(pieces(df, PATH, payload="digest")).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(cut(len(ids), 2048)):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) == lower_bound(Counter(r.length for r in got), 2048)
    real = pieces(df.filter("doc_id = 101"), PATH).collect()
    assert [r.ids for r in real] == [[0]]
    assert pack(pieces(docs([]), PATH)).count() == 0


def test_hot_length(spark):
    same = spark.range(5000).select(F.lit(700).cast("long").alias("length"), "id")
    got = pack(same).groupBy("sequence_id").agg(F.count("*").alias("n"), F.sum("offset").alias("o")).collect()
    assert Counter((r.n, r.o) for r in got) == {(2, 700): 2500}
