"""Exact dedup and SimHash near-dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from lodestone.llm.simhash import components, drop_near_duplicates, fingerprint, large_group_links, near_links, simhash_near_dedup, trie_links

SAMPLE = [
    (5, "a  b\tc"), (3, "a b c"), (9, "a\n\x0b b c"), (1, None), (2, ""), (7, " "), (8, "A b c"),
    (4, "x" * 200_000), (6, "x" * 200_000), (10, "x" * 199_999 + "y"), (None, "a b c"), (11, "a\u2003b c"), (3, "a b c"),
]


def test_exact_dedup_matches_brute_force(docs):
    for digest_all in (True, False):
        got = exact_dedup(docs(SAMPLE), digest_all=digest_all).collect()
        groups = {}
        for i, t in SAMPLE:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
        want = {}
        for t, ids in groups.items():
            for i in ids:
                want[(i, hashlib.sha256(t.encode()).hexdigest())] = (min(x for x in ids if x is not None), len(ids))
        assert len(got) == len(SAMPLE)
        assert sum(r.kept for r in got) == len(groups)
        for r in got:
            if digest_all:
                assert (r.keep_id, r.group_size) == want[(r.doc_id, r.text_sha256)]
            if r.kept:
                assert r.doc_id == r.keep_id


def test_exact_dedup_hot_group_empty_and_drop(docs, spark):
    rows = [(i, "same text") for i in range(2000)] + [(i, f"text {i}") for i in range(2000, 4000)]
    got = exact_dedup(docs(rows)).collect()
    assert sum(r.kept for r in got) == 2001 and {r.group_size for r in got} == {1, 2000}
    assert exact_dedup(docs([])).count() == 0
    kept = drop_exact_duplicates(docs(SAMPLE))
    assert kept.columns == docs(SAMPLE).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7, 8, 10, 11]
    # An id may come with several texts; each row is judged by its own.
    mixed = docs([(1, "a"), (2, "a"), (2, "b"), (2, "b"), (None, "c"), (None, "c")])
    assert sorted((str(r.doc_id), r.text) for r in drop_exact_duplicates(mixed).collect()) == [("1", "a"), ("2", "b"), ("None", "c")]


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    texts = [None, "", " \t", "One", "one TWO", "Ünï ÜNÏ x a b\x0bc", " ".join(rng.choice("abcdefg") for _ in range(500))]
    for t in texts:
        assert fingerprint(t) == plain_fingerprint(t)


def brute_components(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def balls(seed, centres=25, each=12):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6])):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_trie_links_match_brute_force():
    fps = balls(3)
    label = trie_links(np.zeros(len(fps), np.int64), np.array(fps, dtype=np.uint64))
    assert label.tolist() == brute_components(fps)


@pytest.mark.parametrize("most", [2, 10, 100])
def test_large_groups_are_split(most):
    """A group beyond a traversal's size gives the same components, also when all members agree on most bits."""
    fps = balls(5)
    assert large_group_links(np.array(fps, dtype=np.uint64), most=most).tolist() == brute_components(fps)
    rng = random.Random(6)
    same = sorted({0xABCD << 40 | rng.getrandbits(9) << 3 for _ in range(200)})
    assert large_group_links(np.array(same, dtype=np.uint64), most=most).tolist() == brute_components(same)


def test_partitions_are_taken_in_pieces(monkeypatch):
    """Groups that span batches, and groups of more rows than a piece, keep all their links."""
    monkeypatch.setattr(simhash, "TASK_ROWS", 20)
    rows = [(g, x) for g in (1, 2, 3, 7, 8) for x in balls(g, centres=2 if g == 3 else 6, each=8)]
    g, fp = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64).view(np.int64)
    order = np.lexsort((np.random.default_rng(0).random(len(g)), g))
    df = pd.DataFrame({"g": g[order], "fp": fp[order]})
    for size in (1, 7, 33, 1000):
        edges = pd.concat(simhash._link_partition((df.iloc[a : a + size] for a in range(0, len(df), size)), 3))
        got = set(zip(edges["u"], edges["v"]))
        want = set()
        for own in (1, 2, 3, 7, 8):
            fps = sorted(x for gg, x in rows if gg == own)
            signed = np.array(fps, np.uint64).view(np.int64).tolist()
            want |= {(signed[i], signed[j]) for i, j in enumerate(brute_components(fps)) if i != j}
        assert got == want


def test_distributed_links_and_components(spark):
    fps = balls(4)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(fps)
    for split_over in (2, 256):
        roots = {r.v: r.root for r in components(near_links(df, split_over=split_over)).collect()}
        got = {}
        for x, w in zip(signed, want):
            got.setdefault(roots.get(x, x), set()).add(w)
        assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(want))


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {r.root for r in components(path).collect()} == {0}


def test_simhash_rows(docs):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(7, base), (3, base), (9, base + " tail"), (5, None), (4, ""), (6, "\n"), (8, "other words here entirely"), (None, base), (3, base)]
    got = simhash_near_dedup(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert by[4] == [5, 4, 6] or sorted(by[4]) == [4, 5, 6]
    assert by[8] == [8]
    assert {3, 7, None} <= set(by[3])
    assert simhash_near_dedup(docs([])).count() == 0
    kept = drop_near_duplicates(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(by)
    assert [r.doc_id for r in drop_near_duplicates(docs([(None, "a b"), (None, "a b"), (None, "x")]).filter("text = 'a b'")).collect()] == [None]
