"""Near duplicates by similarity against all pairs of shingle sets."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from lodestone.llm import similar
from lodestone.llm.similar import drop_similar, fingerprints, shingles, similar_documents, spanning


def plain_set(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def near_copies(seed, originals=30):
    """Texts, and copies of them with more and more words replaced, inserted and cut off."""
    rng = random.Random(seed)
    texts = []
    for _ in range(originals):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(6, 300))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(0, 5)):
            other = list(words)
            for _ in range(rng.randrange(1, 1 + max(1, len(words) // 40))):
                at = rng.randrange(len(other))
                other[at : at + rng.randrange(2)] = [f"new{rng.randrange(99)}"] * rng.randrange(2)
            texts.append(" ".join(other))
    return texts


def test_shingles():
    for t in (None, "", " \n", "One", "a B c d", "a b c d e", "a b  c d e\tF g", "x " * 50, "é É a A"):
        assert len(shingles(t)) == len(plain_set(t)), t
    assert shingles("A b\nC").tolist() == shingles(" a b c ").tolist() != shingles("a c b").tolist()
    assert shingles("").tolist() == shingles(None).tolist()


def test_distance_of_fingerprints_follows_similarity():
    """Pairs of similarity 0.8 differ in about 15 % of all bits, unrelated ones in half."""
    rng = np.random.default_rng(1)
    rates = []
    for _ in range(30):
        common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
        x, y = (fingerprints(np.concatenate([common, own]), 9) for own in (a, b))
        rates.append(np.bitwise_count(x ^ y).sum() / 576)
    assert 0.13 < np.mean(rates) < 0.17
    x, y = (fingerprints(rng.integers(0, 1 << 63, 900).astype(np.uint64), 9) for _ in range(2))
    assert 0.4 < np.bitwise_count(x ^ y).sum() / 576 < 0.6


def test_spanning_forest_is_made_of_pairs_and_connects():
    rng = np.random.default_rng(2)
    a, b, weight = rng.integers(0, 300, 2000), rng.integers(0, 300, 2000), rng.integers(0, 9, 2000)
    kept = spanning(400, a, b, weight)
    connect = lambda a, b: similar._roots(400, a, b, np.arange(400)).tolist()
    assert len(kept) < 300
    for most in range(9):  # a minimum forest: also below every weight
        assert connect(a[kept][weight[kept] <= most], b[kept][weight[kept] <= most]) == connect(a[weight <= most], b[weight <= most])


@pytest.mark.parametrize("task_rows", [5, 50, 1 << 16])
def test_pairs_of_partitions(monkeypatch, task_rows):
    """All near pairs of each group come once or more, whatever the batches; many pairs leave a forest that connects them."""
    monkeypatch.setattr(similar, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(4)
    g = np.sort(rng.integers(0, 6, 300))
    value = (rng.integers(0, 8, 300) * 0x01010101 ^ (1 << rng.integers(0, 24, 300))).astype(np.int64)
    fp = np.array([0, (1 << 21) - 1])[(value % 5 == 0).astype(int)]  # equal tables of one group are near in the others here
    df = pd.DataFrame({"g": g, "sig": np.arange(300), "fp": fp, "value": value})
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if g[i] == g[j] and (int(value[i]) ^ int(value[j])).bit_count() <= 3 and fp[i] == fp[j]}
    connect = lambda pairs: similar._roots(300, *np.array(sorted(pairs)).T, np.arange(300)).tolist()
    for batch in (7, 100, 300):
        monkeypatch.setattr(similar, "PAIRS_A_MEMBER", 1)
        out = pd.concat(similar._pair_partition(df.iloc[a : a + batch] for a in range(0, 300, batch)))
        got = set(zip(out["u"], out["v"]))
        assert got <= near and connect(got) == connect(near) and len(out) < 400


def brute(texts, at_least=0.8):
    sets = [plain_set(t) or {()} for t in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and jaccard(sets[i], sets[j]) >= at_least:
                    label[i] = label[j] = min(label[i], label[j])
    return label


@pytest.mark.parametrize("pairs_a_member", [0, 1, 100])
def test_components_match_all_pairs(docs, monkeypatch, pairs_a_member):
    """Every component of all pairs of similarity 0.8 and more, whether all found pairs or a spanning forest of them is checked."""
    monkeypatch.setattr(similar, "PAIRS_A_MEMBER", pairs_a_member)
    texts = [*near_copies(5), None, "", "short text", "Short  TEXT", *near_copies(5, 3)]
    got = {r.doc_id: r.component_id for r in similar_documents(docs(list(enumerate(texts)))).collect()}
    want = brute(texts)
    assert got == dict(enumerate(want)) and 20 < len(set(want)) < len(texts) - 20


def test_one_row_of_each_component_stays(docs):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(7, long), (3, long.replace("w50", "x")), (9, long + " tail"), (5, "something else"), (None, long), (3, long.replace("w50", "x")), (4, None), (6, " ")]
    kept = drop_similar(docs(rows))
    assert kept.columns == docs(rows).columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert drop_similar(docs([])).count() == 0 and similar_documents(docs([])).count() == 0


def one_family(seed, copies, words=240, changes=9):
    """Copies of one text with words replaced: most pairs are a little below a similarity of 0.8, some a little above."""
    rng = random.Random(seed)
    first = [f"w{i}" for i in range(words)]
    made = []
    for _ in range(copies):
        own = list(first)
        for _ in range(rng.randrange(1, changes)):
            own[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        made.append(" ".join(own))
    return made


@pytest.mark.parametrize("least", [1 << 11, 1 << 18])
def test_large_families_lose_no_link(docs, monkeypatch, least):
    """Every link of a family with far more pairs than members, with all its members in a block or four in each."""
    monkeypatch.setattr(similar, "LEAST", least, raising=False)
    texts = [t for seed in range(2) for t in one_family(seed, 90)]
    sets = [plain_set(t) for t in texts]
    near = [(i, j) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    want = similar._roots(len(sets), *np.array(near).T, np.arange(len(sets))).tolist()
    got = {r.doc_id: r.component_id for r in similar_documents(docs(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) > 8


def test_similar_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 12, n).astype(np.uint64)) for n in rng.integers(1, 30, 60)]
    want = {(i, j) for j in range(60) for i in range(j) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8}
    assert set(zip(*(x.tolist() for x in similar.similar_sets(sets, 0.8)))) == want and want
