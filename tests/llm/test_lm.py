"""Language-model scoring against a plain model over dictionaries."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm
from lodestone.llm.common import held_out
from lodestone.llm.tokens import word_hashes


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w] + [None]


def model(train, order):
    """Counts of n-grams by order, number of tokens, share of unseen words, and the mass of contexts, over plain dictionaries."""
    seqs = [words_of(t) for t in train]
    counts = [Counter((w,) for s in seqs for w in s)]
    for n in range(2, order + 1):
        counts.append(Counter(tuple([None, *s][i : i + n]) for s in seqs for i in range(len(s) + 2 - n)))
    total = sum(counts[0].values())
    every, alone = Counter(), Counter()
    for n in range(2, order + 1):
        for g, c in counts[n - 1].items():
            rest = counts[n - 2][g[:-1]] - 1
            if rest:
                every[n, int(math.log2(rest))] += c
                alone[n, int(math.log2(rest))] += c == 1
    mass = lambda n, count: (alone[n, int(math.log2(count))] + 1) / (every[n, int(math.log2(count))] + 2)
    return counts, total, min(max(sum(v == 1 for v in counts[0].values()), 0.5) / total, 0.5), mass


def plain(train, texts, order):
    counts, total, unseen, mass = model(train, order)
    c = counts[0]

    def p(context, w):
        if not context:
            return (1 - unseen) * c[(w,)] / total if c[(w,)] else unseen
        lower, count = p(context[1:], w), counts[len(context) - 1][context]
        if not count or (len(context) > 1 and context[-1] is None):
            return lower
        m = mass(len(context) + 1, count)
        return (1 - m) * counts[len(context)][(*context, w)] / count + m * lower

    out = []
    for t in texts:
        s = [None, *words_of(t)]
        logp = sum(math.log10(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))
        base = sum(math.log10((c[(w,)] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in s[1:])
        out.append((len(s) - 1, sum(c[(w,)] > 0 for w in s[1:]), total, base, logp))
    return out


def test_word_hashes():
    data = b"  aa bb\taaaaaaaaa\x0baa " + b"q" * 100 + b" " + b"q" * 100 + b"\xc3\xa9"
    starts, h = word_hashes(data)
    assert starts.tolist() == [2, 5, 8, 18, 21, 122]
    assert h[0] == h[3] and len(set(h.tolist())) == 5
    assert word_hashes(b"")[0].tolist() == [] and word_hashes(b"a")[0].tolist() == [0]


def texts(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    out = [None, "", " \n", "Solo", "the The THE", "z " * 700]
    for _ in range(n):
        w, s = rng.choice(vocabulary), []
        for _ in range(rng.randrange(1, 30)):
            s.append(w if rng.random() < 0.9 else f"rare{rng.randrange(500)}")
            w = vocabulary[(vocabulary.index(w) * 7 + rng.randrange(3)) % 40]
        out.append(" ".join(s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_match_plain_model(docs, order):
    rows = list(enumerate(texts(120)))
    got = {r.doc_id: r for r in lm.score(docs(rows), held_out("doc_id", 5, 1), order=order, buckets=7).collect()}
    assert len(got) == len(rows)
    train = [t for i, t in rows if not got[i].held_out]
    assert 0 < len(train) < len(rows)
    for (i, _), want in zip(rows, plain(train, [t for _, t in rows], order)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], abs=1e-8) and r.score == pytest.approx(want[4], abs=1e-8)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_automaton_takes_the_same_steps(order):
    """One traversal by arcs and failure arcs gives the plain model's probability, and states sum to one."""
    every = texts(80)
    counts, total, unseen, mass = model(every[:60], order)
    auto = lm.Automaton(counts, None, total, unseen, mass)
    for t, want in zip(every, plain(every[:60], every, order)):
        assert auto.traverse(words_of(t)) == pytest.approx(want[4], abs=1e-8)
    for state in [auto.start, *list(auto.fail)[::40]]:
        known = sum(10 ** auto.weigh(state, g[0])[0] for g in counts[0])
        assert known + 10 ** auto.weigh(state, "never seen")[0] == pytest.approx(1)


def test_a_copy_in_training_raises_the_score(docs):
    """A held-out text whose copy is in the training texts scores far above one of the same words in another order."""
    rows = [(i, t) for i, t in enumerate(texts(300)) if t]
    words = [f"w{i % 40}" for i in range(0, 999, 7)]
    random.Random(1).shuffle(words)
    rows += [(5000, " ".join(words)), (5001, " ".join(words)), (5002, " ".join(sorted(words)))]
    got = {r.doc_id: r for r in lm.score(docs(rows), F.col("doc_id") > 5000).collect()}
    copy, other = got[5001], got[5002]
    assert copy.base_score == pytest.approx(other.base_score) and copy.score - copy.base_score > 0.5 * copy.n_tokens > other.score - other.base_score


def test_edges(docs, spark):
    never = F.lit(False)
    assert lm.score(docs([]), never).count() == 0
    same = lm.score(docs([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)]), never).collect()
    assert len(same) == 4 and {r.train_tokens for r in same} == {10}
    untrained = lm.score(docs([(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert [(r.n_known, r.base_score, r.score) for r in untrained] == [(0, 0.0, 0.0)] * 2


def test_chunks_keep_every_row(monkeypatch, docs):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 50)
    import pandas as pd

    rows = pd.DataFrame({"__text": [None, "a b c", "x" * 200, "", "d", "e f"] * 5, "i": range(30)})
    parts = list(lm.chunks(iter([rows.iloc[:7], rows.iloc[7:8], rows.iloc[8:]])))
    assert [i for p, _, _ in parts for i in p["i"]] == list(range(30))
    assert sum(len(h) for _, h, _ in parts) == 5 * (1 + 4 + 2 + 1 + 2 + 3)
    assert len(parts) > 5


def test_every_ngram_counts_whatever_the_corpus(docs):
    """150,000 more training tokens do not make the model forget n-grams seen once."""
    rows = [(0, "z " * 150_000), *((i + 1, t) for i, t in enumerate(texts(60)))]
    got = {r.doc_id: r for r in lm.score(docs(rows), F.col("doc_id") % 5 == 1, buckets=7).collect()}
    train = [t for i, t in rows if i % 5 != 1]
    for (i, _), want in zip(rows[1:], plain(train, [t for _, t in rows[1:]], lm.ORDER)):
        assert got[i].n_known == want[1] and got[i].score == pytest.approx(want[4], abs=1e-8)


def test_hashes_widen_with_the_corpus():
    assert [lm.hash_bits(n) for n in (0, 1 << 20, 1 << 30, 1 << 60)] == [40, 41, 51, 64]
    h = np.array([5, 6, 5, 6, 7, lm.END], np.uint64)
    doc = np.zeros(6, np.int64)
    wide, narrow = list(lm.grams_of(h, doc, 3)), list(lm.grams_of(h, doc, 3, 40))
    assert (wide[0][1] == narrow[0][1]).all() and (wide[2][1] >> np.uint64(24) == narrow[2][1]).all() and narrow[1][1].max() < 1 << 40
