"""Language identification and quality classification: brute force, held-out accuracy and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, quality
from lodestone.llm.ngrams import codes, hashed
from lodestone.llm.queries import op2_quality_classifier, op6_language_id

SF = "/root/testdata/sf0.01"


def test_langid_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op6_language_id(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_edges(docs, spark):
    rows = [(1, "hello there my friend"), (2, None), (3, ""), (4, "12 34 !!"), (5, "x" * 300_000), (5, "ÅÄÖ"), (None, "word")]
    model = langid.fit(docs([(i, "the cat and the dog") for i in range(5)], "en").unionByName(docs([(i, "der hund und die katze") for i in range(5)], "de")))
    block = model.block(0)
    assert block.langs == ["de", "en"] and model.blocks == 1
    assert block.score(["the dog and cat", "die katze und hund"])[0] == ["en", "de"]
    got = langid.predict(docs(rows), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got if r.lang_pred == "und"] == [(2, "und"), (3, "und"), (4, "und")]
    assert len(got) == len(rows) and {r.score for r in got if r.lang_pred == "und"} == {0.0}
    nothing = langid.fit(docs([]))
    assert {r.lang_pred for r in langid.predict(docs(rows), nothing).collect()} == {"und"}
    assert langid.predict(docs([]), model).count() == 0


def plain_multinomial(train, texts):
    """Posterior of each language by dictionaries of n-gram counts; the smaller language of the best, and its share."""
    clean = lambda t: " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
    grams = lambda t: [bucket(t[i : i + n], langid.BITS) for n in langid.SIZES for i in range(len(t) - n + 1)]
    counts, docs = defaultdict(Counter), Counter()
    for lang, text in train:
        docs[lang] += 1
        counts[lang].update(grams(clean(text)))
    out = []
    for t in texts:
        logs = {}
        for lang in docs:
            size = sum(counts[lang].values()) + langid.SMOOTHING * (1 << langid.BITS)
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][g] + langid.SMOOTHING) / size) for g in grams(clean(t)))
        top = max(logs.values())
        out.append((min(x for x in logs if logs[x] == top), 1 / sum(math.exp(v - top) for v in logs.values())))
    return out


@pytest.mark.parametrize("block_langs", [32, 2])
def test_langid_matches_brute_force(docs, block_langs):
    """Five languages in one block of the matrix or in several: the same multinomial model."""
    rng = random.Random(4)
    letters = {"aa": "abcdef", "bb": "bcdefg", "cc": "xyzabc", "dd": "éèab", "ee": "абвгд"}
    make = lambda alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9)))
    train = [(lang, make(alphabet)) for lang, alphabet in letters.items() for _ in range(rng.randrange(3, 8))]
    rows = None
    for lang in letters:
        part = docs([(i, t) for i, (x, t) in enumerate(train) if x == lang], lang)
        rows = part if rows is None else rows.unionByName(part)
    model = langid.fit(rows, block_langs=block_langs)
    assert model.size == 5 and (model.blocks > 1) == (block_langs == 2)
    texts = [make(rng.choice(list(letters.values()))) for _ in range(40)]
    asked = docs([*enumerate(texts), (100, "12 3"), (101, None), (7, texts[7])])
    got = langid.predict(asked, model, keep=["source"]).collect()
    assert len(got) == 43 and [(r.lang_pred, r.score) for r in got if r.doc_id >= 100] == [("und", 0.0)] * 2
    want = plain_multinomial(train, texts)
    for r in got:
        if r.doc_id < 100:
            assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-9)
    kept = langid.keep_known(asked, model, 0.9)
    assert kept.columns == asked.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.lang_pred != "und" and r.score >= 0.9)


def test_quality_held_out_accuracy(spark):
    got = op2_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect())


def test_quality_edges(docs, spark):
    good = docs([(i, f"plain words of text number {i}") for i in range(30)]).withColumn("quality", F.lit(1))
    bad = docs([(i, f"$$$ ### {i} !!! &&&") for i in range(30, 60)]).withColumn("quality", F.lit(0))
    model = quality.fit(good.unionByName(bad).unionByName(bad.limit(3).withColumn("quality", F.lit(None).cast("int"))))
    rows = [(1, "some plain words"), (2, None), (3, ""), (4, "### !!! $$$ &&& ###"), (5, "w " * 100_000), (None, "a")]
    got = {r.doc_id: r for r in quality.predict(docs(rows), model).collect()}
    assert len(got) == 6 and got[1].predicted == 1 and got[4].predicted == 0 and got[2].score == got[3].score
    for train in (docs([]).withColumn("quality", F.lit(1)), good):
        flat = quality.predict(docs(rows), quality.fit(train)).collect()
        assert len({r.score for r in flat}) == 1
    assert quality.predict(docs([]), model).count() == 0


def bucket(gram, bits):
    return int(next(hashed(codes(gram), (len(gram),), bits))[0])


def plain_features(text):
    """Features of a text by slices, one n-gram at a time."""
    found = {bucket(text[i : i + n], quality.BITS) for n in quality.SIZES for i in range(len(text) - n + 1)}
    words = text.split()
    shares = [(i, sum(a == b for a, b in zip(words[g:], words)) / (len(words) - g)) for i, g in enumerate(quality.GAPS) if len(words) > g]
    if words:
        shares.append((len(quality.GAPS), len(set(words)) / len(words)))
    return found | {(1 << quality.BITS) + quality.PLACES * i + int(8 * s) for i, s in shares}


def test_quality_matches_brute_force(docs):
    """Counts and ratios by dictionaries; the hinge fit by its duality gap; the score from both by plain sums."""
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"] if i % 3 else ["$$", "beta", "!!"]) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    train = quality.training_rows(docs(texts).withColumn("quality", (F.col("doc_id") % 3 != 0).cast("int")), "doc_id", "text", "quality")
    rows, counts = quality.class_counts(train)
    features = [plain_features(t) for _, t in texts]
    want = [Counter(f for i, own in enumerate(features) if (i % 3 != 0) == y for f in own) for y in (0, 1)]
    assert rows.tolist() == [20, 40]
    for y in (0, 1):
        assert {f: int(n) for f, n in enumerate(counts[y]) if n} == dict(want[y])
    ratio = quality.log_count_ratios(counts)
    sums = [sum(c.values()) + quality.FEATURES for c in want]
    for f in range(quality.FEATURES):
        plain = math.log((want[1][f] + 1) / sums[1]) - math.log((want[0][f] + 1) / sums[0]) if f in want[0] or f in want[1] else 0.0
        assert abs(ratio[f] - plain) < 1e-9
    cells, y = quality.sample(train, 4000)
    assert sorted(map(sorted, map(np.ndarray.tolist, cells))) == sorted(map(sorted, features)) and (y > 0).sum() == 40
    scaled, bias = quality.descend(cells, y, ratio, epochs=400)
    w = np.divide(scaled, ratio, out=np.zeros_like(scaled), where=ratio != 0)
    x = [{f: ratio[f] / math.sqrt(max(1, len(own))) for f in own.tolist()} for own in cells]
    margins = [sum(w[f] * v for f, v in own.items()) + bias for own in x]
    primal = (sum(w * w) + bias * bias) / 2 + sum(max(0, 1 - yi * m) for yi, m in zip(y, margins))
    # w = sum alpha_i y_i x_i: the dual value is sum(alpha) - |w|^2 / 2, and sum(alpha) = |w|^2 + sum(alpha_i (1 - y_i m_i)) at its optimum.
    assert primal <= 1.001 * sum(abs(a) for a in dual_optimum(x, y)[1]) - dual_optimum(x, y)[0] / 2 + 1e-3
    model = quality.fit(docs(texts).withColumn("quality", (F.col("doc_id") % 3 != 0).cast("int")))
    for _, t in texts[:20]:
        own = sorted(plain_features(t))
        margin = sum(model.weights[f] for f in own) / math.sqrt(max(1, len(own))) + model.bias
        assert model.score(model.margin(quality.Cells()(t))) == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))))


def dual_optimum(x, y, rounds=3000):
    """(|w|^2, alpha) of the dual problem by plain coordinate steps over dictionaries."""
    kernel = [[sum(v * b[f] for f, v in a.items() if f in b) + 1 for b in x] for a in x]
    alpha = [0.0] * len(x)
    g = [0.0] * len(x)  # w.x_i
    for step in range(rounds):
        i = step % len(x)
        new = min(max(alpha[i] - (y[i] * g[i] - 1) / kernel[i][i], 0.0), quality.COST)
        for j in range(len(x)):
            g[j] += (new - alpha[i]) * y[i] * kernel[i][j]
        alpha[i] = new
    return sum(a * yi * gi for a, yi, gi in zip(alpha, y, g)), alpha


def test_quality_learns_from_long_texts(docs):
    """Labelled texts of 30,000 characters teach as much as short ones, and the sample's size is an argument."""
    words = [["plain words of text"], ["$$$ ### !!! &&&"]]
    rows = docs([(i, f"{words[i % 2][0]} {i} " * 1500) for i in range(40)]).withColumn("quality", (F.col("doc_id") % 2 == 0).cast("int"))
    model = quality.fit(rows)
    good, bad = (model.score(model.margin(quality.Cells()(t))) for t in ("plain text of words", "### !!! $$$"))
    assert np.count_nonzero(model.weights) > 100 and good > 0.7 > 0.3 > bad
    few, y = quality.sample(quality.training_rows(rows, "doc_id", "text", "quality"), 10)
    assert len(few) == 10 and (y > 0).sum() == 5


def test_packed_cells(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (0, 1, 4000, 4200, quality.FEATURES):
        cells = rng.permutation(quality.FEATURES)[:n]
        data = quality.packed(cells)
        assert len(data) <= quality.FEATURES // 8 + 3 and quality.unpacked(data).tolist() == sorted(cells.tolist())
        for held in (quality.Sample([data], 0), quality.Sample([data], quality.UNPACKED_CELLS + 1)):
            assert held[0].tolist() == sorted(cells.tolist()) == held.only(np.array([0]))[0].tolist()


def test_dual_coordinate_descent_separates_and_balances():
    rng = random.Random(5)
    rows = [np.array(sorted({0 if i % 2 else 1, *(rng.randrange(2, 40) for _ in range(6))})) for i in range(200)]
    y = np.array([1 if i % 2 else -1 for i in range(200)])
    weights, bias = quality.descend(rows, y, np.ones(40))
    margin = np.array([weights[r].sum() / np.sqrt(len(r)) + bias for r in rows])
    assert (np.sign(margin) == y).all() and weights[0] > 0 > weights[1]


def test_platt_recovers_rates():
    rng = np.random.default_rng(0)
    m = rng.normal(size=4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(2 * m + 0.5)))
    slope, offset = quality.platt(m, y)
    assert slope == pytest.approx(2, abs=0.25) and offset == pytest.approx(0.5, abs=0.15)
