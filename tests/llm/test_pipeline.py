"""Every stage of the pipeline against brute force on a small table with rows of every odd kind."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestone.llm import langid, quality
from lodestone.llm.common import held_out

SF = "/root/testdata/sf0.001"
BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls, blanks, repeated rows, copies, large ids beside null ids, and columns with clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.orderBy("doc_id").first().text
    more = [(BIG, text + " ", None, None, None), (BIG + 1, None, "en", "s", 0), (None, text, "fr", "s", 1), (BIG + 2, " \n", "en", "s", 2), (BIG + 3, "1 2 3", "en", "s", 5), (7, text, "fr", "s", 1)]
    made = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(docs.filter("doc_id < 3"))
    for name in ("score", "lang_pred", "predicted", "__key", "__maybe", "kept", "fp", "c0"):
        made = made.withColumn(name, F.lit("x"))
    return made.repartition(3)


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_against_brute_force(spark, odd):
    before, docs = rows_of(odd), odd
    stages = dict(cp.STAGES)
    # Language: the model applied to each text.
    model = langid.fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2)))
    lang, score = model.block(0).score([t for _, t in before])
    want = {k: n for (k, n), x, s in zip(before.items(), lang, score) if x != "und" and s >= 0.5}
    out = stages["language_id"](spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes and rows_of(out) == want
    assert not {BIG + 1, BIG + 2, BIG + 3} & {i for i, _ in want} and (BIG, before and next(t for i, t in before if i == BIG)) in want
    docs = spark.createDataFrame(out.collect(), docs.schema)
    # Quality: the same.
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.labelled(docs.filter(~held_out("doc_id", 4, 2)), labels))
    cells = quality.Cells()
    want = {k: n for k, n in rows_of(docs).items() if model.score(model.margin(cells(k[1]))) >= 0.7}
    out = stages["quality_classifier"](spark, docs, SF)
    assert out.dtypes == docs.dtypes and rows_of(out) == want
    good = {r.doc_id for r in labels.filter("quality = 1").collect()} & {i for i, _ in rows_of(docs)}
    assert len(good - {i for i, _ in want}) <= 2
    docs = spark.createDataFrame(out.collect(), docs.schema)
    # Exact copies: the smallest id of each normalised text, null ids last.
    groups = {}
    for i, t in rows_of(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append((i is None, i or 0, t))
    first = [min(g) for g in groups.values()]
    out = stages["exact_dedup"](spark, docs, SF)
    assert out.dtypes == docs.dtypes and sorted((none, i or 0) for none, i, _ in first) == sorted((i is None, i or 0) for i, _ in rows_of(out).elements())
    docs = spark.createDataFrame(out.collect(), docs.schema)
    # Near copies: the smallest id of each component of texts alike in at least 0.8 of their five-word shingles.
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for _, t in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
        n = min(5, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    label, changed = list(range(len(rows))), True
    near = [[b for b in range(len(rows)) if len(x & sets[b]) >= 0.8 * len(x | sets[b])] for x in sets]
    while changed:
        changed = False
        for a, others in enumerate(near):
            low = min(label[b] for b in others)
            changed |= low < label[a]
            label[a] = min(label[a], low)
    out = stages["simhash_near_dedup"](spark, docs, SF)
    assert out.dtypes == docs.dtypes and rows_of(out) == Counter(rows[i] for i in set(label))
    docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = stages["best_fit_packing"](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows_of(docs)}
    bins = Counter()
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def test_run_is_the_chain_of_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    key = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(cp.STAGES[-1][1](spark, docs, SF).collect()) == key(cp.run(spark, SF).collect())


def test_without_languages_only_texts_without_letters_go(spark):
    rows = [(1, "some text", None, "s", 9), (2, "1 2", None, "s", 3), (3, None, None, "s", 0), (6, "ett", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in dict(cp.STAGES)["language_id"](spark, docs, SF).collect()) == [1, 6]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns == docs.columns
    assert cp.STAGES[-1][1](spark, docs, SF).count() == 0
