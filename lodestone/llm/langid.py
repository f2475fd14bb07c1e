"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of all training documents: each task keeps one count vector per language and
emits its non-zero entries, which are summed by (language, bucket). The matrix of log-probabilities has
2**BITS columns per language, whatever the corpus. It is broadcast in blocks of about BLOCK_LANGS languages (16 MB); with more
languages than that, documents are scored block by block and the best of all blocks counts. Scoring gathers matrix rows for a
batch of documents in compressed sparse row form and adds them up per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import accepted, scratch, slices
from .ngrams import codes, hashed

BITS = 16
SIZES = (1, 2, 3)
SMOOTHING = 0.5
#: Languages of a block of the matrix, and count vectors that a training task holds.
BLOCK_LANGS = 32
#: N-grams scored at once.
SCORE_BLOCK = 1 << 18
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def _cells(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, lower-cased, with every run of other characters as one space."""
    return hashed(codes(" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "), SIZES, BITS)


class LangBlock:
    """Some languages and their matrix: ``table[bucket, language]`` log-probabilities, ``prior[language]``."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.table, self.prior = langs, table, prior

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(whether a text has a letter, joint log-probability of each text and language)."""
        sums = np.tile(self.prior, (len(texts), 1))
        known = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
        cells: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def add() -> None:
            starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])[:-1]]).astype(np.int64)
            np.add.at(sums, owner, np.add.reduceat(self.table[np.concatenate(cells)], starts, axis=0))

        for i in np.flatnonzero(known).tolist():
            for c in _cells(texts[i]):
                if len(c):
                    cells.append(c)
                    owner.append(i)
                    size += len(c)
                if size > SCORE_BLOCK:
                    add()
                    cells, owner, size = [], [], 0
        if cells:
            add()
        return known, sums

    def best(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Best language (the smaller of two as good; None without a letter), its log-probability, and the sum over languages relative to it."""
        known, sums = self.sums(texts)
        best = sums.argmax(axis=1)
        top = sums[np.arange(len(texts)), best]
        return [self.langs[b] if k else None for b, k in zip(best.tolist(), known.tolist())], top, np.exp(sums - top[:, None]).sum(axis=1)

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior probability per text; ``und`` with 0 for no letter or no language."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        lang, _, whole = self.best(texts)
        return [x or UNKNOWN for x in lang], np.array([1 / w if x else 0.0 for x, w in zip(lang, whole)])


class LangModel:
    """All languages, in blocks that are made from the written counts (``lang``, ``cell``, ``n``; cell 2**BITS counts documents)."""

    def __init__(self, counts: DataFrame, langs: int, docs: int, block_langs: int = BLOCK_LANGS):
        self.counts, self.size, self.docs = counts, langs, docs
        self.blocks = max(1, -(-langs // block_langs))

    def block(self, k: int) -> LangBlock:
        """Languages whose hash falls to block k: at most about BLOCK_LANGS times 2**BITS + 1 rows come to the driver."""
        got = self.counts.filter(F.pmod(F.xxhash64("lang"), F.lit(self.blocks)) == k).toArrow()
        langs = sorted(set(got["lang"].to_pylist()))
        counts = np.zeros(((1 << BITS) + 1, len(langs)))
        if langs:
            where = np.searchsorted(np.array(langs, dtype=object), np.array(got["lang"].to_pylist(), dtype=object))
            counts[got["cell"].to_numpy(), where] = got["n"].to_numpy()
        cells = counts[:-1] + SMOOTHING
        return LangBlock(langs, np.log(cells / cells.sum(axis=0)), np.log(counts[-1] / max(1, self.docs)))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", *, block_langs: int = BLOCK_LANGS) -> LangModel:
    """Learn from every row of ``train`` with a text and a language, whatever the number of languages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}

        def sums() -> Iterator[pd.DataFrame]:
            for lang, own in found.items():
                at = np.flatnonzero(own)
                yield pd.DataFrame({"lang": lang, "cell": at, "n": own[at]})

        for b in batches:
            for lang, text in zip(b["__lang"], b["__text"]):
                if lang not in found and len(found) == block_langs:
                    yield from sums()
                    found = {}
                own = found.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
                own[-1] += 1
                for c in _cells(text):
                    if len(c) > 1 << (BITS - 3):
                        own[:-1] += np.bincount(c, minlength=1 << BITS)
                    else:
                        np.add.at(own, c, 1)
        yield from sums()

    rows = train.select(F.col(lang_col).cast("string").alias("__lang"), F.col(text_col).alias("__text")).dropna()
    counts = scratch(rows.mapInPandas(count, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")), "langid-counts")
    docs = counts.filter(F.col("cell") == 1 << BITS).agg(F.count("*").alias("langs"), F.sum("n").alias("docs")).first()
    return LangModel(counts, docs.langs, docs.docs or 0, block_langs)


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id, the columns named in ``keep``, ``lang_pred``, ``score``.

    ``und`` and 0 where the text is null or has no letter, or where nothing could be learnt; of languages as good as each other the
    smaller one. Whole texts of any length are scored. Extra columns are ignored; an empty table gives an empty result.
    """
    names = [id_col, *(keep or [])]
    rows = docs.select(*names, F.col(text_col).alias("__text"))
    if model.blocks > 1:
        return _predict_by_block(rows.toDF(*[f"c{i}" for i in range(len(names))], "__text"), model).toDF(*names, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model.block(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = shared.value.score(b.column("__text").to_pylist())
            others = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*map(b.column, others), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*others, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def _predict_by_block(rows: DataFrame, model: LangModel) -> DataFrame:
    """``predict`` one block of languages at a time; each pass is written, so that no more than one block is in memory."""
    spark = rows.sparkSession
    rows = scratch(rows.withColumn("__row", F.monotonically_increasing_id()), "langid-rows")
    passes = []
    for k in range(model.blocks):
        own = model.block(k)
        if not own.langs:
            continue
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                lang, top, whole = shared.value.best(b.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array(whole, pa.float64())], names=["__row", "lang", "top", "whole"])

        passes.append(scratch(rows.select("__row", "__text").mapInArrow(run, "__row bigint, lang string, top double, whole double"), "langid-block"))
        shared.unpersist()
    every = passes[0]
    for more in passes[1:]:
        every = every.unionByName(more)
    # One row per document and block; the best has the largest log-probability, ties go to the smaller language.
    parts = every.filter("lang is not null").groupBy("__row").agg(F.min(F.struct((-F.col("top")).alias("minus"), F.col("lang").alias("lang"))).alias("b"), F.collect_list(F.struct("top", "whole")).alias("p"))
    whole = F.aggregate("p", F.lit(0.0), lambda total, x: total + x["whole"] * F.exp(x["top"] + F.col("b.minus")))
    found = parts.select("__row", F.col("b.lang").alias("lang_pred"), (1 / whole).alias("score"))
    both = rows.drop("__text").join(found, "__row", "left").drop("__row")
    return both.withColumns({"lang_pred": F.coalesce("lang_pred", F.lit(UNKNOWN)), "score": F.coalesce("score", F.lit(0.0))})


def keep_known(docs: DataFrame, model: LangModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a letter and a language of at least the score ``least``.

    Where no language could be learnt, every text with a letter stays, as there is nothing to reject it by.
    """
    if not model.size:
        return accepted(docs, text_col, lambda texts: [t is not None and _LETTER.search(t) is not None for t in texts])
    if model.blocks > 1:
        columns = [f"c{i}" for i in range(len(docs.columns))]
        keyed = scratch(docs.toDF(*columns).withColumn("__row", F.monotonically_increasing_id()), "langid-docs")
        judged = predict(keyed, model, "__row", columns[docs.columns.index(text_col)])
        good = judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("__row")
        return keyed.join(good, "__row", "left_semi").drop("__row").toDF(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model.block(0))

    def judge(texts: list[str | None]) -> list[bool]:
        lang, score = shared.value.score(texts)
        return [x != UNKNOWN and s >= least for x, s in zip(lang, score.tolist())]

    return accepted(docs, text_col, judge)
