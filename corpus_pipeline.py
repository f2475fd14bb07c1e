"""Training-corpus pipeline: language ID, quality filter, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
``run`` writes each stage's result to the shared folder before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, packing, quality
from lodestone.llm.common import held_out, scratch, table, text_batches
from lodestone.llm.exact_dedup import drop_exact_duplicates
from lodestone.llm.similar import drop_similar

#: Language predictions less sure than this are rejected.
MIN_LANG_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or a sure language; learns from the documents' own ``lang``, held-out ids excepted.

    Posteriors of whole texts are close to 1, so in effect only texts without a letter go; they alone go where no ``lang`` is given.
    """
    text_batches(spark)
    model = langid.fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2)))
    return langid.keep_known(docs, model, MIN_LANG_SCORE)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier predicts as 0; learns from ``labels``, held-out ids excepted."""
    text_batches(spark)
    train = quality.labelled(docs.filter(~held_out("doc_id", 4, 2)), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, quality.fit(train))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of equal texts."""
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more."""
    text_batches(spark)
    return drop_similar(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of what is left into sequences."""
    text_batches(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), payload="digest"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the learnt stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
