"""Exact deduplication by progressive refinement, in DataFrame functions only.

1. *Length, prefix.* One scan yields the length and a prefix hash of the normalised text. Grouping by
   length and, within it, by prefix hash leaves the groups of two rows or more.
2. *Full hash.* The surviving groups become a bitmap of fixed size that is broadcast. A second scan
   hashes the full content of rows whose group may have survived; all other rows are unique already.
3. *Groups.* Rows with equal length, prefix and SHA-256 form a group; its smallest id stays.

No text is ever shuffled: only ids, lengths and hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bitmap, keep_rows, row_key, scratch, spread_join, with_maybe

#: Characters of the normalised text that the prefix hash covers.
PREFIX_CHARS = 128
#: The bitmap of surviving groups has 2**BITMAP_BITS bits (2 MB), whatever the input; more surviving
#: groups mean more rows hashed in vain, never a wrong result.
BITMAP_BITS = 24


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = BITMAP_BITS, digest_all: bool = False
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after each run of ASCII whitespace is replaced by one space; null counts
    as empty. Of equal texts the row with the smallest id stays. Null ids come last; of rows that repeat the
    smallest id exactly one stays. ``text_sha256`` is null for rows whose full content was not needed, unless
    ``digest_all`` asks for every digest. Extra columns are ignored; an empty table gives an empty result.
    """
    return _decide(docs, id_col, text_col, bits, digest_all).drop("__key", "__hash")


def _decide(docs: DataFrame, id_col: str, text_col: str, bits: int, digest_all: bool) -> DataFrame:
    """``exact_dedup`` with the row keys of ``keep_rows``."""
    text = docs.select(F.col(id_col).alias("__id"), normalised(text_col).alias("__norm"), *row_key(id_col, text_col))
    keyed = text.select(
        "__id",
        "__key",
        "__hash",
        "__norm",
        F.octet_length("__norm").alias("__len"),
        F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("__pre"),
    )
    survivors = keyed.groupBy("__len", "__pre").agg(F.count("*").alias("__n")).filter("__n > 1")
    hashed = with_maybe(keyed, bitmap(survivors, ["__len", "__pre"], bits), ["__len", "__pre"], bits)
    full = F.sha2(F.encode("__norm", "UTF-8"), 256)
    rows = scratch(
        hashed.select(
            "__id",
            "__key",
            "__hash",
            "__len",
            "__pre",
            "__maybe",
            (full if digest_all else F.when(F.col("__maybe"), full)).alias("__full"),
            F.monotonically_increasing_id().alias("__row"),
        ),
        "dedup-rows",
    )
    maybe = rows.filter("__maybe")
    keys = ["__len", "__pre", "__full"]
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row")))
    groups = maybe.groupBy(*keys).agg(F.count("*").alias("group_size"), first.alias("__first"))
    grouped = spread_join(maybe, groups, keys, "__row")
    out = grouped.select(
        F.col("__id").alias(id_col),
        F.col("__first.id").alias("keep_id"),
        "group_size",
        (F.col("__row") == F.col("__first.row")).alias("kept"),
        F.col("__full").alias("text_sha256"),
        "__key",
        "__hash",
    )
    alone = rows.filter(~F.col("__maybe")).select(
        F.col("__id").alias(id_col),
        F.col("__id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("__full").alias("text_sha256"),
        "__key",
        "__hash",
    )
    return out.unionByName(alone)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an id and text one stays."""
    decided = scratch(_decide(docs, id_col, text_col, BITMAP_BITS, False), "dedup-decided")
    return keep_rows(docs, decided, decided.filter("kept"), id_col, text_col)
