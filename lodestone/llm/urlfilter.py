"""URL filtering with explicit rules and mined association rules.

Labelled URLs become transactions of host labels, path segments and query parts, with one more item
where the label says block. Tokens in too few blocked URLs cannot be in a rule and go first; tokens that occur in exactly the same
labelled URLs then become one item, as they would have the same counts in every itemset, and items whose confidence suffices alone are
rules that imply all rules with them, so they go as well. (Without that, each long URL that repeats would
give an itemset for every subset of its tokens.) Spark's parallel FP-growth mines the frequent itemsets of the rest; a rule is an itemset
with the block item whose confidence suffices. Rules that a shorter rule implies are pruned. A rule is a list of items, each
a list of tokens of which a URL must hold one: that is every shortest rule over single tokens at once. URLs are
matched through an inverted index from the tokens of each rule's rarest item to the rule. It is broadcast if it holds at most MAX_RULES
rules; with more, URLs and rules meet in a join on those tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_ITEM = "#block"
#: A rule's number of labelled URLs, whatever their number, and its confidence are at least these.
MIN_COUNT = 8
MIN_CONFIDENCE = 0.7
#: Rules that are broadcast at most.
MAX_RULES = 100_000
RULES_SCHEMA = "items array<array<string>>, support bigint, confidence double, anchor array<string>"

# Fixed values: (host, path, verdict) rules; a rule fits its host and all subdomains.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty for null or where there is no ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def explicit(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long rules the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def url_tokens(url: str) -> Column:
    """Distinct tokens of a URL: host labels (h:), path segments (p:) and query parts (q:); empty for null."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"\?([^#]*)", 1)
    parts = [("h:", host, r"\."), ("p:", F.lower(path), "/"), ("q:", F.lower(query), "&")]
    prefixed = lambda k: lambda x: F.concat(F.lit(k), x)
    made = [F.transform(F.filter(F.split(c, sep), lambda x: x != ""), prefixed(k)) for k, c, sep in parts]
    return F.array_distinct(F.concat(*made))


def items_of(rows: DataFrame, min_count: int) -> DataFrame:
    """(``item``, ``members``, ``n``, ``hits``, ``token``): the tokens of (``row``, ``tokens``, ``block``) that are in at least ``min_count`` blocked rows, and
    the item of each: its smallest token that is in the same rows; with the numbers of rows and of blocked rows. Sets of rows are compared by size and by 128 bits of hashes of their members."""
    single = rows.select("row", "block", F.explode("tokens").alias("token"))
    marks = [F.bit_xor(F.xxhash64("row", F.lit(seed))) for seed in (1, 2)]
    tokens = single.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("block").cast("long")).alias("hits"), marks[0].alias("x"), marks[1].alias("y"))
    # As many tokens as a URL has at most are in one item, since they are in one URL.
    items = tokens.filter(F.col("hits") >= min_count).groupBy("n", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members"), F.first("hits").alias("hits"))
    return items.select(F.col("members")[0].alias("item"), "members", "n", "hits", F.explode("members").alias("token"))


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "block", *, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (``items``, ``support``, ``confidence``, ``anchor``: the rarest item) from URLs and a boolean label; null labels are skipped.

    Repeated rows, and several labels of one URL, count each time. An empty table, or one without blocked URLs, gives no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label_col).isNotNull()).select(url_tokens(url_col).alias("tokens"), F.col(label_col).cast("boolean").alias("block"))
    rows = scratch(rows.withColumn("row", F.monotonically_increasing_id()), "url-transactions")
    items = scratch(items_of(rows, min_count).withColumn("confidence", F.col("hits") / F.col("n")), "url-items")
    alone = items.filter(F.col("confidence") >= min_confidence).select(F.array("members").alias("items"), F.col("hits").alias("support"), "confidence", F.col("members").alias("anchor")).distinct()
    others = items.filter(F.col("confidence") < min_confidence)
    if others.isEmpty():
        return alone
    named = spread_join(rows.select("row", "block", F.explode("tokens").alias("token")), others.select("token", "item"), ["token"], "row")
    block = F.when(F.first("block"), F.array(F.lit(BLOCK_ITEM))).otherwise(F.array().cast("array<string>"))
    baskets = scratch(named.groupBy("row").agg(F.concat(F.collect_set("item"), block).alias("items")).select("items"), "url-baskets")
    support = min(1.0, (min_count - 0.5) / baskets.count())  # FPGrowth rounds its product with the number of rows up
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence, numPartitions=parts).fit(baskets).freqItemsets
    sets = sets.select(F.array_sort("items").alias("items"), "freq")
    blocked = F.array_contains("items", BLOCK_ITEM)
    both = sets.filter(blocked & (F.size("items") > 1)).select(F.array_remove("items", BLOCK_ITEM).alias("items"), F.col("freq").alias("hits"))
    rules = both.join(sets.filter(~blocked), "items").withColumn("confidence", F.col("hits") / F.col("freq"))
    rules = scratch(rules.filter(F.col("confidence") >= min_confidence), "url-rules")
    # A rule is implied by a rule over one item less; what a still shorter one implies goes through it.
    drops = rules.select(F.col("items").alias("whole"), F.explode("items").alias("t")).select("whole", F.array_remove("whole", F.col("t")).alias("items"))
    implied = drops.join(rules.select("items"), "items", "left_semi").select(F.col("whole").alias("items")).distinct()
    kept = rules.join(implied, "items", "left_anti")
    members = others.select("item", "members", F.col("n").alias("af")).distinct()
    spelled = kept.select("items", "hits", "confidence", F.explode("items").alias("item")).join(members, "item")
    whole = spelled.groupBy("items").agg(F.collect_list("members").alias("lists"), F.min(F.struct("af", "item", "members")).alias("a"), F.first("hits").alias("support"), F.first("confidence").alias("confidence"))
    return whole.select(F.array_sort("lists").alias("items"), "support", "confidence", F.col("a.members").alias("anchor")).unionByName(alone)


def _matcher(shared: Broadcast):
    @F.pandas_udf("boolean")
    def matched(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for part in tokens:
            hits = []
            for row in part:
                own = set(row)
                hits.append(any(all(own & item for item in rule) for t in row for rule in index.get(t, ())))
            yield pd.Series(hits, dtype=bool)

    return matched


def match(rows: DataFrame, rules: DataFrame, tokens_col: str, out: str = "matched", max_rules: int = MAX_RULES) -> DataFrame:
    """``rows`` with a boolean ``out``: whether the row's tokens hold a token of every item of any rule."""
    rules = scratch(rules.select("items", "anchor"), "url-index")
    if rules.count() > max_rules:
        return _match_by_join(rows, rules, tokens_col, out)
    index: dict[str, list[list[frozenset[str]]]] = {}
    for r in rules.collect():  # at most ``max_rules``
        for token in r.anchor:
            index.setdefault(token, []).append([frozenset(item) for item in r["items"]])
    shared = rows.sparkSession.sparkContext.broadcast(index)
    return rows.withColumn(out, _matcher(shared)(F.col(tokens_col)))


def _match_by_join(rows: DataFrame, rules: DataFrame, tokens_col: str, out: str) -> DataFrame:
    """``match`` for any number of rules: rows meet the rules that are anchored at one of their tokens."""
    columns = [f"c{i}" for i in range(len(rows.columns))]
    keyed = scratch(rows.toDF(*columns).withColumn("__row", F.monotonically_increasing_id()), "url-rows")
    tokens = columns[rows.columns.index(tokens_col)]
    asked = keyed.select("__row", F.col(tokens).alias("__tokens"), F.explode(tokens).alias("__token"))
    index = rules.select("items", F.explode("anchor").alias("__token"))
    fits = F.forall("items", lambda item: F.arrays_overlap(item, "__tokens"))
    hits = asked.join(index, "__token").filter(fits).select("__row").distinct().withColumn("__hit", F.lit(True))
    both = keyed.join(hits, "__row", "left").select(*columns, F.coalesce("__hit", F.lit(False)).alias(out))
    return both.toDF(*rows.columns, out)


def judge(pages: DataFrame, mined: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per input row: id, ``host``, ``path``, ``rule`` (explicit rule or null), ``verdict``.

    The longest explicit rule that fits decides; where none fits, a URL that a mined rule matches is blocked and others
    are allowed. Null URLs have empty host and path and are allowed. Repeated rows are all judged; extra columns are ignored.
    """
    host, path = host_and_path("__url")
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"))
    rows = rows.select("__id", host.alias("host"), path.alias("path"), url_tokens("__url").alias("__tokens"))
    rows = match(rows, mined, "__tokens", "__matched")
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("__matched"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(F.col("__id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
