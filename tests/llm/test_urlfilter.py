"""URL rules, mined rules and verdicts against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm.urlfilter import RULES, RULES_SCHEMA, judge, match, mine, url_tokens

SCHEMA = "page_id long, url string, html string, host string, verdict int"


def spelled(rules):
    """Rules over single tokens: one token of each item."""
    return {frozenset(tokens): (r.support, round(r.confidence, 9)) for r in rules for tokens in itertools.product(*r["items"])}


@pytest.fixture(scope="module")
def pages(spark):
    return lambda urls: spark.createDataFrame([(i, u, None, "x", 1) for i, u in urls], SCHEMA)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


URLS = [
    "http://a.net/", "https://A.Example.NET/en/x?y#z", "http://example.net/en", "http://net", "http://net/", "http://planet/", "http://b.example.com/de/1",
    "http://example.com/de", "http://w.org/fr/", "http://w.org/FR/", "no scheme", "://", "a://b://c/d", "http://h?/x", "http://h#/x", None, "",
    "http://x.org:80/fr/", "HTTP://ÄB.Net/x", "http://" + "l" * 5000 + ".net/" + "p/" * 5000, "http://a.net/",
]


def test_host_path_and_explicit_rules(pages, spark):
    none = spark.createDataFrame([], RULES_SCHEMA)
    got = judge(pages(list(enumerate(URLS))), none).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = plain_parts(URLS[r.page_id])
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_mined_rules_match_brute_force(pages):
    rng = random.Random(6)
    urls = []
    for i in range(400):
        host = rng.choice(["spam", "good", "news", "shop"]) + rng.choice([".example.com", ".example.org"])
        urls.append((i, f"http://{host}/{rng.choice(['en', 'fr', 'x'])}/{i % 7}?{rng.choice(['a=1', 'b=2'])}"))
    tokens = {r.page_id: frozenset(r.t) for r in pages(urls).select("page_id", url_tokens("url").alias("t")).collect()}
    bad = {i: ("h:spam" in t and "p:x" in t) or (rng.random() < 0.05) for i, t in tokens.items()}
    df = pages(urls)
    labelled = df.withColumn("block", F.array_contains(F.array(*[F.lit(i) for i, b in bad.items() if b]), F.col("page_id").cast("int")))
    got = spelled(mine(labelled, min_count=5).collect())
    want = {}
    for n in range(1, 6):
        for items in itertools.combinations(sorted(set().union(*tokens.values())), n):
            s = frozenset(items)
            own = [i for i, t in tokens.items() if s <= t]
            hits = sum(bad[i] for i in own)
            if hits >= 5 and hits / len(own) >= 0.7:
                want[s] = (hits, round(hits / len(own), 9))
    minimal = {s: v for s, v in want.items() if not any(o < s for o in want)}
    assert got == minimal and got
    rules = mine(labelled, min_count=5)
    for max_rules in (0, 1000):
        rows = match(df.select("page_id", url_tokens("url").alias("t")), rules, "t", max_rules=max_rules).collect()
        assert {r.page_id for r in rows if r.matched} == {i for i, t in tokens.items() if any(s <= t for s in minimal)}


def test_edges(pages):
    df = pages([(1, None), (None, "http://a.b/c"), (None, "http://a.b/c")])
    assert mine(df.withColumn("block", F.lit(False))).count() == 0
    assert mine(df.limit(0).withColumn("block", F.lit(True))).count() == 0
    rules = mine(df.withColumn("block", F.lit(None).cast("boolean")))
    assert [r.verdict for r in judge(df, rules).collect()] == ["allow"] * 3
    assert judge(df.limit(0), rules).count() == 0


def test_rules_need_the_same_count_at_every_size(spark):
    """8 blocked URLs of one host make a rule among 20,000 labelled ones, and a token in nearly all URLs can be a rule."""
    few = [(f"http://bad.test/{i}", True) for i in range(8)] + [(f"http://h{i}.test/{i}", False) for i in range(20_000)]
    assert spelled(mine(spark.createDataFrame(few, "url string, block boolean")).collect()) == {frozenset(["h:bad"]): (8, 1.0)}
    most = [("http://one.site/", i % 10 > 0) for i in range(1000)]
    assert set(spelled(mine(spark.createDataFrame(most, "url string, block boolean")).collect())) == {frozenset(["h:one"]), frozenset(["h:site"])}


def test_repeated_long_urls_are_one_item(spark):
    """20 copies of a URL of 40 segments, and 9 of its half: 2 items, not 2**40 itemsets."""
    long = "http://trap.test/" + "/".join(f"s{i}" for i in range(40))
    half = "http://half.test/" + "/".join(f"s{i}" for i in range(20))
    rows = [(long, True)] * 20 + [(half, False)] * 9 + [(f"http://h{i}.test/x", False) for i in range(200)]
    rules = mine(spark.createDataFrame(rows, "url string, block boolean")).collect()
    assert [(r.support, r.confidence) for r in rules] == [(20, 1.0)]
    assert rules[0]["items"] == [sorted(["h:trap", *(f"p:s{i}" for i in range(20, 40))])] == [rules[0].anchor]
    # Copies that differ in a segment each: no two segments are in the same rows, but each is a rule alone.
    varied = [("http://h.test/" + "/".join(f"s{j}" for j in range(40) if j != i), True) for i in range(40)]
    assert set(spelled(mine(spark.createDataFrame(varied, "url string, block boolean")).collect())) == {frozenset([t]) for t in ["h:h", "h:test", *(f"p:s{i}" for i in range(40))]}


def test_mined_rules_block_through_judge(pages):
    """Verdicts of a whole table against brute force: explicit rules first, then mined combinations, else allow."""
    rng = random.Random(9)
    urls = [(i, f"http://{rng.choice('ab')}.{rng.choice(['spam', 'ham'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['fr', 'win', 'news'])}/{rng.randrange(9)}") for i in range(300)]
    bad = lambda u: ".spam." in u and "/win/" in u
    df = pages(urls)
    rules = mine(df.filter("page_id < 200").withColumn("block", F.col("url").rlike("[.]spam[.].*/win/")))
    assert {frozenset(["h:spam", "p:win"])} <= set(spelled(rules.collect()))
    seen = set()
    for r in judge(df, rules).collect():
        url = urls[r.page_id][1]
        host, path = plain_parts(url)
        want = "block" if host.endswith(".net") else "allow" if host.endswith(".org") and path.startswith("/fr/") else "block" if bad(url) else "allow"
        assert r.verdict == want, url
        seen.add((r.rule is None, r.verdict))
    assert seen == {(True, "block"), (True, "allow"), (False, "block"), (False, "allow")}
