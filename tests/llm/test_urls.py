"""URL rules against plain matching, with lists of several sizes."""

import random

import pytest
from pyspark.sql import functions as F

from evlake.llm import urls


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = min(fits, key=lambda r: (-len(r[0]), r[0]), default=(None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "nothing", "http://", "://", "a://b://c", "http://com", "http://com/", "http://COM/x", "http://xcom/",
    "https://www.Example.com/en/1?q#r", "https://example.com/en", "https://m.example.com/en/", "http://example.net/es/",
    "http://a.b.c.d.net/fr/x", "http://net/fr/", "http://net#/fr/", "http://net?/es/", "http://net//es/", "ftp://.com/",
    "http://example.com./en/", "http://exämple.com/en/é", "http://example.com:80/en/", "x\n://www.example.com/en/\n",
    "http://ÀB.com/", "http://www.example.com/en/" + "x" * 5000,
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


@pytest.mark.parametrize("rules", [RULES, RULES[:1], []])
def test_rules(spark, rules):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] * 2, "page_id int, url string, Host string")
    got = urls.judged(pages, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert tuple(r[2:]) == plain(URLS[r.page_id], rules), URLS[r.page_id]
    assert urls.judged(pages.limit(0), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(1)
    keys = [f"k{i}" for i in range(3000)]
    listed = set(rng.sample(keys, 250))
    universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    levels = urls.cascade(universe)
    assert len(levels) > 1 and sum(x.bits for x in levels) < 250 * 20
    got = universe.select("listed", urls.member(F.col("key"), levels).alias("m")).collect()
    assert all(r.listed == r.m for r in got)


def test_many_rules(spark):
    rng = random.Random(2)
    hosts = [f"{a}.{b}.org" for a in "abcdefgh" for b in "uvwxyz"]
    rules = [(h, rng.choice(["/", "/a/", "/bb"]), rng.choice(["allow", "block"])) for h in rng.sample(hosts, 30)]
    data = [f"http://{rng.choice(['', 'www.'])}{rng.choice(hosts)}/{rng.choice(['', 'a/', 'a', 'bb', 'b/c'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(data)], "page_id int, url string")
    for r in urls.judged(pages, rules).collect():
        assert tuple(r[2:]) == plain(r.url, rules)
