import random

from orbweave.llm import urlfilter as U
from orbweave.llm.common import Cuts

URLS = [
    "http://a.example.net/en/1", "https://A.Example.NET/de/1", "http://x.example.com/de/9?q#f", "http://example.com/en/", "http://b.org/fr/", "http://b.org/fr", "http://net", "http://net/", "ftp://a.b.net?x=/en/",
    "no scheme", None, "", "://", "http://", "http:///path", "http://bad.example.org/x", "http://sub.bad.example.org", "http://notbad.example.org/", "http://example.network/", "mailto:x@y://z.net/q", "http://a.net#/x", "http://user@h.net:80/p",
]
BLOCK, ALLOW, LIST = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/"), ("bad.example.org",)


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(r), r, v) for v, rules in (("block", BLOCK), ("allow", ALLOW)) for r in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    return host, path, None, "block" if any(host == d or host.endswith("." + d) for d in LIST) else "allow"


def test_verdicts(spark):
    df = spark.createDataFrame(list(enumerate(URLS + URLS)), "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule")
    for shard_keys in (U.SHARD_KEYS, 1):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, BLOCK, ALLOW, LIST, shard_keys=shard_keys).collect()}
        assert got == {i: brute(u) for i, u in enumerate(URLS + URLS)}
    assert U.judge(df.limit(0), BLOCK, ALLOW, LIST).count() == 0
    nothing = U.judge(df, (), (), spark.createDataFrame([(None,)], "domain string")).collect()
    assert len(nothing) == 2 * len(URLS) and {r["verdict"] for r in nothing} == {"allow"}


def test_a_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS", 3)  # small filters let more through
    rng = random.Random(1)
    keys = [f"host{rng.randrange(10**9)}.example" for _ in range(6_000)]
    listed, others = set(keys[:800]), set(keys[800:]) - set(keys[:800])
    made = U.build(spark.createDataFrame([(k,) for k in listed], "key string"), spark.createDataFrame([(k,) for k in others], "key string"), Cuts(spark))
    assert len(made.levels) > 2
    assert all(k.encode() in made for k in listed) and not any(k.encode() in made for k in others)
    assert sum(len(bits) for bits, _ in made.levels) < 4_000
    empty = spark.createDataFrame([], "key string")
    assert b"x" not in U.build(empty, empty, Cuts(spark))


def test_a_level_grows_with_the_logarithm_of_the_universe(spark):
    few = spark.createDataFrame([(f"bad{i}",) for i in range(10)], "key string")
    many = spark.range(40_000).selectExpr("concat('good', id) AS key")
    made = U.build(few, many, Cuts(spark))
    assert sum(len(bits) for bits, _ in made.levels) < 300
    assert all(f"bad{i}".encode() in made for i in range(10)) and not any(f"good{i}".encode() in made for i in range(40_000))


def test_null_ids_and_very_long_urls(spark):
    urls = ["http://" + "a." * 3_000 + "net/" + "p" * 50_000, "http://" + "h" * 100_000, "x" * 100_000 + "://b.org/fr/"] + URLS
    df = spark.createDataFrame([(None if i < 2 else 7, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, BLOCK, ALLOW, LIST).collect()), key=str)
    assert got == sorted(((None if i < 2 else 7, *brute(u)) for i, u in enumerate(urls)), key=str)


def test_pieces():
    assert U.domains("a.b.c") == ["a.b.c", "b.c", "c"] and U.domains("") == [] and U.domains("a.") == ["a."]
    assert U.split_url("HTTP://A.b/P?q") == ("a.b", "/P")
    assert U.rule_keys("a.net", "/en/1", (1, 4)) == ["a.net/en/", "net/en/", "a.net/", "net/"]
