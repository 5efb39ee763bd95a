import random

from chronoweft.llm import url_filter as U
from tests.llm.helpers import with_clashes

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "https://a.www.example.com/en/z", "http://example.com?x=/en/", "http://com/", "http://notexample.com/en/", "x://example.com/en", "http://a.net/es/1", "http://net/fr/", "http://net/de/", "http://u@b.net:80/es/", "http://ÄB.net/fr/ü", "a://b.net/es/://c.com/", "http://x.com\n/y"]


def plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:n], rest[n:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(-len(h) - len(p), -len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fit)[2], min(fit)[3]) if fit else (host, path, None, default)


def pages_of(spark, urls):
    return with_clashes(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))


def random_rules(rng, n):
    label = lambda: rng.choice(["a", "b", "com", "net", "x"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    return [(host(), rng.choice(["/", "/a/", "/a/b", ""]), rng.choice(["allow", "block"])) for _ in range(n)]


def test_production_rules(spark):
    got = U.filter_urls(pages_of(spark, URLS), U.PRODUCTION_RULES).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: plain(u, U.PRODUCTION_RULES) for i, u in enumerate(URLS)}


def test_nested_rules_swept_and_joined(spark):
    rng = random.Random(3)
    rules = random_rules(rng, 40)  # some have the same host and path, and both verdicts
    rules += [(h, p, "block" if v == "allow" else "allow") for h, p, v in rules[:9]]
    urls = ["http://" + ".".join(rng.choice(["a", "b", "com", "net", "x", "xa"]) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "/", "/a/b/c", "/a/", "/b"]) for _ in range(300)]
    want = {i: plain(u, rules) for i, u in enumerate(urls)}
    for bound in (100, 5):
        got = U.filter_urls(pages_of(spark, urls), rules, max_swept_rules=bound).collect()
        assert {r.page_id: tuple(r)[1:] for r in got} == want, bound
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert {r.page_id: tuple(r)[1:] for r in U.filter_urls(pages_of(spark, urls), table).collect()} == want


def test_empty_tables(spark):
    assert U.filter_urls(pages_of(spark, URLS).limit(0), U.PRODUCTION_RULES).count() == 0
    assert {r.verdict for r in U.filter_urls(pages_of(spark, URLS), [], "block").collect()} == {"block"}
