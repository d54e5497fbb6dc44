import random

from pyspark.sql import functions as F

from linkscore.llm import url_filters as U


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = max(
        (
            (len(h + p), len(h), h + p, v)
            for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ),
        default=None,
    )
    return host, path, best and best[2], best[3] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn(
        "rule", F.lit("clash")
    )
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = U.judge_urls(pages, table).select("page_id", *U.ADDED).collect()
    assert len(out) == len(urls)
    return {r[0]: tuple(r[1:]) for r in out}


def test_against_brute_force(spark):
    random.seed(1)
    urls = [None, "", "no scheme", "http://", "x://y://z/en/", "http://A.COM?q=/en/", "http://com#/x"]
    urls += ["http://ÄB.com/é\n/x"] * 3
    for _ in range(300):
        host = ".".join(random.choice(["a", "b", "com", "www", ""]) for _ in range(random.randint(1, 5)))
        path = "".join(random.choice(["/a", "/b", "/", "?", "#", "a"]) for _ in range(random.randint(0, 5)))
        urls.append(f"http://{host}{path}")
    rules = [("com", "/", "allow"), ("b.com", "/a", "block"), ("a", "", "block"), ("a", "/a/b", "allow"),
             ("www.b.com", "/a", "allow"), (None, "/", "block"), ("com", "/b", "block")]
    expected = {i: brute(u, [r for r in rules if None not in r]) for i, u in enumerate(urls)}
    assert judged(spark, urls, rules) == expected


def test_large_rule_tables_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BROADCAST_RULES", 0)
    urls = ["http://a.com/x"] * 20 + ["http://b.net/y"]
    expected = {i: brute(u, U.RULES) for i, u in enumerate(urls)}
    assert judged(spark, urls, list(U.RULES)) == expected


def test_hosts_of_many_labels(spark):
    """Only as many labels as rules have are looked at."""
    urls = [f"http://{'a.' * 20_000}b.com/a{'/x' * 20_000}", f"http://{'.' * 5_000}/", "http://com/"] * 3
    rules = [("b.com", "/a", "block"), ("", "/", "block"), ("com", "/", "allow")]
    expected = {i: brute(u, rules) for i, u in enumerate(urls)}
    assert judged(spark, urls, rules) == expected
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    keys = U.with_host_and_path(pages).select("host", "path").distinct()
    assert U.expressions(keys, [1, 2], [1, 2]).agg(F.sum(F.length("_host") + F.length("_path"))).first()[0] < 100


def test_empty_tables(spark):
    assert judged(spark, [], list(U.RULES)) == {}
    assert judged(spark, ["http://a.com/"], []) == {0: ("a.com", "/", None, "allow")}
