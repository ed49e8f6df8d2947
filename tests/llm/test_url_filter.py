import random

from faultline.llm import url_filter as U


def judge(url, rules=U.RULES):
    """Straight from the contract, one URL at a time."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_urls_against_brute_force(spark):
    random.seed(5)
    hosts = ["example.org", "A.Example.ORG", "notexample.org", "org", "x.com", "COM", "é.com", ".org", "a..org", "example.org:80", "u@example.org", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/", "/DE/", "/en/1?x", "?q=/es/", "#/es/", "/a?b#c", "/\n/x"]
    urls = [f"{s}{h}{p}" for s in ("http://", "https://", "x", "") for h in hosts for p in paths] + [None, "", "://", "http://a://b/c"]
    random.shuffle(urls)
    rows = [(i % 50 if i % 7 else None, u) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "url AS host", "url AS path", "url AS rule", "url AS _expression")
    got = U.judge_urls(pages, U.rule_table(spark)).collect()
    want = [(i, *judge(u)) for i, u in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rule_ties_nulls_and_many_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x/y"), (1, "http://a.b/x/y")], "page_id long, url string")
    rules = spark.createDataFrame(
        [("b", "/x/y", "allow"), ("a.b", "/x", "block"), ("a.b", "/x", "allow"), (None, "/", "block"), ("a.b", None, "block"), ("", "/", "block")]
        + [(f"h{i}.c", f"/{i}", "block") for i in range(500)],
        "host string, path string, verdict string",
    )
    # both of length 5: the longer host wins, and of one rule with two verdicts, block
    assert [tuple(r)[3:] for r in U.judge_urls(pages, rules).collect()] == [("a.b/x", "block")] * 2
    none = U.judge_urls(pages, rules.limit(0)).collect()
    assert [tuple(r)[3:] for r in none] == [(None, "allow")] * 2
    assert U.judge_urls(pages.limit(0), rules).count() == 0
