"""URL parts and the rule list against plain code; mined rules against counting."""

import re
from itertools import combinations

from pyspark.sql import functions as F

from locusframe.llm.urls import judge, match, mine

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]
URLS = [
    "http://Example.COM/en/1", "https://www.example.com/en/", "http://a.b.example.com/en/x?y=/z", "http://example.com", "http://com/", "http://xcom/",
    "http://a.net/es/", "http://a.net/es", "http://a.net/ES/", "ftp://user@h.com:80/p#q", "no scheme", "", None, "://", "a://b://c/d", "http://é.com/\n/x",
    "http://a.com?en=/en/", "http://a.com#/en/", "http://a.org/p/1", "http://a.org/p/1", "HTTP://b.org/fr/12.html",
]


def test_rule_list(spark):
    frame = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(URLS)] + [(None, "http://a.com/", "x", 1)], "page_id int, url string, host string, rule int")
    got = {r["id"]: r for r in judge(frame, RULES).collect()}
    assert len(got) == len(URLS) + 1
    for k, u in enumerate(URLS):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule), u
        assert got[k]["verdict"] == verdict if rule else got[k]["verdict"] in ("allow", "block")
    assert judge(frame.limit(0), RULES).count() == 0


def test_mined_rules(spark):
    rows = [(["a", "b"], "block")] * 8 + [(["a", "c"], "allow")] * 9 + [(["b", "c"], "allow")] * 8 + [(["a", "b", "d"], "block")] * 3 + [(["d"], None)] * 5 + [(["c"], "block")]
    frame = spark.createDataFrame(rows, "tokens array<string>, label string")
    got = {(tuple(r["items"]), r["label"]): (round(r["confidence"], 9), round(r["support"], 9)) for r in mine(frame, 0.1, 0.8).collect()}
    known = [(set(t), x) for t, x in rows if x]
    exp = {}
    for n in (1, 2, 3):
        for items in combinations("abcd", n):
            for label in ("allow", "block"):
                every, both = sum(set(items) <= t for t, _ in known), sum(set(items) <= t and x == label for t, x in known)
                if both >= 0.1 * len(known) and both >= 0.8 * every:
                    exp[items, label] = (round(both / every, 9), round(both / len(known), 9))
    exp = {k: v for k, v in exp.items() if not any(set(i) < set(k[0]) and x == k[1] and c[0] >= v[0] for (i, x), c in exp.items())}
    assert got == exp
    urls = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, ["c", "a", "q"]), (4, [])], "key long, tokens array<string>")
    found = {r["key"]: r["label"] for r in match(urls, mine(frame, 0.1, 0.8)).collect()}
    assert found == {1: "block", 3: "allow"}
    assert mine(frame.limit(0)).agg(F.count("*")).first()[0] == 0


def test_tokens_of_the_same_rows(spark):
    """Any token of a class makes the rule fit, and names it."""
    labels = [("http://a.example.net/x", "block")] * 6 + [("http://a.example.org/x", "allow")] * 6
    labels = spark.createDataFrame(labels, "url string, label string")
    pages = ["https://other.net/en/1", "https://www.example.net/", "https://other.org/", "https://example.com/"]
    got = {r["id"]: r for r in judge(spark.createDataFrame(list(enumerate(pages)), "page_id int, url string"), [], labels).collect()}
    assert [(got[k]["verdict"], got[k]["mined_rule"]) for k in range(4)] == [
        ("block", "host:net => block"), ("block", "host:example.net => block"), ("allow", "host:org => allow"), ("allow", None)
    ]
    rules = mine(spark.createDataFrame([(["a", "b", "c"], "block")] * 3 + [(["c"], "allow")] * 3 + [(["a", "b"], "allow")] * 3, "tokens array<string>, label string"), 0.1, 0.9)
    urls = spark.createDataFrame([(1, ["b", "c"]), (2, ["a", "b"]), (3, ["c", "a", "b"])], "key long, tokens array<string>")
    assert {r["key"]: r["rule"] for r in match(urls, rules).collect()} == {1: "b & c => block", 3: "a & c => block"}


def test_long_rules(spark):
    """A rule of four tokens, whose smaller subsets are not sure enough, and none of its supersets."""
    rows = [("abcd", "block"), ("abcde", "block")] * 9 + [(t, "allow") for t in ("abc", "abd", "acd", "bcd") for _ in range(4)]
    frame = spark.createDataFrame([(list(t), x) for t, x in rows], "tokens array<string>, label string")
    got = mine(frame, 0.1, 0.9)
    assert {"".join(r["items"]): r["confidence"] for r in got.filter("label = 'block'").collect()} == {"abcd": 1.0, "e": 1.0}
    urls = spark.createDataFrame([(1, list("abcdx")), (2, list("abd"))], "key long, tokens array<string>")
    assert {r["key"]: r["label"] for r in match(urls, got.filter("label = 'block'")).collect()} == {1: "block"}
