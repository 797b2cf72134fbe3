"""Hosts, rules, model probabilities against their definition, and held-out accuracy."""

import math
import re

from fleetscope.llm import url_model as U
from fleetscope.llm.queries import URL_RULES, table

FOLDER = "/root/testdata/sf0.01"
URLS = ["http://A.Example.NET/en/1?x#y", "https://example.net/en", "http://net", "ftp://x.org/fr/?q", "no scheme/net/", "://net/", "", None, "http://example.com/de/",
        "http://xexample.com/de/", "http://u:1@a.net:80/", "http://é.ORG/fr/ü", "http://a.net?b=http://c.org/fr/", "http://a.net/#b", "a://b://c/d", "http://" + "x" * 5000 + ".net/" + "y" * 20_000]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), v, h + p) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string, host string, score long")
    got = {r["page_id"]: r for r in U.judge(df, URL_RULES, None).collect()}
    assert len(got) == len(URLS) + 2
    for i, u in enumerate(URLS + URLS[:2]):
        host, path = plain(u)
        verdict, name = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, name, verdict or "allow"), u


def test_model_is_a_distribution():
    counts = {"a": 5, "b": 3, "aa": 2, "ab": 3, "ba": 3, "aab": 2}
    m = U.Model(counts)

    def p(context, c):
        g, back = context + c, 0.0
        for a in range(len(g)):
            if g[a:] in m.log:
                return math.exp(back + m.log[g[a:]])
            back += m.back.get(g[a:-1], 0.0)
        return math.exp(back) / U.SYMBOLS

    for context in ("", "a", "b", "aa", "zz"):
        assert abs(sum(p(context, chr(i)) for i in range(U.SYMBOLS)) - 1) < 1e-9
    assert abs(p("", "a") - (5 + 2 / 256) / 10) < 1e-12 and p("a", "b") > p("", "b")


def test_training_separates_held_out_urls(spark):
    pages = table(spark, FOLDER, "pages")
    f = U.train(pages, sample=100)
    rows = U.judge(pages.select("page_id", "url"), [], f).collect()
    bad = {r["page_id"]: any(t in re.split("[^a-z0-9]+", r["host"]) for t in U.TERMS) for r in rows}
    right = sum((r["verdict"] == "block") == bad[r["page_id"]] for r in rows)
    assert right >= 0.97 * len(rows) and f.threshold <= 0
    same = {r["page_id"]: f.score(r["host"] + r["path"]) for r in rows}
    assert all(abs(same[r["page_id"]] - r["score"]) < 1e-9 for r in rows)


def test_null_url_is_allowed_and_no_examples_allow_all(spark):
    few = spark.createDataFrame([(1, "http://good.org/a"), (2, None)], "page_id long, url string")
    assert U.train(few) is None and U.train(few.limit(0)) is None
    f = U.train(table(spark, FOLDER, "pages"), sample=50)
    assert [r["verdict"] for r in U.judge(few.where("url is null"), URL_RULES, f).collect()] == ["allow"]
    assert U.judge(few.limit(0), URL_RULES, f).count() == 0
