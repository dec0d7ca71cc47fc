import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from colophon.llm import urls
from colophon.llm.queries import URL_RULES

PAGES = "page_id bigint, url string, html string, rule string, tokens string"


def pages(spark, of):
    return spark.createDataFrame([(i, u, None, "x", "y") for i, u in of], PAGES)


def marks(spark, of):
    return spark.createDataFrame(of, "page_id bigint, blocked boolean")


def parsed(spark, url):
    u = F.col("url")
    r = pages(spark, [(1, url)]).select(urls.host_of(u).alias("h"), urls.path_of(u).alias("p")).first()
    return r.h, r.p


@pytest.mark.parametrize(("url", "host", "path"), [("HTTP://Www.Éx.COM/A/b?c#d", "www.Éx.com", "/A/b"), ("x://h", "h", ""), ("x://h?q=/a", "h", ""), ("x://h#f/a", "h", ""), ("://h/p", "h", "/p"), ("a://b://c/d", "b:", "//c/d"), ("no scheme/at", "", ""), ("", "", ""), (None, "", ""), ("x://", "", ""), ("x://h/a\nb", "h", "/a\nb")])
def test_host_and_path(spark, url, host, path):
    assert parsed(spark, url) == (host, path)


def test_longest_given_rule(spark):
    of = [("http://a.example.net/en/1", "example.net/en/", "allow"), ("http://example.net/de/1", "net/", "block"), ("http://net/", "net/", "block"), ("http://a.net", None, "allow"), ("http://anet/x", None, "allow"), ("http://x.example.com/de/", "example.com/de/", "block"), ("http://notexample.com/de/", None, "allow"), ("http://a.org/fr/2", "org/fr/", "allow"), ("http://a.org/FR/2", None, "allow"), (None, None, "allow")]
    got = urls.judge(pages(spark, list(enumerate(u for u, _, _ in of))), marks(spark, []), URL_RULES).collect()
    assert [(r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)] == [x[1:] for x in of]


def brute_rules(transactions, least, confidence):
    held, blocked = Counter(), Counter()
    for tokens, bad in transactions:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                held[c] += 1
                blocked[c] += bad
    rules = {c: (blocked[c] / held[c], blocked[c]) for c in held if blocked[c] >= least and blocked[c] / held[c] >= confidence}
    return {c: x for c, x in rules.items() if not any(set(o) < set(c) for o in rules)}


def made(n=600):
    rng = random.Random(3)
    out = []
    for i in range(n):
        sub, top, lang = rng.choice(["", "www.", "m.", "blog."]), rng.choice(["com", "org"]), rng.choice(["en", "de", "fr"])
        host = f"{sub}{rng.choice('abcdefgh')}.{top}"
        end = rng.choice(["", ".html", "?page=2&ref=x", "?ref=x&page=3", "#top"])
        bad = (lang == "de" and top == "com" or end == "#top" and sub == "m.") != (rng.random() < 0.05)
        out.append((i, f"http://{host}/{lang}/{i}{end}", bad))
    return out


def test_mined_rules_equal_all_combinations(spark):
    data = made()
    labelled = [x for x in data if x[0] % 3]
    df = pages(spark, [x[:2] for x in data])
    u = F.col("url")
    tokens = {r.page_id: sorted(r.t) for r in df.select("page_id", urls.tokens_of(u, urls.host_of(u), urls.path_of(u)).alias("t")).collect()}
    assert all(len(t) <= urls.KINDS and len(set(t)) == len(t) for t in tokens.values())
    least = max(5, math.ceil(0.01 * len(labelled)))
    want = brute_rules([(tokens[i], bad) for i, _, bad in labelled], least, 0.7)
    tx = spark.createDataFrame([(tokens[i], bad) for i, _, bad in labelled], "tokens array<string>, blocked boolean")
    got = {tuple(sorted(r.tokens)): (r.confidence, r.pages) for r in urls.mined(tx, 0.01, 5, 0.7).collect()}
    assert got.keys() == want.keys() and all(abs(got[c][0] - want[c][0]) < 1e-9 and got[c][1] == want[c][1] for c in got)
    assert ("dir=de", "top=com") in want
    judged = urls.judge(df, marks(spark, [(i, b) for i, _, b in labelled]), [("h.org/", "allow")], 0.01, 5, 0.7).collect()
    assert len(judged) == len(data)
    for r in judged:
        fits = [c for c in want if set(c) <= set(tokens[r.page_id])]
        if r.host.endswith("h.org") and r.path:
            assert (r.rule, r.verdict, r.pattern) == ("h.org/", "allow", None)
        else:
            best = max(((*want[c], " ".join(c)) for c in fits), default=(0, 0, None))[2]
            assert r.rule is None and (r.verdict, r.pattern) == ("block" if fits else "allow", best)


def test_broadcast_or_not_is_the_same(spark, monkeypatch):
    data = made(300)
    run = lambda: sorted(map(str, urls.judge(pages(spark, [x[:2] for x in data]), marks(spark, [(i, b) for i, _, b in data]), URL_RULES, 0.01, 5, 0.7).collect()))
    first = run()
    monkeypatch.setattr(urls, "SMALL", 0)
    assert run() == first and any("block" in x for x in first)


def test_cases(spark):
    of = [(1, None), (1, None), (None, "http://a.b/c"), (2, ""), (3, "http://x.y/" + "long/" * 200_000 + "?" + "&".join(f"k{i}=v" for i in range(1000)))]
    got = urls.judge(pages(spark, of), marks(spark, [(1, True), (1, None), (None, True), (3, False)]), URL_RULES).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "a.b", "allow"), (1, "", "allow"), (1, "", "allow"), (2, "", "allow"), (3, "x.y", "allow")]
    assert urls.judge(pages(spark, []), marks(spark, []), URL_RULES).count() == 0
