import math
import random
import re
from collections import Counter, defaultdict

from colophon.llm import search
from tests.llm.cases import docs, empty, rows

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(table, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in table]
    n_docs, all_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, bag in bags:
            m = 10 + 90 * bag.total() * n_docs // max(1, all_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in wanted if bag[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def items_of(spark, of):
    return spark.createDataFrame(of, "item_id bigint, text string, score string")


def got(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_equal_to_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Éa", "x-y", "the", "THE", "日本", "a_b"]
    table = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8))), "z") for i in range(25)]
    for small in (search.SMALL, 0):
        monkeypatch.setattr(search, "SMALL", small)
        monkeypatch.setattr(search, "SHARD", 50)
        found = search.search(docs(spark, [(i, t, "s") for i, t in table]), items_of(spark, items))
        assert got(found) == brute_force(table, [x[:2] for x in items])


def test_cases(spark):
    table = [(r[0], r[1]) for r in rows()]
    items = [(1, "one two", "a"), (1, "Three!", "a"), (1, "one two", "a"), (2, None, None), (3, "", "b"), (4, "?!", "c"), (5, "absent", "d"), (None, "word7 ünï a", "e")]
    assert got(search.search(docs(spark), items_of(spark, items))) == brute_force(table, [x[:2] for x in items])
    assert search.search(empty(spark), items_of(spark, items)).count() == 0
    assert search.search(docs(spark), items_of(spark, [])).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    table = [(i, "same words here" if i % 2 else "others in this one", "s") for i in range(60, 0, -1)]
    found = search.search(docs(spark, table), items_of(spark, [(1, "words", "")]), k=5).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [1, 3, 5, 7, 9] and [r["rank"] for r in found] == [1, 2, 3, 4, 5]


def test_terms_do_not_depend_on_parts(monkeypatch):
    text = "One, two;THREE four-five\n" * 200
    whole = search.term_counts(text)
    assert {t.decode(): n for t, n in whole.items()} == Counter(terms(text))
    monkeypatch.setattr(search, "STEP", 7)
    assert search.term_counts(text) == whole
