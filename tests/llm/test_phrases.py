import random
import re
from collections import Counter

import numpy as np

from colophon.llm import phrases
from tests.llm.cases import docs, empty, rows


def brute_force(table, least=10, covered=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in table:
        lang, low = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for lang in n:
        found = []
        for (of, *words), a in candidates.items():
            if of != lang or any(len(o) == len(words) + 2 and o[0] == lang and (list(o[1:-1]) == words or list(o[2:]) == words) and 100 * b >= covered * a for o, b in candidates.items()):
                continue
            cuts = [(10**6 * a * a // (l * r), k, l, r) for k in range(1, len(words)) for l, r in [(f[lang, *words[:k]], f[lang, *words[k:]])]]
            s, _, l, r = min(cuts)
            found.append((-s, -a, " ".join(words).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def of(spark, table):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (lang, t) in enumerate(table)], "doc_id bigint, text string, lang string, phrase string, w1 int")


def got(frame):
    return sorted(map(tuple, frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def made(n=500):
    rng = random.Random(11)
    words = ["the", "The", "of", "New", "york", "city", "a\x01", "a", "é", "日本", "x\x00", "_", "b\xa0c"]
    joints = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randint(0, 60))) + rng.choice(["", "new york city", "City of the"])) for _ in range(n)]


def test_equal_to_counting_all(spark, monkeypatch):
    table = made()
    want = brute_force(table)
    assert len(want) > 80 and {len(x[2].split(" ")) for x in want} == {2, 3}
    assert got(phrases.collocations(of(spark, table))) == want
    # shards of few words, texts split in parts, no broadcast, and a map of pairs that is nearly full
    monkeypatch.setattr(phrases, "SMALL", 0)
    assert got(phrases.collocations(of(spark, table), words=50, bits=64, nodes=40)) == want
    assert got(phrases.collocations(of(spark, table), words=700, bits=6400, nodes=3)) == want


def test_words_do_not_depend_on_parts(monkeypatch):
    text = "One two.  THREE\tfour\n\x0bfive " * 50
    whole = [w for part in phrases.words_of(text) for w in part]
    assert whole[:7] == [b"one", b"two", b"\xff", b"three", b"four", b"\xff", b"\xff"]
    for step in (1, 2, 3, 7):
        monkeypatch.setattr(phrases, "STEP", step)
        assert [w for part in phrases.words_of(text) for w in part] == whole


def test_limits(spark):
    table = made(60)
    assert got(phrases.collocations(of(spark, table), least=5, covered=80, top=7)) == brute_force(table, 5, 80, 7)


def test_cases(spark):
    table = [(r[2], r[1]) for r in rows()]
    assert got(phrases.collocations(docs(spark))) == brute_force(table)
    assert phrases.collocations(empty(spark)).count() == 0
    assert got(phrases.collocations(of(spark, [(None, None), ("en", ""), ("en", "a b")]))) == []


def test_large_counts_are_exact(spark):
    a, l, r = 3 * 10**12 + 7, 5 * 10**12 + 1, 4 * 10**12 + 3
    df = spark.createDataFrame([(a, l, r)], "a bigint, l bigint, r bigint")
    assert df.selectExpr(f"{phrases._score('a', 'l', 'r')} x").first().x == 10**6 * a * a // (l * r)


def test_walk_looks_up_no_more_than_the_first_word_of_a_range(spark):
    nodes = [("en", None, None, None)] + [("en", f"w{i}", None, None) for i in range(30)] + [("en", f"w{i}", f"w{j}", None) for i in range(30) for j in range(30)]
    df = spark.createDataFrame([(*x, k + 10) for k, x in enumerate(nodes)], phrases.NODE).filter("w1 is not null")
    walk = phrases.walked(df).collect()
    f = {(r.w1, r.w2): r.f for r in walk}
    assert all(r.l1 in (None, f[r.w1, None]) for r in walk)
    assert len({r.w1 for r in walk if r.l1 is None}) <= 8
    assert np.isin([r.l1 for r in walk if r.w2 is None], list(f.values())).all()
