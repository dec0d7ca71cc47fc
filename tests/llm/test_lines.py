import random
import re

from colophon.llm import lines
from tests.llm.cases import docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(texts):
    """(text, removed) of texts in order of doc_id, each line held against all earlier lines."""
    seen, out = [], []
    for text in texts:
        kept = []
        for line in text.split("\n"):
            words = frozenset(WORD.findall(line))
            hit = words and any(9 * len(words & s) >= 4 * (len(words) + len(s)) for s in seen)
            if words:
                seen.append(words)
            if not hit:
                kept.append(line)
        out.append("\n".join(kept))
    return out


def made_texts(n=60):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 40))] for _ in range(40)]
    texts = []
    for _ in range(n):
        out = []
        for _ in range(rng.randint(1, 8)):
            line = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            out.append(" ".join(line))
        texts.append("\n".join(out) + rng.choice(["", "\n", "\n \n"]))
    return texts


def test_equals_brute_force(spark):
    texts = made_texts()
    got = {r.doc_id: r.text for r in lines.line_report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_long_postings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 3)
    texts = made_texts(40)
    got = {r.doc_id: r.text for r in lines.line_report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(lines, "SMALL", 0)
    texts = made_texts(20)
    got = {r.doc_id: r.text for r in lines.line_report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_edge_cases(spark):
    out = lines.dedup_lines(docs(spark))
    assert out.columns == docs(spark).columns and out.count() == docs(spark).count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[2] is None and text[3] == "" and text[4] == "   \n\t " and text[6] == "" and text[None] == ""
    assert [r.text for r in out.filter("doc_id = 1").collect()] == ["one two three four five six seven eight nine ten"] * 2
    assert text[7] == ""  # nine words of eleven are shared
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_clashing_columns(spark):
    extra = "doc bigint, text_hash string, pos string, gone string, row string, _gone string, `a.b` string"
    rows = [(1, "one two three four five", 5, *"uvwxyz"), (2, "one two three four five\nsix", 6, *"uvwxyz")]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, {extra}")
    out = lines.dedup_lines(df)
    assert out.columns == df.columns and {r.doc_id: r.text for r in out.collect()} == {1: rows[0][1], 2: "six"}
    assert {tuple(r)[2:] for r in out.collect()} == {(5, *"uvwxyz"), (6, *"uvwxyz")}


def test_near_copies_in_long_postings(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(lines, "HOT", 4)
    monkeypatch.setattr(lines, "PIVOTS", 2)
    base = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(60):
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.randrange(30)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(line))
    texts += [" ".join(f"{a}{i}" for i in range(150)) for a in "pq"] + [" ".join([*(f"p{i}" for i in range(140)), "r"])]
    got = {r.doc_id: r.text for r in lines.line_report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_blanks_of_all_kinds(spark):
    texts = ["a  b\tc d\x0be", " e d c b a ", "\ra b\x0cc d e\r\n f", "x\n\n \ny", "x ", " y\nz"]
    got = {r.doc_id: r.text for r in lines.line_report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_texts_that_share_an_id_are_told_apart(spark):
    a = [f"a{i}" for i in range(10)]
    b, c = " ".join(f"b{i}" for i in range(10)), " ".join(f"c{i}" for i in range(10))
    near = " ".join([*a[:9], "other"])
    table = [(1, " ".join(a), "s"), (None, near, "s"), (None, b, "s"), (7, c, "s"), (7, near, "s"), (None, b + "\nx y", "s"), (None, b + "\nu v", "s")]
    got = sorted((str(r.doc_id), r.text) for r in lines.dedup_lines(docs(spark, table)).collect())
    whole = [r for r in got if b in r[1]]
    assert len(got) == 7 and len(whole) == 1
    assert ("7", c) in got and ("7", "") in got and ("None", "") in got
    assert sum("x y" in r[1] for r in got) == sum("u v" in r[1] for r in got) == 1
