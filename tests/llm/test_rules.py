import re
from collections import Counter

from colophon.llm import rules
from tests.llm.cases import docs, empty, labels, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_columns_equal_brute_force(spark):
    more = ["a b c a b c", "a a a a a", "x y z\nx y z\n\nx y z", "a b c d a b c e a b c", "#*$ %&| <>", "ü v w", "a  b\tc\r\nd"]
    table = [(r[0], r[1], r[3]) for r in rows()] + [(100 + i, t, "s") for i, t in enumerate(more)]
    got = rules.base_columns(docs(spark, table)).collect()
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == Counter((i, *base(t)) for i, t, _ in table)


def test_ratios_and_verdicts(spark):
    good = " ".join(f"the word g{w} of{w % 9} line{w}" for w in range(30))
    bad = " ".join(f"w{w}&&& | z{w}%%%" for w in range(60))
    table = [(i, good.replace("word", f"term{i % 7}"), "s") for i in range(40)] + [(100 + i, bad + f" q{i}", "s") for i in range(10)]
    got = {r.doc_id: r for r in rules.apply_rules(docs(spark, table), labels(spark, [(i, 1, 0) for i in range(30)] + [(None, 1, 0)])).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[100 + i].kept for i in range(10))


def test_score_by_hand(spark):
    ratios = [((i * 7919) % 100 - 50) / 100 for i in range(rules.BUCKETS)]
    got = {r.doc_id: r.llr for r in rules.score(docs(spark, [(1, "ab cd ab", "s"), (2, "", "s"), (3, None, "s")]), ratios).collect()}
    spark_hash = lambda *x: spark.sql(f"select xxhash64({', '.join(x)})").first()[0]
    a, b = spark_hash("'ab'"), spark_hash("'cd'")
    grams = [a, b, a, spark_hash(f"{a}L", f"{b}L"), spark_hash(f"{b}L", f"{a}L")]
    assert abs(got[1] - sum(ratios[g % rules.BUCKETS] for g in grams) / 5) < 1e-9 and got[2] == got[3] == 0


def test_edge_cases(spark):
    out = rules.apply_rules(docs(spark), labels(spark, [])).collect()
    assert len(out) == 12 and all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in out)
    assert rules.apply_rules(empty(spark), labels(spark, [(1, 1, 0)])).count() == 0


def test_log_ratios_equal_brute_force(spark):
    import math
    import struct
    from collections import Counter

    import regex
    import xxhash

    texts = ["one two, two!", "ünï_1 -- x x x", None, "", "three two one; one", "[a] {b}\n\tc c"]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    trusted = spark.createDataFrame([(0,), (4,), (None,), (99,)], "doc_id bigint")

    def buckets(text):
        hashes = [xxhash.xxh64_intdigest(t.encode(), 42) for t in regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+", text or "")]
        low = [h % rules.BUCKETS for h in hashes]
        pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42)) for a, b in zip(hashes, hashes[1:], strict=False)]
        return low + [h % rules.BUCKETS for h in pairs]

    raw, target = Counter(b for t in texts for b in buckets(t)), Counter(b for i in (0, 4) for b in buckets(texts[i]))
    n_raw, n_target = sum(raw.values()) + rules.BUCKETS, sum(target.values())
    got = rules.log_ratios(df, trusted)
    for b in range(rules.BUCKETS):
        r, t = raw[b] + 1, target[b]
        expected = math.log((t + 10 * r / n_raw) * n_raw / ((n_target + 10) * r)) if t else math.log(10 / (n_target + 10)) if raw[b] else 0.0
        assert abs(got[b] - expected) < 1e-9
    scored = {r.doc_id: r.llr for r in rules.score(df.select("doc_id", "text"), got).collect()}
    for i, t in enumerate(texts):
        values = [got[b] for b in buckets(t)]
        assert abs(scored[i] - (sum(values) / len(values) if values else 0.0)) < 1e-5
