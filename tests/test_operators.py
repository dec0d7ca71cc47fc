"""Operators over indexes, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.functions import ids, people, text, titles
from colophon.functions.people import names_nearly_equal
from colophon.operators import near, text_share, trigrams
from colophon.plans import counters


def edits(a, b):
    """Levenshtein's distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_one_edit_pairs(spark):
    rng = random.Random(2)
    words = ["", "a", "é", "ab", "aab", "aaab", "日本", "日木", None, "x" * 300, "x" * 299 + "y"] + ["".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(200)]
    got = near.one_edit_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    known = sorted({w for w in words if w is not None})
    want = {(a, b) for a in known for b in known if a < b and edits(a, b) == 1}
    assert {tuple(r) for r in got} == want
    assert near.one_edit_pairs(spark.createDataFrame([], "word string")).count() == 0


def test_rows_of_near_words_meet_once_for_an_edit(spark):
    df = spark.createDataFrame([(1, "k", "word"), (2, "k", "ward"), (3, "j", "wird"), (4, "k", "words"), (5, None, "worn")], "id int, k string, word string")
    got = near.near_words(df, df, ["k"]).selectExpr("x.id a", "y.id b").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (1, 4), (2, 1), (4, 1)]


def test_near_names_equal_the_rule_on_all_pairs(spark):
    rng = random.Random(3)
    parts = ["Margaret", "Margarret", "Margarets", "Oakes", "Oaken", "Peter", "Petra", "Ann", "Anna", "J.", "von", "Lindqvist", "Lindquist"]
    names = sorted({" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(80)})
    df = spark.createDataFrame([(i % 2, n) for i, n in enumerate(names)], "k int, author string")
    pairs = df.alias("x").join(df.alias("y"), F.col("x.k") == F.col("y.k")).filter(names_nearly_equal(F.col("x.author"), F.col("y.author")))
    want = {tuple(r) for r in pairs.selectExpr("x.author a", "y.author b").collect()}
    got = near.near_names(df, df, ["k"]).selectExpr("x.author a", "y.author b").collect()
    assert {tuple(r) for r in got} == want and len(want) > 10


def test_searches_equal_contains(spark, monkeypatch):
    rng = random.Random(4)
    texts = [(0, None), (1, ""), (2, "a"), (3, "ab"), (4, "a\nb c"), (5, "日本語 text"), (6, "aaaa"), (7, "x" * 5000 + " needle " + "y" * 5000)] + [(i, " ".join("".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 8)))) for i in range(10, 150)]
    searches = [(1, "a"), (2, "ab ca"), (3, "abc"), (4, "cab abca"), (5, ""), (6, None), (7, "needle"), (8, "本語"), (9, "zzz"), (10, "aaaa aaa"), (11, "  b   c "), (12, "ab zz"), (13, "a\nb"), (14, "日")] + [(20 + i, " ".join("".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 3)))) for i in range(40)]
    want = {(s, i) for s, q in searches if q is not None for i, t in texts if t is not None and all(w in t for w in q.split(" ") if w)}
    t, q = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(searches, "search_id int, search string")
    for small, keep in ((500_000, 3), (0, 1)):
        monkeypatch.setattr(trigrams, "SMALL", small)
        monkeypatch.setattr(trigrams, "KEEP", keep)
        got = [tuple(r) for r in trigrams.search(t, q).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert trigrams.search(t.limit(0), q).count() == 0 and trigrams.search(t, q.limit(0)).count() == 0


PLAN = "lib string, id bigint, action string, why string, notes array<string>, review string, selected boolean, override boolean, skipped array<string>"


def test_counters_are_those_of_the_rows_written(spark, tmp_path):
    rows = [
        ("p", 1, "trash", "same file", [], "", True, False, []), ("p", 2, "trash", "same text", ["title and author were swapped"], "", True, True, ["covers"]),
        ("p", 3, "leave", "held: no title or authors", None, None, False, False, None), ("p", 4, "trash", "nothing tells them apart", ["7 is in another language", "9 is in another language"], "no edition", False, False, ["covers", "years"]),
        ("p", 5, "move", "nothing like it", [], "", True, None, []),
    ]
    df = spark.createDataFrame(rows, PLAN)
    got = counters.written_counting(df.repartition(3), f"{tmp_path}/plan", counters.plan_counters(df.columns))
    assert {k: n for k, n in got.items() if n} == {"records": 5, "moved": 1, "trashed": 3, "left": 1, "selected": 3, "swapped": 1, "identical_files": 1, "same_text": 1, "no_edition": 1, "held": 1, "other_language": 2, "to_review": 1, "overruled": 1, "skipped_covers": 2, "skipped_years": 1}
    assert spark.read.parquet(f"{tmp_path}/plan").count() == 5
    line, warnings = counters.summary(got)
    assert "1 duplicates by their files" in line and "2 copies in another language" in line and [w.split()[0] for w in warnings] == ["2", "1"]
    none = counters.written_counting(df.limit(0), f"{tmp_path}/none", counters.plan_counters(df.columns))
    assert set(none.values()) == {0} and counters.summary(none) == ("nothing was read", [])


def test_a_stream_reports_the_counters_of_its_batches(spark, tmp_path):
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = counters.StreamCounters("seen")
    spark.streams.addListener(seen)
    try:
        rows = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("seen", F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % 2 == 0).alias("even"))
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if len(seen.by_batch) >= 3:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    assert seen.totals() == {"n": 30, "even": 15} and len(seen.by_batch) == 3


def _two_sides(spark, rows):
    """Sources have even ids, candidates odd ones."""
    from colophon.plans.features import features
    from colophon.queries.shelves import records

    df = spark.createDataFrame(rows, "id bigint, title string, author string")
    side = F.when(F.col("id") % 2 == 0, "source").otherwise("target")
    feats = features(records(df, lib=F.lit("l"), side=side, id=F.col("id"), title=F.col("title"), authors=F.array("author"), formats=F.array(F.lit("EPUB")))).withColumn("ord", F.array("id"))
    return feats.filter("side = 'source'"), feats.filter("side = 'target'")


def _most_joined(spark, work):
    """The most rows that a join of ``work`` gave, by the statuses of its executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, runs = 0, store.executionsList()
    for i in range(before, runs.size()):
        key, nodes = runs.apply(i).executionId(), store.planGraph(runs.apply(i).executionId()).allNodes()
        values = store.executionMetrics(key)
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if "Join" in node.name():
                for k in range(node.metrics().size()):
                    m = node.metrics().apply(k)
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_author_variants_equal_the_rules_on_all_pairs(spark):
    from colophon.functions.people import initials_match, similar_author_key, surname_match
    from colophon.operators import blocking

    names = ["Margaret Oakes", "M. Oakes", "Oakes", "Margarret Oakes", "P. von Oakes", "Peter van Oakes", "J. R. Holm", "John Robert Holm", "Jane Holm", "Holm", "Holm Holm", "H. Holm", "Ann", "", None]
    src, cand = _two_sides(spark, [(i, "Tides" if i % 3 else "Salt Roads", n) for i, n in enumerate(names * 4)])
    asked = spark.createDataFrame([("Ann", "Oakes", "same"), ("Holm", "Ann", "different")], "a string, b string, answer string")
    got = {tuple(r) for r in blocking.author_variants(src, cand, asked).select("id", "cand", "weak").collect()}
    x, y = (df.select("id", "title_key", F.explode("authors").alias("a")) for df in (src, cand))
    each = x.crossJoin(y.toDF("cand", "t2", "b")).filter("title_key = t2")
    word = F.exists(F.array_intersect(similar_author_key("a"), similar_author_key("b")), lambda w: F.char_length(w) > 1)
    said = F.expr("(a = 'Ann' and b = 'Oakes') or (a = 'Oakes' and b = 'Ann')")
    sure = names_nearly_equal(F.col("a"), F.col("b")) | (word & initials_match(F.col("a"), F.col("b")))
    want = each.withColumn("sure", sure).withColumn("some", F.col("sure") | (word & surname_match(F.col("a"), F.col("b"))) | said).filter("some").groupBy("id", "cand").agg((~F.bool_or("sure")).alias("weak"))
    assert got == {tuple(r) for r in want.collect()} and any(r[2] for r in got) and any(not r[2] for r in got)


def test_a_word_that_all_authors_share_pairs_none_of_them(spark):
    from colophon.operators import blocking

    src, cand = _two_sides(spark, [(i, "Tides", f"Writer {chr(97 + i // 26) * 3}{chr(97 + i % 26) * 3}") for i in range(200)])
    assert _most_joined(spark, lambda: blocking.author_variants(src, cand).count()) < 2_000


def test_similar_titles_compare_each_title_once(spark):
    from colophon.operators import blocking

    src, cand = _two_sides(spark, [(i, "4 Silver Harbour" if i % 2 == 0 else "Silver Harbour" if i % 4 == 1 else "Salt Roads", "Harriet Oakes") for i in range(40)])
    plan = blocking.similar_titles(src, cand)
    assert plan.count() == 20 * 10
    assert {r.cand % 4 for r in plan.collect()} == {1}
    assert "contains" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_records_with_two_authors_in_common_meet_once(spark):
    from colophon.operators import blocking

    df = spark.createDataFrame([("l", i, [i], "tides", ["a", "b", "c"][: 1 + i % 3]) for i in range(6)], "lib string, id bigint, ord array<bigint>, title_key string, similar_keys array<string>")
    met = blocking.similar(df, df)
    assert sorted((r.id, r.cand) for r in met.collect()) == [(a, b) for a in range(6) for b in range(6)]
    # nothing is exchanged or counted after the pairs are made
    assert met._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Project")


def test_large_written_tables_are_exchanged_by_joins(spark):
    from colophon.operators.tables import written

    # a column of one value and numbers in order: little on disk, much in memory
    df = written(spark.range(400_000).selectExpr("id", "xxhash64(id) h", "'the same long text in each row' t"), "rows")
    small = written(spark.range(10).toDF("id"), "few")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(df.join(df.selectExpr("id o", "t s"), F.col("id") == F.col("o")))
    assert "BroadcastHashJoin" in plan(spark.range(99).join(small, "id"))


def test_counts_by_classes_equal_those_of_all_pairs(spark):
    from colophon.operators import blocking

    rng = random.Random(6)
    rows = [("l" if i % 5 else "m", i, [i], rng.choice(["tides", "salt", ""]), rng.choice([["a"], ["a", "b"], ["b"], []]), rng.choice([["a"], ["a", "b"], ["c"], []]), rng.choice([None, "", "saga"]), rng.choice([None, 2.0, 3.5])) for i in range(120)]
    df = spark.createDataFrame(rows, "lib string, id bigint, ord array<bigint>, title_key string, authors_key array<string>, similar_keys array<string>, series_key string, series_number double")
    src, cand = df.filter("id % 2 = 0"), df.filter("id % 2 = 1 or id < 20")
    for own, rule in ((blocking.STRICT, blocking.strict), (blocking.SIMILAR, blocking.similar), (blocking.SERIES, blocking.by_series)):
        want = rule(src, cand).groupBy("lib", "id").agg(F.count("*"), F.min("cand"), F.sum("cand"))
        got = blocking.counted(src, cand, own, rule)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("name", ["block_parts", "block_strict", "block_similar", "block_series", "other_volumes"])
def test_copies_make_no_square_of_pairs(spark, tmp_path, name):
    from colophon.queries import QUERIES

    spark.range(1000).selectExpr("id p_partkey", "'red bolt' p_name", "'Brand#11' p_brand", "'LARGE' p_type", "5 p_size", "1.0D p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    rows = []
    assert _most_joined(spark, lambda: rows.extend(QUERIES[name](spark, str(tmp_path)).collect())) <= 1000
    assert len(rows) == 500 and {r.n for r in rows} == {500}


def times_written(spark, column, what):
    """How often an expression over column ``x`` stands in the plan."""
    plan = spark.createDataFrame([("a",)], "x string").select(column.alias("y"))._jdf.queryExecution().analyzed().toString()
    return plan.split("\n")[0].count(what)


def test_isbn_is_cleaned_once(spark):
    assert times_written(spark, ids.normalize_isbn("x"), "[^0-9Xx]") == 1


def test_names_and_titles_are_read_once(spark):
    assert times_written(spark, people.similar_author_key("x"), "lower(") == times_written(spark, text.key("x"), "lower(")
    assert times_written(spark, titles.title_parts(F.col("x"), F.array(F.lit("b"))), "trim(x") == 1


def test_ascii_keys_equal_the_general_rule(spark):
    odd = [None, "", " ", "&", "a&b", "A_b-C.d", "\x1cx\x1fy\x7f", "tab\tnew\nline\x0bv\x0cf\rr", "It's  1,000 [x] {y} @z", "Ångström & Co", "\x85a b", "é", "ĲSSEL ﬁn ß"]
    df = spark.createDataFrame([(t,) for t in odd], "x string")
    general = F.replace(text.casefold(text._without_accents(F.col("x"))), F.lit("&"), F.lit(" and "))
    general = F.btrim(F.regexp_replace(F.regexp_replace(general, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    rows = df.select(text.key("x").alias("a"), general.alias("b"), text.strip_accents("x").alias("c"), text._without_accents(F.col("x")).alias("d"), text.tokens("x").alias("t")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows)
    assert rows[0]["t"] is None and rows[1]["t"] == rows[2]["t"] == [] and rows[4]["t"] == ["a", "and", "b"]


def test_fingerprints_are_made_once(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 90}" for i in range(600))), (2, "short"), (3, None), (4, "")], "id int, text string")
    made = text_share.prints(docs, 50, need_language=False)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert [r["id"] for r in made.collect()] == [1]
    assert text_share.prints(docs.limit(0)).count() == text_share.prints(docs).count() == 0


def test_pairs_sharing_equals_all_pairs(spark):
    rng = random.Random(5)
    quoted = list(range(4))
    prints = [(i, sorted({*(quoted if i % 2 else []), *rng.sample(range(10, 60), rng.randint(1, 14))})) for i in range(120)]
    prints += [(200 + i, prints[i % 7][1]) for i in range(20)] + [(300, []), (301, quoted)]
    df = spark.createDataFrame(prints, "id int, print array<bigint>")
    for least in (1, 3, 5, 9):
        want = {(i, j) for i, x in prints for j, y in prints if i < j and len({*x} & {*y}) >= least}
        got = [tuple(r) for r in text_share.pairs_sharing(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert text_share.pairs_sharing(df.limit(0), 3).count() == 0


def test_features_are_made_once_and_kept_where_no_isbn_is_junk(spark):
    from colophon.plans import ladder
    from colophon.plans.features import without_junk_isbns
    from colophon.queries.shelves import records

    isbn = F.array(F.lit("9780306406157"))
    of = lambda n: records(spark.range(n), lib=F.lit("l"), side=F.lit("source"), id=F.col("id"), title=F.concat(F.lit("Tides "), F.chr(F.col("id") + 65)), authors=F.array(F.concat(F.lit("Eva Holm"), F.chr(F.col("id") + 97))), isbns=isbn, formats=F.array(F.lit("EPUB")))
    # two titles may share an ISBN: nothing is joined, and what is read back has no title to fold
    two = ladder.described(of(2), ladder.Options())
    assert without_junk_isbns(two) is two
    plan = two._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "regexp_replace" not in plan
    assert [list(r.isbns) for r in two.collect()] == [["9780306406157"]] * 2
    # three can't
    three = ladder.described(of(3), ladder.Options())
    assert [(list(r.isbns), list(r.identity.isbns)) for r in three.collect()] == [([], [])] * 3


def test_doubts_read_changes_and_evidence_instead_of_making_them_again(spark):
    from colophon.plans import review
    from colophon.queries.catalogue import _REVIEW, REVIEWS

    changed = review.changes(review.evidence(spark.createDataFrame([r for r, _ in REVIEWS], _REVIEW)))
    plan = review.doubts(changed)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "LogicalRDD" not in plan
    assert sorted((r.id, r.field, r.doubt) for r in review.doubts(changed).collect()) == sorted((r[0], f, d) for r, cs in REVIEWS for f, _, d in cs)


def test_author_answers_pair_classes_of_records(spark, tmp_path, monkeypatch):
    """Copies of one title and author are one class: pairs don't grow with the square of the copies."""
    import duckdb

    from colophon.operators import blocking
    from colophon.queries import ORACLES, QUERIES

    df = spark.range(2000).selectExpr("id p_partkey", "concat('title ', chr(97 + cast(id % 7 as int)), 'quill') p_name")
    df.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    made, rule = [], blocking.author_variants
    monkeypatch.setattr(blocking, "author_variants", lambda *a: (made.append(rule(*a)), made[-1])[1])
    got = sorted(map(tuple, QUERIES["author_answers"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(ORACLES["author_answers"]).fetchall()) and sum(r[1] for r in got) > 3000
    assert made[0].count() < 1000
