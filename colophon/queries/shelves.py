"""Queries over records made from the given tables, with SQL that decides them in another way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import titles
from colophon.operators import blocking, groups, near, trigrams
from colophon.operators.tables import shared_folder, written
from colophon.plans import answers, counters, execute, ladder, redecide, resume, review, trees
from colophon.plans.features import BOOKS, features
from colophon.queries import query, read, spread
from colophon.streaming.index import CHANGES, decisions, index, keep_index
from colophon.streaming.pause import PausableRun


def records(df: DataFrame, **given: object) -> DataFrame:
    """BOOKS rows of a table: ``given`` columns, and nothing in all others."""
    names = [f.split()[0:2] for f in BOOKS.split(", ")]
    empty = lambda kind: F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
    return df.select(*((given[n] if n in given else empty(kind)).cast(kind).alias(n) for n, kind in names))


def blocks(books: DataFrame) -> DataFrame:
    """What the candidate index takes of records: their block, rank, year and publisher."""
    feats = features(books).filter("title_key <> '' and size(authors_key) > 0")
    block = F.concat_ws("|", "title_key", F.array_join("authors_key", "&"))
    return feats.select("lib", block.alias("block"), "id", F.col("rank").cast("int").alias("rank"), (-F.col("richness")).cast("int").alias("poor"), "year", "publisher")


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as one library: the name is the title, the type the author; neighbours have one file, and sizes give year, publisher and format.

    File copies cross titles and authors, so that most records depend on each other in one component.
    """
    size = F.col("p_size")
    return records(
        spread(spark, sf_dir, "part"),
        lib=F.lit("parts"), side=F.lit("source"), id=F.col("p_partkey"), title=F.col("p_name"), authors=F.array("p_type"),
        year=1990 + size % 4, publisher=F.when(size % 3 == 1, "Osprey").when(size % 3 == 2, "Kestrel"),
        formats=F.array(F.when(size % 2 == 0, "EPUB").otherwise("PDF")), digest=F.expr("cast(p_partkey div 2 as string)"),
    )


#: The shelf in SQL, in the order of ranks; ``pairs`` has what each record meets among the better-ranked ones.
SHELF = """
    recs AS MATERIALIZED (SELECT p_partkey AS id, p_name AS t, p_type AS a, 1990 + p_size % 4 AS y, CASE p_size % 3 WHEN 1 THEN 'Osprey' WHEN 2 THEN 'Kestrel' END AS p, p_partkey // 2 AS d,
        row_number() OVER (ORDER BY p_size % 2, CASE WHEN p_size % 3 > 0 THEN 0 ELSE 1 END, p_partkey) AS k FROM part),
    pairs AS MATERIALIZED (SELECT r.k, c.k AS ck, c.id AS cand, CASE WHEN r.d = c.d THEN 'file' WHEN r.y <> c.y OR r.p <> c.p THEN 'distinct' WHEN r.p = c.p THEN 'duplicate' ELSE 'unknown' END AS v
        FROM recs r JOIN recs c ON c.k < r.k AND (r.d = c.d OR r.t = c.t AND r.a = c.a))"""
#: One record after the other: ``gone`` has the places of those that went.
IN_TURN = f"""
    WITH RECURSIVE {SHELF},
    walk(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.k = w.k + 1 AND p.v IN ('file', 'duplicate') AND NOT list_contains(w.gone, p.ck)) THEN list_append(w.gone, w.k + 1) ELSE w.gone END
        FROM walk w WHERE w.k < (SELECT count(*) FROM recs)),
    ended AS (SELECT gone FROM walk ORDER BY k DESC LIMIT 1),
    live AS (SELECT p.* FROM pairs p, ended e WHERE NOT list_contains(e.gone, p.ck)),
    met AS (SELECT k, arg_min(cand, ck) FILTER (v = 'file') AS fm, arg_min(cand, ck) FILTER (v = 'duplicate') AS dm, count(*) FILTER (v = 'unknown') AS um, arg_min(cand, ck) FILTER (v <> 'file') AS first FROM live GROUP BY k),
    plan AS (SELECT id, k, CASE WHEN fm IS NOT NULL OR dm IS NOT NULL THEN 'trash' ELSE 'leave' END AS action, coalesce(fm, dm, first) AS match,
        CASE WHEN fm IS NOT NULL THEN 'same file' WHEN dm IS NOT NULL THEN 'year+publisher' WHEN um > 0 THEN 'to check' WHEN first IS NOT NULL THEN 'different' ELSE 'nothing like it' END AS why
        FROM recs LEFT JOIN met USING (k))"""

ONE = ladder.Options(one_library=True)


@query(f"{IN_TURN} SELECT id, action, match, why FROM plan")
def greedy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ1, DL0, DL2-DL8, JN1, JN4, WN1 over all parts: decided in parallel rounds, held against one record after the other."""
    return ladder.plan(shelf(spark, sf_dir), ONE).select("id", "action", "match", "why")


#: The parts that come again in another form and those that go, in the last batch; every sixth year is not known.
_FORMS = """p_partkey % 13 = 5 AS again, p_partkey % 40 = 3 AS gone, p_partkey % 6 = 1 AS undated"""
_LATE = f"""
    recs AS MATERIALIZED (SELECT id, t, a, y, p, row_number() OVER (ORDER BY form, poor, id) AS k FROM (
        SELECT p_partkey AS id, p_name AS t, p_type AS a, CASE WHEN NOT undated THEN 1990 + p_size % 4 END AS y, CASE p_size % 3 WHEN 1 THEN 'Osprey' WHEN 2 THEN 'Kestrel' END AS p,
            p_size % 2 AS form, -((CASE WHEN p_size % 3 > 0 THEN 1 ELSE 0 END) + (CASE WHEN undated THEN 0 ELSE 1 END)) AS poor
        FROM (SELECT *, {_FORMS} FROM part) WHERE NOT gone)),
    pairs AS (SELECT r.k, r.id, c.k AS ck, c.id AS cand, CASE WHEN r.y <> c.y OR r.p <> c.p THEN 'distinct' WHEN r.y = c.y AND r.p = c.p THEN 'duplicate' ELSE 'unknown' END AS v FROM recs r JOIN recs c ON c.k < r.k AND r.t = c.t AND r.a = c.a),
    gone AS (SELECT DISTINCT k FROM pairs WHERE v = 'duplicate'),
    met AS (SELECT k, arg_min(cand, ck) FILTER (v = 'duplicate') AS dm, count(*) FILTER (v = 'unknown') AS um, arg_min(cand, ck) AS first FROM pairs WHERE ck NOT IN (SELECT k FROM gone) GROUP BY k)"""


@query(f"""WITH {_LATE} SELECT id, CASE WHEN dm IS NOT NULL THEN 'trash' ELSE 'leave' END AS action, coalesce(dm, first) AS match,
    CASE WHEN dm IS NOT NULL THEN 'year+publisher' WHEN um > 0 THEN 'to check' WHEN first IS NOT NULL THEN 'different' ELSE 'nothing like it' END AS why FROM recs LEFT JOIN met USING (k)""")
def stream_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.17, SQ2: all parts as a stream of batches, better ones after worse, some changed or taken back; the index decides as the batch plan does."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    size = F.col("p_size")
    parts = spread(spark, sf_dir, "part").selectExpr("*", *(x.replace(" AS ", " ") for x in _FORMS.split(", ")))
    rows = blocks(records(
        parts, lib=F.lit("parts"), side=F.lit("source"), id=F.col("p_partkey"), title=F.col("p_name"), authors=F.array("p_type"),
        year=F.when(~F.col("undated"), 1990 + size % 4), publisher=F.when(size % 3 == 1, "Osprey").when(size % 3 == 2, "Kestrel"), formats=F.array(F.when(size % 2 == 0, "EPUB").otherwise("PDF")),
    )).join(parts.select(F.col("p_partkey").alias("id"), "again", "gone"), "id")
    # a batch is one file, written by one task, which would make all keys again
    rows = written(rows, "rows")
    first = rows.withColumn("version", F.lit(1)).withColumn("publisher", F.when(F.col("again"), F.lit("Heron")).otherwise(F.col("publisher"))).withColumn("rank", F.when(F.col("again"), 0).otherwise(F.col("rank"))).withColumn("gone", F.lit(False))
    last = rows.filter("again or gone").withColumn("version", F.lit(2))
    kinds = [f.split()[:2] for f in CHANGES.split(", ")]
    dealt = lambda df: df.select(*(F.col(n).cast(k).alias(n) for n, k in kinds))
    for n, part in enumerate([*(dealt(first.filter((F.col("rank") > 0) & (F.col("id") % 2 == k))) for k in range(2)), dealt(first.filter("rank = 0")), dealt(last)]):
        part.coalesce(1).write.parquet(f"{folder}/in/{n}")
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    keep_index(changes, f"{folder}/log", f"{folder}/checkpoint").awaitTermination()
    return decisions(rows.filter("not gone"), index(spark, f"{folder}/log")).drop("lib")


#: Last ranks of three ranges: the readable ones with all facts, the other readable ones, the rest with all facts.
_CUTS = [[1, 0, -3, 1 << 62], [1, 0, -2, 1 << 62], [1, 3, -3, 1 << 62]]


@query(f"{IN_TURN} SELECT plan.id, action, match, why, p_size % 2 = 0 AS early FROM plan JOIN part ON plan.id = p_partkey")
def resumed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ3, SO5: a run over all parts that stops after two of four ranges and goes on; ``early`` rows stood in the partial plan as they stand in the whole one."""
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    resume.start(shelf(spark, sf_dir), folder, ONE, _CUTS)
    resume.go_on(spark, folder, at_most=2)
    early = written(resume.result(spark, folder)[0].select("id", "action", "match", "why"), "early")
    resume.go_on(spark, folder)
    whole = resume.result(spark, folder)[0].select("id", "action", "match", "why")
    same = early.select(F.struct("id", "action", "match", "why").alias("e"))
    return whole.join(same, F.struct(*whole.columns).eqNullSafe(F.col("e")), "left").select(*whole.columns, F.col("e").isNotNull().alias("early"))


def _counted(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "counter string, n bigint")


#: Checks that a part of the shelf lacked, by its size.
_LACKED = {"covers": 5, "scans": 7}


@query(f"""{IN_TURN}, joined AS (SELECT * FROM plan JOIN part ON plan.id = p_partkey),
    asked AS (SELECT event_type AS kind, CASE WHEN value < 10 THEN 'asked' WHEN value < 20 THEN 'cached' ELSE 'identical' END AS how FROM events),
    counts AS (SELECT count(*) AS records, 0 AS moved, count(*) FILTER (action = 'trash') AS trashed, count(*) FILTER (action = 'leave') AS left_, count(*) FILTER (action = 'trash') AS selected,
        count(*) FILTER (why = 'same file') AS identical_files, count(*) FILTER (p_size % 5 = 0) AS covers, count(*) FILTER (p_size % 7 = 0) AS scans FROM joined)
    SELECT counter, n::BIGINT AS n FROM (
        SELECT unnest(['records', 'moved', 'trashed', 'left', 'selected', 'identical_files', 'skipped_covers', 'skipped_scans']) AS counter, unnest([records, moved, trashed, left_, selected, identical_files, covers, scans]) AS n FROM counts
        UNION ALL SELECT unnest(['swapped', 'same_text', 'by_cover', 'no_edition', 'held', 'empty', 'unreadable', 'other_language', 'to_review', 'overruled', 'skipped_reading', 'skipped_images', 'skipped_years']), 0
        UNION ALL SELECT c, count(kind) FROM (VALUES ('read', 'view', 'asked'), ('read_cached', 'view', 'cached'), ('cover', 'click', 'asked'), ('cover_cached', 'click', 'cached'), ('cover_identical', 'click', 'identical'),
            ('embedded', 'purchase', 'asked'), ('embedded_cached', 'purchase', 'cached'), ('embedded_identical', 'purchase', 'identical'), ('author', 'signup', 'asked'), ('author_cached', 'signup', 'cached'), ('year', 'error', 'asked')) x(c, k, h)
            LEFT JOIN asked ON kind = k AND how = h GROUP BY c)""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9: all counters of a plan over all parts, observed while it is written, and of the events as calls of readers."""
    folder = f"{shared_folder(spark)}/counted-{uuid.uuid4().hex}"
    size = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_compact(F.array(*(F.when(F.col("p_size") % k == 0, name) for name, k in _LACKED.items()))).alias("skipped"))
    plan = ladder.plan(shelf(spark, sf_dir), ONE).join(size, "id")
    counts = counters.written_counting(plan, f"{folder}/plan", counters.plan_counters(plan.columns))
    kinds = {"view": "read", "click": "cover", "purchase": "embedded", "signup": "author", "error": "year"}
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items()))
    calls = read(spark, sf_dir, "events").select(kind.alias("kind"), F.when(F.col("value") < 10, "asked").when(F.col("value") < 20, "cached").otherwise("identical").alias("how"))
    return _counted(spark, counts | counters.written_counting(calls, f"{folder}/calls", counters.call_counters()))


@query("""
    WITH books AS (SELECT p_partkey AS id, p_partkey % 9 = 0 AS unread, p_partkey % 4 = 0 AS cached, CASE p_size % 3 WHEN 1 THEN 'Osprey' WHEN 2 THEN 'Kestrel' END AS p, p_partkey % 7 = 0 AS year_differs FROM part),
    rows AS (SELECT *, CASE WHEN unread THEN 0 ELSE (CASE WHEN p IS DISTINCT FROM 'Osprey' THEN 1 ELSE 0 END) + (CASE WHEN year_differs THEN 1 ELSE 0 END) END AS changes FROM books)
    SELECT unnest(['reviewed', 'changed', 'left_out', 'not_read', 'read', 'read_cached']) AS counter,
        unnest([count(*), count(*) FILTER (changes > 0), sum(changes), count(*) FILTER (unread), count(*) FILTER (NOT unread AND NOT cached), count(*) FILTER (NOT unread AND cached)])::BIGINT AS n FROM rows""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10, PF12, PF13: readings of all parts, what they change, and what is left out as nothing backs it, counted while they are written."""
    folder = f"{shared_folder(spark)}/counted-{uuid.uuid4().hex}"
    books = shelf(spark, sf_dir)
    found = "named_struct('title', cast(null as string), 'authors', cast(null as array<string>), 'publisher', 'Osprey', 'year', year + if(id % 7 = 0, 1, 0), 'series', cast(null as string), 'series_index', cast(null as double), 'isbn', cast(null as array<string>), 'language', cast(null as string))"
    said = books.filter("id % 9 <> 0").select("lib", "id", F.expr(found).alias("found"))
    texts = books.select("lib", "id", F.lit(None).cast("string").alias("text"))
    rows = review.doubts(review.changes(review.evidence(books.join(said, ["lib", "id"]).join(texts, ["lib", "id"]))))
    each = rows.groupBy("lib", "id").agg(F.count("*").alias("changes"), F.count_if(F.col("doubt").isNotNull()).alias("left_out"))
    all_ = books.select("lib", "id", (F.col("id") % 9 != 0).alias("found"), (F.col("id") % 4 == 0).alias("cached")).join(each, ["lib", "id"], "left").fillna(0, ["changes", "left_out"])
    return _counted(spark, counters.written_counting(all_, f"{folder}/review", counters.review_counters()))


#: Names of customers and suppliers without the zeros before their numbers.
_NAMES = "SELECT regexp_replace(c_name, '#0*', '#') AS word FROM customer UNION ALL SELECT regexp_replace(s_name, '#0*', '#') FROM supplier UNION ALL SELECT regexp_replace(c_name, '#0*', '#') FROM customer WHERE c_custkey % 10 = 3"


@query(f"""WITH names AS (SELECT DISTINCT word FROM ({_NAMES})), met AS (SELECT a.word AS x, b.word AS y FROM names a JOIN names b ON a.word <> b.word AND abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.word, b.word) <= 1)
    SELECT x AS word, count(*) AS n, min(y) AS first, max(y) AS last FROM met GROUP BY x""")
def near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM4: all customers' and suppliers' names that are one edit from others: how many, the first and the last, by the index of deletions."""
    names = [read(spark, sf_dir, t).select(F.regexp_replace(c, "#0*", "#").alias("word")) for t, c in (("customer", "c_name"), ("supplier", "s_name"))]
    pairs = near.one_edit_pairs(names[0].union(names[1]).union(names[0]))
    both = pairs.union(pairs.select("b", "a"))
    return both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n"), F.min("b").alias("first"), F.max("b").alias("last"))


@query("""WITH people AS (SELECT c_custkey AS id, c_mktsegment AS t, replace(c_name, 'Customer#', '') AS w FROM customer)
    SELECT a.id, count(*) AS n, min(b.id) AS first, false AS weak FROM people a JOIN people b ON a.t = b.t AND a.id % 2 = 0 AND b.id % 2 = 1 AND hamming(a.w, b.w) = 1 GROUP BY a.id""")
def author_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, NM5 over all customers as authors of books that their segments name: even ones are sources, odd ones targets."""
    key = F.col("c_custkey")
    feats = features(records(spread(spark, sf_dir, "customer"), lib=F.lit("c"), side=F.when(key % 2 == 0, "source").otherwise("target"), id=key, title=F.col("c_mktsegment"), authors=F.array(F.replace("c_name", F.lit("#"), F.lit(" "))), formats=F.array(F.lit("EPUB")))).withColumn("ord", F.array("id"))
    pairs = blocking.author_variants(feats.filter("side = 'source'"), feats.filter("side = 'target'"))
    return pairs.groupBy("id").agg(F.count("*").alias("n"), F.min("cand").alias("first"), F.bool_or("weak").alias("weak"))


#: A fragment of each benchmark text, whose words are searched.
_FRAGMENT = "lower(substring(text, {start}, {length}))"


@query(f"""WITH searches AS (SELECT item_id, list_filter(string_split({_FRAGMENT.format(start="5 + item_id % 7", length="7 + item_id % 11")}, ' '), lambda x: x <> '') AS ws FROM benchmark),
    texts AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
    SELECT item_id, count(*) AS n, min(doc_id) AS first, sum(doc_id)::BIGINT AS total FROM searches JOIN texts ON len(list_filter(ws, lambda w: NOT contains(t, w))) = 0 GROUP BY item_id""")
def many_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF22: fragments of all benchmark texts searched in all documents by the index of trigrams."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("search_id"), F.expr(_FRAGMENT.format(start="cast(5 + item_id % 7 as int)", length="cast(7 + item_id % 11 as int)")).alias("search"))
    hits = trigrams.search(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text")), items)
    return hits.groupBy(F.col("search_id").alias("item_id")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum("id").alias("total"))


@query("""WITH old AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 3001 <> 5),
    new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_custkey + CASE WHEN o_orderkey % 2003 = 11 THEN 1 ELSE 0 END END AS v FROM orders WHERE o_orderkey % 4001 <> 6)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old a FULL JOIN new b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.v IS DISTINCT FROM b.v""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, SL9: what differs between two states of all orders, by descending their hash trees."""
    folder = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    rows = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    for name, there, added in (("old", key % 3001 != 5, F.lit(0)), ("new", key % 4001 != 6, F.when(key % 2003 == 11, 1).otherwise(0))):
        version = F.when(key % 7 != 3, F.col("o_custkey") + added)
        trees.save(rows.filter(there).select(F.lit("orders").alias("lib"), key.alias("id"), version.cast("bigint").alias("version")), f"{folder}/{name}")
    return trees.changed(spark, f"{folder}/old", f"{folder}/new").select("id", "change")


#: The shelf after some files turned out not to open and some readings were asked again.
_ANEW = IN_TURN.replace("1990 + p_size % 4 AS y", "1990 + p_size % 4 + CASE WHEN p_partkey % 97 = 4 THEN 1 ELSE 0 END AS y").replace("AS k FROM part)", "AS k FROM part WHERE p_partkey % 89 <> 6)")


@query(f"{_ANEW} SELECT id, action, match, why FROM plan UNION ALL SELECT p_partkey, 'trash', NULL, 'no format that opens' FROM part WHERE p_partkey % 89 = 6")
def redecided_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF27, AI10, JN11: the plan of all parts decided anew where files failed and readings changed, held against the changed input one after the other."""
    books = shelf(spark, sf_dir)
    kept = redecide.keep(books, ONE)
    failed = F.when(F.col("id") % 89 == 6, F.col("formats")).otherwise(F.col("broken"))
    changed = books.withColumn("broken", failed).withColumn("year", F.col("year") + F.when(F.col("id") % 97 == 4, 1).otherwise(0))
    return redecide.again(kept, changed).plan().select("id", "action", "match", "why")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first FROM events GROUP BY event_type")
def paused_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQ4: all events as a stream of rate-limited batches that is paused twice and taken up again; sums as of one run."""
    folder = f"{shared_folder(spark)}/paused-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    events.repartitionByRange(6, "event_id").write.parquet(f"{folder}/in")
    sums = (F.count("*").alias("n"), F.sum("value").alias("total"), F.min("ts").alias("first"))
    step = lambda batch, n: batch.groupBy("event_type").agg(*sums).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    run = PausableRun("events", lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), step, f"{folder}/checkpoint")
    for batches in (2, 1, None):
        run.go(batches)
    parts = spark.read.parquet(f"{folder}/out")
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"), F.min("first").alias("first"))


@query("""WITH books AS (SELECT p_partkey % 3 AS lib, p_partkey AS id, unnest([lower(p_type) || ' ' || split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)]) AS author FROM part),
    own AS (SELECT lib, array_to_string(list_sort(string_split(author, ' ')), ' ') AS name, count(DISTINCT id) AS n FROM books GROUP BY 1, 2)
    SELECT 'l' || lib AS lib, 'book' AS kind, name, n FROM own UNION ALL SELECT 'l' || lib, 'person', part, count(*) FROM (SELECT lib, name, unnest(list_distinct(string_split(name, ' '))) AS part FROM own) GROUP BY 1, 2, 3""")
def author_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: books of each author, and authors of each part of a name, over all parts in three libraries."""
    noun, adjective = F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1)
    books = records(read(spark, sf_dir, "part"), lib=F.concat(F.lit("l"), (F.col("p_partkey") % 3).cast("string")), side=F.lit("source"), id=F.col("p_partkey"), title=F.col("p_name"), authors=F.array(F.concat_ws(" ", noun, "p_type"), adjective), formats=F.array(F.lit("EPUB")))
    return groups.author_support(features(books))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey DESC) = 1")
def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: the first row of each key kept, in an order that is given."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return groups.first_of_each(rows, ["o_custkey"], [F.col("o_orderdate"), -F.col("o_orderkey")])


@query("""SELECT doc_id, len(items) AS n, md5(array_to_string(list_transform(items[:8], lambda x: substr(trim(x, ' '), 1, 300)), '|')) AS digest
    FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS items FROM documents WHERE text IS NOT NULL)""")
def evidence_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO3 over the lines of all documents as evidence: eight items, 300 characters each."""
    lines = F.split("text", "\n", -1)
    said = F.filter(lines, lambda x: F.btrim(x) != "")
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.size(said).cast("bigint").alias("n"), F.md5(F.array_join(answers.trimmed(lines), "|").cast("binary")).alias("digest"))


@query("""SELECT p_partkey AS id, CASE WHEN s % 5 = 0 THEN 0 WHEN s % 5 = 1 THEN 1 WHEN s % 5 < 4 THEN 2 ELSE 3 END AS rank, CASE WHEN s % 5 = 0 THEN 2 ELSE 1 END + CASE WHEN s % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN s % 4 > 0 THEN 1 ELSE 0 END + CASE WHEN s % 7 = 0 THEN 1 ELSE 0 END AS richness,
    '1,' || rank || ',' || -richness || ',' || p_partkey AS place FROM (SELECT p_partkey, p_size AS s FROM part)""")
def shelf_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1, AG8, SO4: format rank, richness and the order in which all parts would be decided."""
    size = F.col("p_size")
    formats = F.when(size % 5 == 0, F.array(F.lit("PDF"), F.lit("EPUB"))).when(size % 5 == 1, F.array(F.lit("MOBI"))).when(size % 5 == 2, F.array(F.lit("AZW"))).when(size % 5 == 3, F.array(F.lit("AZW3"))).otherwise(F.array(F.lit("PDF")))
    books = records(
        read(spark, sf_dir, "part"), lib=F.lit("l"), side=F.lit("source"), id=F.col("p_partkey"), title=F.col("p_name"), authors=F.array("p_type"), formats=formats, has_cover=size % 2 == 0,
        publisher=F.when(size % 3 > 0, F.col("p_brand")), year=F.when(size % 4 > 0, 1990 + size), comments=F.when(size % 7 == 0, F.lit("rich")).otherwise(F.lit(" ")),
    )
    feats = ladder.ranked(features(books))
    return feats.select(F.col("book").alias("id"), F.col("rank").cast("int").alias("rank"), F.col("richness").cast("int").alias("richness"), F.array_join(F.col("ord").cast("array<string>"), ",").alias("place"))


@query("""SELECT a.p_partkey AS id, count(*) AS n, sum(b.p_partkey)::BIGINT AS total FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1 AND a.p_size % 3 = b.p_size % 3 GROUP BY 1""")
def other_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: pairs by author and title whose titles name other volumes (none, 1 or 2) are no candidates."""
    key, size = F.col("p_partkey"), F.col("p_size")
    title = F.when(size % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" vol "), (size % 3).cast("string")))
    feats = features(records(spread(spark, sf_dir, "part"), lib=F.lit("l"), side=F.when(key % 2 == 0, "source").otherwise("target"), id=key, title=title, authors=F.array("p_brand"), series=F.col("p_name"), formats=F.array(F.lit("EPUB")))).withColumn("ord", F.col("id"))
    by = lambda df: df.select("lib", "id", F.array_join("authors_key", " ").alias("a"), titles.series_key("series").alias("s"))

    def met(src: DataFrame, cand: DataFrame) -> DataFrame:
        pairs = by(src).join(by(cand).withColumnRenamed("id", "cand"), ["lib", "a", "s"]).select("lib", "id", "cand")
        return blocking.without_other_volumes(pairs, src, cand)

    return blocking.counted(feats.filter("side = 'source'"), feats.filter("side = 'target'"), ["title_key", "authors_key", "series"], met).select("id", "n", "total")


@query("""WITH covers AS (SELECT p_partkey AS id, p_brand || p_size % 3 AS cover, p_name AS t, p_type AS a FROM part WHERE p_size % 5 > 0), junk AS (SELECT cover FROM covers GROUP BY cover HAVING count(DISTINCT t) >= 3 AND count(DISTINCT a) >= 3)
    SELECT p_partkey AS id, coalesce(c.cover IN (SELECT cover FROM junk), false) AS generic FROM part LEFT JOIN covers c ON c.id = p_partkey""")
def generic_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IM2, AG4: covers that stand on three titles and three sets of authors say nothing."""
    size = F.col("p_size")
    books = records(read(spark, sf_dir, "part"), lib=F.lit("l"), side=F.lit("source"), id=F.col("p_partkey"), title=F.col("p_name"), authors=F.array("p_type"), formats=F.array(F.lit("EPUB")), cover=F.when(size % 5 > 0, F.concat("p_brand", (size % 3).cast("string"))))
    return ladder._with_generic(features(books)).select("id", "generic")


@query("""SELECT p_partkey AS id, e IS NULL AND y IS NULL OR p IS NULL AS edition, ay IS NULL OR ap IS NULL AS machine FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 3 END AS e, CASE WHEN p_size % 3 = 0 THEN 1990 END AS y, CASE WHEN p_size % 5 > 0 THEN p_brand END AS p, CASE WHEN p_partkey % 2 = 0 THEN 1990 END AS ay, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS ap FROM part)""")
def reading_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF3: which parts' readings are worth asking for, by the record and by what a machine has read."""
    size, key = F.col("p_size"), F.col("p_partkey")
    identity = F.struct(F.when(size % 2 == 0, 3).alias("edition"), F.when(size % 3 == 0, 1990).alias("year"), F.when(size % 5 > 0, F.col("p_brand")).otherwise("").alias("publisher"), F.when(key % 2 == 0, 1990).alias("ai_year"), F.when(key % 3 > 0, F.col("p_brand")).alias("ai_publisher"))
    df = read(spark, sf_dir, "part").select(key.alias("id"), identity.alias("identity"))
    return df.select("id", answers.needs_edition().alias("edition"), answers.needs_machine_facts().alias("machine"))


@query("""WITH writers AS (SELECT p_partkey AS id, p_name AS t, p_partkey % 50 AS n FROM part), asked AS (SELECT k AS n, k + 1 AS m FROM (SELECT unnest(range(0, 49)) AS k) WHERE k % 3 = 0)
    SELECT a.id, count(*) AS n, min(b.id) AS first, bool_and(a.n <> b.n) AS weak FROM writers a JOIN writers b ON a.t = b.t AND a.id % 2 = 0 AND b.id % 2 = 1
    JOIN asked ON (a.n = asked.n AND b.n = asked.m) OR (a.n = asked.m AND b.n = asked.n) GROUP BY a.id""")
def author_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI5, JN5: what a reader said of pairs of authors makes weak candidates; all parts by fifty writers, of whom every third is one person with the next."""
    key = F.col("p_partkey")
    # letters stand twice, so that no two names are one edit apart
    writer = lambda n: F.concat(F.lit("Writer "), F.regexp_replace(F.translate(n.cast("string"), "0123456789", "abcdefghij"), "(.)", "$1$1"), F.lit("quill"))
    books = records(spread(spark, sf_dir, "part"), lib=F.lit("l"), side=F.when(key % 2 == 0, "source").otherwise("target"), id=key, title=F.col("p_name"), authors=F.array(writer(key % 50)), formats=F.array(F.lit("EPUB")))
    feats, n = features(books).withColumn("ord", F.array("id")), F.col("id")
    said = spark.range(0, 49).select(writer(n).alias("a"), writer(n + 1).alias("b"), F.when(n % 3 == 0, "same").when(n % 3 == 1, "different").otherwise("unsure").alias("answer"))
    rule = lambda src, cand: blocking.author_variants(src, cand, said)
    return blocking.counted(feats.filter("side = 'source'"), feats.filter("side = 'target'"), blocking.NAMES, rule, F.bool_and("weak").alias("weak")).select("id", "n", "first", "weak")


@query("""WITH books AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN ['ZIP'] WHEN p_size % 3 = 1 THEN ['EPUB', 'ZIP'] ELSE ['PDF'] END AS formats, p_size % 3 < 2 AND p_size % 5 > 0 AS opened, CASE WHEN p_size % 2 = 0 THEN 'EPUB' ELSE 'MOBI' END AS held FROM part)
    SELECT id, 'source' AS side, array_to_string(list_sort(CASE WHEN opened THEN list_distinct(list_append(list_filter(formats, lambda f: f <> 'ZIP'), held)) ELSE formats END), ',') AS formats FROM books
    UNION ALL SELECT id, 'trash', array_to_string(formats, ',') FROM books WHERE opened""")
def archives_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX6: archives of all parts that open give the record what they held; the whole former record goes to the trash side."""
    size, none = F.col("p_size"), F.array().cast("array<string>")
    pick = lambda *names: F.array(*map(F.lit, names))
    formats = F.when(size % 3 == 0, pick("ZIP")).when(size % 3 == 1, pick("EPUB", "ZIP")).otherwise(pick("PDF"))
    part = read(spark, sf_dir, "part")
    books = part.select(F.lit("l").alias("lib"), F.lit("source").alias("side"), F.col("p_partkey").alias("id"), formats.alias("formats"))
    opened = (size % 3 < 2) & (size % 5 > 0)
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    done = part.select(
        F.lit("l").alias("lib"), F.col("p_partkey").alias("id"), F.lit("leave").alias("action"), empty("bigint", "match"), empty("string", "match_side"), F.lit("").alias("add"), F.lit(True).alias("ok"),
        F.when(opened, pick("ZIP")).otherwise(none).alias("take_out"), F.when(opened, F.array(F.when(size % 2 == 0, "EPUB").otherwise("MOBI"))).otherwise(none).alias("put_in"),
    )
    return execute.applied(books, done).select("id", "side", F.array_join(F.sort_array("formats"), ",").alias("formats"))
