import io
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from colophon import queries
from colophon.sources import catalogue, files
from colophon.streaming import facts

CASES = sorted(queries.ORACLES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "customer supplier part orders events documents pages benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(value):
    return round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CASES)
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    got = duck.execute(queries.ORACLES[name])
    order = [[d[0] for d in got.description].index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == expected


def test_sqlite_scan(spark, tmp_path):
    path = str(tmp_path / "metadata.db")
    with sqlite3.connect(path) as db:
        db.executescript("""
            CREATE TABLE books(id INTEGER, title TEXT, pubdate TEXT, path TEXT, uuid TEXT);
            CREATE TABLE authors(id INTEGER, name TEXT); CREATE TABLE books_authors_link(id INTEGER, book INTEGER, author INTEGER);
            CREATE TABLE data(id INTEGER, book INTEGER, format TEXT, name TEXT); CREATE TABLE identifiers(id INTEGER, book INTEGER, type TEXT, val TEXT);
            INSERT INTO books VALUES (1, 'Dune', '1965-06-15 12:00:00', 'p', 'u1'), (2, 'Old', '0101-01-01 00:00:00', 'q', 'u2');
            INSERT INTO authors VALUES (1, 'Herbert| Frank'), (2, 'B'); INSERT INTO books_authors_link VALUES (2, 1, 1), (1, 1, 2);
            INSERT INTO data VALUES (1, 1, 'epub', 'x'), (2, 1, 'PDF', 'x'); INSERT INTO identifiers VALUES (1, 1, 'isbn', '0-306-40615-2'), (2, 1, 'amazon_it', 'F20');
        """)
    tables = catalogue.sqlite_tables(spark, path, ["books", "authors", "books_authors_link", "data", "identifiers", "tags", "books_tags_link"])
    one, two = catalogue.scan(tables).orderBy("id").collect()
    assert (one.authors, one.year, one.formats, one.isbns, one.asins, one.tags) == (["B", "Herbert, Frank"], 1965, ["EPUB", "PDF"], ["9780306406157"], [], [])
    assert (two.authors, two.year, two.formats, two.isbns) == ([], None, [], [])


def test_tags(spark):
    books = spark.createDataFrame([(1, ["New", "x"]), (2, []), (3, ["NEW"])], "id int, tags array<string>")
    ids = lambda *a: [r.id for r in books.filter(catalogue.tag_selects(*a)).orderBy("id").collect()]
    assert ids(" new ") == [1, 3] and ids("new, x", True) == [2] and ids("") == [1, 2, 3]
    assert [r.tag for r in catalogue.tag_names(books).collect()] == ["NEW", "New", "x"]


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    content = [(1, zipped({"a/Dune.epub": b"x", "a/cover.jpg": b"y"})), (2, zipped({"One.epub": b"x", "Two.pdf": b"y"})), (3, zipped({"a.epub": b"x", "b.epub": b"y"})), (4, b"no"), (5, zipped({"in.zip": b"x"})), (6, zipped({"../up.epub": b"x"}))]
    members = files.archive_members(spark.createDataFrame(content, "id bigint, content binary"))
    got = {r.id: (r.formats, r.problem, r.doubt) for r in files.archive_plan(members).collect()}
    assert got[1] == ("EPUB", None, None) and got[2] == ("EPUB,PDF", None, "names differ") and got[3][1] == "two files of a format"
    assert got[4][1].startswith("not a ZIP") and got[5][1] == "archive within" and got[6][1] == "unsafe names"


def test_epub(spark):
    opf = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> Dune </dc:title></metadata><manifest><item id="c" href="c.png" media-type="image/png" properties="cover-image"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>'
    box = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/o.opf"/></rootfiles></container>'
    content = zipped({"META-INF/container.xml": box, "OEBPS/o.opf": opf, "OEBPS/a.xhtml": "<html><head><title>no</title></head><body><p>one</p><p>two &amp; three</p></body></html>", "OEBPS/c.png": b"png"})
    good, bad = files.read_epubs(spark.createDataFrame([(1, content), (2, b"x")], "id bigint, content binary")).orderBy("id").collect()
    assert (good.text, good.title, bytes(good.cover), good.error) == ("one\n\ntwo & three", "Dune", b"png", None) and bad.error


def test_formats_and_signatures(spark):
    df = spark.createDataFrame([(["PDF", "MOBI", "ZIP"], b"PK\x03\x04")], "f array<string>, c binary")
    r = df.select(files.pick_format(F.col("f")).alias("a"), files.same_text_format(F.array(F.lit("ZIP"))).alias("b"), files.signature(F.col("c")).alias("k"), files.fits(F.lit("PDF"), F.lit("zip")).alias("ok")).first()
    assert tuple(r) == ("MOBI", None, "zip", False)


def test_incremental_facts(spark, tmp_path):
    kind = "lib string, id bigint, version string, text string"
    compute = lambda df: df.select("lib", "id", "version", F.length("text").alias("n"))
    folder = f"{tmp_path}/facts"
    assert facts.refresh(spark.createDataFrame([("a", 1, "x", "one"), ("a", 2, "x", "two")], kind), folder, compute) == 2
    changed = spark.createDataFrame([("a", 1, "x", "one"), ("a", 2, "y", "longer")], kind)
    changed.write.parquet(f"{tmp_path}/in")
    facts.stream_facts(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), folder, f"{tmp_path}/cp", compute).awaitTermination()
    now = facts.current(spark, folder)
    assert {(r.id, r.version, r.n) for r in now.collect()} == {(1, "x", 3), (2, "y", 6)}
    assert facts.refresh(changed, folder, compute) == 0
    assert facts.forget_unseen(now, changed.filter("id = 1")).count() == 1
    facts.compact(spark, folder)
    assert {(r.id, r.version, r.n) for r in facts.current(spark, folder).collect()} == {(1, "x", 3), (2, "y", 6)}
    assert len(facts._log(spark, folder)[0]) == 1 and facts.refresh(changed.withColumn("version", F.lit("z")), folder, compute) == 2
    assert {r.version for r in facts.current(spark, folder).collect()} == {"z"}


def test_files_that_do_not_fit(spark):
    doc, png = bytes.fromhex("D0CF11E0A1B11AE1"), bytes.fromhex("89504E470D0A1A0A")
    rows = [(1, "EPUB", b"PK\x03\x04"), (1, "PDF", b""), (2, "PDF", b"junk %PDF-1.4"), (2, "DOC", doc), (3, "MOBI", png), (3, "TXT", b"words"), (3, "ORIGINAL_EPUB", b"x"), (4, "PDF", None)]
    got = {r.id: (r.broken, r.foreign) for r in files.unreadable_formats(spark.createDataFrame(rows, "id bigint, fmt string, content binary")).collect()}
    assert got == {1: (["PDF"], []), 2: ([], ["DOC"]), 3: (["MOBI"], [])}


def test_excerpts_and_profiles(spark):
    prose = "the book and the road that they have of his with her not but you " * 40
    rows = [(1, "PDF", "pdf text", None), (1, "EPUB", None, "damaged"), (1, "TXT", prose, None), (2, "EPUB", None, "damaged"), (3, "TXT", "short", None)]
    df = spark.createDataFrame(rows, "id bigint, fmt string, text string, error string")
    got = {r.id: (r.fmt, r.text, r.error) for r in files.excerpts(df, "start", 8).collect()}
    assert got == {1: ("TXT", "the book", None), 2: ("EPUB", None, "damaged"), 3: ("TXT", "short", None)}
    assert [(r.id, r.text_lang, r.text_chars > 1000) for r in files.text_profiles(df).collect()] == [(1, "eng", True)]


def test_archive_members_are_taken_out(spark):
    content = [(1, zipped({"a/b.txt": b"hello", "../up.txt": b"no"})), (2, b"junk")]
    got = {(r.id, r.name): (None if r.content is None else bytes(r.content), r.error) for r in files.extracted(spark.createDataFrame(content, "id bigint, content binary")).collect()}
    assert got[1, "a/b.txt"] == (b"hello", None) and got[1, "../up.txt"] == (None, "unsafe name") and got[2, None][1].startswith("not a ZIP")
    books = spark.createDataFrame([("p", ["ZIP", "EPUB"]), ("p", ["PDF"])], "lib string, formats array<string>")
    assert files.archive_books(books).first().n == 1 and [r.unpack for r in files.archive_gate(books, True).collect()] == [True, False]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Füße\nzwei".encode())
    assert [r.text for r in files.read_texts(spark, str(tmp_path)).collect()] == ["Füße\nzwei"]


def test_libraries(spark, tmp_path):
    for name in ("full", "empty", "other"):
        (tmp_path / name).mkdir()
    (tmp_path / "full" / "metadata.db").touch()
    (tmp_path / "other" / "x.txt").touch()
    assert [catalogue.is_library(spark, str(tmp_path / n)) for n in ("full", "empty", "other", "none")] == [True, True, False, False]
    full, empty = str(tmp_path / "full"), str(tmp_path / "empty")
    assert catalogue.library_problems(spark, full, empty, str(tmp_path / "other"), 500) == [f"{tmp_path / 'other'} isn't a library"]
    assert catalogue.library_problems(spark, full, empty, empty + "/", 500) == ["the trash is one of the libraries"]
    assert len(catalogue.library_problems(spark, full, empty, full, 3)) == 3
    assert catalogue.tag_text("a, b ,a", True) == "not tagged 'a' or 'b'" and catalogue.tag_text(" ") == "all records"


def test_sqlite_is_read_by_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "metadata.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE books(id INTEGER, title TEXT)")
        db.executemany("INSERT INTO books VALUES (?, ?)", [(i, f"t{i}") for i in range(250_000)])
    df = catalogue.sqlite_tables(spark, path, ["books"])["books"]
    assert df.rdd.getNumPartitions() == 3 and df.count() == df.distinct().count() == 250_000


def test_reports(spark, tmp_path):
    from colophon.plans import edit, ladder
    from colophon.plans.features import features
    from colophon.queries import catalogue as cases
    from colophon.queries import upkeep
    from colophon.sources import sinks

    folder = "/root/testdata/sf0.001"
    books = cases._books(spark, folder, cases.TWO)
    plan = ladder.plan(books, texts=cases._texts(spark, folder))
    rows = plan.join(ladder.formats_to_add(plan, books), ["lib", "id"], "left").withColumn("manual", F.lit(False)).withColumn("status", F.lit(None).cast("string"))
    report = sinks.plan_report(rows, features(books))
    assert len(report.columns) == 18 and report.count() == plan.count()
    one = report.filter("publisher = 'Osprey' and year = '1990'").first()
    assert (one.checked, one.action, one.add_formats, one.match) == ("yes", "trash", "EPUB", "#1 Tides - Tove Almqvist")
    sinks.write_csv(report.coalesce(1), f"{tmp_path}/plan")
    text = next((tmp_path / "plan").glob("part-*")).read_text()
    assert text.startswith("\ufeffsource_id,checked,manual,title")
    own = lambda df: df.filter("lib in ('p-0', 'p-1')")
    decided = spark.createDataFrame([("p-0", 1, "text", "update", ""), ("p-1", 2, None, "keep", None)], "lib string, id bigint, cover string, action string, note string")
    review = {r.book_id: r for r in sinks.review_report(own(upkeep._values(spark, folder)), own(upkeep._proposed(spark, folder)), decided).collect()}
    assert (review[1].now_year, review[1].read_year, review[1].new_year, review[1].left_out) == ("1990", "1991", "1991", "language: language not in text")
    assert len(review[1]) == 2 + 21 + 4 and review[2].new_year == "" and review[2].cover == ""
    shelf = own(upkeep._shelf(spark, folder))
    done = spark.createDataFrame([("p-0", 1, "2024-01-01T00:00:00", "set", True, "written", None, None)], "lib string, id bigint, time string, action string, ok boolean, result string, why string, match bigint")
    journal = sinks.journal_rows(done, shelf, edit.with_fields(shelf, own(upkeep._actions(spark, folder))))
    assert len(journal.columns) == 12 and journal.first().before.startswith("Salt Roads | Peter Oakes")
    for _ in range(6):
        sinks.run_log(spark, f"{tmp_path}/log", done, most_bytes=1, keep=2)
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["3", "4", "5"]


def test_settings(spark):
    from colophon.plans import selection

    assert selection.settings_changed({"a": 1, "b": None, "c": 2}, {"a": 1, "c": 3, "d": None}) == ["b", "c", "d"]


def test_closure_ends_on_a_ring(spark):
    from colophon.plans import selection

    plan = spark.createDataFrame([("p", 1, 3, "source"), ("p", 2, 1, "source"), ("p", 3, 2, "source"), ("p", 4, 9, "source")], "lib string, id bigint, match bigint, match_side string")
    assert sorted(r.id for r in selection.redecide(plan, spark.createDataFrame([("p", 1)], "lib string, id bigint")).collect()) == [1, 2, 3]


def test_sinks(spark, tmp_path):
    from colophon.sources import sinks

    df = spark.createDataFrame([(1, ["a", "b"], 'x, "y"')], "id int, names array<string>, note string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first()
    assert tuple(back) == ("1", "a & b", 'x, "y"')
    assert [sinks.save_version(df, f"{tmp_path}/saved", 2) for _ in range(4)] == [0, 1, 2, 3]
    assert sorted(p.name for p in (tmp_path / "saved").iterdir() if p.is_dir()) == ["2", "3"]
    assert sinks.read_json(spark, f"{tmp_path}/none", "a int").count() == 0
    uses = spark.createDataFrame([("/A", 1), ("/a", 2), ("/b", 2)], "path string, n int")
    assert [tuple(r) for r in sinks.known_libraries(uses).collect()] == [("/A", 3), ("/b", 2)]


def test_readings_are_joined_by_file(spark):
    from colophon.plans import answers

    df = spark.createDataFrame([(1, "/a", 10, "t1"), (2, "/b", 20, "t2")], "id int, path string, size bigint, modified string")
    keyed = df.withColumn("key", answers.file_key(F.col("path"), F.col("size"), F.col("modified"), "start"))
    known = keyed.filter("id = 1").select("key", F.lit("Osprey").alias("publisher"))
    got = {r.id: r.answer and r.answer.publisher for r in answers.with_answers(keyed, known).collect()}
    assert got == {1: "Osprey", 2: None} and [r.id for r in answers.to_ask(keyed, known).collect()] == [2]
    other = df.withColumn("modified", F.lit("later")).withColumn("key", answers.file_key(F.col("path"), F.col("size"), F.col("modified"), "start"))
    assert answers.to_ask(other, known).count() == 2


def test_judge_requests_hold_both_ends_of_the_texts(spark):
    import json

    from colophon.plans import answers

    text = "a" * 20_000 + "b" * 7_000
    row = answers.request(spark.createDataFrame([(("One",), ("Two",), text, "short")], "a struct<title:string>, b struct<title:string>, text_a string, text_b string")).first()
    body = json.loads(row.request)
    assert body["a"]["title"] == "One" and body["pages_a"] == {"start": "a" * 20_000, "end": "b" * 5_000} and body["pages_b"]["end"] == "short"


def test_series_are_not_publishers(spark):
    from colophon.plans import review

    rows = spark.createDataFrame([(1, "publisher", "Tides", None), (2, "publisher", "Osprey", None), (3, "title", "Tides", None)], "id int, field string, proposed string, doubt string")
    books = spark.createDataFrame([("TIDES",), (None,)], "series string")
    readings = spark.createDataFrame([((None,),)], "found struct<series:string>")
    assert {r.id: r.doubt for r in review.mark_series_publishers(rows, books, readings).collect()} == {1: "series as publisher", 2: None, 3: None}


def test_small_formats(spark):
    import base64

    from colophon.functions import text
    from colophon.sources import sinks
    from colophon.sources.markup import text_of

    r = spark.range(1).select(text.encoded(F.array(F.lit(1), F.lit(0xFFFFFFFF)).cast("array<bigint>")).alias("e"), text.percent(F.lit(0.999)).alias("p")).first()
    assert base64.b64decode(r.e) == b"\x00\x00\x00\x01\xff\xff\xff\xff" and r.p == "99%"
    plan = spark.createDataFrame([(7, "Tides", "move", "nothing like it")], "id bigint, title string, action string, why string")
    assert sinks.console_lines(plan).first().line == "MOVE   #7 Tides / nothing like it"
    page = '<!-- <p>no</p> --><head><title>no</title></head><BODY a=">"><script>if (a < b) "<p>"</script><p>one<br/>two &lt;3</p>x &amp; y<style>p{}</style> < z'
    assert text_of(page) == "one\ntwo <3\nx & y < z" and text_of("") == "" and text_of(None) is None
