"""Scalar functions over literal cases, held against stated results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import ids, people, text, titles
from colophon.queries import query, read, spread, stated, values_sql

TITLES = [
    ("The Lantern Keeper", "lantern keeper"), ("le PHARE du Nord", "le phare du nord"), ("Salt Roads (3rd Edition)", "salt roads"), ("Harbour Songs (Bluebird Classics)", "harbour songs"),
    ("Winter Orchard (Franc", "winter orchard"), ("Tides (Book 3)", "tides book 3"), ("Tides (Book 4)", "tides book 4"), ("Tides (IV)", "tides iv"), ("Tides (#7)", "tides 7"),
    ("Canti (Raccolta)", "canti raccolta"), ("Crème & Sons", "creme and sons"), ("x_y z", "x_y z"), ("Owl Street ( (Harbour 118))", "owl street"), ("An", "an"),
    ("Copper Bridges (Harbour 0301)", "copper bridges"), ("Nora's lamp", "nora s lamp"), ("(Bluebird)", "bluebird"), ("An Inn (Old) Road", "inn old road"), ("Groß", "gross"), ("", ""),
]
EDITIONS = [("Third Edition", 3), ("5a edizione", 5), ("7. Auflage", 7), ("Edition 6", 6), ("Tenth", 10), ("Illustrated", None), ("8th ed.", 8), ("terza edizione", 3), ("Salt Roads", None), ("edizione 0", None)]
FILE_NAMES = [("Salt Roads.mobi", True), ("the_salt_roads", True), ("Harbour 0077 - Lindqvist", True), ("page0034", True), ("C77QRS4410", True), ("1811", False), ("Area 51", False), ("2B2", False), ("10.000 lamps", False), ("Diaries [1911_1919]", False), ("An Old Road.html", True), ("Tides", False)]
VOLUMES = [("the iron coast 1", "the iron coast 2", True), ("the iron coast 3", "the iron coast", True), ("tides vol 4", "tides vol 5", True), ("tides iii", "tides", True), ("tides parte2", "tides 2", False), ("letters 1903", "letters 1911", False), ("tides", "tides", False), ("tides return", "tides", False), ("tides vol 3", "tides iii", False)]
CONTAINED = [("4 silver harbour", "silver harbour", True), ("tides return", "tides", False), ("open fields primavera 1998", "open fields", True), ("harbour 0202", "oh", False), ("winter 1990 z", "winter 1990", False), ("silver harbour", "silver harbour", True)]
RELATED = [("Le Lanterne del Porto", "Lanterne Sul Porto", True), ("La storia della verità", "La Storiaa Della Verita - Volume 3", True), ("Sailing", "Sailing the Gulf", True), ("Tides", "Orchards", False), ("Oak", "Oak", False)]
PUBLISHERS = [("Lindqvist", "Karl Lindqvist Verlag", True), ("K. Lindqvist", "Karl Lindqvist Verlag", True), ("BlueBird Classics S.p.A.", "Blue Bird classics", True), ("Osprey", "Kestrel", False), ("K. Lindqvist", "Osprey", False), ("M. Lindqvist", "Karl Lindqvist", False), ("Osprey Books", "Osprey", True), ("D'Arcy Media, Ltd.", "D'Arcy", True), ("Press", "Press", True)]
ISBNS = [("0-8044-2957-X", "9780804429573"), ("978 0 8044 2957 3", "9780804429573"), ("0804429571", None), ("1111111111", None), ("9770317847001", None), ("1-84356-028-3", "9781843560289"), ("none", None)]
ASINS = [(" b07qrstuv9 ", "B07QRSTUV9"), ("1843560283", "1843560283"), ("K9", None), ("BBBBBBBBBB", None), ("9f0c-77aa", None)]
NAMES = [
    # a, b, nearly equal, initials, surname
    ("Margarret Oakes", "Oakes, Margaret", True, False, False), ("Peter Oakes", "Simon Oakes", False, False, False), ("T. Lindqvist", "Lindqvist, Tove", False, True, True),
    ("K.P.A. Moreau", "Karl Peter Anton Moreau", False, True, True), ("Sandoval", "J. Rui Sándoval", False, False, True), ("Delacroix", "Delacroix, Anne-Lise", False, False, True),
    ("Eva Holm", "Evan Holm", False, False, False), ("Lee", "Harriet Ann Lee", False, False, False), ("Peter Oakes", "Peter Oakes", False, False, False),
    ("A. A. Brandt", "Anna Brandt Adler", False, True, True), ("A. B. Brandt", "Anna Brandt Adler", False, False, True), ("A. Anna Brandt", "Anna A. Brandt", False, False, False), ("Anna B. Brandt", "A. Bertil Brandt", False, True, False),
]
AUTHORS = [("Moreau, K.P.A.", "a k moreau p", "moreau"), ("K. P. A. Moreau", "a k moreau p", "moreau"), ("Harriet A. Oakes", "a harriet oakes", "harriet oakes"), ("AA. VV.", "various authors", "various authors"), ("Vari", "various authors", "various authors"), ("Various", "various authors", "various authors"), ("Q", "q", "q")]
PEOPLE = [("J. Rui Sándoval", True), ("Delacroix, Anne-Lise", True), ("T. W. Oakes", True), ("Lindqvist", True), ("Sailing the Gulf", False), ("Part 07", False), ("Pedro de Almeida", True), ("Almeida, Pedro de", True), ("The Inn at the End of a Road", False), ("Scan two", False)]
LANGUAGES = [("it", "ita", "Italian"), ("English", "eng", "English"), ("ger", "deu", "German"), ("lat", "lat", "Latin"), ("ru", "rus", "rus"), ("klingon", None, None), ("", None, None)]
DURATIONS = [(0.4, "under 1 min"), (59.4, "under 1 min"), (90.0, "2 min"), (3600.0, "1 h 00 min"), (5400.0, "1 h 30 min"), (90000.0, "1 d 1 h")]
CORES = [("Harbour Tales 017 - Tove Lindqvist - Glass Island", ["Tove Lindqvist"], "glass island"), ("Harbour 0077 - Lindqvist", ["Lindqvist"], ""), ("Salt Roads.mobi", ["Oakes"], "salt roads"), ("page0034", ["X"], ""), ("the_salt_roads", ["Oakes"], "salt roads"), ("lanterns in the garden3", [], "lanterns in the garden"), ("Oakes Peter - (tales) - QX77ZZ81 Copper", ["Peter Oakes"], "copper")]
VARIANTS = [("(Harbour - 0415- Glass Island - Tove Lindqvist)", ["Tove Lindqvist"], "glass island|harbour 0415 glass island tove lindqvist"), ("Glass Island", ["Tove Lindqvist"], "glass island"), ("Oakes, Peter - Salt Roads - Copper", ["Peter Oakes"], "salt roads copper|oakes peter salt roads copper|salt roads|copper"), ("Anne-Lise", [], "anne lise")]


def _one(spark: SparkSession, cases: list, function) -> DataFrame:
    df = spark.createDataFrame([(c[0],) for c in cases], "input string")
    return df.select("input", function(F.col("input")).alias("output"))


def _two(spark: SparkSession, cases: list, function) -> DataFrame:
    return spark.createDataFrame([c[:2] for c in cases], "a string, b string").select("a", "b", function(F.col("a"), F.col("b")).alias("output"))


@stated(values_sql(TITLES, "input, output"))
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5-ST8."""
    return _one(spark, TITLES, titles.title_key)


@stated(values_sql(EDITIONS, "input, output"))
def edition_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4."""
    return _one(spark, EDITIONS, titles.edition_number)


@stated(values_sql(FILE_NAMES, "input, output"))
def file_name_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10."""
    return _one(spark, FILE_NAMES, titles.looks_like_file_name)


@stated(values_sql([(t, c) for t, _, c in CORES], "input, output"))
def file_name_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11."""
    df = spark.createDataFrame([c[:2] for c in CORES], "input string, authors array<string>")
    return df.select("input", titles.file_name_core("input", "authors").alias("output"))


@stated(values_sql([(t, v) for t, _, v in VARIANTS], "input, output"))
def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12."""
    df = spark.createDataFrame([c[:2] for c in VARIANTS], "input string, authors array<string>")
    return df.select("input", F.array_join(titles.title_variants("input", "authors"), "|").alias("output"))


@stated(values_sql(VOLUMES, "a, b, output"))
def volume_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13, ST14."""
    return _two(spark, VOLUMES, titles.volumes_differ)


@stated(values_sql(CONTAINED, "a, b, output"))
def title_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST15, ST16."""
    return _two(spark, CONTAINED, lambda a, b: titles.contains_title(a, b, titles.noise()))


@stated(values_sql(RELATED, "a, b, output"))
def related_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST17."""
    return _two(spark, RELATED, lambda a, b: titles.related_titles(a, b, titles.noise()))


@stated(values_sql(PUBLISHERS, "a, b, output"))
def same_publisher_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM9, NM10."""
    return _two(spark, PUBLISHERS, people.same_publisher)


@stated(values_sql(ISBNS, "input, output"))
def isbn_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID1."""
    return _one(spark, ISBNS, ids.normalize_isbn)


@stated(values_sql(ASINS, "input, output"))
def asin_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID2."""
    return _one(spark, ASINS, ids.normalize_asin)


@query("""SELECT p_partkey, '978' || b || ((10 - (38 + list_sum(list_transform(range(1, 10), lambda i: substr(b, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))) % 10) % 10) isbn
    FROM (SELECT p_partkey, '1' || lpad(p_partkey::VARCHAR, 8, '0') b FROM part)""")
def isbn_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID1 over made-up numbers of all parts: the ten-digit form is made, checked and widened."""
    body = F.concat(F.lit("1"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    df = spread(spark, sf_dir, "part").select("p_partkey", body.alias("b"))
    total = sum(((11 - i) * F.substring("b", i, 1).cast("int") for i in range(1, 10)), F.lit(0))
    last = (F.lit(11) - total % 11) % 11
    ten = F.concat("b", F.when(last == 10, "X").otherwise(last.cast("string")))
    return df.select("p_partkey", ids.normalize_isbn(ten).alias("isbn"))


@query("""SELECT p_partkey, '978' || b || c AS found FROM (SELECT *, ((10 - (38 + list_sum(list_transform(range(1, 10), lambda i: substr(b, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))) % 10) % 10) AS c
    FROM (SELECT p_partkey, '1' || lpad(p_partkey::VARCHAR, 8, '0') b FROM part))""")
def isbn_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX14: each part's own number in a text, printed in ten digits and again in thirteen with blanks, beside numbers that aren't one."""
    df = spread(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("1"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("b"))
    last = (F.lit(11) - sum(((11 - i) * F.substring("b", i, 1).cast("int") for i in range(1, 10)), F.lit(0)) % 11) % 11
    check = (F.lit(10) - (F.lit(38) + sum(((3 if i % 2 else 1) * F.substring("b", i, 1).cast("int") for i in range(1, 10)), F.lit(0))) % 10) % 10
    ten = F.concat(F.substring("b", 1, 1), F.lit("-"), F.substring("b", 2, 8), F.lit("-"), F.when(last == 10, "X").otherwise(last.cast("string")))
    thirteen = F.concat(F.lit("978 "), "b", F.lit(" "), check.cast("string"))
    page = F.concat(F.lit("isbn "), ten, F.lit(": "), "p_name", F.lit(", again "), thirteen, F.lit(" and 1234567890 or 978"), "b", ((check + 1) % 10).cast("string"))
    return df.select("p_partkey", F.array_join(ids.isbns_in(page), ",").alias("found"))


@stated(values_sql(NAMES, "a, b, near, initials, surname"))
def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM4-NM7."""
    df = spark.createDataFrame([c[:2] for c in NAMES], "a string, b string")
    a, b = F.col("a"), F.col("b")
    return df.select("a", "b", people.names_nearly_equal(a, b).alias("near"), people.initials_match(a, b).alias("initials"), people.surname_match(a, b).alias("surname"))


@stated(values_sql(AUTHORS, "name, key, alike"))
def author_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM1, NM3."""
    df = spark.createDataFrame([c[:1] for c in AUTHORS], "name string")
    return df.select("name", F.array_join(people.author_key("name"), " ").alias("key"), F.array_join(people.similar_author_key("name"), " ").alias("alike"))


@stated(values_sql(PEOPLE, "input, output"))
def looks_like_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM8."""
    return _one(spark, PEOPLE, people.looks_like_name)


@stated(values_sql(LANGUAGES, "input, code, name"))
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID3, ID4."""
    df = spark.createDataFrame([c[:1] for c in LANGUAGES], "input string").withColumn("code", ids.language_code("input"))
    return df.withColumn("name", ids.language_name("code"))


@stated(values_sql(DURATIONS, "input, output", "input::DOUBLE AS input, output"))
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID8."""
    return spark.createDataFrame([c[:1] for c in DURATIONS], "input double").select("input", text.duration("input").alias("output"))


@query("""SELECT array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(strip_accents(replace(c_name, '.', ' '))), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')), ' ') k, count(*) n, min(c_custkey) AS first FROM customer GROUP BY k""".replace("\\\\", "\\"))
def author_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM1, AG6 over customer names."""
    return read(spark, sf_dir, "customer").groupBy(F.array_join(people.author_key("c_name"), " ").alias("k")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(strip_accents(p_name)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) k FROM part""".replace("\\\\", "\\"))
def series_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9 over part names."""
    return read(spark, sf_dir, "part").select("p_partkey", titles.series_key("p_name").alias("k"))


@query("""SELECT k AS word FROM (SELECT unnest(string_split(lower(p_name), ' ')) k, n FROM (SELECT p_name, count(*) n FROM part GROUP BY p_name HAVING count(*) >= 20)) GROUP BY k""")
def collection_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5 over part names."""
    from colophon.operators.groups import collection_words as words

    return words(read(spark, sf_dir, "part").select(titles.series_key("p_name").alias("series_key")))
