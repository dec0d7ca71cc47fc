"""Text queries over documents, benchmark and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colophon.functions import text
from colophon.functions import words as fixed
from colophon.operators import groups, text_share
from colophon.operators.tables import written
from colophon.queries import query, read

_KEY = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(lower(strip_accents({x})), 'ß', 'ss'), 'ς', 'σ'), '&', ' and '), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"""
_LETTERS = r"length(regexp_replace(text, '\s', '', 'g'))"
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\r', chr(10), 'g'), '[ \t\x0B\f]+', ' ', 'g'), '\n\s*\n+', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')"""
_PLAIN = r"""regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '([\p{L}\p{N}_])-[ \t]*\n\s*([\p{L}\p{N}_])', '\1\2', 'g')), '([a-z]?)[aeiou][''’‘`´ʼ′]([\s.,;:!?»"”)]|$)', '\1\2', 'g'), '[''’‘`´ʼ′]', '', 'g'), '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{M}]', '', 'g'), '[^\x00-\x7F]', ' ', 'g'), '[a-z0-9]+')"""
_STOP = ", ".join(f"('{lang}', '{w}')" for lang, ws in fixed.LANGUAGE_WORDS.items() for w in ws.split())
_HITS = rf"""stop(lang, w) AS (VALUES {_STOP}),
    toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) w FROM documents),
    hits AS (SELECT doc_id, stop.lang, count(*) n FROM toks JOIN stop USING (w) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang DESC) r, lead(n, 1, 0) OVER (PARTITION BY doc_id ORDER BY n DESC, lang DESC) next FROM hits),
    told AS (SELECT doc_id, lang AS told FROM ranked WHERE r = 1 AND n >= 20 AND n >= 3 * next)"""


def _prints(table: str, key: str, least: int) -> str:
    return rf"""(SELECT id, n, h FROM (
        SELECT id, hs, len(hs) n FROM (
            SELECT id, list_distinct(list_filter(list_transform(range(1, len(w) - 3), lambda i: ('0x' || substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 8))::BIGINT), lambda h: h % 16 = 0)) hs
            FROM (SELECT {key} id, {_PLAIN} w FROM {table}) WHERE len(w) >= {least}))
        , unnest(hs) u(h) WHERE n > 0)"""


@query(rf"""SELECT doc_id, CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ' ')) END n_tokens, CASE WHEN k = '' THEN 0 ELSE len(list_distinct(string_split(k, ' '))) END n_distinct, md5(k) key_md5
    FROM (SELECT doc_id, {_KEY.format(x="text")} k FROM documents)""")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2 over whole documents."""
    keyed = read(spark, sf_dir, "documents").select("doc_id", text.key("text").alias("k"))
    tokens = text.split_key(F.col("k"))
    return keyed.select("doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("bigint").alias("n_distinct"), F.md5(F.col("k").cast("binary")).alias("key_md5"))


@query(rf"""SELECT doc_id, length(c) clean_len, md5(c) clean_md5, length(regexp_replace(text, '\s', '', 'g')) letters FROM (SELECT doc_id, text, {_CLEAN} c FROM documents)""")
def doc_clean_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX1, TX2."""
    df = read(spark, sf_dir, "documents").withColumn("c", text.clean("text"))
    return df.select("doc_id", F.char_length("c").cast("bigint").alias("clean_len"), F.md5(F.col("c").cast("binary")).alias("clean_md5"), text.letters("text").cast("bigint").alias("letters"))


@query("""SELECT doc_id, substr(text, 1, 40) head, right(text, 40) tail, substr(text, greatest(0, (length(text) - 40) // 2) + 1, 40) middle FROM documents""")
def doc_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17, TX2."""
    return read(spark, sf_dir, "documents").select("doc_id", text.slice_of("text", "start", 40).alias("head"), text.slice_of("text", "end", 40).alias("tail"), text.middle("text", 40).alias("middle"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = read(spark, sf_dir, "documents").select("doc_id", "lang", text.language_hits("text").alias("hits"))
    return hits.select("doc_id", "lang", text.language("hits").alias("told"))


@query(f"WITH {_HITS} SELECT doc_id, told FROM documents LEFT JOIN told USING (doc_id)")
def doc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX5, WN4, AG12."""
    return _told(spark, sf_dir).select("doc_id", "told")


@query(f"WITH {_HITS} SELECT lang, told, count(*) n FROM documents LEFT JOIN told USING (doc_id) GROUP BY ALL")
def doc_language_vs_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX5 against the language column."""
    return _told(spark, sf_dir).groupBy("lang", "told").agg(F.count("*").alias("n"))


@query(rf"""WITH {_HITS.replace("documents", "(SELECT doc_id, substr(text, greatest(0, (length(text) - 20000) // 2) + 1, 20000) text FROM documents)")} SELECT doc_id, told lang, {_LETTERS} chars FROM documents LEFT JOIN told USING (doc_id) WHERE {_LETTERS} >= 200""")
def doc_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16: language and length of each text that has enough of it."""
    from colophon.sources.files import text_profiles

    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("TXT").alias("fmt"), "text", F.lit(None).cast("string").alias("error"))
    return text_profiles(texts).select(F.col("id").alias("doc_id"), F.col("text_lang").alias("lang"), F.col("text_chars").alias("chars"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"SELECT id doc_id, any_value(n) n_kept, sum(h)::BIGINT sum_kept FROM {_prints('documents', 'doc_id', 500)} GROUP BY id")
def doc_fingerprint_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX6, TX7."""
    p = text_share.prints(_docs(spark, sf_dir), need_language=False)
    return p.select(F.col("id").alias("doc_id"), F.size("print").cast("bigint").alias("n_kept"), F.aggregate("print", F.lit(0).cast("bigint"), lambda s, h: s + h).alias("sum_kept"))


_PAIRS = f"""WITH p AS MATERIALIZED {_prints("documents", "doc_id", 50)},
    pairs AS (SELECT a.id a, b.id b, count(*) common, least(count(*) / any_value(a.n), count(*) / any_value(b.n)) share FROM p a JOIN p b ON a.h = b.h AND a.id < b.id GROUP BY a.id, b.id)"""


def _long_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(text_share.prints(_docs(spark, sf_dir), 50, need_language=False), "prints")


def _share_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_share.share_pairs(_long_prints(spark, sf_dir))


@query(f"{_PAIRS} SELECT a, b, common, round(share, 6) share FROM pairs")
def text_share_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX8 for all pairs that share anything."""
    return _share_pairs(spark, sf_dir).select("a", "b", "common", F.round("share", 6).alias("share"))


@query(f"{_PAIRS} SELECT b id, min(a) match FROM pairs WHERE share >= 0.95 GROUP BY b")
def same_text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX9, WN6."""
    return text_share.same_text(_long_prints(spark, sf_dir))


@query(f"{_PAIRS} SELECT a, b, length(x.text) la, length(y.text) lb, greatest(length(x.text), length(y.text)) >= 3 * least(length(x.text), length(y.text)) longer FROM pairs JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE common >= 10")
def length_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX10 on pairs that share at least ten runs."""
    n = _docs(spark, sf_dir).select("id", F.char_length("text").cast("bigint").alias("n"))
    pairs = text_share.pairs_sharing(_long_prints(spark, sf_dir), 10).join(n.toDF("a", "la"), "a").join(n.toDF("b", "lb"), "b")
    return pairs.select("a", "b", "la", "lb", (F.greatest("la", "lb") >= F.least("la", "lb") * 3).alias("longer"))


@query(f"""WITH s AS {_prints("benchmark", "item_id", 5)}, d AS MATERIALIZED {_prints("documents", "doc_id", 5)}
    SELECT s.id item_id, d.id doc_id, round(count(*) / any_value(s.n), 6) contained FROM s JOIN d USING (h) GROUP BY s.id, d.id""")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX8, one-sided: how much of each benchmark item is in each document."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    pairs = text_share.containment(text_share.prints(items, 5, False), text_share.prints(_docs(spark, sf_dir), 5, False))
    return pairs.select(F.col("small").alias("item_id"), F.col("large").alias("doc_id"), F.round("contained", 6).alias("contained"))


@query("""SELECT sha256(text) digest, octet_length(encode(text)) size, count(*) n, min(doc_id) first FROM documents GROUP BY ALL HAVING count(*) > 1""")
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4, IM1, TX17: a semi-join on size first, so that only colliding sizes are hashed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").cast("bigint").alias("size"))
    met = docs.groupBy("size").count().filter("count > 1").select("size")
    return docs.join(met, "size", "left_semi").groupBy(F.sha2("text", 256).alias("digest"), "size").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("""SELECT doc_id, row_number() OVER w AS rank, first_value(doc_id) OVER w AS kept FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, n_chars DESC, doc_id)""")
def keep_best_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN1, WN2: the best copy of each text first, with the language as the stand-in for the format."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"), "lang", "n_chars")
    order = [F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2), F.desc("n_chars"), F.col("id")]
    return groups.best_copy(docs, ["digest"], order).select(F.col("id").alias("doc_id"), "rank", "kept")


@query("""SELECT line, count(DISTINCT doc_id) titles, count(DISTINCT source) authors, count(*) AS n FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) line FROM documents) WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT source) >= 3""")
def placeholder_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1-AG4 over lines: what stands in three documents of three sources belongs to none of them."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.split("text", "\n", -1)).alias("line")).filter("line <> ''")
    return groups.placeholders(lines, "line", title="doc_id", author="source").withColumnRenamed("rows", "n")


@query("""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) r FROM documents) WHERE r <= 3""")
def retention_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5, SK4: the first three of each source."""
    return groups.newest(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).drop("rank")


@query(r"""SELECT page_id, octet_length(encode(regexp_replace(html, '(?is)<head\b.*?</head\s*>|<style\b.*?</style\s*>|<script\b.*?</script\s*>|<[^>]*>|&[#0-9A-Za-z_]+;|\s+', '', 'g'))) visible FROM pages""")
def page_visible_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX4, SC6."""
    return read(spark, sf_dir, "pages").select("page_id", text.visible_chars("html").cast("bigint").alias("visible"))


@query(r"""SELECT page_id, substr(b, greatest(0, (length(b) - 60) // 2) + 1, 60) sample, octet_length(encode(regexp_replace(html, '(?is)<head\b.*?</head\s*>|<style\b.*?</style\s*>|<script\b.*?</script\s*>|<[^>]*>|&[#0-9A-Za-z_]+;|\s+', '', 'g'))) AS length
    FROM (SELECT *, trim(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>|<style\b.*?</style\s*>|<script\b.*?</script\s*>|<[^>]*>|&[#0-9A-Za-z_]+;', ' ', 'g'), '\s+', ' ', 'g')) b FROM pages)""")
def page_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC6: the middle of each page and how long it is."""
    from colophon.sources.files import page_sample

    return read(spark, sf_dir, "pages").select("page_id", page_sample("html", 60).alias("s")).select("page_id", "s.*")


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') title, nullif(regexp_extract(html, '(?i)<html[^>]*\blang="([a-zA-Z-]+)"', 1), '') lang FROM pages""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7, SC20: the title and language that a page states."""
    pages = read(spark, sf_dir, "pages")
    found = lambda pattern: F.nullif(F.btrim(F.regexp_extract("html", pattern, 1)), F.lit(""))
    return pages.select("page_id", found(r"(?is)<title[^>]*>(.*?)</title>").alias("title"), found(r'(?i)<html[^>]*\blang="([a-zA-Z-]+)"').alias("lang"))


@query()
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX3: readable text of a page, by an HTML parser in Arrow batches."""
    from colophon.sources.markup import html_text

    return read(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


@query(r"""SELECT doc_id, CASE WHEN starts_with(text, 'PK') THEN 'zip' WHEN text = '' THEN 'empty' WHEN contains(substr(text, 1, 1000), '%PDF-') THEN 'pdf' WHEN starts_with(text, '{\rtf') THEN 'rtf' WHEN starts_with(lower(trim(text)), '<!doctype html') OR starts_with(lower(trim(text)), '<html') THEN 'html' ELSE 'text' END kind FROM documents""")
def doc_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TX15: what a file's first bytes say it is."""
    from colophon.sources.files import signature

    return read(spark, sf_dir, "documents").select("doc_id", signature(F.col("text").cast("binary")).alias("kind"))


@query("""SELECT source, count(*) n, sum(n_chars)::BIGINT chars FROM documents GROUP BY source""")
def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, SL9: size of each library (the order-free hash is tested apart)."""
    from colophon.plans.selection import library_state

    docs = read(spark, sf_dir, "documents")
    states = library_state(docs.select(F.col("source").alias("lib"), F.col("doc_id").alias("id"), F.col("n_chars").alias("version")))
    return states.join(docs.groupBy(F.col("source").alias("lib")).agg(F.sum("n_chars").alias("chars")), "lib").select(F.col("lib").alias("source"), "n", "chars")


@query("""SELECT doc_id FROM documents WHERE NOT (doc_id % 3 = 0 AND n_chars % 2 = 0)""")
def fact_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17: records whose kept fact isn't of their present version.

    Facts exist for every third record; half of them are of an older version.
    """
    from colophon.plans import selection

    books = read(spark, sf_dir, "documents").select(F.lit("a").alias("lib"), F.col("doc_id").alias("id"), F.col("n_chars").alias("version"))
    facts = books.filter("id % 3 = 0").withColumn("version", F.col("version") - F.col("version") % 2)
    return selection.fact_delta(books, facts).select(F.col("id").alias("doc_id"))


@query("""SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) running FROM documents""")
def running_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN7's cumulative part, over a library in record order."""
    return read(spark, sf_dir, "documents").select("source", "doc_id", F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id")).alias("running"))
