"""Files as rows: signatures, EPUB parts, archive members."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colophon.functions import text
from colophon.sources.markup import text_of

#: Formats by preference for reading a text (SC12), and those that are never read for comparison (SC13).
READ_ORDER = ["EPUB", "AZW3", "MOBI", "AZW", "DOCX", "HTMLZ", "ODT", "RTF", "FB2", "TXT", "PDF"]
NEVER_COMPARED = ["ZIP", "RAR", "7Z", "CBZ", "CBR", "CB7"]


def signature(content: Column) -> Column:
    """TX15: the kind of a file by its first bytes; ``empty`` for none."""
    head = F.substring(content, 1, 1024)
    text = F.lower(F.btrim(head.cast("string")))
    starts = lambda hexed: F.hex(F.substring(head, 1, len(hexed) // 2)) == hexed
    return (
        F.when(F.octet_length(content) == 0, "empty")
        .when(starts("504B"), "zip").when(F.instr(F.hex(head), "255044462D") % 2 == 1, "pdf").when(starts("7B5C727466"), "rtf")
        .when(starts("526172211A07"), "rar").when(starts("377ABCAF271C"), "7z").when(starts("D0CF11E0A1B11AE1"), "doc")
        .when(starts("49544F4C49544C53"), "lit").when(starts("41542654464F524D"), "djvu").when(starts("FFD8FF"), "jpeg").when(starts("89504E470D0A1A0A"), "png")
        .when(F.hex(F.substring(content, 61, 8)).isin("424F4F4B4D4F4249", "5445587452454164"), "mobi")
        .when(text.startswith("<!doctype html") | text.startswith("<html"), "html").otherwise("text")
    )


def fits(fmt: Column, kind: Column) -> Column:
    """TX15, TX16: can a file of this kind be of the declared format?"""
    zipped = ("EPUB", "KEPUB", "DOCX", "ODT", "HTMLZ", "CBZ", "ZIP")
    table = {"zip": zipped, "pdf": ("PDF",), "rtf": ("RTF",), "mobi": ("MOBI", "AZW", "AZW3"), "rar": ("RAR", "CBR"), "7z": ("7Z", "CB7"), "lit": ("LIT",), "djvu": ("DJVU", "DJV"), "doc": ("DOC",)}
    wanted = F.coalesce(*(F.when(fmt.isin(*names), F.lit(k)) for k, names in table.items()))
    return (kind != "empty") & (wanted.isNull() | (wanted == kind))


def unreadable_formats(files: DataFrame) -> DataFrame:
    """TX16: (id, broken, foreign) of ``files(id, fmt, content)``: formats that are empty or not what they say, and formats that nothing here reads.

    Missing files (null content) and kept originals (ORIGINAL_*) aren't looked at.
    """
    known = F.col("fmt").isin(*READ_ORDER, *NEVER_COMPARED, "KEPUB", "LIT", "DJVU", "DJV", "HTML", "HTM", "PRC", "PDB", "LRF")
    seen = files.filter(F.col("content").isNotNull() & ~F.col("fmt").startswith("ORIGINAL_")).withColumn("good", fits(F.col("fmt"), signature(F.col("content"))))
    listed = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("fmt"))))
    out = seen.groupBy("id").agg(listed(~F.col("good")).alias("broken"), listed(F.col("good") & ~known).alias("foreign"))
    return out.filter("size(broken) + size(foreign) > 0")


def excerpts(texts: DataFrame, part: str, chars: int) -> DataFrame:
    """SC17, SC5, PF28: (id, fmt, text, error): the first or last ``chars`` characters of the best format that could be read.

    ``texts(id, fmt, text, error)`` has a row for each format; the first by preference without an error counts, and where none is, the
    error of the most preferred is given.
    """
    order = F.array(*map(F.lit, READ_ORDER))
    rank = F.coalesce(F.nullif(F.array_position(order, F.col("fmt")).cast("int"), F.lit(0)), F.lit(99))
    failed = (F.col("error").isNotNull() | F.col("text").isNull()).cast("int")
    best = texts.groupBy("id").agg(F.min_by(F.struct("fmt", "text", "error"), F.struct(failed.alias("f"), rank.alias("r"), F.col("fmt").alias("k"))).alias("b"))
    cut = text.slice_of("b.text", part, chars)
    return best.select("id", "b.fmt", F.when(F.col("b.error").isNull(), cut).alias("text"), "b.error")


#: A text of fewer letters tells nothing of its book.
MIN_TEXT = 200


def text_profiles(texts: DataFrame) -> DataFrame:
    """SC16, TX2: (id, text_lang, text_chars) of the best format with enough text; the language is read in the middle."""
    enough = texts.filter(F.col("error").isNull()).withColumn("chars", text.letters("text")).filter(F.col("chars") >= MIN_TEXT)
    order = F.array(*map(F.lit, READ_ORDER))
    rank = F.coalesce(F.nullif(F.array_position(order, F.col("fmt")).cast("int"), F.lit(0)), F.lit(99))
    best = enough.groupBy("id").agg(F.min_by(F.struct("text", "chars"), F.struct(rank.alias("r"), F.col("fmt").alias("k"))).alias("b"))
    hits = best.select("id", F.col("b.chars").cast("bigint").alias("text_chars"), text.language_hits(text.middle("b.text", text.LANGUAGE_SAMPLE)).alias("hits"))
    return hits.select("id", text.language("hits").alias("text_lang"), "text_chars")


def page_sample(html: Column | str, chars: int) -> Column:
    """SC6: ``chars`` characters around the middle of a page's markup without its tags, and the length it stands for, without a parser."""
    bare = F.btrim(F.regexp_replace(F.regexp_replace(text.col(html), r"(?is)<(head|style|script)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;", " "), r"\s+", " "))
    return F.struct(text.middle(bare, chars).alias("sample"), text.visible_chars(html).cast("bigint").alias("length"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """SC11: (path, text) of text files, one row a file; bytes that aren't UTF-8 are replaced."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))


def pick_format(formats: Column) -> Column:
    """SC12: the preferred of an array of formats."""
    order = F.array(*map(F.lit, READ_ORDER))
    rank = F.transform(formats, lambda f: F.struct(F.coalesce(F.nullif(F.array_position(order, f).cast("int"), F.lit(0)), F.lit(99)).alias("rank"), f.alias("fmt")))
    return F.get(F.sort_array(rank), F.lit(0))["fmt"]


def same_text_format(formats: Column) -> Column:
    """SC13: the same, without archives and comics."""
    never = F.array(*map(F.lit, NEVER_COMPARED))
    return pick_format(F.filter(formats, lambda f: ~F.array_contains(never, f)))


def safe_member(name: str) -> bool:
    """SC15: stays a path within the archive."""
    path = posixpath.normpath(name.replace("\\", "/"))
    return bool(name) and not path.startswith(("/", "../")) and path != ".." and not re.match(r"[A-Za-z]:", path)


MEMBERS = "id bigint, name string, size bigint, safe boolean, error string"


def archive_members(files: DataFrame) -> DataFrame:
    """SC14: a row for each member of ZIP files ``(id, content)``; a damaged or locked one gives its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, content in zip(frame.id, frame.content, strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                        locked = any(i.flag_bits & 1 for i in infos)
                        rows += [(key, None, None, None, "locked by a password")] if locked else [(key, i.filename, i.file_size, safe_member(i.filename), None) for i in infos]
                except (zipfile.BadZipFile, TypeError) as e:
                    rows.append((key, None, None, None, f"not a ZIP file: {e}"))
            yield pd.DataFrame(rows, columns=["id", "name", "size", "safe", "error"]).astype({"size": "Int64", "safe": "boolean"})

    return files.select("id", "content").mapInPandas(run, MEMBERS)


MEMBER_FILES = "id bigint, name string, content binary, error string"


def extracted(files: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """SC15: a row with the bytes of each safe member of ZIP files ``(id, content)``; unsafe names and members beyond ``most_bytes`` give an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, content in zip(frame.id, frame.content, strict=True):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    infos = [i for i in archive.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, TypeError) as e:
                    yield pd.DataFrame([(key, None, None, f"not a ZIP file: {e}")], columns=["id", "name", "content", "error"])
                    continue
                # one member at a time: an archive may hold more than fits
                for info in infos:
                    error = None if safe_member(info.filename) else "unsafe name"
                    error = error or ("too large" if info.file_size > most_bytes else None)
                    data = None
                    if error is None:
                        try:
                            data = archive.read(info)
                        except (RuntimeError, zipfile.BadZipFile) as e:
                            error = f"{type(e).__name__}: {e}"
                    yield pd.DataFrame([(key, info.filename, data, error)], columns=["id", "name", "content", "error"])

    return files.select("id", "content").mapInPandas(run, MEMBER_FILES)


def archive_gate(books: DataFrame, unpack: bool) -> DataFrame:
    """PF25, AG15: ``unpack`` for records with an archive: one answer for all; ``archive_books`` counts them first."""
    return books.withColumn("unpack", F.arrays_overlap("formats", F.array(*map(F.lit, NEVER_COMPARED))) & F.lit(unpack))


def archive_books(books: DataFrame) -> DataFrame:
    """AG15: how many records of each library hold an archive."""
    return books.groupBy("lib").agg(F.count_if(F.arrays_overlap("formats", F.array(*map(F.lit, NEVER_COMPARED)))).alias("n"))


def archive_plan(members: DataFrame) -> DataFrame:
    """PF24: per archive, the formats to take out, and a problem or doubt."""
    ext = F.upper(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin(NEVER_COMPARED), "nested").when(ext.isin(READ_ORDER) & ~((ext == "TXT") & (F.col("size") < 20_000)), "book").otherwise("other")
    stem = F.regexp_replace(F.lower(F.regexp_extract("name", r"([^/\\]*)\.[^.]*$", 1)), r"[\W_]+", " ")
    df = members.withColumn("ext", ext).withColumn("kind", kind).withColumn("stem", F.btrim(stem))
    books = F.filter(F.collect_list(F.struct("kind", "ext", "stem")), lambda x: x["kind"] == "book")
    got = df.groupBy("id").agg(books.alias("books"), F.count_if(F.col("kind") == "nested").alias("nested"), F.max("error").alias("error"), F.count_if(~F.col("safe")).alias("unsafe"))
    formats = F.sort_array(F.transform("books", lambda x: x["ext"]))
    twice = F.size(F.array_distinct(formats)) < F.size(formats)
    problem = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("unsafe") > 0, "unsafe names").when(F.col("nested") > 0, "archive within").when(twice, "two files of a format").when(F.size("books") == 0, "nothing readable")
    doubt = F.when(problem.isNull() & (F.size(F.array_distinct(F.transform("books", lambda x: x["stem"]))) > 1), "names differ")
    return got.select("id", F.array_join(formats, ",").alias("formats"), problem.alias("problem"), doubt.alias("doubt"))


def epub_parts(content: bytes) -> tuple[str | None, str | None, bytes | None]:
    """SC5, SC7, SC8: the text in spine order, the title, the cover image."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("}rootfile"))
        root, base = ElementTree.fromstring(z.read(opf)), posixpath.dirname(opf)
        tag = lambda e: e.tag.rpartition("}")[2]
        items = {e.attrib.get("id"): e.attrib for e in root.iter() if tag(e) == "item"}
        where = lambda item: posixpath.normpath(posixpath.join(base, unquote(item["href"])))
        spine = [items[e.attrib["idref"]] for e in root.iter() if tag(e) == "itemref" and e.attrib.get("idref") in items]
        body = "\n\n".join(filter(None, (text_of(z.read(where(i)).decode("utf-8", "replace")) for i in spine if where(i) in z.namelist())))
        title = next((e.text for e in root.iter() if tag(e) == "title" and e.text), None)
        named = next((e.attrib.get("content") for e in root.iter() if tag(e) == "meta" and e.attrib.get("name") == "cover"), None)
        images = [i for i in items.values() if i.get("media-type", "").startswith("image/")]
        ranked = [i for i in images if "cover-image" in i.get("properties", "").split()] + [i for i in images if i.get("id") == named] + [i for i in images if "cover" in (i.get("id", "") + i["href"]).lower()]
        cover = next((z.read(where(i)) for i in ranked if where(i) in z.namelist()), None)
    return body, title.strip() if title else None, cover


def read_epubs(files: DataFrame) -> DataFrame:
    """(id, text, title, cover, error) of EPUB files ``(id, content)``; errors are rows, not failures."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, content in zip(frame.id, frame.content, strict=True):
                try:
                    rows.append((key, *epub_parts(content), None))
                except Exception as e:  # a damaged file is data
                    rows.append((key, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "text", "title", "cover", "error"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("title", T.StringType()), T.StructField("cover", T.BinaryType()), T.StructField("error", T.StringType())])
    return files.select("id", "content").mapInPandas(run, schema)
