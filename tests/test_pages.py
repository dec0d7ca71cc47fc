"""The readable text of all pages of the smallest tables, against Python's own parser."""

import re
from html.parser import HTMLParser

from colophon.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


class Reader(HTMLParser):
    """Text outside scripts, styles and heads, with a line end at both borders of a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.silent, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style", "head")
        self.border(tag)

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style", "head") and self.silent > 0
        self.border(tag)

    def handle_startendtag(self, tag, attrs):
        self.border(tag)

    def border(self, tag):
        if tag in ("p", "div", "br", "li", "tr", "section", "title") or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def plain(html):
    if html is None:
        return None
    reader = Reader()
    reader.feed(html)
    reader.close()
    text = re.sub(r"[ \t\f\v]+", " ", "".join(reader.out).replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n\s*\n+", "\n\n", text).strip()


def test_page_text_equals_the_parser_on_all_pages(spark):
    got = {r.page_id: r.text for r in QUERIES["page_text"](spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").collect()
    assert len(got) == len(pages) and len({t for t in got.values()}) > 40
    wrong = [p.page_id for p in pages if got[p.page_id] != plain(p.html)]
    assert not wrong
