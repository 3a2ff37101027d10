"""Readable text of web pages: the article, main or body without scripts, blocks on lines of their own, headings marked.

What an element that is left out holds is left out up to its end tag, or, where that is missing, up to the end of the block that it
stands in: an open end drops no more of the page."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are dropped, that stand on their own lines, and that have no end tag.
DROPPED = frozenset("script style noscript template".split())
BLOCKS = frozenset("p div section article main header footer nav aside form body ul ol li table tr blockquote pre h1 h2 h3 h4 h5 h6 br hr figure figcaption dl dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TYPE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])


class Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.all, self.main = "", [], []
        self.inside, self.in_title = 0, False
        self.open: list[str] = []  # blocks and dropped elements that are open

    def put(self, s: str) -> None:
        if not DROPPED.intersection(self.open):
            self.all.append(s)
            if self.inside:
                self.main.append(s)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title" and not self.title:
            self.in_title = True
        elif tag in ("article", "main"):
            self.inside += 1
        if tag in BLOCKS:
            self.put("\n" + ("#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""))
        if (tag in BLOCKS or tag in DROPPED) and tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in self.open:  # with all that is open inside it
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        if tag in BLOCKS and tag not in VOID:
            self.put("\n")
        if tag in ("article", "main"):
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        else:
            self.put(re.sub(r"\s+", " ", data))


def readable(html: str | None) -> tuple[str, str]:
    r = Reader()
    r.feed(html or "")
    r.close()
    body = "".join(r.main if "".join(r.main).strip() else r.all)
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in body.split("\n")]
    return r.title.strip(), "\n".join(x for x in lines if x and x != "-" and x.strip("# "))


@F.arrow_udf(TYPE)
def _page(html: pa.Array) -> pa.Array:
    rows = [readable(h) for h in html.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["title", "text"])


def page(html: Column) -> Column:
    """A struct of title and text."""
    return _page(html)
