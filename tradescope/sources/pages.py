"""Links, titles, texts and tables of stored web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a link's text, and links of a page.
LINK_TEXT, LINKS = 100, 100


def host(url: Column) -> Column:
    """The host of a URL in small letters; empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def absolute(base: Column, href: Column) -> Column:
    """A link as a whole URL: as it is, by the base's scheme, host or folder."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"(://[^/]*|/)[^/]*$", "$1")
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme,
        href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, href))


def strip_tags(html: Column) -> Column:
    """Text between tags, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def links(pages: DataFrame, most: int = LINKS) -> DataFrame:
    """Links of pages (page_id, url, html) to their own host: page_id, url, text, position from 1.

    Links are made absolute; a page gives its first ``most`` (the feature's own limit), each URL
    once by its first occurrence, with at most LINK_TEXT characters of text.
    """
    found = F.regexp_extract_all("html", F.lit(r'(?s)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>'), F.lit(0))
    anchors = pages.select("page_id", F.col("url").alias("base"), F.posexplode(found).alias("at", "a"))
    whole = absolute(F.col("base"), F.regexp_extract("a", r'href="([^"]*)"', 1))
    text = F.substring(strip_tags(F.col("a")), 1, LINK_TEXT)
    own = anchors.select("page_id", "at", whole.alias("url"), text.alias("text"), host(F.col("base")).alias("host")).filter(host(F.col("url")) == F.col("host"))
    first = own.groupBy("page_id", "url").agg(F.min(F.struct("at", "text")).alias("f")).select("page_id", "url", "f.at", "f.text")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("at"))
    return first.withColumn("position", rank).filter(F.col("position") <= most).select("page_id", "url", "text", "position")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, title, the joined text of paragraphs, their number and the page's size in bytes."""
    paragraphs = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<script.*?</script>", ""), F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|$)"), F.lit(1))
    texts = F.filter(F.transform(paragraphs, strip_tags), lambda p: p != "")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", "url", title.alias("title"), F.array_join(texts, " ").alias("text"),
        F.size(texts).cast("long").alias("paragraphs"), F.octet_length("html").cast("long").alias("bytes"))


class _Tables(HTMLParser):
    """Rows of cells of each table; a table inside a cell counts as a table of its own."""

    def __init__(self) -> None:
        super().__init__()
        self.done: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.cell = False
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.open[-1][-1].append("")
            self.cell = True

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.done.append([r for r in self.open.pop() if r])
        if tag in ("td", "th", "table"):
            self.cell = False

    def handle_data(self, data):
        if self.cell and self.open and self.open[-1] and self.open[-1][-1]:
            self.open[-1][-1][-1] += data


def tables(pages: DataFrame) -> DataFrame:
    """Tables of two rows or more of pages (page_id, html): page_id, table_index, header, rows, n_rows, n_columns.

    HTML is no regular language, so pages with a ``<table`` go through the standard parser, a
    batch at a time; pages without one never leave the JVM.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                parser = _Tables()
                parser.feed(html)
                kept = [[[" ".join(c.split()) for c in r] for r in t] for t in parser.done if len(t) >= 2]
                out += [(page_id, i, t[0], t[1:], len(t) - 1, max(map(len, t))) for i, t in enumerate(kept)]
            yield pd.DataFrame(out, columns=["page_id", "table_index", "header", "rows", "n_rows", "n_columns"])

    shape = "page_id long, table_index int, header array<string>, rows array<array<string>>, n_rows int, n_columns int"
    return pages.filter(F.lower("html").contains("<table")).select("page_id", "html").mapInPandas(run, shape)


#: Standard columns by the words that name them in a header (fixed values).
HEADERS = {"hs_code": ("hs", "code"), "company_name": ("company", "firm", "supplier"), "amount": ("amount", "value",
    "sum"), "qty": ("qty", "quantity"), "country_code": ("country",)}


def table_records(found: DataFrame, kind: str = "web") -> DataFrame:
    """Extracted tables as records of standard columns: pk, the HEADERS, op_hash; equal records once.

    A column of a table is the first whose header holds one of the words of a standard column.
    """
    place = lambda words: F.array_position(F.transform("header", lambda h: F.lower(h).rlike("|".join(words))), F.lit(True))
    rows = found.select("page_id", "table_index", F.posexplode("rows").alias("row", "cells"), *[place(w).alias(f"at_{c}") for c, w in HEADERS.items()])
    cell = lambda c: F.when(F.col(f"at_{c}") > 0, F.get("cells", (F.col(f"at_{c}") - 1).cast("int")))
    rows = rows.select(F.concat_ws("_", F.lit(kind), "page_id", "table_index", "row").alias("pk"), *[F.nullif(F.trim(cell(c)),
        F.lit("")).alias(c) for c in HEADERS])
    hashed = rows.withColumn("op_hash", F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in HEADERS]), 256))
    return hashed.groupBy("op_hash").agg(F.min(F.struct("pk", *HEADERS)).alias("r")).select("r.*", "op_hash")
