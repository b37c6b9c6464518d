"""Parsed documents: elements of a parser's response, HTML tables as markdown, full texts."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Media types by file name extension; documents above this size are parsed asynchronously.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".hwp": "application/x-hwp",
}
ASYNC_BYTES = 20 * 1024 * 1024


class _Table(HTMLParser):
    """Collects the rows of the first table; nested tables belong to their cell."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth, self.done, self.cell = 0, False, None

    def handle_starttag(self, tag, attrs) -> None:
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self._close()
            self.rows.append([])
        elif self.depth and tag in ("td", "th"):
            self._close()
            self.cell = []

    def _close(self) -> None:
        if self.cell is not None:
            text = "".join(x.strip() for x in self.cell)
            (self.rows or self.rows.append([]) or self.rows)[-1].append(" ".join(text.split("\n")).strip())
            self.cell = None

    def handle_endtag(self, tag) -> None:
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.depth:
            self._close()
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data) -> None:
        if self.cell is not None:
            self.cell.append(data)


def table_markdown(html: str | None) -> str:
    """The first table of an HTML text as markdown: cells trimmed, empty rows dropped, a separator after the first row. Without a table, empty."""
    if not html:
        return ""
    p = _Table()
    p.feed(html)
    p.close()
    p._close()
    rows = ["| " + " | ".join(r) + " |" for r in p.rows if any(r)]
    if not rows:
        return ""
    return "\n".join([rows[0], "|" + "---|" * (rows[0].count("|") - 1), *rows[1:]])


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data) -> None:
        if data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> str:
    """The text of an HTML fragment, every piece trimmed."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return "".join(p.parts)


@F.pandas_udf(StringType())
def table_markdown_udf(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in s:
        yield x.map(table_markdown)


@F.pandas_udf(StringType())
def html_text_udf(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in s:
        yield x.map(html_text)


def element_type(category: Column) -> Column:
    """heading for any category with that word; table, figure and list as they are; all else text."""
    c = F.lower(F.coalesce(category, F.lit("")))
    return F.when(c.contains("heading"), "heading").when(c.isin("table", "figure", "list"), c).otherwise("text")


def elements(raw: DataFrame) -> DataFrame:
    """(source_file, element_id, page, type, content) of a parser's elements (source_file, id, page, category, text, html).

    Figures and empty elements are left out. Tables come from their HTML, else from their text; others from the text, else from the HTML.
    """
    t = raw.withColumn("type", element_type(F.col("category"))).where("type <> 'figure'")
    plain = F.trim(F.coalesce("text", F.lit("")))
    body = F.when(plain != "", plain).otherwise(html_text_udf("html"))
    content = F.when((F.col("type") == "table") & (F.coalesce("html", F.lit("")) != ""), table_markdown_udf("html")).otherwise(body)
    t = t.withColumn("content", content).where(F.trim("content") != "")
    return t.select("source_file", F.col("id").alias("element_id"), F.coalesce("page", F.lit(0)).alias("page"), "type", "content")


def merge_batches(*parts: DataFrame) -> DataFrame:
    """The raw elements of an asynchronous job's batches in order of page and id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("source_file", "page", "id")


def full_text(els: DataFrame) -> DataFrame:
    """(source_file, full_text, elements): non-blank contents in order, a blank line between."""
    e = els.where(F.trim("content") != "")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "element_id", "content"))), lambda x: x["content"]), "\n\n")
    return e.groupBy("source_file").agg(body.alias("full_text"), F.count("*").alias("elements"))


def of_type(els: DataFrame, *types: str) -> DataFrame:
    return els.where(F.col("type").isin(list(types)))


def parser_choice(length: Column) -> Column:
    return F.when(length > ASYNC_BYTES, "async").otherwise("sync")


def media_type(path: Column) -> Column:
    """By extension, any case; octet-stream for others."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext), F.lit("application/octet-stream"))
