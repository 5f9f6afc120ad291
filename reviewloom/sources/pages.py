"""Reviews and product facts from page HTML.

A small tolerant reader collects the text of the marked elements inside the
tasks; numbers, dates and filters are column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.schema import PAGE_PRODUCT, PAGE_REVIEW

# Fixed values: (tag, data-hook) of the parts of a review block.
REVIEW_BLOCK = ("div", "review")
REVIEW_PARTS = {
    ("i", "review-star-rating"): "rating",
    ("a", "review-title"): "title",
    ("span", "review-body"): "body",
    ("span", "review-date"): "date",
    ("span", "avp-badge"): "badge",
    ("span", "helpful-vote-statement"): "helpful",
}
VOID_TAGS = {"br", "hr", "img", "input", "link", "meta", "wbr", "area", "base", "col", "embed", "source", "track"}
#: HTML whose rows leave a task together; a batch of Spark may hold ten thousand pages.
PART_CHARS = 1 << 20
_TEXTS = ("block_id", "rating", "title", "body", "date", "badge", "helpful")
RAW_FIELDS = pa.schema([("page_id", pa.int64()), ("asin", pa.string()), ("page", pa.int32()), ("idx", pa.int32()), *((n, pa.string()) for n in _TEXTS)])
RAW_SCHEMA = "page_id bigint, asin string, page int, idx int, " + ", ".join(f"{name} string" for name in _TEXTS)
PRODUCT_FIELDS = pa.schema([("page_id", pa.int64()), ("asin", pa.string()), ("title", pa.string()), ("rating", pa.string())])


class PageReader(HTMLParser):
    """Collects the first text of each wanted element, per review block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[tuple[dict, str]]]] = []
        self.product: dict = {}
        self.blocks: list[dict] = []
        self.block: dict | None = None
        self.block_depth = 0
        self.title_depth = 0

    def _targets(self, tag: str, attrs: dict) -> list[tuple[dict, str]]:
        hook = attrs.get("data-hook")
        if (tag, hook) == REVIEW_BLOCK and self.block is None:
            self.block = {"block_id": attrs.get("id")}
            self.block_depth = len(self.open) + 1
            self.blocks.append(self.block)
        wanted = []
        if self.block is not None:
            part = REVIEW_PARTS.get((tag, hook))
            if part == "title":
                # the title is the first span inside the first title link
                if "title_seen" not in self.block:
                    self.block["title_seen"] = True
                    self.title_depth = len(self.open) + 1
            elif part and part not in self.block:
                wanted.append((self.block, part))
            if tag == "span" and self.title_depth and "title" not in self.block:
                wanted.append((self.block, "title"))
        if tag == "span" and attrs.get("id") == "productTitle" and "title" not in self.product:
            wanted.append((self.product, "title"))
        if tag == "span" and "a-icon-alt" in (attrs.get("class") or "").split() and "rating" not in self.product:
            wanted.append((self.product, "rating"))
        for store, name in wanted:
            store[name] = ""
        return wanted

    def handle_starttag(self, tag, attrs):
        targets = self._targets(tag, dict(attrs))
        if tag not in VOID_TAGS:
            self.open.append((tag, targets))

    def handle_startendtag(self, tag, attrs):
        self._targets(tag, dict(attrs))

    def handle_endtag(self, tag):
        if not any(name == tag for name, _ in self.open):
            return
        while self.open:
            name, _ = self.open.pop()
            if self.title_depth > len(self.open):
                self.title_depth = 0
            if self.block is not None and self.block_depth > len(self.open):
                self.block = None
            if name == tag:
                break

    def handle_data(self, data):
        for _, targets in self.open:
            for store, name in targets:
                store[name] += data


def read_page(html: str | None) -> PageReader:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    return reader


def _in_parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema, rows_of: Callable[[PageReader], list[dict]]) -> Iterator[pa.RecordBatch]:
    """Rows of the pages, with the page's own columns, in batches of about ``PART_CHARS`` of HTML; one page is read at a time."""
    for batch in batches:
        rows, chars = [], 0
        for i, html in enumerate(batch.column("html")):
            text = html.as_py() or ""
            own = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "html"}
            rows += [own | row for row in rows_of(read_page(text))]
            chars += len(text)
            if chars >= PART_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _review_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_parts(batches, RAW_FIELDS, lambda reader: [{"idx": i, **block} for i, block in enumerate(reader.blocks)])


def _product_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _in_parts(batches, PRODUCT_FIELDS, lambda reader: [reader.product])


def _text(name: str):
    """Python-style strip, missing elements as empty text."""
    from reviewloom.functions.text import strip

    return strip(F.coalesce(F.col(name), F.lit("")))


def _first_number(name: str, pattern: str):
    return F.regexp_extract(F.coalesce(F.col(name), F.lit("")), pattern, 1)


def extract_reviews_from_html(pages: DataFrame) -> DataFrame:
    """Pages ``(page_id, asin, page, html)`` to reviews with a rating and a text."""
    blocks = pages.select("page_id", "asin", F.col("page").cast("int").alias("page"), "html").mapInArrow(
        _review_rows, RAW_SCHEMA
    )
    rating = _first_number("rating", r"([\d.]+)")
    return (
        blocks.select(
            "page_id",
            F.coalesce("block_id", F.concat(F.col("asin"), F.lit("_p"), F.col("page"), F.lit("_"), F.col("idx"))).alias("review_id"),
            "asin",
            F.when(rating == "", F.lit(0.0)).otherwise(rating.try_cast("double")).alias("rating"),
            _text("body").alias("review_text"),
            _text("title").alias("review_title"),
            F.regexp_replace(_text("date"), r".*on\s+", "").alias("review_date"),
            F.col("badge").isNotNull().alias("verified_purchase"),
            F.coalesce(F.nullif(_first_number("helpful", r"(\d+)"), F.lit("")).cast("bigint"), F.lit(0)).alias("helpful_votes"),
        )
        .filter((F.col("rating") > 0) & (F.col("review_text") != ""))
        .select(*PAGE_REVIEW.fieldNames())
    )


def extract_product_from_html(pages: DataFrame) -> DataFrame:
    """Pages ``(page_id, asin, html)`` to title and rating with their defaults."""
    found = pages.select("page_id", "asin", "html").mapInArrow(
        _product_rows, "page_id bigint, asin string, title string, rating string"
    )
    title = _text("title")
    return found.select(
        "page_id",
        "asin",
        F.when(title == "", F.concat(F.lit("Product "), F.col("asin"))).otherwise(title).alias("title"),
        F.coalesce(_first_number("rating", r"([\d.]+)").try_cast("double"), F.lit(0.0)).alias("rating"),
    ).select(*PAGE_PRODUCT.fieldNames())
