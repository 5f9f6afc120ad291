import re

import pytest
from pyspark.sql import functions as F

from reviewloom.functions import codes, text as ft
from reviewloom.operators import keywords
from tests.conftest import SMALL


def test_words_agree_with_python_word_boundaries(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "Café naïve éte under_score a1b2 don't 数据 x²y ½kg"), (-2, ""), (-3, "…")], docs.schema)
    docs = docs.union(more)
    got = docs.select("doc_id", F.filter(ft.split_words(F.col("text")), lambda w: w.rlike(keywords.ASCII_WORD)).alias("w"))
    for row, source in zip(got.orderBy("doc_id").collect(), docs.orderBy("doc_id").collect()):
        assert row.w == re.findall(r"\b[a-z]+\b", source.text.lower())


def test_strip_is_unicode(spark):
    raw = " \t x y　\n"
    assert spark.createDataFrame([(raw,)], "t string").select(ft.strip(F.col("t"))).first()[0] == raw.strip()


def test_clean_text(spark):
    raw = "<b>Hello</b>   WORLD &amp; co, see https://a.b/c?d=1 now\n\nwww.x.org — naïve!  ok"
    df = spark.createDataFrame([(raw,), (None,), ("",)], "t string")
    rows = [r[0] for r in df.select(ft.clean_text(F.col("t"))).collect()]
    assert rows == ["hello world co, see now nave! ok", "", ""]
    words = df.select(ft.review_keywords(F.lit("This product is a well-made one, really sturdy!"))).first()[0]
    assert words == ["well-made", "sturdy"]


def test_clean_text_decodes_and_knows_all_white_space(spark):
    raw = {
        "good&nbsp;quality": "good quality", "see www.a.com\xa0now": "see now", "&eacute;t&#233; caf\xe9": "t caf", "<!-- a > b -->left": "left",
        "a&#32;b&#x21; &#65;&#8195;c": "a b! a c", "&amp;lt; x": "lt x", "&unknown; y": "unknown y", "it&#39;s": "its", "x\u2003\u2003y": "x y",
    }
    df = spark.createDataFrame([(k,) for k in raw], "t string")
    assert dict(df.select("t", ft.clean_text(F.col("t"))).collect()) == raw


def test_truncate(spark):
    df = spark.createDataFrame([("a" * 100,), ("a" * 101,), (None,)], "t string")
    assert [r[0] for r in df.select(ft.truncate_text(F.col("t"))).collect()] == ["a" * 100, "a" * 97 + "...", ""]


@pytest.mark.parametrize("url,strict,loose", [
    ("B08N5WRWNW", "B08N5WRWNW", "B08N5WRWNW"),
    ("b08n5wrwnw", None, "B08N5WRWNW"),
    ("https://www.amazon.com/dp/b08n5wrwnw?x=1", "B08N5WRWNW", "B08N5WRWNW"),
    ("https://x/gp/product/B08N5WRWNW/", "B08N5WRWNW", "B08N5WRWNW"),
    ("https://x/dp/A08N5WRWNW?asin=B08N5WRWNW", "B08N5WRWNW", "A08N5WRWNW"),
    ("https://www.amazon.de/some/B08N5WRWNW?x", None, "B08N5WRWNW"),
    ("B08N5WRWN", None, None), ("", None, None), (None, None, None),
])
def test_product_codes(spark, url, strict, loose):
    df = spark.createDataFrame([(url,)], "u string")
    row = df.select(codes.extract_asin(F.col("u")), codes.extract_asin(F.col("u"), "loose")).first()
    assert tuple(row) == (strict, loose)


def test_urls_and_countries(spark):
    df = spark.createDataFrame([("jp",), ("SE",), ("XX",)], "c string")
    urls = [tuple(r) for r in df.select(*[codes.product_url(F.lit("B1"), F.col("c"), f) for f in ("live", "service")]).collect()]
    base = "https://www.%s/dp/B1"
    assert urls == [(base % "amazon.com", base % "amazon.co.jp"), (base % "amazon.com", base % "amazon.se"), (base % "amazon.com",) * 2]
    assert [r[0] for r in df.select(codes.country_name(F.col("c"))).collect()] == ["Japan", "SE", "XX"]
