import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewloom.functions.ratings import parse_rating, parse_review_date
from reviewloom.sources import items, pages

PAGE = """<html><span id="productTitle">  A lamp </span><i><span class="a-icon-alt">4.3 out of 5</span></i>
<div data-hook="review" id="X1"><i data-hook="review-star-rating"><span>4.0 out of 5 stars</span></i>
 <a data-hook="review-title"><i>5.0 stars</i><span> Fine &amp; good </span><span>no</span></a>
 <span data-hook="review-date">Reviewed in Japan on May 3, 2023</span>
 <span data-hook="review-body"><br>Works <b>well</b></span><span data-hook="avp-badge">ok</span>
 <span data-hook="helpful-vote-statement">12 people</span></div>
<div data-hook="review"><i data-hook="review-star-rating">2.0</i><span data-hook="review-body">bad</span><p>unclosed</div>
<div data-hook="review"><span data-hook="review-body">no rating</span></div>
<div data-hook="review"><i data-hook="review-star-rating">3</i></div></html>"""


def test_page_reviews(spark):
    df = spark.createDataFrame([(1, "B1", 2, PAGE), (2, "B2", 1, ""), (3, "B3", 1, None)], "page_id long, asin string, page int, html string")
    rows = [tuple(r) for r in pages.extract_reviews_from_html(df).collect()]
    assert rows == [
        (1, "X1", "B1", 4.0, "Works well", "Fine & good", "May 3, 2023", True, 12),
        (1, "B1_p2_1", "B1", 2.0, "bad", "", "", False, 0),
    ]
    products = [tuple(r) for r in pages.extract_product_from_html(df).orderBy("page_id").collect()]
    assert products == [(1, "B1", "A lamp", 4.3), (2, "B2", "Product B2", 0.0), (3, "B3", "Product B3", 0.0)]


def test_raw_items(spark, tmp_path):
    raw = [
        {"id": "1", "asin": "B1", "reviewTitle": "t", "reviewRating": "4.0 out of 5 stars", "reviewDate": "Reviewed in London on January 5, 2024"},
        {"id": "2", "asin": "B1", "reviewDescription": "d", "reviewRating": 2, "reviewAuthor": "Al", "isVerified": True, "helpfulCount": 3},
        {"id": "3", "asin": "B1", "reviewTitle": "t", "reviewRating": "n/a"},
        {"error": "blocked", "url": "u"},
    ]
    path = tmp_path / "raw.json"
    path.write_text("\n".join(json.dumps(r) for r in raw))
    out = items.canonicalize_reviews(items.read_raw_items(spark, str(path))).orderBy("review_id").collect()
    assert [(r.review_id, r.rating, r.author, r.verified, r.helpful_count, r.title, r.body) for r in out] == [
        ("1", 4.0, "Anonymous", False, 0, "t", ""), ("2", 2.0, "Al", True, 3, "", "d")
    ]
    assert out[0].review_date == "2024-01-05T00:00:00" and out[1].review_date == "" and out[1].review_ts is None


def test_alias_names(spark):
    df = spark.createDataFrame([("1", "B", "txt", 5, "2024-01-02", True, 7)], "review_id string, asin string, content string, stars int, date string, verified_purchase boolean, helpful_votes int")
    r = items.canonicalize_reviews(df).first()
    assert (r.product_id, r.body, r.rating, r.review_date, r.verified, r.helpful_count) == ("B", "txt", 5.0, "2024-01-02", True, 7)


def test_nested_items(spark, tmp_path):
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"asin": "B", "reviews": [{"title": "a", "stars": 5}, {"title": "b"}]}) + "\n" + json.dumps({"asin": "C", "reviews": []}))
    rows = items.read_nested_items(spark, str(path)).collect()
    assert [(r.asin, r.seq, r.title, r.stars) for r in rows] == [("B", 0, "a", 5), ("B", 1, "b", None)]


@pytest.mark.parametrize("text,value", [
    ("4.0 out of 5 stars", 4.0), ("4", 4.0), ("", 0.0), (None, 0.0), ("x", None), ("4.0d", None), (" 3.5 stars", 3.5), (".5", 0.5),
])
def test_parse_rating(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(parse_rating(F.col("t"))).first()[0] == value


@pytest.mark.parametrize("text,day", [
    ("Reviewed in the United Kingdom on January 5, 2024", "2024-01-05"), ("March 05, 2024", "2024-03-05"), ("yesterday", None),
    ("", None), (None, None), ("London on May 40, 2024", None),
])
def test_parse_date(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(F.date_format(parse_review_date(F.col("t")), "yyyy-MM-dd")).first()[0]
    assert got == day


def test_sanitize(make):
    df = make(
        {"review_id": "a", "body": "first", "rating": 2.0}, {"review_id": "a", "body": "second"}, {"review_id": "b", "rating": None, "body": "x"},
        {"review_id": "c", "rating": 0.5, "body": "x"}, {"review_id": "d", "body": " \n"}, {"review_id": "e", "body": None},
        {"review_id": "f", "body": "x", "review_date": "soon"},
    )
    out = {r.review_id: (r.body, r.rating, r.review_ts is None) for r in items.sanitize_reviews(df).collect()}
    assert out == {"a": ("first", 2.0, False), "b": ("x", 3.0, False), "f": ("x", 3.0, True)}


def test_product_info_takes_the_first_titled_item(spark):
    df = spark.createDataFrame(
        [("B", 0, None, "other", None, None), ("B", 1, "Lamp", None, 4.5, None), ("B", 2, "Later", None, 1.0, None)],
        "asin string, seq long, productTitle string, title string, averageRating double, stars double",
    ).withColumns({c: F.lit(None).cast("string") for c in ("brand", "price", "thumbnailImage", "image")}).withColumns(
        {c: F.lit(None).cast("long") for c in ("totalReviews", "reviewsCount")})
    live, service = items.product_info(df).first(), items.product_info(df, "service").first()
    assert (live.title, live.rating, live.brand) == ("Lamp", 4.5, "") and (service.title, service.rating) == ("other", 0.0)


def test_whole_texts_reach_the_reviews(spark, small_reviews):
    from tests.conftest import SMALL

    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = small_reviews.join(given, F.col("review_id") == F.concat(F.lit("R"), "doc_id"))
    assert whole.where(F.expr("endswith(body, text)")).count() == given.count()


def test_rows_of_many_pages_leave_in_parts(monkeypatch):
    html = '<div data-hook="review" id="R%d"><span data-hook="review-body">' + "x" * 900 + "</span></div>"
    rows = [{"page_id": i, "asin": "B", "page": 1, "html": html % i if i % 3 else None} for i in range(300)]
    monkeypatch.setattr(pages, "PART_CHARS", 10_000)
    found = list(pages._review_rows(iter([pa.RecordBatch.from_pylist(rows)])))
    assert [r["block_id"] for b in found for r in b.to_pylist()] == [f"R{i}" for i in range(300) if i % 3]
    assert len(found) > 10 and max(b.nbytes for b in found) < 20_000
