import pytest
from pyspark.sql import functions as F

from reviewloom.operators import bots

LONG = "the parcel came on a rainy day and we put it away for the later season, as it happens"


def fired(df):
    return {r.review_id: r.bot_indicators for r in bots.bot_score(df).collect()}


CASES = [
    ("very_short", {"body": "a" * 9}, {"body": "a" * 10}),
    ("short_5star", {"body": "b" * 29, "rating": 5.0}, {"body": "b" * 30, "rating": 5.0}),
    ("suspicious_pattern", {"body": "Great product!"}, {"body": "Great product!", "title": "x"}),
    ("too_generic", {"body": ("love it perfect as described " + "z" * 99)[:99]}, {"body": ("love it perfect as described " + "z" * 99)[:100]}),
    ("unverified_extreme", {"body": LONG, "verified": False, "rating": 1.0}, {"body": LONG, "verified": False, "rating": 2.0}),
    ("no_engagement", {"body": "c" * 49, "helpful_count": 0}, {"body": "c" * 50, "helpful_count": 0}),
    ("suspicious_author", {"body": LONG, "author": "User77"}, {"body": LONG, "author": ""}),
    ("excessive_formatting", {"body": LONG + "!!!!!!"}, {"body": LONG + "!!!!!"}),
    ("repetitive", {"body": "go go one two three four"}, {"body": "go go one two three"}),
]


@pytest.mark.parametrize("rule,hit,miss", CASES, ids=[c[0] for c in CASES])
def test_rule_edges(make, rule, hit, miss):
    found = fired(make(hit, miss))
    assert rule in found["R0"] and rule not in found["R1"]


def test_repetitive_needs_more_than_thirty_percent(make):
    ten = " ".join(["same"] * 3 + [f"w{i}" for i in range(7)])
    nine = " ".join(["same"] * 3 + [f"w{i}" for i in range(6)])
    found = fired(make({"body": ten}, {"body": nine}))
    assert "repetitive" not in found["R0"] and "repetitive" in found["R1"]


def test_length_counts_characters_not_bytes(make):
    assert "very_short" in fired(make({"body": "🎯" * 9}))["R0"]
    assert "very_short" not in fired(make({"body": "🎯" * 10}))["R0"]


def test_score_is_capped_and_confident(make):
    row = bots.bot_score(make({"body": "Perfect!", "rating": 5.0, "verified": False, "helpful_count": 0, "author": "123"})).first()
    assert row.bot_score == 1.0 and row.is_bot_likely and row.bot_analysis.confidence == "high"


@pytest.mark.parametrize("author,suspicious", [
    ("customer12", True), ("Amazon Customer", True), ("AmazonCustomer", True), ("12345", True), ("reviewer", True),
    ("ab12", True), ("abc12", False), ("", False), (None, False), ("Jo Smith", False),
])
def test_authors(spark, author, suspicious):
    df = spark.createDataFrame([(author,)], "a string")
    assert df.select(bots.suspicious_author(F.col("a"))).first()[0] is suspicious


def bulk_rows(n, rating=4.0, **more):
    return [{"body": LONG, "rating": rating, "review_date": "2024-02-0%dT10:00:00" % (1 + (i % 1)), **more} for i in range(n)]


def test_bulk_rule_needs_five_of_one_rating(make):
    four = bots.analyze_bots(make(*bulk_rows(4))).collect()
    five = bots.analyze_bots(make(*bulk_rows(5))).collect()
    mixed = bots.analyze_bots(make(*bulk_rows(4), {"body": LONG, "rating": 5.0, "review_date": "2024-02-01"})).collect()
    assert {r.bot_score for r in four} == {0.0}
    assert {r.bot_score for r in five} == {0.2} and all(r.bot_indicators == ["bulk_posting_same_rating"] for r in five)
    assert {r.bot_analysis.score for r in five} == {0.0} and five[0].bot_analysis.indicators == ["bulk_posting_same_rating"]
    assert {r.bot_score for r in mixed} == {0.0}


def test_bulk_rule_groups_empty_dates_and_products_apart(make):
    rows = [{"body": LONG, "review_date": "", "product_id": "A"}] * 5 + [{"body": LONG, "review_date": "", "product_id": "B"}] * 4
    out = bots.analyze_bots(make(*rows)).collect()
    assert {(r.product_id, r.bot_score) for r in out} == {("A", 0.2), ("B", 0.0)}


def test_hot_groups_give_the_same_result(spark, small_reviews):
    plain = bots.analyze_bots(small_reviews.withColumn("rating", F.lit(4.0)))
    split = bots.analyze_bots(small_reviews.withColumn("rating", F.lit(4.0)).withColumn("review_date", F.lit("2024-01-01T1")))
    cold = bots.analyze_bots(small_reviews.withColumn("rating", F.lit(4.0)).withColumn("review_date", F.lit("2024-01-01T1")))
    cols = ["review_id", "bot_score", "is_bot_likely", "bot_indicators"]
    assert sorted(split.select(*cols).collect()) == sorted(cold.select(*cols).collect())
    assert split.filter("array_contains(bot_indicators, 'bulk_posting_same_rating')").count() == small_reviews.count()
    assert plain.count() == small_reviews.count()


def test_statistics(make):
    rows = bulk_rows(3) + [{"body": "Perfect!", "rating": 5.0, "verified": False, "product_id": "P"}]
    stats = bots.bot_statistics(bots.analyze_bots(make(*rows))).first()
    assert (stats.total_reviews, stats.genuine_count, stats.bot_count, stats.bot_percentage, stats.filtered_count) == (4, 3, 1, 25.0, 1)
