import re
from collections import Counter

from pyspark.sql import functions as F

from reviewloom.dictionaries import ENGLISH_STOPWORDS
from reviewloom.operators import keywords, themes


def test_top_keywords_agree_with_a_counter(small_reviews):
    rows = small_reviews.select("product_id", "seq", "title", "body").orderBy("seq").collect()
    got = {}
    for r in keywords.top_keywords(small_reviews).orderBy("rank").collect():
        got.setdefault(r.product_id, []).append((r.word, r.frequency))
    for product in {r.product_id for r in rows}:
        text = " ".join(f"{r.title} {r.body}" for r in rows if r.product_id == product).lower()
        words = [w for w in re.findall(r"\b[a-z]+\b", text) if w not in set(ENGLISH_STOPWORDS) and len(w) > 2]
        assert got[product] == Counter(words).most_common(15)


def test_equal_counts_rank_by_first_occurrence(make):
    out = keywords.top_keywords(make({"body": "zebra apple"}, {"body": "apple mango zebra mango"})).orderBy("rank").collect()
    assert [(r.rank, r.word, r.frequency) for r in out] == [(1, "zebra", 2), (2, "apple", 2), (3, "mango", 2)]


def test_shares_use_all_kept_words(make):
    df = make({"body": "alpha alpha beta gamma"}, {"body": "delta", "product_id": "Q"})
    out = {(r.product_id, r.word): r.weight for r in keywords.keyword_share(df, top_n=1).collect()}
    assert out == {("P", "alpha"): 0.5, ("Q", "delta"): 1.0}


def test_large_seq_keeps_the_order(make):
    big = 2**60
    df = make({"body": "later"}, {"body": "early"}).withColumn("seq", F.lit(big) - F.col("seq"))
    assert keywords.top_keywords(df).orderBy("rank").first().word == "early"


def test_theme_majority_and_order(make):
    df = make(
        {"body": "great quality"}, {"body": "bad quality"}, {"body": "price"}, {"body": "the size and fit"},
        {"body": "nothing here", "product_id": "Q"},
    )
    out = themes.keyword_themes(df).orderBy("rank").collect()
    assert [(r.theme, r.mentions, r.sentiment) for r in out] == [
        ("Quality", 2, "positive"), ("Price", 1, "neutral"), ("Size", 1, "neutral")
    ]


def test_occurrences_do_not_overlap(make):
    out = themes.theme_occurrences(make({"body": "quality quality, helpful help"})).collect()
    assert {(r.theme, r.mentions) for r in out} == {("Product Quality", 2), ("Customer Service", 2)}


def test_products_without_a_pattern_get_the_default_theme(make):
    df = make({"body": "nice price"}, {"body": "zzz"}, {"body": "zzz", "product_id": "Q"}, {"body": "qqq", "product_id": "Q"})
    members = sorted(tuple(r) for r in themes.pattern_theme_members(df).collect())
    assert members == [("P", "Price & Value", "R0"), ("Q", "General Feedback", "R2"), ("Q", "General Feedback", "R3")]
    rows = {(r.product_id, r.id, r.theme, r.size, r.sentiment_score) for r in themes.pattern_themes(df).collect()}
    assert rows == {("P", "theme_0", "Price & Value", 1, 3.5), ("Q", "theme_0", "General Feedback", 2, 3.0)}
