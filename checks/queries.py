"""Registered queries: each operator over the whole tables, flat and named columns."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sql import CLUSTER_FIT, TOPIC_STEPS
from reviewloom import schema
from reviewloom.dictionaries import EMOTIONS
from reviewloom.functions import codes, ratings as fr, rounding, text as ft
from reviewloom.operators import (
    bots, countries, emotions, group_topics, growth, insights, keywords, ranking, ratings, report, samples, sentiment, summaries, themes, topics,
)
from reviewloom.plans import analysis, variants
from reviewloom.sources import driver_tables as dt, items, pages
from reviewloom.sources.shared import new_path
from reviewloom.streaming.growth import stream_growth
from reviewloom.streaming.run import run_available, run_latest
from reviewloom.streaming.scoring import stream_bulk_days, stream_bulk_state, stream_score_reviews

AS_OF = datetime(2024, 1, 31)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
P = "product_id"


def register(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(column: str, sep: str = " | "):
    return F.array_join(column, sep).alias(column)


def reviews(spark, sf):
    return dt.reviews_from_documents(spark, sf)


def mixed(spark, sf):
    """Reviews whose products are sold in several countries, some not in the first ones."""
    kind = F.substring(P, 2, 9).cast("int") % 3
    country = F.element_at(F.array(*[F.lit(c) for c in dt.COUNTRIES]), ((F.floor(F.col("seq") / 20) + F.col("seq")) % 5 + 1).cast("int"))
    moved = F.when((kind == 1) & country.isin("IN", "US"), "FR").when((kind == 2) & (country == "IN"), "US").otherwise(country)
    return reviews(spark, sf).withColumn("country", moved)


def scored(spark, sf):
    return sentiment.score_sentiment(reviews(spark, sf))


def snapshots(spark, sf):
    return growth.estimate_buyers(dt.snapshots_from_events(spark, sf))


def rows_of(df, *names):
    return df.select(*names)


# ---------------------------------------------------------------- sources
@register
def read_raw_items(spark, sf):
    path = new_path(spark, "items")
    dt.raw_items_from_documents(spark, sf).write.json(path)
    return items.read_raw_items(spark, path).select(
        "id", "reviewTitle", "reviewDescription", "reviewRating", F.col("isVerified").cast("string"),
        F.col("helpfulCount").cast("string"), "asin", "seq",
    )


@register
def explode_nested_items(spark, sf):
    entry = F.struct(
        "seq", "title", F.col("body").alias("text"), F.col("rating").cast("int").alias("stars"),
        F.col("review_date").alias("date"), "verified",
    )
    nested = (
        reviews(spark, sf).groupBy(F.col(P).alias("asin"), F.floor(F.col("seq") / 200).alias("item"))
        .agg(F.sort_array(F.collect_list(entry)).alias("reviews"))
        .select("asin", "item", F.transform("reviews", lambda r: r.dropFields("seq")).alias("reviews"))
    )
    return items.explode_nested_items(nested).select("asin", "item", "seq", "title", "text", "stars", "date", "verified")


@register
def extract_reviews_from_html(spark, sf):
    return pages.extract_reviews_from_html(dt.pages_from_documents(spark, sf)).drop("page_id")


@register
def extract_product_from_html(spark, sf):
    return pages.extract_product_from_html(dt.pages_from_documents(spark, sf))


@register
def product_info(spark, sf):
    return items.product_info(dt.raw_items_from_documents(spark, sf), "live")


@register
def product_info_service(spark, sf):
    return items.product_info(dt.raw_items_from_documents(spark, sf).withColumn("image", F.lit("")), "service")


@register
def product_info_api(spark, sf):
    raw = dt.raw_items_from_documents(spark, sf)
    return items.product_info(
        raw.withColumn("productImageUrl", F.when(F.col("seq") % 2 == 0, F.col("thumbnailImage"))).withColumn("imageUrl", F.lit("other")), "api"
    )


@register
def growth_snapshot_store(spark, sf):
    path = new_path(spark, "snapshots")
    growth.append_growth_snapshot(dt.snapshots_from_events(spark, sf), path)
    stored = growth.read_growth_snapshots(spark, path)
    return stored.groupBy(P, F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("snapshots"), F.sum("estimated_buyers").alias("buyers"), F.max("review_count").alias("most_reviews")
    )


# ---------------------------------------------------------------- cleaning
@register
def canonicalize_reviews(spark, sf):
    out = items.canonicalize_reviews(items.raw_reviews_only(dt.raw_items_from_documents(spark, sf)))
    return out.select(
        "review_id", P, "country", "title", "body", "rating", "author", "review_date",
        F.date_format("review_ts", "yyyy-MM-dd").alias("review_day"), "verified", "helpful_count",
        F.size("images").alias("images"), "variant", "source", "seq",
    )


def rating_texts(spark, sf):
    n = F.col("seq") % 7
    value = F.col("rating")
    text = (
        F.when(n == 0, F.format_string("%.1f out of 5 stars", value)).when(n == 1, value.cast("int").cast("string"))
        .when(n == 2, "").when(n == 3, "no rating").when(n == 4, F.concat(F.lit("  "), value.cast("int") - 0.5, F.lit(" of five ")))
        .when(n == 5, F.concat(value.cast("int"), F.lit("d")))
    )
    return reviews(spark, sf).select("review_id", "seq", text.alias("raw"))


@register
def parse_rating(spark, sf):
    rows = rating_texts(spark, sf).select("review_id", fr.parse_rating(F.col("raw")).alias("rating"))
    return rows.filter(F.col("rating").isNotNull())


@register
def parse_review_date(spark, sf):
    n = F.col("seq") % 5
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("seq") % 700).cast("int"))
    long = F.date_format(day, "MMMM d, yyyy")
    raw = (
        F.when(n == 0, F.concat(F.lit("Reviewed in the London region on "), long)).when(n == 1, long)
        .when(n == 2, F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"))).when(n == 3, F.concat(F.lit("seen on May 41, "), F.year(day)))
    )
    rows = reviews(spark, sf).select("review_id", fr.parse_review_date(raw).alias("ts"))
    return rows.select("review_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@register
def sanitize_reviews(spark, sf):
    s = F.col("seq")
    messy = reviews(spark, sf).select(
        F.concat(F.lit("R"), F.floor(s / 2)).alias("review_id"), "seq",
        F.when(s % 13 == 0, "  \n ").when(s % 17 == 0, F.lit(None)).otherwise(F.col("body")).alias("body"),
        F.when(s % 7 == 0, F.lit(None)).when(s % 11 == 0, F.lit(6.0)).when(s % 19 == 0, F.lit(0.0)).otherwise(F.col("rating")).alias("rating"),
        F.when(s % 5 == 0, "someday").otherwise(F.substring("review_date", 1, 10)).alias("review_date"),
    )
    out = items.sanitize_reviews(messy)
    return out.select("review_id", "seq", "body", "rating", F.date_format("review_ts", "yyyy-MM-dd").alias("day"))


def code_texts(spark, sf):
    n, code = F.col("seq") % 12, F.upper(F.concat(F.lit("B0"), F.lpad(F.hex(F.col("seq") * 7919 + 11), 8, "0")))
    low = F.lower(code)
    forms = [
        code, F.concat(F.lit("  "), code, F.lit(" ")), low, F.substring(code, 1, 9),
        F.concat(F.lit("https://www.amazon.com/dp/"), code), F.concat(F.lit("https://WWW.AMAZON.de/gp/product/"), low, F.lit("?th=1")),
        F.concat(F.lit("http://shop.example.com/product/"), code, F.lit("/x")), F.concat(F.lit("https://www.amazon.in/exec/obidos/ASIN/"), code),
        F.concat(F.lit("https://example.com/?q=1&asin="), code), F.concat(F.lit("https://www.amazon.ca/dp/X"), F.substring(code, 2, 9), F.lit("/ref=1?asin="), code),
        F.concat(F.lit("https://www.amazon.co.uk/some-name/"), F.substring(code, 1, 10), F.lit("?tag=2")), F.lit(""),
    ]
    pick = F.element_at(F.array(*forms), (n + 1).cast("int"))
    return reviews(spark, sf).select("review_id", "seq", "country", "product_id", pick.alias("url"))


@register
def valid_asin(spark, sf):
    return code_texts(spark, sf).select("review_id", codes.valid_asin(F.col("url")).alias("strict"), codes.valid_asin(F.col("url"), "any").alias("any_code"))


@register
def extract_asin(spark, sf):
    return code_texts(spark, sf).select("review_id", *[codes.extract_asin(F.col("url"), m).alias(m) for m in ("strict", "loose", "basic")])


@register
def is_marketplace_url(spark, sf):
    return code_texts(spark, sf).select("review_id", *[codes.is_marketplace_url(F.col("url"), m).alias(f"by_{m}") for m in ("domain", "path")])


@register
def product_url(spark, sf):
    code = F.when(F.col("seq") % 3 == 0, F.lower("country")).when(F.col("seq") % 7 == 0, "AU").otherwise(F.col("country"))
    return code_texts(spark, sf).select("review_id", *[codes.product_url(F.col(P), code, f).alias(f) for f in ("live", "service", "dashboard")])


@register
def country_name(spark, sf):
    code = F.when(F.col("seq") % 3 == 0, F.lower("country")).when(F.col("seq") % 7 == 0, "XX").otherwise(F.col("country"))
    return code_texts(spark, sf).select("review_id", codes.country_name(code).alias("country_name"))


def markup(spark, sf):
    s = F.col("seq")
    raw = F.concat(
        F.lit("<p class='x'>"), F.col("title"), F.lit("</p> see https://example.com/a?b=1 or www.example.org/x &amp; "),
        F.when(s % 9 == 0, "well-made one, I would like <b>GOOD</b> use! ").otherwise(""), F.col("body"),
    )
    return reviews(spark, sf).select("review_id", "seq", raw.alias("raw"))


@register
def clean_text(spark, sf):
    return markup(spark, sf).select("review_id", ft.clean_text(F.col("raw")).alias("cleaned"))


@register
def clean_text_without_stopwords(spark, sf):
    from reviewloom.dictionaries import ENGLISH_STOPWORDS, REVIEW_STOPWORDS

    stop = ENGLISH_STOPWORDS + REVIEW_STOPWORDS
    return markup(spark, sf).select("review_id", ft.clean_text(F.col("raw"), stop).alias("cleaned"))


@register
def combined_text(spark, sf):
    title = F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(F.col("title"))
    return reviews(spark, sf).select("review_id", ft.combined_text(title).alias("text"), ft.scoring_text(title).alias("scoring_text"))


@register
def truncate_text(spark, sf):
    return reviews(spark, sf).select("review_id", *[ft.truncate_text(F.col("body"), n).alias(f"cut_{n}") for n in (100, 40)])


@register
def percentage(spark, sf):
    return reviews(spark, sf).groupBy(P).agg(F.count("*").alias("n"), F.count_if("verified").alias("v")).select(
        P, rounding.percentage(F.col("v"), F.col("n")).alias("verified_pct"), rounding.percentage(F.col("v"), F.lit(0)).alias("of_nothing")
    )


@register
def valid_rating(spark, sf):
    rating = F.when(F.col("seq") % 7 == 0, F.lit(None)).otherwise(F.col("rating") * (F.col("seq") % 3) / 2)
    return reviews(spark, sf).select("review_id", fr.valid_rating(rating).alias("valid"))


@register
def display_formats(spark, sf):
    value = (F.col("seq") % 801) / 8.0
    return reviews(spark, sf).select(
        "review_id", fr.display_number(F.col("seq") * 12345).alias("number"), fr.display_percent(value).alias("percent"),
        fr.display_date(F.col("review_date").cast("timestamp")).alias("day"),
    )


@register
def rating_band(spark, sf):
    rating = F.col("rating") - (F.col("seq") % 4) / 4
    return reviews(spark, sf).select("review_id", fr.rating_band(rating).alias("band"), fr.rating_band(rating, "exact").alias("badge"))


# ---------------------------------------------------------------- filters
@register
def filter_genuine(spark, sf):
    return bots.filter_genuine(bots.analyze_bots(reviews(spark, sf))).select("review_id", P)


@register
def filter_bots(spark, sf):
    return bots.filter_bots(bots.analyze_bots(reviews(spark, sf)), 0.4).select("review_id", "bot_score")


@register
def reviews_in_bucket(spark, sf):
    return sentiment.reviews_in_bucket(scored(spark, sf)).select("review_id", "rating", "sentiment", "bucket")


@register
def rating_sentiment(spark, sf):
    rating = F.col("rating") - (F.col("seq") % 4) / 4
    return reviews(spark, sf).select(
        "review_id", fr.rating_sentiment(rating).alias("label"), fr.rating_sentiment(rating, 4.0, 2.0).alias("dashboard_label")
    )


@register
def max_reviews(spark, sf):
    return ranking.max_reviews(reviews(spark, sf), 30).select("review_id", P)


@register
def max_reviews_short(spark, sf):
    return ranking.max_reviews(reviews(spark, sf), 30, cap=5).select("review_id", P)


@register
def skip_blank(spark, sf):
    s = F.col("seq")
    rows = reviews(spark, sf).withColumn("title", F.when(s % 4 < 2, "").otherwise(F.col("title"))).withColumn(
        "body", F.when(s % 6 == 0, " \t").when(s % 6 == 1, "").otherwise(F.col("body"))
    )
    a = sentiment.skip_blank(rows).select("review_id", F.lit("title_body").alias("form"))
    return a.unionByName(sentiment.skip_blank(rows, "body").select("review_id", F.lit("body").alias("form")))


# ---------------------------------------------------------------- bots
@register
def bot_score(spark, sf):
    return bots.bot_score(reviews(spark, sf)).select("review_id", "bot_score", "is_bot_likely")


@register
def bot_indicators(spark, sf):
    return bots.bot_score(reviews(spark, sf)).select("review_id", joined("bot_indicators", ","))


@register
def bot_confidence(spark, sf):
    return bots.analyze_bots(reviews(spark, sf)).select(
        "review_id", F.col("bot_analysis.score").alias("row_score"), F.col("bot_analysis.confidence").alias("confidence"),
        F.array_join("bot_analysis.indicators", ",").alias("indicators"),
    )


@register
def suspicious_author(spark, sf):
    n = F.col("seq") % 8
    name = (
        F.when(n == 0, F.col("author")).when(n == 1, "Amazon Customer").when(n == 2, F.col("seq").cast("string"))
        .when(n == 3, "Reviewer").when(n == 4, F.concat(F.lit("Ab"), F.col("seq"))).when(n == 5, F.concat(F.lit("abc"), F.col("seq"))).when(n == 6, "amazoncustomer")
    )
    return reviews(spark, sf).select("review_id", bots.suspicious_author(name).alias("suspicious"))


@register
def repetitive(spark, sf):
    return reviews(spark, sf).select("review_id", bots.repetitive(ft.scoring_text()).alias("repetitive"))


@register
def bulk_posting(spark, sf):
    return bots.analyze_bots(reviews(spark, sf)).select("review_id", "bot_score", "is_bot_likely", joined("bot_indicators", ","))


@register
def bot_statistics(spark, sf):
    return bots.bot_statistics(bots.analyze_bots(reviews(spark, sf)))


# ---------------------------------------------------------------- sentiment
@register
def lexicon_sentiment(spark, sf):
    return scored(spark, sf).select("review_id", "valence", "compound", "pos_share", "neu_share", "neg_share")


@register
def lexicon_sentiment_free(spark, sf):
    out = sentiment.score_sentiment(reviews(spark, sf), form="body")
    return out.select("review_id", *[rounding.round_exact(F.col(c), 3).alias(c) for c in (*sentiment.SCORES, "confidence")], "sentiment")


@register
def polarity_subjectivity(spark, sf):
    return scored(spark, sf).select("review_id", "polarity", "subjectivity")


@register
def sentiment_label(spark, sf):
    c = F.col("compound")
    return scored(spark, sf).select("review_id", sentiment.sentiment_label(c).alias("label"), sentiment.sentiment_label(c, 0.1).alias("wide_label"))


@register
def sentiment_confidence(spark, sf):
    return scored(spark, sf).select("review_id", "confidence")


@register
def ensemble_vote(spark, sf):
    out = sentiment.ensemble_vote(sentiment.lexicon_sentiment(reviews(spark, sf)))
    return out.select("review_id", "sentiment", "confidence")


def outside_model(spark, sf):
    """An outside model's answers stand in for a column computed elsewhere."""
    s = F.col("seq")
    label = F.when(s % 3 == 1, "POSITIVE").when(s % 3 == 2, "NEGATIVE")
    return reviews(spark, sf).select("review_id", label.alias("label"), F.when(label.isNotNull(), (s % 100) / 100.0).alias("score"))


@register
def external_label(spark, sf):
    base = sentiment.external_label(sentiment.lexicon_sentiment(reviews(spark, sf)), outside_model(spark, sf))
    out = sentiment.ensemble_vote(base, external=("model_label", "model_score"))
    return out.select("review_id", "model_label", "sentiment", "confidence")


@register
def external_model_input(spark, sf):
    return sentiment.model_input(reviews(spark, sf))


@register
def sentiment_distribution(spark, sf):
    return sentiment.sentiment_distribution(scored(spark, sf))


@register
def sentiment_metrics(spark, sf):
    return sentiment.sentiment_metrics(scored(spark, sf))


@register
def sentiment_percentages(spark, sf):
    return sentiment.sentiment_percentages(sentiment.sentiment_distribution(scored(spark, sf)))


@register
def sentiment_by_day(spark, sf):
    s = F.col("seq")
    rows = scored(spark, sf).withColumn("sentiment", F.when(s % 4 != 0, F.col("sentiment"))).withColumn(
        "review_date", F.when(s % 9 != 0, F.col("review_date"))
    )
    return sentiment.sentiment_by_day(rows)


@register
def sentiment_pie(spark, sf):
    return sentiment.sentiment_pie(sentiment.sentiment_distribution(scored(spark, sf)))


# ---------------------------------------------------------------- emotions
@register
def emotion_hits(spark, sf):
    out = emotions.emotion_hits(reviews(spark, sf))
    return out.select("review_id", *[f"hits_{e}" for e in EMOTIONS["default"]])


@register
def emotion_corpus(spark, sf):
    return emotions.emotion_corpus(scored(spark, sf))


@register
def emotion_corpus_api(spark, sf):
    return emotions.emotion_corpus(scored(spark, sf), "api")


@register
def emotion_review(spark, sf):
    out = emotions.emotion_review(reviews(spark, sf))
    return out.select("review_id", *EMOTIONS["ensemble"], "neutral")


@register
def emotion_review_free(spark, sf):
    return emotions.emotion_review(reviews(spark, sf), "free").select("review_id", *EMOTIONS["free"])


@register
def emotion_average(spark, sf):
    return emotions.emotion_average(emotions.emotion_review(reviews(spark, sf)))


@register
def dominant_emotion(spark, sf):
    return emotions.dominant_emotion(emotion_average(spark, sf), [*EMOTIONS["ensemble"], "neutral"])


@register
def emotion_rows(spark, sf):
    return emotions.emotion_rows(emotion_corpus(spark, sf), list(EMOTIONS["default"]))


# ---------------------------------------------------------------- keywords
@register
def tokens(spark, sf):
    return keywords.tokens(reviews(spark, sf)).groupBy(P).agg(F.count("*").alias("tokens"), F.sum(F.length("word")).alias("characters"))


@register
def tokens_alnum(spark, sf):
    return keywords.tokens(reviews(spark, sf), "ensemble").groupBy(P).agg(F.count("*").alias("tokens"), F.sum(F.length("word")).alias("characters"))


@register
def top_keywords(spark, sf):
    return keywords.top_keywords(reviews(spark, sf))


@register
def top_keywords_api(spark, sf):
    return keywords.top_keywords(reviews(spark, sf), "api").withColumnRenamed("frequency", "count")


@register
def keyword_share(spark, sf):
    return keywords.keyword_share(reviews(spark, sf))


@register
def keyword_share_free(spark, sf):
    return keywords.keyword_share(reviews(spark, sf), "free")


@register
def review_keywords(spark, sf):
    return markup(spark, sf).select("review_id", F.array_join(ft.review_keywords(F.col("raw")), " ").alias("words"))


@register
def keyword_size_class(spark, sf):
    return keywords.keyword_size_class(keywords.top_keywords(reviews(spark, sf)))


# ---------------------------------------------------------------- themes
@register
def keyword_themes(spark, sf):
    return themes.keyword_themes(reviews(spark, sf))


@register
def theme_labels(spark, sf):
    return themes.theme_labels(reviews(spark, sf))


@register
def theme_occurrences(spark, sf):
    return themes.theme_occurrences(reviews(spark, sf)).select(P, "ordinal", "theme", "mentions", joined("keywords", ", "))


@register
def aspect_themes(spark, sf):
    out = themes.aspect_themes(sentiment.lexicon_sentiment(reviews(spark, sf), "body"))
    return out.select(P, "rank", "theme", "mentions", "sentiment", "confidence", joined("keywords", ", "))


@register
def pattern_themes(spark, sf):
    return themes.pattern_themes(reviews(spark, sf)).select(P, "id", "theme", "size", "sentiment_score", joined("keywords", ", "))


@register
def pattern_theme_members(spark, sf):
    return themes.pattern_theme_members(reviews(spark, sf))


@register
def theme_sentiment_class(spark, sf):
    return themes.pattern_themes(reviews(spark, sf)).select(
        P, "theme", themes.theme_sentiment_class(F.col("sentiment_score") + F.col("size") % 3 - 1).alias("class")
    )


@register
def theme_lines(spark, sf):
    return themes.theme_lines(themes.pattern_themes(reviews(spark, sf)), "id")


@register
def normalize_themes(spark, sf):
    bare = themes.theme_labels(reviews(spark, sf)).select(P, "theme")
    return themes.normalize_themes(themes.keyword_themes(reviews(spark, sf)).drop("rank"), bare)


@register
def tfidf_features(spark, sf):
    rows = topics.feature_rows(topics.tfidf_features(reviews(spark, sf)))
    return rows.select("review_id", "term", rounding.round_exact(F.col("weight"), 6).alias("weight"))


@register
def tfidf_features_topics(spark, sf):
    rows = topics.feature_rows(topics.tfidf_features(reviews(spark, sf), "topics"))
    return rows.select("review_id", "term", rounding.round_exact(F.col("weight"), 6).alias("weight"))


@register
def tfidf_features_product(spark, sf):
    return group_topics.group_feature_rows(group_topics.group_vectors(reviews(spark, sf)))


@register
def tfidf_features_detailed(spark, sf):
    return group_topics.group_feature_rows(group_topics.group_vectors(reviews(spark, sf), "detailed"))


@register
def cluster_themes(spark, sf):
    return group_topics.cluster_themes(reviews(spark, sf))


@register
def cluster_themes_detailed(spark, sf):
    found = group_topics.cluster_themes_detailed(reviews(spark, sf), **CLUSTER_FIT)
    return found.select(P, "id", "theme", joined("keywords", ", "), "sentiment_score", "size")


@register
def cluster_theme_members(spark, sf):
    return group_topics.detailed_clusters(reviews(spark, sf), **CLUSTER_FIT)[1]


@register
def topic_themes(spark, sf):
    found = group_topics.topic_themes(reviews(spark, sf), iterations=TOPIC_STEPS)
    return found.select(P, "rank", "theme", joined("keywords", ", "), "mentions", "importance")


# ---------------------------------------------------------------- aggregates
@register
def rating_summary(spark, sf):
    return ratings.rating_summary(reviews(spark, sf))


@register
def rating_distribution(spark, sf):
    rows = reviews(spark, sf).withColumn("rating", F.col("rating") - (F.col("seq") % 4) / 4)
    return ratings.rating_distribution(rows)


@register
def rating_distribution_exact(spark, sf):
    rows = reviews(spark, sf).withColumn("rating", F.col("rating") - (F.col("seq") % 4) / 4)
    return ratings.rating_distribution(rows, "exact")


@register
def rating_percentages(spark, sf):
    maps = ratings.rating_distribution(reviews(spark, sf)).select(P, ratings.rating_map("_star").alias("rating_distribution"))
    return ratings.rating_percentages(ratings.distribution_from_map(maps))


def document(spark, sf, **options):
    return analysis.analysis_document(reviews(spark, sf), **options)


def flat_document(doc):
    return doc.select(
        P, "total_reviews", "average_rating", "stars_5", "stars_1", "positive", "neutral", "negative", "bot_count", "bot_percentage",
        "suspicious_count", *[F.col(f"emotions.{e}").alias(e) for e in EMOTIONS["default"]],
        F.array_join(F.transform("keywords", lambda k: F.concat(k["word"], F.lit(":"), k["frequency"])), ",").alias("keywords"),
        F.array_join(F.transform("themes", lambda t: F.concat_ws("/", t["theme"], t["mentions"].cast("string"), t["sentiment"])), ",").alias("themes"),
        F.array_join(F.transform("review_samples.positive", lambda r: r["review_id"]), ",").alias("positive_samples"),
        F.array_join(F.transform("review_samples.negative", lambda r: r["review_id"]), ",").alias("negative_samples"),
        F.array_join(F.transform("review_samples.neutral", lambda r: r["review_id"]), ",").alias("neutral_samples"),
        joined("insights"), "summaries.overall",
    )


@register
def analysis_document(spark, sf):
    return flat_document(document(spark, sf))


def products(spark, sf):
    return items.product_info(dt.raw_items_from_documents(spark, sf), "live")


@register
def analysis_document_products(spark, sf):
    doc = document(spark, sf, products=products(spark, sf))
    texts = F.transform("review_samples.positive", lambda r: F.concat_ws(": ", r["title"], r["body"]))
    return flat_document(doc).join(doc.select(P, "product_title", "brand", "price", "image", F.md5(F.array_join(texts, "|").cast("binary")).alias("sample_texts")), P)


@register
def analysis_document_capped(spark, sf):
    doc = document(spark, sf, limit=30, with_samples=False)
    return doc.select(P, "total_reviews", "average_rating", "analyzed", "bot_total", "bot_count", "positive", "neutral", "negative")


@register
def analysis_document_ensemble(spark, sf):
    doc = variants.ensemble_document(reviews(spark, sf))
    return doc.select(
        P, "analyzed", "positive", "neutral", "negative", "avg_polarity", "avg_subjectivity", "avg_confidence", "joy", "neutral_share", "dominant_emotion",
        F.array_join(F.transform("themes", lambda t: F.concat(t["theme"], F.lit(":"), t["mentions"])), ",").alias("themes"),
        F.array_join(F.transform("keywords", lambda k: k["word"]), ",").alias("keywords"), joined("insights"), joined("recommendations"), "summary",
    )


@register
def analysis_document_free(spark, sf):
    doc = variants.free_document(reviews(spark, sf))
    return doc.select(
        P, "analyzed", "positive", "neutral", "negative", "avg_polarity", "avg_subjectivity", "avg_confidence",
        F.array_join(F.transform("themes", lambda t: F.concat_ws("/", t["theme"], t["mentions"].cast("string"), t["sentiment"])), ",").alias("themes"),
        joined("insights"), "summary", "confidence_level",
    )


@register
def analysis_document_api(spark, sf):
    doc = variants.api_document(reviews(spark, sf))
    return doc.select(
        P, "total_reviews", "average_rating", "stars_5", "stars_1", "positive", "neutral", "negative", "emotions.joy", "emotions.trust",
        joined("themes", ","), "verdict", joined("insights"), "summaries.overall",
    )


@register
def country_rollup(spark, sf):
    out = countries.country_rollup(mixed(spark, sf))
    return out.withColumn("successful_countries", joined("successful_countries", ",")).withColumn("failed_countries", joined("failed_countries", ","))


@register
def country_ratings(spark, sf):
    return countries.country_ratings(mixed(spark, sf))


@register
def review_context(spark, sf):
    return samples.review_context(scored(spark, sf))


@register
def review_context_short(spark, sf):
    return samples.review_context(scored(spark, sf), 5, 80).select(P, "review_texts")


# ---------------------------------------------------------------- growth
@register
def estimate_buyers(spark, sf):
    return snapshots(spark, sf).groupBy(P).agg(*[F.sum(c).alias(c) for c in ("estimated_buyers", "buyers_low", "buyers_high")])


def series(spark, sf, period):
    out = growth.growth_series(snapshots(spark, sf), AS_OF, period)
    return out.withColumn("step_ts", F.date_format("step_ts", "yyyy-MM-dd HH:mm"))


for _period in growth.PERIODS:
    QUERIES[f"growth_series_{_period}"] = lambda spark, sf, period=_period: series(spark, sf, period)


@register
def growth_points(spark, sf):
    return series(spark, sf, "month").drop("trend", "step_ts")


@register
def growth_trend(spark, sf):
    out = growth.growth_trend(growth.growth_points(snapshots(spark, sf), AS_OF, "month"))
    return out.withColumns(
        {"step_ts": F.date_format("step_ts", "yyyy-MM-dd HH:mm"), "previous_buyers": F.coalesce("previous_buyers", F.lit(0))}
    )


@register
def growth_metrics(spark, sf):
    seen = snapshots(spark, sf)
    return growth.growth_metrics(seen, AS_OF, products=seen).drop("recommendations", "next_week", "confidence")


@register
def growth_forecast(spark, sf):
    seen = snapshots(spark, sf)
    return growth.growth_metrics(seen, AS_OF, products=seen).select(P, "next_week", "confidence")


@register
def growth_recommendations(spark, sf):
    seen = snapshots(spark, sf)
    return growth.growth_metrics(seen, AS_OF, products=seen).select(P, joined("recommendations"))


def labels(spark, sf, period):
    return growth.period_labels(snapshots(spark, sf), AS_OF, period)


for _period in growth.LABEL_STEPS:
    QUERIES[f"period_labels_{_period}"] = lambda spark, sf, period=_period: labels(spark, sf, period)


# ---------------------------------------------------------------- samples, sets
@register
def review_samples(spark, sf):
    return samples.review_samples(scored(spark, sf)).select(P, "sentiment", "sample_rank", "review_id", "body")


@register
def review_samples_best(spark, sf):
    return samples.review_samples(scored(spark, sf), "best").select(P, "sentiment", "sample_rank", "review_id", "compound")


@register
def top_k_slices(spark, sf):
    words = keywords.top_keywords(reviews(spark, sf), top_n=8).select(P, F.lit("keyword").alias("kind"), "rank", F.col("word").alias("entry"))
    found = themes.keyword_themes(reviews(spark, sf), limit=3).select(P, F.lit("theme").alias("kind"), "rank", F.col("theme").alias("entry"))
    return words.unionByName(found)


@register
def union_countries(spark, sf):
    r = mixed(spark, sf)
    tables = {c: r.filter(F.col("country") == c).drop("country") for c in ("US", "UK", "DE", "CA")}
    return countries.union_countries(tables).select("review_id", P, "country")


@register
def first_available_country(spark, sf):
    rows = mixed(spark, sf)
    out = countries.first_available_country(rows).select("review_id", P, "country")
    asked = countries.first_available_country(rows, "DE").select("review_id", P, F.concat(F.lit("asked "), F.col("country")).alias("country"))
    return out.unionByName(asked)


# ---------------------------------------------------------------- insights
def analyzed(spark, sf):
    return document(spark, sf, with_samples=False)


@register
def insights_default(spark, sf):
    return analyzed(spark, sf).select(P, joined("insights"))


@register
def insights_ensemble(spark, sf):
    lines, advice, volume = insights.ensemble_insights()
    return analyzed(spark, sf).select(
        P, F.array_join(lines, " | ").alias("insights"), F.array_join(advice, " | ").alias("recommendations"), volume.alias("confidence")
    )


@register
def insights_free(spark, sf):
    return analyzed(spark, sf).select(P, F.array_join(insights.free_insights(), " | ").alias("insights"), insights.free_confidence().alias("confidence"))


@register
def insights_fallback(spark, sf):
    return analyzed(spark, sf).select(P, F.array_join(insights.fallback_insights(), " | ").alias("insights"))


@register
def insights_template(spark, sf):
    text, key, advice = insights.template_insights()
    return analyzed(spark, sf).select(P, text.alias("text"), F.array_join(key, " | ").alias("key_insights"), F.array_join(advice, " | ").alias("recommendations"))


def api_analysis(spark, sf):
    rows = scored(spark, sf)
    counts = rows.groupBy(P).agg(*ratings.rating_aggregates(), *sentiment.sentiment_aggregates())
    return counts.join(keywords.keyword_list(keywords.top_keywords(reviews(spark, sf), "api")), P, "left")


@register
def insights_api(spark, sf):
    verdict, lines = insights.api_insights()
    return api_analysis(spark, sf).select(P, verdict.alias("summary"), F.array_join(lines, " | ").alias("insights"))


@register
def parse_model_bullets(spark, sf):
    """The document texts stand in for answers; every seventh line becomes a bullet."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    answer = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda line, i: F.when(i % 7 == 0, F.concat(F.lit("- "), line)).when(i % 7 == 1, F.concat(F.lit("  2. You SHOULD note "), line))
            .when(i % 7 == 2, F.concat(F.lit("🎯 "), line)).when(i % 7 == 3, F.concat(F.lit("# "), line)).otherwise(line),
        ),
        "\n",
    )
    out = insights.parse_model_bullets(docs.select("doc_id", answer.alias("answer")))
    return out.select("doc_id", joined("bullets"), joined("key_lines"), joined("recommendations"))


@register
def summaries_default(spark, sf):
    return analyzed(spark, sf).select(P, "summaries.overall", "summaries.positive_highlights", "summaries.negative_highlights")


@register
def summaries_api(spark, sf):
    return api_analysis(spark, sf).select(P, summaries.api_summaries().alias("s")).select(P, "s.overall", "s.positive_highlights", "s.negative_highlights")


@register
def summary_ensemble(spark, sf):
    return analyzed(spark, sf).select(P, summaries.ensemble_summary().alias("summary"))


@register
def summary_free(spark, sf):
    return analyzed(spark, sf).select(P, summaries.free_summary().alias("summary"))


@register
def summary_fallback(spark, sf):
    return analyzed(spark, sf).select(P, summaries.fallback_summary().alias("summary"))


@register
def summary_dashboard(spark, sf):
    return analyzed(spark, sf).select(P, summaries.dashboard_summary().alias("summary"), summaries.share_text(F.col(P)).alias("share"))


# ---------------------------------------------------------------- report
@register
def report_summary_section(spark, sf):
    return report.report_summary_section(document(spark, sf, with_samples=False, products=products(spark, sf)))


@register
def report_keywords(spark, sf):
    return report.report_keywords(analyzed(spark, sf))


@register
def report_themes(spark, sf):
    return report.report_themes(analyzed(spark, sf))


@register
def report_insights(spark, sf):
    return report.report_insights(analyzed(spark, sf))


@register
def report_rating_section(spark, sf):
    return report.report_rating_section(ratings.rating_distribution(reviews(spark, sf)))


@register
def report_reviews_section(spark, sf):
    rows = bots.bot_score(scored(spark, sf))
    return report.report_reviews_section(rows)


@register
def report_pdf_sections(spark, sf):
    tables = report.report_pdf_sections(analyzed(spark, sf))
    parts = [
        tables["sentiment"].select(P, F.lit("sentiment").alias("section"), F.col("sentiment").alias("name"), F.concat_ws(" ", F.col("count").cast("string"), "percentage").alias("value")),
        tables["bots"].select(P, F.lit("bots").alias("section"), F.col("metric").alias("name"), "value"),
        tables["themes"].select(P, F.lit("themes").alias("section"), F.col("theme").alias("name"), F.concat_ws(" ", F.col("mentions").cast("string"), "sentiment").alias("value")),
        tables["ratings"].select(P, F.lit("ratings").alias("section"), F.col("rating").alias("name"), F.col("count").cast("string").alias("value")),
        tables["keywords"].select(P, F.lit("keywords").alias("section"), F.col("word").alias("name"), F.concat_ws(" ", F.col("rank").cast("string"), F.col("frequency").cast("string")).alias("value")),
        tables["insights"].select(P, F.lit("insights").alias("section"), F.col("position").cast("string").alias("name"), F.col("insight").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register
def write_report(spark, sf):
    """Write all six sections and read them back: rows, and a digest of each small section's content by product."""
    rows = bots.bot_score(scored(spark, sf))
    paths = report.write_whole_report(document(spark, sf, with_samples=False, products=products(spark, sf)), rows, new_path(spark, "report"), AS_OF, "parquet")
    out = None
    for section, order in (("summary", "ordinal"), ("keywords", "rank"), ("themes", "rank"), ("insights", "position"), ("ratings", "rating"), ("reviews", None)):
        table = spark.read.parquet(paths[section])
        columns = [c for c in ("metric", "value", "word", "frequency", "theme", "mentions", "sentiment", "insight", "rating", "count") if c in table.columns]
        line = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "|") if order else F.lit("")
        read = table.groupBy(P).agg(F.lit(section).alias("section"), F.count("*").alias("n"), F.md5(lines.cast("binary")).alias("digest"))
        out = read if out is None else out.unionByName(read)
    return out


# ---------------------------------------------------------------- streams
@register
def stream_growth_days(spark, sf):
    table = spark.read.parquet(f"{sf}/events.parquet")
    events = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = run_available(stream_growth(dt.snapshot_columns(events)), "growth")
    return out.select(
        P, F.col("date").cast("string").alias("date"), "snapshots", "mean_buyers", rounding.round_exact(F.col("mean_rating"), 4).alias("mean_rating")
    )


@register
def stream_scored_reviews(spark, sf):
    path = new_path(spark, "landed")
    dt.raw_items_from_documents(spark, sf).write.json(path)
    stream = spark.readStream.schema(schema.RAW_ITEM).json(path)
    out = run_available(stream_score_reviews(stream), "scored-stream")
    return out.select("review_id", "bot_score", "compound", "sentiment", "joy", "sadness", "neutral")


@register
def stream_bulk_posting_days(spark, sf):
    path = new_path(spark, "landed")
    reviews(spark, sf).write.parquet(path)
    stream = spark.readStream.schema(reviews(spark, sf).schema).parquet(path)
    out = run_available(stream_bulk_days(stream), "bulk-stream")
    return out.withColumn("date", F.col("date").cast("string"))


@register
def stream_growth_all_days(spark, sf):
    """Open days too: a day's row is replaced for as long as snapshots arrive."""
    table = spark.read.parquet(f"{sf}/events.parquet")
    events = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = run_latest(stream_growth(dt.snapshot_columns(events)), [P, "date"], "growth-all")
    return out.select(
        P, F.col("date").cast("string").alias("date"), "snapshots", "mean_buyers", rounding.round_exact(F.col("mean_rating"), 4).alias("mean_rating")
    )


@register
def stream_bulk_posting_all(spark, sf):
    """The bulk rule on a stream, undated reviews included: every seventh review has no date here."""
    path = new_path(spark, "landed")
    rows = reviews(spark, sf).withColumn("review_date", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("review_date")))
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return run_latest(stream_bulk_state(stream), [P, "day"], "bulk-all").where("bulk").drop("bulk")
