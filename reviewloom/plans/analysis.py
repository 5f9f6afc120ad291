"""The analysis of all products: score once, aggregate once, join small tables.

Steps: (1) row rules, sentiment, emotions and theme flags are computed where a
review is read, and what is left of it without its texts is joined with the bulk
rule and written once to the shared folder; (2) one ``groupBy`` over this narrow
table computes ratings, bot statistics, label counts, emotions and themes together;
(3) keywords come from a second look at the texts, in which nothing but the bot
rules is computed again; (4) samples are chosen by id from the narrow table, and
only their texts are fetched, at the end; (5) the sections are joined on the product.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.rounding import round_exact
from reviewloom.lexicon import SEED_LEXICON, Entry
from reviewloom.operators import bots, emotions, insights, keywords, ratings, samples, sentiment, summaries, themes
from reviewloom.operators.ranking import PRODUCT, max_reviews
from reviewloom.sources.shared import materialize

IDENTITY = ["review_id", "seq", "rating", "review_date"]
#: Counters of single themes and moods, from which the sections are made.
INTERNAL = re.compile(r"(mentions|positive|negative|neutral|hits|theme)_\d+")
SAMPLE_FIELDS = ["review_id", "title", "body", "rating", "review_date", "sentiment", "compound"]


def score_table(
    reviews: DataFrame, filter_bots: bool = True, lexicon: Sequence[Entry] = SEED_LEXICON, keys: Sequence[str] = PRODUCT,
) -> DataFrame:
    """Everything that is known of a review without its texts: keys, identity, rating, scores, label, bot columns, hits and flags."""
    rows = sentiment.score_sentiment(reviews, lexicon=lexicon)
    rows = bots.bot_score(rows) if filter_bots else rows.withColumns({"bot_score": F.lit(0.0), "is_bot_likely": F.lit(False)})
    rows = themes.with_theme_flags(emotions.emotion_hits(rows))
    own = [*dict.fromkeys([*keys, *IDENTITY])]
    narrow = rows.select(*own, *[c for c in rows.columns if c not in reviews.columns and c not in own])
    return bots.bulk_posting(narrow, reviews, keys) if filter_bots else narrow


def product_aggregates(scores: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Everything that one pass over the score table can count.

    Ratings and bot statistics cover all reviews, the rest the genuine ones.
    """
    genuine = ~F.col("is_bot_likely")
    return scores.groupBy(*keys).agg(
        *ratings.rating_aggregates(),
        *bots.bot_aggregates(),
        *sentiment.sentiment_aggregates(genuine),
        *emotions.emotion_aggregates("default", genuine),
        *themes.theme_aggregates(genuine),
    )


def sample_texts(reviews: DataFrame, scores: DataFrame, size: int = 3, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """The first genuine reviews of each label with their texts, which are fetched for the chosen ones only.

    A review is known by its keys, id and number; of rows that agree in all of
    them one is taken.
    """
    genuine = bots.filter_genuine(scores).select(*keys, *[c for c in IDENTITY if c not in keys], "sentiment", "compound")
    picked = materialize(samples.review_samples(genuine, "first", size, keys), "samples")
    same = [*keys, "review_id", "seq"]
    texts = reviews.select(*[F.col(c).alias(f"__{c}") for c in same], "title", "body")
    condition = F.lit(True)
    for c in same:
        condition = condition & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return picked.join(texts, condition).drop(*[f"__{c}" for c in same]).dropDuplicates([*keys, "sentiment", "sample_rank"])


def analysis_document(
    reviews: DataFrame,
    limit: int | None = None,
    filter_bots: bool = True,
    top_n: int = 15,
    with_samples: bool = True,
    write_once: bool = True,
    lexicon: Sequence[Entry] = SEED_LEXICON,
    keys: Sequence[str] = PRODUCT,
    products: DataFrame | None = None,
) -> DataFrame:
    """One row per product with all sections of the default analysis.

    With ``limit`` only the first reviews of a product are analyzed (the
    request cap), while count, mean and star counts stay those of all reviews.
    ``products`` (``product_id`` and the facts of ``product_info``) adds
    product_title, brand, price and image; a product that it lacks has none.
    """
    chosen = reviews if limit is None else max_reviews(reviews, limit, keys)
    scores = score_table(chosen, filter_bots, lexicon, keys)
    if write_once:
        scores = materialize(scores, "scores")
    sums = product_aggregates(scores, keys)
    if limit is not None:
        stars = [c for c in ("total_reviews", "average_rating", *[f"stars_{s}" for s in ratings.STARS])]
        sums = sums.drop(*stars).join(reviews.groupBy(*keys).agg(*ratings.rating_aggregates()), list(keys))
    judged = bots.bulk_posting(bots.bot_score(chosen), chosen, keys) if filter_bots else chosen.withColumn("is_bot_likely", F.lit(False))
    genuine = bots.filter_genuine(judged)
    words = keywords.keyword_list(keywords.top_keywords(genuine, "default", top_n, keys), keys)
    out = sums.withColumn("themes", themes.theme_array()).join(words, list(keys), "left")
    if with_samples:
        picked = sample_texts(chosen, scores, 3, keys)
        out = out.join(samples.sample_lists(picked, [f for f in SAMPLE_FIELDS if f != "sentiment"], keys), list(keys), "left")
    scores = emotions.corpus_scores()
    out = out.withColumns(
        {
            "bot_percentage": bots.bot_percentage(F.col("bot_count"), F.col("bot_total")),
            "emotions": F.struct(*[c.alias(e) for e, c in scores.items()]),
            "rating_distribution": ratings.rating_map(),
            "avg_polarity": round_exact(sentiment.mean_of("polarity"), 3),
            "avg_subjectivity": round_exact(sentiment.mean_of("subjectivity"), 3),
            "avg_confidence": round_exact(sentiment.mean_of("confidence"), 3),
            "dominant_emotion": emotions.dominant([f"__hits_{e}" for e in emotions.emotion_names("default")]),
        }
    )
    out = out.withColumn("dominant_emotion", F.regexp_replace("dominant_emotion", "^__hits_", ""))
    out = out.withColumn("insights", insights.default_insights(filter_bots)).withColumn("summaries", summaries.default_summaries())
    if products is not None:
        facts = products.select(F.col("product_id").alias("__product"), F.col("title").alias("product_title"), "brand", "price", "image")
        out = out.join(facts, F.col(keys[0]).eqNullSafe(F.col("__product")), "left")
    internal = [c for c in out.columns if c.startswith("__") or INTERNAL.fullmatch(c)]
    return out.drop(*[c for c in internal if c not in keys])
