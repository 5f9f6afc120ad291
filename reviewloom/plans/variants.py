"""The analyses of the other variants: ``api``, ``ensemble`` and ``free``.

Each is one row per product: one ``groupBy`` over the scored reviews, joined
with the top keywords.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.ratings import STARS
from reviewloom.functions.rounding import round_exact
from reviewloom.lexicon import SEED_LEXICON, Entry
from reviewloom.operators import emotions, insights, keywords, ratings, sentiment, summaries, themes
from reviewloom.operators.ranking import PRODUCT

MEANS = ("polarity", "subjectivity", "confidence")


def _means() -> dict:
    return {f"avg_{c}": round_exact(sentiment.mean_of(c), 3) for c in MEANS}


def _visible(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    hidden = [c for c in df.columns if c not in keys and c.startswith(("__", "mentions_"))]
    return df.drop(*hidden)


def ensemble_document(
    reviews: DataFrame, lexicon: Sequence[Entry] = SEED_LEXICON, external: tuple[str, str] | None = None,
    keys: Sequence[str] = PRODUCT,
) -> DataFrame:
    """Weighted vote, mean emotions, counted themes, keywords with weight, insights and summary."""
    rows = sentiment.skip_blank(reviews)
    scored = sentiment.ensemble_vote(sentiment.lexicon_sentiment(rows, lexicon=lexicon), external=external)
    scored = themes.with_occurrences(emotions.emotion_review(scored, "ensemble"))
    sums = scored.groupBy(*keys).agg(
        *sentiment.sentiment_aggregates(), *emotions.average_aggregates("ensemble"), *themes.occurrence_aggregates()
    )
    words = keywords.keyword_list(keywords.top_keywords(rows, "ensemble", keys=keys), keys)
    # the emotion "neutral" is called neutral_share beside the label count "neutral"
    names = {e: "neutral_share" if e == "neutral" else e for e in emotions.average_names("ensemble")}
    scores = {names[e]: c for e, c in emotions.average_scores("ensemble", "analyzed").items()}
    out = sums.withColumns({**_means(), **scores})
    mood = F.regexp_replace(emotions.dominant(list(names.values())), "_share$", "")
    out = out.withColumns({"themes": themes.occurrence_array(), "dominant_emotion": mood}).join(words, list(keys), "left")
    lines, advice, volume = insights.ensemble_insights()
    return _visible(
        out.withColumns({"insights": lines, "recommendations": advice, "confidence": volume, "summary": summaries.ensemble_summary()}), keys
    )


def free_document(
    reviews: DataFrame, lexicon: Sequence[Entry] = SEED_LEXICON, keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Text-only scores (three decimals), aspect themes, keywords, insights and summary."""
    rows = sentiment.skip_blank(reviews, "body")
    scored = sentiment.score_sentiment(rows, form="body", lexicon=lexicon)
    rounded = scored.withColumns({c: round_exact(F.col(c), 3) for c in MEANS})
    sums = rounded.groupBy(*keys).agg(*sentiment.sentiment_aggregates())
    entry = F.struct("rank", "theme", "mentions", "sentiment", "confidence", "keywords")
    aspects = themes.aspect_themes(scored, keys).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("themes"))
    words = keywords.keyword_list(keywords.top_keywords(rows, "free", keys=keys), keys)
    out = sums.withColumns(_means()).join(aspects, list(keys), "left").join(words, list(keys), "left")
    return _visible(
        out.withColumns(
            {"insights": insights.free_insights(), "summary": summaries.free_summary(), "confidence_level": insights.free_confidence()}
        ),
        keys,
    )


def api_document(
    reviews: DataFrame, lexicon: Sequence[Entry] = SEED_LEXICON, keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Exact star counts, labels, weighted emotions, theme names, keywords, insights and long summaries."""
    scored = themes.with_label_flags(emotions.emotion_hits(sentiment.score_sentiment(reviews, lexicon=lexicon), "api"))
    exact = [F.count_if(F.col("rating") == s).alias(f"stars_{s}") for s in STARS]
    sums = scored.groupBy(*keys).agg(
        *ratings.rating_aggregates()[:2], *exact, *sentiment.sentiment_aggregates(), *emotions.api_aggregates(),
        *themes.label_aggregates(),
    )
    words = keywords.keyword_list(keywords.top_keywords(reviews, "api", keys=keys), keys)
    out = sums.withColumns(
        {
            "emotions": F.struct(*[c.alias(e) for e, c in emotions.api_scores("analyzed").items()]),
            "themes": F.transform(themes.label_array(), lambda t: t["theme"]),
        }
    ).join(words, list(keys), "left")
    verdict, lines = insights.api_insights()
    out = out.withColumns({"verdict": verdict, "insights": lines, "summaries": summaries.api_summaries()})
    return _visible(out.withColumn("average_rating", round_exact(F.col("average_rating"), 2)), keys)
