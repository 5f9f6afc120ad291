"""Emotion scores from keyword dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.dictionaries import EMOTIONS
from reviewloom.functions.rounding import round_exact
from reviewloom.functions.text import analysis_text, count_contained
from reviewloom.operators.ranking import PRODUCT
from reviewloom.operators.sentiment import mean_of

API_HIT = 0.15
UNIT = 1e9


def text_form(variant: str) -> str:
    return "body" if variant == "free" else "title_body"


def emotion_names(variant: str) -> list[str]:
    return list(EMOTIONS[variant])


def emotion_hits(reviews: DataFrame, variant: str = "default") -> DataFrame:
    """Add ``hits_<emotion>``: dictionary words that occur as substrings."""
    low = reviews.withColumn("__low", F.lower(analysis_text(text_form(variant))))
    return low.withColumns(
        {f"hits_{e}": count_contained(F.col("__low"), words) for e, words in EMOTIONS[variant].items()}
    ).drop("__low")


def emotion_review(reviews: DataFrame, variant: str = "ensemble") -> DataFrame:
    """Per review: hits over dictionary size, three decimals; ``neutral`` when nothing hit."""
    hits = emotion_hits(reviews, variant)
    names = emotion_names(variant)
    scores = {e: round_exact(F.col(f"hits_{e}") / float(len(EMOTIONS[variant][e])), 3) for e in names}
    out = hits.withColumns(scores)
    if variant == "ensemble":
        nothing = sum((F.col(f"hits_{e}") for e in names), F.lit(0)) == 0
        out = out.withColumn("neutral", F.when(nothing, 1.0).otherwise(0.0))
    return out.drop(*[f"hits_{e}" for e in names])


def average_names(variant: str) -> list[str]:
    return emotion_names(variant) + (["neutral"] if variant == "ensemble" else [])


def average_aggregates(variant: str = "ensemble") -> list[Column]:
    """Exact sums of the review scores for use in any ``agg``."""
    return [F.sum(F.round(F.col(e) * 1000).cast("long")).alias(f"__sum_{e}") for e in average_names(variant)]


def average_scores(variant: str, total: str) -> dict[str, Column]:
    return {
        e: round_exact(F.col(f"__sum_{e}").cast("double") / 1000.0 / F.col(total), 3) for e in average_names(variant)
    }


def emotion_average(scored: DataFrame, variant: str = "ensemble", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Mean of the review scores, three decimals, over a fixed set of emotions."""
    sums = scored.groupBy(*keys).agg(F.count("*").alias("__n"), *average_aggregates(variant))
    return sums.select(*keys, *[c.alias(e) for e, c in average_scores(variant, "__n").items()])


def emotion_aggregates(variant: str = "default", where: Column | None = None) -> list[Column]:
    """Sums of hits for use in any ``agg``; needs the ``hits_`` columns."""
    keep = F.lit(True) if where is None else where
    return [F.sum(F.when(keep, F.col(f"hits_{e}")).otherwise(0)).alias(f"__hits_{e}") for e in emotion_names(variant)]


def corpus_scores(total: str = "analyzed") -> dict[str, Column]:
    """Emotions of the default variant from summed hits and the mean polarity.

    Hits over twice the number of reviews, at most 1; a positive mean polarity
    lifts joy and trust, a negative one sadness and anger.
    """
    mood = mean_of("polarity", total)
    count = F.when(F.col(total) == 0, 1).otherwise(F.col(total))
    lift = {
        "joy": F.when(mood > 0, 0.2), "trust": F.when(mood > 0, 0.15),
        "sadness": F.when(mood < 0, 0.15), "anger": F.when(mood < 0, 0.1),
    }
    out = {}
    for emotion in emotion_names("default"):
        score = F.least(F.col(f"__hits_{emotion}").cast("double") / (count * 2).cast("double"), F.lit(1.0))
        if emotion in lift:
            score = F.when(lift[emotion].isNotNull(), F.least(score + lift[emotion], F.lit(1.0))).otherwise(score)
        out[emotion] = score
    return out


def emotion_corpus(scored: DataFrame, variant: str = "default", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Emotions of a product; needs ``polarity`` (default) or ``compound`` (api)."""
    hits = emotion_hits(scored, variant)
    if variant == "default":
        polarity = F.sum(F.round(F.col("polarity") * UNIT).cast("long")).alias("__sum_polarity")
        sums = hits.groupBy(*keys).agg(F.count("*").alias("analyzed"), polarity, *emotion_aggregates())
        return sums.select(*keys, *[c.alias(e) for e, c in corpus_scores().items()])
    sums = hits.groupBy(*keys).agg(F.count("*").alias("__n"), *api_aggregates())
    return sums.select(*keys, *[c.alias(e) for e, c in api_scores("__n").items()])


def api_aggregates() -> list[Column]:
    """Per review 0.15 a hit, weighted by the compound score, at most 1; needs the ``hits_`` columns."""
    weight = 1.0 + F.abs("compound")
    return [
        F.sum(F.round(F.least(F.col(f"hits_{e}") * API_HIT * weight, F.lit(1.0)) * UNIT).cast("long")).alias(f"__api_{e}")
        for e in emotion_names("api")
    ]


def api_scores(total: str) -> dict[str, Column]:
    return {
        e: round_exact(F.col(f"__api_{e}").cast("double") / UNIT / F.col(total), 3) for e in emotion_names("api")
    }


def dominant(names: Sequence[str]) -> Column:
    """Name of the highest score; the first of equal ones."""
    top = F.greatest(*names)
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.col(name) == top, name).otherwise(out)
    return out


def dominant_emotion(emotions: DataFrame, names: Sequence[str], keys: Sequence[str] = PRODUCT) -> DataFrame:
    return emotions.select(*keys, dominant(names).alias("dominant_emotion"), F.greatest(*names).alias("score"))


def emotion_rows(emotions: DataFrame, names: Sequence[str], keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Scores as rows with a capitalized name."""
    pairs = ", ".join(f"'{n.capitalize()}', `{n}`" for n in names)
    return emotions.select(*keys, F.expr(f"stack({len(names)}, {pairs}) as (emotion, value)"))
