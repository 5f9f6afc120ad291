"""Row rules on a stream of new reviews, and the bulk rule per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.lexicon import SEED_LEXICON, Entry
from reviewloom.operators.bots import BULK_MIN_REVIEWS, bot_score, date_part
from reviewloom.operators.emotions import emotion_review
from reviewloom.operators.ranking import PRODUCT
from reviewloom.operators.sentiment import score_sentiment
from reviewloom.sources.items import canonicalize_reviews, raw_reviews_only
from reviewloom.streaming.days import day_of, wall_clock


def stream_score_reviews(
    items: DataFrame, raw: bool = True, variant: str = "ensemble", lexicon: Sequence[Entry] = SEED_LEXICON
) -> DataFrame:
    """Canonical reviews with bot score, sentiment and emotions; needs no state."""
    reviews = canonicalize_reviews(raw_reviews_only(items), "stream", raw=True) if raw else items
    return emotion_review(score_sentiment(bot_score(reviews), lexicon=lexicon), variant)


def stream_bulk_days(reviews: DataFrame, delay: str = "1 day", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Product-days with five reviews of one rating, emitted when the day has closed.

    Reviews whose date is no timestamp are left out; ``stream_bulk_state`` has them.
    """
    days = reviews.withColumn("ts", wall_clock(F.col("review_date").try_cast("timestamp"))).withWatermark("ts", delay)
    rating = F.coalesce(F.col("rating"), F.lit(0.0))
    sums = days.groupBy(*keys, F.window("ts", "1 day").alias("window")).agg(
        F.count("*").alias("reviews"), F.min(rating).alias("low"), F.max(rating).alias("high")
    )
    return sums.filter((F.col("reviews") >= BULK_MIN_REVIEWS) & (F.col("low") == F.col("high"))).select(
        *keys, day_of().alias("date"), "reviews", F.col("low").alias("rating")
    )


def stream_bulk_state(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Groups (keys, day) of five reviews and more, and whether they carry one rating so far (``bulk``), as the batch rule has them.

    A day is the text before ``T``, so undated reviews form the day ``''``. The
    state has no event time: one small row for each product and day, kept for good,
    and a group changes whenever a review of it arrives. For ``run_latest``.
    """
    rating = F.coalesce(F.col("rating"), F.lit(0.0))
    days = reviews.select(*keys, date_part().alias("day"), rating.alias("rating")).where(F.col("day").isNotNull())
    sums = days.groupBy(*keys, "day").agg(F.count("*").alias("reviews"), F.min("rating").alias("low"), F.max("rating").alias("high"))
    return sums.where(F.col("reviews") >= BULK_MIN_REVIEWS).select(*keys, "day", "reviews", F.col("low").alias("rating"), (F.col("low") == F.col("high")).alias("bulk"))
