"""Fake-review scoring: nine row rules, one group rule, statistics, filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.dictionaries import GENERIC_PHRASES, SUSPICIOUS_AUTHOR_PATTERNS, SUSPICIOUS_TEXT_PATTERNS
from reviewloom.functions.binding import let
from reviewloom.functions.rounding import percent, round_exact
from reviewloom.functions.text import any_match, count_contained, scoring_text, split_space
from reviewloom.operators.ranking import PRODUCT, join_group_facts

# Rule name and weight in tenths, in rule order.
RULES = [
    ("very_short", 3),
    ("short_5star", 2),
    ("suspicious_pattern", 4),
    ("too_generic", 3),
    ("unverified_extreme", 2),
    ("no_engagement", 1),
    ("suspicious_author", 3),
    ("excessive_formatting", 2),
    ("repetitive", 3),
]
BULK_RULE = ("bulk_posting_same_rating", 2)
BULK_MIN_REVIEWS = 5
BOT_THRESHOLD = 0.6
SUSPICIOUS_FROM = 0.3
COLUMNS = ["bot_score", "is_bot_likely", "bot_indicators", "bot_analysis"]


def suspicious_author(author: Column) -> Column:
    """Author name built like a generated account; an empty name is not suspicious."""
    return F.coalesce(any_match(F.lower(author), SUSPICIOUS_AUTHOR_PATTERNS), F.lit(False))


def repetitive(text: Column) -> Column:
    """One token makes up more than 30 % of a text of more than five tokens.

    In the sorted tokens a word with ``m`` copies fills ``m`` places in a row,
    so it is enough to compare each place with the one ``m - 1`` further.
    """
    words = F.sort_array(split_space(text))

    def long_run(sorted_words: Column) -> Column:
        total = F.size(sorted_words)
        needed = (F.floor(total * F.lit(0.3)) + 1).cast("int")
        starts = F.sequence(F.lit(0), total - needed)
        return (total > 5) & F.exists(
            starts, lambda s: F.get(sorted_words, s) == F.get(sorted_words, s + needed - 1)
        )

    return let(words, long_run)


def _rule_conditions() -> dict[str, Column]:
    text, rating = F.col("__text"), F.coalesce(F.col("rating"), F.lit(0.0))
    length = F.length(text)
    verified = F.coalesce(F.col("verified"), F.lit(False))
    helpful = F.coalesce(F.col("helpful_count"), F.lit(0))
    marks = length - F.length(F.replace(text, F.lit("!"), F.lit("")))
    return {
        "very_short": length < 10,
        "short_5star": (length < 30) & (rating == 5),
        "suspicious_pattern": any_match(text, SUSPICIOUS_TEXT_PATTERNS),
        "too_generic": (length < 100) & (count_contained(text, GENERIC_PHRASES) >= 3),
        "unverified_extreme": ~verified & rating.isin(5.0, 1.0),
        "no_engagement": (helpful == 0) & (length < 50),
        "suspicious_author": suspicious_author(F.col("author")),
        "excessive_formatting": marks > 5,
        "repetitive": repetitive(text),
    }


def bot_score(reviews: DataFrame) -> DataFrame:
    """Row rules only: score (capped at 1), decision, fired rules, confidence.

    Scores are summed in integer tenths, so the thresholds are exact.
    """
    rules = _rule_conditions()
    flagged = reviews.withColumn("__text", scoring_text()).withColumns({f"__{n}": rules[n] for n, _ in RULES})
    tenths = sum((F.when(F.col(f"__{n}"), w).otherwise(0) for n, w in RULES), F.lit(0))
    fired = F.array_compact(F.array(*[F.when(F.col(f"__{n}"), n) for n, _ in RULES]))
    scored = flagged.select(
        *reviews.columns, F.least(tenths, F.lit(10)).alias("__tenths"), fired.alias("bot_indicators")
    )
    score = F.col("__tenths") / 10.0
    return scored.select(
        *reviews.columns,
        score.alias("bot_score"),
        (score >= BOT_THRESHOLD).alias("is_bot_likely"),
        "bot_indicators",
        F.struct(
            score.alias("score"), bot_confidence(score).alias("confidence"), F.col("bot_indicators").alias("indicators")
        ).alias("bot_analysis"),
    )


def bot_confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def date_part() -> Column:
    return F.element_at(F.split(F.col("review_date"), "T"), 1)


def bulk_days(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Product-days with at least five reviews that all carry one rating."""
    rating = F.coalesce(F.col("rating"), F.lit(0.0))
    days = reviews.select(*keys, date_part().alias("__day"), rating.alias("__rating")).filter(F.col("__day").isNotNull())
    grouped = days.groupBy(*keys, "__day").agg(
        F.count("*").alias("__n"), F.min("__rating").alias("__low"), F.max("__rating").alias("__high")
    )
    return grouped.filter((F.col("__n") >= BULK_MIN_REVIEWS) & (F.col("__low") == F.col("__high"))).select(
        *keys, "__day", "__n", F.lit(True).alias("__bulk")
    )


def bulk_posting(
    scored: DataFrame, source: DataFrame | None = None, keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Add the group rule to scored reviews.

    The group facts come from a partial aggregation of two narrow columns;
    ``source`` may name the unscored reviews so that only those are read for it.
    The nested score and confidence keep their row-rule values, the nested
    indicator list gains the entry.
    """
    facts = bulk_days(scored if source is None else source, keys)
    rows = scored.withColumn("__day", date_part())
    joined = join_group_facts(rows, facts, [*keys, "__day"], ["__bulk"])
    bulk = F.coalesce(F.col("__bulk"), F.lit(False))
    tenths = F.round(F.col("bot_score") * 10).cast("int")
    score = F.when(bulk, F.least(tenths + BULK_RULE[1], F.lit(10)) / 10.0).otherwise(F.col("bot_score"))
    names = F.when(bulk, F.array_append("bot_indicators", F.lit(BULK_RULE[0]))).otherwise(F.col("bot_indicators"))
    rest = [c for c in scored.columns if c not in COLUMNS]
    return joined.select(
        *rest,
        score.alias("bot_score"),
        F.when(bulk, score >= BOT_THRESHOLD).otherwise(F.col("is_bot_likely")).alias("is_bot_likely"),
        names.alias("bot_indicators"),
        F.struct(
            F.col("bot_analysis.score").alias("score"),
            F.col("bot_analysis.confidence").alias("confidence"),
            names.alias("indicators"),
        ).alias("bot_analysis"),
    )


def analyze_bots(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Row rules plus the bulk-posting rule."""
    return bulk_posting(bot_score(reviews), reviews, keys)


def bot_aggregates() -> list[Column]:
    """Counts behind the statistics, for use in any ``agg``."""
    score, bot = F.col("bot_score"), F.col("is_bot_likely")
    return [
        F.count("*").alias("bot_total"),
        F.count_if(bot).alias("bot_count"),
        F.count_if((score >= SUSPICIOUS_FROM) & (score < BOT_THRESHOLD)).alias("suspicious_count"),
    ]


def bot_percentage(part: Column, total: Column) -> Column:
    return round_exact(percent(part, total), 1)


def bot_statistics(scored: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    stats = scored.groupBy(*keys).agg(*bot_aggregates())
    return stats.select(
        *keys,
        F.col("bot_total").alias("total_reviews"),
        (F.col("bot_total") - F.col("bot_count")).alias("genuine_count"),
        "bot_count",
        bot_percentage(F.col("bot_count"), F.col("bot_total")).alias("bot_percentage"),
        "suspicious_count",
        F.col("bot_count").alias("filtered_count"),
    )


def filter_genuine(scored: DataFrame) -> DataFrame:
    return scored.filter(~F.col("is_bot_likely"))


def filter_bots(scored: DataFrame, threshold: float = BOT_THRESHOLD) -> DataFrame:
    return scored.filter(F.col("bot_score") < F.lit(float(threshold)))
