"""Rating helpers: parsing, validity, bands, labels, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.rounding import fixed
from reviewloom.functions.text import SPACE_CLASS, strip

STARS = (5, 4, 3, 2, 1)
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_rating(text: Column) -> Column:
    """``"4.0 out of 5 stars"`` or ``"4"`` -> 4.0; missing or empty -> 0; else NULL."""
    raw = strip(F.coalesce(text.cast("string"), F.lit("0")))
    first = F.element_at(F.split(raw, SPACE_CLASS + "+"), 1)
    number = F.when(first.rlike(NUMBER_PATTERN), first)
    return F.when(raw == "", F.lit(0.0)).otherwise(number.try_cast("double"))


def valid_rating(rating: Column) -> Column:
    return F.coalesce(rating.between(1, 5), F.lit(False))


def star_bucket(rating: Column) -> Column:
    """Nearest star: 4.5 and more is 5, below 1.5 (also 0) is 1."""
    return (
        F.when(rating >= 4.5, 5).when(rating >= 3.5, 4).when(rating >= 2.5, 3).when(rating >= 1.5, 2).otherwise(1)
    )


def rating_band(rating: Column, mode: str = "range") -> Column:
    """Display band 1 (worst) to 5 (best); ``exact`` bands whole stars only."""
    if mode == "exact":
        return F.when(rating.isin(5.0, 4.0, 3.0, 2.0), rating.cast("int")).otherwise(1)
    return F.when(rating >= 4.5, 5).when(rating >= 4.0, 4).when(rating >= 3.0, 3).when(rating >= 2.0, 2).otherwise(1)


def rating_sentiment(rating: Column, positive: float = 4.0, negative: float = 2.5) -> Column:
    return F.when(rating >= positive, "positive").when(rating <= negative, "negative").otherwise("neutral")


def display_number(value: Column) -> Column:
    return F.format_number(value, 0)


def display_percent(value: Column) -> Column:
    return F.concat(fixed(value, 1, ties="up"), F.lit("%"))


def display_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def parse_review_date(text: Column) -> Column:
    """Date after the last ``on``, as ``January 5, 2024``; NULL when it does not parse."""
    tail = strip(F.element_at(F.split(F.coalesce(text, F.lit("")), "on"), -1))
    value = F.when(F.coalesce(text, F.lit("")).contains("on"), tail).otherwise(text)
    # A month name that itself ends in "on" does not exist, so the split is safe.
    return F.try_to_timestamp(value, F.lit("MMMM d, yyyy"))
