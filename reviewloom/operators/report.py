"""Report sections as tables, one row set per product, and their writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.ratings import STARS
from reviewloom.functions.rounding import fixed, percent, plain
from reviewloom.operators.ranking import PRODUCT
from reviewloom.sources.shared import materialize

# Columns of the review sheet and size of the tables.
REVIEW_COLUMNS = ["title", "text", "rating", "author", "date", "sentiment", "verified", "bot_score"]
REVIEW_NAMES = {"text": "body", "date": "review_date"}
PDF_KEYWORDS, PDF_THEMES = 15, 10


def _rows(df: DataFrame, keys: Sequence[str], entries: Sequence[tuple[str, Column, Column | None]]) -> DataFrame:
    """Entries ``(metric, value, condition)`` as ordered rows."""
    structs = []
    for place, (metric, value, condition) in enumerate(entries):
        row = F.struct(F.lit(place).alias("ordinal"), F.lit(metric).alias("metric"), value.cast("string").alias("value"))
        structs.append(row if condition is None else F.when(condition, row))
    return df.select(*keys, F.explode(F.array_compact(F.array(*structs))).alias("row")).select(*keys, "row.*")


def report_summary_section(analysis: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """``(ordinal, metric, value)`` rows; a section shows only when it has data."""
    names = set(analysis.columns)

    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in names else F.lit(default)

    total = F.col("positive") + F.col("neutral") + F.col("negative")
    blank, some = F.lit(""), F.col("positive").isNotNull()
    entries = [
        ("ASIN", F.col(keys[0]), None),
        ("Product Title", text("product_title", "N/A"), None),
        ("Brand", text("brand", "N/A"), None),
        ("Total Reviews", F.col("total_reviews"), None),
        ("Average Rating", plain(F.col("average_rating")), None),
        ("Country", text("country", "US"), None),
        ("Data Source", text("source", "unknown"), None),
        ("AI Provider", text("provider", "N/A"), None),
        ("", blank, None),
        ("Sentiment Analysis", blank, some),
        ("Positive Reviews", F.col("positive"), some),
        ("Neutral Reviews", F.col("neutral"), some),
        ("Negative Reviews", F.col("negative"), some),
        ("Positive %", F.concat(fixed(percent(F.col("positive"), total)), F.lit("%")), some & (total > 0)),
        ("", blank, some),
    ]
    return _rows(analysis, keys, entries + _bot_entries(F.col("bot_total").isNotNull()))


def _bot_entries(condition: Column) -> list[tuple[str, Column, Column | None]]:
    return [
        ("Bot Detection", F.lit(""), condition),
        ("Total Reviews Analyzed", F.col("bot_total"), condition),
        ("Genuine Reviews", F.col("bot_total") - F.col("bot_count"), condition),
        ("Bot Reviews Filtered", F.col("bot_count"), condition),
        ("Bot Percentage", F.concat(plain(F.col("bot_percentage")), F.lit("%")), condition),
    ]


def report_keywords(analysis: DataFrame, limit: int | None = None, keys: Sequence[str] = PRODUCT) -> DataFrame:
    rows = analysis.select(*keys, F.explode("keywords").alias("k")).select(*keys, "k.rank", "k.word", "k.frequency")
    return rows if limit is None else rows.filter(F.col("rank") <= limit)


def report_themes(analysis: DataFrame, limit: int | None = None, keys: Sequence[str] = PRODUCT) -> DataFrame:
    rows = analysis.select(*keys, F.explode("themes").alias("t")).select(
        *keys, "t.rank", "t.theme", "t.mentions", "t.sentiment"
    )
    return rows if limit is None else rows.filter(F.col("rank") <= limit)


def report_insights(analysis: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    return analysis.select(*keys, F.posexplode("insights").alias("position", "insight"))


def report_rating_section(distribution: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Rows ``5 Star`` to ``1 Star`` with their count."""
    pairs = ", ".join(f"'{s} Star', coalesce(`stars_{s}`, 0)" for s in STARS)
    return distribution.select(*keys, F.expr(f"stack(5, {pairs}) as (rating, count)"))


def report_reviews_section(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """The wanted review columns, as far as the table has them."""
    found = []
    for name in REVIEW_COLUMNS:
        source = name if name in reviews.columns else REVIEW_NAMES.get(name)
        if source in reviews.columns:
            found.append(F.col(source).alias(name))
    return reviews.select(*keys, *found)


def report_pdf_sections(analysis: DataFrame, keys: Sequence[str] = PRODUCT) -> dict[str, DataFrame]:
    """Tables of the page report: shares of all reviews, ranked lists, bots only if found."""
    counts = F.expr("stack(3, 'Positive', positive, 'Neutral', neutral, 'Negative', negative) as (sentiment, count)")
    sentiment = analysis.select(*keys, "total_reviews", counts).select(
        *keys, "sentiment", "count",
        F.concat(fixed(percent(F.col("count"), F.col("total_reviews"))), F.lit("%")).alias("percentage"),
    )
    themes = report_themes(analysis, PDF_THEMES, keys)
    mood = F.coalesce("sentiment", F.lit("neutral"))
    capitalized = F.concat(F.upper(F.substring(mood, 1, 1)), F.lower(F.substring(mood, 2, 100)))
    return {
        "sentiment": sentiment,
        "bots": _rows(analysis.filter(F.col("bot_count") > 0), keys, _bot_entries(None)[1:]),
        "keywords": report_keywords(analysis, PDF_KEYWORDS, keys),
        "themes": themes.withColumn("sentiment", capitalized),
        "insights": report_insights(analysis, keys),
        "ratings": report_rating_section(analysis, keys),
    }


def report_sections(analysis: DataFrame, reviews: DataFrame | None = None, keys: Sequence[str] = PRODUCT) -> dict[str, DataFrame]:
    """The six sheets of the table report."""
    out = {
        "summary": report_summary_section(analysis, keys),
        "keywords": report_keywords(analysis, keys=keys),
        "themes": report_themes(analysis, keys=keys),
        "insights": report_insights(analysis, keys),
        "ratings": report_rating_section(analysis, keys),
    }
    if reviews is not None:
        out["reviews"] = report_reviews_section(reviews, keys)
    return out


def report_name(product: str, at: datetime) -> str:
    return f"analysis_{product}_{at:%Y%m%d_%H%M%S}"


def write_report(
    sections: Mapping[str, DataFrame], folder: str, at: datetime, kind: str = "csv", product: str = "all", keys: Sequence[str] = PRODUCT,
) -> dict[str, str]:
    """One table per section below ``<folder>/<name>``; rows of a product stay together.

    The small sections are clustered by ``keys``, the review section keeps its
    own partitioning.
    """
    base = f"{folder.rstrip('/')}/{report_name(product, at)}"
    paths = {}
    for name, table in sections.items():
        path = f"{base}/{name}"
        writer = table if name == "reviews" else table.repartition(*keys).sortWithinPartitions(*keys)
        target = writer.write.mode("overwrite")
        (target.option("header", True) if kind == "csv" else target).format(kind).save(path)
        paths[name] = path
    return paths


def write_whole_report(
    analysis: DataFrame, reviews: DataFrame, folder: str, at: datetime, kind: str = "csv", product: str = "all", keys: Sequence[str] = PRODUCT,
) -> dict[str, str]:
    """All six sections of one analysis, which is computed and written once; the sections are read from it."""
    document = materialize(analysis, "document")
    return write_report(report_sections(document, reviews, keys), folder, at, kind, product, keys)
