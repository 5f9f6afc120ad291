"""Reviews of one product from several countries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.dictionaries import COUNTRY_PRIORITY, MULTI_COUNTRY_DEFAULT
from reviewloom.functions.rounding import round_exact
from reviewloom.operators.ranking import PRODUCT, join_group_facts
from reviewloom.operators.ratings import rating_aggregates


def union_countries(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of the per-country tables, the country stamped on each row."""
    stamped = [df.withColumn("country", F.lit(country)) for country, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stamped)


def country_priority(requested: str | None = None) -> list[str]:
    """Order in which countries are tried: the requested one, then the fixed list."""
    if requested and requested != COUNTRY_PRIORITY[0]:
        return [requested] + [c for c in COUNTRY_PRIORITY if c != requested]
    return list(COUNTRY_PRIORITY)


def first_available_country(
    reviews: DataFrame, requested: str | None = None, keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Reviews of the first country in the priority order that has any."""
    rank = F.lit(None).cast("int")
    for place, country in reversed(list(enumerate(country_priority(requested)))):
        rank = F.when(F.col("country") == country, place).otherwise(rank)
    listed = reviews.withColumn("__place", rank).filter(F.col("__place").isNotNull())
    facts = listed.groupBy(*keys).agg(F.min("__place").alias("__best"), F.count("*").alias("__n"))
    joined = join_group_facts(listed, facts, keys, ["__best"])
    return joined.filter(F.col("__place") == F.col("__best")).select(*reviews.columns)


def country_rollup(
    reviews: DataFrame, requested: Sequence[str] = tuple(MULTI_COUNTRY_DEFAULT), keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Totals over the requested countries, and which of them had reviews."""
    rows = reviews.filter(F.col("country").isin(*requested))
    aggs = rating_aggregates()
    found = [F.max(F.col("country") == c).alias(f"__has_{c}") for c in requested]
    out = rows.groupBy(*keys).agg(*aggs, *found)

    def names(present: bool):
        flags = [F.when(F.col(f"__has_{c}") if present else ~F.col(f"__has_{c}"), c) for c in requested]
        return F.array_compact(F.array(*flags))

    return out.select(
        *keys, "total_reviews", round_exact(F.col("average_rating"), 2).alias("average_rating"),
        *[f"stars_{s}" for s in (5, 4, 3, 2, 1)],
        names(True).alias("successful_countries"), names(False).alias("failed_countries"),
    )


def country_ratings(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Totals per product and country."""
    return reviews.groupBy(*keys, "country").agg(*rating_aggregates())
