"""Rating aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.ratings import STARS, star_bucket
from reviewloom.functions.rounding import percent
from reviewloom.operators.ranking import PRODUCT


def exact_mean(rating: Column) -> Column:
    """Mean of the ratings that are not NULL, 0 without any; summed as decimals, so that the order of rows does not matter."""
    n = F.count(rating)
    return F.when(n > 0, F.sum(rating.cast("decimal(18,6)")).cast("double") / n).otherwise(0.0)


def rating_aggregates(where: Column | None = None) -> list[Column]:
    """Count, mean and bucketed star counts for use in any ``agg``."""
    keep = F.lit(True) if where is None else where
    rating = F.coalesce(F.col("rating"), F.lit(0.0))
    return [
        F.count_if(keep).alias("total_reviews"),
        exact_mean(F.when(keep, rating)).alias("average_rating"),
        *[F.count_if(keep & (star_bucket(rating) == s)).alias(f"stars_{s}") for s in STARS],
    ]


def rating_summary(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    return reviews.groupBy(*keys).agg(*rating_aggregates()).select(*keys, "total_reviews", "average_rating")


def rating_distribution(reviews: DataFrame, mode: str = "bucketed", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Counts of the five stars, one column each; ``exact`` counts whole stars only."""
    if mode == "bucketed":
        aggs = rating_aggregates()[2:]
    else:
        aggs = [F.count_if(F.col("rating") == s).alias(f"stars_{s}") for s in STARS]
    return reviews.groupBy(*keys).agg(*aggs)


def rating_rows(distribution: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Star counts as rows; all five stars are always present."""
    pairs = ", ".join(f"{s}, `stars_{s}`" for s in STARS)
    return distribution.select(*keys, F.expr(f"stack(5, {pairs}) as (star, count)"))


def rating_map(suffix: str = "") -> Column:
    """Map view of the star columns, keyed ``5`` .. ``1`` (or ``5_star`` ..)."""
    return F.create_map(*[x for s in STARS for x in (F.lit(f"{s}{suffix}"), F.col(f"stars_{s}"))])


def rating_percentages(distribution: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Star rows with their share of all counted ratings."""
    whole = sum((F.col(f"stars_{s}") for s in STARS), F.lit(0))
    rows = rating_rows(distribution.withColumn("__all", whole), [*keys, "__all"])
    return rows.select(*keys, "star", "count", percent(F.col("count"), F.col("__all")).alias("percentage"))


def distribution_from_map(table: DataFrame, column: str = "rating_distribution", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Star columns from a map with either key style; missing stars are 0."""
    return table.select(
        *keys,
        *[
            F.coalesce(F.try_element_at(column, F.lit(f"{s}_star")), F.try_element_at(column, F.lit(str(s))), F.lit(0)).alias(f"stars_{s}")
            for s in STARS
        ],
    )
