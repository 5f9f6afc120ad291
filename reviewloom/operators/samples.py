"""Review samples and text context per product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.rounding import fixed
from reviewloom.operators.ranking import PRODUCT, first_rows
from reviewloom.operators.ratings import exact_mean


def review_samples(scored: DataFrame, mode: str = "first", size: int = 3, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """The first reviews per label; ``best`` puts the strongest scores first.

    ``best`` orders positive reviews by falling and negative ones by rising
    compound score (three decimals), neutral ones by ingest order.
    """
    order = [F.col("seq").asc()]
    if mode == "best":
        from reviewloom.functions.rounding import round_exact

        score = round_exact(F.col("compound"), 3)
        key = F.when(F.col("sentiment") == "positive", -score).when(F.col("sentiment") == "negative", score).otherwise(0.0)
        order = [key.asc(), *order]
    return first_rows(scored, [*keys, "sentiment"], order, size, "sample_rank")


def sample_lists(samples: DataFrame, fields: Sequence[str], keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Samples of a product as one struct of three short arrays."""
    entry = F.struct("sample_rank", *fields)

    def of(label: str):
        return F.sort_array(F.collect_list(F.when(F.col("sentiment") == label, entry))).alias(label)

    grouped = samples.groupBy(*keys).agg(of("positive"), of("negative"), of("neutral"))
    return grouped.select(*keys, F.struct("positive", "negative", "neutral").alias("review_samples"))


def review_context(scored: DataFrame, first: int = 10, length: int = 100, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Counts and the first snippets of a product as text blocks for a text model.

    Ten snippets of 100 characters carry the rating, five of 80 do not.
    """
    text = F.concat(F.substring(F.coalesce("body", F.lit("")), 1, length), F.lit("..."))
    line = F.concat(F.lit("- "), text)
    if first == 10:
        line = F.concat(F.lit("- Rating "), F.col("rating").cast("string"), F.lit("/5: "), text)
    top = first_rows(scored.select(*keys, "seq", line.alias("line")), keys, [F.col("seq").asc()], first, "__rank")
    blocks = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__rank", "line"))).alias("__lines"))
    counts = scored.groupBy(*keys).agg(
        F.count("*").alias("total_reviews"), exact_mean(F.coalesce("rating", F.lit(0.0))).alias("__mean"),
        *[F.count_if(F.col("sentiment") == n).alias(n) for n in ("positive", "neutral", "negative")],
    )
    return counts.join(blocks, list(keys)).select(
        *keys, "total_reviews", fixed(F.col("__mean"), 1).alias("average_rating"), "positive", "neutral", "negative",
        F.array_join(F.transform("__lines", lambda x: x["line"]), "\n").alias("review_texts"),
    )
