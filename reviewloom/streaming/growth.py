"""Daily growth means from a stream of snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.growth import estimate_buyers
from reviewloom.operators.ranking import PRODUCT
from reviewloom.streaming.days import day_of, wall_clock


def stream_growth(snapshots: DataFrame, delay: str = "1 day", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Mean buyers and rating per product and day of a snapshot stream.

    State is one small row per product and open day.  A day is emitted once the
    watermark has passed its end; snapshots that arrive after that are dropped.
    """
    local = snapshots.withColumn("ts", wall_clock(F.col("ts")))
    rows = estimate_buyers(local).withWatermark("ts", delay)
    sums = rows.groupBy(*keys, F.window("ts", "1 day").alias("window")).agg(
        F.count("*").alias("snapshots"), F.sum("estimated_buyers").alias("__buyers"),
        F.sum(F.col("rating").cast("decimal(18,6)")).alias("__rating"),
    )
    return sums.select(
        *keys, day_of().alias("date"), "snapshots",
        (F.col("__buyers").cast("double") / F.col("snapshots")).alias("mean_buyers"),
        (F.col("__rating").cast("double") / F.col("snapshots")).alias("mean_rating"),
    )
