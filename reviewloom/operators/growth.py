"""Growth of buyers over time from review snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.dictionaries import GROWTH_RECOMMENDATIONS
from reviewloom.functions.rounding import round_exact
from reviewloom.operators.ranking import PRODUCT, join_group_facts
from reviewloom.schema import SNAPSHOT, STORED_SNAPSHOT

# Days back and hours per step of each period; label counts.
PERIODS = {"day": (1, 1), "week": (7, 24), "month": (30, 24), "quarter": (90, 168)}
LABEL_STEPS = {"day": (7, 1), "week": (12, 7), "month": (6, 30), "quarter": (4, 90)}
BUYER_RATE, RATE_LOW, RATE_HIGH = 0.02, 0.01, 0.03


def estimate_buyers(snapshots: DataFrame, rate: float = BUYER_RATE) -> DataFrame:
    """Buyers if ``rate`` of them write a review, with the bounds at 3 % and 1 %."""
    n = F.col("review_count").cast("double")
    return snapshots.withColumns(
        {
            "estimated_buyers": F.floor(n / F.lit(rate)).cast("long"),
            "buyers_low": F.floor(n / F.lit(RATE_HIGH)).cast("long"),
            "buyers_high": F.floor(n / F.lit(RATE_LOW)).cast("long"),
        }
    )


def append_growth_snapshot(snapshots: DataFrame, path: str, rate: float = BUYER_RATE, keys: Sequence[str] = PRODUCT) -> None:
    """Append snapshots below ``path``, one folder per date.

    Products are clustered inside the date folders; a folder per product would
    make one tiny file per product and day.
    """
    rows = estimate_buyers(snapshots, rate).select(
        *keys, *[c for c in SNAPSHOT.fieldNames() if c not in PRODUCT], F.to_date("ts").alias("date")
    )
    # Rebalanced, so that a day of very many rows is split over several files.
    rows.hint("rebalance", "date").sortWithinPartitions("date", keys[0]).write.mode("append").partitionBy(
        "date"
    ).parquet(path)


def read_growth_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Stored snapshots; filters on ``date`` prune folders."""
    return spark.read.schema(STORED_SNAPSHOT).parquet(path)


def growth_steps(spark: SparkSession, as_of: datetime, period: str = "week") -> DataFrame:
    """Steps of a period up to ``as_of``: at most 31 rows; unknown periods are a week."""
    days, hours = PERIODS.get(period, PERIODS["week"])
    count = days * 24 // hours
    start = as_of - timedelta(days=days)
    # without time zone, so that a step of hours never meets a clock change
    first = F.lit(start.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    step = spark.range(count + 1).select(
        F.timestamp_add("HOUR", (F.col("id") * hours).cast("int"), first).alias("step_ts")
    )
    shape = "yyyy-MM-dd" if hours >= 24 else "HH:mm"
    return step.select("step_ts", F.to_date("step_ts").alias("date"), F.date_format("step_ts", shape).alias("label"))


def daily_means(snapshots: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Mean buyers and rating per date; sums are exact, so order does not matter."""
    days = snapshots.withColumn("date", F.to_date("ts"))
    sums = days.groupBy(*keys, "date").agg(
        F.count("*").alias("__n"), F.sum("estimated_buyers").alias("__buyers"),
        F.sum(F.col("rating").cast("decimal(18,6)")).alias("__rating"),
    )
    return sums.select(
        *keys, "date",
        (F.col("__buyers").cast("double") / F.col("__n")).alias("mean_buyers"),
        (F.col("__rating").cast("double") / F.col("__n")).alias("mean_rating"),
    )


def trend(change: Column) -> Column:
    return F.when(change > 5, "up").when(change < -5, "down").otherwise("stable")


def _recent_days(snapshots: DataFrame, as_of: datetime, period: str, keys: Sequence[str]) -> DataFrame:
    """Daily means of the dates that a period touches; the filters reach the scan."""
    days, _ = PERIODS.get(period, PERIODS["week"])
    return daily_means(_between(snapshots, as_of - timedelta(days=days), as_of), keys)


def _between(snapshots: DataFrame, first: datetime, last: datetime) -> DataFrame:
    """Snapshots of the days from ``first`` to ``last``; stored ones also by their folder's date."""
    low, high = first.strftime("%Y-%m-%d"), last.strftime("%Y-%m-%d")
    after = (last + timedelta(days=1)).strftime("%Y-%m-%d")
    recent = snapshots.filter((F.col("ts") >= F.lit(low).cast("timestamp")) & (F.col("ts") < F.lit(after).cast("timestamp")))
    if "date" in snapshots.columns:
        recent = recent.filter(F.col("date").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    return recent


def growth_points(
    snapshots: DataFrame, as_of: datetime, period: str = "week", keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """One point per step whose date has snapshots, with the trend to the previous point.

    The current mean is compared untruncated with the truncated previous value.
    """
    return _points(_recent_days(snapshots, as_of, period, keys), as_of, period, keys)


def _points(means: DataFrame, as_of: datetime, period: str, keys: Sequence[str]) -> DataFrame:
    steps = F.broadcast(growth_steps(means.sparkSession, as_of, period))  # at most 31 rows
    points = means.join(steps, "date")
    order = Window.partitionBy(*keys).orderBy("step_ts")
    buyers = F.col("mean_buyers").cast("long")
    previous = F.lag(buyers).over(order)
    change = F.when(previous != 0, (F.col("mean_buyers") - previous) / previous * 100).otherwise(0.0)
    return points.select(
        *keys, "step_ts", F.col("label").alias("date"), buyers.alias("buyers"),
        round_exact(F.col("mean_rating"), 2).alias("rating"), trend(F.coalesce(change, F.lit(0.0))).alias("trend"),
        F.lag(buyers).over(order).alias("previous_buyers"),
    )


def growth_series(snapshots: DataFrame, as_of: datetime, period: str = "week", keys: Sequence[str] = PRODUCT) -> DataFrame:
    return growth_points(snapshots, as_of, period, keys).drop("previous_buyers")


def growth_trend(points: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    return points.select(*keys, "step_ts", "buyers", "previous_buyers", "trend")


def _period_metrics(points: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    sums = points.groupBy(*keys).agg(
        F.min_by("buyers", "step_ts").alias("__first"), F.max_by("buyers", "step_ts").alias("__last"),
        F.sum("buyers").alias("__sum"), F.count("*").alias("__n"), F.max("buyers").alias("__peak"),
        F.count_if(F.col("buyers") > F.col("previous_buyers")).alias("__rises"),
        F.min_by("date", F.struct(-F.col("buyers"), F.col("step_ts"))).alias("__best"),
    )
    first, last = F.col("__first"), F.col("__last")
    growth = F.when(first != 0, (last - first) / F.when(first != 0, first) * 100).otherwise(0.0)
    steps = F.col("__n") - 1
    return sums.select(
        *keys, growth.alias(f"{name}_growth"), (F.col("__sum") / F.col("__n")).alias(f"{name}_mean"),
        last.alias(f"{name}_last"), F.col("__peak").alias(f"{name}_peak"), F.col("__best").alias(f"{name}_best"),
        F.when(steps > 0, F.col("__rises") / F.when(steps > 0, steps)).otherwise(0.0).alias(f"{name}_strength"),
    )


def growth_metrics(
    snapshots: DataFrame, as_of: datetime, keys: Sequence[str] = PRODUCT, products: DataFrame | None = None
) -> DataFrame:
    """Week and month growth, averages, best day, trend, forecast and recommendations.

    Both periods share the daily means of the month, so snapshots are read once.
    Every product of ``products`` has a row, or, without that list, every
    product of the last month: ``status`` is ``ok``, or ``insufficient_data``
    where the last week or month has no snapshots; what rests on it is then NULL.
    """
    means = _recent_days(snapshots, as_of, "month", keys)
    week, month = (_period_metrics(_points(means, as_of, p, keys), keys, p) for p in ("week", "month"))
    both = join_group_facts(month, week, keys, [c for c in week.columns if c not in keys])
    if products is not None:
        both = join_group_facts(products.select(*keys).distinct(), both, keys, [c for c in both.columns if c not in keys])
    enough = F.col("week_last").isNotNull() & F.col("month_last").isNotNull()
    known = F.col("week_growth").isNotNull()
    growth, strength = F.col("week_growth"), F.col("week_strength")
    return both.select(
        *keys,
        round_exact(growth, 1).alias("weekly_growth"),
        round_exact(F.col("month_growth"), 1).alias("monthly_growth"),
        F.col("week_mean").cast("long").alias("weekly_average"),
        F.col("month_mean").cast("long").alias("monthly_average"),
        F.col("week_best").alias("best_day"),
        F.col("week_peak").alias("peak_buyers"),
        F.when(known, F.when(growth > 5, "growing").when(growth < -5, "declining").otherwise("stable")).alias("trend"),
        round_exact(strength * 100, 1).alias("trend_strength"),
        growth_forecast(F.col("week_last"), growth).alias("next_week"),
        F.when(known, forecast_confidence(strength)).alias("confidence"),
        growth_recommendations(growth, F.col("month_growth"), strength).alias("recommendations"),
        F.when(enough, "ok").otherwise("insufficient_data").alias("status"),
    )


def growth_forecast(last: Column, week_growth: Column) -> Column:
    return (last * (1 + week_growth / 100)).cast("long")


def forecast_confidence(strength: Column) -> Column:
    return F.when(strength > 0.7, "high").when(strength > 0.4, "medium").otherwise("low")


def growth_recommendations(week_growth: Column, month_growth: Column, strength: Column) -> Column:
    text = GROWTH_RECOMMENDATIONS
    return F.array_compact(
        F.array(
            F.when(week_growth > 10, text["strong"]).when(week_growth < -10, text["declining"]),
            F.when(strength > 0.7, text["consistent"]).when(strength < 0.3, text["volatile"]),
            F.when(month_growth > 20, text["monthly"]),
        )
    )


def period_labels(
    snapshots: DataFrame, as_of: datetime, period: str = "week", keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Labelled buckets back from ``as_of`` with mean buyers and growth against the first.

    Seven days by weekday, twelve weeks by number, six months by name, four
    quarters by number (twelve for an unknown period).  A bucket covers the days since the one before.
    """
    count, days = LABEL_STEPS.get(period, (12, 90))
    last = F.lit(as_of.strftime("%Y-%m-%d")).cast("date")
    back = F.floor(F.datediff(last, F.to_date("ts")) / days).cast("int")
    recent = _between(snapshots, as_of - timedelta(days=count * days), as_of)
    rows = recent.withColumn("__i", F.lit(count) - back).filter((F.col("__i") >= 1) & (F.col("__i") <= count))
    sums = rows.groupBy(*keys, "__i").agg(F.sum("estimated_buyers").alias("__sum"), F.count("*").alias("__n"))
    date = F.date_sub(last, ((F.lit(count) - F.col("__i")) * days).cast("int"))
    label = {
        "day": F.date_format(date, "EEE"), "week": F.concat(F.lit("Week "), F.col("__i")),
        "month": F.date_format(date, "MMM"),
    }.get(period, F.concat(F.lit("Q"), F.col("__i")))
    points = sums.select(*keys, "__i", date.alias("date"), label.alias("label"), (F.col("__sum") / F.col("__n")).cast("long").alias("buyers"))
    base = F.first("buyers").over(Window.partitionBy(*keys).orderBy("__i"))
    rate = F.when(base != 0, (F.col("buyers").cast("double") / F.when(base != 0, base) - 1) * 100).otherwise(0.0)
    return points.select(
        *keys, F.col("__i").alias("position"), F.date_format("date", "yyyy-MM-dd").alias("date"), "label", "buyers",
        round_exact(rate, 1).alias("growth_rate"),
    )
