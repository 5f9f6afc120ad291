"""Top rows per group, caps, and joins of rows with facts about their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRODUCT = ("product_id",)
SALTS = 512
# The most rows for which Spark limits groups before the shuffle.
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group.

    ``row_number <= n`` lets Spark keep at most ``n`` rows per group in every
    input task before the shuffle, so a hot group costs no more than others.
    Spark does so up to a number in its settings; beyond, a salted first round does the same.
    """
    name = rank or "__rank"
    out = df
    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING)):
        salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
        out = out.withColumn("__salt", salt)
        local = Window.partitionBy(*keys, "__salt").orderBy(*order)
        out = out.withColumn("__local", F.row_number().over(local)).filter(F.col("__local") <= n).drop("__salt", "__local")
    window = Window.partitionBy(*keys).orderBy(*order)
    out = out.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def max_reviews(reviews: DataFrame, limit: int, keys: Sequence[str] = PRODUCT, cap: int | None = None) -> DataFrame:
    """The first ``limit`` reviews of each product; a caller whose requests are capped passes the cap (100, or 5)."""
    n = limit if cap is None else min(limit, cap)
    return first_rows(reviews, keys, [F.col("seq").asc()], n)


def join_group_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left-join facts about groups (one row for each) to rows; missing keys match each other.

    One join: Spark broadcasts the facts if they are small, and otherwise
    splits the rows of a hot group at run time (adaptive skew join).
    """
    named = facts.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *values)
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    return rows.join(named, condition, "left").select(*rows.columns, *values)
