"""Keyword counts per product."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.dictionaries import API_STOPWORDS, ENGLISH_STOPWORDS
from reviewloom.functions.rounding import round_exact
from reviewloom.functions.text import analysis_text, split_words, sql_words
from reviewloom.operators.ranking import PRODUCT, first_rows

# Token rule, minimum length, stopwords, list size and share of
# each keyword variant.
ASCII_WORD = "^[a-z]+$"
ALNUM_WORD = r"^[\p{L}\p{N}]+$"


@dataclass(frozen=True)
class KeywordRule:
    form: str
    word: str
    min_length: int
    stopwords: tuple[str, ...]
    top_n: int
    share: str | None = None
    digits: int = 0


RULES = {
    "default": KeywordRule("title_body", ASCII_WORD, 3, tuple(ENGLISH_STOPWORDS), 15),
    "api": KeywordRule("title_body", ASCII_WORD, 3, tuple(API_STOPWORDS), 10),
    "ensemble": KeywordRule("title_body", ALNUM_WORD, 3, tuple(ENGLISH_STOPWORDS), 15, "weight", 4),
    "free": KeywordRule("body", ALNUM_WORD, 4, tuple(ENGLISH_STOPWORDS), 15, "relevance", 3),
}
# seq * 2**32 + place orders all words of a product by first occurrence
PLACE = "decimal(38,0)"
PLACES_PER_REVIEW = 2**32


def _words(reviews: DataFrame, form: str, keys: Sequence[str]) -> DataFrame:
    words = F.posexplode(split_words(analysis_text(form))).alias("pos", "word")
    return reviews.select(*keys, "seq", words)


def tokens(reviews: DataFrame, variant: str = "default", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Words of all reviews with their place: ``(keys, seq, pos, word)``."""
    rule = RULES[variant]
    return _words(reviews, rule.form, keys).filter(F.col("word").rlike(rule.word))


def keyword_tokens(reviews: DataFrame, variant: str = "default", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Words that count as keywords; the cheap tests come before the pattern."""
    rule = RULES[variant]
    kept = (F.length("word") >= rule.min_length) & F.expr(f"word NOT IN {sql_words(rule.stopwords)}")
    return _words(reviews, rule.form, keys).filter(kept & F.col("word").rlike(rule.word))


def first_place() -> Column:
    return (F.col("seq").cast(PLACE) * PLACES_PER_REVIEW + F.col("pos")).cast(PLACE)


def keyword_counts(reviews: DataFrame, variant: str = "default", keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Frequency and first place of each keyword, combined inside the tasks first."""
    return (
        keyword_tokens(reviews, variant, keys)
        .groupBy(*keys, "word")
        .agg(F.count("*").alias("frequency"), F.min(first_place()).alias("first_place"))
    )


def keyword_order() -> list[Column]:
    return [F.col("frequency").desc(), F.col("first_place").asc()]


def top_keywords(
    reviews: DataFrame, variant: str = "default", top_n: int | None = None, keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Most frequent keywords; equal counts in order of first occurrence."""
    counts = keyword_counts(reviews, variant, keys)
    top = first_rows(counts, keys, keyword_order(), top_n or RULES[variant].top_n, "rank")
    return top.select(*keys, "rank", "word", "frequency")


def keyword_share(
    reviews: DataFrame, variant: str = "ensemble", top_n: int | None = None, keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Top keywords with their share of all kept words of the product.

    One pass counts the words and, as a second grouping set, the total of the
    product; the total ranks before the words, so it travels with the top rows
    and no window or join touches the whole vocabulary.
    """
    rule = RULES[variant]
    words = keyword_tokens(reviews, variant, keys)
    names = [F.col(k) for k in keys]
    counts = words.groupingSets([[*names, F.col("word")], names], *names, F.col("word")).agg(
        F.count("*").alias("frequency"), F.min(first_place()).alias("first_place"), F.grouping("word").alias("__all")
    )
    order = [F.col("__all").desc(), *keyword_order()]
    top = first_rows(counts, keys, order, (top_n or rule.top_n) + 1, "__place")
    total = F.first("frequency").over(Window.partitionBy(*keys).orderBy("__place"))
    share = round_exact(F.col("frequency").cast("double") / F.col("__total"), rule.digits)
    return (
        top.withColumn("__total", total)
        .filter(F.col("__all") == 0)
        .select(*keys, (F.col("__place") - 1).alias("rank"), "word", "frequency", share.alias(rule.share))
    )


def keyword_size_class(keywords: DataFrame) -> DataFrame:
    """Display size: five times the frequency, at most 100, and a class."""
    n = F.col("frequency")
    return keywords.withColumn("size", F.least(n * 5, F.lit(100))).withColumn(
        "size_class", F.when(n > 20, "large").when(n > 10, "medium").otherwise("small")
    )


def keyword_list(keywords: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Ranked keywords of a product as one small array of structs."""
    entry = F.struct("rank", "word", "frequency")
    return keywords.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("keywords"))
