"""Themes from keyword dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.dictionaries import (
    ASPECT_THEMES,
    KEYWORD_THEMES,
    LABEL_THEMES,
    OCCURRENCE_THEMES,
    PATTERN_DEFAULT_KEYWORDS,
    PATTERN_DEFAULT_SCORE,
    PATTERN_DEFAULT_THEME,
    PATTERN_THEME_SCORE,
    PATTERN_THEMES,
    THEME_NEGATIVE_WORDS,
    THEME_POSITIVE_WORDS,
)
from reviewloom.functions.rounding import round_exact
from reviewloom.functions.text import analysis_text, contains_any, count_contained, count_occurrences
from reviewloom.operators.ranking import PRODUCT, join_group_facts
from reviewloom.operators.sentiment import compound_of, sentiment_label

TOP_THEMES = 5


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _unpivot(df: DataFrame, keys: Sequence[str], names: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Columns ``<part>_<ordinal>`` to rows ``(ordinal, theme, parts...)``."""
    rows = ", ".join(
        f"{i}, {_quoted(name)}, " + ", ".join(f"`{p}_{i}`" for p in parts) for i, name in enumerate(names)
    )
    return df.select(*keys, F.expr(f"stack({len(names)}, {rows}) as (ordinal, theme, {', '.join(parts)})"))


def _ranked(rows: DataFrame, keys: Sequence[str], limit: int | None) -> DataFrame:
    """Rank themes by mentions, then dictionary order (a handful of rows per product)."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(F.col("mentions").desc(), F.col("ordinal").asc())
    out = rows.filter(F.col("mentions") > 0).withColumn("rank", F.row_number().over(window))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def theme_mood(low: Column) -> Column:
    """Mood of one text: more praise than blame words, or the other way round."""
    praise = count_contained(low, THEME_POSITIVE_WORDS)
    blame = count_contained(low, THEME_NEGATIVE_WORDS)
    return F.when(praise > blame, "positive").when(blame > praise, "negative").otherwise("neutral")


def with_theme_flags(reviews: DataFrame) -> DataFrame:
    """Add one flag per keyword theme and the mood of the text."""
    low = reviews.withColumn("__low", F.lower(analysis_text()))
    flags = {f"theme_{i}": contains_any(F.col("__low"), words) for i, words in enumerate(KEYWORD_THEMES.values())}
    return low.withColumns({**flags, "mood": theme_mood(F.col("__low"))}).drop("__low")


def theme_aggregates(where: Column | None = None) -> list[Column]:
    """Mentions and moods per theme for use in any ``agg``; needs the flags."""
    keep = F.lit(True) if where is None else where
    out = []
    for i in range(len(KEYWORD_THEMES)):
        hit = keep & F.col(f"theme_{i}")
        out.append(F.count_if(hit).alias(f"mentions_{i}"))
        out += [F.count_if(hit & (F.col("mood") == m)).alias(f"{m}_{i}") for m in ("positive", "negative", "neutral")]
    return out


def theme_array(limit: int = TOP_THEMES) -> Column:
    """Ranked themes of a product row as an array, from the summed flags.

    Sorted by mentions, then dictionary order; the majority mood of a theme,
    ties going to positive, negative, neutral.
    """

    def entry(i: int, name: str) -> Column:
        pos, neg, neu = (F.col(f"{m}_{i}") for m in ("positive", "negative", "neutral"))
        top = F.greatest(pos, neg, neu)
        mood = F.when(pos == top, "positive").when(neg == top, "negative").otherwise("neutral")
        n = F.col(f"mentions_{i}")
        row = F.struct((-n).alias("order"), F.lit(i).alias("ordinal"), F.lit(name).alias("theme"), n.alias("mentions"), mood.alias("sentiment"))
        return F.when(n > 0, row)

    found = F.sort_array(F.array_compact(F.array(*[entry(i, n) for i, n in enumerate(KEYWORD_THEMES)])))
    return F.transform(
        F.slice(found, 1, limit),
        lambda t, i: F.struct((i + 1).alias("rank"), t["theme"].alias("theme"), t["mentions"].alias("mentions"), t["sentiment"].alias("sentiment")),
    )


def theme_rows(sums: DataFrame, keys: Sequence[str] = PRODUCT, limit: int = TOP_THEMES) -> DataFrame:
    return sums.select(*keys, F.explode(theme_array(limit)).alias("t")).select(*keys, "t.*")


def keyword_themes(reviews: DataFrame, keys: Sequence[str] = PRODUCT, limit: int = TOP_THEMES) -> DataFrame:
    """Reviews per theme and the majority mood of those reviews; five largest."""
    return theme_rows(with_theme_flags(reviews).groupBy(*keys).agg(*theme_aggregates()), keys, limit)


def with_label_flags(reviews: DataFrame) -> DataFrame:
    low = reviews.withColumn("__low", F.lower(analysis_text()))
    flags = {f"label_{i}": contains_any(F.col("__low"), w) for i, w in enumerate(LABEL_THEMES.values())}
    return low.withColumns(flags).drop("__low")


def label_aggregates() -> list[Column]:
    return [F.count_if(F.col(f"label_{i}")).alias(f"mentions_{i}") for i in range(len(LABEL_THEMES))]


def label_array() -> Column:
    """Themes of a product row by number of reviews, then dictionary order."""

    def entry(i: int, name: str) -> Column:
        n = F.col(f"mentions_{i}")
        return F.when(n > 0, F.struct((-n).alias("order"), F.lit(i).alias("ordinal"), F.lit(name).alias("theme"), n.alias("mentions")))

    found = F.sort_array(F.array_compact(F.array(*[entry(i, n) for i, n in enumerate(LABEL_THEMES)])))
    return F.transform(
        found, lambda t, i: F.struct((i + 1).alias("rank"), t["theme"].alias("theme"), t["mentions"].alias("mentions"))
    )


def theme_labels(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Theme names by number of reviews that mention them."""
    sums = with_label_flags(reviews).groupBy(*keys).agg(*label_aggregates())
    return sums.select(*keys, F.explode(label_array()).alias("t")).select(*keys, "t.*")


def with_occurrences(reviews: DataFrame) -> DataFrame:
    """Add the occurrences of each theme's words, non-overlapping per word."""
    low = reviews.withColumn("__low", F.lower(analysis_text()))
    counts = {
        f"occurrences_{i}": sum((count_occurrences(F.col("__low"), w) for w in words), F.lit(0))
        for i, words in enumerate(OCCURRENCE_THEMES.values())
    }
    return low.withColumns(counts).drop("__low")


def occurrence_aggregates() -> list[Column]:
    return [F.sum(f"occurrences_{i}").alias(f"mentions_{i}") for i in range(len(OCCURRENCE_THEMES))]


def occurrence_array() -> Column:
    """Themes of a product row that occur, in dictionary order."""

    def entry(i: int, name: str, words: Sequence[str]) -> Column:
        n = F.col(f"mentions_{i}")
        row = F.struct(
            F.lit(i).alias("ordinal"), F.lit(name).alias("theme"), n.alias("mentions"), F.array(*map(F.lit, words)).alias("keywords")
        )
        return F.when(n > 0, row)

    return F.array_compact(F.array(*[entry(i, n, w) for i, (n, w) in enumerate(OCCURRENCE_THEMES.items())]))


def theme_occurrences(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Occurrences of the theme words in all texts, in dictionary order."""
    sums = with_occurrences(reviews).groupBy(*keys).agg(*occurrence_aggregates())
    return sums.select(*keys, F.explode(occurrence_array()).alias("t")).select(*keys, "t.*")


def aspect_themes(scored: DataFrame, keys: Sequence[str] = PRODUCT, cut: float = 0.05) -> DataFrame:
    """Distinct aspect words present anywhere, and the mood of the matching texts.

    The mood adds up the exact valence of the matching reviews, so no joined
    text is built.  Needs ``valence``.
    """
    low = scored.select(*keys, F.lower(F.coalesce("body", F.lit(""))).alias("__low"), "valence")
    aggs = []
    for i, words in enumerate(ASPECT_THEMES.values()):
        aggs += [F.max(F.col("__low").contains(w)).alias(f"word_{i}_{j}") for j, w in enumerate(words)]
        hit = contains_any(F.col("__low"), words)
        aggs.append(F.sum(F.when(hit, F.col("valence")).otherwise(0)).alias(f"valence_{i}"))
    sums = low.groupBy(*keys).agg(*aggs)
    present = {
        f"mentions_{i}": sum((F.col(f"word_{i}_{j}").cast("int") for j in range(len(words))), F.lit(0))
        for i, words in enumerate(ASPECT_THEMES.values())
    }
    rows = _unpivot(sums.withColumns(present), keys, list(ASPECT_THEMES), ["mentions", "valence"])
    score = compound_of(F.col("valence"))
    words = F.create_map(*[x for n, w in ASPECT_THEMES.items() for x in (F.lit(n), F.array(*map(F.lit, w[:3])))])
    return _ranked(rows, keys, TOP_THEMES).select(
        *keys, "rank", "theme", "mentions", sentiment_label(score, cut).alias("sentiment"),
        round_exact(F.abs(score), 3).alias("confidence"), F.element_at(words, F.col("theme")).alias("keywords"),
    )


def _pattern_matches(reviews: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("body", F.lit("")))
    names = [F.when(contains_any(F.col("__low"), w), n) for n, w in PATTERN_THEMES.items()]
    return reviews.withColumn("__low", low).withColumn("__themes", F.array_compact(F.array(*names))).drop("__low")


def pattern_theme_members(
    reviews: DataFrame, keys: Sequence[str] = PRODUCT
) -> DataFrame:
    """Members of the pattern themes as rows ``(keys, theme, review_id)``.

    A product without any match puts all its reviews into the default theme.
    The membership stays a long table: a theme may hold most of the reviews.
    """
    matched = _pattern_matches(reviews).select(*keys, "review_id", "__themes")
    facts = matched.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(F.size("__themes")).alias("__most"))
    unmatched = facts.filter(F.col("__most") == 0).withColumn("__none", F.lit(True))
    rows = join_group_facts(matched, unmatched, keys, ["__none"])
    names = F.when(F.col("__none"), F.array(F.lit(PATTERN_DEFAULT_THEME))).otherwise(F.col("__themes"))
    return rows.select(*keys, "review_id", F.explode(names).alias("theme")).select(*keys, "theme", "review_id")


def pattern_themes(reviews: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Size, constant score and first words of each pattern theme, numbered per product."""
    aggs = [F.count_if(F.array_contains("__themes", n)).alias(f"size_{i}") for i, n in enumerate(PATTERN_THEMES)]
    sums = _pattern_matches(reviews).groupBy(*keys).agg(F.count("*").alias("__n"), *aggs)
    found = sum((F.col(f"size_{i}") for i in range(len(PATTERN_THEMES))), F.lit(0))
    names = [*PATTERN_THEMES, PATTERN_DEFAULT_THEME]
    sums = sums.withColumn(f"size_{len(PATTERN_THEMES)}", F.when(found == 0, F.col("__n")).otherwise(0))
    from pyspark.sql import Window

    rows = _unpivot(sums, keys, names, ["size"]).filter(F.col("size") > 0)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal")) - 1
    words: Mapping[str, list[str]] = {**PATTERN_THEMES, PATTERN_DEFAULT_THEME: PATTERN_DEFAULT_KEYWORDS}
    lists = F.create_map(*[x for n, w in words.items() for x in (F.lit(n), F.array(*map(F.lit, w[:3])))])
    score = F.when(F.col("theme") == PATTERN_DEFAULT_THEME, PATTERN_DEFAULT_SCORE).otherwise(PATTERN_THEME_SCORE)
    return rows.select(
        *keys, F.concat(F.lit("theme_"), number).alias("id"), "theme", "size",
        score.alias("sentiment_score"), F.element_at(lists, F.col("theme")).alias("keywords"),
    )


def theme_sentiment_class(score: Column) -> Column:
    value = F.coalesce(score, F.lit(3.0))
    return F.when(value > 3.5, "positive").when(value < 2.5, "negative").otherwise("neutral")


def theme_lines(themes: DataFrame, order: str, keys: Sequence[str] = PRODUCT, limit: int = 5) -> DataFrame:
    """The first themes of a product as one text block, a line each."""
    from reviewloom.operators.ranking import first_rows

    line = F.format_string(
        "- %s: %d reviews, %s sentiment, keywords: %s",
        "theme", F.col("size").cast("long"), theme_sentiment_class(F.col("sentiment_score")), F.array_join("keywords", ", "),
    )
    top = first_rows(themes, keys, [F.col(order).asc()], limit, "__rank")
    lines = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__rank", line.alias("line")))).alias("__lines"))
    return lines.select(*keys, F.array_join(F.transform("__lines", lambda x: x["line"]), "\n").alias("theme_text"))


def normalize_themes(*tables: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """One theme table from tables with missing fields: mentions 0, neutral, empty name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    for name, kind in (("theme", "string"), ("mentions", "bigint"), ("sentiment", "string")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    blank = F.coalesce(F.nullif(F.col("sentiment"), F.lit("")), F.lit("neutral"))
    return out.select(
        *keys, F.coalesce("theme", F.lit("")).alias("theme"),
        F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"), blank.alias("sentiment"),
    )
