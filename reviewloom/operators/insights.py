"""Rule-based insight lines and parsing of model answers.

Every rule reads the one-row-per-product analysis table of
``plans.analysis``: label counts, ``keywords`` and ``themes`` as short arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.dictionaries import NEGATIVE_THEME_MARKS
from reviewloom.functions.rounding import fixed, percent, plain
from reviewloom.functions.text import strip

# --------------------------------------------------------------------------
# Text of the insight lines and recommendations
# --------------------------------------------------------------------------
DEFAULT_TEXT = {
    "excellent": "⭐ Excellent satisfaction: %s%% positive reviews",
    "good": "✅ Good satisfaction: %s%% positive reviews",
    "negative": "⚠️ High negativity: %s%% negative reviews",
    "keywords": "🔤 Top keywords: %s",
    "bots": "🤖 Filtered %d bot/fake reviews (%s%%)",
}
ENSEMBLE_TEXT = {
    "exceptional": "⭐ Exceptional satisfaction: %s%% positive reviews",
    "good": "✅ Good satisfaction: %s%% positive sentiment",
    "negative": "⚠️ Concerning negativity: %s%% negative reviews",
    "neutral": "🤔 High uncertainty: %s%% neutral sentiment",
    "themes": "🎯 Key discussion topics: %s",
    "bad_mood": "😟 Negative emotions detected: %s",
    "good_mood": "😊 Positive emotions dominant: %s",
    "opinion": "💭 Reviews are highly opinion-based",
    "facts": "📊 Reviews focus on factual aspects",
    "keywords": "🔤 Most mentioned: %s",
}
ENSEMBLE_ADVICE = {
    "exceptional": "Maintain quality standards and consider premium positioning",
    "good": "Focus on converting neutral reviewers to positive",
    "negative": "Urgent: Address common complaints and improve quality",
    "neutral": "Provide clearer product information and set expectations",
    "theme": "Address issues related to: %s",
    "bad_mood": "Review negative feedback and implement improvements",
    "good_mood": "Leverage positive sentiment in marketing",
    "opinion": "Provide more factual product information",
    "facts": "Highlight emotional benefits in marketing",
}
BAD_MOODS = ["anger", "sadness", "fear", "disgust"]
GOOD_MOODS = ["joy", "trust", "anticipation"]
FREE_TEXT = {
    "positive": "⭐ Overwhelmingly positive reception (%s%% positive reviews)",
    "good": "✓ Generally positive feedback (%s%% positive)",
    "negative": "⚠ Concerning negative sentiment (%s%% negative reviews)",
    "theme": "🎯 Most discussed: %s (%d mentions)",
    "opinion": "💭 Reviews are highly subjective and opinion-based",
    "facts": "📊 Reviews are factual and objective",
}
FALLBACK_TEXT = {
    "excellent": "⭐ Excellent satisfaction: %s%% positive reviews indicate strong product quality",
    "good": "✅ Good performance: %s%% positive sentiment shows customer acceptance",
    "improve": "⚠️ Improvement needed: Only %s%% positive sentiment",
    "negative": "🔍 High negativity: %s%% negative reviews require attention",
    "keywords": "🔤 Key topics: Customers frequently mention %s",
    "many": "📊 Strong engagement: %d reviews indicate high market interest",
    "few": "📊 Limited feedback: Only %d reviews - more data needed for full analysis",
    "premium": "🏆 Premium quality: %s/5 average rating suggests excellent product",
    "above": "👍 Above average: %s/5 rating shows solid performance",
}
# verdict, strength, improvement
TEMPLATE_VERDICTS = [
    (70, "very positive", "product quality and customer satisfaction", "minor aspects like packaging or delivery"),
    (50, "generally positive", "core functionality", "some quality control issues"),
    (None, "mixed or negative", "potential in the product concept", "significant quality and service issues"),
]
TEMPLATE_LINES = [
    "EXECUTIVE SUMMARY:",
    "Analysis of %1$d customer reviews reveals %2$s sentiment. ",
    "%3$s%% of customers are satisfied with their purchase.",
    "",
    "KEY STRENGTHS:",
    "Customers appreciate the %4$s. Positive reviews highlight good value and performance.",
    "",
    "AREAS FOR IMPROVEMENT:",
    "Focus on %5$s mentioned in critical reviews.",
    "",
    "RECOMMENDATIONS:",
    "Leverage positive feedback in marketing and address common concerns raised in negative reviews.",
]
TEMPLATE_INSIGHTS = [
    "Customer satisfaction rate: %s%%",
    "Key concerns relate to %s",
    "Product shows potential for market success",
]
TEMPLATE_ADVICE = [
    "Highlight positive aspects in product marketing",
    "Address quality issues mentioned in negative reviews",
    "Monitor customer feedback continuously",
]
API_TEXT = ["✨ %s%% positive sentiment", "⚠️ %d critical reviews need attention", "🎯 Top concern: %s"]
API_VERDICT = "Product shows %s customer satisfaction"
PARSE_DEFAULT_ADVICE = "Analyze more reviews for specific recommendations"
ADVICE_WORDS = ["recommend", "suggest", "should", "consider"]
# a bullet, a digit, or a character beyond U+1F000 opens an insight line
BULLET_PATTERN = r"^[-•\p{Nd}\x{1F001}-\x{10FFFF}]"
BULLET_MARKS = "-•0123456789. "


def lines(*entries: Column) -> Column:
    """The entries whose rule fired, in order."""
    return F.array_compact(F.array(*entries))


def label_pct(label: str, total: str = "analyzed") -> Column:
    return percent(F.col(label), F.col(total))


def top_words(n: int) -> Column:
    return F.transform(F.slice("keywords", 1, n), lambda k: k["word"])


def theme_names() -> Column:
    return F.transform("themes", lambda t: t["theme"])


def _has(column: str) -> Column:
    return F.coalesce(F.size(column) > 0, F.lit(False))


def default_insights(bots: bool = True) -> Column:
    pos, neg, text = label_pct("positive"), label_pct("negative"), DEFAULT_TEXT
    entries = [
        F.when(pos > 70, F.format_string(text["excellent"], fixed(pos))).when(
            pos > 50, F.format_string(text["good"], fixed(pos))
        ),
        F.when(neg > 30, F.format_string(text["negative"], fixed(neg))),
        F.when(_has("keywords"), F.format_string(text["keywords"], F.array_join(top_words(5), ", "))),
    ]
    if bots:
        entries.append(
            F.when(F.col("bot_count") > 0, F.format_string(text["bots"], "bot_count", plain(F.col("bot_percentage"))))
        )
    return lines(*entries)


def _label_sum() -> Column:
    return F.col("positive") + F.col("neutral") + F.col("negative")


def ensemble_insights() -> tuple[Column, Column, Column]:
    """Insight lines, recommendations and volume confidence.

    Needs ``dominant_emotion`` and ``avg_subjectivity`` besides the common columns.
    """
    total = _label_sum()
    pos, neg, neu = (percent(F.col(c), total) for c in ("positive", "negative", "neutral"))
    mood, facts = F.col("dominant_emotion"), F.col("avg_subjectivity")
    text, advice = ENSEMBLE_TEXT, ENSEMBLE_ADVICE

    def choose(table, key, value=None):
        return F.lit(table[key]) if value is None else F.format_string(table[key], value)

    insights = lines(
        F.when(pos > 70, choose(text, "exceptional", fixed(pos)))
        .when(pos > 50, choose(text, "good", fixed(pos)))
        .when(neg > 40, choose(text, "negative", fixed(neg))),
        F.when(neu > 30, choose(text, "neutral", fixed(neu))),
        F.when(_has("themes"), choose(text, "themes", F.array_join(F.slice(theme_names(), 1, 3), ", "))),
        F.when(mood.isin(*BAD_MOODS), choose(text, "bad_mood", mood)).when(
            mood.isin(*GOOD_MOODS), choose(text, "good_mood", mood)
        ),
        F.when(facts > 0.6, text["opinion"]).when(facts < 0.4, text["facts"]),
        F.when(_has("keywords"), choose(text, "keywords", F.array_join(top_words(5), ", "))),
    )

    def troubled(theme: Column) -> Column:
        found = F.lit(False)
        for mark in NEGATIVE_THEME_MARKS:
            found = found | F.lower(theme).contains(mark)
        return found

    theme_advice = F.transform(
        F.filter(F.coalesce(theme_names(), F.array().cast("array<string>")), troubled),
        lambda t: F.format_string(advice["theme"], t),
    )
    recommendations = F.concat(
        lines(
            F.when(pos > 70, advice["exceptional"]).when(pos > 50, advice["good"]).when(neg > 40, advice["negative"]),
            F.when(neu > 30, advice["neutral"]),
        ),
        theme_advice,
        lines(
            F.when(mood.isin(*BAD_MOODS), advice["bad_mood"]).when(mood.isin(*GOOD_MOODS), advice["good_mood"]),
            F.when(facts > 0.6, advice["opinion"]).when(facts < 0.4, advice["facts"]),
        ),
    )
    volume = F.when(total > 50, "high").when(total > 20, "medium").otherwise("low")
    return insights, recommendations, volume


def free_insights() -> Column:
    total = _label_sum()
    pos, neg = percent(F.col("positive"), total), percent(F.col("negative"), total)
    text, facts, top = FREE_TEXT, F.col("avg_subjectivity"), F.get("themes", F.lit(0))
    return lines(
        F.when(pos > 70, F.format_string(text["positive"], fixed(pos)))
        .when(pos > 50, F.format_string(text["good"], fixed(pos)))
        .when(neg > 50, F.format_string(text["negative"], fixed(neg))),
        F.when(_has("themes"), F.format_string(text["theme"], top["theme"], top["mentions"].cast("long"))),
        F.when(facts > 0.6, text["opinion"]).when(facts < 0.4, text["facts"]),
    )


def free_confidence() -> Column:
    return F.when(F.col("avg_confidence") > 0.6, "high").otherwise("medium")


def fallback_insights(total: str = "analyzed", rating: str = "average_rating") -> Column:
    pos, neg, text = label_pct("positive", total), label_pct("negative", total), FALLBACK_TEXT
    n, mean = F.col(total), F.col(rating)
    return F.slice(
        lines(
            F.when(pos > 70, F.format_string(text["excellent"], fixed(pos)))
            .when(pos > 50, F.format_string(text["good"], fixed(pos)))
            .otherwise(F.format_string(text["improve"], fixed(pos))),
            F.when(neg > 30, F.format_string(text["negative"], fixed(neg))),
            F.when(_has("keywords"), F.format_string(text["keywords"], F.array_join(top_words(3), ", "))),
            F.when(n > 100, F.format_string(text["many"], n)).when(n < 20, F.format_string(text["few"], n)),
            F.when(mean >= 4.5, F.format_string(text["premium"], fixed(mean))).when(
                mean >= 4.0, F.format_string(text["above"], fixed(mean))
            ),
        ),
        1, 5,
    )


def template_insights(total: str = "analyzed") -> tuple[Column, Column, Column]:
    """Report text, key insights and fixed recommendations; shares enter as fractions."""
    share = F.when(F.col(total) == 0, 0.0).otherwise(F.col("positive").cast("double") / F.when(F.col(total) != 0, F.col(total)))
    pos = share * 100

    def pick(place: int) -> Column:
        (first, *a), (second, *b), (_, *c) = TEMPLATE_VERDICTS
        return F.when(pos > first, a[place]).when(pos > second, b[place]).otherwise(c[place])

    body = ("\n" + " " * 8).join(TEMPLATE_LINES)
    text = F.format_string(body, F.col(total).cast("long"), pick(0), fixed(pos), pick(1), pick(2))
    key = F.array(
        F.format_string(TEMPLATE_INSIGHTS[0], fixed(pos)), F.format_string(TEMPLATE_INSIGHTS[1], pick(2)),
        F.lit(TEMPLATE_INSIGHTS[2]),
    )
    return text, key, F.array(*[F.lit(a) for a in TEMPLATE_ADVICE])


def api_insights(total: str = "total_reviews") -> tuple[Column, Column]:
    """Verdict sentence and three lines."""
    pos = label_pct("positive", total)
    grade = F.when(pos > 70, "strong").when(pos > 40, "moderate").otherwise("weak")
    top = F.coalesce(F.get("keywords", F.lit(0))["word"], F.lit("N/A"))
    entries = F.array(
        F.format_string(API_TEXT[0], fixed(pos)), F.format_string(API_TEXT[1], F.col("negative")),
        F.format_string(API_TEXT[2], top),
    )
    return F.format_string(API_VERDICT, grade), entries


def _text_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip)


def parse_bullets(text: Column) -> Column:
    """The first five lines that open with a bullet, a digit or an emoji, marks removed."""
    found = F.filter(_text_lines(text), lambda line: line.rlike(BULLET_PATTERN))
    cleaned = F.transform(found, lambda line: strip(F.ltrim(line, F.lit(BULLET_MARKS))))
    return F.slice(cleaned, 1, 5)


def parse_key_lines(text: Column) -> Column:
    """The first three lines longer than 20 characters that are no headings."""
    kept = F.filter(_text_lines(text), lambda line: (F.length(line) > 20) & ~line.startswith("#"))
    return F.slice(kept, 1, 3)


def parse_recommendations(text: Column) -> Column:
    """The first three lines that give advice, capitalized; a default line otherwise."""

    def advises(line: Column) -> Column:
        found = F.lit(False)
        for word in ADVICE_WORDS:
            found = found | line.contains(word)
        return found

    low = F.transform(_text_lines(text), F.lower)
    kept = F.slice(F.filter(low, advises), 1, 3)
    told = F.transform(kept, lambda line: F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 2**31 - 1)))
    return F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(PARSE_DEFAULT_ADVICE)))


def parse_model_bullets(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Add the parsed parts of a model's answer text."""
    value = F.col(text)
    return answers.withColumns(
        {"bullets": parse_bullets(value), "key_lines": parse_key_lines(value), "recommendations": parse_recommendations(value)}
    )
