"""Summary texts per product, from the one-row-per-product analysis table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.rounding import fixed, percent
from reviewloom.operators.insights import label_pct, theme_names, top_words

# --------------------------------------------------------------------------
# Sentences of the summaries
# --------------------------------------------------------------------------
DEFAULT_TEXT = {
    "empty": ("No reviews available for analysis.", "N/A", "N/A"),
    "overall": "Analyzed %1$d customer reviews with an overall %2$s sentiment. "
    "%3$d reviews were positive (%4$s%%), %5$d were negative (%6$s%%), and %7$d were neutral (%8$s%%). "
    "The most frequently mentioned topics include: %9$s.",
    "praise": "Customers particularly appreciate the %1$s. "
    "Many reviewers highlight the product's strengths in these areas, "
    "with %2$d customers expressing high satisfaction.",
    "no_praise": "Limited positive feedback available.",
    "concern": "Some customers raised concerns about %1$s. "
    "%2$d reviews mentioned issues that may require attention, "
    "particularly regarding quality and performance expectations.",
    "dislike": "%1$d customers expressed dissatisfaction with various aspects of the product.",
    "no_dislike": "No significant negative feedback found.",
}
ENSEMBLE_TEXT = {
    "empty": "No reviews analyzed",
    "start": "Analyzed %d reviews. ",
    "high": "Overall sentiment is positive with strong customer satisfaction. ",
    "middle": "Mixed sentiment indicates room for improvement. ",
    "low": "Negative sentiment suggests significant issues need addressing. ",
    "theme": "Key themes include %s. ",
}
FREE_TEXT = {
    "start": "Analyzed %d reviews using free AI/NLP models. ",
    "high": "Overall sentiment is positive with strong customer satisfaction.",
    "low": "Mixed to negative feedback indicates areas needing improvement.",
    "middle": "Balanced mix of opinions across the customer base.",
}
FALLBACK_TEXT = (
    "Based on %1$d reviews, this product has an average rating of %2$s/5 stars with %3$s. "
    "%4$d customers reported positive experiences, while %5$d noted areas for improvement. "
    "The feedback suggests %6$s."
)
FALLBACK_GRADES = [
    (75, "excellent customer satisfaction"),
    (60, "good customer satisfaction"),
    (40, "mixed customer feedback"),
]
FALLBACK_LOW = "concerns from customers"
FALLBACK_MARKET = ("strong market performance", "opportunity for product enhancement")
DASHBOARD_TEXT = (
    "Analysis of %1$d reviews shows %2$s%% positive, %3$s%% neutral, and %4$s%% negative sentiment. "
    "The average rating is %5$s/5 stars."
)
SHARE_TEXT = "%1$s: %2$s - Avg Rating %3$s/5 based on %4$d reviews. AI Analysis shows %5$s%% positive sentiment."

# The long texts of the "api" variant: the branches are fixed, the wording is ours.
API_EMPTY = ("No reviews available.", "No positive feedback found.", "No negative feedback found.")
API_GRADES = ("strong positive sentiment", "mixed feedback", "concerning negative trends")
API_REMARKS = (
    "Most buyers are content and name quality and value as the reasons.",
    "The reception is favorable on the whole, but some expectations were not met.",
    "Buyers report problems that should be looked into soon.",
)
API_OVERALL = (
    "%1$d customer reviews show %2$s: %3$s%% positive, %4$s%% neutral and %5$s%% negative. %6$s "
    "Frequent words are %7$s."
)
API_PRAISE = "%1$s%% of the reviews are positive. Buyers name %2$s and %3$s most often, and also like the %4$s."
API_BLAME = "%1$s%% of the reviews are negative. Complaints concern %2$s first and %3$s next."
API_WORDS = ("quality", "value")
API_DEFAULT_PRAISE = ("quality", "performance", "design")
API_DEFAULT_BLAME = ("durability", "functionality")


def default_summaries() -> Column:
    """Overall text, positive and negative highlights as a struct."""
    total, pos, neg, neu = (F.col(c) for c in ("analyzed", "positive", "negative", "neutral"))
    text = DEFAULT_TEXT
    some_words = F.coalesce(F.size("keywords") > 0, F.lit(False))
    mood = F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("mixed")
    words = F.when(some_words, F.array_join(top_words(5), ", ")).otherwise("N/A")
    overall = F.format_string(
        text["overall"], total, mood, pos, fixed(label_pct("positive")), neg, fixed(label_pct("negative")),
        neu, fixed(label_pct("neutral")), words,
    )
    praise = F.when(
        (pos > 0) & some_words, F.format_string(text["praise"], F.array_join(top_words(3), ", "), pos)
    ).otherwise(text["no_praise"])
    bad_themes = F.slice(
        F.transform(
            F.filter(F.coalesce("themes", F.array().cast("array<struct<rank:int,theme:string,mentions:bigint,sentiment:string>>")),
                     lambda t: t["sentiment"] == "negative"),
            lambda t: t["theme"],
        ),
        1, 3,
    )
    blame = (
        F.when(neg == 0, text["no_dislike"])
        .when(F.size(bad_themes) > 0, F.format_string(text["concern"], F.lower(F.array_join(bad_themes, ", ")), neg))
        .otherwise(F.format_string(text["dislike"], neg))
    )
    empty = [F.lit(t) for t in text["empty"]]
    none = total == 0
    return F.struct(
        F.when(none, empty[0]).otherwise(overall).alias("overall"),
        F.when(none, empty[1]).otherwise(praise).alias("positive_highlights"),
        F.when(none, empty[2]).otherwise(blame).alias("negative_highlights"),
    )


def api_summaries(total: str = "total_reviews") -> Column:
    n = F.col(total)
    pos, neg, neu = (fixed(label_pct(c, total)) for c in ("positive", "negative", "neutral"))
    share = label_pct("positive", total)
    words = top_words(5)

    def grade(options) -> Column:
        return F.when(share > 70, options[0]).when(share > 40, options[1]).otherwise(options[2])

    listed = F.when(F.coalesce(F.size(words) > 0, F.lit(False)), words).otherwise(F.array(*map(F.lit, API_WORDS)))

    def word(place: int, default: str) -> Column:
        return F.coalesce(F.get(listed, F.lit(place)), F.lit(default))

    overall = F.format_string(
        API_OVERALL, n, grade(API_GRADES), pos, neu, neg, grade(API_REMARKS), F.array_join(F.slice(listed, 1, 3), ", ")
    )
    praise = F.format_string(API_PRAISE, pos, *[word(i, w) for i, w in enumerate(API_DEFAULT_PRAISE)])
    blame = F.format_string(API_BLAME, neg, *[word(i, w) for i, w in enumerate(API_DEFAULT_BLAME)])
    none = n == 0
    return F.struct(
        F.when(none, API_EMPTY[0]).otherwise(overall).alias("overall"),
        F.when(none, API_EMPTY[1]).otherwise(praise).alias("positive_highlights"),
        F.when(none, API_EMPTY[2]).otherwise(blame).alias("negative_highlights"),
    )


def ensemble_summary() -> Column:
    share, text = label_pct("positive"), ENSEMBLE_TEXT
    first = F.get(theme_names(), F.lit(0))
    return F.when(F.col("analyzed") == 0, text["empty"]).otherwise(
        F.concat(
            F.format_string(text["start"], "analyzed"),
            F.when(share > 60, text["high"]).when(share > 40, text["middle"]).otherwise(text["low"]),
            F.coalesce(F.when(first.isNotNull(), F.format_string(text["theme"], F.lower(first))), F.lit("")),
        )
    )


def free_summary() -> Column:
    total = F.col("positive") + F.col("neutral") + F.col("negative")
    pos, neg, text = percent(F.col("positive"), total), percent(F.col("negative"), total), FREE_TEXT
    return F.concat(
        F.format_string(text["start"], "analyzed"),
        F.when(pos > 60, text["high"]).when(neg > 40, text["low"]).otherwise(text["middle"]),
    )


def fallback_summary(total: str = "analyzed", rating: str = "average_rating") -> Column:
    share = label_pct("positive", total)
    grade = F.lit(FALLBACK_LOW)
    for bound, name in reversed(FALLBACK_GRADES):
        grade = F.when(share >= bound, name).otherwise(grade)
    market = F.when(share >= 70, FALLBACK_MARKET[0]).otherwise(FALLBACK_MARKET[1])
    return F.format_string(
        FALLBACK_TEXT, F.col(total), fixed(F.col(rating)), grade, F.col("positive"), F.col("negative"), market
    )


def dashboard_summary(total: str = "total_reviews", summary: Column | None = None) -> Column:
    """The given summary, else one line from the shares; ties round up here."""
    whole = F.col("positive") + F.col("neutral") + F.col("negative")
    shares = [fixed(percent(F.col(c), whole), 0, "up") for c in ("positive", "neutral", "negative")]
    line = F.format_string(DASHBOARD_TEXT, F.col(total), *shares, fixed(F.col("average_rating"), 1, "up"))
    return line if summary is None else F.coalesce(F.nullif(summary, F.lit("")), line)


def share_text(title: Column, name: str = "Review report", total: str = "total_reviews") -> Column:
    whole = F.col("positive") + F.col("neutral") + F.col("negative")
    share = fixed(percent(F.col("positive"), whole), 0, "up")
    return F.format_string(
        SHARE_TEXT, F.lit(name), title, fixed(F.col("average_rating"), 1, "up"), F.col(total), share
    )
