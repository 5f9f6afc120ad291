"""Lexicon sentiment of reviews and its aggregates.

All valences are integers (units of 1e-7), so sums are exact and do not depend
on the order of rows or on the partitioning.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.binding import let
from reviewloom.functions.rounding import percent, round_exact
from reviewloom.functions.ratings import rating_sentiment
from reviewloom.functions.text import WORD_BREAK, analysis_text, sql_words, strip
from reviewloom.lexicon import BOOST_DOWN, BOOST_UP, CONTRAST, EMOTICONS, IDIOMS, NEGATIONS, SEED_LEXICON, Entry
from reviewloom.operators.ranking import PRODUCT, first_rows

# Published constants of the valence rule, in units of 1e-7.
UNIT = 10_000_000
TENTH = UNIT // 10
BOOST = (2_930_000, 2_783_500, 2_637_000)  # 0.293, damped by 5 % and 10 %
NEGATION_PERCENT = -74
CAPITALS = 7_330_000  # for a word in capitals among others that are not
BOOST_CAPITALS = (7_330_000, 6_963_500, 6_597_000)  # the same for a word that boosts, damped
MARK_BOOST = 2_920_000  # per exclamation mark, at most four
QUESTION_BOOST = (1_800_000, 9_600_000)  # each of two or three, all beyond
NORMALIZER = 15.0
WORD_BREAK_SQL = WORD_BREAK.replace("\\", "\\\\")
SPACE = "[ \\t\\n\\r]"
#: Texts with an emoticon between white space; only these are split at white space first.
HAS_EMOTICON = f"(?:^|{SPACE})(?:" + "|".join(re.escape(e) for e in EMOTICONS) + f")(?:{SPACE}|$)"
LABELS = ("positive", "neutral", "negative")
SCORES = ["compound", "pos_share", "neu_share", "neg_share", "polarity", "subjectivity"]


def _by_value(entries: Sequence[Entry], field: str) -> dict[int, list[str]]:
    groups = defaultdict(list)
    for entry in entries:
        groups[getattr(entry, field)].append(entry.token)
    return groups


def _lookup_sql(word: str, groups: dict[int, list[str]], unit: int = 1) -> str:
    """Value of a word: one set test per distinct value, whatever the lexicon size."""
    cases = " ".join(f"WHEN {word} IN {sql_words(words)} THEN {value * unit}L" for value, words in groups.items())
    return f"CASE {cases} ELSE 0L END"


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _context_sql(place: str, base: str, lexicon: Sequence[Entry]) -> str:
    """Valence at a place from its own one: words before it boost, damp or negate, and it counts by its side of the contrast.

    The three words before it may boost, damp or negate; a word of the lexicon
    itself does not boost. Before the first contrast word valences count half,
    after it one and a half times.
    """
    tokens = {e.token for e in lexicon}
    up = sql_words([w for w in BOOST_UP if w not in tokens])
    down = sql_words([w for w in BOOST_DOWN if w not in tokens])
    near = [f"get(t.w, {place} - {d})" for d in (1, 2, 3)]
    boosts = " + ".join(
        f"CASE WHEN {word} IN {up} OR {word} IN {down} THEN CASE WHEN {word} IN {up} THEN {size}L ELSE -{size}L END"
        f" + CASE WHEN t.mixed AND get(t.raw, {place} - {d}) = upper({word}) THEN {capitals}L ELSE 0L END ELSE 0L END"
        for d, word, size, capitals in zip((1, 2, 3), near, BOOST, BOOST_CAPITALS)
    )
    negated = " OR ".join(f"{word} IN {sql_words(NEGATIONS)}" for word in near)
    parts = f"named_struct('base', {base}, 'boost', {boosts}, 'negated', coalesce({negated}, false))"
    boosted = "(h.base + CASE WHEN h.base < 0 THEN -h.boost ELSE h.boost END)"
    valence = f"CASE WHEN h.negated THEN ({boosted} div 100) * {NEGATION_PERCENT}L ELSE {boosted} END"
    return f"""get(transform(transform(array({parts}), h -> {valence}), v ->
        CASE WHEN t.contrast = 0 OR {place} + 1 = t.contrast THEN v WHEN {place} + 1 < t.contrast THEN v div 2 ELSE v * 3 div 2 END), 0)"""


def _hit_sql(lexicon: Sequence[Entry]) -> str:
    """Struct for the lexicon word or emoticon at place ``i``: valence, polarity, subjectivity, whether it is a word.

    Written as SQL text because a lexicon holds many literals. A word within an
    idiom has no valence of its own.
    """
    word = _lookup_sql("get(t.w, i)", _by_value(lexicon, "valence"), TENTH)
    marks = defaultdict(list)
    for mark, tenths in EMOTICONS.items():
        marks[tenths].append(mark)
    base = f"CASE WHEN get(t.raw, i) IN {sql_words(EMOTICONS)} THEN {_lookup_sql('get(t.raw, i)', marks, TENTH)} ELSE {word} END"
    loud = f"t.mixed AND get(t.raw, i) = upper(get(t.w, i)) AND get(t.raw, i) NOT IN {sql_words(EMOTICONS)}"
    capitals = f"get(transform(array({base}), b -> b + CASE WHEN {loud} THEN CASE WHEN b < 0 THEN -{CAPITALS}L ELSE {CAPITALS}L END ELSE 0L END), 0)"
    return f"""named_struct(
        'v', CASE WHEN exists(t.idioms, x -> x.i <= i AND i < x.i + x.n) THEN 0L ELSE {_context_sql('i', capitals, lexicon)} END,
        'p', {_lookup_sql("get(t.w, i)", _by_value(lexicon, "polarity"))},
        's', {_lookup_sql("get(t.w, i)", _by_value(lexicon, "subjectivity"))},
        'word', get(t.raw, i) NOT IN {sql_words(EMOTICONS)})"""


def _idiom_sql() -> str:
    """Idioms of ``w`` as (i, n, tenths): at each place the longest, and none that begins inside an earlier one."""
    by_length: dict[int, list[str]] = defaultdict(list)
    for phrase in IDIOMS:
        by_length[len(phrase.split())].append(phrase)
    joined = {n: f"concat_ws(' ', slice(w, i + 1, {n}))" for n in by_length}
    cases = " ".join(f"WHEN {joined[n]} IN {sql_words(by_length[n])} THEN {n}" for n in sorted(by_length, reverse=True))
    first = sql_words(sorted({p.split()[0] for p in IDIOMS}))
    values = " ".join(f"WHEN {_sql_text(p)} THEN {v}L" for p, v in IDIOMS.items())
    met = f"filter(transform(filter(sequence(0, size(w) - 1), i -> get(w, i) IN {first}), i -> named_struct('i', i, 'n', CASE {cases} ELSE 0 END)), x -> x.n > 0)"
    free = "filter(m, x -> NOT exists(m, y -> y.i < x.i AND x.i < y.i + y.n))"
    return f"get(transform(array({met}), m -> transform({free}, x -> named_struct('i', x.i, 'n', x.n, 'v', CASE concat_ws(' ', slice(w, x.i + 1, x.n)) {values} ELSE 0L END))), 0)"


def _hits(text: str, lexicon: Sequence[Entry]) -> Column:
    """Scored words, emoticons and idioms of a text column, and its number of words.

    Words keep their case beside the lower one. ``mixed``: some word is not in
    capitals, so that those which are stand out.
    """
    words = f"split({text}, '{WORD_BREAK_SQL}')"
    marked = f"filter(flatten(transform(split({text}, {_sql_text(SPACE)}), x -> CASE WHEN x IN {sql_words(EMOTICONS)} THEN array(x) ELSE split(x, '{WORD_BREAK_SQL}') END)), x -> x <> '')"
    raw = f"CASE WHEN {text} RLIKE {_sql_text(HAS_EMOTICON)} THEN {marked} ELSE {words} END"
    mixed = f"CASE WHEN {text} RLIKE '\\\\p{{Lu}}\\\\p{{Lu}}' THEN exists(raw, x -> x <> '' AND NOT (x = upper(x) AND x <> lower(x))) ELSE false END"
    bound = f"""named_struct('raw', raw, 'w', w, 'mixed', {mixed}, 'contrast', array_position(w, '{CONTRAST}'), 'idioms', {_idiom_sql()})"""
    found = f"filter(sequence(0, size(t.w) - 1), i -> get(t.w, i) IN {sql_words([e.token for e in lexicon])} OR get(t.raw, i) IN {sql_words(EMOTICONS)})"
    idioms = f"transform(t.idioms, x -> named_struct('v', {_context_sql('x.i', f'x.v * {TENTH}L', lexicon)}, 'p', 0L, 's', 0L, 'word', false))"
    scored = f"""named_struct(
        'hits', concat(transform({found}, i -> {_hit_sql(lexicon)}), {idioms}),
        'words', size(filter(t.w, x -> x <> '')))"""
    lowered = f"transform(array(transform(raw, x -> lower(x))), w -> {bound})"
    return F.expr(f"get(transform(flatten(transform(array({raw}), raw -> {lowered})), t -> {scored}), 0)")


def _mark_emphasis(text: Column) -> Column:
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    each, beyond = QUESTION_BOOST
    asked = F.when(questions <= 1, 0).when(questions <= 3, questions * each).otherwise(beyond)
    return (F.least(marks, F.lit(4)) * MARK_BOOST + asked).cast("long")


def compound_of(valence: Column) -> Column:
    """Normalized score in [-1, 1] with four decimals from a summed valence."""
    value = valence.cast("double") / float(UNIT)
    return round_exact(let(value, lambda v: v / F.sqrt(v * v + NORMALIZER)), 4)


def _emphasized(total: Column, emphasis: Column) -> Column:
    return F.when(total > 0, total + emphasis).when(total < 0, total - emphasis).otherwise(total)


def lexicon_sentiment(
    reviews: DataFrame, form: str = "title_body", lexicon: Sequence[Entry] = SEED_LEXICON, text: Column | None = None
) -> DataFrame:
    """Add compound, positive/neutral/negative shares, polarity and subjectivity.

    Everything is computed inside the row: no explode and no shuffle. Words
    are looked up in lower case; capitals among other words, boosting and negating
    words before, the side of a contrast, idioms and emoticons change a valence.
    ``valence`` keeps the exact sum before emphasis for group scores.
    """
    source = analysis_text(form) if text is None else text
    base = reviews.withColumn("__t", source)
    base = base.withColumn("__h", _hits("__t", lexicon)).withColumn("__e", _mark_emphasis(F.col("__t")))

    def total(field: str, part: Callable[[Column], Column] | None = None) -> Column:
        values = F.transform(F.col("__h.hits"), lambda h: h[field])
        if part is not None:
            values = F.filter(values, part)
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)

    def count(part: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(F.col("__h.hits"), lambda h: part(h["v"]))).cast("long")  # times UNIT, 215 hits pass an int

    sums = base.select(
        *reviews.columns, "__e",
        F.col("__h.words").alias("__n"), F.size(F.filter(F.col("__h.hits"), lambda h: h["word"])).alias("__k"),
        total("v").alias("valence"), total("p").alias("__p"), total("s").alias("__s"),
        total("v", lambda v: v > 0).alias("__pos"), total("v", lambda v: v < 0).alias("__neg"),
        count(lambda v: v > 0).alias("__npos"), count(lambda v: v < 0).alias("__nneg"),
    )
    # each scored word counts its valence plus one, emphasis goes to the larger side
    pos = F.col("__pos") + F.col("__npos") * UNIT
    neg = -F.col("__neg") + F.col("__nneg") * UNIT
    pos = pos + F.when(F.col("__pos") > -F.col("__neg"), F.col("__e")).otherwise(0)
    neg = neg + F.when(F.col("__pos") < -F.col("__neg"), F.col("__e")).otherwise(0)
    neu = (F.col("__n") - F.col("__npos") - F.col("__nneg")) * F.lit(UNIT).cast("long")
    shares = sums.withColumns({"__a": pos, "__b": neg, "__c": neu})

    def share(name: str) -> Column:
        whole = F.col("__a") + F.col("__b") + F.col("__c")
        return F.when(whole == 0, 0.0).otherwise(round_exact(F.col(name).cast("double") / whole.cast("double"), 3))

    def mean(name: str) -> Column:
        return F.when(F.col("__k") == 0, 0.0).otherwise(F.col(name).cast("double") / (F.col("__k").cast("long") * 100).cast("double"))

    return shares.select(
        *reviews.columns,
        "valence",
        compound_of(_emphasized(F.col("valence"), F.col("__e"))).alias("compound"),
        share("__a").alias("pos_share"), share("__c").alias("neu_share"), share("__b").alias("neg_share"),
        mean("__p").alias("polarity"), mean("__s").alias("subjectivity"),
    )


def sentiment_label(score: Column, cut: float = 0.05) -> Column:
    return F.when(score >= cut, "positive").when(score <= -cut, "negative").otherwise("neutral")


def sentiment_confidence(compound: Column) -> Column:
    return F.abs(compound)


def skip_blank(reviews: DataFrame, form: str = "title_body") -> DataFrame:
    """``title_body``: drop blank title and text; ``body``: drop an empty text."""
    text = analysis_text(form)
    return reviews.filter(strip(text) != "" if form == "title_body" else text != "")


def score_sentiment(
    reviews: DataFrame, cut: float = 0.05, form: str = "title_body", lexicon: Sequence[Entry] = SEED_LEXICON
) -> DataFrame:
    """Scores plus label and confidence of a single-model variant."""
    scored = lexicon_sentiment(reviews, form, lexicon)
    return scored.withColumn("sentiment", sentiment_label(F.col("compound"), cut)).withColumn(
        "confidence", sentiment_confidence(F.col("compound"))
    )


def ensemble_vote(
    scored: DataFrame, cut: float = 0.1, external: tuple[str, str] | None = None
) -> DataFrame:
    """Weighted vote of compound (1.0), polarity (0.8) and an optional outside model (1.2).

    ``external`` names the columns with the outside label and score.  Ties go
    to positive, then negative, then neutral; no weight at all is neutral with
    confidence 0.
    """
    votes = [
        (sentiment_label(F.col("compound"), cut), F.abs("compound")),
        (sentiment_label(F.col("polarity"), cut), F.abs("polarity") * 0.8),
    ]
    if external:
        label, score = external
        votes.append((F.lower(F.col(label)), F.coalesce(F.col(score), F.lit(0.0)) * 1.2))

    def weight_of(name: str) -> Column:
        return sum((F.when(label == name, weight).otherwise(0.0) for label, weight in votes), F.lit(0.0))

    voted = scored.withColumns({f"__{n}": weight_of(n) for n in LABELS})
    whole = sum((weight for _, weight in votes), F.lit(0.0))
    top = F.greatest("__positive", "__negative", "__neutral")
    winner = (
        F.when(whole == 0, "neutral")
        .when(F.col("__positive") == top, "positive")
        .when(F.col("__negative") == top, "negative")
        .otherwise("neutral")
    )
    sure = F.when(whole == 0, 0.0).otherwise(F.least(top / F.when(whole == 0, 1.0).otherwise(whole), F.lit(1.0)))
    return voted.withColumn("sentiment", winner).withColumn("confidence", sure).drop(*[f"__{n}" for n in LABELS])


def external_label(reviews: DataFrame, model: DataFrame, key: str = "review_id") -> DataFrame:
    """Attach an outside model's ``(label, score)`` per review, computed elsewhere."""
    return reviews.join(model.select(key, F.col("label").alias("model_label"), F.col("score").alias("model_score")), key, "left")


def model_input(reviews: DataFrame, length: int = 512) -> DataFrame:
    """Text that an outside model would see (its own input limit)."""
    return reviews.select("review_id", F.substring(analysis_text(), 1, length).alias("model_text"))


def sentiment_aggregates(where: Column | None = None) -> list[Column]:
    """Counts per label, and exact sums of the scores in units of 1e-9."""
    keep = F.lit(True) if where is None else where
    label = F.col("sentiment")
    counts = [F.count_if(keep & (label == name)).alias(name) for name in LABELS]
    nano = [
        F.sum(F.when(keep, F.round(F.col(c) * 1e9).cast("long")).otherwise(0)).alias(f"__sum_{c}")
        for c in ("polarity", "subjectivity", "confidence")
    ]
    return [F.count_if(keep).alias("analyzed"), *counts, *nano]


def mean_of(name: str, total: str = "analyzed") -> Column:
    """Mean of an exactly summed score."""
    return F.when(F.col(total) == 0, 0.0).otherwise(
        F.col(f"__sum_{name}").cast("double") / 1e9 / F.when(F.col(total) == 0, 1).otherwise(F.col(total)).cast("double")
    )


def sentiment_distribution(scored: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    return scored.groupBy(*keys).agg(*[F.count_if(F.col("sentiment") == n).alias(n) for n in LABELS])


def sentiment_metrics(scored: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    grouped = scored.groupBy(*keys).agg(*sentiment_aggregates())
    return grouped.select(
        *keys, "analyzed",
        *[round_exact(mean_of(c), 3).alias(f"avg_{c}") for c in ("polarity", "subjectivity", "confidence")],
    )


def sentiment_percentages(distribution: DataFrame, total: str | None = None) -> DataFrame:
    """Shares of the labels in ``total``, or in the sum of the labels."""
    whole = F.col(total) if total else F.col("positive") + F.col("neutral") + F.col("negative")
    return distribution.select("*", *[percent(F.col(n), whole).alias(f"{n}_pct") for n in LABELS])


def sentiment_pie(distribution: DataFrame, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Label rows with a positive count."""
    rows = distribution.select(
        *keys, F.expr("stack(3, 'Positive', positive, 'Neutral', neutral, 'Negative', negative) as (name, value)")
    )
    return rows.filter(F.col("value") > 0)


def sentiment_by_day(scored: DataFrame, keys: Sequence[str] = PRODUCT, days: int = 10) -> DataFrame:
    """Label counts per calendar day, the first days in order of appearance.

    A missing label falls back to the rating (4 and 2 as cuts); a missing date
    is the day ``Unknown``.
    """
    day = F.coalesce(F.date_format(F.col("review_date").try_cast("timestamp"), "MMM d"), F.lit("Unknown"))
    label = F.coalesce(F.col("sentiment"), rating_sentiment(F.coalesce(F.col("rating"), F.lit(3.0)), 4.0, 2.0))
    rows = scored.select(*keys, "seq", day.alias("day"), label.alias("__label"))
    grouped = rows.groupBy(*keys, "day").agg(
        *[F.count_if(F.col("__label") == n).alias(n) for n in LABELS], F.min("seq").alias("__first")
    )
    ranked = first_rows(grouped, keys, [F.col("__first").asc(), F.col("day").asc()], days, "position")
    return ranked.drop("__first")


def reviews_in_bucket(scored: DataFrame) -> DataFrame:
    """One row per review and bucket: by label, or by rating (4 and more, 3, 2 and less)."""
    rating = F.coalesce(F.col("rating"), F.lit(0.0))
    by_rating = F.when(rating >= 4, "positive").when(rating <= 2, "negative").when(rating == 3, "neutral")
    buckets = F.array_distinct(F.array_compact(F.array(F.col("sentiment"), by_rating)))
    return scored.withColumn("bucket", F.explode(buckets))
