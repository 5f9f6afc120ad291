import math
import re

import pytest
from pyspark.sql import functions as F

from reviewloom import lexicon as lx
from reviewloom.operators import emotions, sentiment

LEX = {e.token: e for e in lx.SEED_LEXICON}


def tokens(text):
    """Words as they are written, emoticons between white space whole."""
    out = []
    for chunk in re.split(r"[ \t\n\r]", text):
        out += [chunk] if chunk in lx.EMOTICONS else re.split(r"[\W]+", chunk)
    return [x for x in out if x]


def brute(text):
    """The valence rule, word by word."""
    raw = tokens(text)
    words = [w.lower() for w in raw]
    capital = [w == w.upper() and w != w.lower() for w in raw]
    mixed = not all(capital)
    contrast = words.index("but") if "but" in words else None
    idioms, total, hits = [], 0, []
    for i in range(len(words)):
        fit = [p for p in lx.IDIOMS if words[i:i + len(p.split())] == p.split()]
        if fit:
            best = max(fit, key=len)
            idioms.append((i, len(best.split()), lx.IDIOMS[best]))
    idioms = [x for x in idioms if not any(y[0] < x[0] < y[0] + y[1] for y in idioms)]

    def context(i, v):
        boost, negated = 0, False
        for d, size, loud in ((1, 2_930_000, 7_330_000), (2, 2_783_500, 6_963_500), (3, 2_637_000, 6_597_000)):
            if i - d >= 0:
                before = words[i - d]
                if before in lx.BOOST_UP or before in lx.BOOST_DOWN:
                    boost += (size if before in lx.BOOST_UP else -size) + (loud if capital[i - d] and mixed else 0)
                negated |= before in lx.NEGATIONS
        v += boost if v >= 0 else -boost
        if negated:
            v = v // 100 * -74
        return v if contrast is None or i == contrast else v // 2 if i < contrast else v * 3 // 2

    for i, w in enumerate(words):
        if raw[i] in lx.EMOTICONS or w in LEX:
            v = (lx.EMOTICONS[raw[i]] if raw[i] in lx.EMOTICONS else LEX[w].valence) * 1_000_000
            if raw[i] not in lx.EMOTICONS and capital[i] and mixed:
                v += 7_330_000 if v >= 0 else -7_330_000
            v = 0 if any(x <= i < x + n for x, n, _ in idioms) else context(i, v)
            total += v
            if raw[i] not in lx.EMOTICONS:
                hits.append((v, LEX[w].polarity, LEX[w].subjectivity))
    total += sum(context(i, v * 1_000_000) for i, _, v in idioms)
    marks, asks = min(text.count("!"), 4) * 2_920_000, text.count("?")
    extra = marks + (0 if asks <= 1 else asks * 1_800_000 if asks <= 3 else 9_600_000)
    full = total + (extra if total > 0 else -extra if total < 0 else 0)
    c = full / 1e7
    n = len(hits) or 1
    return total, round(c / math.sqrt(c * c + 15), 4), sum(h[1] for h in hits) / (100 * n), sum(h[2] for h in hits) / (100 * n)


TEXTS = [
    "Good", "not good", "very good!", "It is not a very good thing, really terrible!!!", "slightly bad, isn't great", "",
    "No love. no hate? why??? what", "absolutely love love love!!!!!!", "plain text without any marks", "¡très good! 数据 awful",
    "great but terrible", "I love it, but it broke. But good", "this is GREAT", "GREAT STUFF", "VERY good and SLIGHTLY bad", "NOT good", "É GOOD é",
    "the food is to die for", "not the bomb", "he is bad ass, in the red", "under the weather :( but on the ball :)", "nice :D", ":) :) fine", "a :/b <3", "12 GOOD 3",
]
#: Valence in units of 1e-7 by hand: contrast, capitals, boosting capitals, idiom, negated idiom, emoticon.
GOLDEN = {
    "but awful": -37_500_000, "good but nice": 9_500_000 + 27_000_000, "GOOD one": 26_330_000, "GOOD": 19_000_000,
    "VERY good": 19_000_000 + 10_260_000, "to die for": 30_000_000, "never to die for": -22_200_000, "shelf :)": 20_000_000, "shelf:)": 0,
}


def test_each_rule_of_the_valence(make):
    out = sentiment.lexicon_sentiment(make(*[{"body": t} for t in GOLDEN]), "body").orderBy("seq").collect()
    assert [r.valence for r in out] == list(GOLDEN.values())


def test_scores_agree_with_brute_force(make):
    out = sentiment.lexicon_sentiment(make(*[{"body": t} for t in TEXTS]), "body").orderBy("seq").collect()
    for row, text in zip(out, TEXTS):
        assert (row.valence, row.compound, row.polarity, row.subjectivity) == pytest.approx(brute(text), abs=1e-12), text
        assert row.pos_share + row.neu_share + row.neg_share == pytest.approx(1.0 if text else 0.0, abs=0.002)


def test_whole_documents_agree_with_brute_force(small_reviews):
    rows = sentiment.lexicon_sentiment(small_reviews).select("title", "body", "valence", "compound").collect()
    for r in rows:
        assert (r.valence, r.compound) == brute(f"{r.title} {r.body}")[:2]


def test_label_cuts_are_inclusive(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (0.1,), (-0.1,)], "c double")
    rows = df.select(sentiment.sentiment_label(F.col("c")), sentiment.sentiment_label(F.col("c"), 0.1)).collect()
    assert [r[0] for r in rows] == ["positive", "negative", "neutral", "positive", "negative"]
    assert [r[1] for r in rows] == ["neutral", "neutral", "neutral", "positive", "negative"]


def test_vote(spark):
    rows = [(0.5, -0.5, None, None), (0.4, -0.5, None, None), (0.0, 0.0, None, None), (0.2, 0.0, "NEGATIVE", 0.9), (0.05, 0.05, None, None)]
    df = spark.createDataFrame(rows, "compound double, polarity double, l string, s double")
    out = sentiment.ensemble_vote(df, external=("l", "s")).collect()
    assert [r.sentiment for r in out] == ["positive", "positive", "neutral", "negative", "neutral"]
    assert out[1].confidence == 0.5 and out[2].confidence == 0.0 and out[4].confidence == 1.0


def test_days_take_the_first_ten_and_fall_back_to_ratings(make):
    rows = [{"review_date": f"2024-03-{d:02d}", "rating": 5.0} for d in range(1, 12)] + [{"review_date": None, "rating": 1.0}]
    out = sentiment.sentiment_by_day(make(*rows).withColumn("sentiment", F.lit(None).cast("string"))).orderBy("position").collect()
    assert [r.day for r in out] == [f"Mar {d}" for d in range(1, 11)] and all(r.positive == 1 for r in out)


def test_a_review_may_land_in_two_buckets(make):
    df = make({"rating": 5.0}, {"rating": 3.0}).withColumn("sentiment", F.lit("negative"))
    out = sorted((r.review_id, r.bucket) for r in sentiment.reviews_in_bucket(df).collect())
    assert out == [("R0", "negative"), ("R0", "positive"), ("R1", "negative"), ("R1", "neutral")]


def test_emotions_match_substrings_and_cap(make):
    df = make({"body": "whatever"}, {"body": "Happy joy LOVE excellent amazing great perfect"})
    hits = emotions.emotion_hits(df).orderBy("seq").collect()
    assert hits[0].hits_anger == 1 and hits[1].hits_joy == 7
    scored = df.withColumns({"polarity": F.lit(0.0), "compound": F.lit(0.0)})
    corpus = emotions.emotion_corpus(scored).first()
    assert corpus.joy == 1.0 and corpus.anger == 0.25 and corpus.trust == 0.0
    up = emotions.emotion_corpus(df.withColumn("polarity", F.lit(0.1))).first()
    assert up.trust == 0.15 and up.joy == 1.0
    plain = emotions.emotion_review(make({"body": "zzz"})).first()
    assert plain.neutral == 1.0 and plain.joy == 0.0


@pytest.mark.parametrize("word, sides", [("good", (1.0, 0.0)), ("bad", (0.0, 1.0))])
def test_shares_of_a_text_with_hundreds_of_scored_words(make, word, sides):
    row = sentiment.lexicon_sentiment(make({"body": f"{word} " * 300})).first()
    assert (row["pos_share"], row["neg_share"], row["neu_share"]) == (*sides, 0.0)


def test_queries_score_reviews_of_many_scored_words(spark, tmp_path):
    from checks.queries import QUERIES

    texts = [("great love good excellent " * 100,), ("terrible bad hate awful " * 100,)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, (t,) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.review_id: r for r in QUERIES["lexicon_sentiment"](spark, str(tmp_path)).collect()}
    assert rows["R0"].pos_share > 0.9 and rows["R1"].neg_share > 0.9
    free = {r.review_id: r for r in QUERIES["lexicon_sentiment_free"](spark, str(tmp_path)).collect()}
    assert free["R0"].sentiment == "positive" and free["R1"].sentiment == "negative"
