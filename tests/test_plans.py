"""Whole analyses: invariance, independence of products, plan shape, texts."""

from pyspark.sql import functions as F

from reviewloom.operators import bots, countries, insights, keywords, ranking, report, samples, sentiment
from reviewloom.plans.analysis import analysis_document


def canonical(df):
    return sorted(map(str, df.collect()))


def test_result_does_not_depend_on_partitioning(small_reviews):
    shuffled = small_reviews.orderBy(F.xxhash64("review_id")).repartition(7)
    a = analysis_document(small_reviews, write_once=False)
    b = analysis_document(shuffled)
    assert canonical(a) == canonical(b)


def test_one_product_alone_gives_the_same_row(small_reviews):
    product = "B000000007"
    whole = analysis_document(small_reviews, write_once=False).filter(F.col("product_id") == product)
    alone = analysis_document(small_reviews.filter(F.col("product_id") == product), write_once=False)
    assert canonical(whole) == canonical(alone)


def test_product_with_only_bots_keeps_a_row(make):
    rows = [{"body": "Perfect!", "rating": 5.0, "verified": False, "author": "123"}] * 2 + [{"body": "The lamp is of good quality and stands well", "product_id": "Q"}]
    doc = {r.product_id: r for r in analysis_document(make(*rows)).collect()}
    assert doc["P"].bot_count == 2 and doc["P"].analyzed == 0 and doc["P"].summaries.positive_highlights == "N/A"
    assert doc["P"].insights == ["🤖 Filtered 2 bot/fake reviews (100.0%)"] and doc["P"].emotions.joy == 0.0
    assert doc["Q"].insights[0] == "⭐ Excellent satisfaction: 100.0% positive reviews"


def test_cap_limits_the_analysis_but_not_the_counts(small_reviews):
    doc = analysis_document(small_reviews, limit=4, with_samples=False).first()
    assert doc.total_reviews == small_reviews.where(F.col("product_id") == doc.product_id).count() and doc.bot_total == 4


def test_group_limit_runs_before_the_shuffle(small_reviews):
    for df in (
        keywords.top_keywords(small_reviews), ranking.max_reviews(small_reviews, 3),
        samples.review_samples(sentiment.score_sentiment(small_reviews)),
    ):
        assert "Partial" in [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "WindowGroupLimit" in line][-1]


def test_long_lists_take_a_salted_first_round(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id"))
    out = ranking.first_rows(rows, ["k"], [F.col("id").asc()], 1500)
    assert out.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).orderBy("k").collect() == [(0, 1500, 2998), (1, 1500, 2999)]


def test_growth_metrics_read_the_snapshots_once(spark):
    from datetime import datetime

    from reviewloom.operators import growth
    from reviewloom.sources.driver_tables import snapshots_from_events
    from tests.conftest import SMALL

    out = growth.growth_metrics(growth.estimate_buyers(snapshots_from_events(spark, SMALL)), datetime(2024, 1, 31))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_group_facts_take_one_join(spark, small_reviews):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bots.analyze_bots(small_reviews)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_first_country_and_rollup(make):
    df = make({"country": "DE"}, {"country": "US"}, {"country": "US"}, {"country": "FR", "product_id": "Q"})
    assert {r.review_id for r in countries.first_available_country(df).collect()} == {"R1", "R2"}
    assert {r.review_id for r in countries.first_available_country(df, "DE").collect()} == {"R0"}
    assert {r.review_id for r in countries.first_available_country(df, "FR").collect()} == {"R1", "R2", "R3"}
    row = countries.country_rollup(df).first()
    assert (row.total_reviews, row.successful_countries, row.failed_countries) == (3, ["US", "DE"], ["UK", "CA"])


def test_best_samples(make):
    df = make(*[{"body": t} for t in ("good", "excellent", "bad", "terrible", "best", "great", "zzz")])
    out = samples.review_samples(sentiment.score_sentiment(df), "best").collect()
    first = {(r.sentiment, r.sample_rank): r.body for r in out}
    assert first["positive", 1] == "best" and first["negative", 1] == "bad" and first["neutral", 1] == "zzz"
    assert sum(r.sentiment == "positive" for r in out) == 3


def test_parse_answer(spark):
    text = "# Heading that is long enough to count\n- one insight\n2. You should sell more lamps\n🎯 aim high\nplain line with more than twenty letters\n• 5 stars"
    row = insights.parse_model_bullets(spark.createDataFrame([(text,), (None,)], "answer string")).collect()
    assert row[0].bullets == ["one insight", "You should sell more lamps", "🎯 aim high", "stars"]
    assert row[0].key_lines == ["2. You should sell more lamps", "plain line with more than twenty letters"]
    assert row[0].recommendations == ["2. you should sell more lamps"] and row[1].recommendations == [insights.PARSE_DEFAULT_ADVICE]


def test_report_files(spark, small_reviews, tmp_path):
    from datetime import datetime

    doc = analysis_document(small_reviews)
    paths = report.write_report(report.report_sections(doc, small_reviews), str(tmp_path), datetime(2024, 5, 6, 7, 8, 9), "parquet")
    assert set(paths) == {"summary", "keywords", "themes", "insights", "ratings", "reviews"}
    assert paths["summary"].endswith("analysis_all_20240506_070809/summary")
    assert spark.read.parquet(paths["ratings"]).count() == 100
    assert spark.read.parquet(paths["reviews"]).columns == ["product_id", "title", "text", "rating", "author", "date", "verified"]
    assert set(report.report_pdf_sections(doc)) == {"sentiment", "bots", "keywords", "themes", "insights", "ratings"}


def test_keys_of_any_name_stay(small_reviews):
    renamed = small_reviews.withColumnRenamed("product_id", "store_1")
    assert "store_1" in analysis_document(renamed, keys=("store_1",), write_once=False).columns


def test_a_missing_product_is_a_group(make):
    from reviewloom.operators import themes

    df = make({"product_id": None, "body": "nothing here"}, {"product_id": None, "body": "nor here"})
    assert themes.pattern_theme_members(df).count() == 2


def test_written_scores_have_no_texts(small_reviews):
    from reviewloom.plans.analysis import score_table

    table = score_table(small_reviews)
    assert not {"title", "body", "author", "images", "variant", "__low", "__t"} & set(table.columns)
    assert {"review_id", "rating", "sentiment", "compound", "is_bot_likely", "theme_0"} <= set(table.columns)


def test_samples_have_the_texts_of_their_reviews(make):
    from reviewloom.plans.analysis import sample_texts, score_table

    rows = [{"body": f"good thing {i}", "title": f"t{i}", "verified": True} for i in range(9)] + [{"body": "awful thing", "title": "bad", "product_id": None}]
    reviews = make(*rows)
    got = sample_texts(reviews, score_table(reviews, filter_bots=False)).orderBy("seq").collect()
    assert [(r.product_id, r.sentiment, r.title, r.body) for r in got] == [("P", "positive", f"t{i}", f"good thing {i}") for i in range(3)] + [(None, "negative", "bad", "awful thing")]


def test_report_reads_one_document(spark, make, tmp_path):
    from datetime import datetime

    from reviewloom.operators import report
    from reviewloom.plans.analysis import analysis_document
    from reviewloom.operators.sentiment import score_sentiment

    reviews = make(*[{"body": f"great price {i}", "product_id": "AB"[i % 2], "author": f"Person {i}"} for i in range(8)])
    doc = analysis_document(reviews, with_samples=False)
    paths = report.write_whole_report(doc, score_sentiment(reviews), str(tmp_path), datetime(2024, 1, 2), "parquet", keys=("product_id",))
    assert list(paths) == ["summary", "keywords", "themes", "insights", "ratings", "reviews"]
    for path in paths.values():
        assert {r.product_id for r in spark.read.parquet(path).select("product_id").collect()} == {"A", "B"}
