from datetime import datetime

from pyspark.sql import functions as F

from reviewloom.operators import growth
from reviewloom.sources.shared import new_path
from reviewloom.streaming.growth import stream_growth
from reviewloom.operators.bots import bulk_days
from reviewloom.streaming.run import run_available, run_latest
from reviewloom.streaming.scoring import stream_bulk_days, stream_bulk_state, stream_score_reviews

SNAP = "product_id string, ts timestamp, review_count long, rating double"


def land(spark, path, rows):
    data = [(p, datetime.fromisoformat(t), n, r) for p, t, n, r in rows]
    spark.createDataFrame(data, SNAP).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_for_closed_days(spark):
    path = new_path(spark, "snap")
    rows = [("P", f"2024-01-{1 + i // 4:02d}T{i % 4 * 5:02d}:00:00", 100 + i, 3 + i % 7 / 10) for i in range(40)]
    land(spark, path, rows)
    stream = spark.readStream.schema(SNAP).parquet(path)
    got = run_available(stream_growth(stream), "g").select("product_id", "date", "mean_buyers", "mean_rating")
    batch = growth.daily_means(growth.estimate_buyers(spark.read.schema(SNAP).parquet(path)))
    expected = batch.filter(F.col("date") <= "2024-01-08").select("product_id", "date", "mean_buyers", "mean_rating")
    assert sorted(got.collect()) == sorted(expected.collect()) and got.count() == 8


def test_rows_behind_the_watermark_are_dropped(spark):
    path = new_path(spark, "late")
    land(spark, path, [("P", "2024-01-01T01:00:00", 100, 4.0), ("P", "2024-01-05T00:00:00", 100, 4.0)])
    stream = stream_growth(spark.readStream.schema(SNAP).parquet(path))
    table, state = new_path(spark, "t"), new_path(spark, "s")

    def run():
        query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    land(spark, path, [("P", "2024-01-01T02:00:00", 900, 1.0), ("P", "2024-01-09T00:00:00", 100, 4.0)])
    run()
    first = spark.read.parquet(table).filter("date = '2024-01-01'").collect()
    assert [(r.snapshots, r.mean_buyers) for r in first] == [(1, 5000.0)]


def test_scoring_stream_equals_batch(spark, small_reviews):
    path = new_path(spark, "rev")
    small_reviews.write.parquet(path)
    batch = stream_score_reviews(spark.read.schema(small_reviews.schema).parquet(path), raw=False)
    got = run_available(stream_score_reviews(spark.readStream.schema(small_reviews.schema).parquet(path), raw=False), "sc")
    cols = ["review_id", "bot_score", "compound", "joy", "neutral"]
    assert sorted(got.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_bulk_days_stream(spark, make):
    path = new_path(spark, "bulk")
    rows = [{"review_date": "2024-01-01T0%d:00:00" % i, "rating": 4.0} for i in range(5)] + [{"review_date": "2024-01-09"}]
    make(*rows).write.parquet(path)
    stream = spark.readStream.schema(make(*rows).schema).parquet(path)
    out = run_available(stream_bulk_days(stream), "b").collect()
    assert [(r.product_id, str(r.date), r.reviews, r.rating) for r in out] == [("P", "2024-01-01", 5, 4.0)]


def test_bulk_state_equals_batch_with_undated_reviews(spark, make):
    path = new_path(spark, "bulk-state")
    first = [{"review_date": "", "rating": 4.0}] * 4 + [{"review_date": "2024-01-01T01", "rating": 2.0}] * 5 + [{"review_date": None}] * 6
    second = [{"review_date": "", "rating": 4.0}, {"review_date": "2024-01-01T02", "rating": 3.0}] + [{"review_date": "soon", "product_id": None}] * 5
    for rows in (first, second):
        make(*rows).coalesce(1).write.mode("append").parquet(path)
    schema = make(*first).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_latest(stream_bulk_state(stream), ["product_id", "day"], "bs").where("bulk").select("product_id", "day", "reviews")
    batch = bulk_days(spark.read.schema(schema).parquet(path)).select("product_id", "__day", "__n")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr) == [("P", "", 5), (None, "soon", 5)]


def test_open_days_are_in_the_latest_rows(spark):
    path = new_path(spark, "snap-all")
    rows = [("P", f"2024-01-{1 + i // 4:02d}T{i % 4 * 5:02d}:00:00", 100 + i, 3 + i % 7 / 10) for i in range(40)]
    land(spark, path, rows[:22])
    land(spark, path, rows[22:])
    stream = spark.readStream.schema(SNAP).option("maxFilesPerTrigger", 1).parquet(path)
    got = run_latest(stream_growth(stream), ["product_id", "date"], "ga").select("product_id", "date", "mean_buyers", "mean_rating")
    batch = growth.daily_means(growth.estimate_buyers(spark.read.schema(SNAP).parquet(path)))
    assert sorted(got.collect()) == sorted(batch.select("product_id", "date", "mean_buyers", "mean_rating").collect()) and got.count() == 10
