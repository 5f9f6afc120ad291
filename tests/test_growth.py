from datetime import datetime

from pyspark.sql import functions as F

from reviewloom.operators import growth

AS_OF = datetime(2024, 3, 10)


def frame(spark, rows):
    data = [(p, datetime.fromisoformat(t), n, r, b) for p, t, n, r, b in rows]
    return spark.createDataFrame(data, "product_id string, ts timestamp, review_count long, rating double, estimated_buyers long")


def trends(spark, values):
    rows = [("P", f"2024-03-0{4 + i}T12:00:00", 1, 4.0, v) for i, v in enumerate(values)]
    return [r.trend for r in growth.growth_series(frame(spark, rows), AS_OF).orderBy("step_ts").collect()]


def test_trend_edges(spark):
    assert trends(spark, [100]) == ["stable"]
    assert trends(spark, [100, 105, 111, 105]) == ["stable", "stable", "up", "down"]
    assert trends(spark, [0, 50]) == ["stable", "stable"]


def test_day_repeats_the_mean_of_the_date(spark):
    df = frame(spark, [("P", "2024-03-09T05:00:00", 1, 4.0, 10), ("P", "2024-03-09T09:00:00", 1, 5.0, 21)])
    out = growth.growth_series(df, AS_OF, "day").orderBy("step_ts").collect()
    assert len(out) == 24 and {r.buyers for r in out} == {15} and {r.rating for r in out} == {4.5}
    assert out[0].date == "00:00" and out[-1].date == "23:00"


def test_unknown_period_is_a_week_and_quarter_steps_by_seven(spark):
    df = frame(spark, [("P", f"2024-03-0{d}T00:00:00", 1, 4.0, 10) for d in range(1, 10)])
    assert growth.growth_series(df, AS_OF, "decade").count() == growth.growth_series(df, AS_OF, "week").count() == 7
    assert [r.date for r in growth.growth_series(df, AS_OF, "quarter").collect()] == ["2024-03-04"]  # 84 of 90 days on


def test_metrics(spark):
    days = [100, 120, 90, 130, 130]
    df = frame(spark, [("P", f"2024-03-0{4 + i}T00:00:00", 1, 4.0, v) for i, v in enumerate(days)])
    m = growth.growth_metrics(df, AS_OF).first()
    assert (m.weekly_growth, m.weekly_average, m.best_day, m.peak_buyers, m.trend, m.trend_strength) == (30.0, 114, "2024-03-07", 130, "growing", 50.0)
    assert (m.next_week, m.confidence) == (169, "medium")
    assert m.recommendations == [growth.GROWTH_RECOMMENDATIONS["strong"], growth.GROWTH_RECOMMENDATIONS["monthly"]]


def test_store_appends_and_prunes(spark, tmp_path):
    df = frame(spark, [("P", "2024-03-01T00:00:00", 10, 4.0, 0), ("Q", "2024-03-02T00:00:00", 20, 4.0, 0)])
    path = str(tmp_path / "s")
    growth.append_growth_snapshot(df, path)
    growth.append_growth_snapshot(df, path)
    stored = growth.read_growth_snapshots(spark, path).filter(F.col("date") == "2024-03-02")
    assert [(r.product_id, r.estimated_buyers) for r in stored.collect()] == [("Q", 1000)] * 2
    assert "PartitionFilters: [isnotnull(date" in stored._jdf.queryExecution().toString()


def test_period_labels(spark):
    df = frame(spark, [("P", "2024-03-10T00:00:00", 1, 4.0, 150), ("P", "2024-03-09T00:00:00", 1, 4.0, 100)])
    out = growth.period_labels(df, AS_OF, "day").orderBy("position").collect()
    assert [(r.position, r.date, r.label, r.buyers, r.growth_rate) for r in out] == [
        (6, "2024-03-09", "Sat", 100, 0.0), (7, "2024-03-10", "Sun", 150, 50.0)
    ]
    assert [r.label for r in growth.period_labels(df, AS_OF, "decade").collect()] == ["Q12"]


def test_products_without_recent_data_stay(spark):
    df = frame(spark, [("P", "2024-03-08T00:00:00", 1, 4.0, 10), ("Q", "2024-02-15T00:00:00", 1, 4.0, 20), ("R", "2023-01-01T00:00:00", 1, 4.0, 30), (None, "2024-03-08T00:00:00", 1, 4.0, 5)])
    out = {r.product_id: r for r in growth.growth_metrics(df, AS_OF, products=df).collect()}
    assert {k: r.status for k, r in out.items()} == {"P": "ok", "Q": "insufficient_data", "R": "insufficient_data", None: "ok"}
    assert out["Q"].monthly_average == 20 and out["Q"].weekly_average is None and out["Q"].trend is None and out["R"].confidence is None


def test_stored_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "s")
    growth.append_growth_snapshot(frame(spark, [("P", f"2024-03-0{d}T00:00:00", 10, 4.0, 0) for d in range(1, 10)]), path)
    stored = growth.read_growth_snapshots(spark, path)
    for out in (growth.growth_series(stored, AS_OF), growth.period_labels(stored, AS_OF, "day")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(ts" in plan
