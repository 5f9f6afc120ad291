import random

from pyspark.sql import functions as F

from reviewloom.functions.rounding import fixed, percentage, round_exact


def test_agrees_with_python_rounding(spark):
    rng = random.Random(7)
    values = [p / t * 100 for t in (3, 7, 8, 16, 40, 80, 400, 2000) for p in range(0, t + 1, max(1, t // 40))]
    values += [2.675, 0.125, 0.375, 12.25, 0.15, 0.35, 1.005, -0.125, -2.5, -12.25, 0.5, 1.5]
    values += [rng.uniform(-100, 100) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3, 4):
        got = [r[0] for r in df.select(round_exact(F.col("v"), digits)).collect()]
        assert got == [round(v, digits) for v in values]


def test_fixed_text_and_ties(spark):
    df = spark.createDataFrame([(12.25,), (12.35,), (0.15,), (100.0,), (12.5,)], "v double")
    rows = df.select(fixed(F.col("v")), fixed(F.col("v"), 1, "up"), fixed(F.col("v"), 0, "up")).collect()
    assert [r[0] for r in rows] == ["%.1f" % v for v in (12.25, 12.35, 0.15, 100.0, 12.5)]
    assert [r[1] for r in rows] == ["12.3", "12.3", "0.1", "100.0", "12.5"]
    assert [r[2] for r in rows] == ["12", "12", "0", "100", "13"]


def test_percentage_of_nothing_is_zero(spark):
    row = spark.range(1).select(percentage(F.lit(1), F.lit(3)), percentage(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (33.33, 0.0)
