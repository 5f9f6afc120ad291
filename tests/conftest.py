import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Reviews from partial dicts; missing fields get plain defaults."""
    from reviewloom.schema import REVIEW

    base = {
        "review_id": "", "product_id": "P", "country": "US", "title": "", "body": "", "rating": 3.0, "author": "Ann Lee",
        "review_date": "2024-01-01T00:00:00", "review_ts": None, "verified": True, "helpful_count": 1, "images": [],
        "variant": "", "source": "test", "seq": 0,
    }

    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            full.append({**base, "review_id": f"R{i}", "seq": i, **row})
        return spark.createDataFrame([tuple(r[f.name] for f in REVIEW.fields) for r in full], REVIEW)

    return build


@pytest.fixture(scope="session")
def small_reviews(spark):
    from reviewloom.sources.driver_tables import reviews_from_documents

    return reviews_from_documents(spark, SMALL)
