"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks.oracle import ORACLE
from checks.queries import QUERIES
from checks.compare import compare
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)


# A cross-section by default; FULL_TWINS=1 runs all of them.
SECTION = [
    "read_raw_items", "explode_nested_items", "extract_reviews_from_html", "product_info", "canonicalize_reviews", "sanitize_reviews",
    "extract_asin", "clean_text", "display_formats", "bulk_posting", "bot_statistics", "lexicon_sentiment", "external_label",
    "sentiment_by_day", "emotion_corpus", "emotion_average", "top_keywords", "keyword_share", "keyword_themes", "aspect_themes",
    "pattern_theme_members", "tfidf_features", "tfidf_features_detailed", "cluster_themes", "cluster_themes_detailed", "topic_themes", "rating_percentages", "analysis_document", "analysis_document_ensemble",
    "analysis_document_free", "analysis_document_api", "country_rollup", "first_available_country",
    "review_context", "growth_series_day", "growth_metrics", "review_samples_best", "parse_model_bullets", "summaries_api",
    "report_pdf_sections", "stream_growth_days", "stream_scored_reviews",
]
NAMES = sorted(QUERIES) if os.environ.get("FULL_TWINS") else SECTION


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    line = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("OK"), line
