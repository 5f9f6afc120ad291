"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from reviewloom.session import local_session  # noqa: E402

HEADLINE = [
    "analysis_document", "bulk_posting", "bot_statistics", "lexicon_sentiment", "sentiment_metrics", "ensemble_vote",
    "emotion_corpus", "emotion_average", "top_keywords", "keyword_share", "keyword_themes", "theme_occurrences",
    "aspect_themes", "pattern_theme_members", "rating_summary", "rating_distribution", "country_rollup",
    "first_available_country", "review_samples", "sentiment_by_day", "canonicalize_reviews", "sanitize_reviews",
    "clean_text", "review_keywords", "extract_reviews_from_html", "tfidf_features", "growth_series_month", "growth_metrics",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session()
    run(spark, sf_dir, "rating_summary")  # warm the JVM
    times = {name: round(statistics.median(run(spark, sf_dir, name) for _ in range(rounds)), 3) for name in names}
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_median_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
