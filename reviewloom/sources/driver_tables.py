"""Adapters from the benchmark tables to the tables of the engine.

The prose of the ``documents`` table seldom contains review words, so a phrase
chosen by the document id precedes the whole text of each. Every third document
gives a second, short review of the phrase alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture phrases by remainder of the document id.
TITLES = ["", "Good value", "Not what I hoped", "Works fine"]
# Divisible by all numbers up to 20, so that a short review's number has the remainders of its document's.
SHORT_SEQ = 1_163_962_800
COUNTRIES = ["US", "UK", "DE", "CA", "IN"]
PHRASES = [
    "Great product!",
    "Terrible build, I regret the cost.",
    "I love the design and the price is worth it.",
    "Shipping was slow and the package arrived open.",
    "Not good, I hate the color.",
    "Very easy setup, excellent quality, highly recommend, fast shipping.",
    "wow wow wow wow so so",
    "Worried about safety!!!!!! but support did help.",
    "It fits the shelf.",
    "Reliable and sturdy, excited for the next one.",
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a table that has fewer files than there are cores.

    A file of one row group is read by one task; a table of many files keeps
    its own splits and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def reviews_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical reviews: one with the whole text of each document, and a short one for every third."""
    doc = F.col("doc_id")
    block = F.floor(doc / 20)
    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    phrase, short = _pick(PHRASES, doc % 10), F.col("short")
    kinds = F.when(doc % 3 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return docs.withColumn("short", F.explode(kinds)).select(
        F.concat(F.when(short, "X").otherwise("R"), doc).alias("review_id"),
        F.concat(F.lit("B"), F.lpad((doc % 20).cast("string"), 9, "0")).alias("product_id"),
        _pick(COUNTRIES, doc % 5).alias("country"),
        _pick(TITLES, doc % 4).alias("title"),
        F.when(short, phrase).otherwise(F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit("")))).alias("body"),
        F.when(doc % 20 == 0, 5.0).otherwise((1 + (block * 7 + doc) % 5).cast("double")).alias("rating"),
        F.when(doc % 6 == 0, F.concat(F.lit("customer"), doc))
        .when(doc % 6 == 1, "user7")
        .when(doc % 6 == 2, "")
        .otherwise(F.concat(F.lit("Reader "), doc % 50))
        .alias("author"),
        F.concat(F.lit("2024-01-"), F.lpad((1 + block % 7).cast("string"), 2, "0"), F.lit("T00:00:00")).alias("review_date"),
        (doc % 3 != 0).alias("verified"),
        (doc % 4).cast("int").alias("helpful_count"),
        F.when(short, doc + SHORT_SEQ).otherwise(doc).alias("seq"),
    )


def snapshots_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth snapshots, one per event, without an estimate of buyers."""
    return snapshot_columns(_table(spark, sf_dir, "events"))


def snapshot_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("B"), F.lpad((F.col("user_id") % 20).cast("string"), 9, "0")).alias("product_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        (100 + F.col("event_id") % 400).alias("review_count"),
        (3 + (F.col("event_id") % 20) / 10).alias("rating"),
    )


def raw_items_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reviews in the form in which a collector delivers them."""
    r = reviews_from_documents(spark, sf_dir)
    day = F.to_date(F.substring("review_date", 1, 10))
    return r.select(
        F.col("review_id").alias("id"),
        F.col("title").alias("reviewTitle"),
        F.col("body").alias("reviewDescription"),
        F.format_string("%.1f out of 5 stars", "rating").alias("reviewRating"),
        F.concat(F.lit("Reviewed in the country on "), F.date_format(day, "MMMM d, yyyy")).alias("reviewDate"),
        F.nullif(F.col("author"), F.lit("")).alias("reviewAuthor"),
        F.when(F.col("verified"), True).alias("isVerified"),
        F.nullif(F.col("helpful_count"), F.lit(0)).alias("helpfulCount"),
        F.col("country"),
        F.when(F.col("seq") % 3 == 1, F.concat(F.lit("Product "), F.col("product_id"), F.lit(" "), F.col("seq"))).alias("productTitle"),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Item "), F.col("seq"))).alias("title"),
        F.when(F.col("seq") % 7 != 0, "House brand").alias("brand"),
        F.concat(F.lit("$"), F.col("seq") % 90 + 10, F.lit(".99")).alias("price"),
        F.col("product_id").alias("asin"),
        F.when(F.col("seq") % 5 == 0, 4.5).alias("averageRating"),
        F.lit(4.0).alias("stars"),
        F.lit(None).cast("long").alias("totalReviews"),
        F.col("seq").alias("reviewsCount"),
        F.concat(F.lit("https://img.example.com/"), F.col("seq")).alias("thumbnailImage"),
        F.col("seq"),
    )


def pages_from_documents(spark: SparkSession, sf_dir: str, per_page: int = 10) -> DataFrame:
    """Review pages of up to ten reviews, built from the same reviews."""
    r = reviews_from_documents(spark, sf_dir)

    def escaped(name):
        out = F.col(name)
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(char), F.lit(entity))
        return out

    block = F.concat(
        F.lit('<div data-hook="review"'),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit(' id="'), F.col("review_id"), F.lit('"'))).otherwise(""),
        F.lit('><i data-hook="review-star-rating"><span class="a-icon-alt">'),
        F.format_string("%.1f out of 5 stars", "rating"),
        F.lit('</span></i><a data-hook="review-title" href="#"><span>'), escaped("title"),
        F.lit('</span><span>ignored</span></a><span data-hook="review-date">Reviewed in the country on '),
        F.date_format(F.to_date(F.substring("review_date", 1, 10)), "MMMM d, yyyy"),
        F.lit('</span><br><span data-hook="review-body"><span>'), escaped("body"), F.lit("</span></span>"),
        F.when(F.col("verified"), '<span data-hook="avp-badge">Verified</span>').otherwise(""),
        F.when(
            F.col("helpful_count") > 0,
            F.concat(F.lit('<span data-hook="helpful-vote-statement">'), F.col("helpful_count"), F.lit(" people found this helpful</span>")),
        ).otherwise(""),
        F.lit("</div>"),
    )
    number = F.floor(F.col("seq") / 20)  # running number of the review within its product
    page = (F.floor(number / per_page) + 1).cast("int")
    rows = r.select(F.col("product_id").alias("asin"), page.alias("page"), "seq", block.alias("block"))
    grouped = rows.groupBy("asin", "page").agg(F.sort_array(F.collect_list(F.struct("seq", "block"))).alias("blocks"))
    return grouped.select(
        (F.col("blocks")[0]["seq"]).alias("page_id"),
        "asin",
        "page",
        F.concat(
            F.lit("<html><body>"),
            F.when(F.col("page") % 2 == 1, F.concat(F.lit('<span id="productTitle"> Title of '), F.col("asin"), F.lit(" </span>"))).otherwise(""),
            F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"),
            F.lit("</body></html>"),
        ).alias("html"),
    )
