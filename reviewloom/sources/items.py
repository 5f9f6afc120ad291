"""Raw items to canonical reviews and product rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewloom.functions.ratings import parse_rating, parse_review_date
from reviewloom.functions.text import strip
from reviewloom.operators.ranking import first_rows
from reviewloom.schema import NESTED_ITEM, RAW_ITEM, REVIEW

# Names under which producers deliver each canonical field, in
# order of preference.
ALIASES = {
    "review_id": ["review_id", "id"],
    "product_id": ["product_id", "asin"],
    "country": ["country"],
    "title": ["title", "review_title", "reviewTitle"],
    "body": ["body", "text", "content", "review_text", "reviewDescription"],
    "rating": ["rating", "stars", "reviewRating"],
    "author": ["author", "reviewAuthor"],
    "review_date": ["review_date", "date", "reviewDate"],
    "verified": ["verified", "verified_purchase", "isVerified"],
    "helpful_count": ["helpful_count", "helpful_votes", "helpfulCount"],
    "images": ["images", "reviewImages"],
    "variant": ["variant"],
    "source": ["source"],
    "seq": ["seq"],
}
# A raw item also carries product fields, so only the review names count.
RAW_ALIASES = {
    **ALIASES,
    "title": ["reviewTitle"],
    "body": ["reviewDescription"],
    "rating": ["reviewRating"],
    "review_date": ["reviewDate"],
}
DEFAULTS = {
    "review_id": "", "country": "", "title": "", "body": "", "author": "Anonymous", "variant": "",
    "verified": False, "helpful_count": 0,
}


def read_raw_items(spark: SparkSession, path: str, schema: T.StructType = RAW_ITEM) -> DataFrame:
    """JSON items with a declared schema; only items that hold a review."""
    return raw_reviews_only(spark.read.schema(schema).json(path))


def raw_reviews_only(items: DataFrame) -> DataFrame:
    """Keep an item when its review title or its review text is present."""
    return items.filter(F.col("reviewTitle").isNotNull() | F.col("reviewDescription").isNotNull())


def read_nested_items(spark: SparkSession, path: str) -> DataFrame:
    return explode_nested_items(spark.read.schema(NESTED_ITEM).json(path))


def explode_nested_items(items: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per element of ``reviews``; the position becomes the order."""
    outer = [c for c in items.columns if c != "reviews"]
    return items.select(*outer, F.posexplode("reviews").alias(seq, "review")).select(
        *outer, F.col(seq).cast("long").alias(seq), "review.*"
    )


def _first_alias(df: DataFrame, names: list[str]) -> Column | None:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else None


def canonicalize_reviews(df: DataFrame, source: str = "items", raw: bool | None = None) -> DataFrame:
    """Fold field names into the canonical schema and apply the defaults.

    The rating text is parsed; a row whose rating does not parse is dropped.
    A date that parses is stored in ISO form, any other date text is kept.
    """
    if raw is None:
        raw = "reviewTitle" in df.columns or "reviewDescription" in df.columns
    aliases = RAW_ALIASES if raw else ALIASES
    columns = []
    for field in REVIEW.fields:
        name = field.name
        if name == "review_ts":
            continue
        value = _first_alias(df, aliases[name])
        if name == "rating":
            value = parse_rating(value) if value is not None else F.lit(0.0)
        elif name == "source":
            value = F.coalesce(value, F.lit(source)) if value is not None else F.lit(source)
        elif name == "images":
            empty = F.array().cast("array<string>")
            value = F.coalesce(value, empty) if value is not None else empty
        else:
            value = F.lit(None) if value is None else value
            value = value.cast(field.dataType)
            if name in DEFAULTS:
                value = F.coalesce(value, F.lit(DEFAULTS[name]))
        columns.append(value.cast(field.dataType).alias(name))
    out = df.select(*columns).filter(F.col("rating").isNotNull())
    parsed = parse_review_date(F.col("review_date"))
    iso = F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss")
    out = out.withColumn("review_ts", F.coalesce(parsed, F.col("review_date").try_cast("timestamp")))
    out = out.withColumn("review_date", F.coalesce(iso, F.col("review_date"), F.lit("")))
    return out.select(*REVIEW.fieldNames())


def sanitize_reviews(reviews: DataFrame) -> DataFrame:
    """First row per review id, default rating 3, valid ratings, parsed date, no blank text."""
    out = first_rows(reviews, ["review_id"], [F.col("seq").asc()], 1)
    out = out.withColumn("body", F.coalesce("body", F.lit("")))
    out = out.withColumn("rating", F.coalesce("rating", F.lit(3.0)))
    out = out.filter(F.col("rating").between(1, 5))
    out = out.withColumn("review_ts", F.col("review_date").try_cast("timestamp"))
    return out.filter(strip(F.col("body")) != "")


def product_info(items: DataFrame, form: str = "live") -> DataFrame:
    """One row per product from its first usable item.

    ``live`` wants an item with a product title; ``service`` takes the first
    item and falls back to the second name of each field; ``api`` keeps title
    and picture only.
    """
    if form == "service":
        fields = {
            "title": F.coalesce("productTitle", "title", F.lit("")),
            "image": F.coalesce("thumbnailImage", "image", F.lit("")),
            "rating": F.coalesce("averageRating", "stars", F.lit(0.0)),
            "total_reviews": F.coalesce("totalReviews", "reviewsCount", F.lit(0)),
        }
        usable = items
    elif form == "api":
        usable = items.filter(F.coalesce(F.col("productTitle"), F.lit("")) != "")
        picture = F.coalesce(F.nullif(F.col("productImageUrl"), F.lit("")), F.col("imageUrl"))
        first = first_rows(usable, ["asin"], [F.col("seq").asc()], 1)
        return first.select(F.col("asin").alias("product_id"), F.col("productTitle").alias("title"), picture.alias("image"))
    else:
        fields = {
            "title": F.col("productTitle"),
            "image": F.coalesce("thumbnailImage", F.lit("")),
            "rating": F.coalesce("averageRating", F.lit(0.0)),
            "total_reviews": F.coalesce("totalReviews", F.lit(0)),
        }
        usable = items.filter(F.col("productTitle").isNotNull())
    first = first_rows(
        usable.select(
            "asin", "seq", *[c.alias(n) for n, c in fields.items()],
            F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("price", F.lit("")).alias("price"),
        ),
        ["asin"], [F.col("seq").asc()], 1,
    )
    return first.select(F.col("asin").alias("product_id"), "title", "brand", "price", "image", "rating", "total_reviews")
