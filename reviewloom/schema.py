"""Declared schemas.  ``seq`` is the ingest order of a review within its product."""

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
DOUBLE, BOOL, TIME = T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


REVIEW = _struct(
    review_id=STRING, product_id=STRING, country=STRING, title=STRING, body=STRING, rating=DOUBLE,
    author=STRING, review_date=STRING, review_ts=TIME, verified=BOOL, helpful_count=INT,
    images=T.ArrayType(STRING), variant=STRING, source=STRING, seq=LONG,
)

# One JSON item is one review plus fields of its product.
RAW_ITEM = _struct(
    id=STRING, reviewTitle=STRING, reviewDescription=STRING, reviewRating=STRING, reviewDate=STRING,
    reviewAuthor=STRING, isVerified=BOOL, helpfulCount=INT, reviewImages=T.ArrayType(STRING), variant=STRING,
    country=STRING, productTitle=STRING, title=STRING, brand=STRING, price=STRING, thumbnailImage=STRING,
    image=STRING, asin=STRING, averageRating=DOUBLE, stars=DOUBLE, totalReviews=LONG, reviewsCount=LONG,
    error=STRING, url=STRING, seq=LONG,
)

NESTED_ITEM = _struct(
    asin=STRING,
    reviews=T.ArrayType(
        _struct(
            title=STRING, text=STRING, stars=INT, date=STRING, verified=BOOL, productTitle=STRING,
            imageUrl=STRING, productImageUrl=STRING,
        )
    ),
)

SNAPSHOT = _struct(product_id=STRING, ts=TIME, review_count=LONG, rating=DOUBLE, estimated_buyers=LONG)
STORED_SNAPSHOT = T.StructType([*SNAPSHOT.fields, T.StructField("date", T.DateType())])

# Output of page extraction.
PAGE_REVIEW = _struct(
    page_id=LONG, review_id=STRING, asin=STRING, rating=DOUBLE, review_text=STRING, review_title=STRING,
    review_date=STRING, verified_purchase=BOOL, helpful_votes=LONG,
)
PAGE_PRODUCT = _struct(page_id=LONG, asin=STRING, title=STRING, rating=DOUBLE)
