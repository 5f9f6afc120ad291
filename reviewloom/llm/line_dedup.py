"""Line deduplication with DataFrame functions only.

Every text is exploded into lines, each line is normalised and hashed, the
documents of each hash are counted, and lines over the threshold are dropped.
The kept lines are put together again by position.

Shuffles: (hash, id) pairs with partial aggregation, the (hash, id, position)
rows of one join, the dropped positions, and the texts once. Lines themselves
never travel. A line that stands in every document is one aggregated key; the
keys found in several documents are written before the join, so that its sides are
plain exchanges and adaptive execution can split the rows of such a line.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.shared import materialize

#: The white space that is stripped from a line.
SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else untouched; pure ASCII texts take the faster way."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Columns id, tag, pos, hash: one row for each line with a key that is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")
    )
    keyed = lines.where(F.char_length("line") >= min_chars).select("id", "tag", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select("id", "tag", "pos", F.unhex(F.md5("key")).alias("hash"))


def _repeated(rows: DataFrame, min_docs: int) -> DataFrame:
    """Columns hash, keeper: lines found in at least ``min_docs`` documents and the smallest id that holds them.

    For a threshold of two, the smallest and the largest id tell all; a larger
    one needs the distinct pairs.
    """
    lowest, highest, unnamed = F.min("id"), F.max("id"), F.max(F.col("id").isNull())
    if min_docs <= 2:
        sums = rows.groupBy("hash").agg(lowest.alias("keeper"), highest.alias("last"), unnamed.alias("unnamed"))
        docs = F.when(F.col("keeper") < F.col("last"), 2).otherwise(F.when(F.col("keeper").isNull(), 0).otherwise(1))
        docs = docs + F.col("unnamed").cast("int")
    else:
        sums = rows.select("hash", "id").distinct().groupBy("hash").agg(lowest.alias("keeper"), F.count(F.lit(1)).alias("docs"))
        docs = F.col("docs")
    return materialize(sums.where(docs >= min_docs).select("hash", "keeper"), "repeated-lines")


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """``docs`` with the columns ``__n_lines``, ``__n_dropped`` and ``__kept`` (the text without repeated lines).

    A line whose key (stripped, A-Z lower-cased) has ``min_chars`` code points
    or more and stands in ``min_docs`` documents or more stays only in the
    document with the smallest id, there with all its repetitions.

    A NULL text is one empty line. Rows with the same id are one document, and
    rows without an id together one document that comes after all others. All
    other columns pass unchanged, whatever their names. No rows: no rows.
    """
    rows = _line_rows(docs, id_col, text_col, min_chars)
    hits = rows.join(_repeated(rows, min_docs), "hash").where(~F.col("id").eqNullSafe(F.col("keeper")))
    dropped = hits.groupBy("id", "tag").agg(F.collect_set("pos").alias("gone"))
    dropped = dropped.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("gone").alias("__gone"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(dropped, docs[id_col].eqNullSafe(dropped["__id"]) & (F.xxhash64(text) == F.col("__tag")), "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    # One bound struct, so that the text is split once and not once for each line.
    bound = F.transform(
        F.array(F.struct(lines.alias("lines"), stay.alias("stay"))),
        lambda x: F.array_join(F.transform(x["stay"], lambda i: x["lines"][i]), "\n"),
    )[0]
    n_lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *[docs[c] for c in docs.columns],
        n_lines.cast("long").alias("__n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("__n_dropped"),
        F.when(F.col("__gone").isNull(), text).otherwise(bound).alias("__kept"),
    )
