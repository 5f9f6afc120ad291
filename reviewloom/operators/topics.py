"""TF-IDF vectors of one corpus with one vocabulary.

The vocabulary is a bounded top-k table (50 or 100 terms), so only that many
rows ever reach the driver; vectors are built row by row from it.  Vectors,
clusters and topics of every product by itself are in ``group_topics``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.dictionaries import ENGLISH_STOPWORDS
from reviewloom.functions.binding import let
from reviewloom.functions.text import analysis_text, split_words
from reviewloom.sources.shared import materialize


@dataclass(frozen=True)
class VectorRule:
    form: str
    terms: int
    bigrams: bool
    min_docs: int = 1
    max_share: float = 1.0


# Settings of the three vectorizers.
VECTOR_RULES = {
    "default": VectorRule("title_body", 50, True),
    "detailed": VectorRule("body", 100, True),
    "topics": VectorRule("title_body", 50, False, 2, 0.8),
}


def with_terms(reviews: DataFrame, rule: VectorRule, stopwords: Sequence[str] = tuple(ENGLISH_STOPWORDS)) -> DataFrame:
    """Add ``terms``: words of two and more characters without stopwords, and their pairs."""
    words = F.filter(split_words(analysis_text(rule.form)), lambda w: (F.length(w) >= 2) & ~w.isin(*stopwords))
    out = reviews.withColumn("terms", words)
    return with_pairs(out) if rule.bigrams else out


def with_pairs(docs: DataFrame) -> DataFrame:
    """``terms`` and the pairs of neighbouring ones."""
    size = F.size("terms")
    following = F.slice("terms", F.lit(2), F.greatest(size - 1, F.lit(0)))
    leading = F.slice("terms", F.lit(1), F.greatest(size - 1, F.lit(0)))
    pairs = F.zip_with(leading, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return docs.withColumn("terms", F.concat("terms", pairs))


def with_candidates(docs: DataFrame, rule: VectorRule) -> DataFrame:
    """Columns __g, __doc, terms: the words and pairs of a document that may be among the ``rule.terms`` most frequent of its group; written.

    ``docs`` has the words of each document as ``terms``.  A pair is no more
    frequent than either of its words.  So a term that is less frequent than
    ``rule.terms`` words of its group is not counted, and no pair with such a
    word is made.  For rules that bound no document counts.
    """
    counts = docs.select("__g", F.explode("terms").alias("term")).groupBy("__g", "term").agg(F.count(F.lit(1)).alias("total"))
    counts = materialize(counts, "word-counts")
    order = Window.partitionBy("__g").orderBy(F.col("total").desc())
    top = counts.withColumn("order", F.row_number().over(order)).where(F.col("order") <= rule.terms)
    least = top.groupBy("__g").agg(F.when(F.count(F.lit(1)) == rule.terms, F.min("total")).otherwise(0).alias("least"))
    words = materialize(counts.join(least, "__g").where("total >= least").select("__g", "term"), "frequent-words")
    placed = docs.select("__g", "__doc", F.posexplode("terms").alias("place", "term")).join(words, ["__g", "term"])
    found = placed.groupBy("__g", "__doc").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("found"))
    following = F.slice("found", F.lit(2), F.size("found") - 1)
    leading = F.slice("found", F.lit(1), F.size("found") - 1)
    pairs = F.zip_with(leading, following, lambda a, b: F.when(a["place"] + 1 == b["place"], F.concat(a["term"], F.lit(" "), b["term"])))
    terms = F.concat(F.transform("found", lambda x: x["term"]), F.array_compact(pairs))
    return materialize(found.select("__g", "__doc", terms.alias("terms")), "candidate-terms")


def marked_terms() -> Column:
    """The sorted terms of a document, the first of equal ones marked with 1."""

    def marked(terms: Column) -> Column:
        return F.transform(
            terms, lambda t, i: F.struct(t.alias("term"), F.when(F.get(terms, i - 1) == t, 0).otherwise(1).alias("first"))
        )

    return let(F.sort_array("terms"), marked)


def vocabulary(docs: DataFrame, rule: VectorRule, n: int) -> DataFrame:
    """The most frequent terms of ``n`` documents, at most ``rule.terms`` rows.

    In the sorted terms of a document the first of equal ones is marked, so one
    aggregation yields the occurrences and, as the sum of the marks, the
    documents of a term.  Equal counts rank in alphabetical order.
    """

    rows = docs.select(F.explode(marked_terms()).alias("t"))
    counts = rows.groupBy("t.term").agg(F.count("*").alias("total"), F.sum("t.first").alias("doc_count"))
    kept = counts.filter((F.col("doc_count") >= rule.min_docs) & (F.col("doc_count") <= n * rule.max_share))
    return kept.orderBy(F.col("total").desc(), F.col("term").asc()).limit(rule.terms)


@dataclass
class Corpus:
    """Vectors of a corpus and the terms of their places."""

    table: DataFrame
    terms: list[str]
    docs: int


def tfidf_features(
    reviews: DataFrame, variant: str = "default", stopwords: Sequence[str] = tuple(ENGLISH_STOPWORDS)
) -> Corpus:
    """L2-normalized TF-IDF vectors with idf = ln((1 + n) / (1 + df)) + 1."""
    rule = VECTOR_RULES[variant]
    docs = with_terms(reviews, replace(rule, bigrams=False), stopwords)
    words = materialize(docs.select(F.lit("").alias("__g"), F.monotonically_increasing_id().alias("__doc"), "terms"), "words")
    n = words.count()
    counted = with_candidates(words, rule) if rule.bigrams else words
    rows = sorted(vocabulary(counted, rule, n).collect(), key=lambda r: r["term"])  # at most 100 rows
    terms = [r["term"] for r in rows]
    if not terms:
        return Corpus(docs.drop("terms"), [], n)
    idf = [math.log((1 + n) / (1 + r["doc_count"])) + 1 for r in rows]
    model = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="tf")
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="tfidf")
    norm = Normalizer(p=2.0, inputCol="tfidf", outputCol="features")
    if rule.bigrams:  # other words only stand between those of the vocabulary
        named = {w for t in terms for w in t.split(" ")}
        docs = docs.withColumn("terms", F.transform("terms", lambda w: F.when(w.isin(*sorted(named)), w)))
        docs = with_pairs(docs).withColumn("terms", F.array_compact("terms"))
    table = norm.transform(scaled.transform(model.transform(docs))).drop("terms", "tf", "tfidf")
    return Corpus(table, terms, n)


def feature_rows(vectors: Corpus, key: str = "review_id") -> DataFrame:
    """Vectors as rows ``(key, term, weight)`` of their non-zero places."""
    terms = F.array(*[F.lit(t) for t in vectors.terms])
    rows = vectors.table.select(key, F.posexplode(vector_to_array("features")).alias("place", "weight"))
    return rows.filter(F.col("weight") != 0).select(key, F.get(terms, F.col("place")).alias("term"), "weight")
