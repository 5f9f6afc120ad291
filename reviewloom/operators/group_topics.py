"""Themes of every product from its own reviews: k-means clusters and topics.

All products are fitted together.  Every product has its own vocabulary, document
frequencies and vectors.  The vectors of some hundred documents of a product are one
row, a block; a step of a model is one join of the blocks with the small model of
their product, a computation within the block in numpy, and one aggregation of sums
keyed by product, restart, center and term.  A block sends each of its few sums
once, whatever the number of its documents.  Products and restarts stop by themselves.

Weights are whole millionths, and centers whole numbers of them: sums do not
depend on the order of rows, so that a fit is the same however rows are dealt, and
equal terms are equal.  The blocks are written once and read by every step.

A product that the model cannot serve (few reviews, no vocabulary) takes the
counted themes that belong to the variant.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.dictionaries import CLUSTER_GENERIC_WORDS, CLUSTER_SUFFIXES, ENGLISH_STOPWORDS, PATTERN_DEFAULT_THEME
from reviewloom.functions.binding import let
from reviewloom.functions.rounding import round_exact
from reviewloom.operators import themes
from reviewloom.operators.topics import VECTOR_RULES, marked_terms, with_candidates, with_terms
from reviewloom.sources.shared import materialize

PRODUCT = ("product_id",)
UNIT = 1_000_000  # weights and counts are whole millionths
ENTRY = "array<struct<place:int,w:bigint>>"

# Number of clusters and topics, restarts, least reviews, words that give a name its mood.
CLUSTERS, RESTARTS, LEAST_REVIEWS = 5, 10, 5
STEPS = 300  # steps of a restart whose centers never come to rest
NAME_WORDS = {"positive": ["good", "great"], "negative": ["bad", "poor"]}
MISSING_RATING = 3
BLOCK_DOCS = 2_000  # documents of a block at most
BLOCK = "__g string, places int, size array<int>, place binary, w binary"


@dataclass
class GroupVectors:
    """Groups (__g, keys, n, terms by place) and their documents (__g, __doc, review_id, rating, entries)."""

    groups: DataFrame
    docs: DataFrame


def group_key(keys: Sequence[str]) -> Column:
    """One text for the keys of a row, missing ones included."""
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def group_vectors(
    reviews: DataFrame, variant: str = "default", keys: Sequence[str] = PRODUCT, stopwords: Sequence[str] = tuple(ENGLISH_STOPWORDS)
) -> GroupVectors:
    """TF-IDF vectors of every group with the group's own vocabulary, written.

    The most frequent terms of a group (equal counts in alphabetical order), idf
    = ln((1 + n) / (1 + df)) + 1 with its own n and df, L2 norm one, in whole
    millionths.  The words of a text are split once.  A text without any term
    of the vocabulary has no entries.
    """
    rule = VECTOR_RULES[variant]
    words = with_terms(reviews, replace(rule, bigrams=False), stopwords)
    rows = words.select(group_key(keys).alias("__g"), *keys, "review_id", "rating", "terms", F.monotonically_increasing_id().alias("__doc"))
    rows = materialize(rows, "words")
    docs = with_candidates(rows, rule) if rule.bigrams else rows
    sizes = rows.groupBy("__g").agg(*[F.first(k).alias(k) for k in keys], F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes, "groups")

    met = docs.select("__g", F.explode(marked_terms()).alias("t")).groupBy("__g", "t.term")
    counts = met.agg(F.count(F.lit(1)).alias("total"), F.sum("t.first").alias("df")).where(F.col("df") >= rule.min_docs)
    if rule.max_share < 1:
        counts = materialize(counts, "terms").join(sizes.select("__g", "n"), "__g").where(F.col("df") <= F.col("n") * rule.max_share).drop("n")
    order = Window.partitionBy("__g").orderBy(F.col("total").desc(), F.col("term").asc())
    kept = counts.withColumn("order", F.row_number().over(order)).where(F.col("order") <= rule.terms)
    place = (F.row_number().over(Window.partitionBy("__g").orderBy("term")) - 1).cast("int")
    idf = F.log((1 + F.col("n")).cast("double") / (1 + F.col("df")).cast("double")) + 1
    listed = kept.withColumn("place", place).join(sizes.select("__g", "n"), "__g").select("__g", "term", "place", idf.alias("idf"))
    listed = materialize(listed, "vocabulary")

    hits = docs.select("__g", "__doc", F.explode("terms").alias("term")).join(listed, ["__g", "term"])
    hits = hits.groupBy("__doc", "place", "idf").agg((F.count(F.lit(1)) * F.col("idf")).alias("x"))
    vectors = hits.groupBy("__doc").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e["x"] * e["x"]))
    weight = lambda x: F.floor(x * UNIT + 0.5)
    entries = let(F.struct(F.col("v"), norm(F.col("v")).alias("n")), lambda t: F.transform(t["v"], lambda e: F.struct(e["place"], weight(e["x"] / t["n"]).alias("w"))))
    docs = rows.select("__g", "__doc", "review_id", "rating").join(vectors.select("__doc", entries.alias("entries")), "__doc", "left")
    docs = docs.withColumn("entries", F.coalesce(F.col("entries").cast(ENTRY), F.array().cast(ENTRY)))
    by_place = listed.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("t"))
    groups = sizes.join(by_place, "__g", "left").withColumn("terms", F.coalesce(F.transform("t", lambda t: t["term"]), F.array().cast("array<string>"))).drop("t")
    return GroupVectors(materialize(groups, "groups"), materialize(docs, "vectors"))


def group_feature_rows(vectors: GroupVectors, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Vectors as rows (keys, review_id, term, weight in whole millionths) of their places."""
    rows = vectors.docs.select("__g", "review_id", F.explode("entries").alias("e"))
    named = rows.join(vectors.groups.select("__g", *keys, "terms"), "__g")
    return named.select(*keys, "review_id", F.get("terms", F.col("e.place")).alias("term"), F.col("e.w").alias("weight"))


# ---------------------------------------------------------------- blocks
def vector_blocks(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The vectors of ``docs`` whose group is in ``groups``, many documents of a group in a row; written.

    ``size`` counts the entries of each document, ``place`` and ``w`` hold them one
    after the other, ``places`` is the number of terms of the group.
    """
    rows = docs.join(groups.select("__g", F.size("terms").alias("places")), "__g").select("__g", "places", "entries")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("__g").dictionary_encode().indices.to_numpy()
            ends = [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            start = 0
            for end in ends:
                for at in range(start, end, BLOCK_DOCS):
                    part = batch.slice(at, min(BLOCK_DOCS, end - at))
                    lists = part.column("entries")
                    entries = lists.flatten()
                    place, w = (entries.field(k).to_numpy(zero_copy_only=False) for k in ("place", "w"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part.column("__g")[0].as_py()], pa.string()),
                            pa.array([part.column("places")[0].as_py()], pa.int32()),
                            pa.array([lists.value_lengths().to_numpy()], pa.list_(pa.int32())),
                            pa.array([place.astype("<i4").tobytes()], pa.binary()),
                            pa.array([w.astype("<i8").tobytes()], pa.binary()),
                        ],
                        ["__g", "places", "size", "place", "w"],
                    )
                start = end

    return materialize(rows.sortWithinPartitions("__g").mapInArrow(block, BLOCK), "blocks")


def _weights(row: dict) -> np.ndarray:
    """Weights of a block, a row for each document and a column for each place."""
    out = np.zeros((len(row["size"]), row["places"]), np.int64)
    out[np.repeat(np.arange(len(row["size"])), row["size"]), np.frombuffer(row["place"], "<i4")] = np.frombuffer(row["w"], "<i8")
    return out


# ---------------------------------------------------------------- clusters
def _dense(entries: Column, places: Column) -> Column:
    """Entries as one number for each place."""
    return let(F.map_from_entries(entries), lambda m: F.transform(places, lambda p: F.coalesce(F.try_element_at(m, p), F.lit(0).cast("long"))))


def first_centers(docs: DataFrame, groups: DataFrame, restarts: int) -> DataFrame:
    """Columns __g, restart, slot, c: for each restart the documents whose ids come first by MD5; ``groups`` has k."""
    rows = docs.select("__g", "__doc", "entries", "review_id", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))
    drawn = F.md5(F.concat_ws(":", F.coalesce(F.col("review_id"), F.lit("")), "restart").cast("binary"))
    order = Window.partitionBy("__g", "restart").orderBy(drawn, "__doc")
    first = rows.withColumn("order", F.row_number().over(order)).where(F.col("order") <= CLUSTERS)  # limited before the shuffle
    of_group = first.withColumn("slot", F.col("order") - 1).join(groups.select("__g", "k", F.size("terms").alias("m")), "__g").where("slot < k")
    dense = _dense(F.col("entries"), F.sequence(F.lit(0), F.col("m") - 1))
    return of_group.select("__g", "restart", "slot", dense.alias("c"))


def _model(centers: DataFrame) -> DataFrame:
    """One row for each group: its restarts with their centers, at most restarts x k x terms numbers; written."""
    norm = F.aggregate("c", F.lit(0).cast("long"), lambda s, v: s + v * v)
    slots = centers.groupBy("__g", "restart").agg(F.sort_array(F.collect_list(F.struct("slot", norm.alias("norm"), "c"))).alias("slots"))
    return materialize(slots.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("restart", "slots"))).alias("model")), "centers")


def _placed(docs: DataFrame, centers: DataFrame) -> DataFrame:
    """``docs`` with ``nearest``: slot and score (squared distance without the document's own norm) for each restart."""

    def dot(c: Column) -> Column:
        return F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["w"] * F.get(c, e["place"]))

    def nearest(r: Column) -> Column:
        scores = F.transform(r["slots"], lambda s: s["norm"] - F.lit(2) * dot(s["c"]))
        return let(scores, lambda x: F.struct(r["restart"].alias("restart"), (F.array_position(x, F.array_min(x)) - 1).cast("int").alias("slot"), F.array_min(x).alias("score")))

    return docs.join(_model(centers), "__g").withColumn("nearest", F.transform("model", nearest)).drop("model")


def _nearest(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each restart of a block with its model: number, weights, and slot and score (as in ``_placed``) of each document."""
    weights = _weights(row)
    for restart in row["model"]:
        centers = np.array([x["c"] for x in restart["slots"]], np.int64)
        scores = np.array([x["norm"] for x in restart["slots"]], np.int64) - 2 * (weights @ centers.T)
        yield restart["restart"], weights, scores.argmin(axis=1), scores.min(axis=1)


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and summed weights of the documents of each slot."""
    kinds = {"__g": pa.string(), "restart": pa.int32(), "slot": pa.int32(), "sums": pa.list_(pa.int64())}
    for batch in batches:
        for i in range(batch.num_rows):
            row, out = batch.slice(i, 1).to_pylist()[0], []
            for restart, weights, slot, _ in _nearest(row):
                for s in np.unique(slot).tolist():
                    own = weights[slot == s]
                    out.append({"__g": row["__g"], "restart": restart, "slot": s, "sums": [len(own), *own.sum(axis=0).tolist()]})
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))


def _block_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summed scores of the documents of each restart."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            out = [{"__g": row["__g"], "restart": restart, "cost": int(score.sum())} for restart, _, _, score in _nearest(row)]
            yield pa.RecordBatch.from_pylist(out, pa.schema({"__g": pa.string(), "restart": pa.int32(), "cost": pa.int64()}))


def lloyd_step(blocks: DataFrame, centers: DataFrame) -> DataFrame:
    """Centers (__g, restart, slot, c) moved to the mean of their documents, with ``moving``, true if any of their restart did; a center without any stays."""
    rows = blocks.join(_model(centers), "__g").mapInArrow(_block_sums, "__g string, restart int, slot int, sums array<bigint>")
    parts = rows.select("__g", "restart", "slot", F.posexplode("sums").alias("at", "w")).withColumn("place", F.col("at") - 1)  # place -1 counts the documents
    sums = parts.groupBy("__g", "restart", "slot", "place").agg(F.sum("w").alias("w"))
    means = sums.groupBy("__g", "restart", "slot").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"))
    both = centers.join(means, ["__g", "restart", "slot"], "left")
    mean = F.expr("transform(c, (v, i) -> coalesce(try_element_at(m, i), 0L) div m[-1])")
    both = both.withColumn("next", F.when(F.col("m").isNull(), F.col("c")).otherwise(mean))
    moving = F.max(F.col("next") != F.col("c")).over(Window.partitionBy("__g", "restart"))
    return materialize(both.select("__g", "restart", "slot", F.col("next").alias("c"), moving.alias("moving")), "moved")


def fit_clusters(blocks: DataFrame, centers: DataFrame, iterations: int = STEPS) -> DataFrame:
    """Centers (__g, slot, c) of the best restart of each group after at most ``iterations`` steps.

    A restart of a group stops when none of its centers moves; the others go on.
    """
    done, now = [], materialize(centers, "starts")
    for _ in range(iterations):
        moved = lloyd_step(blocks, now)
        kinds = {r["moving"] for r in moved.groupBy("moving").count().collect()}  # two at most
        if False in kinds:
            done.append(moved.where("NOT moving").drop("moving"))
        now = moved.where("moving").drop("moving")
        if True not in kinds:
            break
    every = now
    for part in done:
        every = every.unionByName(part)
    every = materialize(every, "centers")
    scores = blocks.join(_model(every), "__g").mapInArrow(_block_costs, "__g string, restart int, cost bigint")
    scores = scores.groupBy("__g", "restart").agg(F.sum(F.col("cost").cast("decimal(38,0)")).alias("cost"))
    best = scores.groupBy("__g").agg(F.min_by("restart", F.struct("cost", "restart")).alias("restart"))
    return materialize(every.join(best, ["__g", "restart"], "left_semi"), "centers")


def top_terms(weights: Column, terms: Column, n: int) -> Column:
    """The ``n`` terms of largest weight; of equal ones the last."""
    order = F.array_sort(F.transform(weights, lambda v, i: F.struct((-v).alias("v"), (-i).alias("i"))))
    return F.transform(F.slice(order, 1, n), lambda x: F.get(terms, -x["i"]))


def title_case(text: Column) -> Column:
    """Letters after other letters small, the rest capital."""
    chars = F.split(text, "")
    cased = F.transform(chars, lambda c, i: F.when((i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(cased, "")


def _fitted(reviews: DataFrame, variant: str, keys: Sequence[str], least: int, k: Column, restarts: int, iterations: int):
    """Vectors, fitted centers with the terms of their group, and placed documents of the groups that can be fitted; the others' keys."""
    vectors = group_vectors(reviews, variant, keys)
    able = (F.col("n") >= least) & (F.size("terms") > 0)
    groups = vectors.groups.where(able).withColumn("k", k)
    docs = vectors.docs
    if not vectors.groups.where(~able).isEmpty():
        docs = materialize(docs.join(groups.select("__g"), "__g", "left_semi"), "vectors")
    centers = fit_clusters(vector_blocks(docs, groups), first_centers(docs, groups, restarts), iterations)
    placed = _placed(docs, centers).select("__g", "review_id", "rating", F.get("nearest", F.lit(0))["slot"].alias("slot"))
    return centers.join(groups, "__g"), placed, vectors.groups.where(~able).select("__g")


def _others(reviews: DataFrame, keys: Sequence[str], groups: DataFrame) -> DataFrame:
    return reviews.withColumn("__g", group_key(keys)).join(groups, "__g", "left_semi").drop("__g")


def cluster_themes(reviews: DataFrame, restarts: int = RESTARTS, keys: Sequence[str] = PRODUCT, iterations: int = STEPS) -> DataFrame:
    """Clusters of the live analysis for each product: keys, rank, theme, mentions, sentiment.

    Five clusters of the vectors of title and body; a name of the two
    heaviest terms, its mood from the words in it, ranked by size, then by the
    number of the cluster.  A product with under five reviews or without terms
    has its keyword themes instead.
    """
    centers, placed, others = _fitted(reviews, "default", keys, LEAST_REVIEWS, F.least(F.lit(CLUSTERS), F.col("n")), restarts, iterations)
    sizes = placed.groupBy("__g", "slot").agg(F.count(F.lit(1)).alias("mentions"))
    name = title_case(F.array_join(top_terms(F.col("c"), F.col("terms"), 2), " "))
    named = centers.join(sizes, ["__g", "slot"], "left").select("__g", *keys, "slot", name.alias("theme"), F.coalesce("mentions", F.lit(0)).alias("mentions"))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("theme"), w))
    mood = F.when(has(NAME_WORDS["positive"]), "positive").when(has(NAME_WORDS["negative"]), "negative").otherwise("neutral")
    rank = F.row_number().over(Window.partitionBy("__g").orderBy(F.col("mentions").desc(), "slot"))
    found = named.select(*keys, rank.alias("rank"), "theme", "mentions", mood.alias("sentiment"))
    counted = themes.keyword_themes(_others(reviews, keys, others), keys) if keys else _whole(reviews, others)
    return found.unionByName(counted.select(*keys, "rank", "theme", "mentions", "sentiment"))


def _whole(reviews: DataFrame, others: DataFrame) -> DataFrame:
    sums = themes.with_theme_flags(_others(reviews, (), others)).agg(*themes.theme_aggregates()).withColumn("__all", F.lit(1))
    return themes.theme_rows(sums, ["__all"])


def cluster_name(keywords: Column) -> Column:
    """First meaningful keyword in title case, with a suffix from the first matching group."""
    useful = F.filter(keywords, lambda w: (F.length(w) > 3) & ~w.isin(*CLUSTER_GENERIC_WORDS))
    base = title_case(F.replace(F.get(useful, F.lit(0)), F.lit("_"), F.lit(" ")))
    suffix = F.lit(None).cast("string")
    for name, group in reversed(CLUSTER_SUFFIXES):
        suffix = F.when(F.arrays_overlap(keywords, F.array(*map(F.lit, group))), F.lit(name)).otherwise(suffix)
    return F.when(F.size(useful) == 0, PATTERN_DEFAULT_THEME).otherwise(F.concat_ws(" & ", base, suffix))


def detailed_clusters(
    reviews: DataFrame, k: int = CLUSTERS, restarts: int = RESTARTS, keys: Sequence[str] = PRODUCT, iterations: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Detailed clusters of each product and their members.

    Returns (keys, id, theme, keywords, sentiment_score, size) and (keys, id,
    review_id): the name and five keywords come from the ten heaviest terms
    of the bodies, the score is the mean rating, a missing one being 3.  A product
    with fewer than ``k`` reviews has half as many clusters, one at least; empty
    ones are left out.  A product without any term has the pattern themes.
    """
    clusters = F.when(F.col("n") < k, F.greatest(F.lit(1), F.floor(F.col("n") / 2))).otherwise(k).cast("int")
    centers, placed, others = _fitted(reviews, "detailed", keys, 0, clusters, restarts, iterations)
    placed = materialize(placed, "placed")
    rating = F.coalesce(F.col("rating"), F.lit(float(MISSING_RATING))).cast("decimal(12,6)")
    sums = placed.groupBy("__g", "slot").agg(F.sum(rating).alias("r"), F.count(F.lit(1)).alias("size"))
    score = (F.col("r").cast("double") / F.col("size")).alias("sentiment_score")
    label = F.concat(F.lit("theme_"), F.col("slot")).alias("id")
    words = top_terms(F.col("c"), F.col("terms"), 10)
    named = centers.withColumn("words", words).join(sums, ["__g", "slot"])
    found = named.select(*keys, label, cluster_name(F.col("words")).alias("theme"), F.slice("words", 1, 5).alias("keywords"), score, "size")
    members = placed.join(centers.select("__g", "slot", *keys), ["__g", "slot"]).select(*keys, label, "review_id")
    rest = _others(reviews, keys, others)
    if rest.isEmpty():
        return found, members
    patterns = themes.pattern_themes(rest, keys)
    inside = themes.pattern_theme_members(rest, keys).join(patterns.select(*keys, "theme", "id"), [*keys, "theme"])
    return found.unionByName(patterns.select(*found.columns)), members.unionByName(inside.select(*keys, "id", "review_id"))


def cluster_themes_detailed(reviews: DataFrame, k: int = CLUSTERS, restarts: int = RESTARTS, keys: Sequence[str] = PRODUCT, iterations: int = 100) -> DataFrame:
    return detailed_clusters(reviews, k, restarts, keys, iterations)[0]


# ---------------------------------------------------------------- topics
def first_topics(groups: DataFrame) -> DataFrame:
    """Columns __g, k, lam: for each topic one number for each place, all different in their pattern."""
    start = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda t: F.transform(F.sequence(F.lit(0), F.size("terms") - 1), lambda p: ((1 + (31 * p + 17 * t + 7 * p * t) % 23) * UNIT).cast("long")),
    )
    return groups.select("__g", "k", start.alias("lam"))


def _shares(weights: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Weight of each topic in each place (first axis) of each document (last axis)."""
    parts = theta[:, None, :] * phi[:, :, None]
    whole = np.zeros(weights.shape)
    for part in parts:
        whole += part
    parts *= weights
    parts /= whole
    return parts


def _block_topics(inner: int):
    """Sums of the rounded shares of each topic and place in a block; topic by topic and place by place, so that they do not depend on the block."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                weights, phi = np.ascontiguousarray(_weights(row).T.astype(np.float64)), np.array(row["phi"], np.float64)
                theta = np.full((len(phi), weights.shape[1]), 1.0 / len(phi))
                for _ in range(inner - 1):
                    share = _shares(weights, phi, theta)
                    theta = np.full(theta.shape, float(UNIT) / len(phi))
                    for place in range(len(weights)):
                        theta += share[:, place]
                whole = np.floor(_shares(weights, phi, theta) + 0.5).sum(axis=2).astype(np.int64)
                out = [{"__g": row["__g"], "t": t, "sums": x.tolist()} for t, x in enumerate(whole)]
                yield pa.RecordBatch.from_pylist(out, pa.schema({"__g": pa.string(), "t": pa.int32(), "sums": pa.list_(pa.int64())}))

    return sums


def topic_step(blocks: DataFrame, model: DataFrame, inner: int = 3) -> DataFrame:
    """``model`` (__g, k, lam) after one step of expectation and maximization, written.

    Expectation, for each document of a block: the share of topic t in a term is
    proportional to theta[t] * phi[t][term], and theta[t] to 1/k plus the
    weight that topic t has in the document; ``inner`` rounds from equal shares.
    Maximization: lam is 1/k plus the weights of each topic and term in all
    documents of the group, one aggregation for all groups.
    """
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    phi = F.transform("lam", lambda row: let(total(row), lambda s: F.transform(row, lambda v: v.cast("double") / s)))
    rows = blocks.join(materialize(model.select("__g", phi.alias("phi")), "topics"), "__g")
    rows = rows.mapInArrow(_block_topics(inner), "__g string, t int, sums array<bigint>")
    sums = rows.select("__g", "t", F.posexplode("sums").alias("place", "w")).groupBy("__g", "t", "place").agg(F.sum("w").alias("w"))
    by_topic = sums.groupBy("__g", "t").agg(F.map_from_entries(F.collect_list(F.struct("place", "w"))).alias("m"))
    by_group = by_topic.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("t", "m"))).alias("sums"))
    prior = f"{UNIT}L div k"
    lam = F.expr(f"transform(lam, (row, t) -> transform(row, (v, p) -> {prior} + coalesce(try_element_at(try_element_at(sums, t), p), 0L)))")
    return materialize(model.join(by_group, "__g", "left").select("__g", "k", lam.alias("lam")), "topics")


def topic_themes(reviews: DataFrame, topics: int = CLUSTERS, iterations: int = 10, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Topics of each product: keys, rank, theme, keywords, mentions, importance.

    As many topics as half of the reviews allow, ``topics`` at most; a name of
    the three heaviest words, five keywords, the summed weight as mentions, the
    largest as importance, which ranks them.  A product with under five reviews or
    without terms has its counted dictionary themes instead, without importance.
    """
    vectors = group_vectors(reviews, "topics", keys)
    able = (F.col("n") >= LEAST_REVIEWS) & (F.size("terms") > 0)
    groups = materialize(vectors.groups.where(able).withColumn("k", F.least(F.lit(topics), F.floor(F.col("n") / 2)).cast("int")), "groups")
    model = materialize(first_topics(groups), "topics")
    blocks = vector_blocks(vectors.docs, groups)
    for _ in range(iterations):
        model = topic_step(blocks, model)
    rows = model.select("__g", F.posexplode("lam").alias("t", "row")).join(groups, "__g")
    words = top_terms(F.col("row"), F.col("terms"), 5)
    total = F.aggregate("row", F.lit(0).cast("long"), lambda s, v: s + v)
    largest = round_exact(F.array_max("row").cast("double") / UNIT, 3)
    named = rows.select("__g", *keys, "t", words.alias("keywords"), F.floor(total / UNIT).alias("mentions"), largest.alias("importance"))
    rank = F.row_number().over(Window.partitionBy("__g").orderBy(F.col("importance").desc(), "t"))
    found = named.select(*keys, rank.alias("rank"), F.array_join(F.slice("keywords", 1, 3), " + ").alias("theme"), "keywords", "mentions", "importance")
    rest = _others(reviews, keys, vectors.groups.where(~able).select("__g"))
    counted = themes.theme_occurrences(rest if keys else rest.withColumn("__all", F.lit(1)), keys or ["__all"])
    order = F.row_number().over(Window.partitionBy(*(keys or ["__all"])).orderBy("ordinal"))
    return found.unionByName(counted.select(*keys, order.alias("rank"), "theme", "keywords", "mentions", F.lit(None).cast("double").alias("importance")))
