import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from checks import queries
from reviewloom.operators import group_topics, topics

TEXTS = [
    "battery life long battery", "battery charge quick", "screen bright screen sharp", "screen color bright", "price low price fair",
    "price value fair", "battery life quick charge", "screen sharp color",
]


def corpus(make):
    return make(*[{"body": t, "rating": 1.0 + i % 5} for i, t in enumerate(TEXTS)])


def test_vectors_agree_with_brute_force(make):
    got = {(r.review_id, r.term): r.weight for r in topics.feature_rows(topics.tfidf_features(corpus(make), "detailed")).collect()}
    docs = []
    for text in TEXTS:
        words = text.split()
        docs.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    expected = {}
    for i, d in enumerate(docs):
        raw = {t: d.count(t) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in set(d)}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        expected.update({(f"R{i}", t): x / norm for t, x in raw.items()})
    assert len(df) <= 100 and got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_document_bounds_and_term_limit(make):
    vectors = topics.tfidf_features(corpus(make), "topics")
    assert "low" not in vectors.terms and "battery" in vectors.terms and vectors.docs == 8


def test_clusters_cover_all_reviews(make):
    themes, members = group_topics.detailed_clusters(corpus(make), 3, restarts=2)
    rows = themes.collect()
    assert sum(r["size"] for r in rows) == members.count() == 8 and all(len(r.keywords) == 5 for r in rows)
    live = group_topics.cluster_themes(corpus(make), restarts=2).collect()
    assert sum(r.mentions for r in live) == 8 and {r.sentiment for r in live} <= {"positive", "negative", "neutral"}
    assert [r.mentions for r in sorted(live, key=lambda r: r["rank"])] == sorted((r.mentions for r in live), reverse=True)


def test_small_corpora_fall_back(make):
    few = make({"body": "good quality"}, {"body": "fast shipping"})
    assert {r.theme for r in group_topics.cluster_themes(few).collect()} == {"Quality", "Performance", "Delivery"}
    assert {r.theme for r in group_topics.topic_themes(few).collect()} == {"Product Quality", "Shipping"}


def test_topics(make):
    rows = sorted(group_topics.topic_themes(corpus(make), 3).collect(), key=lambda r: r["rank"])
    assert len(rows) == 3 and all(r.theme == " + ".join(r.keywords[:3]) for r in rows)
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


@pytest.mark.parametrize("keywords, name", [
    (["good", "battery life", "price"], "Battery Life & Price"), (["great", "screen", "fast"], "Screen & Delivery"),
    (["screen", "easy"], "Screen & Usability"), (["screen"], "Screen"), (["good", "bad"], "General Feedback"), (["3d_print 2go"], "3D Print 2Go"),
])
def test_cluster_names(spark, keywords, name):
    row = spark.createDataFrame([(keywords,)], "k array<string>").select(group_topics.cluster_name(F.col("k")).alias("n")).first()
    assert row.n == name


# ---------------------------------------------------------------- all products at once
def several(make):
    """A product with two moods of texts, one with other words, one of few reviews, one without terms, one without a key."""
    rows = [{"product_id": "A", "body": t} for t in TEXTS] + [{"product_id": "B", "body": f"{t} poor sound {i % 3} zoom{i}", "rating": float(1 + i % 5)} for i, t in enumerate(TEXTS * 2)]
    rows += [{"product_id": "C", "body": "good quality price"}, {"product_id": "C", "body": "fast shipping"}]
    rows += [{"product_id": "D", "body": t} for t in ("the and of", "", "it is", "to be", "a b", "or not")]
    rows += [{"product_id": None, "body": f"hinge broke {t}"} for t in TEXTS[:6]] + [{"product_id": "B", "body": None, "rating": None}]
    return make(*rows), rows


def vectors_by_hand(rows, variant):
    """Per product: n, terms by place, and for each review its places and whole weights."""
    rule, out = topics.VECTOR_RULES[variant], {}
    for product in {r["product_id"] for r in rows}:
        texts = [(f"R{i}", r["body"] or "") for i, r in enumerate(rows) if r["product_id"] == product]
        docs = []
        for _, text in texts:
            words = [w for w in text.lower().split() if len(w) >= 2 and w not in topics.ENGLISH_STOPWORDS]
            docs.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])] * rule.bigrams)
        n, df = len(docs), {t: sum(t in d for d in docs) for d in docs for t in d}
        total = {t: sum(d.count(t) for d in docs) for t in df if rule.min_docs <= df[t] <= n * rule.max_share}
        terms = sorted(sorted(total, key=lambda t: (-total[t], t))[:rule.terms])
        vectors = []
        for d in docs:
            x = {p: d.count(t) * (math.log((1 + n) / (1 + df[t])) + 1) for p, t in enumerate(terms) if t in d}
            norm = math.sqrt(sum(v * v for v in x.values()))
            vectors.append({p: math.floor(v / norm * 1_000_000 + 0.5) for p, v in x.items()})
        out[product] = (n, terms, [i for i, _ in texts], vectors)
    return out


def kmeans_by_hand(ids, vectors, m, k, restarts, iterations):
    best = None
    for restart in range(restarts):
        first = sorted(range(len(ids)), key=lambda i: hashlib.md5(f"{ids[i]}:{restart}".encode()).hexdigest())[:k]
        centers = [[vectors[i].get(p, 0) for p in range(m)] for i in first]
        score = lambda v, c: sum(x * x for x in c) - 2 * sum(w * c[p] for p, w in v.items())
        place = lambda: [min(range(k), key=lambda s: (score(v, centers[s]), s)) for v in vectors]
        for _ in range(iterations):
            at = place()
            moved = [[sum(v.get(p, 0) for v, a in zip(vectors, at) if a == s) // at.count(s) for p in range(m)] if s in at else centers[s] for s in range(k)]
            if moved == centers:
                break
            centers = moved
        at = place()
        cost = sum(score(v, centers[a]) for v, a in zip(vectors, at))
        if best is None or cost < best[0]:
            best = (cost, centers, at)
    return best[1:]


def heaviest(weights, terms, n):
    return [terms[p] for p in sorted(range(len(terms)), key=lambda p: (-weights[p], -p))[:n]]


@pytest.mark.parametrize("restarts, iterations", [(1, 1), (3, 20)])
def test_clusters_of_each_product_by_hand(make, restarts, iterations):
    reviews, rows = several(make)
    got = group_topics.cluster_themes(reviews.repartition(5), restarts, iterations=iterations).collect()
    for product, (n, terms, ids, vectors) in vectors_by_hand([{**r, "body": r["body"] or ""} for r in rows], "default").items():
        own = sorted((r for r in got if r.product_id == product), key=lambda r: r["rank"])
        if n < 5 or not terms:
            assert [r.theme for r in own] == {"C": ["Quality", "Price", "Performance", "Delivery"], "D": []}[product] or product == "C"
            continue
        centers, at = kmeans_by_hand(ids, vectors, len(terms), 5, restarts, iterations)
        named = [(" ".join(heaviest(c, terms, 2)).title(), at.count(s)) for s, c in enumerate(centers)]
        named.sort(key=lambda x: -x[1])
        assert [(r.theme, r.mentions) for r in own] == named, product
        assert all(r.sentiment == ("negative" if "poor" in r.theme.lower() else "neutral") for r in own)


def test_registered_clusters_go_on_until_they_rest(spark, tmp_path):
    """The query takes all ten restarts to their end; two restarts of six steps find other clusters here."""
    draw = random.Random(8)
    words = "battery screen price sound hinge cable motor fabric lens button strap filter handle speaker charger".split()
    docs = [(20 * i, " ".join(draw.choices(words[i % 4:i % 4 + 12], k=draw.randint(3, 9)))) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = sorted((r.review_id, f"{r.title} {r.body}") for r in queries.reviews(spark, str(tmp_path)).collect())
    rows = [{"product_id": "P", "body": " ".join(re.findall(r"\w+", text))} for _, text in own]
    ((_, terms, _, vectors),) = vectors_by_hand(rows, "default").values()
    themes = {}
    for restarts, steps in ((10, 1000), (2, 6)):
        centers, at = kmeans_by_hand([i for i, _ in own], vectors, len(terms), 5, restarts, steps)
        themes[restarts] = sorted((-at.count(s), s, " ".join(heaviest(c, terms, 2)).title()) for s, c in enumerate(centers))
    got = sorted(queries.QUERIES["cluster_themes"](spark, str(tmp_path)).collect(), key=lambda r: r["rank"])
    assert [(r.theme, r.mentions) for r in got] == [(name, -n) for n, _, name in themes[10]]
    assert [x[0] for x in themes[2]] != [x[0] for x in themes[10]]


def test_detailed_clusters_of_each_product_by_hand(make):
    reviews, rows = several(make)
    themes, members = group_topics.detailed_clusters(reviews.repartition(3), restarts=2, iterations=9)
    themes, members = themes.collect(), members.collect()
    for product, (n, terms, ids, vectors) in vectors_by_hand(rows, "detailed").items():
        inside = {}
        for m in members:
            if m.product_id == product:
                inside.setdefault(m.id, []).append(m.review_id)
        if not terms:
            assert {(t.id, t.theme, t.size) for t in themes if t.product_id == product} == {("theme_0", "General Feedback", 6)}
            assert sorted(inside["theme_0"]) == sorted(ids)
            continue
        k = 5 if n >= 5 else max(1, n // 2)
        centers, at = kmeans_by_hand(ids, vectors, len(terms), k, 2, 9)
        for s in set(at):
            theme, = [t for t in themes if t.product_id == product and t.id == f"theme_{s}"]
            of_cluster = [i for i, a in zip(ids, at) if a == s]
            ratings = [rows[int(i[1:])].get("rating", 3.0) for i in of_cluster]
            ratings = [3.0 if r is None else r for r in ratings]
            assert sorted(inside[theme.id]) == sorted(of_cluster) and theme.size == len(of_cluster)
            assert theme.keywords == heaviest(centers[s], terms, 5) and theme.sentiment_score == pytest.approx(sum(ratings) / len(ratings))
        assert len(inside) == len(set(at))


def topics_by_hand(terms, vectors, k, iterations, inner):
    m = len(terms)
    lam = [[(1 + (31 * p + 17 * t + 7 * p * t) % 23) * 1_000_000 for p in range(m)] for t in range(k)]
    for _ in range(iterations):
        phi = [[v / sum(row) for v in row] for row in lam]
        lam = [[1_000_000 // k] * m for _ in range(k)]
        for v in vectors:
            theta = [1.0 / k] * k
            for turn in range(inner):
                share = {}
                for p, w in sorted(v.items()):
                    parts = [theta[t] * phi[t][p] for t in range(k)]
                    share[p] = [w * x / sum(parts) for x in parts]
                if turn < inner - 1:
                    theta = [1_000_000 / k + sum(s[t] for s in share.values()) for t in range(k)]
            for p, s in share.items() if v else ():
                for t in range(k):
                    lam[t][p] += math.floor(s[t] + 0.5)
    return lam


def test_topics_of_each_product_by_hand(make):
    reviews, rows = several(make)
    got = group_topics.topic_themes(reviews.repartition(5), iterations=4).collect()
    for product, (n, terms, ids, vectors) in vectors_by_hand(rows, "topics").items():
        own = sorted((r for r in got if r.product_id == product), key=lambda r: r["rank"])
        if n < 5 or not terms:
            assert all(r.importance is None for r in own)
            continue
        lam = topics_by_hand(terms, vectors, min(5, n // 2), 4, 3)
        expected = [(heaviest(row, terms, 5), sum(row) // 1_000_000, round(max(row) / 1e6, 3)) for row in lam]
        expected.sort(key=lambda x: -x[2])
        assert [(r.keywords, r.mentions, r.importance) for r in own] == expected, product


def test_no_reviews(make):
    none = make({"body": "x"}).limit(0)
    assert group_topics.cluster_themes(none, restarts=2).count() == group_topics.topic_themes(none).count() == 0
    assert [t.count() for t in group_topics.detailed_clusters(none, restarts=2)] == [0, 0]


def test_vocabulary_with_ties_at_its_end(spark, make):
    # Many words and pairs as frequent as the last term; pairs across a rarer word do not exist.
    texts = [" ".join(f"w{(7 * i + j * (1 + i % 3)) % 83:02d}" for j in range(40)) + (" solo alone" if i == 3 else "") for i in range(30)]
    texts += ["solo rare alone rare solo alone", "", "solo"]
    pairs = lambda words: [f"{a} {b}" for a, b in zip(words, words[1:])]
    docs = [t.split() + pairs(t.split()) for t in texts]
    total = {}
    for t in (t for d in docs for t in d):
        total[t] = total.get(t, 0) + 1
    kept = sorted(sorted(total, key=lambda t: (-total[t], t))[:50])
    reviews = make(*[{"body": t} for t in texts])
    assert topics.tfidf_features(reviews).terms == kept
    assert group_topics.group_vectors(reviews).groups.first()["terms"] == kept
    words = spark.createDataFrame([("", i, t.split()) for i, t in enumerate(texts)], "__g string, __doc long, terms array<string>")
    made = {t for r in topics.with_candidates(words, topics.VECTOR_RULES["default"]).collect() for t in r.terms}
    least = min(total[t] for t in kept)
    assert set(kept) <= made and all(total[w] >= least for t in made for w in t.split()) and len(made) < len(total)


def test_steps_read_blocks_of_documents(make):
    reviews, _ = several(make)
    vectors = group_topics.group_vectors(reviews, "topics")
    able = vectors.groups.where(F.size("terms") > 0)
    blocks = group_topics.vector_blocks(vectors.docs.coalesce(1), able).collect()
    docs = {r["__g"]: r["n"] for r in vectors.docs.join(able.select("__g"), "__g").groupBy("__g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(blocks) == len(docs) and {b["__g"]: len(b["size"]) for b in blocks} == docs
    entries = vectors.docs.select("__g", F.explode("entries").alias("e")).groupBy("__g").agg(F.sum("e.w").alias("w")).collect()
    assert {r["__g"]: r["w"] for r in entries} == {b["__g"]: int(group_topics._weights(b.asDict()).sum()) for b in blocks if b["size"] and sum(b["size"])}
