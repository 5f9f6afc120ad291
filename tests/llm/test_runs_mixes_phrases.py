import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from reviewloom.llm import collocations as phrases_module
from reviewloom.llm import cube_mix
from reviewloom.llm.collocations import collocations, frequent_phrases
from reviewloom.llm.cube_mix import mix_sources, water_level
from reviewloom.llm.periodic_runs import find_runs, plant_runs
from reviewloom.llm.recompression import extension, grammar, mirrored

WORD = r"[^\x20\x09-\x0D]+"


def runs_by_hand(words):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(24, 3 * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed_by_hand(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic(seed):
    draw = random.Random(seed)
    words = [f"w{draw.randrange(draw.choice((1, 2, 5, 400)))}" for _ in range(draw.choice((0, 1, 23, 24, 60, 400)))]
    for _ in range(3):
        if words:
            a, p = draw.randrange(len(words)), 1 + draw.randrange(1 + len(words) // 4)
            for i in range(a, min(len(words), a + draw.randrange(len(words)))):
                words[i] = words[a + (i - a) % p]
    return words


def test_grammar_extensions():
    draw = np.random.default_rng(3)
    for high in (1, 2, 3, 50):
        words = np.concatenate([[900], np.tile(draw.integers(0, high, 40), 6), draw.integers(0, high, 200), [901]])
        levels = grammar(words)
        a = draw.integers(1, len(words) - 2, 500)
        b = draw.integers(1, len(words) - 2, 500)
        a, b = np.minimum(a, b), np.maximum(a, b) + (a == b)
        b = np.minimum(b, len(words) - 1)
        a, b = a[a < b], b[a < b]
        for lv, text, x, y in ((levels, words, a, b), (mirrored(levels), words[::-1], len(words) - 1 - b, len(words) - 1 - a)):
            x, y = np.minimum(x, y), np.maximum(x, y)
            got = extension(lv, x, y)
            for i, j, n in zip(x.tolist(), y.tolist(), got.tolist()):
                k = 0
                while j + k < len(text) and text[i + k] == text[j + k]:
                    k += 1
                assert n == k


def test_runs(docs_of, cases):
    rows = cases + [(1000 + i, " ".join(periodic(i))) for i in range(150)] + [(5000, "x " * 30_000), (5001, "a b c " * 8_000 + "end")]
    got = find_runs(docs_of(rows), keep=["doc_id"]).collect()
    expected = []
    for i, text in rows:
        words = re.findall(WORD, text or "")
        runs = runs_by_hand(words) if len(words) < 20_000 else {5000: [(0, 30_000, 1)], 5001: [(0, 24_000, 3)]}[i]
        expected.append(repr((i, len(words), runs, collapsed_by_hand(words, runs))))
    assert sorted(repr((r[0], r[1], [tuple(x) for x in r[2]], r[3])) for r in got) == sorted(expected)
    assert find_runs(docs_of(rows[:3])).columns[:4] == ["doc_id", "text", "id", "tag"]
    assert find_runs(docs_of([])).count() == 0


def test_planted_runs(docs_of, cases):
    rows = cases + [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(100, 300)]
    expected = []
    for i, text in rows:
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words, g = (text or "").split(), h // 10
        n = len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[j] if j < a else words[a + (j - a) % p] for j in range(n))
        expected.append(repr((i, text)))
    assert sorted(repr(tuple(r)) for r in plant_runs(docs_of(rows)).collect()) == sorted(expected)


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    every, capped = sum(sizes.values()), set()
    while True:
        rest = every - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: Fraction(3 * sizes[s]) if s in capped else Fraction(rest * weight[s], free) for s in names}
        over = {s for s in names if target[s] > 3 * sizes[s]}
        if not over:
            return {s: float(t) for s, t in target.items()}
        capped |= over


@pytest.fixture
def sourced(spark, cases, prose):
    def build(rows):
        return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, size string, `rank` int")

    rows = [(i, t, None) for i, t in cases] + [(10 + i, prose(i, 5 + i % 70), "big") for i in range(400)]
    rows += [(600 + i, prose(700 + i, 30), ["é", "Z", "a", "tiny"][i % 4 if i < 60 else 1]) for i in range(130)] + [(999, None, "none"), (998, "one", "solo")]
    return build, rows


@pytest.mark.parametrize("part, fan", [(20_000, 5_000), (40, 3)])
def test_mix(sourced, monkeypatch, part, fan):
    monkeypatch.setattr(cube_mix, "PART_DOCUMENTS", part)
    monkeypatch.setattr(cube_mix, "FAN_IN", fan)
    build, rows = sourced
    docs = build(rows)
    got = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(7, "text")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(WORD, text or ""))
    target, taken = targets_by_hand(sizes), Counter()
    for row in got:
        assert row["__size"] * 3 >= row["__taken"] and (row["__taken"] % row["__size"] == 0 if row["__size"] else row["__taken"] == 0)
        assert row["__source_size"] == sizes[row["source"]] and row["__target"] == pytest.approx(target[row["source"]], rel=1e-12)
        taken[row["source"]] += row["__taken"]
    assert len(got) == len(rows)
    for source in ("big", "é", "Z", "a", "tiny"):
        assert abs(taken[source] - target[source]) <= 3, source
    assert taken["none"] == 0


def test_mix_of_nothing(sourced):
    build, _ = sourced
    assert mix_sources(build([])).count() == 0
    assert [r["__taken"] for r in mix_sources(build([(1, None, "a"), (1, "", "a"), (None, None, None)])).collect()] == [0, 0, 0]


def test_chances_are_kept():
    # Over many draws every document is taken as often as its probability says, and both totals are kept.
    units = [(100 + 7 * i, 0.15 + 0.02 * (i % 30), i) for i in range(40)]
    times = np.zeros(40)
    for seed in range(3000):
        done = sorted(cube_mix.flight(units, random.Random(seed).random))
        assert sum(0 < c < 1 for _, c in done) <= 2
        assert sum(c for _, c in done) == pytest.approx(sum(u[1] for u in units))
        assert sum(units[i][0] * c for i, c in done) == pytest.approx(sum(u[0] * u[1] for u in units))
        times += [c for _, c in done]
    assert np.abs(times / 3000 - [u[1] for u in units]).max() < 0.04


def test_water_level(spark):
    rows = spark.createDataFrame([(5, 1), (2, 1), (1, 100), (5, 50), (2, 0)], "weight long, size long")
    level = water_level(rows)
    assert sum(min(Fraction(3 * s), level * w) for w, s in [(5, 1), (2, 1), (1, 100), (5, 50), (2, 0)]) == 152


def phrases_by_hand(rows, least, top):
    count, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i:i + size])] += 1
    candidates = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    inside = lambda w, x: any(x[i:i + len(w)] == w for i in range(len(x) - len(w) + 1))
    out = []
    for (lang, w), a in candidates.items():
        if any(g == lang and len(x) > len(w) and b >= a and inside(w, x) for (g, x), b in candidates.items()):
            continue
        cuts = [(1000 * a * totals[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(w), count[lang, w[:k]], count[lang, w[k:]]))
    result = []
    for lang in totals:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        result += [(lang, i + 1, p, a, l, r, totals[lang], s) for i, (_, s, a, p, l, r) in enumerate(own)]
    return sorted(result)


@pytest.mark.parametrize("group, table", [(8 << 20, 16 << 20), (900, 1 << 16)])
def test_collocations(spark, prose, monkeypatch, group, table):
    monkeypatch.setattr(phrases_module, "GROUP_BYTES", group)
    monkeypatch.setattr(phrases_module, "FILTER_BYTES", table)
    draw = random.Random(5)
    common = ["alpha Beta gamma", "red red red red red red", "x y z u v w", "één twee", "a\tb", "New York"]
    text = lambda: " ".join(draw.choice([*common, prose(draw.randrange(30), 3)]) + draw.choice(["", "", ".", ",\n", "!"]) for _ in range(40))
    rows = [(text(), draw.choice(["en", "en", "de", None])) for _ in range(60)] + [(None, "en"), ("", "fr"), ("...", None)] + [(text(), "es")] * 4
    docs = spark.createDataFrame([(t, g, 1, "x", 2) for t, g in rows], "text string, lang string, n long, phrase string, size int")
    expected = phrases_by_hand(rows, 12, 9)
    assert sorted(tuple(r) for r in collocations(spark, docs, least=12, top=9).collect()) == expected
    assert collocations(spark, docs.limit(0), least=12).count() == 0


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    # All n-grams of a length share a fingerprint; the words at the pointers still part the phrases.
    monkeypatch.setattr(phrases_module.Words, "fingerprints", lambda self, size, places: np.zeros(len(places), np.uint64))
    rows = [("a b a b a b c. d e f", "en")] * 5
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {(r["size"], r["phrase"]): r["n"] for r in frequent_phrases(spark, docs, least=5, longest=2).collect()}
    assert got == {(0, ""): 50, (1, "a"): 15, (1, "b"): 15, **{(1, w): 5 for w in "cdef"}, (2, "a b"): 15, (2, "b a"): 10, (2, "b c"): 5, (2, "d e"): 5, (2, "e f"): 5}
