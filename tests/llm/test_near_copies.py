import re
from itertools import combinations

import numpy as np
import pytest

from reviewloom.llm import combination_join
from reviewloom.llm.bottom_k import containment, distinct, edited_fingerprints, fingerprints, from_text, merge, merged_fingerprints, resemblance, sketch
from reviewloom.llm.combination_join import near_duplicate_components, near_duplicate_pairs
from reviewloom.llm.components import connected_components
from reviewloom.llm.shingles import word_hashes


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def components_by_hand(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    name = lambda k: min((i for i in least[find(k)] if i is not None), default=None) if sets[k] else rows[k][0]
    return sorted(repr((i, len(sets[k]), name(k))) for k, (i, _) in enumerate(rows))


def edited(text, places, mark):
    words = text.split(" ")
    for p in places:
        words[p] = f"{mark}{p}"
    return " ".join(words)


@pytest.mark.parametrize("percent, frequent, few", [(85, 16, 16), (85, 2, 2), (80, 1, 3), (80, 3, 1)])
def test_components(docs_of, cases, prose, monkeypatch, percent, frequent, few):
    # Small bounds let small tables use classes of frequent tokens and entries of many nodes.
    monkeypatch.setattr(combination_join, "FREQUENT", frequent)
    monkeypatch.setattr(combination_join, "FEW_NODES", few)
    monkeypatch.setattr(combination_join, "LEVELS", 2)
    base = prose(99, 400, marks=False)
    near = [(100 + i, edited(base, [10 + 7 * i, 200 + 5 * i], f"m{i}")) for i in range(12)]
    chain = [(200 + i, edited(base, range(0, 12 * i, 2), "c")) for i in range(9)]
    shared = [(300 + i, prose(400 + i, 90, marks=False) + " " + base[:300]) for i in range(10)]
    # Copies near the original and not near each other, and families of copies with edits in common.
    wide = [(400 + i, edited(base, range(i % 5, 380, 37 + i), f"w{i}")) for i in range(14)]
    family = [(500 + i, edited(edited(base, range(i % 3, 390, 28), f"f{i % 3}"), [5 + 9 * i], "g")) for i in range(15)]
    rows = cases + near + chain + shared + wide + family
    got = [repr(tuple(r)) for r in near_duplicate_components(docs_of(rows), percent=percent).collect()]
    assert sorted(got) == components_by_hand(rows, 4, percent)


def families(prose):
    """Copies near an original, chains, shared passages and families with edits in common, of several sizes."""
    base, other = prose(99, 400, marks=False), prose(98, 330, marks=False)
    near = [(100 + i, edited(base, [10 + 7 * i, 200 + 5 * i], f"m{i}")) for i in range(12)]
    chain = [(200 + i, edited(base, range(0, 12 * i, 2), "c")) for i in range(9)]
    shared = [(300 + i, prose(400 + i, 60 + 9 * i, marks=False) + " " + base[:300]) for i in range(10)]
    wide = [(400 + i, edited(other, range(i % 5, 320, 30 + i), f"w{i}")) for i in range(14)]
    family = [(500 + i, edited(edited(base, range(i % 3, 390, 28), f"f{i % 3}"), [5 + 9 * i], "g")) for i in range(15)]
    cut = [(600 + i, " ".join(other.split(" ")[:330 - 8 * i])) for i in range(9)]
    return near + chain + shared + wide + family + cut


@pytest.mark.parametrize("percent, few, block, levels", [(85, 2, 512, 24), (80, 2, 6, 24), (85, 3, 3, 2), (80, 1, 1, 2)])
def test_components_of_blocks_and_crowds(docs_of, cases, prose, monkeypatch, percent, few, block, levels):
    monkeypatch.setattr(combination_join, "FREQUENT", 2)
    monkeypatch.setattr(combination_join, "FEW_NODES", few)
    monkeypatch.setattr(combination_join, "BLOCK_NODES", block)
    monkeypatch.setattr(combination_join, "LEVELS", levels)
    rows = cases + families(prose)
    got = [repr(tuple(r)) for r in near_duplicate_components(docs_of(rows), percent=percent).collect()]
    assert sorted(got) == components_by_hand(rows, 4, percent)


@pytest.mark.parametrize("longest", [1 << 16, 256])
def test_bit_rows_leave_out_no_link(prose, monkeypatch, longest):
    monkeypatch.setattr(combination_join, "LONGEST_ROW", longest)
    texts = [t for _, t in families(prose)]
    sets = [combination_join.shingle_hashes(word_hashes(t.encode()), 4) for t in texts]
    block = combination_join._Block([len(s) for s in sets], [combination_join.bit_row(s) for s in sets], 80)
    links = {(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    every = np.arange(len(sets))
    kept, forest = block.all_pairs(every), block.closest_pairs(every)
    assert len(links) > 100 and links <= set(kept) and {tuple(sorted(p)) for p in forest} <= set(kept)
    if longest > 256:
        assert len(kept) < 1.5 * len(links)
    reached = connected(len(sets), kept)
    assert connected(len(sets), forest) == reached and len(forest) == len(sets) - len(set(reached))
    assert not block.all_pairs(every * 0) and not block.closest_pairs(every * 0)


def connected(n, pairs):
    part = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    return part


def test_copies_too_far_from_each_other_end_after_a_round(docs_of, prose, monkeypatch):
    base, written = prose(97, 400, marks=False), []
    rows = [(i, edited(base, range(i % 11, 400, 29 + i % 9), f"u{i % 70}x")) for i in range(140)]
    mat = combination_join.materialize

    def counted(df, name):
        out = mat(df, name)
        written.extend([out.count()] if name == "verified" else [])
        return out

    monkeypatch.setattr(combination_join, "materialize", counted)
    got = [repr(tuple(r)) for r in near_duplicate_components(docs_of(rows)).collect()]
    assert sorted(got) == components_by_hand(rows, 4, 85)
    assert len(written) <= 2 and sum(written) < 1000


def test_all_pairs_of_crowded_entries(docs_of, cases, prose):
    base = prose(99, 400, marks=False)
    rows = [r for r in cases if r[0] is not None and r[0] != 9] + [(100 + i, edited(base, [10 + 7 * i, 200 + 5 * i], f"m{i}")) for i in range(20)] + [(200, base), (201, base)]
    pairs, members = near_duplicate_pairs(docs_of(rows))
    member = {r.doc_id: r.node for r in members.collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    of_node = {frozenset(s): member[i] for i, s in sets.items() if s}
    assert len(set(of_node.values())) == len(of_node) and all(member[i] == (of_node[frozenset(s)] if s else None) for i, s in sets.items())
    want = {tuple(sorted((of_node[x], of_node[y]))) for x, y in combinations(of_node, 2) if 100 * len(x & y) >= 85 * len(x | y)}
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(want) > 150 and sorted(want) == sorted(got)


@pytest.mark.parametrize("percent", [10, 20, 33, 50, 80, 85])
def test_similar_sizes_have_a_band_in_common(percent):
    bands = {n: combination_join.bands(n, percent) for n in range(1, 300)}
    assert all(bands[a] & bands[b] for a in bands for b in range(a, min(299, 100 * a // percent) + 1))


def test_no_documents(docs_of):
    assert near_duplicate_components(docs_of([])).count() == 0
    assert edited_fingerprints(docs_of([])).count() == 0


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = dict(tuple(r) for r in connected_components(edges).collect())
    assert got == {**{i: 0 for i in range(71)}, 100: 100, 101: 100}


def test_equal_words_have_equal_hashes():
    long = "x" * 5000
    h = word_hashes(f"Aa  b\taA {long} {long}y {long}".encode())
    assert h[0] == h[2] and h[3] == h[5] != h[4] and len(h) == 6


def test_estimates(prose):
    a, b = prose(1, 3000, marks=False), prose(2, 3000, marks=False)
    mixed = a[:len(a) // 2] + " " + b[:len(b) // 2]
    x, y = sketch(a.encode(), 512), sketch(mixed.encode(), 512)
    true = len(shingles(a, 5) & shingles(mixed, 5)) / len(shingles(a, 5) | shingles(mixed, 5))
    assert abs(resemblance(x, y, 512) - true) < 0.08
    assert abs(distinct(x, 512) / len(shingles(a, 5)) - 1) < 0.15
    assert abs(containment(x, y, 512) - len(shingles(a, 5) & shingles(mixed, 5)) / len(shingles(a, 5))) < 0.15
    assert np.array_equal(merge(x, y, 512), merge(y, x, 512))


def test_fingerprints_merge(spark, docs_of, cases):
    rows = [(r.doc_id, r["__fingerprint"]) for r in fingerprints(docs_of(cases)).collect()]
    texts = dict(cases)
    for i, f in rows:
        if i in texts and i != 9:
            assert np.array_equal(from_text(f), sketch((texts[i] or "").encode()))
    whole = merged_fingerprints(spark.createDataFrame([(i or 0, f) for i, f in rows], "g long, __fingerprint string").selectExpr("g % 2 AS g", "__fingerprint").repartition(3), "g")
    for r in whole.collect():
        want = np.zeros(0, np.uint64)
        for i, f in rows:
            want = merge(want, from_text(f)) if (i or 0) % 2 == r.g else want
        assert np.array_equal(from_text(r["__fingerprint"]), want)


def test_edited_texts(docs_of, cases):
    import hashlib

    got = edited_fingerprints(docs_of(cases)).collect()
    rows = sorted(cases, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        want.append((i, len(text), hashlib.sha256((text[:len(text) - half] + following[:half]).encode()).hexdigest()))
    assert sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(map(repr, want))
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[2].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
