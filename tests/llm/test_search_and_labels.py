import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark import TaskContext

from reviewloom.llm import mil_toxicity
from reviewloom.llm.mil_toxicity import offending_sentences, score_documents, sentences, train
from reviewloom.llm.reply_trees import as_chain, format_paths, parse_conversation, reply_paths
from reviewloom.llm.wu_manber import find_test_strings


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def found_by_hand(rows, items):
    windows = []
    for i, text in items:
        own = words_of(text)
        size = min(10, len(own))
        windows += [(str(i) if i is not None else "null", own[k:k + size]) for k in range(len(own) - size + 1) if size]
    out = []
    for i, text in rows:
        own, hit, found = words_of(text), set(), set()
        for item, w in windows:
            for k in range(len(own) - len(w) + 1):
                if own[k:k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    found.add(item)
        out.append(repr((i, len(own), len(hit), sorted(found))))
    return sorted(out)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 700])
def test_strings_are_found(spark, docs_of, cases, prose, pass_bytes):
    item = prose(777, 25)
    items = [(1, item), (2, prose(778, 12)), (2, prose(779, 30)), (10, "Two Words"), (3, ""), (4, None), (None, prose(780, 14)), (5, item), (6, "éé")]
    rows = cases + [(60, prose(3) + " " + item.upper().replace("É", "é") + " x"), (61, item[:40]), (62, "so two  words, two-words; twowords"), (63, prose(779, 30) + " éé " + prose(780, 14))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    out = find_test_strings(docs_of(rows), benchmark, pass_bytes=pass_bytes).collect()
    assert sorted(repr((r.doc_id, r["__n_words"], r["__n_hit"], r["__items"])) for r in out) == found_by_hand(rows, items)
    assert all(sum(s["after"] - s["first"] for s in r["__spans"]) == r["__n_hit"] for r in out)


def test_no_strings_or_no_documents(spark, docs_of, cases):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["__n_hit"] for r in find_test_strings(docs_of(cases), none).collect()} == {0}
    assert find_test_strings(docs_of([]), none).count() == 0


def toxic_rows(n, seed):
    draw = random.Random(seed)
    clean = [a + b for a in ("on", "the", "ret", "sha", "ing", "bl") for b in ("er", "an", "ith", "om", "us")]
    bad = ["scumbag", "scummy", "worthless", "idiotic", "idiot"]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        parts = [" ".join(draw.choice(clean) for _ in range(9)) for _ in range(draw.randint(2, 8))]
        if toxic:
            parts.insert(draw.randrange(len(parts)), "you " + draw.choice(bad) + " " + draw.choice(clean))
        rows.append((i, ". ".join(parts) + ".", int(toxic)))
    return rows


def test_toxic_documents_and_their_sentences(spark, docs_of):
    rows = toxic_rows(400, 1)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows[:300]] + [(None, 1, 0), (7, None, 0)], "doc_id long, toxic int, quality int")
    docs = docs_of([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "..!\n"), (None, "on the way")])
    model = train(docs, labels)
    scored = {r.doc_id: r["__score"] for r in score_documents(docs, model).collect()}
    held = [(y, scored[i] >= 0.5) for i, _, y in rows[300:]]
    assert sum(bool(y) == p for y, p in held) >= 97
    assert scored[900] == scored[901] == scored[902] == 0.0 and all(0 <= s <= 1 for s in scored.values())
    located = offending_sentences(docs, model).collect()
    assert located and sum(bool(re.search("scum|worthless|idiot", r["__sentence"])) for r in located) >= 0.95 * len(located)
    assert all(r.text[r["__start"]:r["__end"]] == r["__sentence"] for r in located)


def test_all_tasks_scan_for_the_sample(spark, docs_of, tmp_path):
    """No task reads all documents, and the fit does not depend on how they are dealt."""
    rows = toxic_rows(120, 2)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    folder = str(tmp_path)

    def mark(batches):
        for batch in batches:
            open(f"{folder}/{TaskContext.get().taskAttemptId()}", "w").close()
            yield batch

    docs = docs_of([(i, t) for i, t, _ in rows]).select("doc_id", "text").repartition(6)
    one = train(docs.mapInArrow(mark, docs.schema), labels)
    assert len(list(tmp_path.iterdir())) == 6
    assert (one == train(docs.orderBy("text").repartition(2), labels)).all()


def test_without_labels_nothing_is_toxic(spark, docs_of, cases):
    model = train(docs_of(cases), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r["__score"] < 0.5 for r in score_documents(docs_of(cases[:4]), model).collect())
    assert score_documents(docs_of([]), model).count() == 0


def test_sentences():
    text = "One two. three!\n\n four"
    assert [text[a:b] for a, b, _ in sentences(text)] == ["One two", " three", " four"]


def unspaced_rows(n, seed):
    """Texts without a space: in an unspaced script, hyphen chains, or one run of letters; what is toxic lies in the middle."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        toxic, kind = i // 3 % 2, i % 3
        if kind == 0:
            syllables, bad, glue = [chr(0x4E00 + 37 * k) for k in range(60)], "\u6ec5\u7d76\u8822\u8ca8", ""
        else:
            syllables, bad, glue = ["on", "ther", "ret", "sha", "ing", "blu", "kan", "mer", "tos", "vel"], draw.choice(("scumbag", "worthless")), "-" if kind == 1 else ""
        parts = [draw.choice(syllables) for _ in range(300)]
        if toxic:
            parts[draw.randrange(100, 200)] = bad
        rows.append((i, glue.join(parts), toxic))
    return rows


def test_long_words_are_read_whole(spark, docs_of):
    rows = unspaced_rows(480, 5)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows[:360]], "doc_id long, toxic int, quality int")
    docs = docs_of([(i, t) for i, t, _ in rows])
    model = train(docs, labels)
    scored = {r.doc_id: r["__score"] for r in score_documents(docs, model).collect()}
    for kind in range(3):
        held = [(y, scored[i] >= 0.5) for i, _, y in rows[360:] if i % 3 == kind]
        assert sum(bool(y) == p for y, p in held) >= 0.8 * len(held), kind


def test_toxic_words_inside_long_chains(spark, docs_of):
    """A chain scores like its words between spaces; in a run of letters, the toxic word counts."""
    rows = toxic_rows(400, 1)
    model = train(docs_of([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int"))
    chain = ["oner", "than", "reting", "shaus", "blom"] * 20
    bad = chain[:50] + ["scumbag"] + chain[50:]
    docs = docs_of([(1, "-".join(chain)), (2, "-".join(bad)), (3, " ".join(bad)), (4, "".join(chain)), (5, "".join(bad))])
    scored = {r.doc_id: r["__score"] for r in score_documents(docs, model).collect()}
    assert scored[2] == pytest.approx(scored[3]) and scored[2] > 10 * scored[1] and scored[5] > scored[4]


@pytest.mark.parametrize("n", [64, 65, 66, 76, 77, 500])
def test_pieces_hold_all_ngrams(n):
    draw = random.Random(n)
    word = "".join(draw.choice("ab\u00e9\u4e01\U0001f600") for _ in range(n))
    (_, _, pieces), = sentences(word)
    raw, seen = b"\x02" + word.encode() + b"\x03", set()
    for piece in pieces:
        b = b"\x02" + piece.encode() + b"\x03"
        seen |= {b[k:k + 5] for k in range(len(b) - 4)}
    assert {raw[k:k + 5] for k in range(len(raw) - 4)} <= seen
    assert n > 64 or pieces == {word}


def test_sentences_of_other_scripts():
    text = "\u4e00\u4e01\u3001\u4e02\u3002\u4e03\uff01\u4e04"
    assert [(text[a:b], sorted(w)) for a, b, w in sentences(text)] == [("\u4e00\u4e01\u3001\u4e02", ["\u4e00\u4e01", "\u4e02"]), ("\u4e03", ["\u4e03"]), ("\u4e04", ["\u4e04"])]


def copied_rows(docs_of, spark):
    rows = toxic_rows(60, 3)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    return rows, docs_of([(i, t) for i, t, _ in rows for _ in range(1 + i % 3)]), labels


def test_copies_of_a_row_are_fitted_with_their_number(spark, docs_of):
    """A row that is there three times counts three times, but reaches the fit once."""
    rows, docs, labels = copied_rows(docs_of, spark)
    once = [(mil_toxicity.word_lines(t), y, 1 + i % 3) for i, t, y in rows]
    each = [(lines, y) for lines, y, n in once for _ in range(n)]
    share = sum(y for _, _, y in rows) / len(rows)
    expected = mil_toxicity.fit(each, share)
    assert np.allclose(mil_toxicity.fit(once, share), expected, rtol=1e-6, atol=1e-9)
    assert np.allclose(train(docs, labels), expected, rtol=1e-4, atol=1e-6)


def test_work_in_parts_changes_nothing(spark, docs_of, monkeypatch):
    rows = [*toxic_rows(60, 4), (60, "Shaus \u03a3\u0391\u03a3 rETing\u3000oner\x1fthan " * 40, 0)]
    words = [(mil_toxicity.word_lines(t), y) for _, t, y in rows]
    table = mil_toxicity.fit(words, 0.5)
    whole = [mil_toxicity.Scorer(table).read(t) for _, t, _ in rows]
    for name, value in (("STRETCH", 7), ("FEATURE_WORDS", 5), ("TEXT_WORDS", 9), ("PASS_WORDS", 40)):
        monkeypatch.setattr(mil_toxicity, name, value)
    assert [(mil_toxicity.word_lines(t), y) for _, t, y in rows] == words
    assert np.allclose(mil_toxicity.fit(words, 0.5), table, rtol=1e-6, atol=1e-9)
    for (_, text, _), (starts, ends, logits) in zip(rows, whole):
        again = mil_toxicity.Scorer(table).read(text)
        assert again[:2] == (starts, ends) and np.allclose(again[2], logits)
        assert [(a, b) for a, b, _ in sentences(text)] == list(zip(starts, ends))


@pytest.mark.parametrize("mark", [".", ""])
def test_scoring_a_long_text_takes_little_memory(mark):
    """The words of a text are not all held at once, whether it has many sentences or one."""
    words = [f"w{i * i % 997}x" for i in range(997)]
    text = " ".join(words[i * 31 % 997] + (mark if i % 12 == 11 else "") for i in range(800_000))
    scorer = mil_toxicity.Scorer(np.zeros(2**mil_toxicity.TABLE_BITS + 1))
    tracemalloc.start()
    try:
        _, _, logits = scorer.read(text)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(logits) == (-(-800_000 // 12) if mark else 1) and peak < 30_000_000, peak


MESSAGES = "tree_id long, message_id long, parent_id long, role string, text string, score double, place string"


def test_best_paths(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "poor", 0.1), (1, 3, 1, "assistant", "good </turn> \\", 0.9), (1, 4, 3, "user", "thanks", 0.5),
        (1, 5, 99, "user", "lost parent", 0.2), (None, 1, None, "user", None, None), (2, 1, None, None, "<turn x>", 1.0), (2, 1, None, None, "<turn x>", 1.0),
    ]
    messages = spark.createDataFrame([(*r, "x") for r in rows], MESSAGES)
    paths = reply_paths(messages, best=None)
    got = {(r.tree, r["rank"]): [x.node for x in paths.where(f"tree <=> {r.tree if r.tree is not None else 'NULL'} AND leaf = {r.leaf}").orderBy("place").collect()] for r in paths.select("tree", "leaf", "rank").distinct().collect()}
    assert got == {(1, 1): [1, 3, 4], (1, 2): [5], (1, 3): [1, 2], (None, 1): [1], (2, 1): [1]}
    out = {r.tree: r for r in format_paths(reply_paths(messages), messages).collect()}
    assert parse_conversation(out[1].formatted) == [("user", "q"), ("assistant", "good </turn> \\"), ("user", "thanks")]
    assert parse_conversation(out[None].formatted) == [("user", "")] and parse_conversation(out[2].formatted) == [("", "<turn x>")]
    (span,) = out[1].loss_spans
    assert out[1].formatted[span.first:span.after] == "good \\</turn\\> \\\\"


def test_messages_without_ids_have_paths_of_their_own(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 0.5), (1, None, 2, "user", "one", 0.9), (1, None, 2, "user", "two", 0.8),
        (1, None, None, "user", "alone", 0.1), (1, None, None, "user", "alone", 0.1), (None, None, 7, None, None, None),
    ]
    messages = spark.createDataFrame([(*r, "x") for r in rows], MESSAGES).repartition(3)
    out = format_paths(reply_paths(messages, best=None), messages).collect()
    got = sorted((r.tree or 0, r["rank"], [t for _, t in parse_conversation(r.formatted)]) for r in out)
    assert got == [(0, 1, [""]), (1, 1, ["q", "a", "one"]), (1, 2, ["q", "a", "two"]), (1, 3, ["alone"]), (1, 4, ["alone"])]


def test_deep_chain_and_cycle(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(70)], "conv_id long, turn long, role string, text string")
    messages = as_chain(turns)
    names = {"tree": "conv_id", "node": "__message"}
    (row,) = format_paths(reply_paths(messages, **names, parent="__parent", score=None), messages, **names).collect()
    assert [t for _, t in parse_conversation(row.formatted)] == [f"t{t}" for t in range(70)] and len(row.loss_spans) == 35
    assert reply_paths(messages.where("turn < 0"), **names, parent="__parent", score=None).count() == 0
    ring = spark.createDataFrame([(1, 1, 2, "u", "a", 0.0, ""), (1, 2, 1, "u", "b", 0.0, "")], MESSAGES)
    with pytest.raises(ValueError):
        reply_paths(ring)
