import ast
import glob
import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare
from reviewloom.llm.mil_toxicity import Scorer, noisy_or, sentences, train
from reviewloom.llm.oracle import ORACLE
from reviewloom.llm.queries import held_out
from tests.llm.test_archives_and_lines import SPACES, kept_by_hand
from tests.llm.test_near_copies import components_by_hand
from tests.llm.test_search_and_labels import words_of
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    line = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("OK"), line


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()} == {f"op{n}" for n in range(1, 11)}
    assert "pipeline" in entry.queries()


def test_stages_decide_and_keep_the_columns(spark, con):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    before = set(given)
    toxic = {i for (i,) in con.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= before
        if name == "toxicity":
            gone = before - set(rows)
            labelled = {i for (i,) in con.execute("SELECT doc_id FROM labels").fetchall()}
            assert not (gone & labelled) - toxic
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) and len(r.text) <= len(given[i].text) for i, r in rows.items())
        before = set(rows)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in final} == before and all(len(r.ids) == r.n_tokens for r in final)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0


def test_near_copies_without_ids(spark):
    base = [" ".join(f"{c}{k}" for k in range(80)) for c in "abcd"]
    near = [b + " more" for b in base]
    rows = [(1, base[0]), (None, near[0]), (None, base[0]), (None, base[1]), (None, near[1]), (None, base[1]), (3, base[2]), (2, near[2]), (None, base[3]), (None, ""), (None, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs.repartition(3), SMALL)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    group = [t for i, t in kept if i is None and t in (base[1], near[1])]
    assert len(group) == 1
    kept.remove((None, group[0]))
    assert sorted(map(repr, kept)) == sorted(map(repr, [(1, base[0]), (2, near[2]), (None, base[3]), (None, ""), (None, None), (4, "")]))


@pytest.fixture(scope="module")
def planted(spark, con, prose):
    """Short documents of the fixture with near copies, benchmark passages and repeated lines."""
    rows = con.execute("SELECT doc_id, text FROM documents WHERE n_chars < 3000 ORDER BY doc_id LIMIT 60").fetchall()
    item = max((t for (t,) in con.execute("SELECT text FROM benchmark").fetchall()), key=lambda t: len(words_of(t)))
    passage = " ".join(words_of(item)[:10])
    base = prose(5, 120, marks=False)
    rows += [(90001, base), (90002, base + " more"), (90003, " ".join(base.split(" ")[:100])), (90004, " ".join(base.split(" ")[:80]))]
    rows += [(90010, "before it " + passage.upper() + " after"), (90011, " ".join(passage.split(" ")[:9])), (90020, "a line of its own\nThis LINE is repeated"), (90021, "this line is repeated"), (90022, "new words\nthis line is repeated\n")]
    return rows, spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def kept_rows(out):
    return sorted((r.doc_id, r.text) for r in out.collect())


def test_line_dedup_by_hand(spark, planted):
    rows, docs = planted
    want = [(i, text) for i, _, gone, text in kept_by_hand(rows) if text.strip(SPACES) or not gone]
    assert kept_rows(corpus_pipeline.line_dedup(spark, docs, SMALL)) == sorted(want) and len(want) < len(rows)


def test_near_duplicates_by_hand(spark, planted):
    rows, docs = planted
    named = {i: least for i, _, least in map(ast.literal_eval, components_by_hand(rows, 5, 80))}
    want = [(i, t) for i, t in rows if named[i] == i]
    assert kept_rows(corpus_pipeline.near_duplicates(spark, docs, SMALL)) == sorted(want)
    assert named[90002] == named[90003] == 90001


def test_decontamination_by_hand(spark, con, planted):
    rows, docs = planted
    windows = set()
    for (text,) in con.execute("SELECT text FROM benchmark").fetchall():
        own = words_of(text)
        size = min(10, len(own))
        windows |= {tuple(own[k:k + size]) for k in range(len(own) - size + 1) if size}
    sizes = {len(w) for w in windows}
    bad = lambda own: any(tuple(own[k:k + n]) in windows for n in sizes for k in range(len(own) - n + 1))
    want = [(i, t) for i, t in rows if not bad(words_of(t))]
    assert kept_rows(corpus_pipeline.decontamination(spark, docs, SMALL)) == sorted(want)
    assert 90010 not in dict(want) and 90011 in dict(want)


def test_bpe_by_hand(spark, planted):
    from tokenizers import Tokenizer

    rows, docs = planted
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_file("word_bpe_49k.json"))
    out = {r.doc_id: r for r in corpus_pipeline.bpe(spark, docs, SMALL).collect()}
    for i, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(out[i].ids) == ids and out[i].n_tokens == len(ids)
        assert out[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_toxicity_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{SMALL}/labels.parquet").where(~held_out()))
    scorer = Scorer(model)
    score = lambda text: noisy_or(scorer.logits([words for _, _, words in sentences(text or "")]))
    want = sorted(r.doc_id for r in docs.collect() if score(r.text) < 0.5)
    assert sorted(r.doc_id for r in corpus_pipeline.toxicity(spark, docs, SMALL).collect()) == want and len(want) < docs.count()


def test_run_is_all_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = spark.createDataFrame((out := stage(spark, want, SMALL)).collect(), out.schema)
    rows = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert rows == sorted(tuple(r) for r in want.collect()) and rows
