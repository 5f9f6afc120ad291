import gzip
import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from reviewloom.llm import warc
from reviewloom.llm.files import open_file, open_stream
from reviewloom.llm.line_dedup import drop_repeated_lines

SPACES = " \t\n\x0b\x0c\r"


def upper_to_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def kept_by_hand(rows, min_chars=10, min_docs=2):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = upper_to_lower(line.strip(SPACES))
            if len(key) >= min_chars:
                holders[key].add(i)
    order = lambda i: (i is None, i or 0)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = []
        for line in lines:
            own = holders.get(upper_to_lower(line.strip(SPACES)), {i})
            stay += [line] if len(own) < min_docs or min(own, key=order) == i else []
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_lines(docs_of, cases):
    rows = cases + [(30, "One LINE of text \nshort\nonly here, once"), (31, "\tone line of text\nshort\n"), (32, "É line of text..\né line of text..")]
    for min_docs in (2, 3):
        out = drop_repeated_lines(docs_of(rows), min_docs=min_docs)
        assert set(out.columns) > {"id", "tag", "pos", "hash", "key"}
        got = [(r.doc_id, r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in out.collect()]
        assert sorted(got, key=repr) == kept_by_hand(rows, min_docs=min_docs)


def test_no_documents(docs_of):
    assert drop_repeated_lines(docs_of([])).count() == 0


def test_line_dedup_runs_no_python(docs_of, cases):
    plan = drop_repeated_lines(docs_of(cases).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, path string")


PAGES = [
    (5, "u", "x" * 200), (3, None, "x" * 200), (9, "a\r\nb: c", "x" * 200), (1, "u", None), (2, "u", ""), (4, "u", "y" * 99), (6, "u", "y" * 99),
    (7, "u", "é" * 400_000), (8, "u", "WARC/1.1\r\n\r\n" * 50), (None, "u", "x" * 200), (None, "z", "q" * 150), (3, None, "x" * 200),
]


def test_archives(spark):
    archives = warc.write_archives(warc.record_decisions(pages(spark, PAGES)), roll_bytes=900)
    index = warc.normalise(archives)
    assert index.count() == len(PAGES) == archives.agg(F.sum("records")).first()[0]
    rows = warc.read_records(index, with_payload=True).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in PAGES:
        body = (h or "").encode()
        to = first.get(h) if len(body) >= 100 and first.get(h) != i else None
        want.append((warc.RECORD_ID + ("" if i is None else str(i)), "response" if to is None else "revisit", None if to is None else f"{warc.RECORD_ID}{to}", len(body), hashlib.sha256(body).hexdigest(), body if to is None else b""))
    got = [(r.record_id, r.record_type, r.refers_to, r.declared_bytes, r.digest, bytes(r.payload)) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert all(r.computed_digest == r.digest for r in rows if r.record_type == "response")


def test_one_stream_before_and_members_after(spark):
    archives = warc.write_archives(warc.record_decisions(pages(spark, PAGES).coalesce(1)))
    index = warc.normalise(archives).orderBy("path", "offset").collect()
    for r in index:
        with open_file(r.path) as file:
            assert gzip.decompress(file.read_at(r.length, r.offset)).startswith(b"WARC/1.1\r\n")
    for r in archives.collect():
        with open_stream(r.path) as stream:
            raw = stream.read()
        assert gzip.decompress(raw).count(b"WARC-Record-ID") == r.records
    # A normalised file, of many members, is good input too.
    again = warc.normalise(spark.createDataFrame([(p,) for p in {r.path for r in index}], "path string"))
    assert again.count() == len(index)


def test_no_pages(spark):
    assert warc.read_records(warc.normalise(warc.write_archives(warc.record_decisions(pages(spark, []))))).count() == 0
