import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from reviewloom.llm.addressable_codes import NO_ID, Reader, read_checksums, read_documents, write_token_files
from reviewloom.llm.files import open_file
from reviewloom.llm.overlap_tokens import count_tokens
from reviewloom.llm.queries import tokenizer_file
from reviewloom.llm.word_table_bpe import encode_decode, expand, word_blocks

BYTES, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_ids():
    tool = Tokenizer.from_file(BYTES)
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (700, 64), (300, 1)])
def test_counts(docs_of, cases, byte_ids, chunk, overlap):
    out = count_tokens(docs_of(cases), BYTES, chunk=chunk, overlap=overlap)
    got = [(r.doc_id, r["__n_bytes"], r["__n_tokens"]) for r in out.collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, len((t or "").encode()), len(byte_ids(t)))) for i, t in cases)


def test_text_without_any_boundary(docs_of, byte_ids):
    text = "abc,é" * 500
    assert count_tokens(docs_of([(1, text)]), BYTES, chunk=100, overlap=10).first()["__n_tokens"] == len(byte_ids(text))


def test_words_there_and_back(docs_of, cases):
    tool = Tokenizer.from_file(WORDS)
    out = encode_decode(docs_of(cases), WORDS).collect()
    assert len(out) == len(cases)
    for r in out:
        ids = tool.encode(r.text or "", add_special_tokens=False).ids
        assert r["__ids"] == ids and r["__n_tokens"] == len(ids) and r["__decoded"] == tool.decode(ids, skip_special_tokens=False)
    digests = {(r.doc_id, r.text): r for r in encode_decode(docs_of(cases), WORDS, digests=True).collect()}
    for r in out:
        other = digests[r.doc_id, r.text]
        assert other["__ids_sha256"] == hashlib.sha256(np.array(r["__ids"], "<u4").tobytes()).hexdigest()
        assert other["__decoded_sha256"] == hashlib.sha256(r["__decoded"].encode()).hexdigest()


def test_token_files(docs_of, cases, byte_ids):
    files = write_token_files(docs_of(cases), BYTES)
    rows = sorted(cases, key=lambda r: (NO_ID if r[0] is None else r[0], r[1] or ""))
    want, at = [], 0
    for i, text in rows:
        ids = byte_ids(text) + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in read_checksums(files, docs_per_task=3).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_single_ids_are_found_without_their_neighbours(docs_of, cases, byte_ids):
    for row in write_token_files(docs_of([c for c in cases if c[0] == 6]), BYTES).collect():
        want = byte_ids(dict(cases)[6]) + [0]
        with open_file(row.path) as file:
            reader = Reader(file)
            assert reader.total == len(want)
            for at in (0, 1, 511, 512, 513, 4_000, len(want) - 1):
                assert reader.ids(at, 1).tolist() == want[at:at + 1]
            assert reader.ids(300, 2_000).tolist() == want[300:2_300]


def test_empty_tables(docs_of):
    none = docs_of([])
    assert count_tokens(none, BYTES).count() == 0
    assert encode_decode(none, WORDS).count() == 0
    assert read_documents(write_token_files(none, BYTES)).count() == 0


def test_word_numbers_stand_in_files_and_are_not_joined(docs_of):
    texts = [(i, f"alpha beta word{i} gamma, {i}") for i in range(300)]
    blocks = word_blocks(docs_of(texts).repartition(3), "text", ["doc_id"], 4)
    assert "codes" not in blocks.columns
    for row in blocks.collect():
        with open_file(row.path) as file:
            file.seek(row.start)
            codes = expand(file.read(row.size))
        assert len(codes) == sum(row.lengths) and set(codes.tolist()) == set(range(row.n_words))
