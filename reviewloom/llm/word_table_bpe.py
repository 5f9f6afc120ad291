"""BPE encoding and decoding through a table of distinct words.

Texts are split into words where they are read. The words of a run of
documents (a block) are numbered, and the block keeps one number for each
word of its texts. The distinct words of all blocks meet by the hash of the
word, so the tokenizer sees each distinct word once; the ids go back to the
blocks and are joined by position. Decoding joins the ids that occur in a block
with the table of pieces, and puts the pieces together by position.

Cutting at spaces, tabs and line ends is safe for a tokenizer that drops white
space: no normalisation, special token or word reaches across it.

What is shuffled: each distinct word once for each block, and its ids back. A word
that stands everywhere adds one entry for each block. The word numbers of the texts
are written once, to files of the shared folder, and read where a block is put together.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.chunk_cache import load_tokenizer
from reviewloom.llm.files import new_file, open_file
from reviewloom.llm.memory import released
from reviewloom.sources.shared import materialize, new_path

BLOCK_CHARS = 8 << 20
BATCH_BYTES = 2 << 20
_SPACES = str.maketrans("\t\n\r", "   ")
#: Letters up to U+024F, then at most one run of marks: two words for the tokenizer, and case does not matter.
_LETTERS = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]+)([.,;:!?]*)")
_TOKENIZERS: dict[str, object] = {}


def split_words(piece: str) -> list[str]:
    """The words of a text between two spaces."""
    found = _LETTERS.fullmatch(piece)
    if not found:
        return [piece]
    word, marks = found.groups()
    return [word.lower(), marks] if marks else [word.lower()]


class _Block:
    """Numbers the words of texts."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = {"": []}
        self.codes: list[np.ndarray] = []
        self.rows: list = []
        self.chars = 0

    def add(self, row, text: str) -> None:
        pieces = text.translate(_SPACES).split(" ") if any(c in text for c in "\t\n\r") else text.split(" ")
        for piece in set(pieces).difference(self.pieces):
            self.pieces[piece] = [self.words.setdefault(w, len(self.words)) for w in split_words(piece)]
        codes: list[int] = []
        for numbers in map(self.pieces.__getitem__, pieces):
            codes += numbers
        self.codes.append(np.array(codes, "<u4"))
        self.rows.append(row)
        self.chars += len(text)

    def batch(self, schema: pa.Schema, buckets: int, path: str, stream: pa.NativeFile) -> pa.RecordBatch:
        """One row, its codes added to a file; words ordered by bucket and frequency, their places as steps, so that both compress well."""
        flat = np.concatenate(self.codes) if self.codes else np.zeros(0, "<u4")
        counts = np.bincount(flat, minlength=len(self.words))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order), dtype="<u4")
        words = list(self.words)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        by_bucket: dict[int, tuple[list[str], list[int]]] = {}
        for number in np.lexsort((rank, bucket)):
            own = by_bucket.setdefault(int(bucket[number]), ([], []))
            own[0].append(words[number])
            own[1].append(int(rank[number]))
        start, codes = stream.tell(), shrink(rank[flat] if len(flat) else flat)
        stream.write(codes)
        return pa.RecordBatch.from_pylist(
            [
                {
                    "block": uuid.uuid4().int >> 65,
                    "rows": self.rows,
                    "lengths": [len(c) for c in self.codes],
                    "n_words": len(words),
                    "path": path,
                    "start": start,
                    "size": len(codes),
                    "words": [{"bucket": b, "words": packed(w), "places": shrink(np.diff(np.array(p, "<u4"), prepend=np.uint32(0)))} for b, (w, p) in by_bucket.items()],
                }
            ],
            schema,
        )


def packed(words: list[str]) -> bytes:
    """Words, none of which has a line end, as one compressed text."""
    plain = "\n".join(words).encode()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unpacked(words: bytes) -> list[str]:
    return pa.decompress(words[8:], decompressed_size=int.from_bytes(words[:8], "little"), codec="zstd", asbytes=True).decode().split("\n")


def shrink(numbers: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = pa.decompress(packed[8:], decompressed_size=4 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, n).T).view("<u4").ravel()


def word_blocks(docs: DataFrame, text_col: str, keep: list[str], buckets: int) -> DataFrame:
    """Blocks of documents with numbered words, written before they are returned.

    The numbers stand in a file for each task, at ``size`` bytes from ``start`` on in ``path``.
    """
    folder = new_path(docs.sparkSession, "word-codes")
    kept = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    row = kept.schema["row"].dataType.simpleString()
    fields = f"block long, rows array<{row}>, lengths array<int>, n_words long, path string, start long, size long, words array<struct<bucket:int,words:binary,places:binary>>"

    @released
    def split(batches):
        block, schema, file = _Block(), None, None
        with ExitStack() as opened:
            for batch in batches:
                if schema is None:
                    word = pa.struct([("bucket", pa.int32()), ("words", pa.binary()), ("places", pa.binary())])
                    schema = pa.schema(
                        [("block", pa.int64()), ("rows", pa.list_(batch.schema.field("row").type)), ("lengths", pa.list_(pa.int32())), ("n_words", pa.int64()), ("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("words", pa.list_(word))]
                    )
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                    block.add(row, text.as_py())
                    if block.chars >= BLOCK_CHARS:
                        file = file or opened.enter_context(new_file(folder, ".codes"))
                        yield block.batch(schema, buckets, *file)
                        block = _Block()
            if block.rows:
                file = file or opened.enter_context(new_file(folder, ".codes"))
                yield block.batch(schema, buckets, *file)

    return materialize(kept.mapInArrow(split, fields), "word-blocks")


def encode_words(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """Columns block, lengths, ids (packed, for the words of one bucket of a block), distinct: each distinct word is encoded once."""
    rows = blocks.select("block", F.explode("words").alias("w")).select(F.col("w.bucket").alias("bucket"), "block", F.col("w.words").alias("words"), F.col("w.places").alias("places"))

    @released
    def encode(batches):
        tool, table, at = _tokenizer(tokenizer), {}, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != at:
                    at, table = row["bucket"], {}
                words = unpacked(row["words"])
                new = [w for w in words if w not in table]
                table.update(zip(new, (array("I", x.ids) for x in tool.encode_batch_fast(new, add_special_tokens=False))))
                ids = [table[w] for w in words]
                flat = np.frombuffer(b"".join(ids), "<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()),
                        pa.array([row["places"]], pa.binary()),
                        pa.array([shrink(np.array([len(x) for x in ids], "<u4"))], pa.binary()),
                        pa.array([shrink(flat)], pa.binary()),
                        pa.array([np.unique(flat).astype(np.int32)], pa.list_(pa.int32())),
                    ],
                    ["block", "places", "lengths", "ids", "used"],
                )

    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return materialize(sorted_rows.mapInArrow(encode, "block long, places binary, lengths binary, ids binary, used array<int>"), "word-ids")


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = load_tokenizer(path)
    return _TOKENIZERS[path]


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """Columns id, piece: the vocabulary, which has a fixed size."""
    vocabulary = load_tokenizer(tokenizer).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(vocabulary.keys(), pa.string())}))


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The columns ``keep`` (all, if not given) of ``docs`` with the ids and the decoded text.

    Adds ``__n_tokens``, ``__ids`` (array<int>) and ``__decoded``, or, with
    ``digests``, the SHA-256 of the ids as little-endian 32-bit integers and of
    the decoded text in UTF-8 as ``__ids_sha256`` and ``__decoded_sha256``. The
    tokenizer has no decoder of its own, so pieces are joined by one space, and
    no special tokens are added or skipped.

    A NULL or empty text has no tokens and decodes to the empty string. Repeated
    rows and columns of any name pass unchanged.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    blocks = word_blocks(docs, text_col, keep, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = encode_words(blocks, tokenizer)
    by_block = words.groupBy("block").agg(F.collect_list(F.struct("places", "lengths", "ids")).alias("tables"))
    used = words.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"))
    pieces = used.select("block", F.explode("used").alias("id")).join(F.broadcast(piece_table(spark, tokenizer)), "id")
    pieces = pieces.groupBy("block").agg(F.collect_list("id").alias("piece_ids"), F.collect_list("piece").alias("pieces"))
    joined = blocks.drop("words").join(by_block, "block", "left").join(pieces, "block", "left")
    kept = docs.select(F.struct(*keep).alias("row")).schema["row"].dataType.simpleString()
    results = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    @released
    def assemble(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _assembled(batch.slice(i, 1), digests)

    out = joined.mapInArrow(assemble, f"row {kept}, n_tokens long, {results}")
    names = [r.split()[0] for r in results.split(", ")]
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("n_tokens").alias("__n_tokens"), *[F.col(n).alias(f"__{n}") for n in names])


def _assembled(block: pa.RecordBatch, digests: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a block from its word numbers, the ids of its words and the pieces of its ids."""
    get = lambda name: block.column(name)[0].as_py()
    with open_file(get("path")) as file:
        file.seek(get("start"))
        codes = expand(file.read(get("size")))
    n_words = get("n_words")
    tables = [(np.cumsum(expand(t["places"]), dtype=np.uint32), expand(t["lengths"]), expand(t["ids"])) for t in get("tables") or []]
    place, size, flat = (np.concatenate([t[k] for t in tables]) if tables else np.zeros(0, "<u4") for k in range(3))
    starts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    piece = dict(zip(get("piece_ids") or [], get("pieces") or []))
    spelled = list(map(piece.__getitem__, flat.tolist()))
    first, length = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    first[place], length[place] = starts[:-1], size
    text_of: list[str] = [""] * n_words
    for p, a, b in zip(place.tolist(), starts[:-1].tolist(), starts[1:].tolist()):
        text_of[p] = " ".join(spelled[a:b])
    rows, at, size_now, out = block.column("rows").flatten(), 0, 0, []
    for n in get("lengths"):
        own = codes[at:at + n]
        at += n
        lengths = length[own]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if n else 0
        where = np.arange(total) + np.repeat(first[own] - (ends - lengths), lengths)
        ids = flat[where]
        own_text = [t for t in map(text_of.__getitem__, own.tolist()) if t]
        decoded = " ".join(own_text)
        if digests:
            out.append((total, hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        else:
            out.append((total, ids.astype(np.int32), decoded))
            size_now += 4 * total + len(decoded)
        if len(out) == 500 or size_now > BATCH_BYTES:
            yield _documents(rows[:len(out)], out, digests)
            rows, out, size_now = rows[len(out):], [], 0
    if out:
        yield _documents(rows, out, digests)


def _documents(rows: pa.Array, found: list, digests: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string())
    names = ["row", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    return pa.RecordBatch.from_arrays([rows, *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names)
