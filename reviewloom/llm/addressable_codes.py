"""Token ids as directly addressable codes.

An id is split into chunks of eight bits. The lowest chunk of every id is in
level 0, the next chunk of those ids that have one in level 1, and so on; a
bitmap for each level says which ids continue. A rank directory counts the
continuing ids before each block of 512 bits, so the chunks of any id are found
with one lookup for each level and nothing before it is decoded.

A file is a row of segments of bounded size, a document index and a footer:

    magic | segments | documents: id, start, count (int64 each) | segment table (int64) | lengths (4 x int64) | magic

and a segment has for each level: chunks | bitmap | directory. Documents are in
ascending order of their ids within a file, and files follow each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.chunk_cache import PieceEncoder
from reviewloom.llm.files import new_file, open_file
from reviewloom.sources.shared import materialize, new_path

MAGIC = b"DACIDS01"
LEVELS = 4
BLOCK_BITS = 512
SEGMENT_IDS = 1 << 21
READ_IDS = 1 << 20
DOCS_PER_TASK = 20_000
NO_ID = -(1 << 63)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint16)


def pack(ids: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Parts of a segment (chunks, bitmap, directory of each level) and the number of chunks in each level."""
    parts, counts, rest = [], [], ids.astype("<u4")
    for _ in range(LEVELS):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        blocks = _ONES[bits].reshape(-1, BLOCK_BITS // 8).sum(1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        parts += [rest.astype(np.uint8).tobytes(), bits.tobytes(), directory.tobytes()]
        counts.append(len(rest))
        rest = rest[more] >> 8
    return parts, counts


class Writer:
    """Appends documents to an open file."""

    def __init__(self, stream):
        self.stream, self.at = stream, len(MAGIC)
        self.docs: list[tuple[int, int, int]] = []
        self.table: list[list[int]] = []
        self.total, self.flushed, self.held = 0, 0, []
        stream.write(MAGIC)

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append((doc, self.total, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        if self.total - self.flushed >= SEGMENT_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        while len(ids) >= SEGMENT_IDS or last and len(ids):
            self._segment(ids[:SEGMENT_IDS])
            ids = ids[SEGMENT_IDS:]
        self.held = [ids]

    def _segment(self, ids: np.ndarray) -> None:
        parts, counts = pack(ids)
        row = [self.flushed, len(ids), *counts]
        for part in parts:
            row.append(self.at)
            self.stream.write(part)
            self.at += len(part)
        self.table.append(row)
        self.flushed += len(ids)

    def close(self) -> None:
        self._flush(True)
        docs = np.array(self.docs, "<i8").reshape(-1, 3)
        table = np.array(self.table, "<i8").reshape(-1, 2 + 4 * LEVELS)
        for part in (docs, table, np.array([self.at, len(docs), len(table), self.total], "<i8")):
            self.stream.write(part.tobytes())
        self.stream.write(MAGIC)


class Reader:
    """Random access to the ids of a file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(32 + len(MAGIC), size - 32 - len(MAGIC))
        if tail[32:] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at, self.n_docs, n_table, self.total = (int(x) for x in np.frombuffer(tail[:32], "<i8"))
        self.docs_at = at
        width = 2 + 4 * LEVELS
        self.table = np.frombuffer(file.read_at(n_table * width * 8, at + self.n_docs * 24), "<i8").reshape(-1, width)

    def docs(self, first: int, after: int) -> np.ndarray:
        """Rows (id, start, count) of some documents."""
        return np.frombuffer(self.file.read_at((after - first) * 24, self.docs_at + first * 24), "<i8").reshape(-1, 3)

    def _rank(self, row: np.ndarray, level: int, position: int) -> int:
        """Continuing ids before a position of a level."""
        at = row[2 + LEVELS + 3 * level:]
        block = position // BLOCK_BITS
        before = int(np.frombuffer(self.file.read_at(4, int(at[2]) + 4 * block), "<u4")[0])
        within = position - block * BLOCK_BITS
        if not within:
            return before
        bits = np.frombuffer(self.file.read_at((within + 7) // 8, int(at[1]) + block * BLOCK_BITS // 8), np.uint8)
        return before + int(np.unpackbits(bits, count=within, bitorder="little").sum())

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids from ``start`` on; only their own chunks are read."""
        out = []
        for row in self.table[max(0, int(np.searchsorted(self.table[:, 0], start, "right")) - 1):]:
            first = max(start - int(row[0]), 0)
            after = min(start + count - int(row[0]), int(row[1]))
            if after <= 0:
                break
            if first < after:
                out.append(self._level(row, 0, first, after - first))
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def _level(self, row: np.ndarray, level: int, first: int, count: int) -> np.ndarray:
        at = row[2 + LEVELS + 3 * level:]
        low = np.frombuffer(self.file.read_at(count, int(at[0]) + first), np.uint8).astype("<u4")
        skip = first % 8
        bits = np.frombuffer(self.file.read_at((skip + count + 7) // 8, int(at[1]) + first // 8), np.uint8)
        more = np.unpackbits(bits, bitorder="little")[skip:skip + count].astype(bool)
        high = int(more.sum())
        if high:
            low[more] |= self._level(row, level + 1, self._rank(row, level, first), high) << 8
        return low


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Encode texts and write their ids in ascending order of document ids; one row for each file.

    Columns ``path, first_doc, n_docs, n_ids, start`` (ids in all files before).
    The table of files is written before it is returned. Every document ends
    with ``end_id``; a NULL text is empty. A missing id counts as the smallest;
    rows with equal ids follow each other in the order of their texts. No rows:
    no files.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-ids")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc").sortWithinPartitions("doc", "text")
    schema = pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches):
        encoder = PieceEncoder.of(tokenizer)
        end = np.array([end_id], "<u4")
        stack = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if stack is None:
                stack = new_file(folder, ".dac")
                path, stream = stack.__enter__()
                writer = Writer(stream)
            numbers = batch.column("doc").to_numpy()
            texts = (t.as_py() for t in batch.column("text"))
            for number, ids in zip(numbers, encoder.encode(texts)):
                writer.add(int(number), np.concatenate([ids, end]))
        if stack is not None:
            writer.close()
            stack.__exit__(None, None, None)
            yield pa.RecordBatch.from_pylist([{"path": path, "first_doc": writer.docs[0][0], "n_docs": len(writer.docs), "n_ids": writer.total}], schema)

    files = materialize(rows.mapInArrow(write, "path string, first_doc long, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("first_doc").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_documents(files: DataFrame, docs_per_task: int = DOCS_PER_TASK) -> DataFrame:
    """Columns ``doc_id, start, n_tokens, ids``: every document of the files."""
    as_lists = lambda offsets, ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
    return _documents(files, docs_per_task, "ids array<int>", as_lists)


def read_checksums(files: DataFrame, docs_per_task: int = DOCS_PER_TASK) -> DataFrame:
    """As ``read_documents``, with ``ids_crc32`` (of the ids as little-endian 32-bit integers) in place of the ids."""

    def sums(offsets, ids):
        plain = ids.astype("<u4")
        return pa.array([zlib.crc32(plain[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64())

    return _documents(files, docs_per_task, "ids_crc32 long", sums)


def _documents(files: DataFrame, docs_per_task: int, field: str, column) -> DataFrame:
    """Every document with ``column(offsets, ids)``; a task reads one range of a file."""
    ranges = files.select(
        "path", "start", "n_docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(docs_per_task).cast("long"))).alias("first")
    )

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    reader = Reader(file)
                    after = min(row["first"] + docs_per_task, row["n_docs"])
                    for docs in _bounded(reader.docs(row["first"], after)):
                        base = int(docs[0, 1])
                        ids = reader.ids(base, int(docs[-1, 1] + docs[-1, 2]) - base)
                        offsets = np.concatenate([docs[:, 1] - base, [len(ids)]]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(docs[:, 0], pa.int64(), mask=docs[:, 0] == NO_ID),
                                pa.array(docs[:, 1] + row["start"], pa.int64()),
                                pa.array(docs[:, 2], pa.int64()),
                                column(offsets, ids),
                            ],
                            ["doc_id", "start", "n_tokens", field.split()[0]],
                        )

    n_ranges = ranges.agg(F.count(F.lit(1))).first()[0]  # a number of its own, which adaptive execution keeps
    return ranges.repartition(max(1, n_ranges), "path", "first").mapInArrow(read, f"doc_id long, start long, n_tokens long, {field}")


def _bounded(docs: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of documents that together have a bounded number of ids, one document at least."""
    first = 0
    while first < len(docs):
        after = int(np.searchsorted(docs[:, 1] + docs[:, 2], docs[first, 1] + READ_IDS, "right"))
        after = max(after, first + 1)
        yield docs[first:after]
        first = after
