"""Benchmark decontamination by a Wu-Manber search over words.

The symbols are words, the patterns are windows of ten words of the test
strings. A table of shifts over blocks of two words says how far the search
may jump: a block that is in no pattern lets it skip almost a whole window.
Where the shift is zero, the block selects a bucket of windows, and a direct
comparison confirms an occurrence.

The windows of one block of test strings are broadcast, after their size has
been checked; more test strings than fit are searched for in several passes,
each over all documents. Documents are scanned in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.memory import released
from reviewloom.sources.shared import materialize

#: Bytes of words, [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z.
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256)
)
SEGMENT_BYTES = 4 << 20
PART_WORDS = 4096
PASS_BYTES = 32 << 20



def word_segments(text: bytes, size: int = SEGMENT_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    plain = text.translate(_TO_WORDS)
    start, end = 0, len(plain)
    while start < end:
        stop = start + size
        if stop < end:
            cut = plain.find(b" ", stop)
            stop = end if cut < 0 else cut
        yield plain[start:stop].split()
        start = stop


class WuManber:
    """Search for windows that all have the same number of words."""

    def __init__(self, windows: dict[tuple[bytes, ...], object], length: int, block: int = 2):
        self.length = length
        self.block = min(block, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], object]] = {}
        for window, owner in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.bucket.setdefault(window[length - self.block:], {})[window] = owner

    def search(self, words: list[bytes]) -> Iterator[tuple[int, object]]:
        """First word and owner of each occurrence, in order."""
        shift, far, length, n = self.shift.get, self.far, self.length, len(words)
        end = length
        if self.block == 2:
            while end <= n:
                step = shift((words[end - 2], words[end - 1]), far)
                if step:
                    end += step
                    continue
                yield from self._confirm(words, end)
                end += 1
        else:
            while end <= n:
                step = shift(tuple(words[end - self.block:end]), far)
                if step:
                    end += step
                    continue
                yield from self._confirm(words, end)
                end += 1

    def _confirm(self, words: list[bytes], end: int) -> Iterator[tuple[int, object]]:
        window = tuple(words[end - self.length:end])
        for candidate, owner in self.bucket[window[self.length - self.block:]].items():
            if candidate == window:
                yield end - self.length, owner


class Patterns:
    """The windows of test strings, one search for each length that occurs."""

    def __init__(self, items: list[tuple[str, bytes, bool]], words: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text, _ in items:
            own = text.split()
            size = min(words, len(own))
            for i in range(len(own) - size + 1):
                by_length.setdefault(size, {}).setdefault(tuple(own[i:i + size]), set()).add(item)
        self.searches = [WuManber(w, n) for n, w in sorted(by_length.items()) if n]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged spans of hit words, items found."""
        total, spans, items = 0, [], set()
        tails: list[list[bytes]] = [[] for _ in self.searches]
        for words in word_segments(text):
            for k, search in enumerate(self.searches):
                piece = tails[k] + words if tails[k] else words
                base = total - len(tails[k])
                for at, owner in search.search(piece):
                    spans.append((base + at, base + at + search.length))
                    items |= owner
                tails[k] = piece[len(piece) - search.length + 1:] if search.length > 1 else []
            total += len(words)
        return total, merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _item_parts(benchmark: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Test strings as plain words, long ones in parts that overlap by a window less one word."""

    @released
    def split(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = list(chain.from_iterable(word_segments(text or b"")))
                for i in range(0, max(1, len(own) - words + 1), PART_WORDS):
                    part = own[i:i + PART_WORDS + words - 1]
                    if part:
                        out.append((item, b" ".join(part)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["item", "words"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(split, "item string, words binary").distinct()


def find_test_strings(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 10,
    pass_bytes: int = PASS_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all, if not given) of ``docs`` with ``__n_words``, ``__n_hit``, ``__spans`` (merged spans of hit words) and ``__items`` (item ids, sorted as strings).

    A window is ``words`` consecutive words of a test string; a shorter string
    is one window, one without words none. Ids are compared as strings, a
    missing id is the string ``null``; equal ids are one item. A NULL or empty
    text has no words and no hits. Other columns pass unchanged. An empty
    benchmark finds nothing.
    """
    keep = docs.columns if keep is None else keep
    parts = materialize(_item_parts(benchmark, item_col, item_text_col, words), "test-strings")
    size = parts.agg(F.sum(F.length("words") + F.length("item") + 64)).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    if passes == 1:
        return _scan(docs, text_col, _load(parts), words, keep)
    # Each pass keeps what it has found, which is little; a document is known by the hash of its text.
    tag = F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary")), 256)
    found = None
    for k in range(passes):
        block = parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(passes)) == k)
        hits = _scan(docs.select(tag.alias("__tag"), F.col(text_col)), text_col, _load(block), words, ["__tag"])
        hits = materialize(hits.where("__n_hit > 0").select("__tag", "__spans", "__items").dropDuplicates(["__tag"]), "found")
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("__tag").agg(
        F.flatten(F.collect_list("__spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items")
    )
    # Spans of several passes overlap; folding them in order gives the union.
    span = "array<struct<first:bigint,after:bigint>>"
    union = F.aggregate(
        F.sort_array("spans"),
        F.array().cast(span),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["after"] >= s["first"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["after"], s["after"]).alias("after"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    found = found.select("__tag", union.alias("__spans"), "__items")
    counted = _scan(docs.withColumn("__tag", tag), text_col, [], words, [*keep, "__tag"]).drop("__n_hit", "__spans", "__items")
    hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda acc, s: acc + s["after"] - s["first"])
    return counted.join(found, "__tag", "left").select(
        *keep,
        "__n_words",
        F.coalesce(hit, F.lit(0).cast("long")).alias("__n_hit"),
        F.coalesce("__spans", F.array().cast(span)).alias("__spans"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("__items"),
    )


def _load(parts: DataFrame) -> list[tuple[str, bytes, bool]]:
    """Test strings of one pass; their size was checked before."""
    return [(r["item"], bytes(r["words"]), True) for r in parts.collect()]


def _scan(docs: DataFrame, text_col: str, items: list, words: int, keep: list[str]) -> DataFrame:
    broadcast = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index(text_col)
    span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    @released
    def scan(batches):
        patterns = Patterns(broadcast.value, words)
        for batch in batches:
            found = [patterns.scan((t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in batch.column(at).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([sum(b - a for a, b in f[1]) for f in found], pa.int64()),
                    pa.array([[{"first": a, "after": b} for a, b in f[1]] for f in found], span),
                    pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
                ],
                names=[*keep, "__n_words", "__n_hit", "__spans", "__items"],
            )

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.mapInArrow(scan, f"{fields}, __n_words long, __n_hit long, __spans array<struct<first:bigint,after:bigint>>, __items array<string>")
