"""Phrases whose words keep together, found by Rabin-Karp fingerprints.

Counting: every task numbers its words and takes prefix polynomials of their
hashes, from which the fingerprint of every n-gram is one subtraction and one
product. Fingerprints are counted where they are met and summed in a shuffle.
Lengths are counted in turn: an n-gram is looked at only if the two shorter ones
in it are frequent, which loses none. Which are frequent is told by a bit table
of at most ``FILTER_BYTES`` for a length, that may say yes too often, never no;
more phrases than it can hold cost rows in the shuffle and no result.

Verifying: a task brings the occurrences of a frequent fingerprint together with
a pointer to the first of them and compares the words of every occurrence
with those at the pointer, so that phrases that share a fingerprint part. Only
then a phrase is cut out of the text, once for a pointer, and sent with its
number. Final counts are sums over phrases, so that no result rests on a
fingerprint: one can only bring a phrase too many, whose true count then fails
the threshold. Texts of rare phrases never leave a task.

What a group of texts sends is packed, one row for each bucket of fingerprints:
sorted fingerprints as steps, phrases as one text, numbers as byte planes. A task
sums one bucket at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewloom.llm.bit_table import bit_table, told
from reviewloom.llm.memory import released
from reviewloom.llm.shingles import mix
from reviewloom.sources.shared import materialize

LONGEST = 5
GROUP_BYTES = 8 << 20
FILTER_BYTES = 16 << 20
HELD_PRINTS = 4 << 20
TOP_SALTS = 64
#: A byte that no UTF-8 text has ends a piece.
MARK = b"\xff"
_PIECES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + MARK * 10)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts in one language, numbered, with the fingerprints of their n-grams."""

    def __init__(self, lang: str, texts: list[bytes]):
        data = MARK.join(texts).translate(_PIECES).replace(MARK, b" \xff ") + b" \xff"
        self.lang, self.tokens = lang, data.split()
        numbers: dict[bytes, int] = defaultdict(count(1).__next__, {MARK: 0})
        self.ids = np.fromiter(map(numbers.__getitem__, self.tokens), np.int64, len(self.tokens))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))
        ends = np.flatnonzero(self.ids == 0)
        n = len(self.ids)
        #: Words from each place to the end of its piece.
        self.room = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes[self.ids] * _powers(_BASE, n), out=self.prefix[1:])
        self.back = _powers(_INVERSE, n)
        self.seed = xxhash.xxh3_64_intdigest(lang)

    def fingerprints(self, size: int, places: np.ndarray) -> np.ndarray:
        """Of the n-grams at ``places``; language and length are part of them."""
        plain = (self.prefix[places + size] - self.prefix[places]) * self.back[places]
        return mix(plain + np.uint64((self.seed + size * 0xD6E8FEB86659FD93) % 2**64))

    def places(self, size: int, tables: list[np.ndarray | None]) -> np.ndarray:
        """Where n-grams start whose two shorter ones may be frequent, by the bit tables of each length."""
        at = np.flatnonzero(self.room >= size)
        if size > 1:
            shorter = np.flatnonzero(self.room >= size - 1)
            frequent = np.zeros(len(self.ids) + 1, bool)
            frequent[shorter] = told(tables[size - 1], self.fingerprints(size - 1, shorter))
            at = at[frequent[at] & frequent[at + 1]]
        return at

    def phrases(self, size: int, places: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], list[int]]]:
        """Sorted fingerprints with their phrases and numbers; words are compared, fingerprints only bring them together.

        Phrases that share a fingerprint come in turns, one of them in each.
        """
        while len(places):
            found, pointer, owner = np.unique(prints, return_index=True, return_inverse=True)
            pointer = places[pointer]
            equal = np.ones(len(places), bool)
            for j in range(size):
                equal &= self.ids[places + j] == self.ids[pointer[owner] + j]
            texts = [b" ".join(self.tokens[at:at + size]) for at in pointer.tolist()]
            yield found, texts, np.bincount(owner[equal], minlength=len(pointer)).tolist()
            places, prints = places[~equal], prints[~equal]


def _groups(batches) -> Iterator[Words]:
    """Words of up to ``GROUP_BYTES`` of texts of one language, or of one longer text."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if not text.is_valid:
                continue
            plain = text.as_buffer().to_pybytes()
            if size and size + len(plain) > GROUP_BYTES:
                yield from (Words(*one) for one in held.items())
                held, size = {}, 0
            held.setdefault(lang, []).append(plain)
            size += len(plain)
    yield from (Words(*one) for one in held.items())


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes; sorted ones are given as steps and become small."""
    planes = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def _slices(prints: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of sorted fingerprints, dealt to buckets by their high bits."""
    own = ((prints >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if len(own) else [0]
    for start, end in zip(starts[:-1], starts[1:]):
        yield int(own[start]), int(start), int(end)


def _summed(prints: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, count = np.concatenate(prints), np.concatenate(numbers)
    order = np.argsort(every)
    every, count = every[order], count[order]
    first = np.concatenate([[0], np.flatnonzero(every[1:] != every[:-1]) + 1]) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(count, first) if len(first) else count


def _counted(rows: DataFrame, size: int, known, least: int, buckets: int) -> DataFrame:
    """Fingerprints (``print``) of n-grams of ``size`` words that are met at least ``least`` times, written.

    A group of texts sends its distinct fingerprints and their numbers packed,
    one row for a bucket; a task sums the buckets it gets, one after another.
    """

    @released
    def counts(batches):
        for words in _groups(batches):
            prints, numbers = np.unique(words.fingerprints(size, words.places(size, known.value)), return_counts=True)
            cut = list(_slices(prints, buckets))
            columns = [
                pa.array([b for b, _, _ in cut], pa.int32()),
                pa.array([y - x for _, x, y in cut], pa.int64()),
                pa.array([_packed(np.diff(prints[x:y], prepend=np.uint64(0))) for _, x, y in cut], pa.binary()),
                pa.array([_packed(numbers[x:y]) for _, x, y in cut], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "size", "steps", "numbers"])

    @released
    def sums(batches):
        held, at = ([], []), None

        def frequent():
            prints, numbers = _summed(*held)
            return pa.RecordBatch.from_arrays([pa.array(prints[numbers >= least].view(np.int64))], ["print"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != at and at is not None:
                    yield frequent()
                    held = ([], [])
                at = row["bucket"]
                held[0].append(np.cumsum(_unpacked(row["steps"], row["size"]), dtype=np.uint64))
                held[1].append(_unpacked(row["numbers"], row["size"]))
                if sum(map(len, held[0][1:])) > HELD_PRINTS:
                    held = tuple([x] for x in _summed(*held))
        if at is not None:
            yield frequent()

    met = rows.mapInArrow(counts, "bucket int, size long, steps binary, numbers binary")
    dealt = met.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(sums, "print long"), "fingerprints")


def frequent_phrases(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = LONGEST) -> DataFrame:
    """Columns lang, size, phrase, n: all phrases of up to ``longest`` words met at least ``least`` times, written.

    A row of size 0 has the number of all words of a language. Words keep A-Z
    lower-cased; phrases join them by one space and stay within a piece (texts
    are cut at ``[.,;:!?\x0A-\x0D]``, pieces into words ``[^\x20\x09]+``).
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables: list = [None] * (longest + 1)
    for size in range(1, longest + 1):
        known = spark.sparkContext.broadcast(tables)
        tables[size] = bit_table(_counted(rows, size, known, least, buckets), FILTER_BYTES)
        known.destroy()
    known = spark.sparkContext.broadcast(tables)

    @released
    def phrases(batches):
        for words in _groups(batches):
            # The number of all words goes with an empty phrase.
            out = [(int((words.seed >> 32) * buckets >> 32), words.lang, [b""], [np.count_nonzero(words.ids)])]
            for size in range(1, longest + 1):
                places = words.places(size, known.value)
                prints = words.fingerprints(size, places)
                hit = told(known.value[size], prints)
                for found, texts, numbers in words.phrases(size, places[hit], prints[hit]):
                    out += [(b, words.lang, texts[x:y], numbers[x:y]) for b, x, y in _slices(found, buckets)]
            columns = [
                pa.array([b for b, *_ in out], pa.int32()),
                pa.array([lang for _, lang, *_ in out], pa.string()),
                pa.array([pa.compress(b"\n".join(texts), codec="zstd", asbytes=True) for _, _, texts, _ in out], pa.binary()),
                pa.array([sum(map(len, texts)) + len(texts) - 1 for _, _, texts, _ in out], pa.int64()),
                pa.array([_packed(np.array(numbers)) for *_, numbers in out], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "lang", "phrases", "bytes", "numbers"])

    @released
    def sums(batches):
        held, at = {}, None

        def frequent():
            kept = [(*key, n) for key, n in held.items() if n >= least or not key[1]]
            langs, texts, numbers = zip(*kept) if kept else ((), (), ())
            sizes = [t.count(b" ") + 1 if t else 0 for t in texts]
            columns = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.binary()), pa.array(numbers, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "n"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != at and at is not None:
                    yield frequent()
                    held = {}
                at, lang = row["bucket"], row["lang"]
                texts = pa.decompress(row["phrases"], decompressed_size=row["bytes"], codec="zstd", asbytes=True).split(b"\n")
                for text, n in zip(texts, _unpacked(row["numbers"], len(texts)).tolist()):
                    held[lang, text] = held.get((lang, text), 0) + n
        if at is not None:
            yield frequent()

    met = rows.mapInArrow(phrases, "bucket int, lang string, phrases binary, bytes long, numbers binary")
    dealt = met.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    summed = dealt.mapInArrow(sums, "lang string, size int, phrase binary, n long")
    return materialize(summed.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def collocations(
    spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000, longest: int = LONGEST
) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    A candidate has 2 to ``longest`` words and a >= ``least`` occurrences,
    overlapping ones included. Cut after k words into parts met l and r times it
    scores floor(1000 a n / (l r)), n being all words of the language; its lowest
    cut counts, of equal ones the first. Candidates within a longer one that is
    met as often go. Order: score and a descending, phrase by its bytes.

    NULL and empty texts have no words; a NULL language is ``und``. Repeated
    rows count as often as they are; ids are not read. Without candidates the
    result is empty. Ties end at the phrase, which is unique in a language.
    """
    phrases = frequent_phrases(spark, docs, text_col, lang_col, least, longest)
    totals = materialize(phrases.where("size = 0").select("lang", F.col("n").alias("total")), "totals")
    found = phrases.where("size > 0")
    words = F.split("phrase", " ")
    # One more word at either end is enough: what a longer phrase has as often, those between have as often too.
    inner = found.where("size > 2").select("lang", F.col("n").alias("a"), F.explode(F.array(F.expr("slice(split(phrase, ' '), 1, size - 1)"), F.expr("slice(split(phrase, ' '), 2, size - 1)"))).alias("part"))
    inner = inner.select("lang", "a", F.array_join("part", " ").alias("phrase")).distinct()
    left = found.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a")).join(inner, ["lang", "phrase", "a"], "left_anti")
    cut = left.select("lang", "phrase", "a", "size", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
    )
    part = lambda name, n: found.where(F.col("size") < longest).select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = materialize(cut, "cuts").join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(15,0)) * cast(total as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cut.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each salt, then the first of those: no task holds all phrases of a language.
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
