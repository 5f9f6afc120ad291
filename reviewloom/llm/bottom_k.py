"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct hashes of a document's word shingles.
Sketches of parts merge into the sketch of the whole: the k smallest hashes of
their union. From sketches alone follow estimates of resemblance (share of
common hashes among the k smallest of the union), of containment, and of the
number of distinct shingles (from the k-th smallest hash).

A fingerprint is the sketch in base64, eight bytes for each hash, so equal
texts have equal fingerprints, and fingerprints can be stored and merged.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.shingles import shingle_hashes, word_hashes

WORDS = 5
SIZE = 128
LOWEST = -(1 << 63)


def sketch(text: bytes, size: int = SIZE, words: int = WORDS) -> np.ndarray:
    """The smallest hashes of the shingles, ascending; texts of fewer words are one shingle, none has an empty sketch."""
    return shingle_hashes(word_hashes(text), words)[:size]


def merge(one: np.ndarray, other: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.union1d(one, other)[:size]


def resemblance(one: np.ndarray, other: np.ndarray, size: int = SIZE) -> float:
    """Estimate of |both| / |either|; two empty sketches are alike."""
    if not len(one) and not len(other):
        return 1.0
    lowest = merge(one, other, size)
    common = np.intersect1d(one, other, assume_unique=True)
    return float(np.isin(lowest, common, assume_unique=True).sum() / len(lowest))


def distinct(one: np.ndarray, size: int = SIZE) -> float:
    """Estimate of the number of distinct shingles, exact below ``size``."""
    return float(len(one)) if len(one) < size else (size - 1) * 2.0**64 / (float(one[size - 1]) + 1)


def containment(one: np.ndarray, other: np.ndarray, size: int = SIZE) -> float:
    """Estimate of the share of the first document's shingles that the second has too; 1 for an empty first."""
    if not len(one):
        return 1.0
    both = resemblance(one, other, size) * distinct(merge(one, other, size), size)
    return min(1.0, both / distinct(one, size))


def to_text(one: np.ndarray) -> str:
    return base64.b64encode(one.astype("<u8").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = SIZE, words: int = WORDS) -> DataFrame:
    """``docs`` with ``__fingerprint``, without a shuffle. A NULL text counts as empty; other columns pass unchanged."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("binary").alias("text"))
    kept = row.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [to_text(sketch(t.as_buffer().to_pybytes() if t.is_valid else b"", size, words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.string())], ["row", "found"])

    out = row.mapInArrow(run, f"row {kept}, found string")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("found").alias("__fingerprint"))


def merged_fingerprints(parts: DataFrame, by: str, fingerprint: str = "__fingerprint", size: int = SIZE) -> DataFrame:
    """Columns by, fingerprint: the sketches of a group's parts merged.

    Tasks merge what they hold before the shuffle, so a group of any size moves
    one sketch for each task. Groups with NULL keys are one group.
    """
    rows = parts.select(F.col(by).alias("by"), F.col(fingerprint).alias("fingerprint"))
    key = rows.schema["by"].dataType.simpleString()

    def fold(batches):
        held: dict = {}
        for batch in batches:
            for by_value, text in zip(batch.column("by").to_pylist(), batch.column("fingerprint").to_pylist()):
                new = from_text(text or "")
                held[by_value] = merge(held[by_value], new, size) if by_value in held else new[:size]
            if len(held) > 10_000:
                yield _rows(held, batch.schema)
                held = {}
        if held:
            yield _rows(held, batch.schema)

    partial = rows.mapInArrow(fold, f"by {key}, fingerprint string")
    whole = partial.repartition("by").sortWithinPartitions("by").mapInArrow(fold, f"by {key}, fingerprint string")
    return whole.select(F.col("by").alias(by), F.col("fingerprint").alias(fingerprint))


def _rows(held: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), schema.field("by").type), pa.array([to_text(x) for x in held.values()], pa.string())], ["by", "fingerprint"])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Columns part, id, text, ghost: documents in runs of descending ids, each run followed by the next document as a ghost.

    Cut points of the ids (a fixed number, from a sketch of the id column) deal
    the texts to runs, which are sorted in their tasks. Only the largest
    document of each run goes to a second run, so texts are shuffled once. The
    run of the smallest ids is followed by the largest document of all.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = rows.select("id")
    cuts = sorted({int(c) for c in ids.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (4 * parts))}) if parts > 1 else []

    @F.pandas_udf("long")
    def part_of(values):
        return values.__class__(np.searchsorted(cuts, values, "right"))

    heads = sorted((r["part"], r["head"]) for r in ids.select(part_of("id").alias("part"), "id").groupBy("part").agg(F.max("id").alias("head")).collect())
    follows = {heads[i][1]: heads[(i + 1) % len(heads)][0] for i in range(len(heads))}

    @F.pandas_udf("array<struct<part:bigint,ghost:boolean>>")
    def places(values):
        own = np.searchsorted(cuts, values, "right")
        return values.__class__([[(int(p), False)] + ([(follows[v], True)] if v in follows else []) for p, v in zip(own, values)])

    dealt = rows.withColumn("place", F.explode(places("id"))).select("place.part", "place.ghost", "id", "text")
    # By ranges of the run numbers: a hash would put several runs into some tasks and none into others.
    return dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "ghost", F.desc("id"), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, words: int = WORDS) -> DataFrame:
    """Fingerprint each text and the text whose last half is replaced by the first half of the next document.

    The next document has the next smaller id; after the smallest comes the
    largest. Returns id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and contained (the estimated
    share of a text's shingles that the edited text keeps) and n_shingles.

    A NULL text is empty; empty texts are alike. A missing id is the smallest.
    Equal ids follow each other in the order of their texts; a lone document is
    its own next one.
    """
    fields = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained double, n_shingles double"
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4]

    def compare(batches):
        held = None  # a document that waits for the next one: part, id, text, sketch
        for batch in batches:
            out = []
            for part, ghost, number, text in zip(batch.column("part").to_pylist(), batch.column("ghost").to_pylist(), batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py()
                own = sketch(text.encode(), size, words)
                if held is not None and held[0] == part:
                    out.append(_compared(*held[1:], text, own, size, words))
                held = None if ghost else (part, number, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    out = with_next(docs, id_col, text_col).mapInArrow(compare, fields)
    return out.select(F.when(F.col("id") != LOWEST, F.col("id")).alias(id_col), *names[1:])


def _compared(number: int, text: str, own: np.ndarray, following: str, next_sketch: np.ndarray, size: int, words: int) -> tuple:
    half = len(text) // 2
    edited = (text[:len(text) - half] + following[:half]).encode()
    changed = sketch(edited, size, words)
    return (
        number,
        len(text),
        hashlib.sha256(edited).hexdigest(),
        to_text(own),
        to_text(changed),
        resemblance(own, changed, size),
        resemblance(own, next_sketch, size),
        containment(own, changed, size),
        distinct(own, size),
    )
