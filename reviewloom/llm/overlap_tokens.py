"""Token counts, with huge documents encoded in overlapping chunks.

A huge document is cut into chunks that overlap, which many tasks encode with
offsets. Two neighbours are spliced at a boundary that both have and that is
proven stable: a single space between two characters that are no white space.
The pre-tokenizer always breaks there, and its breaks after it depend on later
text only, so from there on a chunk has the tokens of the whole text wherever
it began. Where an overlap holds no common stable boundary, the document is
encoded again with chunks and overlaps four times as long; in the end one chunk is
the whole text. A round costs little more than the text once, however rare
boundaries are, and the number of rounds is the logarithm of the length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.chunk_cache import PieceEncoder
from reviewloom.sources.shared import materialize

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024


def chunk_starts(n_chars: int, chunk: int, overlap: int) -> range:
    """Where chunks start; the last one reaches the end of the text."""
    return range(0, max(1, n_chars - overlap), chunk)


def stable_boundaries(text: str, offsets: list[tuple[int, int]], first: int, after: int) -> list[tuple[int, int]]:
    """(position, tokens before it) for the stable boundaries of a chunk within a range.

    A boundary counts only if the offsets show a token that ends there and one
    that starts there, with the space.
    """
    ends = np.array([e for _, e in offsets], np.int64)
    starts = np.array([s for s, _ in offsets], np.int64)
    found, at = [], text.find(" ", max(first, 1), after)
    while 0 <= at < len(text) - 1:
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            before = int(np.searchsorted(ends, at, "right"))
            if 0 < before < len(starts) and ends[before - 1] == at and starts[before] == at:
                found.append((at, before))
        at = text.find(" ", at + 1, after)
    return found


def _chunks(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Columns tag, no, base, last, chunk; equal texts give equal rows, which are kept once."""

    def cut(batches):
        for batch in batches:
            for tag, text in zip(batch.column("tag").to_pylist(), batch.column("text")):
                text = text.as_py()
                starts = chunk_starts(len(text), chunk, overlap)
                for no, base in enumerate(starts):
                    last = no == len(starts) - 1
                    piece = text[base:] if last else text[base:base + chunk + overlap]
                    yield pa.RecordBatch.from_pylist([{"tag": tag, "no": no, "base": base, "last": last, "chunk": piece}])

    rows = long_docs.mapInArrow(cut, "tag string, no long, base long, last boolean, chunk string")
    return rows.dropDuplicates(["tag", "no"])


def _spliced(chunks: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """Columns tag, n_tokens: NULL where two neighbours have no common boundary."""
    bounds = "array<struct<at:bigint,before:bigint>>"
    kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))

    def encode(batches):
        encoder = PieceEncoder.of(tokenizer).tokenizer
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, base = row["chunk"], row["base"]
                found = encoder.encode(text, add_special_tokens=False)
                offsets = found.offsets
                head = stable_boundaries(text, offsets, 0, overlap) if row["no"] else []
                tail = [] if row["last"] else stable_boundaries(text, offsets, chunk, chunk + overlap)
                rows.append((row["tag"], row["no"], row["last"], len(offsets), *([{"at": base + a, "before": b} for a, b in x] for x in (head, tail))))
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), kind, kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["tag", "no", "last", "total", "head", "tail"])

    parts = chunks.mapInArrow(encode, f"tag string, no long, last boolean, total long, head {bounds}, tail {bounds}")
    order = Window.partitionBy("tag").orderBy("no")  # the chunks of one text
    following = parts.withColumn("next", F.lead("head").over(order))
    at = F.array_min(F.array_intersect(F.col("tail.at"), F.col("next.at")))
    joint = following.withColumn("at", at)

    def before(side: str):
        return F.filter(F.col(side), lambda b: b["at"] == F.col("at"))[0]["before"]

    cut = joint.select(
        "tag",
        "last",
        F.when(F.col("last"), F.col("total")).when(F.col("at").isNotNull(), before("tail")).alias("stop"),
        F.when(F.col("last"), F.lit(0)).when(F.col("at").isNotNull(), before("next")).alias("skip"),
    )
    failed = F.max(F.col("stop").isNull())
    return cut.groupBy("tag").agg(F.when(~failed, F.sum(F.col("stop") - F.col("skip"))).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """The columns ``keep`` (all, if not given) of ``docs`` with ``__n_bytes`` and ``__n_tokens``.

    Texts of up to ``chunk`` code points are counted where they are read; only
    chunks of longer ones are shuffled, equal ones once. A NULL or empty text
    has no bytes and no tokens; repeated rows and other columns pass unchanged.
    """
    keep = docs.columns if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("keep"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    small, large = rows.where(F.char_length("text") <= chunk), rows.where(F.char_length("text") > chunk)
    kept = rows.schema["keep"].dataType.simpleString()

    def count(batches):
        encoder = PieceEncoder.of(tokenizer)
        for batch in batches:
            counts = [len(ids) for ids in encoder.encode(t.as_py() for t in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("keep"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["keep", "n_bytes", "n_tokens"])

    counted = small.mapInArrow(count, f"keep {kept}, n_bytes long, n_tokens long")
    tagged = large.withColumn("tag", F.sha2(F.col("text").cast("binary"), 256))
    totals = _totals(tagged.select("tag", "text"), tokenizer, chunk, overlap)
    huge = tagged.select("keep", "n_bytes", "tag").join(totals, "tag").select("keep", "n_bytes", "n_tokens")
    return counted.unionByName(huge).select(
        *[F.col("keep")[c].alias(c) for c in keep], F.col("n_bytes").alias("__n_bytes"), F.col("n_tokens").alias("__n_tokens")
    )


def _totals(long_docs: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    done, open_docs = None, long_docs
    while True:
        found = materialize(_spliced(_chunks(open_docs, chunk, overlap), tokenizer, chunk, overlap), "token-counts")
        ended = found.where("n_tokens IS NOT NULL")
        done = ended if done is None else done.unionByName(ended)
        failed = found.where("n_tokens IS NULL").select("tag")
        if failed.isEmpty():
            return done
        open_docs, chunk, overlap = long_docs.join(failed, "tag", "left_semi"), 4 * chunk, 4 * overlap
