"""Periodic runs of words: maximal stretches that repeat their first q words.

Words q apart agree along a run on at least ``grid(q)`` places in a row, so that
one of the places 0, grid(q), 2 grid(q), ... lies among them: the harmonic grid
of q. Over all periods these are about n ln(n) / 2 places for n words. A place is
a candidate if eight words from it, or the eight up to it, have the
fingerprint of those q further on; one of the two always holds in a run. For
documents with candidates a run-length grammar is built, and its extensions
to both sides give the exact ends of each stretch. Without a run nothing is
compared beyond fingerprints, and no fingerprint decides what a run is.

A stretch of at least three periods has one smallest period, which divides all
others that were found for the same ends; of these the smallest is kept.

Nothing is shuffled; a task holds one group of documents with up to
``GROUP_WORDS`` words, or one longer document, and candidates are resolved
``PENDING`` at a time.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.recompression import extension, grammar, mirrored
from reviewloom.llm.shingles import mix

LEAST_LENGTH, LEAST_PERIODS = 24, 3
SEEN = 8
GROUP_WORDS = 1 << 19
GRID_PLACES = 1 << 20
FIRST_PLACES = 1 << 14
PENDING = 1 << 18
DENSE = 1 << 12
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def fingerprints(words: np.ndarray) -> np.ndarray:
    """Of ``SEEN`` words from each place that has so many."""
    n = len(words)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=prefix[1:])
    return (prefix[SEEN:] - prefix[:-SEEN]) * _powers(_INVERSE, n - SEEN + 1)


def grid(periods: np.ndarray) -> np.ndarray:
    """Distance of the grid places of a period: as many neighbouring places agree at least."""
    return np.maximum(LEAST_LENGTH - periods, (LEAST_PERIODS - 1) * periods)


def candidates(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, period) whose fingerprints agree."""
    n = len(words)
    if n < LEAST_LENGTH:
        return
    print_of = fingerprints(words)
    periods = np.arange(1, n // LEAST_PERIODS + 1)
    step = grid(periods)
    places = (n - periods - 1) // step + 1
    after = np.cumsum(places)
    low, last, room = 0, len(print_of) - 1, FIRST_PLACES
    while low < len(periods):
        before = after[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(after, before + room, "right")))
        room = min(GRID_PLACES, 2 * room)
        own = places[low:high]
        first = np.repeat(after[low:high] - own - before, own)
        period = np.repeat(periods[low:high], own)
        place = (np.arange(len(first)) - first) * np.repeat(step[low:high], own)
        ahead, behind = np.minimum(place + period, last), np.maximum(place - SEEN + 1, 0)
        hit = (print_of[np.minimum(place, last)] == print_of[ahead]) & (place + period <= last)
        hit |= (print_of[behind] == print_of[np.minimum(behind + period, last)]) & (place >= SEEN - 1)
        if hit.any():
            yield place[hit], period[hit]
        low = high


class _Group:
    """Candidates of some documents, resolved together by one grammar."""

    def __init__(self, documents: list[np.ndarray]):
        self.documents, self.found = documents, [dict() for _ in documents]
        self.pending, self.size, self.built = [], 0, ((), None, None, None)

    def resolve(self) -> None:
        if not self.pending:
            return
        owners = tuple(sorted({d for d, _, _ in self.pending}))
        if self.built[0] != owners:
            # Every document stands between marks of its own, which end all matches.
            free = 1 + max(int(self.documents[d].max()) for d in owners)
            parts, offsets, at = [], {}, 0
            for mark, d in enumerate(owners):
                parts += [np.array([free + mark]), self.documents[d]]
                offsets[d] = at + 1
                at += 1 + len(self.documents[d])
            parts.append(np.array([free + len(owners)]))
            levels = grammar(np.concatenate(parts), len(owners))
            self.built = (owners, offsets, levels, mirrored(levels))
        _, offsets, levels, back = self.built
        owner = np.concatenate([np.full(len(p), d) for d, p, _ in self.pending])
        offset = np.concatenate([np.full(len(p), offsets[d]) for d, p, _ in self.pending])
        place = np.concatenate([p for _, p, _ in self.pending]) + offset
        period = np.concatenate([q for _, _, q in self.pending])
        self.pending, self.size = [], 0
        last = len(levels[0].symbols) - 1
        for i in range(0, len(place), PENDING):
            own = slice(i, i + PENDING)
            x, q = place[own], period[own]
            end = x + q + extension(levels, x, x + q)
            start = x - extension(back, last - (x - 1), last - (x + q - 1))
            good = end - start >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * q)
            rows = np.unique(np.stack([owner[own][good], (start - offset[own])[good], (end - offset[own])[good], q[good]], axis=1), axis=0)
            for d, s, e, p in rows.tolist():
                self.found[d][s, e] = min(p, self.found[d].get((s, e), p))

    def runs(self) -> list[list[tuple[int, int, int]]]:
        for d, words in enumerate(self.documents):
            for place, period in candidates(words):
                for (start, end), p in self.found[d].items():
                    # Multiples of a period within its run give the same run again.
                    new = (place < start) | (place + period >= end) | (period % p != 0)
                    place, period = place[new], period[new]
                if len(place) >= DENSE and self.pending and self.pending[-1][0] != d:
                    self.resolve()  # so that the grammar of a document with many candidates is its own
                self.pending.append((d, place, period))
                self.size += len(place)
                if self.size >= PENDING or len(place) >= DENSE:
                    self.resolve()
        self.resolve()
        return [sorted((s, e - s, p) for (s, e), p in of.items()) for of in self.found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what a run repeats after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def _groups(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        if group and size + len(words) > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def find_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) and __n_words, __runs (start, length, period; by start, then period), __collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they are written, numbered from 0. A
    run is a stretch whose words q apart are equal, for its smallest q, of at
    least 24 words and three periods, that no neighbouring word extends.
    __collapsed joins by one space the words that no run has after its first
    period.

    A NULL text has no words, no runs and an empty __collapsed, as an empty
    one. Every row has its own result, so repeated rows, NULL ids and ties do
    not matter; an empty table gives an empty result. A column of ``docs`` may
    have any name that does not begin with two underscores.
    """
    kept = docs.columns if keep is None else keep
    rows = docs.select(*kept, F.col(text_col).cast("string").cast("binary").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches):
        for batch in batches:
            done = 0
            for group in _groups(batch.column("__text")):
                numbers: dict[bytes, int] = defaultdict(count().__next__)
                runs = _Group([np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in group]).runs()
                part = batch.slice(done, len(group))
                done += len(group)
                found = [
                    pa.array([len(words) for words in group], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), run)) for run in own] for own in runs], run_type),
                    pa.array([collapsed(words, own) for words, own in zip(group, runs)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], [*kept, "__n_words", "__runs", "__collapsed"])

    run_fields = "__n_words long, __runs array<struct<start: long, length: long, period: long>>, __collapsed binary"
    found = rows.mapInArrow(find, f"{fields}, {run_fields}" if fields else run_fields)
    return found.withColumn("__collapsed", F.col("__collapsed").cast("string"))


def plant_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, text: about a tenth of the documents repeats a stretch of its own words up to its end.

    With h the CRC-32 of the id as text and g = h // 10, documents with h % 10
    = 0 and n > 0 words repeat the p words from a = g % n, where p = 1 + (n - a)
    // (3 + g % 8). Other texts and those without an id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.when(h % 10 == 0, F.floor(h / 10).cast("long")).alias("g"))
    kind = rows.schema["id"].dataType.simpleString()

    def plant(batches):
        for batch in batches:
            out = []
            for text, g in zip(batch.column("text"), batch.column("g").to_pylist()):
                words = text.as_py().encode().split() if g is not None and text.is_valid else []
                if words:
                    n, a = len(words), g % len(words)
                    p = 1 + (n - a) // (3 + g % 8)
                    words[a:] = (words[a:a + p] * ((n - a) // p + 1))[:n - a]
                    out.append(b" ".join(words).decode())
                else:
                    out.append(text.as_py())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], ["id", "text"])

    return rows.mapInArrow(plant, f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
