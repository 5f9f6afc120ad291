"""Mixing sources to target word counts by balanced sampling with the cube method.

A source that is to give t of its s words takes every document t // s times, and
once more with probability p = t / s - t // s. Which documents are taken once
more is drawn by the cube method, balanced on words and on documents: among
three documents with open probabilities there is a direction that changes neither
the expected words nor the expected documents of their source. Probabilities
move along it, up or down by chance in proportion, until one of them is 0 or 1;
this keeps every document's probability and both totals.

Flight: the documents of a source are dealt to parts by a hash, large ones first
within a part. A task moves over its part with three open documents in hand, so
that at most two remain open. Those of ``FAN_IN`` parts come together in the next
round, until each source has one part; the number of rounds is the logarithm of
the number of parts. Landing: some documents of all sizes are kept out of the last
flight. They and the two it leaves open, at most sixteen, are few enough to try
all outcomes; the one whose words are nearest to the target is taken. Only for
these few documents of a source the probability is not kept exactly.

Texts are read once, for their word counts. What is shuffled are narrow rows;
a large source has many parts, so that none of them is large.
"""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.sources.shared import materialize

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
PART_DOCUMENTS = 20_000
FAN_IN = 5_000
LAND_LARGEST, LAND_SPREAD = 6, 8
SEED = 17
UNIT = ("rank", "part", "size", "tie", "row", "chance")


def running_number(rows: DataFrame, *order) -> DataFrame:
    """``rows``, written, with __number from 0 in the order given; sorted by ranges, not in one task."""
    placed = materialize(rows.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))  # one row for a range
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn("__number", F.col("__before") + F.col("__place").bitwiseAND(F.lit(2**33 - 1))).drop("__part", "__before", "__place")


def water_level(sources: DataFrame) -> Fraction:
    """What a weight of one gets when targets stop at ``MOST_REPEATS`` times their size: rows of (weight, size), sizes shared in all."""
    whole = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    every, weight = sources.agg(whole("size"), whole("weight")).first()
    level = Fraction(int(every), int(weight)) if weight else Fraction(0)
    while level:
        full = f"{MOST_REPEATS} * cast(size as decimal(24,0)) * {level.denominator}BD <= weight * {level.numerator}BD"
        capped, held = sources.where(full).agg(whole("size"), whole("weight")).first()
        if held == weight:
            break
        raised = Fraction(int(every) - MOST_REPEATS * int(capped), int(weight - held))
        if raised == level:
            break
        level = raised
    return level


def targets(sizes: DataFrame) -> DataFrame:
    """Columns source, rank, source_size, documents, target of the sources in ``sizes`` (source, size), written."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("documents"))
    ranked = running_number(sources, F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("__number") % len(WEIGHTS) + 1).cast("int"))
    weighted = materialize(ranked.withColumn("weight", weight), "sources")
    level = water_level(weighted)
    share = F.expr(f"cast(weight * {level.numerator}BD as double) / {float(level.denominator)!r}D")
    capped = F.expr(f"{MOST_REPEATS} * cast(size as decimal(24,0)) * {level.denominator}BD <= weight * {level.numerator}BD")
    target = F.when(capped, (MOST_REPEATS * F.col("size")).cast("double")).otherwise(share)
    return materialize(weighted.select("source", F.col("__number").alias("rank"), F.col("size").alias("source_size"), "documents", target.alias("target")), "targets")


def flight(units, draw) -> list:
    """Moves (size, chance, row) in the order given; yields (row, 0.0 or 1.0), and at the end what is open."""
    held: list[list] = []
    for size, chance, row in units:
        if not 0.0 < chance < 1.0:
            yield row, chance
            continue
        held.append([size, chance, row])
        while len(held) == 3 or (len(held) == 2 and held[0][0] == held[1][0]):
            held = yield from _move(held, draw())
    for _, chance, row in held:
        yield row, chance


def _move(held: list, chance: float):
    """One move along the direction that keeps words and documents; yields what is decided, returns what is open."""
    sizes = [h[0] for h in held]
    equal = next(((i, j) for i in range(len(held)) for j in range(i) if sizes[i] == sizes[j]), None)
    if equal:
        way = [0.0] * len(held)
        way[equal[0]], way[equal[1]] = 1.0, -1.0
    else:
        a, b, c = sizes
        # Scaled by the largest part, which keeps the steps of very different sizes exact enough.
        way = [b - c, c - a, a - b]
        most = max(map(abs, way))
        way = [w / most for w in way]
    up = min((1.0 - h[1]) / w if w > 0 else -h[1] / w for h, w in zip(held, way) if w)
    down = min(h[1] / w if w > 0 else (h[1] - 1.0) / w for h, w in zip(held, way) if w)
    step = up if chance * (up + down) < down else -down
    ends = [((1.0 - h[1]) if step * w > 0 else h[1]) / abs(w) if w else None for h, w in zip(held, way)]
    nearest = min(range(len(held)), key=lambda i: (ends[i] is None, ends[i]))
    left = []
    for i, (h, w) in enumerate(zip(held, way)):
        h[1] = min(1.0, max(0.0, h[1] + step * w))
        if i == nearest:
            h[1] = 1.0 if step * w > 0 else 0.0
        if h[1] in (0.0, 1.0):
            yield h[2], h[1]
        else:
            left.append(h)
    return left


def _drawn(seed: int, *of) -> random.Random:
    return random.Random(int.from_bytes(hashlib.blake2b(repr((seed, *of)).encode(), digest_size=8).digest(), "little"))


def reserve(n: int) -> set[int]:
    """Which of n documents, large ones first, are left for landing: the largest, and others of all sizes."""
    return set(range(min(n, LAND_LARGEST))) | set(np.linspace(0, n - 1, min(n, LAND_SPREAD), dtype=int).tolist())


def land(left: list[tuple]) -> list[float]:
    """0.0 or 1.0 for each open (size, chance, row): of the outcomes that miss the expected documents by less than one, that with the nearest words."""
    size, chance = np.array([x[0] for x in left], float), np.array([x[1] for x in left])
    taken = np.arange(2 ** len(left))[:, None] >> np.arange(len(left)) & 1
    words, documents = np.abs(taken @ size - size @ chance), np.abs(taken.sum(1) - chance.sum())
    return taken[np.lexsort((documents, words, documents >= 1))[0]].astype(float).tolist()


def _flown(units: DataFrame, turn: int, seed: int, last: bool) -> DataFrame:
    """``units`` (rank, part, size, tie, row, chance) after one round of flight, and after landing in the last one; written.

    Units are dealt by rank and part and sorted within; a task holds one part.
    """
    dealt = units.repartition("rank", "part").sortWithinPartitions("rank", "part", F.desc("size"), "tie", "row")

    def fly(batches):
        part, key = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in UNIT)):
                if row[:2] != key and part:
                    yield moved(part, key)
                    part = []
                key = row[:2]
                part.append(row)
        if part:
            yield moved(part, key)

    def moved(part, key):
        held = reserve(len(part)) if last else set()
        done = list(flight(((r[2], r[5], r) for i, r in enumerate(part) if i not in held), _drawn(seed, turn, *key).random))
        if last:
            left = [(r[2], chance, r) for r, chance in [*done, *((part[i], part[i][5]) for i in sorted(held))] if 0.0 < chance < 1.0]
            done = [x for x in done if x[1] in (0.0, 1.0)] + [(r, t) for (_, _, r), t in zip(left, land(left))]
        columns = zip(*((*r[:5], chance) for r, chance in done))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 5 else pa.int64()) for i, c in enumerate(columns)], list(UNIT))

    return materialize(dealt.mapInArrow(fly, units.schema), "flown")


def balanced_draw(units: DataFrame, seed: int = SEED) -> DataFrame:
    """Columns row, chance (0.0 or 1.0) for ``units``: rank of the stratum, parts, size, tie, row, chance (between 0 and 1)."""
    parts = units.agg(F.max("parts")).first()[0] or 1
    now = units.withColumn("part", F.pmod("tie", "parts")).select(*UNIT)
    decided, turn = [], 0
    while True:
        flown = _flown(now, turn, seed, last=parts == 1)
        is_open = (F.col("chance") > 0) & (F.col("chance") < 1)
        decided.append(flown.where(~is_open).select("row", "chance"))
        if parts == 1:
            break
        parts, turn = -(-parts // FAN_IN), turn + 1
        now = flown.where(is_open).withColumn("part", F.floor(F.col("part") / FAN_IN))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, seed: int = SEED
) -> DataFrame:
    """``keep`` (default: all columns but the text) and __size, __source_size, __target, __taken (words that the mix takes of the document).

    Size is the number of words ``[^\\x20\\x09-\\x0D]+``. Sources, by code
    point, NULL last, weigh 5, 2, 1, repeating, and share all words by weight; a
    target stops at three times its source's size, and what is over is shared
    by the others in the same way. A document is taken 0 to 3 times as a whole.
    A source's words are missed only by what the outcomes of landing leave, in
    general less than its smallest document: the rest is balanced exactly.

    A NULL or empty text has size 0 and gives nothing; a source without words
    has the target 0. The draw depends on id, text and size only: a repeated run
    agrees, however rows are dealt. Rows of equal id and text are drawn as
    separate documents that may change places; NULL ids are ids. An empty table
    gives an empty result. Names beginning with two underscores are reserved.
    """
    kept = [c for c in docs.columns if c != text_col] if keep is None else keep
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(
        *[F.col(c).alias(f"__kept_{i}") for i, c in enumerate(kept)], F.col(source_col).cast("string").alias("source"), words.alias("size"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "sizes")
    of_source = targets(rows)
    joined = rows.join(of_source.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio), F.lit(MOST_REPEATS)).cast("long")
    joined = joined.withColumn("whole", whole).withColumn("chance", F.when(F.col("whole") < MOST_REPEATS, ratio - F.col("whole")).otherwise(0.0))
    parts = F.ceil(F.col("documents") / PART_DOCUMENTS).alias("parts")
    drawn = balanced_draw(joined.where("chance > 0").select("rank", parts, "size", "tie", "row", "chance"), seed)
    more = joined.drop("chance").join(drawn, "row", "left")
    return more.select(
        *[F.col(f"__kept_{i}").alias(c) for i, c in enumerate(kept)], F.col("size").alias("__size"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), (F.col("size") * (F.col("whole") + F.coalesce(F.col("chance"), F.lit(0.0)).cast("long"))).alias("__taken"),
    )
