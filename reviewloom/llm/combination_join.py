"""N-gram Jaccard self-join with prefixes of tokens and of token combinations.

The tokens of a document are the hashes of its distinct word shingles. All
documents order tokens alike, rare ones first, and look at a prefix that is so
long that two similar documents must share something in it. A rare token is
indexed alone. Frequent tokens are dealt to classes; within a class every
combination of two is indexed, and the prefix is extended by one token for each
class, because a class may hide one common token. Candidates are verified
against the whole texts.

Why no link is lost: similar documents x and y differ in at most
``spare(n)`` tokens of x. Of the two prefixes take the one that ends first, say
that of x. What it shares with y lies in the prefix of y too. If they shared no rare
token and no combination, all rare tokens of x's prefix and all but one of each
class would be missing in y, and the prefix is made so long that these are more
than ``spare(n)``.

Order: tokens below a fixed fraction of the hash range ("sampled" tokens; they
are enough for nearly every prefix) come first, by document frequency; other
tokens follow by hash. Any order is right, as long as it is the same for all;
this one needs the frequencies of a fifth of the tokens only.

Equal sets are one node, and of the entries with the same nodes one is kept. An
index entry with few nodes gives all its pairs. A block (some hundred nodes) is
compared by bit rows: every token flips one of a row's bits, so two rows differ in
no more bits than the sets in tokens, and a pair that differs too much is left out
before its texts are read. First the closest pairs that would join the block are
verified, in the next round all others between the components that are left. The
nodes of crowded entries are looked at from a center M, a set of tokens that
most of some of them have. D(x) is the difference of x and M: B(x) of its tokens
M lacks, A(x) of M's tokens it lacks. For two linked nodes there are two cases.

Their differences have no token in common. Then their similarity follows from
their A and B alone, and it only grows if one of them is replaced by a node with
no larger A and B. So both link with nodes of the front (those that no other node
of the crowd undercuts in A and B), and these link with each other: comparing all
nodes with the front, as far as A and B allow a link, joins their component.

Their differences have a token in common. They differ in at most ``spread(n)``
tokens, so their first common one is among the first ``spread(n) + 1`` of each
difference, in any order that all share. These tokens are the entries of the next
level. What most of a crowd has or lacks is in few differences, so an entry has
about half of the crowd at most; crowded ones become crowds in turn.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.llm.bit_table import bit_table, told
from reviewloom.llm.components import connected_components
from reviewloom.llm.memory import released
from reviewloom.llm.shingles import shingle_hashes, word_hashes
from reviewloom.sources.shared import materialize

SAMPLED = np.uint64(int(0.2 * 2**64))
FREQUENT = 16
FEW_NODES = 16
BLOCK_NODES = 512
LONGEST_ROW = 1 << 16
LEVELS = 24
CENTER_NODES = 49
SMALL_BAND = 6
CLASS_TOKENS = 3
SETS_KEPT_BYTES = 32 << 20


def spare(n: int, percent: int) -> int:
    """Tokens of a set of n that a similar set may lack."""
    return n - -(-percent * n // 100)


def spread(n: int, percent: int) -> int:
    """Tokens in which a set of n and a similar one may differ, both ways together."""
    return (100 - percent) * n // percent


def classes(band: int, percent: int) -> int:
    """Classes of frequent tokens for sets of 2**band tokens and more; none for small sets."""
    return 0 if band < SMALL_BAND else max(1, (2**band * (100 - percent)) // (100 * CLASS_TOKENS))


def bands(n: int, percent: int) -> set[int]:
    """All bands from that of a set's own size to that of the largest similar set; two similar sets have the band of the larger in common."""
    return set(range(n.bit_length() - 1, (100 * n // percent).bit_length()))


def low_tokens(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The tokens that a prefix may need, in the order of their hashes, and how many of them are sampled."""
    n = len(tokens)
    if not n:
        return tokens, 0
    sampled = int(np.searchsorted(tokens, SAMPLED))
    longest = spare(n, percent) + 1 + max(classes(b, percent) for b in bands(n, percent))
    return tokens[:max(sampled, min(n, longest))], sampled


def prefix_keys(n: int, n_low: int, sampled: int, listed: list[tuple[int, int]], percent: int) -> list[int]:
    """Index keys of a set; ``listed`` has (frequency, token) for the tokens in ``n_low`` that others have too."""
    whole = n_low > sampled
    unique = n_low - len(listed)  # no other document has these; they are rare and first
    needed = spare(n, percent) + 1 - unique
    if needed <= 0 and not whole:
        return []
    order = sorted(((t >= SAMPLED, 0 if t >= SAMPLED else f, t), f, t) for f, t in ((f, np.uint64(t % 2**64)) for f, t in listed))
    out: list[int] = []
    for band in bands(n, percent):
        n_classes, seen, left = classes(band, percent), {}, needed
        base = int(band) << 1
        for _, frequency, token in order:
            if left <= 0 and not whole:
                break
            if n_classes and frequency > FREQUENT:
                own = seen.setdefault(int(token >> np.uint64(20)) % n_classes, [])
                left -= bool(own)
                own.append(int(token))
            else:
                left -= 1
                out.append(_key(base, int(token), 0))
        out += [_key(base + 1, *sorted(two)) for own in seen.values() for two in combinations(own, 2)]
    return out


def _key(kind: int, one: int, other: int) -> int:
    h = (one * 0x9E3779B97F4A7C15 + (other ^ kind * 0xC2B2AE3D27D4EB4F) * 0xD6E8FEB86659FD93) % 2**64
    h ^= h >> 29
    return (h * 0xBF58476D1CE4E5B9) % 2**64 - 2**63


def _signature(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Columns id, n, sampled, low, sig (of the whole set): one row for each document, written before it is returned."""

    @released
    def tokens(batches):
        for batch in batches:
            n, sampled, low, sig = [], [], [], []
            for text in batch.column("text"):
                own = shingle_hashes(word_hashes(text.as_buffer().to_pybytes() if text.is_valid else b""), words)
                first, k = low_tokens(own, percent)
                n.append(len(own))
                sampled.append(k)
                low.append(first.view(np.int64))
                sig.append(_signature(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(sampled, pa.int64()), pa.array(low, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["id", "n", "sampled", "low", "sig"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(tokens, f"id {kind}, n long, sampled long, low array<long>, sig binary"), "shingle-sets")


def _nodes(sets: DataFrame) -> DataFrame:
    """One row for each distinct set, with a number of its own and the smallest id that has it."""
    row = F.struct("id", "n", "sampled", "low")
    one = sets.where("n > 0").groupBy("sig").agg(F.coalesce(F.min_by(row, "id"), F.first(row)).alias("row"))
    return materialize(one.select("sig", "row.*").withColumn("node", F.monotonically_increasing_id()), "nodes")


def _index(nodes: DataFrame, percent: int) -> DataFrame:
    """Columns key, node, n."""
    postings = nodes.select("node", F.explode("low").alias("token"))
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = postings.join(shared, "token").groupBy("node").agg(F.collect_list(F.struct("df", "token")).alias("listed"))
    rows = listed.join(nodes.select("node", "n", "sampled", F.size("low").alias("n_low")), "node")

    @released
    def keys(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = prefix_keys(row["n"], row["n_low"], row["sampled"], [(x["df"], x["token"]) for x in row["listed"]], percent)
                if own:
                    k = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([row["node"]] * k, pa.int64()), pa.array([row["n"]] * k, pa.int64())], ["key", "node", "n"])

    entries = materialize(rows.mapInArrow(keys, "key long, node long, n long"), "index")
    counted = entries.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), *_same_nodes()).where("nodes > 1")
    return materialize(entries.join(_one_of_equal(counted), "key"), "index")


def _same_nodes() -> list:
    """Two 64-bit sums that entries with the same nodes have in common."""
    return [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"sum_{k}") for k in (1, 2)]


def _one_of_equal(counted: DataFrame) -> DataFrame:
    """Columns key, nodes: of the entries with the same nodes, which give the same pairs, one."""
    return counted.groupBy("nodes", "sum_1", "sum_2").agg(F.min("key").alias("key")).select("key", "nodes")


def _similar_size(percent: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _pairs(left: DataFrame, right: DataFrame, condition, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of nodes with a common key and sizes that allow a link."""
    a = left.select("key", *[F.col(c).alias(f"{c}_a") for c in left.columns if c != "key"])
    b = right.select("key", *[F.col(c).alias(f"{c}_b") for c in right.columns if c != "key"])
    joined = a.join(b, "key").where(condition & _similar_size(percent))
    return joined.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def bit_row(tokens: np.ndarray) -> bytes:
    """Bits of which each token flips one; two to four for each token, up to ``LONGEST_ROW``."""
    width = min(LONGEST_ROW, 1 << max(6, (2 * len(tokens)).bit_length()))
    flips = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


class _Block:
    """The nodes of an entry with their bit rows, grouped by the length of the rows."""

    def __init__(self, sizes: list[int], rows: list[bytes], percent: int):
        self.n, self.percent = np.array(sizes), percent
        held = [np.frombuffer(r, np.uint64) for r in rows]
        widths = np.array([len(r) for r in held])
        self.own = held
        self.groups = [(w, np.flatnonzero(widths == w)) for w in sorted(set(widths.tolist()))]
        self.folded = {(w, w): np.stack([held[k] for k in at]) for w, at in self.groups}

    def _at(self, w: int, to: int) -> np.ndarray:
        """Rows of one length in a shorter one: bits whose places become equal flip each other."""
        if (w, to) not in self.folded:
            longer = self._at(w, 2 * to)
            self.folded[w, to] = longer[:, :to] ^ longer[:, to:]
        return self.folded[w, to]

    def apart(self, k: int) -> np.ndarray:
        """For each node the least share of tokens in which it and node k may differ, infinite if that is too much for a link."""
        out = np.full(len(self.n), np.inf)
        whole = self.n + self.n[k]
        alike = 100 * np.minimum(self.n, self.n[k]) >= self.percent * np.maximum(self.n, self.n[k])
        for w, at in self.groups:
            at_k = at[alike[at]]
            if not len(at_k):
                continue
            mine = self.own[k]
            while len(mine) > w:
                mine = mine[:len(mine) // 2] ^ mine[len(mine) // 2:]
            bits = np.bitwise_count(self._at(w, len(mine))[alike[at]] ^ mine).sum(axis=1, dtype=np.int64)
            near = bits * (100 + self.percent) <= (100 - self.percent) * whole[at_k]
            out[at_k[near]] = bits[near] / whole[at_k[near]]
        return out

    def all_pairs(self, component: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of nodes of different components that may link."""
        return [(k, int(j)) for k in range(len(self.n)) for j in np.flatnonzero(np.isfinite(self.apart(k)) & (component != component[k])) if j > k]

    def closest_pairs(self, component: np.ndarray) -> list[tuple[int, int]]:
        """Of these a spanning forest, closest pairs first."""
        best, by, out = np.full(len(self.n), np.inf), np.full(len(self.n), -1), []
        open_ = np.ones(len(self.n), bool)
        for _ in range(len(self.n)):
            k = int(np.argmin(np.where(open_, best, np.inf))) if np.isfinite(best[open_]).any() else int(np.flatnonzero(open_)[0])
            if by[k] >= 0:
                out.append((int(by[k]), k))
            open_[k] = False
            near = self.apart(k)
            closer = open_ & (near < best)
            best[closer], by[closer] = near[closer], k
            mates = open_ & (component == component[k])  # joined already
            best[mates], by[mates] = -1.0, -1
        return out


def _block_pairs(blocks: DataFrame, component: DataFrame | None, texts: DataFrame, percent: int, closest: bool) -> DataFrame:
    """Distinct pairs (a < b) within blocks (key, node, n) of nodes of different components that may link, or a spanning forest of them."""
    rows = blocks.select("key", "node", "n")
    if component is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        named = component.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
        rows = rows.join(named, F.col("node") == F.col("__node"), "left").select("key", "node", "n", F.coalesce("__component", "node").alias("component"))
        rows = rows.join(rows.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other")).where("one <> other").select("key"), "key")
    rows = rows.join(texts.select("node", "bits"), "node").repartition("key").sortWithinPartitions("key", "node").select("key", "node", "n", "component", "bits")

    def pairs_of(held: list[tuple]) -> pa.RecordBatch:
        nodes, sizes, components, bits = zip(*held)
        block = _Block(sizes, bits, percent)
        found = (block.closest_pairs if closest else block.all_pairs)(np.array(components))
        ends = [sorted((nodes[i], nodes[j])) for i, j in found]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    @released
    def compare(batches):
        at, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "node", "n", "component", "bits")]
            for key, *row in zip(*columns):
                if key != at:
                    if held:
                        yield pairs_of(held)
                    at, held = key, []
                held.append(row)
        if held:
            yield pairs_of(held)

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs with their Jaccard distance over whole sets and whether they link, written before they are returned."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    @released
    def verify(batches):
        kept: dict[int, np.ndarray] = {}
        room = SETS_KEPT_BYTES

        def tokens(node, text):
            nonlocal room
            if node not in kept:
                own = shingle_hashes(word_hashes(zlib.decompress(text.as_buffer())), words)
                room -= own.nbytes
                if room < 0:
                    kept.clear()
                    room = SETS_KEPT_BYTES - own.nbytes
                kept[node] = own
            return kept[node]

        for batch in batches:
            found = []
            for a, b, text_a, text_b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                x, y = tokens(a, text_a), tokens(b, text_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                found.append((a, b, 100 * both >= percent * either, 1 - both / either))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["a", "b", "link", "distance"])

    return materialize(joined.mapInArrow(verify, "a long, b long, link boolean, distance double"), "verified")


def _crowds(many: DataFrame, before: int | None) -> DataFrame:
    """Columns crowd, node, n: crowded entries (key, node, n) whose node with most such entries is the same are one crowd; written.

    Where that gives hardly fewer rows than the level before, which had
    ``before``, the same crowds have come together again: every entry is then a
    crowd of its own, and has about half of the nodes in the next level.
    """
    many = materialize(many.select("key", "node", "n"), "crowded")
    weight = materialize(many.groupBy("node").agg(F.count(F.lit(1)).alias("weight")), "weights")
    first = many.join(weight, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("crowd"))
    crowds = materialize(many.join(materialize(first, "crowd-names"), "key").select("crowd", "node", "n").distinct(), "crowds")
    if before is not None and crowds.count() * 4 > before * 3:
        return many.select(F.col("key").alias("crowd"), "node", "n")
    return crowds


def _centers(crowds: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Columns crowd, center: the sorted tokens that most of ``CENTER_NODES`` nodes of each crowd have; written.

    Any center gives right results; a good one makes small differences.
    """
    order = Window.partitionBy("crowd").orderBy(F.xxhash64("node", "crowd"))
    some = crowds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CENTER_NODES).select("crowd", "node")
    rows = materialize(some, "center-nodes").join(texts.select("node", "text"), "node").repartition("crowd").sortWithinPartitions("crowd", "node")

    def center(held: list[np.ndarray]) -> bytes:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        return tokens[2 * counts > len(held)].tobytes()

    @released
    def vote(batches):
        at, held, size = None, [], 0
        for batch in batches:
            done = []
            for crowd, text in zip(batch.column("crowd").to_pylist(), batch.column("text")):
                if crowd != at:
                    if held:
                        done.append((at, center(held)))
                    at, held, size = crowd, [], 0
                if size < SETS_KEPT_BYTES:
                    held.append(shingle_hashes(word_hashes(zlib.decompress(text.as_buffer())), words))
                    size += held[-1].nbytes
            yield _named_centers(done)
        if held:
            yield _named_centers([(at, center(held))])

    return materialize(rows.select("crowd", "text").mapInArrow(vote, "crowd long, center binary"), "centers")


def _named_centers(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["crowd", "center"])


def _differences(crowds: DataFrame, centers: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Columns crowd, node, n, m (tokens of the center), lacks, adds, low (the first tokens of the difference) of every node of a crowd; written."""
    joined = crowds.join(centers, "crowd").join(texts.select("node", "text"), "node")

    @released
    def compare(batches):
        for batch in batches:
            out = []
            for center, text in zip(batch.column("center"), batch.column("text")):
                m, x = np.frombuffer(center.as_buffer(), np.uint64), shingle_hashes(word_hashes(zlib.decompress(text.as_buffer())), words)
                adds, lacks = np.setdiff1d(x, m, assume_unique=True), np.setdiff1d(m, x, assume_unique=True)
                low = np.concatenate([adds, lacks])[:spread(len(x), percent) + 1].view(np.int64)
                out.append((len(m), len(lacks), len(adds), low))
            columns = [batch.column("crowd"), batch.column("node"), batch.column("n")]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            found = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns + found, ["crowd", "node", "n", "m", "lacks", "adds", "low"])

    return materialize(joined.mapInArrow(compare, "crowd long, node long, n long, m long, lacks long, adds long, low array<long>"), "differences")


def _front_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of the nodes of each crowd with those of its front whose similarity allows a link if their differences are apart."""
    least = rows.groupBy("crowd", "lacks").agg(F.min(F.struct("adds", "node")).alias("x"))
    before = F.min("x.adds").over(Window.partitionBy("crowd").orderBy("lacks").rowsBetween(Window.unboundedPreceding, -1))
    front = least.withColumn("before", before).where("before IS NULL OR x.adds < before")
    front = materialize(front.select("crowd", F.col("lacks").alias("l"), F.col("x.adds").alias("d"), F.col("x.node").alias("f")), "front")
    near = (F.lit(100) * (F.col("m") - F.col("lacks") - F.col("l")) >= F.lit(percent) * (F.col("m") + F.col("adds") + F.col("d"))) & (F.col("node") != F.col("f"))
    joined = rows.select("crowd", "node", "m", "lacks", "adds").join(front, "crowd").where(near)
    return joined.select(F.least("node", "f").alias("a"), F.greatest("node", "f").alias("b")).distinct()


def _next_entries(rows: DataFrame, component: DataFrame) -> DataFrame:
    """Columns key, node, n, component, nodes: entries of the crowds' differences that hold nodes of two components; written."""
    named = component.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    rows = rows.join(named, F.col("node") == F.col("__node"), "left")
    rows = rows.select("crowd", "node", "n", F.coalesce("__component", "node").alias("component"), F.explode("low").alias("token"))
    entries = materialize(rows.select(F.xxhash64("crowd", "token").alias("key"), "node", "n", "component"), "entries")
    counted = entries.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), F.min("component").alias("one"), F.max("component").alias("other"), *_same_nodes())
    counted = materialize(_one_of_equal(counted.where("one <> other")), "counted")
    return materialize(entries.join(counted, "key"), "entries")


def _joined(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: the links between components are joined, and their members renamed."""
    if component is None:
        return materialize(connected_components(links), "components")
    a = component.select(F.col("node").alias("a"), F.col("component").alias("part_a"))
    b = component.select(F.col("node").alias("b"), F.col("component").alias("part_b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    renamed = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    old = component.join(renamed, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    new = renamed.join(component, F.col("node") == renamed["component"], "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component"))
    return materialize(old.unionByName(new), "components")


def _prepared(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sets of all rows, distinct sets, index entries of two nodes or more, and the texts of their nodes."""
    sets = shingle_sets(docs, id_col, text_col, words, percent)
    nodes = _nodes(sets)
    index = _index(nodes, percent)
    # Texts of the nodes that have candidates; a document is known by its id and its set.
    wanted = nodes.join(index.select("node").distinct(), "node", "left_semi").select("node", "id", F.col("sig").alias("node_sig"))
    wanted = materialize(wanted, "candidates")
    return sets, nodes, index, materialize(_texts(docs, wanted, id_col, text_col, words), "candidate-texts")


def near_duplicate_pairs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85
) -> tuple[DataFrame, DataFrame]:
    """All links between distinct sets (a, b, similarity; a < b), and the set of each row of ``docs`` (id_col, n_shingles, node).

    a and b are numbers of sets, as in ``node``; rows of one node have equal
    sets and link with each other. Rows without shingles have no node. All pairs
    of an entry are verified, crowded entries too, so the work grows with the
    number of candidate pairs; components alone cost less.
    """
    sets, nodes, index, texts = _prepared(docs, id_col, text_col, words, percent)
    verified = _verify(_pairs(index.drop("nodes"), index.drop("nodes"), F.col("node_a") < F.col("node_b"), percent), texts, words, percent)
    members = sets.join(nodes.select("sig", "node"), "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "node")
    return verified.where("link").select("a", "b", (1 - F.col("distance")).alias("similarity")), members


def near_duplicate_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85
) -> DataFrame:
    """Columns id_col, n_shingles, component_id: one row for each row of ``docs``.

    Two documents link when ``100 * |common shingles| >= percent * |all
    shingles|``; component_id is the smallest id that links reach, the
    document's own included.

    A NULL or empty text has no shingles and links with nothing. Documents
    with equal sets are linked. A row without an id belongs to a component
    like others, but gives it no name; its component is NULL if no member has
    an id. Rows with equal ids stay apart, each with its own text.
    """
    sets, nodes, entries, texts = _prepared(docs, id_col, text_col, words, percent)
    apart, component, tested, before, blocks = F.col("node_a") < F.col("node_b"), None, None, None, None
    level = 0
    while entries is not None or blocks is not None:
        parts = [] if blocks is None else [_block_pairs(blocks, component, texts, percent, closest=False)]
        rows = blocks = None
        if entries is not None:
            few = FEW_NODES if level < LEVELS else 2**62  # at last all pairs of what is left
            some = max(few, BLOCK_NODES)
            small = entries.where(F.col("nodes") <= few).drop("nodes")
            parts.append(_pairs(small, small, apart, percent))
            in_blocks, crowded = entries.agg(F.count_if((F.col("nodes") > few) & (F.col("nodes") <= some)), F.count_if(F.col("nodes") > some)).first()
            if in_blocks:
                blocks = entries.where((F.col("nodes") > few) & (F.col("nodes") <= some))
                parts.append(_block_pairs(blocks, component, texts, percent, closest=True))
            if crowded:
                crowds = _crowds(entries.where(F.col("nodes") > some), before)
                before = crowds.count()
                rows = _differences(crowds, _centers(crowds, texts, words), texts, words, percent)
                parts.append(_front_pairs(rows, percent))
        fresh = reduce(DataFrame.unionByName, parts)
        fresh = fresh.distinct() if len(parts) > 1 else fresh
        if tested is not None:
            fresh = fresh.join(tested, ["a", "b"], "left_anti")
        fresh = materialize(fresh, "tested")
        tested = fresh if tested is None else tested.unionByName(fresh)
        component = _joined(component, _verify(fresh, texts, words, percent).where("link").select("a", "b"))
        entries = None if rows is None else _next_entries(rows, component)
        if entries is not None and entries.isEmpty():
            entries = None
        apart = (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b"))
        level += 1
    return _named(sets, nodes, component).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Columns node, text (deflated, as it travels with every pair), bits (its bit row).

    The scan passes by documents that are not wanted, as far as a table of bits
    tells; only deflated texts of the others are shuffled to the join.
    """
    table = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(F.xxhash64("id"))))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(id_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))

    @released
    def packed(batches):
        for batch in batches:
            some = batch.filter(pa.array(told(table.value, batch.column("hash").to_numpy().view(np.uint64))))
            sigs, texts, bits = [], [], []
            for text in some.column("text"):
                plain = text.as_buffer().to_pybytes() if text.is_valid else b""
                own = shingle_hashes(word_hashes(plain), words)
                sigs.append(_signature(own))
                texts.append(zlib.compress(plain, 4))
                bits.append(bit_row(own))
            kinds = [pa.array(c, pa.binary()) for c in (sigs, texts, bits)]
            yield pa.RecordBatch.from_arrays([some.column("doc"), *kinds], ["doc", "doc_sig", "text", "bits"])

    kind = rows.schema["doc"].dataType.simpleString()
    deflated = rows.mapInArrow(packed, f"doc {kind}, doc_sig binary, text binary, bits binary")
    # Several rows may have the id of a node; one with its set is kept.
    same = F.col("doc").eqNullSafe(F.col("id")) & (F.col("doc_sig") == F.col("node_sig"))
    return deflated.join(wanted, same).select("node", "text", "bits").dropDuplicates(["node"])


def _named(sets: DataFrame, nodes: DataFrame, component: DataFrame) -> DataFrame:
    """Rows of ``sets`` with the smallest id of their component."""
    of_set = nodes.select("sig", "node").join(component, "node", "left").select("sig", F.coalesce("component", "node").alias("component"))
    ids = sets.where("n > 0").groupBy("sig").agg(F.min("id").alias("least"))
    least = ids.join(of_set, "sig").groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_set.join(least, "component").select("sig", "component_id")
    return sets.select("id", "n", "sig").join(named, "sig", "left").select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
