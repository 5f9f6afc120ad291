"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins that double their reach
every round find, for each message, its depth and the sum of the scores on the way
from the root; a path of n messages needs log2(n) rounds. The leaves of a tree
are ranked by the mean score of their paths, and each chosen path is
enumerated by the same doubled pointers and formatted as one conversation.

Only (tree, message, pointer, score) rows take part in the rounds; texts join
the chosen paths at the end. Every round is a table in the shared folder.

A formatted turn is ``<turn role>`` LF text ``</turn>`` LF, where a backslash before
``\\``, ``<`` and ``>`` in roles and texts makes them ordinary, so that no text can
open or close a turn and the original comes back exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.sources.shared import materialize

_TURN = re.compile(r"<turn ([^\\<>]*(?:\\.[^\\<>]*)*)>\n([^\\<>]*(?:\\.[^\\<>]*)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
MASKED_ROLE = "assistant"


def escape(text: Column) -> Column:
    for char in ("\\", "<", ">"):
        text = F.replace(text, F.lit(char), F.lit("\\" + char))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _numbered(messages: DataFrame, tree: str, node: str) -> DataFrame:
    """Messages with ``__unnamed``: a key for those without an id, equal rows apart; NULL for others, of which one row for each id stays.

    Of different rows with one id the one whose content comes first stays. Key
    and choice depend on all columns, so that the same table gets the same again.
    """
    content = F.sha2(F.to_json(F.struct(*messages.columns), {"ignoreNullFields": "false"}), 256)
    first = messages.where(F.col(node).isNotNull()).groupBy(tree, node).agg(F.min_by(F.struct(*messages.columns), content).alias("__row"))
    named = first.select("__row.*").withColumn("__unnamed", F.lit(None).cast("string"))
    unnamed = messages.where(F.col(node).isNull()).withColumn("__content", content)
    copy = F.row_number().over(Window.partitionBy("__content").orderBy("__content"))
    return named.unionByName(unnamed.withColumn("__unnamed", F.concat_ws("-", "__content", copy)).drop("__content"))


def _doubled(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer tables (tree, node, unnamed, up) that reach 1, 2, 4, ... messages up, and (tree, node, unnamed, depth, total) for all.

    A message whose parent is missing or is not in its tree is a root.
    """
    known = messages.where("node IS NOT NULL").select(F.col("tree").alias("t"), F.col("node").alias("p"))
    linked = messages.join(known, messages["tree"].eqNullSafe(known["t"]) & (messages["parent"] == known["p"]), "left")
    state = materialize(
        linked.select("tree", "node", "unnamed", F.col("p").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "replies"
    )
    most = state.count()
    levels: list[DataFrame] = []
    while not state.where("up IS NOT NULL").isEmpty():
        if 2 ** len(levels) > max(most, 1):
            raise ValueError("a message answers itself, directly or through others")
        levels.append(state.where("up IS NOT NULL").select("tree", "node", "unnamed", "up"))
        above = state.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("total").alias("s"))
        # Only messages that have not reached their root take part; the others wait.
        going, ended = state.where("up IS NOT NULL"), state.where("up IS NULL")
        joined = going.join(above, going["tree"].eqNullSafe(above["t"]) & (going["up"] == above["n"]), "left")
        state = materialize(
            ended.unionByName(joined.select("tree", "node", "unnamed", F.col("next").alias("up"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("s", F.lit(0.0))).alias("total"))),
            "replies",
        )
    return levels, state


def reply_paths(
    messages: DataFrame, tree: str = "tree_id", node: str = "message_id", parent: str = "parent_id", score: str | None = "score", best: int | None = 1
) -> DataFrame:
    """Columns tree, leaf, rank, path_score, node, place, unnamed: the messages of the ``best`` root-to-leaf paths of each tree (all if None).

    Paths are ranked by their mean score, then by the leaf. A missing score is
    0. Trees without an id are one tree; a message without an id is in no path
    but its own, and each has one: ``unnamed`` tells which (NULL in the paths of
    other messages). Repeated ids within a tree are one message. A reply cycle
    is an error.
    """
    rows = _numbered(messages, tree, node).select(
        F.col(tree).alias("tree"),
        F.col(node).alias("node"),
        F.col(parent).alias("parent"),
        (F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("score"),
        F.col("__unnamed").alias("unnamed"),
    )
    levels, state = _doubled(rows)
    inner = levels[0].select(F.col("tree").alias("t"), F.col("up").alias("u")).distinct() if levels else None
    leaves = state if inner is None else state.join(inner, state["tree"].eqNullSafe(inner["t"]) & (state["node"] == inner["u"]), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "unnamed", "depth", (F.col("total") / F.col("depth")).alias("path_score"))
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf", "unnamed")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    paths = leaves.select("tree", "leaf", "rank", "path_score", F.col("leaf").alias("node"), F.col("depth").alias("place"), "unnamed")
    # From the longest pointers to the shortest: each distance from the leaf comes up exactly once.
    for k in reversed(range(len(levels))):
        up = levels[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("unnamed").alias("m"), "up")
        # A message without an id is only met as the leaf of its own path.
        own = F.when(paths["node"].isNull(), paths["unnamed"])
        higher = paths.join(up, paths["tree"].eqNullSafe(up["t"]) & paths["node"].eqNullSafe(up["n"]) & own.eqNullSafe(up["m"]))
        paths = paths.unionByName(higher.select("tree", "leaf", "rank", "path_score", F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"), "unnamed"))
        paths = materialize(paths, "paths")
    return paths


def format_paths(paths: DataFrame, messages: DataFrame, tree: str = "tree_id", node: str = "message_id", role: str = "role", text: str = "text") -> DataFrame:
    """Columns tree, leaf, rank, path_score, n_turns, formatted, loss_spans: one row for each path.

    ``messages`` is the table that ``reply_paths`` had, with the same columns.
    ``loss_spans`` are the code-point ranges of the texts of assistant turns in
    ``formatted``, escapes included. A NULL role or text is empty. A path is one
    conversation, so its turns meet in one row.
    """
    texts = _numbered(messages, tree, node).select(
        F.col(tree).alias("t"), F.col(node).alias("m"), F.col("__unnamed").alias("u"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    own = F.when(paths["node"].isNull(), paths["unnamed"])
    rows = paths.join(texts, paths["tree"].eqNullSafe(texts["t"]) & paths["node"].eqNullSafe(texts["m"]) & own.eqNullSafe(texts["u"]))
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n"))
    body = escape(F.col("text"))
    turn = F.struct("place", head.alias("head"), body.alias("body"), (F.col("role") == MASKED_ROLE).alias("loss"))
    grouped = rows.groupBy("tree", "leaf", "unnamed").agg(
        F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(turn)).alias("turns")
    )
    formatted = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit("</turn>\n"))), "")
    # Running position: every turn adds its head, its body and the closing mark.
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,after:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"]) + len("</turn>\n")).alias("at"),
            F.when(
                x["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.char_length(x["head"])).cast("long").alias("first"),
                            (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"])).cast("long").alias("after"),
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return grouped.select("tree", "leaf", "rank", "path_score", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), ends["spans"].alias("loss_spans"))


def parse_conversation(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def as_chain(turns: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A linear table as a reply tree: every turn answers the one before it. Adds __message and __parent."""
    order = Window.partitionBy(tree).orderBy(turn, role, text)
    rows = turns.withColumn("__message", F.row_number().over(order).cast("long"))
    return rows.withColumn("__parent", F.when(F.col("__message") > 1, F.col("__message") - 1))
