"""Operator 10: reply trees to training conversations.

Paths from leaves to roots are enumerated by iterative self-joins that double the step each round (a node's
parent, then its ancestor two, four, ... levels up), so a chain of n turns takes about log2(n) rounds. Branches
are ranked by their score inside each tree and the chosen paths are formatted, one conversation each. Every round is stored,
so a lost executor never costs more than one round.

Template: ``<|im_start|>role``, a line end, the text, ``<|im_end|>``, a line end. Inside texts and roles every ``<|`` gets one more
backslash between its two characters, so no text can hold a control string, and reading takes one away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_GUARD, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)
_ROLE = {"\\": "\\\\", "\n": "\\n"}


def escape(text: str) -> str:
    return _GUARD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on the header line, so their line ends and backslashes are spelled out as well."""
    return escape("".join(_ROLE.get(c, c) for c in role))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: the code-point spans of the assistant's texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns, read back from a formatted conversation."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _trees(nodes: DataFrame, *others: str) -> DataFrame:
    """``tree, node, parent`` and ``others``: keys that equal themselves where ids are null, and one row a node.

    Repeated rows are one node. Different rows of one node id are different nodes, of which replies go to the first, by all their columns.
    """
    rows = nodes.select("tree_id", "node_id", "parent_id", *others).distinct()
    nth = F.row_number().over(Window.partitionBy("tree_id", "node_id").orderBy("parent_id", *others))
    key = lambda node, n: F.struct(F.col(node).alias("id"), n.alias("nth"))
    return rows.select(F.struct("tree_id").alias("tree"), key("node_id", nth).alias("node"), F.when(F.col("parent_id").isNotNull(), key("parent_id", F.lit(1))).alias("parent"), *others)


def _paths(links: DataFrame) -> DataFrame:
    """``tree, leaf, node, depth`` of a stored table ``tree, node, parent``."""
    there = links.select("tree", F.col("node").alias("parent"))
    jumps = materialize(links.join(there, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")))
    parents = jumps.select("tree", F.col("up").alias("node"))
    # Each round is stored by itself, so a path's nodes are written once, however many rounds follow.
    found = materialize(links.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("height")))
    largest = links.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step < largest:
        far = found.join(jumps, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + step).alias("height"))
        found = found.unionByName(materialize(far))
        step *= 2
        if step < largest:
            next_up = jumps.select("tree", F.col("node").alias("up"), F.col("up").alias("further"))
            jumps = materialize(jumps.join(next_up, ["tree", "up"]).select("tree", "node", F.col("further").alias("up")))
            if jumps.isEmpty():
                break
    # Paths into a circle grow past the largest tree; a circle that no leaf leads to is on no path.
    if largest and not (found.where(F.col("height") >= largest).isEmpty() and links.join(found.select("tree", "node"), ["tree", "node"], "left_anti").isEmpty()):
        raise ValueError("a node is its own ancestor")
    top = Window.partitionBy("tree", "leaf")
    return found.select("tree", "leaf", "node", (F.max("height").over(top) - F.col("height")).alias("depth"))


def paths(nodes: DataFrame) -> DataFrame:
    """``tree_id, leaf_id, node_id, depth``: every root-to-leaf path of a table ``tree_id, node_id, parent_id``; the root has depth 0.

    A node whose parent is null or not there is a root. Null tree ids are one tree, null node ids are leaves. Repeated rows are one
    node; rows that share a node id but not the parent are different nodes, and replies go to the one of the smallest parent. Circles raise
    ValueError, whether a leaf leads into them or not. An empty table gives no rows; other columns of any name are not read.
    """
    found = _paths(materialize(_trees(nodes)))
    return found.select("tree.tree_id", F.col("leaf.id").alias("leaf_id"), F.col("node.id").alias("node_id"), "depth")


def conversations(nodes: DataFrame, per_tree: int | None = None) -> DataFrame:
    """``tree_id, leaf_id, branch, score, formatted, loss_spans`` for the ``per_tree`` best branches of each tree (all of them if None).

    ``nodes`` has ``tree_id, node_id, parent_id, role, text, score``. A branch scores the sum over its nodes (null: 0); equal
    scores rank by leaf id. Null roles and texts are empty. Null and repeated ids, repeated rows and circles are as in ``paths``: rows of
    one node id that differ in any of these columns are all kept. An empty table gives no rows; other columns are not read.
    """
    nodes = nodes.select("tree_id", "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    trees = materialize(_trees(nodes, "role", "text", "score"))
    found = _paths(trees.select("tree", "node", "parent"))
    if per_tree is not None:
        scored = found.join(trees.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
        best = scored.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("branch") <= per_tree)
        found = found.join(best.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turns = found.join(trees.select("tree", "node", "role", "text", "score"), ["tree", "node"])
    whole = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    whole = whole.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b.column(4).to_pylist()]
            columns = [*b.columns[:4], pa.array([m[0] for m in made], pa.string()), pa.array([[{"start": s, "stop": e} for s, e in m[1]] for m in made], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, ["tree_id", "leaf_id", "branch", "score", "formatted", "loss_spans"])

    kinds = dict(nodes.dtypes)
    return whole.select("tree.tree_id", F.col("leaf.id").alias("leaf_id"), "branch", "score", "turns").mapInArrow(
        run, f"tree_id {kinds['tree_id']}, leaf_id {kinds['node_id']}, branch int, score double, formatted string, loss_spans array<struct<start: long, stop: long>>"
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back: ``tree_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, ["tree_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = dict(formatted.dtypes)["tree_id"]
    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(run, f"tree_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chain(rows: DataFrame) -> DataFrame:
    """Plain conversations ``conv_id, turn, role, text`` as trees of one branch: every row replies to the one before it.

    Rows of one turn (repeated or null) follow each other by role and text, nulls first. Rows without a ``conv_id`` are one conversation.
    """
    ranked = rows.withColumn("node_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    return ranked.select(F.col("conv_id").alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0).alias("score"))
