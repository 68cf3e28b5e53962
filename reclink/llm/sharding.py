"""Operator 9: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is cut into equal arcs. Every virtual node sits on an arc, and from each arc the shards follow in the
order in which their virtual nodes are met clockwise. Keys are offered in a fixed order of their cells (arc and
sub-cell, in hashed order); a key whose shard is full continues clockwise. As all keys of an arc see the same
shards, whole cells are placed at once from their counts, and a row only needs its rank in its cell:

* one scan computes size, checksum and cell of each row (the text goes no further);
* the driver collects one count for each cell (a parameter, whatever the input) and lays the cells out;
* a window inside each small cell ranks its rows, and a broadcast of the layout gives shard and slot.

With ``slack=0`` the capacities add up to the number of rows, so the counts of two shards differ by one at most;
with more slack fewer keys move, as in the usual bounded-load ring.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import materialize

ARCS, SUBCELLS, VIRTUAL_NODES = 2048, 8, 128


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def clockwise(shards: int, arcs: int = ARCS, virtual_nodes: int = VIRTUAL_NODES) -> list[list[int]]:
    """For each arc, all shards in the order in which the ring meets them from there."""
    ring = sorted((_hash(f"shard {s} node {v}") % arcs, _hash(f"tie {s} {v}"), s) for s in range(shards) for v in range(virtual_nodes))
    out: list[list[int]] = [[]] * arcs
    order: list[int] = [s for _, _, s in ring]
    # Walk the ring backwards twice: a node met earlier goes to the front.
    seen: list[int] = []
    at = 2 * len(ring) - 1
    for arc in range(2 * arcs - 1, -1, -1):
        while at >= 0 and ring[at % len(ring)][0] + arcs * (at // len(ring)) >= arc:
            s = order[at % len(ring)]
            seen = [s, *(x for x in seen if x != s)]
            at -= 1
        if arc < arcs:
            out[arc] = seen
    return out


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """The most rows of each shard; without slack they add up to ``rows`` and differ by one at most."""
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def layout(counts: dict[tuple[int, int], int], shards: int, slack: float, arcs: int = ARCS) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, sub-cell, ranks from, to, shard, slot of rank 0) for counts of rows by (arc, sub-cell)."""
    order, left = clockwise(shards, arcs), capacities(sum(counts.values()), shards, slack)
    used, out = [0] * shards, []
    for arc, sub in sorted(counts, key=lambda c: (_hash(f"cell {c[0]} {c[1]}"), c)):
        at, n = 0, counts[arc, sub]
        for shard in order[arc]:
            if take := min(left[shard], n - at):
                out.append((arc, sub, at, at + take, shard, used[shard] - at))
                left[shard] -= take
                used[shard] += take
                at += take
    return out


def shard_documents(docs: DataFrame, shards: int = 8, slack: float = 0.0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Place every row: ``id_column, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus one; a null text has no bytes and the checksum of an empty one. The law is
    ``rows``, so ``grown_shard`` is null. Null ids are one key; rows that share an id but not the text may part; equal
    rows take different slots in any order. An empty table gives no rows; other columns of any name are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = materialize(docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    rows = rows.withColumns({
        "arc": F.pmod(F.xxhash64("doc_id"), F.lit(ARCS)).cast("int"),
        "sub": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SUBCELLS)).cast("int"),
    })
    counts = {(r["arc"], r["sub"]): r["count"] for r in rows.groupBy("arc", "sub").count().collect()}  # ARCS * SUBCELLS at most
    places = F.broadcast(spark.createDataFrame(layout(counts, shards, slack), "arc int, sub int, lo long, hi long, shard int, first long"))
    rank = F.row_number().over(Window.partitionBy("arc", "sub").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("rank", rank.cast("long")).join(places, ["arc", "sub"]).where("rank >= lo AND rank < hi")
    return placed.select(
        F.col("doc_id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("first") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
