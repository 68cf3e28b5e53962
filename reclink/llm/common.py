"""Helpers shared by the corpus operators: table access, durable intermediate tables, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.sources.stages import materialize, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Keys that a join settles without a shuffle, at most: bounds what is broadcast.
HOT_KEYS = 1_000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], value: str, count: str, hot: int = HOT_KEYS) -> DataFrame:
    """``left`` with the column ``value`` of ``right``, and without ``keys``; rows without a partner are left out.

    ``right`` is a stored table with one row a key; its column ``count`` says how many rows of ``left`` have that key. The ``hot`` most frequent
    keys meet their rows by a broadcast, so no task gets more than one ``hot``-th of all rows for one key; the rest are shuffled. Settled
    rows travel under keys of their own, which spread them over all tasks.
    """
    top = right.orderBy(F.desc(count), *keys).limit(hot).select(*keys, F.col(value).alias("_hot"))
    others = [c for c in left.columns if c not in keys]
    tagged = left.join(F.broadcast(top), keys, "left")
    own = F.when(F.col("_hot").isNotNull(), F.xxhash64(F.lit("settled"), *keys, *others)).otherwise(F.col(keys[0])).alias(keys[0])
    tagged = tagged.select(own, *keys[1:], *others, "_hot")
    met = tagged.join(right.select(*keys, value), keys, "left")
    return met.select(*others, F.coalesce("_hot", value).alias(value)).where(F.col(value).isNotNull())


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives its memory back when a task ends."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most, so that what is made of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray | list]]:
    """Columns of rows sorted by the first column, in pieces of about ``least`` rows that never part equal first values."""
    held: list[pa.RecordBatch] = []
    size = 0

    def columns(table: pa.Table) -> list:
        return [c.combine_chunks().to_pylist() if pa.types.is_binary(c.type) else c.combine_chunks() for c in table.columns]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        last = b.column(0)[b.num_rows - 1].as_py()
        if size < least or held[0].column(0)[0].as_py() == last:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.flatnonzero(table.column(0).to_numpy() != last)[-1]) + 1
        yield columns(table.slice(0, cut))
        held = table.slice(cut).combine_chunks().to_batches()
        size = table.num_rows - cut
    if held:
        yield columns(pa.Table.from_batches(held))
