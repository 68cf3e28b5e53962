"""Operator 5: packing documents into sequences by length patterns.

1. Each worker tokenises its rows and cuts them into pieces; only small piece rows leave it.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the input) goes to the driver.
3. There, patterns of two to four lengths that fill a sequence are enumerated, their repeat counts fitted to
   the histogram by non-negative least squares and rounded, never above what is there; what remains is placed by
   best fit, decreasing, on counts of equal lengths and equal gaps, so the work does not grow with the input.
4. Each length's pieces get ranks (counts by cell, then row numbers inside small cells), and a rank says which
   repeat of which pattern a piece goes to. No piece ever goes to the driver.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.bpe import byte_alphabet
from reclink.llm.common import materialize, tidied

#: The byte-level pre-tokeniser's published pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks of text kept by a Python worker; the cache is emptied when it is full.
CACHE_CHUNKS = 200_000
#: Cells over which ranks are counted: bounds what the driver collects.
CELLS = 16_384
#: Patterns offered to the least-squares fit, and its steps.
MAX_PATTERNS, FIT_STEPS = 60_000, 400


class ByteBpe(dict):
    """Encoder of a byte-level vocabulary file; as a dict, a bounded cache from chunk to ids (little-endian, 32 bits)."""

    MIXED_SPACE = regex.compile(r"[ \n]\s|\x00")

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

    def __missing__(self, chunk: str) -> bytes:
        found = self[chunk] = np.array(self.bpe.encode_ordinary(chunk), "<u4").tobytes()
        return found

    def plain(self, text: str) -> bytes:
        """Tokens never cross the place before a blank, or after a line end, that a visible character follows."""
        if self.MIXED_SPACE.search(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\n\0").split("\0")))

    def ids(self, text: str) -> bytes:
        if len(self) > CACHE_CHUNKS:
            self.clear()
        return b"".join(self.special[p] if k % 2 else self.plain(p) for k, p in enumerate(self.split_special.split(text)))


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_column: str = "doc_id", text_column: str = "text", block: int = 256) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, nth``: each text's ids and ``end_id``, in pieces of at most ``capacity``.

    Longer documents are cut into full pieces, the first one taking what is over. ``nth`` numbers the rows of a task, so that rows
    that share an id and a text can be dealt apart; it is of use only once the table is stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_bpe(vocabulary), np.array([end_id], "<u4").tobytes()
        done = 0
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = encoder.ids(text or "") + end
                    n = len(ids) // 4
                    stops = [*range(n % capacity or capacity, n + 1, capacity)]
                    for piece, (start, stop) in enumerate(zip([0, *stops], stops)):
                        rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] + [pa.array(np.arange(done, done + len(rows)))]
                done += len(rows)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    kind = dict(docs.dtypes)[id_column]
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(tidied(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long")


def patterns(hist: np.ndarray, limit: int = MAX_PATTERNS) -> list[tuple[int, ...]]:
    """Patterns of two to four present lengths, each of which fills a sequence exactly; ``hist[k]`` counts length k."""
    capacity = len(hist) - 1
    there = [int(k) for k in np.flatnonzero(hist[:capacity])]
    found = {tuple(sorted((a, capacity - a))) for a in there if 0 < capacity - a and hist[capacity - a]}
    common = sorted(there, key=lambda k: (-hist[k], k))
    for a in common:
        for b in common:
            c = capacity - a - b
            if len(found) >= limit:
                return sorted(found)
            if c > 0 and hist[c]:
                found.add(tuple(sorted((a, b, c))))
    for a in common[:64]:
        for b in common[:64]:
            for c in common[:64]:
                d = capacity - a - b - c
                if d > 0 and hist[d] and len(found) < limit:
                    found.add(tuple(sorted((a, b, c, d))))
    return sorted(found)


def fit(found: list[tuple[int, ...]], hist: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts by non-negative least squares: accelerated projected gradient on the sparse pattern matrix."""
    rows = np.concatenate([np.array(p) for p in found])
    cols = np.repeat(np.arange(len(found)), [len(p) for p in found])
    forward = lambda x: np.bincount(rows, weights=x[cols], minlength=len(hist))
    back = lambda y: np.bincount(cols, weights=y[rows], minlength=len(found))
    target = hist.astype(float)
    probe = np.ones(len(found))
    for _ in range(20):  # the largest eigenvalue, by power iteration
        probe = back(forward(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * np.linalg.norm(back(forward(probe))))
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences for a histogram of lengths below the capacity ``len(hist) - 1``."""
    capacity, left = len(hist) - 1, hist.astype(np.int64).copy()
    left[capacity] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if found := patterns(left):
        wanted = fit(found, left)
        for k in np.argsort(-wanted, kind="stable"):
            need: dict[int, int] = defaultdict(int)
            for length in found[k]:
                need[length] += 1
            if n := min(int(round(wanted[k])), *(int(left[length]) // m for length, m in need.items())):
                for length, m in need.items():
                    left[length] -= n * m
                out.append((found[k], n))
    # Best fit, decreasing, over whole classes: n pieces of one length meet m open sequences of one gap.
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            gap = next((g for g in range(length, capacity) if gaps.get(g)), capacity)
            content, m = gaps[gap].pop() if gap < capacity else ((), -1)
            if not content:
                fits = capacity // length
                if n >= fits:
                    gaps[capacity - fits * length].append(((length,) * fits, n // fits))
                    n %= fits
                else:
                    gaps[capacity - n * length].append(((length,) * n, 1))
                    n = 0
                continue
            each = min(gap // length, max(1, n // m))
            used = min(m, n // each)
            gaps[gap - each * length].append((content + (length,) * each, used))
            n -= used * each
            if m > used:
                gaps[gap].append((content, m - used))
    return out + [x for classes in gaps.values() for x in classes]


def pack(pieces: DataFrame, capacity: int, cells: int = CELLS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored ``pieces`` (they are read three times; see ``materialize``).

    What is broadcast has at most one row a cell and a pattern's length: ``cells + capacity`` and four for each used pattern or class of gaps.
    """
    spark = pieces.sparkSession
    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in short.groupBy("length").count().collect():  # at most capacity rows
        hist[r["length"]] = r["count"]
    n = int(hist.sum())
    share = np.maximum(1, np.ceil(hist * (cells / max(n, 1)))).astype(np.int64)  # cells of each length
    widths = spark.createDataFrame(pd.DataFrame({"length": np.arange(1, capacity), "width": share[1:capacity]}), "length long, width long")
    in_cells = short.join(F.broadcast(widths), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "nth"), "width")).drop("width")
    counts = in_cells.groupBy("length", "cell").count().collect()  # at most cells + capacity rows
    counts.sort(key=lambda r: (r["length"], r["cell"]))

    segments: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: repeats, first sequence, offset
    sequences = 0
    for content, repeats in plan(hist):
        offset = 0
        for length in content:
            segments[length].append((repeats, sequences, offset))
            offset += length
        sequences += repeats
    rows: list[tuple[int, int, int, int, int, int]] = []  # length, cell, ranks from, to, sequence of rank 0, offset
    queues = {length: iter(found) for length, found in segments.items()}
    open_: dict[int, tuple[int, int, int]] = {}
    for r in counts:
        length, at = r["length"], 0
        while at < r["count"]:
            repeats, first, offset = open_.pop(length, None) or next(queues[length])
            take = min(repeats, r["count"] - at)
            rows.append((length, r["cell"], at, at + take, first - at, offset))
            if take < repeats:
                open_[length] = (repeats - take, first + take, offset)
            at += take
    names = ["length", "cell", "lo", "hi", "first", "offset"]
    places = spark.createDataFrame(pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, 6), columns=names), ", ".join(f"{c} long" for c in names))
    rank = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32", "nth")) - 1
    placed = in_cells.withColumn("rank", rank.cast("long")).join(F.broadcast(places), ["length", "cell"]).where("rank >= lo AND rank < hi")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    alone = full.select(*names, (F.lit(sequences) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.select(*names, (F.col("first") + F.col("rank")).alias("sequence_id"), "offset").unionByName(alone)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenise, cut and pack all rows: ``id_column, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece that holds ``end_id`` alone; a null id stays null; repeated rows are packed as
    often as they occur; an empty table gives no rows; other columns of any name are not read.
    """
    pieces = materialize(cut(docs, vocabulary, end_id, capacity, id_column, text_column))
    return pack(pieces, capacity).withColumnRenamed("doc_id", id_column)
