"""Candidates: the top primary records of each query record by weighted overlap of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclink.functions import constants as K


#: Features of primary records, and of query records, that a task holds at most (in about 20 bytes each), and features of query records that
#: are worth a task; tasks to aim at where the tables are small.
PART, BLOCK, LEAST_BLOCK, TASKS = 4_000_000, 4_000_000, 50_000, 12
#: Primary records of which one maximum is taken in the search for the bound of the best.
STRIDE = 64


def _grid(used: DataFrame) -> tuple[dict[str, tuple[int, int, int]], int]:
    """(first cell, parts of the primary records, blocks of the query records) of each country that has both, and the most parts of any."""
    sizes = used.groupBy("country").agg(F.count_if(F.col("src") == 1).alias("s"), F.count_if(F.col("src") > 1).alias("q")).where("s > 0 AND q > 0").orderBy("country").collect()
    total, first, grid = sum(r["q"] for r in sizes), 0, {}
    for r in sizes:
        parts = -(-r["s"] // PART)
        wanted = min(-(-TASKS * r["q"] // (total * parts)), -(-r["q"] // LEAST_BLOCK))
        blocks = max(wanted, -(-r["q"] // BLOCK))
        grid[r["country"]] = (first, parts, blocks)
        first += parts * blocks
    return grid, max((parts for _, parts, _ in grid.values()), default=0)


def _spread(grid: dict[str, tuple[int, int, int]]):
    """A function for ``mapInArrow``: rows ``rec_id, country, primary, dealt, id, w`` packed by the cells that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(grid)
        first, parts, blocks = (np.array([grid[c][k] for c in names], dtype=np.int64) for k in range(3))
        for b in batches:
            country = b.column(1).dictionary_encode()
            known = {c: k for k, c in enumerate(names)}
            at = np.array([known.get(c, -1) for c in country.dictionary.to_pylist()], dtype=np.int64)[country.indices.to_numpy()]
            rows = np.flatnonzero(at >= 0)
            if not len(rows):
                continue
            at, primary, dealt = at[rows], b.column(2).to_numpy(zero_copy_only=False)[rows], b.column(3).to_numpy()[rows]
            target = dealt % np.where(primary, parts[at], blocks[at])
            recs = b.column(0).dictionary_encode()
            codes, keys, w = recs.indices.to_numpy()[rows], b.column(4).to_numpy()[rows], b.column(5).to_numpy()[rows]
            order = np.lexsort((codes, target, primary, at))
            at, primary, target, codes, keys, w = (x[order] for x in (at, primary, target, codes, keys, w))
            begin = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (primary[1:] != primary[:-1]) | (target[1:] != target[:-1])]))
            out: list[tuple] = []
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(at)]):
                c, own = at[lo], target[lo]
                cells = first[c] + (own * blocks[c] + np.arange(blocks[c]) if primary[lo] else np.arange(parts[c]) * blocks[c] + own)
                mine, code = np.unique(codes[lo:hi], return_inverse=True)
                out.append((cells.tolist(), 0 if primary[lo] else 1, names[c], recs.dictionary.take(pa.array(mine)).to_pylist(), code.astype("<i4").tobytes(), keys[lo:hi].astype("<i8").tobytes(), w[lo:hi].astype("<f8").tobytes()))
            kinds = (pa.list_(pa.int32()), pa.int32(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["cells", "side", "country", "recs", "codes", "keys", "w"])

    return run


def _joined(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, code, key, weight) of packed rows: codes go by the order of the ids, which decides between equal scores."""
    each = [np.array(r[0], dtype=object) for r in rows]
    names, code = np.unique(np.concatenate(each), return_inverse=True)
    begin = np.cumsum([0, *[len(x) for x in each[:-1]]])
    codes = np.concatenate([code[lo + np.frombuffer(r[1], "<i4")] for lo, r in zip(begin, rows)])
    return names, codes, np.concatenate([np.frombuffer(r[2], "<i8") for r in rows]), np.concatenate([np.frombuffer(r[3], "<f8") for r in rows])


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places that hold the ``k`` greatest of ``score``, rounded; more where others come near, none of those without a score."""
    whole = len(score) // STRIDE
    bound = -1.0
    if whole >= k:
        # Each maximum stands for another place, so at least k places reach the k-th of them.
        most = score[: whole * STRIDE].reshape(whole, STRIDE).max(axis=1)
        bound = np.partition(most, whole - k)[whole - k] - 1e-8
    return np.flatnonzero(score >= bound) if bound > 0 else np.flatnonzero(score > 0)


def _cell_topk(primary: list[tuple], queries: list[tuple], k: int) -> Iterator[tuple[str, list[str], np.ndarray]]:
    """(query id, primary ids, scores) of the top ``k`` of each query record of a cell, best first."""
    names, s_code, keys, sw = _joined(primary)
    order = np.argsort(keys, kind="stable")
    keys, s_code, sw = keys[order], s_code[order].astype(np.int64), sw[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ids, stop = keys[start], np.append(start[1:], len(keys))
    q_names, q_code, wanted, qw = _joined(queries)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    met = np.flatnonzero(ids[at] == wanted)
    met = met[np.argsort(q_code[met], kind="stable")]
    q_code, at, qw = q_code[met], at[met], qw[met]
    begin = np.flatnonzero(np.concatenate([[True], q_code[1:] != q_code[:-1]])) if len(q_code) else np.zeros(0, np.int64)
    lo_of, n_of = start[at], (stop - start)[at]
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(q_code)]):
        lists = [slice(x, x + n) for x, n in zip(lo_of[a:b].tolist(), n_of[a:b].tolist())]
        own = np.concatenate([s_code[x] for x in lists])
        product = np.concatenate([sw[x] for x in lists])
        product *= np.repeat(qw[a:b], n_of[a:b])
        if 4 * len(own) < len(names):
            place, own = np.unique(own, return_inverse=True)
            score = np.bincount(own, product)
            found = _best(score, k)
            place, score = place[found], score[found]
        else:
            score = np.bincount(own, product, len(names))
            place = _best(score, k)
            score = score[place]
        score = np.round(score, 9)
        top = np.lexsort((place, -score))[:k]
        yield q_names[q_code[a]], names[place[top]].tolist(), score[top]


def _solve(k: int, pruned: bool = False):
    """A function for ``mapInArrow``: the top ``k`` of the query records of each cell, from its packed rows, which come together.

    With ``pruned`` only what ``prune`` can keep of a list leaves, with the list's length and its second score.
    """

    def flush(held: dict[int, list[tuple]], country: str) -> Iterator[pa.RecordBatch]:
        if not (held[0] and held[1]):
            return
        out: list[tuple] = []
        for n, found in enumerate(_cell_topk(held[0], held[1], k), 1):
            out.append(found)
            if n % 5_000 == 0:
                yield table(out, country)
                out = []
        if out:
            yield table(out, country)

    def table(out: list[tuple], country: str) -> pa.RecordBatch:
        more = []
        if pruned:
            of = [(len(x), x[1] if len(x) > 1 else 0.0, min(K.KEEP, np.count_nonzero(x >= K.KEEP_RATIO * x.max(initial=0.0)))) for _, _, x in out]
            out = [(q, s[:m], x[:m]) for (q, s, x), (_, _, m) in zip(out, of)]
            more = [np.repeat([o[c] for o in of], [m for _, _, m in of]) for c in range(2)]
        n = [len(s) for _, s, _ in out]
        q = pa.array([q for (q, _, _), m in zip(out, n) for _ in range(m)], pa.string())
        ids = pa.array([x for _, s, _ in out for x in s], pa.string())
        rank = pa.array(np.concatenate([np.arange(m) for m in n]), pa.int32())
        columns = [q, ids, pa.array([country] * len(q), pa.string()), pa.array(np.concatenate([x for _, _, x in out]), pa.float64()), rank]
        columns += [pa.array(x, kind) for x, kind in zip(more, (pa.int64(), pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["q_id", "s1_id", "country", "bscore", "brank", "n", "second"][: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, of, held = None, "", {0: [], 1: []}
        for b in batches:
            cells, side, country, recs = (b.column(c) for c in range(4))
            for r in range(b.num_rows):
                if cells[r].as_py() != cell:
                    yield from flush(held, of)
                    cell, of, held = cells[r].as_py(), country[r].as_py(), {0: [], 1: []}
                held[side[r].as_py()].append((recs[r].as_py(), *[b.column(c)[r].as_py() for c in (4, 5, 6)]))
        yield from flush(held, of)

    return run


_LIST = "q_id string, s1_id string, country string, bscore double, brank int"


def _cells(weighted: DataFrame, weights: dict[str, float]) -> tuple[DataFrame, int]:
    """(packed rows of all cells, which come together, and the most parts of a country)."""
    ns_weight = F.create_map(*[x for ns, w in weights.items() for x in (F.lit(ns), F.lit(w))])
    used = weighted.where(F.col("in_product") & F.col("ns").isin(*[ns for ns, w in weights.items() if w > 0]))
    if "met" in weighted.columns:
        used = used.where("met")
    grid, parts = _grid(used)
    primary = F.col("src") == 1
    w = F.when(primary, F.col("w")).otherwise(ns_weight[F.col("ns")] * F.col("w"))
    rows = used.select("rec_id", "country", primary.alias("primary"), F.xxhash64("rec_id").alias("dealt"), F.xxhash64("country", "ns", "key").alias("id"), w.alias("w"))
    packed = rows.mapInArrow(_spread(grid), "cells array<int>, side int, country string, recs array<string>, codes binary, keys binary, w binary")
    dealt = packed.select(F.explode("cells").alias("cell"), "side", "country", "recs", "codes", "keys", "w").repartition("cell").sortWithinPartitions("cell")
    return dealt, parts


def topk(weighted: DataFrame, k: int = K.TOP_K, weights: dict[str, float] = K.WEIGHTS) -> DataFrame:
    """``q_id, s1_id, country, bscore, brank``: the ``k`` primary records of the greatest weighted overlap. ``weighted`` should be stored.

    A country's primary records are dealt in parts, its query records in blocks, and each part meets each block in one task, a cell. Only features
    travel, packed as numbers, a primary record's once to each block and a query record's once to each part; products are made and added up in the cell, and only
    the best ``k`` leave it. A part and a block hold as much as a task's memory lets them, so there are few copies. Keys above the frequency bound left the product before;
    where ``weighted`` has ``met``, so do keys of primary records that no query record has, which add nothing to any score.
    """
    cells, parts = _cells(weighted, weights)
    return _ranked(cells, parts, k)


def _ranked(cells: DataFrame, parts: int, k: int) -> DataFrame:
    out = cells.mapInArrow(_solve(k), _LIST)
    if parts < 2:
        return out
    rank = F.row_number().over(Window.partitionBy("q_id", "country").orderBy(F.desc("bscore"), "s1_id")) - 1
    return out.withColumn("brank", rank.cast("int")).where(F.col("brank") < k)


def context(top: DataFrame) -> DataFrame:
    """Add ``top1, top2, n_ret, gap_top1, top_margin, ratio_top1`` of the query record's list."""
    w = Window.partitionBy("q_id")
    return _derived(top.withColumns({"top1": F.max("bscore").over(w), "top2": F.coalesce(F.max(F.when(F.col("brank") == 1, F.col("bscore"))).over(w), F.lit(0.0)), "n_ret": F.count("*").over(w)}))


def _derived(out: DataFrame) -> DataFrame:
    return out.withColumns({"gap_top1": F.col("bscore") - F.col("top1"), "top_margin": F.col("top1") - F.col("top2"), "ratio_top1": F.col("bscore") / F.col("top1")})


def prune(listed: DataFrame) -> DataFrame:
    """The best ten at most, and of those what reaches 0.6 of the best."""
    return listed.where((F.col("brank") < K.KEEP) & (F.col("bscore") >= K.KEEP_RATIO * F.col("top1")))


def pruned(weighted: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """The same as ``prune(context(topk(weighted, k)))``; where a country has one part, only what is kept leaves its task."""
    cells, parts = _cells(weighted, K.WEIGHTS)
    if parts > 1:
        return prune(context(_ranked(cells, parts, k)))
    w = Window.partitionBy("q_id")
    first = lambda c: F.when(F.col("brank") == 0, F.col(c))
    out = cells.mapInArrow(_solve(k, pruned=True), f"{_LIST}, n long, second double")
    out = out.withColumns({"top1": F.max("bscore").over(w), "top2": F.max(first("second")).over(w), "n_ret": F.sum(first("n")).over(w)}).drop("n", "second")
    return prune(_derived(out))


def s1_context(kept: DataFrame) -> DataFrame:
    """``q_id, s1_id, s1_nq, s1_ntop1, s1_rank, s1_gap``: how a primary record's queries compete for it."""
    w = Window.partitionBy("s1_id")
    return kept.select(
        "q_id", "s1_id", F.count("*").over(w).alias("s1_nq"), F.sum(F.when(F.col("brank") == 0, 1).otherwise(0)).over(w).alias("s1_ntop1"),
        F.row_number().over(w.orderBy(F.desc("bscore"), "q_id")).cast("long").alias("s1_rank"), (F.col("bscore") - F.max("bscore").over(w)).alias("s1_gap"),
    )


def name_frequency(records: DataFrame) -> DataFrame:
    """``entity_id, name_freq``: primary records of the country with the same core name.

    Empty names, which may be many, meet a table of one row a country instead of the join.
    """
    named = records.select("entity_id", "src", "country", "nm_core")
    counts = named.where("src = 1").groupBy("country", "nm_core").agg(F.count("*").alias("name_freq"))
    some = named.where("nm_core <> ''").join(counts, ["country", "nm_core"], "left")
    none = named.where("nm_core = ''").join(F.broadcast(counts.where("nm_core = ''").drop("nm_core")), "country", "left")
    pick = ["entity_id", F.coalesce("name_freq", F.lit(0)).cast("long").alias("name_freq")]
    return some.select(*pick).unionByName(none.select(*pick))


def union_topk(weighted: DataFrame, lists: list[tuple[dict[str, float], int]]) -> DataFrame:
    """``q_id, s1_id, country`` in any of several lists, each by its own namespace weights and length."""
    found = [topk(weighted, k, weights).select("q_id", "s1_id", "country") for weights, k in lists]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()
