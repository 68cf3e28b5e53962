"""Operator 8: SimHash fingerprints, and all links within a Hamming radius by vantage-point trees.

* Equal fingerprints are one point, so groups of copies cost one point each.
* A top tree is fitted on the driver to a bounded sample of the points (``sample``). A node holds a vantage point and a
  distance ``mu``: points farther than ``mu`` go to its outer side and points up to ``mu + radius`` to its inner
  side. By the triangle bound two points within ``radius`` always meet on one side: if both are farther than
  ``mu``, on the outer one, else on the inner one. So every pair meets in a shard, and only points near a
  boundary are stored twice.
* A ball that no vantage point can part is dealt into blocks, and each two blocks meet in a shard of their own.
* Inside a shard the same rule goes on down to small sets. A shard gives a spanning forest of its links,
  never all pairs.

The wider search for similar texts (``near_duplicates``, ``first_of_each``) goes by the same trees, after a first vantage point for sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import join_hot, materialize, runs, slices, tidied
from reclink.llm.components import components

#: Most points in the driver's sample, points to aim at in a shard, and shards to aim at on small tables.
SAMPLE, SHARD_POINTS, SHARDS = 50_000, 8_000, 96
#: Sets of this size are compared without further branching.
SMALL = 768


def fingerprint(text: str, width: int, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles (XXH64 of UTF-8, A-Z lower-cased, repeats included); no word: zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    stops, at = [], -1
    for w in words:
        at += len(w) + 1
        stops.append(at)
    k = min(width, n)
    starts = [0, *(s + 1 for s in stops[: n - k])]
    hash_, out = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    total = n - k + 1
    for lo in range(0, total, 1 << 16):
        h = np.array([hash_(joined[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 16)], stops[k - 1 + lo : k - 1 + lo + (1 << 16)])], dtype="<u8")
        out += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * out > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t or "", width) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(tidied(run), f"doc_id {kind}, fp long")


def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def branch(points: np.ndarray, radius: int, tries: int, rng: np.random.Generator, wide: bool = False) -> tuple[int, int] | None:
    """The vantage point and ``mu`` with the smallest two sides, if both sides are clearly smaller than the set.

    ``wide``: the sides together must also have fewer pairs than the set, as at a wide radius many points go to both.
    """
    best, n, power = None, len(points), 2 if wide else 1.6
    for v in points[rng.integers(0, n, tries)]:
        below = np.cumsum(np.bincount(distance(points, v), minlength=65 + radius))[: 65 + radius]
        inner, outer = below[radius:], n - below[: len(below) - radius]
        cost = inner.astype(float) ** power + outer.astype(float) ** power
        mu = int(np.argmin(cost))
        if max(inner[mu], outer[mu]) <= 0.87 * n and (best is None or cost[mu] < best[0]) and not (wide and cost[mu] > 0.9 * n**2):
            best = (cost[mu], int(v), mu)
    return best and best[1:]


def fit_tree(sample: np.ndarray, radius: int, leaf: float, seed: int = 7, wide: bool = False) -> list[tuple]:
    """Nodes of the top tree: ("split", vantage, mu, inner, outer) or ("leaf", first shard, blocks); ``leaf`` sample points fill a shard."""
    rng, nodes, shards = np.random.default_rng(seed), [()], 0
    todo = [(0, np.unique(sample))]
    while todo:
        at, points = todo.pop()
        found = branch(points, radius, 24, rng, wide) if len(points) > leaf else None
        if found:
            d = distance(points, found[0])
            nodes[at] = ("split", *found, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), points[d <= found[1] + radius]), (len(nodes) + 1, points[d > found[1]])]
            nodes += [(), ()]
        else:
            blocks = max(1, int(np.ceil(2 * len(points) / leaf))) if len(points) > 2 * leaf else 1
            nodes[at] = ("leaf", shards, blocks)
            shards += blocks * (blocks + 1) // 2
    return nodes


def route(points: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the point, shard), once for each shard that a point belongs to."""
    index, shard, todo = [], [], [(0, np.arange(len(points)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        kind, *node = nodes[at]
        if kind == "split":
            d = distance(points[own], node[0])
            todo += [(node[2], own[d <= node[1] + radius]), (node[3], own[d > node[1]])]
            continue
        first, blocks = node
        with np.errstate(over="ignore"):
            block = ((points[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
        for other in range(blocks):
            low, high = np.minimum(block, other), np.maximum(block, other)
            index.append(own)
            shard.append(first + high * (high + 1) // 2 + low)
    return (np.concatenate(index), np.concatenate(shard)) if index else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest(points: np.ndarray, radius: int, small: int = SMALL) -> np.ndarray:
    """Edges (two columns of points) of a forest that spans the links among ``points``, within a shard."""
    rng, edges, todo = np.random.default_rng(11), [], [np.unique(points)]
    while todo:
        own = todo.pop()
        found = branch(own, radius, 6, rng) if len(own) > small else None
        if found:
            d = distance(own, found[0])
            todo += [own[d <= found[1] + radius], own[d > found[1]]]
            continue
        left = own
        while len(left):
            root, left = left[0], left[1:]
            queue = [root]
            while queue and len(left):
                near = distance(left, queue.pop()) <= radius
                if near.any():
                    new = left[near]
                    edges.append(np.stack([np.full(len(new), root), new], axis=1))
                    queue += list(new)
                    left = left[~near]
    return np.concatenate(edges) if edges else np.zeros((0, 2), np.uint64)


def links(points: DataFrame, radius: int = 3, sample: int = SAMPLE) -> DataFrame:
    """Edges ``a, b`` that span all links within ``radius`` among the distinct longs ``fp`` of a stored table."""
    n = points.count()
    # The sample goes by a hash of the point: a bounded top-k, the same for the same points.
    drawn = [r["fp"] for r in points.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").collect()] if n > sample else [r["fp"] for r in points.select("fp").collect()]
    leaf = min(SHARD_POINTS, max(64, n / SHARDS)) * len(drawn) / max(n, 1)
    nodes = fit_tree(np.array(drawn, dtype=np.int64).view(np.uint64), radius, leaf) if drawn else [("leaf", 0, 1)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            index, shard = route(own.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(own[index], pa.int64())], ["shard", "fp"])

    def join(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(group["fp"].to_numpy().view(np.uint64), radius).view(np.int64), columns=["a", "b"])

    dealt = points.select("fp").mapInArrow(tidied(spread), "shard long, fp long")
    return dealt.groupBy("shard").applyInPandas(join, "a long, b long")


def near_copies(docs: DataFrame, width: int = 3, radius: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, fingerprint, component_id`` for every row.

    ``fingerprint``: 16 lower-case hex digits. ``component_id``: the smallest id that links of up to ``radius`` differing bits
    reach. Null texts and texts without words have the fingerprint zero and are linked like any other; a null id stays null and
    counts for no smallest id; repeated rows give repeated rows; other columns of any name are not read.
    """
    found = materialize(fingerprints(docs, width, id_column, text_column))
    points = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(points, radius)).withColumnRenamed("node", "fp")
    rooted = materialize(points.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    # In a struct, as the smallest id of rows without ids is null.
    least = materialize(rooted.groupBy("root").agg(F.struct(F.min("first").alias("id")).alias("component"), F.count("*").alias("size")))
    classes = materialize(join_hot(rooted, least, ["root"], "component", "size"))
    known = join_hot(found.withColumn("bits", F.col("fp")), classes, ["fp"], "component", "n")
    return known.select(F.col("doc_id").alias(id_column), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("component.id").alias("component_id"))


#: Bins of one byte in a sketch of the wider search, and those of them that are looked at first.
BINS, FIRST_BINS = 256, 64
#: Points that meet in one shard of the wider search, and the share of all points from which on a small table is dealt, too.
BLOCK_POINTS, BLOCK_SHARE = 200_000, 1 / 6
#: Points and shingle hashes of one group of candidates that are compared exactly in one block.
EXACT_POINTS, EXACT_HASHES = 1_000, 1_000_000


def shingles(text: str, width: int) -> np.ndarray:
    """The set of ``width``-word shingles as sorted hashes; a text without words has the one hash zero."""
    words = text.encode().lower().split()
    n, k = len(words), min(width, len(words))
    joined = b" ".join(words)
    stops, at = [], -1
    for w in words:
        at += len(w) + 1
        stops.append(at)
    starts = [0, *(s + 1 for s in stops[: n - k])]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops[k - 1 :])] if n else [0], dtype="<u8"))


def set_hash(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 7)


def sketch(text: str, width: int) -> tuple[int, int, bytes, int]:
    """(hash of the set of ``width``-word shingles, SimHash of that set, byte sketch, size of the set).

    The sketch holds, for each bin of the shingle hashes, one byte of the least hash in it (0: none), so the share of equal bytes
    among bins that either text fills estimates the sets' similarity.
    """
    h = shingles(text, width)
    ones = sum(np.unpackbits(h[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for lo in range(0, len(h), 65536))
    fp = int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")
    bins = np.zeros(BINS, np.uint8)
    by_bin = (h & np.uint64(BINS - 1)).astype(np.int64)
    order = np.lexsort((h, by_bin))
    first = order[np.concatenate([[True], np.diff(by_bin[order]) > 0])]
    bins[by_bin[first]] = ((h[first] >> np.uint64(8)) % np.uint64(255)).astype(np.uint8) + 1
    return set_hash(h), fp, bins.tobytes(), len(h)


def similarity(bins: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of one sketch to each of others."""
    same = ((others == bins) & (bins > 0)).sum(axis=1)
    return same / np.maximum(((others > 0) | (bins > 0)).sum(axis=1), 1)


def similar_forest(fps: np.ndarray, bins: np.ndarray, sizes: np.ndarray, radius: int, least: float, ratio: float) -> list[tuple[int, int]]:
    """Edges (indices) that span the links among points of one shard: sizes within ``ratio``, near fingerprints, then near sketches.

    Trees go on inside the shard, down to sets that no vantage point parts.
    """
    rng, edges, todo = np.random.default_rng(11), [], [np.argsort(sizes, kind="stable")]
    # Of two sketches that agree in ``least`` of 256 bins, far more than an eighth of that agree among the first 64.
    some = max(1, int(FIRST_BINS * least / 8))
    while todo:
        own = todo.pop()
        found = branch(fps[own], radius, 6, rng, wide=True) if len(own) > SMALL else None
        if found:
            d = distance(fps[own], found[0])
            todo += [own[d <= found[1] + radius], own[d > found[1]]]
            continue
        fp, size, alive = fps[own], sizes[own], np.ones(len(own), dtype=bool)
        # Where the partners of each point begin and end; a little wider than the ratio, as the whole sets decide later.
        begin, end = np.searchsorted(size, size * ratio * (1 - 1e-9)), np.searchsorted(size, size / ratio * (1 + 1e-9), side="right")
        for root in range(len(own)):
            if not alive[root]:
                continue
            alive[root] = False
            queue = [root]
            while queue:
                at = queue.pop()
                # All up to the root are settled.
                lo, hi = max(begin[at], root + 1), end[at]
                near = np.flatnonzero(distance(fp[lo:hi], fp[at]) <= radius) + lo
                near = near[alive[near]]
                if not len(near):
                    continue
                mine, rows = bins[own[at]], own[near]
                # Few filled bins hold too little for a first look, as empty ones are equal, too: they pass it.
                near = near[(bins[rows, :FIRST_BINS] == mine[:FIRST_BINS]).sum(axis=1) >= some]
                near = near[similarity(mine, bins[own[near]]) >= least] if len(near) else near
                if len(near):
                    alive[near] = False
                    edges += [(int(own[root]), k) for k in own[near].tolist()]
                    queue += near.tolist()
    return edges


def size_class(sizes: np.ndarray, least: float) -> np.ndarray:
    """Classes of set sizes: two sets of a similarity of ``least`` lie in one class or in neighbouring ones."""
    return np.floor(np.log(sizes) / np.log(1 / least + 1e-9)).astype(np.int64)


def candidates(points: DataFrame, radius: int, least: float, margin: float) -> DataFrame:
    """Edges ``a, b`` that span all pairs of a stored table ``point, fp, bins, n_shingles`` that may reach ``least``.

    The first vantage point is the empty set, the distance to which is a set's size: sets that share ``least`` lie in one class of sizes
    or in neighbouring ones, so a class meets the one below it. From there on vantage points are fingerprints of a bounded sample, with boundary points
    on both sides; what they cannot part is dealt into blocks, of which each two meet in a shard. So every pair within ``radius`` meets.
    """
    n = points.count()
    drawn = points.select("fp", "n_shingles")
    drawn = (drawn.orderBy(F.xxhash64("fp"), "fp", "n_shingles").limit(SAMPLE) if n > SAMPLE else drawn).collect()
    fps = np.array([r["fp"] for r in drawn], dtype=np.int64).view(np.uint64)
    classes = size_class(np.array([r["n_shingles"] for r in drawn], dtype=np.float64), least)
    leaf = min(BLOCK_POINTS, max(SMALL, n * BLOCK_SHARE)) * len(drawn) / max(n, 1)
    trees = {c: fit_tree(fps[(classes == c) | (classes == c - 1)], radius, leaf, wide=True) for c in {int(c) + k for c in np.unique(classes) for k in (0, 1)}}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            own, of = b.column(1).to_numpy().view(np.uint64), size_class(b.column(3).to_numpy().astype(np.float64), least)
            for c in np.unique(np.concatenate([of, of + 1])).tolist():
                mine = np.flatnonzero((of == c) | (of == c - 1))
                index, shard = route(own[mine], trees.get(c, [("leaf", 0, 1)]), radius)
                rows = pa.array(mine[index])
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(c) << np.int64(32)) + shard, pa.int64()), *[x.take(rows) for x in b.columns]], ["shard", "point", "fp", "bins", "n_shingles"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, point, fp, bins, size in runs(batches, 4096):
            shard, point, fp, size = shard.to_numpy(), point.to_numpy(), fp.to_numpy().view(np.uint64), size.to_numpy()
            rows = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS)
            begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            edges: list[tuple[int, int]] = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(shard)]):
                edges += [(a + i, a + j) for i, j in similar_forest(fp[a:b], rows[a:b], size[a:b], radius, least - margin, least)] if b - a > 1 else []
            pairs = point[np.array(edges, dtype=np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    dealt = points.select("point", "fp", "bins", "n_shingles").mapInArrow(tidied(spread), "shard long, point long, fp long, bins binary, n_shingles long")
    return dealt.repartition("shard").sortWithinPartitions("shard", "point").mapInArrow(tidied(link), "a long, b long")


def exact_forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges (indices) that span the links among sets of hashes: those whose similarity, counted in full, is ``least`` or more."""
    sizes = np.array([len(h) for h in sets])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    # For every hash, the sets that hold it.
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    stop = np.cumsum(np.bincount(ids, minlength=len(names)))
    start = np.concatenate([[0], stop[:-1]])
    edges, left = [], np.arange(len(sets))
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            at = queue.pop()
            own = ids[ends[at] - sizes[at] : ends[at]]
            n = stop[own] - start[own]
            places = np.arange(n.sum()) + np.repeat(start[own] - (np.cumsum(n) - n), n)
            common = np.bincount(holders[places], minlength=len(sets))[left]
            near = common >= least * (sizes[at] + sizes[left] - common)
            if near.any():
                new = left[near].tolist()
                edges += [(root, k) for k in new]
                queue += new
                left = left[~near]
    return edges


def _members(docs: DataFrame, width: int, least: float, radius: int, margin: float, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows ``doc_id, mark, point``, stored; points ``point, first, n, root``, stored): ``mark`` is a digest of the text, ``first`` the smallest row of a point."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [sketch(t, width) for t in b.column(2).to_pylist()]
            signed = lambda v: np.array(v, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(signed([m[0] for m in made])), pa.array(signed([m[1] for m in made])), pa.array([m[2] for m in made], pa.binary()), pa.array([m[3] for m in made], pa.int64())], ["doc_id", "mark", "point", "fp", "bins", "n_shingles"])

    text = F.coalesce(F.col(text_column), F.lit(""))
    named = docs.select(F.col(id_column).alias("doc_id"), F.unhex(F.md5(text)).alias("mark"), text.alias("text"))
    found = materialize(named.mapInArrow(tidied(run), f"doc_id {kind}, mark binary, point long, fp long, bins binary, n_shingles long"))
    # Rows without an id come last.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("first")
    points = materialize(found.groupBy("point").agg(first, F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("bins").alias("bins"), F.first("n_shingles").alias("n_shingles")))
    groups = materialize(components(candidates(points, radius, least, margin)).withColumnRenamed("node", "point").join(points.select("point", "first", "n_shingles"), "point"))
    blocks = F.greatest(F.ceil(F.count("*") / EXACT_POINTS), F.ceil(F.sum("n_shingles") / EXACT_HASHES)).cast("int")
    sizes = materialize(groups.groupBy("root").agg(blocks.alias("blocks"), F.count("*").alias("size")))
    wanted = join_hot(groups.select("root", F.col("root").alias("group"), "point", "first.*"), sizes, ["root"], "blocks", "size")
    wanted = wanted.select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "point", "group", "blocks")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            # Repeated rows of one text meet here; one is enough.
            new = [p not in seen and not seen.add(p) for p in b.column(1).to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            sets = pa.array([shingles(t, width).tobytes() for t in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], sets], ["point", "group", "blocks", "hashes"])

    own = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))
    fetched = named.join(wanted, own).select("text", "point", "group", "blocks").mapInArrow(tidied(fetch), "point long, group long, blocks int, hashes binary")
    fetched = fetched.withColumn("own", F.pmod(F.xxhash64("point"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    fetched = fetched.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "point", "hashes")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, point, hashes in runs(batches, 256):
            shard, point = shard.to_numpy(), point.to_numpy()
            new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (point[1:] != point[:-1])])
            shard, point, sets = shard[new], point[new], [np.frombuffer(h, "<u8") for h, n in zip(hashes, new) if n]
            begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            edges: list[tuple[int, int]] = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(shard)]):
                edges += [(a + i, a + j) for i, j in exact_forest(sets[a:b], least)] if b - a > 1 else []
            pairs = point[np.array(edges, dtype=np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    decided = fetched.repartition("shard").sortWithinPartitions("shard", "point").mapInArrow(tidied(decide), "a long, b long")
    roots = components(decided).withColumnRenamed("node", "point")
    return found.select("doc_id", "mark", "point"), materialize(points.select("point", "first", "n").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point")))


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 22, margin: float = 0.15, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, component_id`` for every row: groups of texts whose shingle sets have a similarity of ``least`` or more.

    At a similarity of 0.8 fingerprints differ in some ten bits (up to 20). Pairs within ``radius`` are found by vantage-point trees that lose none
    (``candidates``), and are candidates if their sketches agree in ``least - margin`` of the bins. Sketches only find candidates: all points of a group that
    candidates connect are then compared by their whole shingle sets, worked out again from the texts, in blocks where a group is large. Equal shingle sets
    are one point, of which the most frequent meet their rows by a broadcast of bounded size.

    ``component_id`` is the smallest id of a group; a group of rows without ids keeps a null one. Null texts have no shingles and are equal to empty ones. Rows that
    share an id but not the text are different documents; repeated rows are returned as often as they occur; an empty table gives no rows; other
    columns of any name are not read.
    """
    found, points = _members(docs, width, least, radius, margin, id_column, text_column)
    firsts = materialize(points.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("size")))
    classes = materialize(join_hot(points, firsts, ["root"], "component", "size"))
    return join_hot(found, classes, ["point"], "component", "n").select(F.col("doc_id").alias(id_column), F.col("component.doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 22, margin: float = 0.15, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group that ``near_duplicates`` finds, the one row of the smallest id.

    Rows without an id come after those with one, rows of one id go by a digest of the text. Of repeated rows (same id and text) one stays, with the
    smallest of its other columns. All columns of ``docs`` come along, whatever their names; an empty table gives no rows.
    """
    _, points = _members(docs, width, least, radius, margin, id_column, text_column)
    firsts = points.groupBy("root").agg(F.min("first").alias("component")).select("component.doc_id", "component.mark")
    # Under keys of its own, so that no other column can clash; the keys are never null, so equal rows meet the join where they were merged.
    kind = dict(docs.dtypes)[id_column]
    key = lambda doc, mark: [F.coalesce(doc.cast("string"), F.lit("")).alias("_key"), doc.isNull().alias("_unnamed"), mark.alias("_mark")]
    own = key(F.col(id_column), F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit("")))))
    names = [c for c in docs.columns if c not in (id_column, text_column)]
    rest = F.min(F.struct(*[F.col(c) for c in names])) if names else F.first(F.lit(None).cast("int"))
    one = docs.select(*own, *docs.columns).groupBy("_key", "_unnamed", "_mark").agg(F.first(text_column).alias("_text"), rest.alias("_rest"))
    kept = one.join(firsts.select(*key(F.col("doc_id"), F.col("mark"))), ["_key", "_unnamed", "_mark"], "left_semi")
    put = {id_column: F.when(~F.col("_unnamed"), F.col("_key")).cast(kind), text_column: F.col("_text")} | {c: F.col(f"_rest.`{c}`") for c in names}
    return kept.select(*[put[c].alias(c) for c in docs.columns])
