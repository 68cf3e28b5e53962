"""Operator 7: removing every byte that an earlier equal string of ``span`` bytes covers.

Which strings can be equal is settled by anchors that depend on content alone: the anchor of a string is the start of its
``GRAM``-byte substring with the least hash, so equal strings have equal anchor substrings at equal offsets. An anchor's region
holds all strings of which it is the anchor; a document is cut into about one region for every 35 bytes.

1. Regions (two polynomial hashes, place) are dealt by the anchor's hash. Regions that agree in both hashes are taken for repeats of
   the earliest of them. What agrees in the anchor only (the ends of repeated passages) is left open.
2. Open regions are cut from the texts and dealt by anchor. There, strings whose hash another one shares are sorted as suffixes: by their first eight bytes, and
   among equals by a mergesort whose comparisons find the common extension by binary search over prefix polynomial
   hashes. Neighbours with a common extension of ``span`` bytes are compared byte by byte before they count as equal.
3. Repeats of whole regions are verified as well. Neighbouring regions that repeat neighbouring ones join into one long span first. Spans inside
   one chunk of texts are compared byte by byte, others by 128-bit cryptographic digests of their bytes, worked out from both texts. Should
   any differ, all starts again with other hash tables, so no byte goes on the word of a polynomial hash alone.
4. Spans go back to their documents.

Hot content does not meet in one task. Equal regions are merged in every chunk before they are dealt, and a task reads a hot anchor's regions as
a stream. The open regions of an anchor that has more than ``WIDE`` of them, whatever the input, are dealt string by string instead, by cryptographic
digests, merged in every chunk in the same way. So what a task holds is bounded, and the result does not depend on it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import materialize, runs, slices, tidied

#: Bytes of an anchor substring; strings of ``span`` bytes hold ``span - GRAM + 1`` of them.
GRAM = 32
#: Bytes of text that a task handles together, and strings that are sorted together.
CHUNK_BYTES, SORT_STRINGS = 16 << 20, 400_000
#: Open regions of one anchor that are sorted together, at most, and strings that a task deals together.
WIDE, DEAL_STRINGS = 2_000, 500_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 1..n of a base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0][0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [tuple(np.cumprod(np.full(size, b, dtype=np.uint64)) for b in (base, pow(base, -1, 2**64))) for base in _BASES]
    return _powers[which]


@functools.lru_cache(maxsize=4)
def tables(attempt: int) -> np.ndarray:
    """Random values of the byte values, for both hashes."""
    return np.random.default_rng(20_240_601 + attempt).integers(0, 2**64, (2, 256), dtype=np.uint64)


def prefix_hashes(data: np.ndarray, which: int, attempt: int = 0) -> np.ndarray:
    """H with H[i] the polynomial hash of the first i bytes; see ``part_hashes``."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(tables(attempt)[which][data] * powers(which, len(data))[0][: len(data)])])


def part_hashes(prefix: np.ndarray, which: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, stop), equal for equal substrings wherever they are."""
    with np.errstate(over="ignore"):
        return (prefix[stops] - prefix[starts]) * powers(which, len(prefix))[1][starts]


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def least_ahead(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (width - done)], h[width - done :]) if done < width else h


def regions(data: np.ndarray, span: int, attempt: int = 0) -> tuple[np.ndarray, ...]:
    """(anchor hash, region hash, first string, number of strings, repeats itself) of a text of ``span`` bytes or more."""
    one, two = prefix_hashes(data, 0, attempt), prefix_hashes(data, 1, attempt)
    at = np.arange(len(data) - GRAM + 1)
    grams = mixed(part_hashes(one, 0, at, at + GRAM))
    most = span - GRAM + 1
    least = least_ahead(grams, most)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(first, len(least)))
    # A run of one least hash may be longer than a string has anchors, where content repeats itself: cut it.
    if (count > most).any():
        first = np.concatenate([np.arange(f, f + c, most) for f, c in zip(first, count)])
        count = np.diff(np.append(first, len(least)))
    # Equal strings inside one region need an anchor that stands in it twice.
    edge = np.zeros(most - 1, np.uint64)
    anchors = np.flatnonzero(grams == ~least_ahead(~np.concatenate([edge, least, edge]), most))
    twice = (grams[anchors[1:]] == grams[anchors[:-1]]) & (np.diff(anchors) < most)
    itself = np.isin(least[first], grams[anchors[1:][twice]]) if twice.any() else np.zeros(len(first), bool)
    with np.errstate(over="ignore"):
        whole = mixed(part_hashes(two, 1, first, first + count + span - 1) + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return least[first], whole, first, count, itself


#: Low bits of a place that hold the number of strings; one bit above them says whether the region repeats itself.
COUNT_BITS = 23


def pack_place(start: np.ndarray, itself: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Start, whether the region repeats itself, and number of strings in one long that sorts by start."""
    return (start.astype(np.int64) << (COUNT_BITS + 1)) | (itself.astype(np.int64) << COUNT_BITS) | count.astype(np.int64)


def place_start(place):
    return place >> (COUNT_BITS + 1)


def place_count(place):
    return place & ((1 << COUNT_BITS) - 1)


def text_mark(data: bytes) -> int:
    """A signed 64-bit digest that tells rows of one id with different texts apart."""
    return xxhash.xxh64_intdigest(data, 11) - (1 << 63)


class Chunk(NamedTuple):
    """Texts that a task handles together; equal rows are one."""

    key: np.ndarray
    mark: np.ndarray
    texts: list[bytes]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    held: dict[tuple[int, int], bytes] = {}
    size = 0

    def made() -> Chunk:
        key, mark = np.array([*held], dtype=np.int64).reshape(-1, 2).T
        return Chunk(key, mark, [*held.values()])

    for b in slices(batches):
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            raw = text.encode()
            held[key, text_mark(raw)] = raw
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield made()
                held, size = {}, 0
    if held:
        yield made()


def _long(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64, copy=False), pa.int64(), mask=missing)


def _classes(columns: list[np.ndarray], doc: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Rows (anchor, region, key, mark, place), sorted; which ones begin a class of equal content; which ones repeat another; the beginning of each row's class.

    A row that stands there twice neither begins a class nor repeats one. ``doc`` is a further column that is sorted along.
    """
    a, r, key, mark, place = columns
    order = np.lexsort((place, mark, key, r, a))
    columns = [c[order] for c in [*columns, *([] if doc is None else [doc])]]
    a, r, key, mark, place = columns[:5]
    differ = lambda *c: np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in c])])
    new = differ(a, r)
    first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return columns, new, ~new & differ(a, r, key, mark, place), first


def joined_runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray, lead: np.ndarray, lead_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, start, strings, lead, lead start) of maximal runs of regions that repeat neighbouring regions of one text."""
    order = np.lexsort((start, doc))
    doc, start, count, lead, lead_start = (x[order] for x in (doc, start, count, lead, lead_start))
    if not len(doc):
        return doc, start, count, lead, lead_start
    follows = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + count[:-1]) & (lead[1:] == lead[:-1]) & (lead_start[1:] == lead_start[:-1] + count[:-1])
    # The number of strings has to fit into a place.
    total = np.cumsum(count)
    begin = np.flatnonzero(np.concatenate([[True], ~follows | (total[1:] >> (COUNT_BITS - 1) != total[:-1] >> (COUNT_BITS - 1))]))
    return doc[begin], start[begin], np.add.reduceat(count, begin), lead[begin], lead_start[begin]


def _settled(key: np.ndarray, mark: np.ndarray, start: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (anchor, region, key, mark, place) of spans that need no more than to reach their documents, spread over all tasks."""
    place = pack_place(start, np.zeros(len(start), bool), strings)
    return mixed(key.view(np.uint64) ^ mixed(mark.view(np.uint64) ^ place.view(np.uint64))), np.zeros(len(start), np.uint64), key, mark, place


def _rows(settled: tuple[np.ndarray, ...], others: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches of both; settled rows have no region hash."""
    done = np.concatenate([np.ones(len(settled[0]), bool), np.zeros(len(others[0]), bool)])
    columns = [np.concatenate(c) for c in zip(settled, others)]
    for lo in range(0, len(done), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([_long(c[s], done[s] if k == 1 else None) for k, c in enumerate(columns)], ["anchor", "region", "key", "mark", "place"])


DEALT = "anchor long, region long, key long, mark long, place long"


def deal(texts: DataFrame, span: int, attempt: int = 0) -> DataFrame:
    """``anchor, region, key, mark, place`` of all regions of a table ``key, text``; repeats inside a chunk are compared by their bytes and settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            parts = []
            for doc, raw in enumerate(chunk.texts):
                if len(raw) >= span:
                    a, r, first, count, itself = regions(np.frombuffer(raw, np.uint8), span, attempt)
                    parts.append((a, r, pack_place(first, itself, count), np.full(len(a), doc)))
            if not parts:
                continue
            a, r, place, doc = (np.concatenate(c) for c in zip(*parts))
            columns, new, again, first = _classes([a, r, chunk.key[doc], chunk.mark[doc], place], doc)
            *columns, doc = columns
            start, count = place_start(columns[4]), place_count(columns[4])
            lead = first[again]
            found = joined_runs(doc[again], start[again], count[again], doc[lead], start[lead])
            same = np.array([chunk.texts[d][s : s + n + span - 1] == chunk.texts[e][t : t + n + span - 1] for d, s, n, e, t in zip(*(x.tolist() for x in found))], dtype=bool)
            if not same.all():
                # Equal hashes of unequal bytes: these regions travel on, to be found out by their digests.
                new, found, same = new | again, tuple(x[:0] for x in found), same[:0]
            yield from _rows(_settled(chunk.key[found[0]], chunk.mark[found[0]], found[1], found[2]), [c[new] for c in columns])

    return texts.mapInArrow(tidied(run), DEALT)


FOUND = "key long, mark long, place long, anchor long, open boolean, lead_key long, lead_mark long, lead_place long"


def settle(dealt: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """``FOUND`` rows: repeats with the earliest of their class, settled rows without one, and (``open``) regions that share their anchor with other regions or hold it twice.

    Reads each anchor's rows as a stream, in order, ``piece`` rows or a batch at a time; of an anchor that goes on, two rows are kept in mind.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in (x.slice(at, piece) for x in batches for at in range(0, x.num_rows, piece)):
            held.append(b)
            if sum(x.num_rows for x in held) >= piece:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: list[np.ndarray] | None = None  # the beginning of the class that was read last
        told = others = False  # whether it was given out as open, and whether its anchor had other classes before it
        last: list[np.int64] = []  # the row that was read last
        for table in pieces(batches):
            done = table.column(1).is_null().to_numpy()
            whole = [table.column(k).combine_chunks().fill_null(0).to_numpy() for k in range(5)]
            columns = [c[~done] for c in whole]
            out = [([c[done] for c in whole], False, None)]
            if len(columns[0]):
                if carried is not None:
                    # The row that was read last may stand here again.
                    fresh = np.logical_or.reduce([c != v for c, v in zip(columns, last)])
                    columns = [np.concatenate([head, c[fresh]]) for head, c in zip(carried, columns)]
                columns, new, again, first = _classes(columns)
                a, place = columns[0], columns[4]
                group = np.concatenate([[True], a[1:] != a[:-1]])
                number = np.cumsum(group) - 1
                classes = np.bincount(number, weights=new)
                classes[0] += others
                left = new & ((classes[number] > 1) | (place >> COUNT_BITS & 1 == 1))
                begin, known = int(first[-1]), carried is not None and told
                told, others = bool(left[begin]) or (known and begin == 0), bool(classes[-1] > 1)
                if known:
                    left[0] = False
                carried, last = [c[begin : begin + 1] for c in columns], [c[-1] for c in columns]
                out += [([c[again] for c in columns], False, [c[first[again]] for c in columns]), ([c[left] for c in columns], True, None)]
            for (a, _, key, mark, place), is_open, lead in out:
                if len(a):
                    leads = [pa.nulls(len(a), pa.int64())] * 3 if lead is None else [_long(c) for c in lead[2:]]
                    yield pa.RecordBatch.from_arrays([*map(_long, (key, mark, place, a)), pa.array(np.full(len(a), is_open)), *leads], ["key", "mark", "place", "anchor", "open", "lead_key", "lead_mark", "lead_place"])

    return dealt.repartition("anchor").sortWithinPartitions("anchor", "region", "key", "mark", "place").mapInArrow(tidied(run), FOUND)


def whole_spans(found: DataFrame) -> DataFrame:
    """``key, mark, start, n, lead_key, lead_mark, lead_start``: repeats of whole regions, joined to maximal runs of ``n`` strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            place, *lead, lead_place = (lists.flatten().field(k).to_numpy() for k in range(4))
            doc = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
            # The leading text by a number, as its id and mark are two values.
            leads, number = np.unique(np.stack(lead), axis=1, return_inverse=True)
            doc, start, n, number, lead_start = joined_runs(doc, place_start(place), place_count(place), number.reshape(-1), place_start(lead_place))
            own = [b.column(k).take(pa.array(doc)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *map(_long, (start, n, leads[0][number], leads[1][number], lead_start))], ["key", "mark", "start", "n", "lead_key", "lead_mark", "lead_start"])

    lists = found.where("lead_key IS NOT NULL").groupBy("key", "mark").agg(F.collect_list(F.struct("place", "lead_key", "lead_mark", "lead_place")).alias("those"))
    return lists.mapInArrow(tidied(run), "key long, mark long, start long, n long, lead_key long, lead_mark long, lead_start long")


class SuffixOrder:
    """Strings of ``span`` bytes at places of a text, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, span: int):
        self.data, self.span = data, span
        self.prefix = prefix_hashes(data, 0)
        self.back = powers(0, len(data) + 1)[1]
        eight = np.concatenate([data, np.zeros(8, np.uint8)])
        self.head = sum((eight[k : k + len(data)].astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(8)), np.zeros(len(data), np.uint64))

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the strings at ``at``, which stand in the text as a whole."""
        with np.errstate(over="ignore"):
            return (self.prefix[at + self.span] - self.prefix[at]) * self.back[at]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of two strings whose first eight bytes agree, up to ``span``: binary search over lengths, for those that differ."""
        low = np.full(len(x), self.span)
        k = np.flatnonzero(self.whole(x) != self.whole(y))
        if len(k):
            low[k] = self.differing(x[k], y[k])
        return low

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """As ``common``, for strings that differ."""
        low, high = np.full(len(x), 8), np.full(len(x), self.span - 1)
        with np.errstate(over="ignore"):
            while True:
                live = low < high
                if not live.any():
                    return low
                mid = (low + high + 1) >> 1
                same = (self.prefix[x + mid] - self.prefix[x]) * self.back[x] == (self.prefix[y + mid] - self.prefix[y]) * self.back[y]
                low, high = np.where(live & same, mid, low), np.where(live & ~same, mid - 1, high)

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = self.common(x, y)
        ends = n >= self.span
        n = np.minimum(n, self.span - 1)
        return ~ends & (self.data[x + n] < self.data[y + n])

    def sort(self, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, segment): the strings at places ``at`` by group and content; segments have one group and equal first bytes."""
        head = self.head[at]
        order = np.lexsort((head, group))
        g, h = group[order], head[order]
        segment = np.cumsum(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])) - 1
        size = np.bincount(segment)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        width = 1
        while width < size.max():
            own = np.flatnonzero(size[segment] > width)  # what still has runs to merge
            s = segment[own]
            begin, inside = start[s], own - start[s]
            run = begin + inside // (2 * width) * (2 * width)
            middle = np.minimum(run + width, begin + size[s])
            stop = np.minimum(run + 2 * width, begin + size[s])
            left = own < middle
            low, high = np.where(left, middle, run), np.where(left, stop, middle)
            base = low.copy()
            x = at[order[own]]
            while (live := np.flatnonzero(low < high)).size:
                mid = (low[live] + high[live]) >> 1
                y = at[order[mid]]
                # Elements of the left run go before equal ones of the right run.
                before = np.where(left[live], self.less(y, x[live]), ~self.less(x[live], y))
                low[live], high[live] = np.where(before, mid + 1, low[live]), np.where(before, high[live], mid)
            new = np.where(left, own, run + own - middle) + low - base
            moved = order.copy()
            moved[new] = order[own]
            order = moved
            width *= 2
        return order, segment

    def equal_next(self, at: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """For sorted strings, whether each but the last equals the next one; hash equality is verified on the bytes."""
        out = segment[1:] == segment[:-1]
        k = np.flatnonzero(out)
        k = k[self.common(at[k], at[k + 1]) >= self.span]
        out[:] = False
        for lo in range(0, len(k), 1 << 15):
            some = k[lo : lo + (1 << 15)]
            reach = np.arange(self.span)
            out[some] = (self.data[at[some][:, None] + reach] == self.data[at[some + 1][:, None] + reach]).all(axis=1)
        return out


def shared(group: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the values that stand more than once in their group, in order."""
    with np.errstate(over="ignore"):
        h = mixed(h ^ mixed(group.view(np.uint64)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    return np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])])


def covered(group: np.ndarray, key: np.ndarray, mark: np.ndarray, place: np.ndarray, texts: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """(key, mark, start, stop) of spans covered by strings that occur earlier in a region of the same group."""
    first, count = place_start(place), place_count(place)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
    member = np.repeat(np.arange(len(texts)), count)
    step = np.arange(len(member)) - np.repeat(np.cumsum(count) - count, count)
    at, start = begin[member] + step, first[member] + step
    strings = SuffixOrder(data, span)
    # Equal strings have equal hashes: what shares its hash with no other of its group repeats nothing and is not sorted.
    some = shared(group[member], strings.whole(at))
    member, step, at, start = member[some], step[some], at[some], start[some]
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    order, segment = strings.sort(at, group[member])
    same = np.concatenate([[False], strings.equal_next(at[order], segment)])
    kind = np.empty(len(at), np.int64)
    kind[order] = np.cumsum(~same)
    # The earliest of each kind stays.
    order = np.lexsort((start, mark[member], key[member], kind))
    new = np.concatenate([[True], kind[order][1:] != kind[order][:-1]])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    gone = (key[member[order]] != key[member[lead]]) | (start[order] != start[lead]) | (mark[member[order]] != mark[member[lead]])
    out = np.sort(order[gone])  # by member and step
    if not len(out):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    new = np.concatenate([[True], (member[out][1:] != member[out][:-1]) | (step[out][1:] != step[out][:-1] + 1)])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(out) - 1)
    return key[member[out[new]]], mark[member[out[new]]], start[out[new]], start[out[last]] + span


def digest(part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16).digest()


#: What is wanted of a text: an open region's bytes, an open region string by string, or a span's digest.
OPEN, STRINGS, DIGEST = 1, 2, 3


def cut_out(packed: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """``kind, anchor, region, key, mark, place, n, part`` for the rows ``key, mark, kind, anchor, place, n`` of ``wanted``, from the texts of ``packed``.

    Regions by their bytes. Strings as rows for ``settle``, by two halves of their digest; those that a task has met before are settled, without a half. Spans by
    their digest. Equal rows of ``wanted`` count once.
    """
    names = ["kind", "anchor", "region", "key", "mark", "place", "n", "part"]

    def batch(kind: int, rows: list[tuple]) -> pa.RecordBatch:
        """Rows (anchor, key, mark, place, n, part)."""
        a, key, mark, place, n, part = ([r[k] for r in rows] for k in range(6))
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in (a, [None] * len(rows), key, mark, place, n)), pa.array(part, pa.binary())], names)

    def strings(held: list[tuple[bytes, int, int, int]]) -> Iterator[pa.RecordBatch]:
        halves = np.frombuffer(b"".join(h[0] for h in held), "<u8").reshape(-1, 2)
        key, mark, start = np.array([h[1:] for h in held], dtype=np.int64).T
        one = lambda x: pack_place(x, np.zeros(len(x), bool), np.ones(len(x), np.int64))
        columns, new, again, _ = _classes([halves[:, 0].copy(), halves[:, 1].copy(), key, mark, one(start)])
        texts, doc = np.unique(np.stack([columns[2], columns[3]]), axis=1, return_inverse=True)
        doc, start = doc.reshape(-1)[again], place_start(columns[4][again])
        # Each string for itself: it need not repeat what its neighbour does.
        doc, start, n, *_ = joined_runs(doc, start, np.ones(len(doc), np.int64), np.zeros(len(doc), np.int64), start)
        for b in _rows(_settled(texts[0][doc], texts[1][doc], start, n), [c[new] for c in columns]):
            blank = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, STRINGS, np.int32)), *b.columns, blank, pa.nulls(b.num_rows, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        held: list[tuple[bytes, int, int, int]] = []
        for b in batches:
            for key, mark, packed_text, those in zip(*(b.column(k).to_pylist() for k in range(4))):
                text, rows = unzip(packed_text), {OPEN: [], DIGEST: []}
                for kind, anchor, place, n in (x.values() for x in those):
                    start = place_start(place)
                    stop = start + (place_count(place) if kind != DIGEST else n) + span - 1
                    if kind == STRINGS:
                        held += [(digest(text[i : i + span]), key, mark, i) for i in range(start, stop - span + 1)]
                    else:
                        rows[kind].append((anchor, key, mark, place, n, text[start:stop] if kind == OPEN else digest(text[start:stop])))
                yield from (batch(kind, some) for kind, some in rows.items() if some)
                if len(held) >= DEAL_STRINGS:
                    yield from strings(held)
                    held = []
        if held:
            yield from strings(held)

    lists = wanted.groupBy("key", "mark").agg(F.collect_set(F.struct("kind", "anchor", "place", "n")).alias("those"))
    joined = packed.select("key", "mark", "packed").join(lists, ["key", "mark"]).select("key", "mark", "packed", "those")
    return joined.mapInArrow(tidied(run), "kind int, anchor long, region long, key long, mark long, place long, n long, part binary")


def spans(texts: DataFrame, packed: DataFrame, span: int, wide: int = WIDE, attempt: int = 0) -> DataFrame:
    """``key, mark, found``: for each document with repeats, the list of (start, stop) to remove."""
    found = materialize(settle(deal(texts, span, attempt)))
    opens = found.where("open").select("key", "mark", "anchor", "place")
    many = materialize(opens.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > wide))
    kind = F.when(F.col("n").isNull(), OPEN).otherwise(STRINGS).alias("kind")
    wanted = opens.join(many, "anchor", "left").select("key", "mark", kind, "anchor", "place", F.lit(0).cast("long").alias("n"))
    whole = materialize(whole_spans(found))
    at = lambda c: F.shiftleft(F.col(c), COUNT_BITS + 1)
    both = whole.select("key", "mark", at("start").alias("place"), "n").unionByName(whole.select(F.col("lead_key").alias("key"), F.col("lead_mark").alias("mark"), at("lead_start").alias("place"), "n"))
    asked = both.select("key", "mark", F.lit(DIGEST).alias("kind"), F.lit(0).cast("long").alias("anchor"), "place", "n")
    parts = materialize(cut_out(packed, wanted.unionByName(asked), span))

    digests = parts.where(F.col("kind") == DIGEST).select("key", "mark", F.shiftright("place", COUNT_BITS + 1).alias("start"), "n", "part")
    lead = digests.select(F.col("key").alias("lead_key"), F.col("mark").alias("lead_mark"), F.col("start").alias("lead_start"), "n", F.col("part").alias("lead_part"))
    checked = whole.join(digests, ["key", "mark", "start", "n"], "left").join(lead, ["lead_key", "lead_mark", "lead_start", "n"], "left")
    if not checked.where(~F.coalesce(F.col("part") == F.col("lead_part"), F.lit(False))).isEmpty():
        return spans(texts, packed, span, wide, attempt + 1)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, key, mark, place, cut in runs(batches, SORT_STRINGS // 50):
            made = covered(anchor.to_numpy(), key.to_numpy(), mark.to_numpy(), place.to_numpy(), cut, span)
            yield pa.RecordBatch.from_arrays([*map(_long, made)], ["key", "mark", "start", "stop"])

    own = parts.where(F.col("kind") == OPEN).select("anchor", "key", "mark", "place", "part")
    ends = own.repartition("anchor").sortWithinPartitions("anchor", "key", "mark", "place").mapInArrow(tidied(sort), "key long, mark long, start long, stop long")
    start = F.shiftright("place", COUNT_BITS + 1)
    count = F.col("place").bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    placed = lambda df: df.select("key", "mark", start.alias("start"), (start + count + (span - 1)).alias("stop"))
    strings = settle(parts.where(F.col("kind") == STRINGS).select("anchor", "region", "key", "mark", "place")).where("NOT open")
    every = ends.unionByName(placed(found.where("NOT open AND lead_key IS NULL"))).unionByName(placed(strings))
    every = every.unionByName(whole.select("key", "mark", "start", (F.col("start") + F.col("n") + (span - 1)).alias("stop")))
    return every.groupBy("key", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("found"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((f["start"], f["stop"]) for f in found or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole_characters(text: bytes, gone: list[tuple[int, int]]) -> str:
    """What spans leave of a UTF-8 text; of a character that a span cuts, the rest goes as well."""
    kept, at = [], 0
    for start, stop in gone:
        while start > at and start < len(text) and text[start] & 0xC0 == 0x80:
            start -= 1
        kept.append(text[at:start] if start > at else b"")
        at = max(at, stop)
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
    return b"".join([*kept, text[at:]]).decode()


def remove_repeats(docs: DataFrame, span: int = 100, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False, others: list[str] | None = None, wide: int = WIDE) -> DataFrame:
    """``id_column, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_text``, the remaining bytes ``kept`` and whole characters ``kept_text``; columns named in ``others`` come along.

    Removes each byte covered by a string of ``span`` bytes (from 32 to some 4 million) that also starts earlier: in a row of smaller id, or earlier in the same
    row. Ids are whole numbers; a null id stays null and is smaller than others. A null or empty text has no bytes. Rows that share an id but not the text
    are different documents, ordered by 64-bit hashes of their texts. Repeated rows (same id and text) do not count against each other and all get the
    result of one. An empty table gives no rows; other columns of any name are not read. ``wide`` is a bound on what a task sorts together; results do not depend on it.
    """
    if not GRAM <= span < 1 << (COUNT_BITS - 1):
        raise ValueError(f"a span has {GRAM} to {(1 << (COUNT_BITS - 1)) - 1} bytes")
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))
    named = docs.select(key.alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("others"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches):
            raw = [t.encode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(text_mark, raw), pa.int64()), pa.array(map(zip_, raw), pa.binary()), b.column(2)], ["key", "mark", "packed", "others"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for b in slices(batches):
            rows = []
            for packed_text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text, at, kept = unzip(packed_text), 0, []
                gone = merged(found)
                for start, stop in gone:
                    kept.append(text[at:start])
                    at = stop
                kept = b"".join([*kept, text[at:]])
                rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, whole_characters(text, gone) if keep_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary(), pa.string()] * keep_text
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)), b.column(3)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "kept_text"] * keep_text + ["others"])

    kind = dict(named.dtypes)["others"]
    packed = named.mapInArrow(tidied(squeeze), f"key long, mark long, packed binary, others {kind}")
    extra = ", kept binary, kept_text string" * keep_text + f", others {kind}"
    found = spans(named.select("key", "text"), packed, span, wide)
    done = packed.join(found, ["key", "mark"], "left").select("key", "packed", "found", "others").mapInArrow(tidied(finish), f"key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
    back = F.when(F.col("key") != -(2**63), F.col("key")).cast(dict(docs.dtypes)[id_column])
    return done.select(back.alias(id_column), *[c for c in done.columns if c not in ("key", "others")], *[F.col(f"others.{c}").alias(c) for c in others or []])
