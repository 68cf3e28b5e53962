"""String similarities that Spark lacks, worked out over whole Arrow batches with numpy.

All functions take aligned lists of strings. Strings become rows of a matrix of code points, and every step runs over all pairs of a
batch at once. Pairs that occur twice in a batch are worked out once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that fit into one machine word of the subsequence search; longer strings take whole numbers of any size.
WORD = 63
#: Pairs that are worked out together: bounds the matrices.
BLOCK = 1 << 16


def _matrix(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, zero behind each end; lengths)."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    wide = max(int(sizes.max(initial=0)), 1)
    return np.array([s.ljust(wide, "\0") for s in strings], dtype=f"<U{wide}").view(np.uint32).reshape(len(strings), wide), sizes


def _long_subsequence(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def common_subsequence(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences: rows of the table as bits of one word, all pairs in step."""
    out = np.zeros(len(a), np.int64)
    # The shorter string's characters are the bits.
    a, b = [x if len(x) <= len(y) else y for x, y in zip(a, b)], [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    sizes = np.fromiter(map(len, a), np.int64, len(a))
    for k in np.flatnonzero(sizes > WORD):
        out[k] = _long_subsequence(a[k], b[k])
    # By length of the longer string, so that few pairs wait for others.
    order = np.flatnonzero((sizes <= WORD) & (sizes > 0))
    order = order[np.argsort([len(b[k]) for k in order], kind="stable")]
    for lo in range(0, len(order), BLOCK // 8):
        own = order[lo : lo + BLOCK // 8]
        x, n = _matrix([a[k] for k in own])
        y, _ = _matrix([b[k] for k in own])
        letters, number = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
        masks = np.zeros((len(own), len(letters)), np.uint64)
        rows, xs, ys = np.arange(len(own)), number[: x.size].reshape(x.shape), number[x.size :].reshape(y.shape)
        for i in range(x.shape[1]):
            inside = rows[n > i]
            masks[inside, xs[inside, i]] |= np.uint64(1 << i)
        full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
        row = full.copy()
        for j in range(y.shape[1]):
            # Behind an end no bit of the string stands, so the row stays as it is.
            u = row & masks[rows, ys[:, j]]
            row = ((row + u) | (row - u)) & full
        out[own] = n - np.bitwise_count(row).astype(np.int64)
    return out


def ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """100 times twice the common subsequence over the sum of lengths; 100 for two empty strings."""
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), np.int64, len(a))
    return np.where(total > 0, 200.0 * common_subsequence(a, b) / np.maximum(total, 1), 100.0)


def token_sort_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    tidy = lambda x: " ".join(sorted(x.split()))
    return ratio([tidy(x) for x in a], [tidy(x) for x in b])


def token_set_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Best ratio among the shared tokens and the shared tokens with either rest; 0 if either is empty."""
    both, one, two, fixed = [], [], [], np.full(len(a), np.nan)
    for k, (x, y) in enumerate(zip(a, b)):
        x, y = set(x.split()), set(y.split())
        shared = " ".join(sorted(x & y))
        left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
        if not x or not y:
            fixed[k] = 0.0
        elif shared and (not left or not right):
            fixed[k] = 100.0
        both.append(shared)
        one.append(f"{shared} {left}".strip())
        two.append(f"{shared} {right}".strip())
    some = np.array([bool(x) for x in both])
    best = np.maximum(ratio(one, two), np.where(some, np.maximum(ratio(both, one), ratio(both, two)), 0.0))
    return np.where(np.isnan(fixed), best, fixed)


def partial_ratio(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Best ratio of the shorter string against the windows of the longer one, shorter at its ends; of equally long ones, either against the other's."""
    out = np.zeros(len(a))
    owner, left, right = [], [], []

    def flush() -> None:
        np.maximum.at(out, owner, ratio(left, right))
        for x in (owner, left, right):
            x.clear()

    for k, (x, y) in enumerate(zip(a, b)):
        if not x or not y:
            out[k] = 100.0 if x == y else 0.0
            continue
        if x in y or y in x:
            out[k] = 100.0
            continue
        for short, long in [(x, y) if len(x) <= len(y) else (y, x)] + [(y, x)] * (len(x) == len(y)):
            n = len(short)
            windows = {long[max(0, j) : j + n] for j in range(1 - n, len(long))}
            owner += [k] * len(windows)
            left += [short] * len(windows)
            right += windows
        if len(owner) >= BLOCK:
            flush()
    if owner:
        flush()
    return out


def jaro_winkler(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Jaro similarity, with a bonus for up to four equal first characters above 0.7; 1 for two empty strings."""
    out = np.zeros(len(a))
    for lo in range(0, len(a), BLOCK // 16):
        x, n = _matrix(a[lo : lo + BLOCK // 16])
        y, m = _matrix(b[lo : lo + BLOCK // 16])
        rows, reach = np.arange(len(x)), np.maximum(np.maximum(n, m) // 2 - 1, 0)
        place = np.arange(y.shape[1])
        taken, mine = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
        for i in range(x.shape[1]):
            # The first character of the other side that is near enough and not taken yet.
            free = (y == x[:, i : i + 1]) & ~taken & (np.abs(place - i) <= reach[:, None]) & (place < m[:, None]) & (i < n)[:, None]
            j = free.argmax(axis=1)
            hit = free[rows, j]
            taken[rows[hit], j[hit]] = True
            mine[:, i] = hit
        count = mine.sum(axis=1)
        # The taken characters of each side, in order, one under the other.
        first, second = np.zeros((2, len(x), max(int(count.max(initial=0)), 1)), np.uint32)
        r, c = np.nonzero(mine)
        first[r, np.cumsum(mine, axis=1)[r, c] - 1] = x[r, c]
        r, c = np.nonzero(taken)
        second[r, np.cumsum(taken, axis=1)[r, c] - 1] = y[r, c]
        swaps = (first != second).sum(axis=1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(count > 0, (count / n + count / m + (count - swaps) / count) / 3, 0.0)
        four = min(4, x.shape[1], y.shape[1])
        prefix = np.cumprod((x[:, :four] == y[:, :four]) & (x[:, :four] > 0), axis=1).sum(axis=1)
        value = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
        out[lo : lo + len(x)] = np.where((n == m) & (n == 0), 1.0, value)
    return out


FUNCTIONS: dict[str, Callable[[Sequence[str], Sequence[str]], np.ndarray]] = {
    "ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "partial": partial_ratio, "jaro_winkler": jaro_winkler,
}


def compare(name: str, x: pd.Series, y: pd.Series) -> pd.Series:
    """A function of this module over two columns; null if either side is."""
    codes, pairs = pd.MultiIndex.from_arrays([x, y]).factorize()
    known = np.array([isinstance(p, str) and isinstance(q, str) for p, q in pairs], bool)
    values = np.full(len(pairs), np.nan)
    if known.any():
        left, right = zip(*(p for p, k in zip(pairs, known) if k))
        values[known] = FUNCTIONS[name](left, right)
    return pd.Series(values[codes]).astype("Float64").where(known[codes])


def similarity(name: str, a: Column, b: Column) -> Column:
    """One of the functions above as a column; null if either side is."""
    return F.pandas_udf(lambda x, y: compare(name, x, y), "double")(a, b)


def similarities(wanted: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct of similarities, each by (function, left, right), from one pass over the rows; strings go to Python once."""
    names = list(wanted)

    def run(*columns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({n: compare(wanted_functions[k], columns[2 * k], columns[2 * k + 1]) for k, n in enumerate(names)})

    wanted_functions = [f for f, _, _ in wanted.values()]
    run.__annotations__ = {}
    return F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(*[c for _, x, y in wanted.values() for c in (x, y)])
