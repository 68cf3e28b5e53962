"""Operator 4: byte-pair encoding by speculation and verification, and decoding.

A word is first cut greedily into its longest vocabulary entries. Byte-pair encoding is local: a token
sequence is the encoding of its text exactly when every adjacent pair of its tokens encodes to itself.
So all adjacent pairs of all new words of a batch are tested together with numpy, and only words with a
failing pair (or with a token that is not its own encoding) go through the exact merge loop.

Results are kept per white-space-delimited word in a bounded cache of each Python worker; no state is
shared between tasks, so a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and units of words kept by a Python worker; the cache is emptied when it is full.
CACHE_WORDS = 400_000
#: Symbols of a word up to which plain lists are faster than a heap; both give the same.
SHORT = 48


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def lower_each(text: str) -> str:
    """Lower case of each character by itself: a capital sigma has no final form."""
    return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))


class WordBpe:
    """Encoder of a word-end vocabulary file: NFC, white space dropped, lower case, ``</w>`` on word ends."""

    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    SPACE = regex.compile(r"\s+")
    #: White space to ``str.split`` alone.
    SEPARATORS = regex.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        # The longest entry by its first three characters; whatever begins with no such three is shorter.
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            bare = t.removesuffix(self.end) if t != self.end else t
            if len(bare) > 2:
                self.longest[bare[:3]] = max(len(bare), self.longest.get(bare[:3], 0))
        self.alphabet = byte_alphabet()
        self.id_texts = {i: str(i) for i in self.names}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        size = max(self.names) + 1
        # How each token was made: its two parts and the rank of that merge; base symbols have no parts.
        self.left, self.right, self.made = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        joined = []
        for r, (a, b) in enumerate(merges):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            joined.append((i << 32 | j, r))
            if self.made[k] < 0:
                self.left[k], self.right[k], self.made[k] = i, j, r
        joined.sort()
        self.pair_keys = np.array([k for k, _ in joined], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in joined], dtype=np.int64)
        self.own: dict[int, bool] = {}
        self.words: dict[str, tuple[int, str, str]] = {}
        self.exact_words = 0

    def exact(self, symbols: list[str]) -> list[str]:
        """The merge loop: join the leftmost pair of lowest rank until none is left."""
        return self.exact_short(symbols) if len(symbols) <= SHORT else self.exact_long(symbols)

    def exact_short(self, symbols: list[str]) -> list[str]:
        none, get = len(self.rank), self.rank.get
        ranks = [get(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((symbols[i], symbols[i + 1]), none)
            if i:
                ranks[i - 1] = get((symbols[i - 1], symbols[i]), none)
        return symbols

    def exact_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs by rank and place, and symbols linked to their neighbours: n symbols take n log n steps."""
        get, n = self.rank.get, len(symbols)
        queue = [(r, i, i + 1) for i, p in enumerate(zip(symbols, symbols[1:])) if (r := get(p)) is not None]
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            rank, i, j = heapq.heappop(queue)
            # Stale unless both still begin where they did and make the pair of this rank.
            if after[i] != j or j >= n or not symbols[i] or not symbols[j] or get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, k))
            if (k := before[i]) >= 0 and (r := get((symbols[k], symbols[i]))) is not None:
                heapq.heappush(queue, (r, k, i))
        return [s for s in symbols if s]

    def symbols(self, unit: str) -> list[str]:
        """The base symbols of ``unit``, a string over the byte alphabet."""
        return [*unit[:-1], unit[-1] + self.end]

    def is_own(self, token: int) -> bool:
        """Whether the text of ``token`` encodes to that one token."""
        if (known := self.own.get(token)) is None:
            name = self.names[token]
            ended = bool(self.end) and name.endswith(self.end) and name != self.end
            base = self.symbols(name.removesuffix(self.end)) if ended else list(name)
            known = self.own[token] = self.exact(base) == [name]
        return known

    def greedy(self, unit: str) -> list[int]:
        """Longest match first, from the left."""
        out, at, n = [], 0, len(unit)
        while at < n:
            stop = min(n, at + self.longest.get(unit[at : at + 3], 2))
            found = self.vocab.get(unit[at:stop] + self.end) if stop == n else None
            if found is None:
                stop = min(stop, n - 1) if stop == n and n - at > 1 else stop
                while (found := self.vocab.get(unit[at:stop] if stop < n else unit[at:stop] + self.end)) is None:
                    stop -= 1
            out.append(found)
            at = stop
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether no merge crosses the seam between them.

        Takes the merges on both sides back, latest first; the merge of what then touches at the seam
        must not come before the merge that was taken back last.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        good, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        limit, from_left = np.full(len(a), len(self.rank), dtype=np.int64), np.zeros(len(a), dtype=bool)
        while len(live):
            keys = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], len(self.rank))
            # A merge inside the left token comes before an equal one at the seam, one inside the right token after it.
            crosses = (rank < limit) | ((rank == limit) & ~from_left & (rank < len(self.rank)))
            good[live[crosses]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~crosses & ((made_a >= 0) | (made_b >= 0))
            # Of equal merges the left one was applied first, so the right one is taken back first.
            undo_a = go & (made_a > made_b)
            undo_b = go & ~undo_a
            limit, from_left = np.where(undo_a, made_a, made_b), undo_a
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            live, a, b, limit, from_left = live[go], a[go], b[go], limit[go], from_left[go]
        return good

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Speculate on all units, verify all adjacent pairs at once, and merge exactly where a check fails."""
        proposed = [self.greedy(u) for u in units]
        flat = np.fromiter((t for p in proposed for t in p), dtype=np.int64)
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, proposed), dtype=np.int64, count=len(units)))
        bad = np.zeros(len(units), dtype=bool)
        tokens, inverse = np.unique(flat, return_inverse=True)
        own = np.fromiter((self.is_own(int(t)) for t in tokens), dtype=bool, count=len(tokens))
        if len(flat):
            bad[owner[~own[inverse]]] = True
        inside = owner[1:] == owner[:-1]
        pairs, inverse = np.unique(flat[:-1][inside] << 32 | flat[1:][inside], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        if len(pairs):
            bad[owner[1:][inside][~fits[inverse]]] = True
        for k in np.flatnonzero(bad):
            proposed[k] = [self.vocab[s] for s in self.exact(self.symbols(units[k]))]
            self.exact_words += 1
        return proposed

    def pieces(self, text: str) -> list[tuple[bool, list[str]]]:
        """The text as (is special, words): control strings first, then white-space-delimited words."""
        out = []
        for k, part in enumerate(self.split_special.split(text)):
            if k % 2:
                out.append((True, [part]))
            elif part:
                plain = lower_each(part if part.isascii() else unicodedata.normalize("NFC", part))
                out.append((False, self.SPACE.sub(" ", plain).split(" ") if self.SEPARATORS.search(plain) else plain.split()))
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words that the cache lacks, all together; a word is one or more units. Units are kept as words, as each encodes as the word that it is."""
        known = self.words
        cut = {w: self.WORDS.findall(w) for w in words if not w.isalpha()}
        new = [*{w for w in words if w.isalpha()}.union(u for units in cut.values() for u in units if u not in known)]
        # Bytes as characters of the same number, then as their stand-ins.
        encoded = self.encode_units([u.encode().decode("latin-1").translate(self.alphabet) for u in new])
        name, text = self.names.__getitem__, self.id_texts.__getitem__
        for u, ids in zip(new, encoded):
            known[u] = (len(ids), " ".join(map(text, ids)), " ".join(map(name, ids)))
        for w, units in cut.items():
            if len(units) != 1:
                n, ids, names = zip(*map(known.__getitem__, units)) if units else ((), (), ())
                known[w] = (sum(n), " ".join(ids), " ".join(names))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of tokens, decimal ids joined by a space, decoded text."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        todo = [self.pieces(t) for t in texts]
        known = self.words
        self.learn({w for text in todo for special, words in text if not special for w in words if w not in known})
        for text in todo:
            found = []
            for special, words in text:
                found += [(1, str(self.special[words[0]]), words[0])] if special else map(known.__getitem__, words)
            n, ids, names = zip(*found) if found else ((), (), ())
            yield sum(n), " ".join(filter(None, ids)), " ".join(x for x, k in zip(names, n) if k) if 0 in n else " ".join(names)


@functools.lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """The encoder of a vocabulary file, loaded once in a Python worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", keep_texts: bool = False, block: int = 256) -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns ``id_column, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_texts``, the ids joined by
    spaces (``ids``) and the ``decoded`` text. A null or empty text has no tokens, and both digests are those
    of the empty string; a null id stays null; repeated rows give repeated rows; other columns of any name
    are not read. Rows are handled ``block`` at a time, whatever their length.
    """
    extra = ", ids string, decoded string" if keep_texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                got = list(encoder.encode_batch([t or "" for t in batch.column(1).to_pylist()]))
                columns = [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([sha(g[1]) for g in got], pa.string()), pa.array([sha(g[2]) for g in got], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_texts:
                    columns += [pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_column]
    plain = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}").withColumnRenamed("doc_id", id_column)
