"""Corpus operators against brute force, on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reclink.llm import bpe, chat, media, packing, pii, quality, queries, sentences, sharding, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, key string"
WORD = r"[^\x20\x09-\x0D]+"


def corpus():
    r = random.Random(5)
    stock = ["the", "of", "Aner", "thond", "été", "straße", "erwh.", "Ou,", "漢字", "42", "b@x.org", "😀"]
    text = lambda n: " ".join(r.choice(stock) + str(r.randint(0, 400)) * r.randint(0, 1) for _ in range(n))
    base = [text(r.randint(1, 150)) for _ in range(40)]
    near = [b.replace(b.split()[len(b.split()) // 2], "swapped", 1) for b in base[:8]]
    passage = text(60)
    shared = [text(20) + ". " + passage + "\n" + text(30) for _ in range(4)]
    odd = ["", " ", "\n\n", "a", "ab " * 400, "x" * 5000, "one line\none line\none line", "a <|startoftext|> b <|endoftext|>", "call +44 20 7946 0958 or 10.0.0.1, 4111 1111 1111 1111"]
    texts = base + near + base[:5] + shared + odd + [text(6000)]
    rows = [(k, t, "en", "s", len(t), 1, "z") for k, t in enumerate(texts)]
    return rows + [(len(rows), None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """A null id and a repeated row."""
    return spark.createDataFrame([(*x, *[None] * 5) for x in AWKWARD], SCHEMA)


AWKWARD = [(None, "alone here with words"), (7, "twice"), (7, "twice")]


def per_row(df, *columns):
    """Rows by id as text, as null ids do not sort."""
    return sorted((repr(r["doc_id"]), *(r[c] for c in columns)) for r in df.collect())


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


LABELS = "doc_id long, quality int, toxic int"


def test_quality(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(quality, "TOXIC_LEAST", 1.0)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(45, 0, 1), (46, 0, 1), (53, 1, 1), (54, 1, 1), (55, 1, 1), (56, 1, 1), (None, 1, 0), (49, None, None)], LABELS)
    good_ids, toxic_ids = {*range(30)}, {45, 46, 53, 54, 55, 56}
    got = by_id(quality.quality(docs, labels, threshold=-0.04))
    half = lambda k: spark_hash(b"half", k) % 2
    raw, good = collections.Counter(), [collections.Counter(), collections.Counter()]
    fine, toxic = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    grams = {}
    for k, t, *_ in rows:
        u = [spark_hash(x.encode()) for x in re.findall(WORD, t or "")]
        grams[k] = u + [spark_hash(x, y) for x, y in zip(u, u[1:])]
        coarse = [x % quality.BUCKETS for x in grams[k]]
        raw.update(coarse)
        good[half(k)].update(coarse if k in good_ids else [])
        fine[half(k)].update([x % quality.TOXIC_BUCKETS for x in grams[k]] if k in good_ids else [])
        toxic[half(k)].update([x % quality.TOXIC_BUCKETS for x in grams[k]] if k in toxic_ids else [])
    every = sum(raw.values())

    def score(c, h):
        b = h % quality.BUCKETS
        return np.log((c[b] + quality.SMOOTHING * raw[b] / every) / (sum(c.values()) + quality.SMOOTHING)) - np.log(raw[b] / every)

    def toxicity(c, g, h):
        b = h % quality.TOXIC_BUCKETS
        return float(np.log((c[b] + quality.TOXIC_PRIOR) / (g[b] / sum(g.values()) * sum(c.values()) + quality.TOXIC_PRIOR)) >= quality.TOXIC_LEAST)

    mean = lambda k, ratio: sum(round(quality.SCALE * ratio(h)) for h in grams[k]) / (len(grams[k]) * quality.SCALE) if grams[k] else 0.0
    for k, t, *_ in rows:
        w = re.findall(WORD, t or "")
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(runs)
        covered = {j for i, x in enumerate(runs) if count[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed
        )
        g, f, x = good[1 - half(k)], fine[1 - half(k)], toxic[1 - half(k)]
        assert got[k]["score"] == pytest.approx(mean(k, lambda h: score(g, h)), abs=2e-6)
        assert got[k]["toxicity"] == pytest.approx(mean(k, lambda h: toxicity(x, f, h)), abs=2e-6)
        assert not (failed and got[k]["kept"])
    assert any(r["toxicity"] > 0 for r in got.values())
    # Labels without bad documents give no cut, so the given threshold counts; without one all that the base rules keep is kept.
    some = labels.where("quality = 1")
    for threshold in (-0.04, 0.01):
        found = quality.quality(docs, some.where("toxic = 0"), threshold=threshold).collect()
        assert all(r["kept"] == (not r["base_failed"] and r["score"] >= threshold) for r in found)
    assert all(r["kept"] != r["base_failed"] for r in quality.quality(docs, some.where("toxic = 0")).collect())
    assert quality.quality(empty(spark), spark.createDataFrame([], LABELS)).count() == 0
    assert quality.quality(empty(spark), labels).count() == 0


def test_quality_scores_once(spark, docs, monkeypatch):
    """The word arrays of labelled documents are not worked out a second time for the cuts, nor again by a filter on the verdict."""
    calls, scored = [], quality.scored
    monkeypatch.setattr(quality, "scored", lambda *a: calls.append(a) or scored(*a))
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(50)], LABELS)
    got = quality.quality(docs, labels, keep=["text"]).where("kept")
    assert len(calls) == 1 and "xxhash64" not in got._jdf.queryExecution().optimizedPlan().toString()
    full = by_id(quality.quality(docs, labels))
    assert {r["doc_id"] for r in got.collect()} == {k for k, r in full.items() if r["kept"]}


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_quality_out_of_sample(spark, size):
    """With half of the labels, clean documents of the other half stay; without labels the base rules alone decide."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{size}/{name}.parquet") for name in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2)) == 0
    got = by_id(quality.quality(docs, labels.where(seen)).select("doc_id", "base_failed", "kept"))
    kept = lambda which: [got[r["doc_id"]]["kept"] for r in labels.where(which).collect() if not got[r["doc_id"]]["base_failed"]]
    clean, bad = kept(~seen & F.expr("quality = 1 AND toxic = 0")), kept("quality = 0")
    assert sum(clean) >= 0.95 * len(clean) and len(clean) > 25
    assert sum(bad) <= 0.75 * len(bad)
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.quality(docs, labels.where("false")).select("base_failed", "kept").collect())


def test_quality_toxic(spark):
    """Toxic documents in good prose go by a ratio of their own."""
    r = random.Random(6)
    prose = lambda: [f"word{r.randint(0, 300)}" for _ in range(120)]
    texts = {k: " ".join(prose() + ([f"slur{r.randint(0, 20)}" for _ in range(30)] if k % 4 == 0 else [])) for k in range(240)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(120)], LABELS)
    got = by_id(quality.quality(docs, labels, threshold=-1.0).select("doc_id", "kept"))
    assert {k: got[k]["kept"] for k in texts} == {k: k % 4 != 0 for k in texts}
    assert quality.cut_between([1.0, 2.0, 3.0], [0.0, 0.5]) == 0.75
    assert quality.cut_between([1.0], []) == quality.cut_between([1.0], [2.0]) == -np.inf


def test_quality_uses_every_label(spark, monkeypatch):
    """The ratios rest on all labelled documents, however many, and a shuffle joins them as a broadcast does."""
    n = 30_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('common w', id % 7, ' u', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "cast(1 AS long) AS quality", "cast(0 AS long) AS toxic")
    ratios = []
    for bound in (quality.BROADCAST_LABELS, 0):
        monkeypatch.setattr(quality, "BROADCAST_LABELS", bound)
        own = quality.labelled_texts(docs, labels)
        assert own.count() == n and own.where("good = 1 AND bad IS NULL AND toxic IS NULL").count() == n
        ratios.append(quality.log_ratios(docs, own))
    assert ratios[0] == ratios[1]
    # Five n-grams a document, of both halves: with every document trusted the counts of the halves add up to those of all.
    of = {f"good{k}": F.when(quality.half(F.col("doc_id")) == k, F.col("good")) for k in (0, 1)}
    assert quality.counted(own, 100, of).selectExpr("sum(n) AS n", "sum(good0 + good1) AS g").first() == (5 * n, 5 * n)


def brute_sentences(rows, run=3):
    """(id, sentences, removed, kept) for every row; equal rows are one, rows of one id go by a hash of the text."""
    mark = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64) * (h >> 63)
    seen, kept = set(), {}
    for _, k, _, t in sorted({(k is not None, k or 0, mark(t or ""), t or "") for k, t in rows}):
        s = [x.strip(" ") for x in re.sub(r"([.!?])[ \t\r]+", "\\1\n", t).split("\n")]
        s = [x for x in s if x]
        gone = set()
        for i in range(max(len(s) - run + 1, min(len(s), 1))):
            if tuple(s[i : i + run]) in seen:
                gone |= {*range(i, min(i + run, len(s)))}
            seen.add(tuple(s[i : i + run]))
        kept[k, t] = (len(s), len(gone), "\n".join(x for i, x in enumerate(s) if i not in gone))
    return sorted((repr(k), *kept[k or 0, t or ""]) for k, t in rows)


def found_sentences(df):
    return sorted((repr(r["doc_id"]), *tuple(r)[1:]) for r in df.collect())


def test_sentences(spark, docs, rows, awkward):
    assert found_sentences(sentences.remove_repeats(docs)) == brute_sentences([r[:2] for r in rows])
    assert found_sentences(sentences.remove_repeats(awkward)) == brute_sentences([tuple(r)[:2] for r in awkward.collect()])
    assert sentences.remove_repeats(empty(spark)).count() == 0


def test_sentences_of_shared_ids(spark, monkeypatch):
    """Rows of one id are documents of their own; hot runs and others give the same."""
    r = random.Random(4)
    text = lambda: " ".join(f"S{r.randint(0, 12)}." for _ in range(r.randint(0, 9)))
    rows = [(r.choice([None, 3, k]), text()) for k in range(1, 60)] + [(1, "A. B. C."), (5, "A. B. C."), (5, "X. Y. Z."), (None, "Alone"), (None, "Alone"), (9, "Alone"), (70, None)]
    docs = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string").repartition(3)
    expected = brute_sentences(rows)
    assert found_sentences(sentences.remove_repeats(docs)) == expected
    import functools

    from reclink.llm import common

    monkeypatch.setattr(sentences, "join_hot", functools.partial(common.join_hot, hot=2))
    assert found_sentences(sentences.remove_repeats(docs)) == expected


def test_media(spark, docs, rows, awkward):
    stored = media.media(docs).cache()
    got, clips = by_id(media.features(stored)), collections.defaultdict(list)
    for r in media.clips(stored).collect():
        clips[r["doc_id"]].append(tuple(r)[1:])
    for k, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        data = media.write_avi(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), sha(data))
        # The film by itself: frames of 24 rows of 64 samples, or fewer rows.
        rows_ = min(24, len(payload) // 64)
        n = -(-len(payload) // (64 * rows_))
        cuts = brute_shots(np.frombuffer(payload.ljust(n * 64 * rows_, b"\0"), np.uint8).reshape(n, -1))
        assert r["feature"] == f"64x{rows_}@25 frames={n} clips=" + ",".join(f"{a}-{b - 1}@{a / 25:.2f}-{b / 25:.2f}" for a, b in cuts)
        assert sorted(clips[k]) == [(i, a, b - a, a / 25, b / 25) for i, (a, b) in enumerate(cuts)]
    assert sorted((repr(r["doc_id"]), r["n_bytes"]) for r in media.features(media.media(awkward)).collect()) == [("7", 5), ("7", 5), ("None", 21)]
    assert media.features(media.media(empty(spark))).count() == 0 and media.clips(media.media(empty(spark))).count() == 0
    assert media.clips(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def brute_shots(frames):
    """Shots by the rule: a change of histogram above 0.25 and above the mean of those before it in the shot by three deviations."""
    n = len(frames)
    hist = [np.bincount(f >> 3, minlength=32) for f in frames]
    out, start, before = [], 0, []
    for k in range(1, n):
        d = np.abs(hist[k] - hist[k - 1]).sum() / (2 * frames.shape[1])
        mean, spread = (np.mean(before), np.std(before)) if before else (0, 0)
        if k - start >= 2 and n - k >= 2 and d > 0.25 and d > mean + 3 * spread + 1e-12:
            out.append((start, k))
            start, before = k, []
        else:
            before.append(d)
    return [*out, (start, n)]


def baseline(frames, quality, restart=0, chroma=None):
    """Baseline JPEG files, by the standard's definitions; ``chroma``: (wide, high) adds two components at that share of the samples."""
    huff = {}  # codes of equal length: 12 lengths of differences, 176 run and size pairs
    for kind, symbols in ((0, range(12)), (1, [16 * a + b for a in range(16) for b in range(11)])):
        size = 4 if kind == 0 else 8
        huff[kind] = ({s: format(i, f"0{size}b") for i, s in enumerate(symbols)}, size, list(symbols))
    steps = np.fromfunction(lambda u, v: 1 + (u + v) * quality, (8, 8))
    cosine = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.125 if u == 0 else 0.25) ** 0.5 for u in range(8)] for x in range(8)])
    zigzag = sorted(np.ndindex(8, 8), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    n, height, width = frames.shape
    seg = lambda mark, body: bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body
    wide, high = chroma or (1, 1)
    parts = [(1, wide * 16 + high)] + ([(2, 0x11), (3, 0x11)] if chroma else [])
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes(int(steps[p]) for p in zigzag))
    head += seg(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([c, s, 0]) for c, s in parts))
    for kind, (_, size, symbols) in huff.items():
        head += seg(0xC4, bytes([kind * 16, *[len(symbols) * (k == size) for k in range(1, 17)], *symbols]))
    head += (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"") + seg(0xDA, bytes([len(parts)]) + b"".join(bytes([c, 0]) for c, _ in parts) + b"\0\x3f\0")
    number = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    files = []
    for frame in frames:
        columns, rows = -(-width // (8 * wide)), -(-height // (8 * high))
        plane = np.pad(frame, ((0, rows * 8 * high - height), (0, columns * 8 * wide - width)), mode="edge").astype(float) - 128
        out, bits, before = b"", "", [0] * 3

        def flush():
            whole = bits + "1" * (-len(bits) % 8)
            return int(whole, 2).to_bytes(len(whole) // 8, "big").replace(b"\xff", b"\xff\0") if whole else b""

        for unit in range(rows * columns):
            if restart and unit and unit % restart == 0:
                out, bits, before = out + flush() + bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]), "", [0] * 3
            for part, (_, _) in enumerate(parts):
                for k in range(wide * high if part == 0 else 1):
                    block = np.zeros((8, 8))
                    if part == 0:
                        y, x = (unit // columns * high + k // wide) * 8, (unit % columns * wide + k % wide) * 8
                        block = np.rint(cosine.T @ plane[y : y + 8, x : x + 8] @ cosine / steps)
                    flat = [int(block[p]) for p in zigzag]
                    d, before[part], run = flat[0] - before[part], flat[0], 0
                    bits += huff[0][0][abs(d).bit_length()] + number(d)
                    last = max((i for i in range(1, 64) if flat[i]), default=0)
                    for v in flat[1 : last + 1]:
                        if v == 0 and run < 15:
                            run += 1
                            continue
                        bits += huff[1][0][16 * run + abs(v).bit_length()] + number(v)
                        run = 0
                    bits += huff[1][0][0] if last < 63 else ""
        files.append(head + out + flush() + b"\xff\xd9")
    return files


@pytest.mark.parametrize(("restart", "chroma"), [(0, None), (2, None), (0, (1, 1)), (0, (2, 2)), (3, (2, 1))])
def test_baseline_frames(restart, chroma):
    y, x = np.mgrid[:21, :37]
    frames = np.stack([128 + 80 * np.sin(x / (4 + k)) * np.cos(y / 7) + k for k in range(3)]).round().astype(np.uint8)
    files = baseline(frames, 0, restart, chroma)
    assert np.abs(media.decode_frames(files).astype(int) - frames).max() <= 2
    rough = media.decode_frames(baseline(frames, 2, restart, chroma)).astype(int)
    assert np.abs(rough - frames).mean() < 4
    # Baseline and lossless frames in one film.
    both = media.decode_frames([*files, *media.encode_frames(frames)])
    assert (both[3:] == frames).all() and np.abs(both[:3].astype(int) - frames).max() <= 2
    with pytest.raises(ValueError, match="baseline and lossless"):
        media.decode_frames([files[0].replace(b"\xff\xc0", b"\xff\xc2")])


def test_shots_and_foreign_tables():
    x = np.concatenate([np.full((10, 24, 64), 20), np.full((15, 24, 64), 200), np.full((5, 24, 64), 90)]).astype(np.uint8)
    assert media.shots(x) == [(0, 10), (10, 25), (25, 30)]
    noise = np.random.default_rng(0).integers(0, 256, (3, 5, 7), dtype=np.uint8)
    files = media.encode_frames(noise)
    assert (media.decode_frames(files) == noise).all()
    # The same codes with one that the frames never use: no fixed rate, so the reader goes bit by bit.
    head = files[0].index(b"\xff\xc4")
    slow = [f[: head + 2] + (len(f[head + 4 : head + 4 + 26]) + 3).to_bytes(2, "big") + f[head + 4 : head + 4 + 10] + b"\1" + f[head + 15 : head + 30] + b"\x0f" + f[head + 30 :] for f in files]
    assert (media.decode_frames(slow) == noise).all()


def test_bpe(spark, docs, rows, awkward):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    got = by_id(bpe.encode_decode(docs, path))
    for k, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    expected = sorted((repr(k), len(ids := tokenizer.encode(x, add_special_tokens=False).ids), sha(" ".join(map(str, ids)))) for k, x in AWKWARD)
    assert per_row(bpe.encode_decode(awkward, path), "n_tokens", "ids_sha256") == expected and bpe.encode_decode(empty(spark), path).count() == 0


def test_bpe_on_random_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tokenizer, r = bpe.word_bpe(path), Tokenizer.from_file(path), random.Random(2)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    texts = ["".join(r.choice("abinthe 'sΣéß٣½\x1c\x85　漢😀<|>.") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    found = [g[1] for g in encoder.encode_batch(texts)]
    assert found == [" ".join(map(str, e.ids)) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_both_merge_loops_agree():
    encoder, r = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json")), random.Random(7)
    for _ in range(4000):
        symbols = encoder.symbols("".join(r.choice("aabinthesing") for _ in range(r.randint(1, 60))))
        assert encoder.exact_short(list(symbols)) == encoder.exact_long(list(symbols))


def test_packing(spark, docs, rows, awkward):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    got = packing.pack_documents(docs, path).collect()
    pieces = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        pieces[r["doc_id"]].append(r)
    for k, t, *_ in rows:
        ids, at = tokenizer.encode(t or "", add_special_tokens=False).ids + [2], 0
        for n, p in enumerate(pieces[k]):
            assert (p["piece"], p["start"]) == (n, at) and (n == 0 or p["length"] == 1024)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 1024
    made = packing.pack_documents(awkward, path).collect()
    crc = lambda x: zlib.crc32(np.array(tokenizer.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((repr(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in made) == sorted((repr(k), 0, crc(x)) for k, x in AWKWARD)
    assert len({(r["sequence_id"], r["offset"]) for r in made}) == 3 and packing.pack_documents(empty(spark), path).count() == 0


def test_packing_of_one_hot_cell(spark):
    """Very many rows without an id and of one text: no piece is lost, no place taken twice."""
    made = packing.pack_documents(spark.range(3_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a few words").alias("text")), public_tokenizers.path("byte_bpe_50k.json")).collect()
    length = made[0]["length"]
    places = {(r["sequence_id"], r["offset"]) for r in made}
    assert len(made) == len(places) == 3_000 and all(r["offset"] % length == 0 and r["offset"] + length <= 1024 for r in made)
    assert len({s for s, _ in places}) <= -(-3_000 // (1024 // length))


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    r = np.random.default_rng(seed)
    hist = np.r_[0, r.poisson(r.choice([0.2, 3, 400]), 1024)]
    made = packing.plan(hist)
    used = np.zeros(1025, np.int64)
    for content, n in made:
        assert sum(content) <= 1024
        for length in content:
            used[length] += n
    hist[1024] = 0
    assert (used == hist).all()
    assert sum(n for _, n in made) <= 1.02 * -(-(np.arange(1025) * hist).sum() // 1024) + 1


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii(spark, docs, rows, awkward):
    got = by_id(pii.find_pii(docs))
    for k, t, *_ in rows:
        base = brute_pii(t or "")
        assert got[k]["base_sha256"] == sha(",".join(f"{a}:{b}:{c}" for a, b, c in base))
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(s[0] == x for s in base) for x in pii.KINDS]
    assert per_row(pii.find_pii(awkward), "spans", "base_sha256") == sorted((repr(k), "", sha("")) for k, _ in AWKWARD) and pii.find_pii(empty(spark)).count() == 0
    r = random.Random(3)
    for _ in range(20000):
        t = "".join(r.choice("a.@1-+ 9%(b2") for _ in range(r.randint(0, 40)))
        assert list(map(tuple, pii.detect(t))) == brute_pii(t)


@pytest.mark.parametrize(("text", "hidden"), [
    ("mail john at example dot com now", "john at example dot com"), ("john (at) ex.com", "john (at) ex.com"), ("jоhn@exаmple.com!", "jоhn@exаmple.com"),
    ("call plus four four two zero seven nine four six zero nine five eight", "plus four four two zero seven nine four six zero nine five eight"),
    ("card ４１１１１１１１１１１１１１１１", "４１１１１１１１１１１１１１１１"), ("see at the dot. x at y.com", ""), ("one two three", ""),
])
def test_disguises(text, hidden):
    _, added = pii.find(text)
    assert [text[s.start : s.end] for s in added] == ([hidden] if hidden else [])


@pytest.mark.parametrize(("text", "kind", "hidden"), [
    ("at 192[.]168[.]1[.]20 now", "ip", "192[.]168[.]1[.]20"), ("10 (dot) 1 (dot) 2 (dot) 3", "ip", "10 (dot) 1 (dot) 2 (dot) 3"), ("on 192 dot 168 dot 1 dot 20.", "ip", "192 dot 168 dot 1 dot 20"),
    ("is one two seven dot zero dot zero dot one ok", "ip", "one two seven dot zero dot zero dot one"), ("one.two.three.four", "ip", "one.two.three.four"),
    ("to john [dot] doe [at] ex [dot] com!", "email", "john [dot] doe [at] ex [dot] com"), ("to john dot doe at ex dot com", "email", "john dot doe at ex dot com"), ("john [dot] doe@ex.com", "email", "john [dot] doe@ex.com"),
    ("𝐣𝐨𝐡𝐧@𝐞𝐱.𝐜𝐨𝐦", "email", "𝐣𝐨𝐡𝐧@𝐞𝐱.𝐜𝐨𝐦"), ("ⓙⓞⓔ@ex.com", "email", "ⓙⓞⓔ@ex.com"), ("at 300[.]1[.]1[.]1", "", ""), ("1[.]2[.]3", "", ""), ("1 dot 2 dot 3 dot 4 dot 5", "", ""),
])
def test_disguised_addresses(text, kind, hidden):
    spans, added = pii.find(text)
    assert [(s.kind, text[s.start : s.end]) for s in added] == ([(kind, hidden)] if hidden else [])
    left = pii.redact(text, spans + added)
    assert not hidden or left == text.replace(hidden, f"<{kind.upper()}>")


def disguised(r):
    """(kind of disguise, kind of identifier, disguised text), made by rule."""
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    names = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    back = {}
    for odd, plain in pii.LOOKALIKES.items():
        back.setdefault(plain, []).append(odd)
    spelled = lambda t: " ".join("plus" if c == "+" else names[int(c)] for c in t)
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) for c in t)
    mail = f"{word()}.{word()}@{word()}.{r.choice(['com', 'org', 'net', 'de'])}"
    ip, phone = ".".join(str(r.randint(0, 255)) for _ in range(4)), "+" + "".join(str(r.randint(0, 9)) for _ in range(r.randint(10, 12)))
    card = next(c for c in (str(r.randint(10**15, 10**16 - 1)) for _ in range(1000)) if pii.luhn(c))
    place = r.choice([k for k, c in enumerate(mail) if c in back])
    yield "look-alike", "email", mail[:place] + r.choice(back[mail[place]]) + mail[place + 1 :]
    yield "wide", "email", wide(mail)
    yield "styled", "email", "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in mail)
    yield "brackets", "email", mail.replace("@", r.choice([" (at) ", "[at]", " {at} "])).replace(".", r.choice([" (dot) ", "[.]", "[dot]"]))
    yield "words", "email", mail.replace("@", " at ").replace(".", " dot ")
    yield "invisible", "email", "\u200b".join(mail)
    yield "brackets", "ip", ip.replace(".", r.choice(["[.]", "(dot)", " dot "]))
    yield "spelled", "ip", " dot ".join(spelled(p) for p in ip.split("."))
    yield "digits", "ip", "".join(chr(0x660 + int(c)) if c.isdigit() else c for c in ip)
    yield "wide", "card", wide(card)
    yield "spelled", "card", spelled(card)
    yield "wide", "phone", wide(phone)
    yield "spelled", "phone", spelled(phone)


def test_recall_of_disguises():
    r = random.Random(5)
    for _ in range(60):
        for how, kind, hidden in disguised(r):
            before, behind = "seen by them: ", " , and so on"
            base, added = pii.find(before + hidden + behind)
            assert (kind, len(before), len(before) + len(hidden)) in base + added, (how, hidden)


def brute_suffixes(rows, span):
    """By row number: (bytes, removed, spans, digest); ``rows`` are (id, text), and equal ones are one."""
    order = sorted({(-(2**63) if k is None else k, suffixes.text_mark((t or "").encode()), (t or "").encode()) for k, t in rows})
    first, out = set(), {}
    for k, _, b in order:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if b[i : i + span] in first:
                gone[i : i + span] = b"\1" * span
            first.add(b[i : i + span])
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out[None if k == -(2**63) else k, b] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return sorted((repr(k), *out[k, (t or "").encode()]) for k, t in rows)


def found_suffixes(df):
    return sorted((repr(r[0]), *r[1:]) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_suffixes(spark, docs, rows, awkward):
    assert found_suffixes(suffixes.remove_repeats(docs, span=100)) == brute_suffixes([r[:2] for r in rows], 100)
    assert found_suffixes(suffixes.remove_repeats(awkward, span=32)) == brute_suffixes([tuple(r)[:2] for r in awkward.collect()], 32)
    assert suffixes.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="span"):
        suffixes.remove_repeats(docs, span=31)


@pytest.mark.parametrize(("span", "wide"), [(40, 2_000), (100, 2_000), (100, 1), (300, 2_000), (300, 1)])
def test_suffixes_of_shared_ids(spark, span, wide):
    """Null and shared ids, repeated rows, passages and copies, and all ways that strings can meet."""
    r = random.Random(span)
    letters = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [letters(n) for n in (60, 130, 320, 700)]
    texts = [letters(r.randint(0, 150)) + r.choice(passages) + letters(r.randint(0, 150)) + r.choice(passages) * r.randint(0, 2) for _ in range(40)]
    texts += ["ab" * 400, "x" * 700, passages[3], passages[3][20:600], "", None]
    rows = [(r.choice([None, 5, k, k]), t) for k, t in enumerate(texts)] + [(None, texts[0]), (5, texts[1]), (5, texts[2]), (7, texts[3]), (7, texts[3])]
    rows += rows[:5]
    made = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), span=span, wide=wide)
    assert found_suffixes(made) == brute_suffixes(rows, span)


def test_streamed_classes(spark):
    """What ``settle`` says of sorted rows does not depend on where the stream is cut."""
    r = random.Random(3)
    rows = [(a, 0 if a < 20 else r.randint(0, 2), r.randint(0, 50), 0, int(suffixes.pack_place(np.int64(r.randint(0, 3)), np.bool_(a == 3), np.int64(7)))) for a in (r.randint(0, 60) for _ in range(3_000))]
    dealt = spark.createDataFrame(rows + [(r.randint(0, 9**9), None, 1, 1, 9)], suffixes.DEALT)
    made = {piece: sorted(map(tuple, suffixes.settle(dealt, piece).collect()), key=repr) for piece in (3, 64, 1 << 16)}
    assert made[3] == made[64] == made[1 << 16]
    classes, regions = collections.defaultdict(set), collections.defaultdict(set)
    for a, region, *row in rows:
        classes[a, region].add(tuple(row))
        regions[a].add(region)
    opened = sorted((*min(c), a) for (a, _), c in classes.items() if len(regions[a]) > 1 or a == 3)
    again = sorted((*x, a, *min(c)) for (a, _), c in classes.items() for x in c - {min(c)})
    assert sorted(x[:4] for x in made[3] if x[4]) == opened
    assert sorted(x[:4] + x[5:] for x in made[3] if x[5] is not None) == again
    assert len(made[3]) == len(opened) + len(again) + 1


def test_colliding_hashes(spark, monkeypatch):
    """Regions of equal hashes and unequal bytes are found out by their digests, and all starts again."""
    texts = spark.createDataFrame([(k, "".join(random.Random(k).choices("abcd", k=400))) for k in (1, 2, 1, 3)], "key long, text string").repartition(4)
    tried = []
    real = suffixes.deal

    def broken(docs, span, attempt=0):
        tried.append(attempt)
        rows = real(docs, span, attempt)
        return rows.select(F.lit(1).cast("long").alias("anchor"), F.lit(2).cast("long").alias("region"), "key", "mark", "place") if attempt == 0 else rows

    monkeypatch.setattr(suffixes, "deal", broken)
    got = suffixes.remove_repeats(texts.withColumnRenamed("key", "doc_id"), span=100).collect()
    assert tried == [0, 1] and all(r["n_removed"] == 0 for r in got) and len(got) == 4


def test_suffix_sort_orders_by_content():
    r = np.random.default_rng(4)
    data = np.tile(r.integers(97, 99, 150), 6).astype(np.uint8)
    at = np.arange(len(data) - 100)
    order, segment = suffixes.SuffixOrder(data, 100).sort(at, np.zeros(len(at), np.int64))
    strings = [bytes(data[i : i + 100]) for i in at[order]]
    assert strings == sorted(strings)
    same = suffixes.SuffixOrder(data, 100).equal_next(at[order], segment)
    assert same.tolist() == [a == b for a, b in zip(strings, strings[1:])]


def test_suffixes_sort_only_what_repeats(monkeypatch):
    """Strings whose hash no other string of their group has are left out of the sort, and nothing else is."""
    r = np.random.default_rng(8)
    passage = r.bytes(150)
    texts = [r.bytes(70) + passage + r.bytes(80), r.bytes(20) + passage + r.bytes(130), passage + r.bytes(150)]
    sizes, sort = [], suffixes.SuffixOrder.sort
    monkeypatch.setattr(suffixes.SuffixOrder, "sort", lambda self, at, group: sizes.append(len(at)) or sort(self, at, group))
    start = np.zeros(3, np.int64)
    place = suffixes.pack_place(start, np.zeros(3, bool), np.full(3, 201))
    # The third text has a group of its own.
    found = suffixes.covered(np.array([5, 5, -6]), np.arange(3), start, place, texts, 100)
    assert [x.tolist() for x in found] == [[1], [0], [20], [170]]
    assert sizes == [2 * 51]
    assert [len(x) for x in suffixes.covered(np.array([5, 6, 7]), np.arange(3), start, place, texts, 100)] == [0] * 4


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, docs, rows, awkward):
    def fingerprint(t):
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {k: fingerprint(t or "") for k, t, *_ in rows}
    roots = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in by_id(simhash.near_copies(docs)).items()} == {k: (f"{f:016x}", roots[k]) for k, f in fps.items()}
    assert per_row(simhash.near_copies(awkward), "fingerprint", "component_id") == sorted([("None", f"{fingerprint(AWKWARD[0][1]):016x}", None)] + [("7", f"{fingerprint('twice'):016x}", 7)] * 2, key=str)
    assert simhash.near_copies(empty(spark)).count() == 0


@pytest.mark.parametrize("leaf", [40, 150])
def test_shards_lose_no_link(leaf):
    r = np.random.default_rng(1)
    near = np.array([int(r.integers(2**63)) ^ 0 for _ in range(300)], dtype=np.uint64)
    center = near[0]
    ball = np.array([int(center) ^ sum(1 << int(b) for b in set(r.integers(0, 64, 5))) for _ in range(700)], dtype=np.uint64)
    points = np.unique(np.concatenate([near, ball]))
    nodes = simhash.fit_tree(points[::2], 3, leaf)
    index, shard = simhash.route(points, nodes, 3)
    edges = np.concatenate([simhash.forest(points[index[shard == s]], 3, 64) for s in np.unique(shard)])
    ids = points.tolist()
    links = {}
    for a, b in edges.tolist():
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    found = {}
    for i in ids:
        if i not in found:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in found:
                    found[x] = i
                    todo += links.get(x, ())
    assert found == brute_components(ids, lambda a, b: (a ^ b).bit_count() <= 3)


def test_near_duplicates(spark, rows):
    long = [(k, t) for k, t, *_ in rows if t and len(t.split()) > 60][:20]
    copies = [(1000 + k, t.replace(t.split()[5], "changed", 1) + " tail") for k, t in long]
    got = by_id(simhash.near_duplicates(spark.createDataFrame([*long, *copies, (None, "x")], "doc_id long, text string")))
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    sets = {k: shingles(t) for k, t in long + copies}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for k, _ in long:
        if similar(k, 1000 + k) >= 0.85:
            assert got[k]["component_id"] == got[1000 + k]["component_id"]
        for j, _ in long:
            if similar(k, j) < 0.5:
                assert got[k]["component_id"] != got[j]["component_id"]
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_of_each(spark):
    """Shared and null ids, repeated rows, null texts and clashing names: one row of each group stays, unrelated ones all do."""
    r = random.Random(31)
    text = lambda: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    near = a.replace(a.split()[30], "other", 1)
    rows = [(1, a), (7, near), (7, b), (9, c), (9, c), (None, c), (None, d), (None, d), (3, None), (4, ""), (5, b + " more")]
    docs = spark.createDataFrame([(*x, k, "k", 1.5) for k, x in enumerate(rows)], "doc_id long, text string, point int, mark string, root double").repartition(4)
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and all(x["mark"] == "k" and x["root"] == 1.5 for x in kept.collect())
    # Of a repeated row the smallest other columns stay.
    assert sorted(map(repr, (tuple(x)[:3] for x in kept.collect()))) == sorted(map(repr, [(1, a, 0), (5, b + " more", 10), (9, c, 3), (None, d, 6), (3, None, 8)]))
    classes = [(1, 1), (7, 1), (7, 5), (9, 9), (9, 9), (None, 9), (None, None), (None, None), (3, 3), (4, 3), (5, 5)]
    assert sorted(map(repr, map(tuple, simhash.near_duplicates(docs).collect()))) == sorted(map(repr, classes))
    assert simhash.first_of_each(empty(spark)).count() == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    """Large bands and groups are dealt in blocks, of which each two meet; the classes are the same."""
    r = random.Random(6)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(80)]
    texts = {k: " ".join(words[:40] + [f"x{k}"] + words[40:]) for k in range(40)} | {100 + k: " ".join(f"v{r.randint(0, 10**6)}" for _ in range(70)) for k in range(10)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = {k: 0 if k < 100 else k for k in texts}
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs).collect()} == expected
    monkeypatch.setattr(simhash, "BLOCK_POINTS", 7)
    monkeypatch.setattr(simhash, "EXACT_POINTS", 5)
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs).collect()} == expected


def test_trees_lose_no_candidate(spark, monkeypatch):
    """Pairs far below 0.8, which band keys of four minima would often part, meet in the trees; so they do where sets are dealt into blocks."""
    r = random.Random(41)
    texts = {}
    for pair in range(120):
        words = [f"w{r.randint(0, 10**9)}" for _ in range(r.choice([104, 204, 404]))]
        changed, total = list(words), len(words) - 4
        # 0.54 to 0.57 of the shingles stay.
        for i in range(int(total * 0.28 / 5)):
            changed[5 + i * 10] = f"new{r.randint(0, 10**9)}"
        texts[2 * pair], texts[2 * pair + 1] = " ".join(words), " ".join(changed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = {k: k - k % 2 for k in texts}
    for points in (simhash.BLOCK_POINTS, 40):
        monkeypatch.setattr(simhash, "BLOCK_POINTS", points)
        assert {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, least=0.5, radius=32).collect()} == expected


def test_near_duplicates_at_the_border(spark):
    """Pairs planted just above and just below a similarity of 0.8 are decided by their whole shingle sets."""
    r = random.Random(12)
    texts, similar = {}, {}
    for pair in range(80):
        words = [f"w{r.randint(0, 10**9)}" for _ in range(r.choice([150, 400, 1000, 3000]))]
        changed, total = list(words), len(words) - 4
        # Each changed word takes five shingles away and brings five new ones.
        n = int(total * (1 - 0.8) / (5 * (1 + 0.8))) + pair % 2
        for i in range(n):
            changed[5 + i * 10] = f"new{r.randint(0, 10**9)}"
        texts[2 * pair], texts[2 * pair + 1] = " ".join(words), " ".join(changed)
        similar[pair] = (total - 5 * n) / (total + 5 * n)
    assert {s >= 0.8 for s in similar.values()} == {True, False} and all(0.74 < s < 0.84 for s in similar.values())
    got = by_id(simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {k: got[2 * k + 1]["component_id"] == 2 * k for k in similar} == {k: s >= 0.8 for k, s in similar.items()}


def test_sharding(spark, docs, rows, awkward):
    got = sharding.shard_documents(docs).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    texts = {k: t or "" for k, t, *_ in rows}
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]].encode()) + 1, zlib.crc32(texts[r["doc_id"]].encode()), "rows", None) for r in got)
    assert placed(sharding.shard_documents(awkward)) == brute_ring(AWKWARD) and sharding.shard_documents(empty(spark)).count() == 0
    assert placed(sharding.shard_documents(docs)) == brute_ring([(k, t) for k, t, *_ in rows])


def placed(df):
    return sorted((repr(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"]) for r in df.collect())


def spark_hash(*values):
    """Spark's xxhash64 of whole numbers and of bytes; nulls are passed over."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) * (seed >> 63)


def brute_ring(rows, shards=8):
    """Key by key: from its arc clockwise, past full shards, to the first virtual node of a shard with room."""
    ring = sorted((sharding._hash(f"shard {s} node {v}") % sharding.ARCS, sharding._hash(f"tie {s} {v}"), s) for s in range(shards) for v in range(sharding.VIRTUAL_NODES))
    keys = []
    for doc, text in rows:
        raw = (text or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        cell = (spark_hash(doc) % sharding.ARCS, spark_hash(doc, size, crc) % sharding.SUBCELLS)
        keys.append((sharding._hash(f"cell {cell[0]} {cell[1]}"), cell, doc is not None, doc or 0, crc, size))
    left, used, out = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)], [0] * shards, []
    for _, (arc, _), named, doc, crc, _ in sorted(keys):
        begin = next((i for i, (place, _, _) in enumerate(ring) if place >= arc), 0)
        shard = next(s for _, _, s in ring[begin:] + ring[:begin] if left[s])
        out.append((repr(doc if named else None), crc, shard, used[shard]))
        left[shard] -= 1
        used[shard] += 1
    return sorted(out)


def test_ring_order_and_movement():
    ring = sorted((sharding._hash(f"shard {s} node {v}") % 512, sharding._hash(f"tie {s} {v}"), s) for s in range(8) for v in range(16))
    for arc, order in enumerate(sharding.clockwise(8, 512, 16)):
        walk = [s for p, _, s in ring if p >= arc] + [s for _, _, s in ring]
        assert order == list(dict.fromkeys(walk))
    counts = {(a, 0): 10 for a in range(sharding.ARCS)}
    where = lambda n: {(a, k): s for a, _, lo, hi, s, _ in sharding.layout(counts, n, 0.25) for k in range(lo, hi)}
    old, new = where(8), where(9)
    assert sum(old[k] != new[k] for k in old) < 0.35 * len(old)


def test_chat(spark):
    nodes = [("t", 1, None, "user", "q <|im_end|>", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 3, "user", None, None), ("u", 1, 9, None, "orphan", 0.0)]
    schema = "tree_id string, node_id long, parent_id long, role string, text string, score double"
    got = chat.conversations(spark.createDataFrame(nodes, schema)).collect()
    assert {(r["tree_id"], r["leaf_id"]): chat.read_turns(r["formatted"]) for r in got} == {
        ("t", 2): [("user", "q <|im_end|>"), ("assistant", "a")], ("t", 4): [("user", "q <|im_end|>"), ("assistant", "b"), ("user", "")], ("u", 1): [("", "orphan")]
    }
    assert [r["leaf_id"] for r in got if r["tree_id"] == "t" and r["branch"] == 1] == [4]
    assert chat.conversations(spark.createDataFrame([], schema), 1).count() == 0
    with pytest.raises(ValueError, match="ancestor"):
        chat.paths(spark.createDataFrame([("c", 1, 2), ("c", 2, 1), ("c", 3, 1)], "tree_id string, node_id long, parent_id long")).count()
    r = random.Random(1)
    for _ in range(3000):
        text, role = ("".join(r.choice("<|\\>im_end\n") for _ in range(r.randint(0, 20))) for _ in range(2))
        formatted, spans = chat.format_turns([(role, text), ("assistant", text)])
        assert chat.read_turns(formatted) == [(role, text), ("assistant", text)]
        assert chat.unescape("".join(formatted[a:b] for a, b in spans[-1:])) == text


def test_chat_of_awkward_rows(spark):
    """Null trees, shared and null node ids, repeated rows, clashing names; circles with and without leaves."""
    schema = "tree_id string, node_id long, parent_id long, role string, text string, score double, leaf long, depth string"
    nodes = [
        (None, 1, None, "user", "q", 0.0), (None, 2, 1, "assistant", "a", 1.0), (None, 2, 1, "assistant", "a", 1.0), ("t", 1, None, "user", "one", 0.0), ("t", 1, None, "user", "two", 0.0),
        ("t", 2, 1, "assistant", "reply", 0.0), ("u", None, None, "user", "nameless", 0.0), ("u", None, 3, None, None, None), ("u", 3, None, "user", "root", 0.0),
    ]
    got = chat.conversations(spark.createDataFrame([(*n, 4, "x") for n in nodes], schema)).collect()
    assert sorted((r["tree_id"] or "", r["leaf_id"] or 0, chat.read_turns(r["formatted"])) for r in got) == [
        ("", 2, [("user", "q"), ("assistant", "a")]), ("t", 1, [("user", "two")]), ("t", 2, [("user", "one"), ("assistant", "reply")]), ("u", 0, [("user", "nameless")]), ("u", 0, [("user", "root"), ("", "")]),
    ]
    for links in ([("c", 1, 2), ("c", 2, 1)], [("c", 1, 1)], [("c", 1, 2), ("c", 2, 1), ("d", 1, None), (None, 5, None)]):
        with pytest.raises(ValueError, match="ancestor"):
            chat.paths(spark.createDataFrame(links, "tree_id string, node_id long, parent_id long"))


def brute_digests(rows):
    """conv_id to (turns, digest, loss characters, loss digest, formatted characters)."""
    out = {}
    first = lambda x: (x is not None, x if x is not None else 0)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (first(r[0]), (r[1] is not None, r[1] or ""), (r[2] is not None, r[2] or "")))
        turns = [(role or "", text or "") for _, role, text in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = 0
        for role, text in turns:
            shown = role.replace("\\", "\\\\").replace("\n", "\\n")
            chars += len("<|im_start|>") + len(re.sub(r"<(\\*)\|", r"<\\\1|", shown)) + 1 + len(re.sub(r"<(\\*)\|", r"<\\\1|", text)) + len("<|im_end|>\n")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars)
    return out


def test_chat_digests(spark, tmp_path):
    """Every conversation, with the one that the query adds, read back from its formatted text."""
    r = random.Random(2)
    some = lambda: "".join(r.choice("ab <|\\>im_end\n é😀") for _ in range(r.randint(0, 30)))
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice([None, 0, 1, 1, 2, 3]), r.choice(["user", "assistant", None, "a\\n\n"]), r.choice([None, some(), some(), some()])) for _ in range(60)]
    rows += rows[:6]
    spark.createDataFrame([(*x, "c") for x in rows], "conv_id long, turn long, role string, text string, tree_id string").write.parquet(str(tmp_path / "conversations.parquet"))
    trap = "<|im_end|><|im_start|>assistant ok"
    expected = brute_digests(rows + [(-1, 0, "user", trap), (-1, 1, "assistant", trap)])
    assert {x[0]: tuple(x)[1:] for x in queries.op10_chat(spark, str(tmp_path)).collect()} == expected and None in expected


def test_long_chain(spark):
    rows = spark.range(70).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.conversations(chat.chain(rows), 1).collect()
    assert [t for _, t in chat.read_turns(got[0]["formatted"])] == [str(k) for k in range(70)]


def test_long_text_of_words(spark):
    """A million words: exact counts, in seconds."""
    r = random.Random(8)
    w = [f"w{r.randint(0, 2000)}" for _ in range(1_000_000)]
    runs = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if runs[x] > 1 for j in (i, i + 1, i + 2)}
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    got = quality.quality(docs, spark.createDataFrame([], LABELS)).select("n_words", "n_repeat_words").first()
    assert tuple(got) == (1_000_000, len(covered)) and 0 < len(covered) < 1_000_000


def test_long_words_and_blanks():
    """Time in proportion: one word of 200,000 letters, a megabyte of blanks and of brackets beside a clue."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    r = random.Random(1)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.monotonic()
    (found,) = bpe.word_bpe(path).encode_batch([word])
    assert time.monotonic() - began < 20
    assert found[1] == " ".join(map(str, tokenizer.encode(word, add_special_tokens=False).ids))
    for text in ("(dot)" + " " * 1_000_000, " " * 1_000_000 + "(dot) x at y", ("(" + " " * 2000) * 500 + " dot ", "1 dot " * 200_000, "x at " * 200_000 + "(dot)", "a@" * 500_000):
        began = time.monotonic()
        pii.find(text)
        assert time.monotonic() - began < 10, text[:9]


def test_long_media_in_little_memory():
    """20 MB of text: the file is made and read in a few times that."""
    payload = (b"some text of words, " * 1_000_000).ljust(-(-20_000_000 // 192) * 192, b" ")
    tracemalloc.start()
    try:
        video = media.read_avi(media.write_avi(payload))
        assert media.payload_of(video) == payload and media.clip_rows(video)
        assert tracemalloc.get_traced_memory()[1] < 7 * len(payload)
    finally:
        tracemalloc.stop()
