"""Operator 1: quality rules and a hashed n-gram likelihood ratio, in DataFrame operations only.

Multinomials over hashed word n-grams are counted: over trusted documents, over toxic ones, and over the whole corpus. A document's
scores are the mean log ratio, over its n-grams, of the trusted against all, and the share of its n-grams whose log ratio of the toxic against the trusted is strong. Log ratios are rounded
to whole multiples of 2**-20, so sums are exact and the verdict on a document does not depend on the order of addition.

The verdict is out of sample. Documents fall into two halves by a hash of the id, and each half is judged by ratios that were fitted on the
labelled documents of the other one. A ratio's target is smoothed towards the shares of the whole corpus, so an n-gram that no
labelled document has counts nothing. The toxic ratio has more buckets, as few words tell, and is strong where
n-grams occur in toxic documents far more often than their share of trusted ones lets expect. The cut of each ratio comes from the labelled documents' own scores.

Every labelled document counts, for the ratios as for the cuts. One scan counts all documents (what leaves a task is one row a bucket at most), one stores the labelled ones, whose n-grams are
counted twice, a last one scores and stores all; the cuts read the labelled ones' scores there. The text is shuffled only where labels are too many to be broadcast. Words are hashed once; n-grams are hashes of their words' hashes. The log ratios travel inside the plan, whatever the input.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import materialize

#: Buckets of the hashed n-grams (words and pairs of words), and the fixed-point scale of the log ratios.
BUCKETS, SCALE = 10_000, 1 << 20
#: Labelled documents (about 50 bytes each) that a broadcast joins to their texts; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: N-grams that the smoothing adds to a target, and the share of trusted documents that a cut may lose, out of sample.
SMOOTHING, LOSS = 10_000, 0.01
#: Buckets of the toxic ratio, occurrences added to the seen and the expected ones, and the least log ratio that counts.
TOXIC_BUCKETS, TOXIC_PRIOR, TOXIC_LEAST = 1 << 18, 0.5, 2.0

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def hashes(w: Column) -> Column:
    """64-bit hashes of words."""
    return F.transform(w, lambda x: F.xxhash64(x))


def pairs(u: Column) -> Column:
    """Hashes of each two neighbours."""
    n = F.greatest(F.size(u) - 1, F.lit(0))
    return F.zip_with(F.slice(u, 1, n), F.slice(u, 2, n), lambda x, y: F.xxhash64(x, y))


def triples(u: Column, b: Column) -> Column:
    """Hashes of each three neighbours, from those of words and of pairs: both are 64 bits of hashes that differ, so bits that are combined lose nothing."""
    n = F.greatest(F.size(u) - 2, F.lit(0))
    return F.zip_with(F.slice(b, 1, n), F.slice(u, 3, n), lambda x, y: x.bitwiseXOR(y))


def bucket(h: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def half(doc_id: Column) -> Column:
    """Which half a document falls into: 0 or 1."""
    return F.pmod(F.xxhash64(F.lit("half"), doc_id), F.lit(2)).cast("int")


def known(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, good, bad, toxic`` (1 or null) of every labelled document: good are trusted ones, which are not toxic."""
    of = {"good": "quality = 1 AND coalesce(toxic, 0) = 0", "bad": "quality = 0", "toxic": "toxic = 1"}
    each = labels.where("quality IN (0, 1) OR toxic = 1").select(F.col(id_column).alias("doc_id"), *[F.when(F.expr(which), 1).alias(c) for c, which in of.items()])
    return each.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in of])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a label, with ``good, bad, toxic``."""
    found = materialize(known(labels))
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_LABELS else found, "doc_id")


def labelled_texts(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, good, bad, toxic`` of the documents that have a label, stored."""
    return materialize(labelled(texts, labels))


def counted(docs: DataFrame, buckets: int, of: dict[str, Column]) -> DataFrame:
    """``bucket, n`` and a count for each column ``of``, which is null in what it does not count: n-grams by bucket."""
    u = docs.select(*[c.alias(name) for name, c in of.items()], hashes(words(F.coalesce("text", F.lit("")))).alias("u"))
    # Pairs are hashed behind the explosion, in generated code, and not by a function over arrays, which is interpreted.
    each = u.select(*of, "u", F.posexplode("u").alias("i", "x")).withColumn("y", F.get("u", F.col("i") + 1))
    each = each.select(*of, F.explode(F.array("x", F.when(F.col("y").isNotNull(), F.xxhash64("x", "y")))).alias("h")).where("h IS NOT NULL")
    return each.groupBy(bucket(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("n"), *[F.count(name).alias(name) for name in of])


def log_ratios(docs: DataFrame, own: DataFrame, buckets: int = BUCKETS) -> tuple[list[tuple[list[int], list[int]]], bool]:
    """For each half the scaled log ratios by bucket, trusted against all, and the buckets whose log ratio of toxic against trusted is strong; and whether any trusted document was found. ``own``: the labelled ones.

    They come from the other half's labels. To the trusted counts of the first, ``SMOOTHING`` n-grams are added in proportion to all documents.
    """
    n = {c: [0] * buckets for c in ("n", "good0", "good1", "toxic0", "toxic1")}
    of = {f"{c}{k}": F.when(half(F.col("doc_id")) == k, F.col(c)) for c in ("good", "toxic") for k in (0, 1)}
    for r in counted(docs, buckets, {}).collect():
        n["n"][r["bucket"]] = r["n"]
    own = own.where("good IS NOT NULL OR toxic IS NOT NULL")
    for r in counted(own, buckets, of).collect():
        for c in of:
            n[c][r["bucket"]] = r[c]
    every, total = max(sum(n["n"]), 1), {c: sum(v) for c, v in n.items()}
    # Fewer occurrences than these never count, so few rows leave this.
    seen = math.ceil(math.exp(TOXIC_LEAST) * TOXIC_PRIOR - TOXIC_PRIOR)
    strong = counted(own, TOXIC_BUCKETS, of).where((F.col("toxic0") >= seen) | (F.col("toxic1") >= seen)).collect() if total["toxic0"] + total["toxic1"] else []
    scaled = lambda x: round(SCALE * x)
    out = []
    for other in ("1", "0"):
        good, of_good, of_toxic = n["good" + other], total["good" + other], total["toxic" + other]
        score = [scaled(math.log((g + SMOOTHING * r / every) / (of_good + SMOOTHING)) - math.log(r / every)) if r else 0 for g, r in zip(good, n["n"])]
        ratio = lambda r: math.log((r["toxic" + other] + TOXIC_PRIOR) / (r["good" + other] / of_good * of_toxic + TOXIC_PRIOR))  # noqa: B023, E731
        out.append((score, [r["bucket"] for r in strong if of_good and ratio(r) >= TOXIC_LEAST]))
    return out, total["good0"] + total["good1"] > 0


def cut_between(keep: Sequence[float], drop: Sequence[float], loss: float = LOSS) -> float:
    """The cut at which most of ``drop`` and fewest of ``keep`` lie below; at most a share ``loss`` of ``keep`` does. Minus infinity if no cut helps."""
    keep, drop = np.sort(np.asarray(keep, dtype=float)), np.sort(np.asarray(drop, dtype=float))
    if not len(keep) or not len(drop):
        return -math.inf
    least = keep[: int(loss * len(keep)) + 1]
    below = np.searchsorted(drop, least)
    won = np.where(below > 0, below / len(drop) - np.searchsorted(keep, least) / len(keep), 0.0)
    k = int(np.argmax(won))
    if won[k] <= 0:
        return -math.inf
    # Halfway to the next lower score.
    return float((keep[k] + max(drop[below[k] - 1], keep[k - 1] if k and keep[k - 1] < keep[k] else -math.inf)) / 2)


def repeated_words(cut: DataFrame) -> DataFrame:
    """Add ``n_repeat_words``: words inside runs of three words that the text has twice or more. Reads the hashes ``t`` of these runs, and drops them.

    Hashes are sorted together with their places, so equal ones are neighbours.
    """
    # Most documents have no repeated run; only the others are sorted.
    some = F.size(F.array_distinct("t")) < F.size("t")
    keys = F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = cut.withColumn("s", F.when(some, keys).otherwise(F.array().cast("array<struct<h: bigint, i: int>>"))).drop("t")
    equal = lambda x, j: F.coalesce(F.get(F.col("s"), j)["h"] == x["h"], F.lit(False))
    found = F.filter("s", lambda x, j: equal(x, j - 1) | equal(x, j + 1))
    step = step.withColumn("d", F.sort_array(F.transform(found, lambda x: x["i"])))
    # Each repeated run adds the words that the next one does not hold.
    added = F.aggregate(F.transform("d", lambda x, i: F.least(F.coalesce(F.get(F.col("d"), i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda a, b: a + b)
    return step.withColumn("n_repeat_words", added).drop("s", "d")


def bits(buckets: list[int]) -> list[int]:
    """A set of toxic buckets as signed longs of 64 bits each."""
    out = [0] * (TOXIC_BUCKETS // 64)
    for b in buckets:
        out[b >> 6] |= 1 << (b & 63)
    return [x - (1 << 64) * (x >> 63) for x in out]


def scored(named: DataFrame, ratios: list[tuple[list[int], list[int]]], more: list[Column] | None = None) -> DataFrame:
    """``doc_id``, the rules' counts, ``base_failed``, ``score`` and ``toxicity`` of a table ``doc_id, text``, and the columns in ``more``."""
    # One flat array a ratio and half, the strong buckets as bits of longs: the optimiser folds these to literals.
    array = lambda values: F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<bigint>")
    of_half = lambda values: F.when(F.col("half") == 1, array(values[1])).otherwise(array(values[0]))
    score, strong = of_half([r[0] for r in ratios]), of_half([bits(r[1]) for r in ratios])
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = named.select(
        "doc_id", *(more or []), words(text).alias("w"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    cut = cut.withColumns({"u": hashes(F.col("w")), "word_chars": F.length(F.array_join("w", "")).cast("long"), "half": half(F.col("doc_id"))}).drop("w")
    cut = cut.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    cut = cut.withColumn("b", pairs(F.col("u"))).withColumn("n_words", F.size("u").cast("long"))
    cut = cut.withColumns({"t": triples(F.col("u"), F.col("b")), "h": F.concat("u", "b")}).drop("u", "b")
    total = lambda of: F.aggregate("h", F.lit(0).cast("long"), lambda a, x: a + of(x))
    mean = lambda of, scale: F.when(F.size("h") > 0, total(of) / (F.size("h") * F.lit(scale))).otherwise(0.0)
    is_strong = lambda x: F.getbit(F.get(strong, F.shiftright(x.bitwiseAND(F.lit(TOXIC_BUCKETS - 1)), 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int"))
    cut = cut.withColumns({"score": mean(lambda x: F.get(score, bucket(x, len(ratios[0][0]))), float(SCALE)), "toxicity": mean(is_strong, 1.0)})
    cut = repeated_words(cut.drop("h", "half"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return cut.withColumn("base_failed", failed)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = -math.inf, id_column: str = "doc_id", text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, toxicity, kept`` and the columns in ``keep``, for every row.

    ``base_failed``: under 50 words, or over half of the words in repeated runs of three. ``kept`` is false for those, else whether the document passes
    both ratios out of sample: ``score``, trusted against all (cut from trusted and bad documents), and ``toxicity``, the share of strongly toxic n-grams (cut from toxic and trusted ones).
    Labels without a trusted document judge nothing: what the base rules keep is kept. Labels with trusted and without bad documents give no
    cut for the first ratio, so there ``score`` has to reach ``threshold``, which is no bound unless it is given. Null and empty texts have no words; null ids are never trusted; labels that are null trust nothing; repeated
    rows are counted and returned as often as they occur; an empty table gives no rows.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.struct(*(keep or [F.lit(None).cast("int").alias("none")])).alias("others"))
    texts = named.select("doc_id", "text")
    own = labelled_texts(texts, labels)
    ratios, any_trusted = log_ratios(texts, own)
    # Stored: the scores of labelled documents are read here, not worked out again, and a filter on the verdict is not pushed down to the word arrays.
    every = materialize(scored(named, ratios, [F.col("others")]))
    passed = F.lit(True)
    if any_trusted:
        # Three flags and two numbers a labelled document, as columns of numbers.
        flags = [F.col(c).isNotNull().alias(c) for c in ("good", "bad", "toxic")]
        judged = labelled(every.select("doc_id", "base_failed", "score", "toxicity"), labels).select(*flags, "base_failed", "score", "toxicity").toArrow()
        col = {c: judged.column(c).to_numpy() for c in judged.column_names}
        of = lambda c, kind: col[c][col[kind] & ~col["base_failed"]]
        bad = of("score", "bad")
        least = cut_between(of("score", "good"), bad)
        most = -cut_between(-of("toxicity", "good"), -of("toxicity", "toxic"))
        passed = (F.col("score") >= (least if len(bad) else threshold)) & (F.col("toxicity") <= most)
    out = every.withColumn("kept", ~F.col("base_failed") & passed)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "toxicity", "kept"]
    return out.select(F.col("doc_id").alias(id_column), *names, *[F.col(f"others.{c}").alias(c) for c in keep or []])
