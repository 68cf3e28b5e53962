"""Feature keys in nine namespaces, document frequencies, idf and unit weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.functions import constants as K


#: Records of a part, within which a feature's weight travels once; fewest and most parts.
PER_PART, LEAST_PARTS, MOST_PARTS = 10_000, 8, 252
#: Parts that one mask tells.
BITS = 63


def _keys(ns: str, values: Column) -> Column:
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(ns).alias("ns"), v.alias("key")))


def grams(text: Column, n: int = 3, most: int = 40) -> Column:
    """Distinct character n-grams of the first ``most`` characters."""
    last = F.least(F.length(text), F.lit(most)) - n + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.substring(text, k, F.lit(n)))


def _every(weights: dict[str, float]) -> Column:
    """All features of a normalised record, as structs of ``ns`` and ``key``."""
    none = F.array().cast("array<string>")
    six, eight = F.slice("nm_tok", 1, 6), F.slice("ad_tok", 1, 8)
    words = F.filter(F.split(F.array_join("nm_parts", " "), " "), lambda x: x != "")
    street = F.when(F.col("ad_first_num").isNotNull(), F.transform(F.slice("ad_tok", 1, 2), lambda t: F.concat("ad_first_num", F.lit("|"), t))).otherwise(none)
    pairs = F.flatten(F.transform(six, lambda a, i: F.transform(F.filter(six, lambda b, j: j > i), lambda b: F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b)))))
    cross = F.flatten(F.transform(F.slice("nm_tok", 1, 4), lambda a: F.transform(F.slice("ad_tok", 1, 6), lambda b: F.concat(a, F.lit("|"), b))))
    near = F.filter(F.transform(eight, lambda a, i: F.concat(a, F.lit("|"), F.get(eight, i + 1))), lambda x: x.isNotNull())
    spaces = {"nw": words, "ng": grams(F.col("nm_concat")), "aw": F.col("ad_tok"), "an": F.col("ad_num"), "ac": F.col("ad_code"), "ap": street, "np": pairs, "xn": cross, "ab": near}
    return F.concat(*[_keys(ns, v) for ns, v in spaces.items() if ns in weights])


def features(records: DataFrame, weights: dict[str, float] = K.WEIGHTS) -> DataFrame:
    """``rec_id, src, country, ns, key``, distinct, from normalised records: arrays in the row, one explode, no shuffle. ``weights`` names the namespaces.

    Records that have a ``part`` keep it.
    """
    more = [c for c in ("part",) if c in records.columns]
    return records.select(F.col("entity_id").alias("rec_id"), "src", "country", F.explode(_every(weights)).alias("f"), *more).select("rec_id", "src", "country", "f.ns", "f.key", *more)


def dealt(records: DataFrame) -> DataFrame:
    """``records`` with a ``part``, whose rows stand together: at most ``MOST_PARTS`` parts, of ``PER_PART`` records where that many do."""
    n = min(max(-(-records.count() // PER_PART), LEAST_PARTS), MOST_PARTS)
    part = F.pmod(F.xxhash64("entity_id"), F.lit(n)).cast("int")
    return records.withColumn("part", part).repartitionById(n, F.col("part"))


def _masks() -> Column:
    """The parts of a group's rows, as masks of ``BITS`` parts each."""
    bit = F.expr(f"shiftleft(1L, part % {BITS})")
    return F.array(*[F.bit_or(F.when(F.expr(f"part div {BITS}") == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(-(-MOST_PARTS // BITS))])


def _parts() -> Column:
    """The parts that ``masks`` tells."""
    own = f"filter(sequence(0, {BITS - 1}), b -> getbit(m, b) = 1)"
    return F.expr(f"flatten(transform(masks, (m, k) -> if(m = 0, cast(array() AS array<int>), transform({own}, b -> b + {BITS} * k))))")


def statistics(feats: DataFrame, records: DataFrame, max_df: int = K.MAX_DF, weights: dict[str, float] = K.WEIGHTS, corpus: bool = True) -> DataFrame:
    """``country, ns, key, df, cdf, idf, in_product`` of the features that primary records have.

    One aggregation gives the frequency among primary records and in the whole corpus. Without ``corpus`` the idf rests on primary records alone.
    Features with a ``part`` also get ``masks``, the parts that have them, which ``part_weights`` needs.
    """
    parts = "part" in feats.columns
    counted = feats if corpus else feats.where("src = 1")
    counts = counted.groupBy("country", "ns", "key").agg(F.count_if(F.col("src") == 1).alias("df"), F.count("*").alias("cdf"), *([_masks().alias("masks")] if parts else [])).where("df > 0")
    size = (records if corpus else records.where("src = 1")).groupBy("country").agg(F.count("*").alias("n"))
    idf = F.log((F.col("n") + 1) / (F.col("cdf") + 1)) + 1
    weight = F.create_map(*[x for ns, w in weights.items() for x in (F.lit(ns), F.lit(w))])
    return counts.join(size, "country").select("country", "ns", "key", "df", "cdf", idf.alias("idf"), ((F.col("df") <= max_df) & (weight[F.col("ns")] > 0)).alias("in_product"), *(["masks"] if parts else []))


def weights(feats: DataFrame, stats: DataFrame, unseen_idf: DataFrame | None = None) -> DataFrame:
    """``rec_id, src, country, ns, key, norm, w, in_product``: idf over the norm of the record's known features in the namespace.

    With ``unseen_idf`` (``country, most``) unknown features stay in the norm with that idf.
    """
    known = feats.join(stats.select("country", "ns", "key", "idf", "in_product"), ["country", "ns", "key"], "left" if unseen_idf else "inner")
    if unseen_idf:
        known = known.join(unseen_idf, "country").withColumns({"idf": F.coalesce("idf", "most"), "in_product": F.coalesce("in_product", F.lit(False))}).drop("most")
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("rec_id", "ns")))
    # A record's rows stay together, so that they are stored, and packed later, with its id once.
    known = known.repartition("rec_id")
    return known.withColumn("norm", norm).withColumn("w", F.col("idf") / F.col("norm")).drop("idf")


def part_weights(records: DataFrame, stats: DataFrame) -> DataFrame:
    """The same as ``weights`` for the records of ``dealt``: not a record's features travel, but once to each part the statistics of those that it has.

    Features are made again from the records after these have met the statistics, and stay in their part to the end. ``met`` tells whether others than
    primary records have the feature, for without them it adds to no product.
    """
    n = records.agg(F.max("part")).first()[0]
    source = ("nm_parts", "nm_tok", "nm_concat", "ad_tok", "ad_num", "ad_code", "ad_first_num")
    mine = records.select("part", F.lit(True).alias("mine"), F.col("entity_id").alias("rec_id"), "src", "country", *source)
    known = stats.select(F.explode(_parts()).alias("part"), F.lit(False).alias("mine"), "country", F.struct("ns", "key").alias("f"), "idf", "in_product", (F.col("cdf") > F.col("df")).alias("met"))
    both = mine.unionByName(known, allowMissingColumns=True).repartitionById(1 + (n or 0), F.col("part"))
    each = both.select("part", "mine", "rec_id", "src", "country", "idf", "in_product", "met", F.explode(F.when(F.col("mine"), _every(K.WEIGHTS)).otherwise(F.array("f"))).alias("f"))
    flat = each.select("part", "mine", "rec_id", "src", "country", "f.ns", "f.key", "idf", "in_product", "met")
    of = Window.partitionBy("part", "country", "ns", "key")
    found = flat.withColumns({c: F.max(c).over(of) for c in ("idf", "in_product", "met")}).where("mine AND idf IS NOT NULL")
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("part", "rec_id", "ns")))
    return found.withColumn("norm", norm).select("rec_id", "src", "country", "ns", "key", "in_product", "met", "norm", (F.col("idf") / F.col("norm")).alias("w"))


def six_spaces(records: DataFrame) -> DataFrame:
    """Weights of the older model: six namespaces, idf from primary records alone, unknown features with the greatest idf in the norm."""
    feats = features(records, K.OLD_WEIGHTS)
    stats = statistics(feats, records, K.OLD_MAX_DF, K.OLD_WEIGHTS, corpus=False)
    most = records.where("src = 1").groupBy("country").agg((F.log(F.count("*") + 1) + 1).alias("most"))
    return weights(feats, stats, most)


def unseen(feats: DataFrame, stats: DataFrame) -> DataFrame:
    """``rec_id, ns, unseen``: the share of a record's features that no primary record has."""
    seen = feats.join(stats.select("country", "ns", "key", F.lit(1).alias("seen")), ["country", "ns", "key"], "left")
    return seen.groupBy("rec_id", "ns").agg((1 - F.count("seen") / F.count("*")).alias("unseen"))


def unseen_left(feats: DataFrame, weighted: DataFrame) -> DataFrame:
    """The same as ``unseen``, from the stored weights of all known features: only counts travel."""
    every = feats.groupBy("rec_id", "ns").agg(F.count("*").alias("n"))
    known = weighted.groupBy("rec_id", "ns").agg(F.count("*").alias("known"))
    return every.join(known, ["rec_id", "ns"], "left").select("rec_id", "ns", (1 - F.coalesce("known", F.lit(0)) / F.col("n")).alias("unseen"))


def vectors(weighted: DataFrame) -> DataFrame:
    """``rec_id, vec, norms``: each record's weights as one array of namespace, hashed key and weight, and its norm in each namespace."""
    entry = F.struct("ns", F.xxhash64("ns", "key").alias("id"), "w")
    norms = F.array(*[F.max(F.when(F.col("ns") == ns, F.col("norm"))) for ns in K.WEIGHTS])
    return weighted.groupBy("rec_id").agg(F.collect_list(entry).alias("vec"), norms.alias("norms"))
