"""Features of candidate pairs, worked out in the row from both records' profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.functions import constants as K
from reclink.functions.strings import compare, similarities

SPACES = tuple(K.WEIGHTS)


def sides(pairs: DataFrame, records: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """``q_id, s1_id`` and ``keep`` with the named record columns of both sides, as ``q_*`` and ``s_*``."""
    q = records.select(F.col("entity_id").alias("q_id"), *[F.col(c).alias(f"q_{c}") for c in columns])
    s = records.select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"s_{c}") for c in columns])
    return pairs.select("q_id", "s1_id", *keep).join(q, "q_id").join(s, "s1_id")


def _of(vec: str, ns: str) -> Column:
    return F.filter(vec, lambda x: x["ns"] == ns)


def vector_sides() -> tuple[dict[str, Column], dict[str, Column]]:
    """What ``with_cosines`` needs of a query's and of a primary record's ``vec``: entries of the one, a map of the other, sizes of both."""
    sizes = lambda side: {f"{side}_nnz_{ns}": F.coalesce(F.size(_of("vec", ns)), F.lit(0)) for ns in SPACES}
    as_map = F.map_from_entries(F.transform("vec", lambda x: F.struct(x["id"], x["w"])))
    return {"q_vec": F.col("vec"), **sizes("q")}, {"s_map": as_map, **sizes("s")}


def with_cosines(p: DataFrame) -> DataFrame:
    """Add ``cos_*, ovl_*, jac_*`` to pairs with the columns of ``vector_sides``.

    The dot product looks one side's keys up in the other's map. Nothing in common gives zeros, and no feature on either side no ``jac``.
    """
    none = F.array().cast("array<struct<ns: string, id: bigint, w: double>>")
    shared = F.filter(F.transform(F.coalesce("q_vec", none), lambda x: F.struct(x["ns"].alias("ns"), (x["w"] * F.try_element_at("s_map", x["id"])).alias("x"))), lambda x: x["x"].isNotNull())
    p = p.withColumn("_shared", shared).drop("q_vec", "s_map")
    add = lambda total, x: total + x["x"]
    out = {}
    for ns in SPACES:
        own = _of("_shared", ns)
        either = F.col(f"q_nnz_{ns}") + F.col(f"s_nnz_{ns}") - F.size(own)
        out |= {f"cos_{ns}": F.aggregate(own, F.lit(0.0), add), f"ovl_{ns}": F.size(own), f"jac_{ns}": F.when(either > 0, F.size(own) / either)}
    return p.withColumns(out).drop("_shared")


def cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``q_id, s1_id`` and ``cos_*, ovl_*, q_nnz_*, s_nnz_*, jac_*`` of all namespaces, over all known features, also those too frequent for retrieval.

    Only the keys of a query record and its norms travel to each of its pairs: a shared key has the same idf on both sides, so the one side's
    weight is the other's by the ratio of the norms.
    """
    sizes = lambda side: [F.size(_of("vec", ns)).alias(f"{side}_nnz_{ns}") for ns in SPACES]
    entries = F.map_from_entries(F.transform("vec", lambda x: F.struct(x["id"], F.struct(x["ns"].alias("ns"), x["w"].alias("w")))))
    mine = vectors.select(F.col("rec_id").alias("q_id"), F.transform("vec", lambda x: x["id"]).alias("q_keys"), F.col("norms").alias("q_norms"), *sizes("q"))
    other = vectors.select(F.col("rec_id").alias("s1_id"), entries.alias("s_map"), F.col("norms").alias("s_norms"), *sizes("s"))
    p = pairs.select("q_id", "s1_id").join(mine, "q_id", "left").join(other, "s1_id", "left").na.fill(0, [f"{x}_nnz_{ns}" for x in "qs" for ns in SPACES])
    none = F.array().cast("array<bigint>")
    p = p.withColumn("_shared", F.filter(F.transform(F.coalesce("q_keys", none), lambda x: F.try_element_at("s_map", x)), lambda x: x.isNotNull())).drop("q_keys", "s_map")
    p = p.withColumn("_shared", F.coalesce("_shared", F.array().cast(p.schema["_shared"].dataType)))
    out = {}
    for k, ns in enumerate(SPACES):
        own = _of("_shared", ns)
        square = F.aggregate(own, F.lit(0.0), lambda total, x: total + x["w"] * x["w"])
        either = F.col(f"q_nnz_{ns}") + F.col(f"s_nnz_{ns}") - F.size(own)
        cos = F.coalesce(square * (F.col("s_norms")[k] / F.col("q_norms")[k]), F.lit(0.0))
        out |= {f"cos_{ns}": cos, f"ovl_{ns}": F.size(own), f"jac_{ns}": F.when(either > 0, F.size(own) / either)}
    return p.withColumns(out).drop("_shared", "q_norms", "s_norms")


def long_cosines(wide: DataFrame) -> DataFrame:
    """``q_id, s1_id, ns, cos, ovl, q_nnz, s_nnz, jac`` of the namespaces in which a pair has something in common."""
    names = ("cos", "ovl", "q_nnz", "s_nnz", "jac")
    each = F.explode(F.array(*[F.struct(F.lit(ns).alias("ns"), *[F.col(f"{n}_{ns}").alias(n) for n in names]) for ns in SPACES])).alias("x")
    return wide.select("q_id", "s1_id", each).select("q_id", "s1_id", "x.*").where("ovl > 0")


def legal_tokens(name: Column) -> Column:
    return F.array_intersect(F.split(name, " "), F.array(*[F.lit(x) for x in K.LEGAL]))


def either_affix(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a)


NATIVE_SIDES = ("nm", "nm_core", "nm_concat", "nm_tok", "ad", "ad_comp", "ad_first_num", "nm_native")


def record_sizes(side: str = "") -> dict[str, Column]:
    """Lengths and counts of a record's name and address; ``side`` is what its columns begin with."""
    return {"nmlen": F.length(f"{side}nm_core"), "adlen": F.length(f"{side}ad"), "ncomp": F.size(f"{side}ad_comp"), "nmtok": F.size(f"{side}nm_tok")}


def native_columns() -> dict[str, Column]:
    """Pair features that Spark computes itself: names, house numbers, legal forms, sizes. Null means not applicable."""
    a, b = F.col("q_ad_first_num"), F.col("s_ad_first_num")
    both = a.isNotNull() & b.isNotNull()
    number = lambda x: F.substring(x, 1, 9).try_cast("bigint").cast("double")
    legal_q, legal_s = legal_tokens(F.col("q_nm")), legal_tokens(F.col("s_nm"))
    legal = (F.size(legal_q) > 0) & (F.size(legal_s) > 0)
    sizes = {s: record_sizes(f"{s}_") for s in "qs"}
    return {
        "nm_concat_eq": (F.col("q_nm_concat") == F.col("s_nm_concat")).cast("int"),
        "fnum_eq": F.when(both, (a == b).cast("int")), "hn_lev": F.when(both, F.levenshtein(a, b)),
        "hn_logdiff": F.when(both, F.log1p(F.abs(number(a) - number(b)))), "hn_affix": F.when(both, either_affix(a, b).cast("int")),
        "hn_lendiff": F.when(both, F.length(a) - F.length(b)),
        "legal_both": legal.cast("int"), "legal_same": F.when(legal, F.arrays_overlap(legal_q, legal_s).cast("int")),
        **{f"{s}_{n}": sizes[s][n] for n in sizes["q"] for s in "qs"}, "q_native": F.col("q_nm_native").cast("int"),
    }


def native(pairs: DataFrame, records: DataFrame) -> DataFrame:
    columns = native_columns()
    return sides(pairs, records, list(NATIVE_SIDES)).select("q_id", "s1_id", *[c.alias(n) for n, c in columns.items()])


def _best_part(parts: pd.Series, core: pd.Series) -> pd.DataFrame:
    """Best ratios of any part of the one name; a name without parts has one empty part."""
    lists = [list(p) if p is not None and len(p) else [""] for p in parts]
    owner = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    each, other = pd.Series([x for p in lists for x in p], dtype=object), core.iloc[owner].reset_index(drop=True)
    out = {}
    for name, function in (("nm_part_ratio", "ratio"), ("nm_part_tset", "token_set")):
        best = np.zeros(len(lists))
        np.maximum.at(best, owner, compare(function, each, other).to_numpy(dtype=float, na_value=0.0))
        out[name] = best
    return pd.DataFrame(out)


STRING_SIDES = ("nm", "nm_core", "nm_concat", "nm_parts", "ad", "ad_first_num")


def string_columns() -> dict[str, Column]:
    """Structs of fuzzy similarities of names, addresses and house numbers, and of the best part of a query name of several parts."""
    pick = {"ratio": "ratio", "token_sort": "tsort", "token_set": "tset", "partial": "partial"}
    q, s = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"s_{c}"))
    wanted = {f"{p}_{short}": (f, q(c), s(c)) for p, c in (("nm", "nm_core"), ("ad", "ad")) for f, short in pick.items()}
    wanted |= {"nm_jw_concat": ("jaro_winkler", q("nm_concat"), s("nm_concat")), "nm_full_ratio": ("ratio", q("nm"), s("nm")), "fnum_jw": ("jaro_winkler", q("ad_first_num"), s("ad_first_num"))}
    parts = F.pandas_udf(_best_part, "nm_part_ratio double, nm_part_tset double")(q("nm_parts"), s("nm_core"))
    return {"strings": similarities(wanted), "parts": parts}


def names(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """All fuzzy similarities: one pass of Arrow batches over the pairs."""
    p = sides(pairs, records, list(STRING_SIDES))
    return p.select("q_id", "s1_id", F.size("q_nm_parts").alias("q_nparts"), *[c.alias(n) for n, c in string_columns().items()]).select("q_id", "s1_id", "q_nparts", "strings.*", "parts.*")
