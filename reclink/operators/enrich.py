"""What the differences between two records say: vocabulary, structure, legal forms, codes, shared deviations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.functions import constants as K
from reclink.functions.strings import compare
from reclink.operators.pairs import either_affix, legal_tokens, sides


def token_stats(records: DataFrame, by_country: bool = True) -> DataFrame:
    """``country, t, df, lratio, dfpct`` of name tokens, for countries that have primary and query records.

    Without ``by_country`` one vocabulary of all countries counts, under each country that has it.
    """
    if not by_country:
        pooled = token_stats(records.withColumn("country", F.lit("")))
        return records.select("country", F.explode("nm_tok").alias("t")).distinct().join(pooled.drop("country"), "t").select("country", "t", "df", "lratio", "dfpct")
    primary = F.col("src") == 1
    size = records.groupBy("country").agg(F.count_if(primary).alias("n1"), F.count_if(~primary).alias("nq")).where("n1 > 0 AND nq > 0")
    counts = records.select("country", "src", F.explode("nm_tok").alias("t")).groupBy("country", "t").agg(F.count_if(primary).alias("df"), F.count_if(~primary).alias("nq_t"))
    lratio = F.log(((F.col("nq_t") + 1) / F.col("nq")) / ((F.col("df") + 1) / F.col("n1")))
    known = counts.join(size, "country").select("country", "t", "df", lratio.alias("lratio"))
    # The running share depends on the frequency alone, so it is made over one row a frequency, not a token.
    by_df = known.groupBy("country", "df").agg(F.sum("df").alias("mass"))
    w = Window.partitionBy("country")
    share = by_df.select("country", "df", (F.sum("mass").over(w.orderBy("df")) / F.sum("mass").over(w)).alias("dfpct"))
    return known.join(share, ["country", "df"]).select("country", "t", "df", "lratio", "dfpct")


def structure(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query side ``q_id, q_addr_s1n, q_support``, primary side ``s1_id, s_addr_n, s_addr_w1_n, s_support``); null without a usable address.

    Records without a usable address (they would share a few keys) take no part in the joins.
    """
    first = F.coalesce("ad_first_num", F.lit(""))
    a = F.concat(first, F.lit("|"), F.array_join(F.slice("ad_tok", 1, 2), " "))
    k = F.concat("nm_core", F.lit("|"), first, F.lit("|"), F.coalesce(F.get("ad_tok", 0), F.lit("")))
    r = records.select("entity_id", "src", "country", a.alias("a"), k.alias("k"), F.coalesce(F.get("nm_tok", 0), F.lit("")).alias("w1"))
    ok = F.length("a") > 3
    s, q = r.where((F.col("src") == 1) & ok), r.where((F.col("src") > 1) & ok)
    at = s.groupBy("country", "a").agg(F.count("*").alias("n"))
    at_word = s.groupBy("country", "a", "w1").agg(F.count("*").alias("n_w1"))
    same = q.groupBy("country", "k").agg(F.count("*").alias("nk"))
    none, null = F.lit(0), F.lit(None).cast("long")
    s_out = s.join(at, ["country", "a"], "left").join(at_word, ["country", "a", "w1"], "left").join(same, ["country", "k"], "left")
    q_out = q.join(at, ["country", "a"], "left").join(same, ["country", "k"], "left")
    q_rest, s_rest = r.where((F.col("src") > 1) & ~ok), r.where((F.col("src") == 1) & ~ok)
    return (
        q_out.select(F.col("entity_id").alias("q_id"), F.coalesce("n", none).cast("long").alias("q_addr_s1n"), (F.col("nk") - 1).alias("q_support"))
        .unionByName(q_rest.select(F.col("entity_id").alias("q_id"), null.alias("q_addr_s1n"), null.alias("q_support"))),
        s_out.select(F.col("entity_id").alias("s1_id"), F.col("n").alias("s_addr_n"), F.col("n_w1").alias("s_addr_w1_n"), F.coalesce("nk", none).cast("long").alias("s_support"))
        .unionByName(s_rest.select(F.col("entity_id").alias("s1_id"), null.alias("s_addr_n"), null.alias("s_addr_w1_n"), null.alias("s_support"))),
    )


def with_tokens(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``entity_id, tokens``: each record's name tokens with ``t, df, lratio, dfpct``; tokens outside the vocabulary have zeros."""
    each = records.select("entity_id", "country", F.explode("nm_tok").alias("t")).join(vocabulary, ["country", "t"], "left").na.fill(0, ["df", "lratio", "dfpct"])
    return each.groupBy("entity_id").agg(F.collect_list(F.struct("t", "df", "lratio", "dfpct")).alias("tokens"))


def _best_match(own: pd.Series, other: pd.Series) -> pd.Series:
    """For each token of the one list the best similarity to a token of the other; no list where either is empty."""
    rows = [(k, i, a, b) for k, (x, y) in enumerate(zip(own, other)) if x is not None and y is not None for i, a in enumerate(x) for b in y]
    out: list[np.ndarray | None] = [np.zeros(len(x)) if x is not None and y is not None and len(x) and len(y) else None for x, y in zip(own, other)]
    if rows:
        row, place, left, right = zip(*rows)
        value = compare("jaro_winkler", pd.Series(left), pd.Series(right)).to_numpy(dtype=float)
        for k, i, v in zip(row, place, value):
            out[k][i] = max(out[k][i], v)
    return pd.Series(out, dtype=object)


TOKEN_COLUMNS = ("n", "typo", "minjw", "noise", "vocab", "maxlratio", "maxpct", "minpct")
#: Columns by absolute frequency, of an older variant.
OLD_TOKEN_COLUMNS = ("known", "rare", "logmaxdf")


def unmatched_tokens(p: DataFrame, old: bool = False) -> DataFrame:
    """Add ``nm_qx_*`` and ``nm_sx_*`` to pairs with ``q_tokens`` and ``s_tokens``: what the tokens are that only one side has.

    A token counts only if the other side has an unmatched token as well. ``old`` adds the columns by absolute frequency.
    """
    none = F.array().cast("array<struct<t: string, df: bigint, lratio: double, dfpct: double>>")
    words = lambda c: F.transform(F.coalesce(c, none), lambda x: x["t"])
    only = lambda a, b: F.filter(F.coalesce(a, none), lambda x: ~F.array_contains(words(b), x["t"]))
    p = p.withColumns({"_q": only("q_tokens", "s_tokens"), "_s": only("s_tokens", "q_tokens")})
    best = F.pandas_udf(_best_match, "array<double>")
    p = p.withColumns({"_qb": best(words("_q"), words("_s")), "_sb": best(words("_s"), words("_q"))})
    count = lambda c, test: F.size(F.filter(c, test))
    out = {}
    for side in "qs":
        z = F.when(F.col(f"_{side}b").isNotNull(), F.zip_with(f"_{side}", f"_{side}b", lambda x, jw: F.struct(x["df"], x["lratio"], x["dfpct"], jw.alias("jw")))).otherwise(F.array().cast("array<struct<df: bigint, lratio: double, dfpct: double, jw: double>>"))
        p = p.withColumn(f"_{side}z", z)
        z, odd = F.col(f"_{side}z"), F.filter(f"_{side}z", lambda x: x["jw"] < K.TYPO)
        own = {
            "n": F.size(z), "typo": count(z, lambda x: x["jw"] >= K.TYPO), "minjw": F.array_min(F.transform(z, lambda x: x["jw"])), "noise": count(odd, lambda x: x["lratio"] >= K.NOISE_LOG_RATIO),
            "vocab": count(odd, lambda x: (x["lratio"] < K.NOISE_LOG_RATIO) & (x["df"] >= K.VOCABULARY_DF)), "maxlratio": F.array_max(F.transform(odd, lambda x: x["lratio"])),
            "maxpct": F.array_max(F.transform(odd, lambda x: x["dfpct"])), "minpct": F.array_min(F.transform(odd, lambda x: x["dfpct"])),
        }
        if old:
            own |= {"known": count(odd, lambda x: x["df"] >= K.VOCABULARY_DF), "rare": count(odd, lambda x: x["df"] < K.VOCABULARY_DF), "logmaxdf": F.log1p(F.array_max(F.transform(odd, lambda x: x["df"])))}
        out |= {f"nm_{side}x_{c}": v for c, v in own.items()}
    return p.withColumns(out).drop("_q", "_s", "_qb", "_sb", "_qz", "_sz")


def long_tokens(pairs: DataFrame, records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``q_id, s1_id, side`` and the columns of ``unmatched_tokens``, for sides that have such tokens."""
    tokens = with_tokens(records, vocabulary)
    wide = unmatched_tokens(sides(pairs, records.select("entity_id").join(tokens, "entity_id", "left"), ["tokens"]))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), *[F.col(f"nm_{s}x_{c}").alias(c) for c in TOKEN_COLUMNS]) for s in "qs"])).alias("x")
    return wide.select("q_id", "s1_id", each).select("q_id", "s1_id", "x.*").where("n > 0")


def legal_columns() -> dict[str, Column]:
    """Legal forms that only one side has: numbers, whether the sides agree, and one flag a form and side."""
    q, s = legal_tokens(F.col("q_nm")), legal_tokens(F.col("s_nm"))
    qo, so = F.array_except(q, s), F.array_except(s, q)
    out = {"legal_q_only_n": F.size(qo), "legal_s_only_n": F.size(so), "legal_equal": ((F.size(q) > 0) & (F.size(qo) == 0) & (F.size(so) == 0)).cast("int")}
    return out | {f"legal_{side}_only_{form}": F.array_contains(only, form).cast("int") for form in K.LEGAL_FLAGS for side, only in (("q", qo), ("s", so))}


def legal_difference(pairs: DataFrame, records: DataFrame) -> DataFrame:
    return sides(pairs, records, ["nm"]).select("q_id", "s1_id", *[c.alias(n) for n, c in legal_columns().items()])


def with_codes(p: DataFrame) -> DataFrame:
    """Add ``code_minlev, code_affix, code_subst1`` over all pairs of codes; null where either side has none. Arrays in the row, no join."""

    def distance(a: Column, b: Column) -> Column:
        lev = F.levenshtein(a, b)
        return F.struct(lev.alias("lev"), ((lev > 0) & either_affix(a, b)).alias("affix"), ((lev == 1) & (F.length(a) == F.length(b))).alias("subst"))

    p = p.withColumn("_x", F.flatten(F.transform("q_ad_code", lambda a: F.transform("s_ad_code", lambda b: distance(a, b)))))
    some = F.size("_x") > 0
    return p.withColumns({
        "code_minlev": F.array_min(F.transform("_x", lambda v: v["lev"])), "code_affix": F.when(some, F.exists("_x", lambda v: v["affix"]).cast("int")),
        "code_subst1": F.when(some, F.exists("_x", lambda v: v["subst"]).cast("int")),
    }).drop("_x")


def code_difference(pairs: DataFrame, records: DataFrame) -> DataFrame:
    return with_codes(sides(pairs, records, ["ad_code"])).select("q_id", "s1_id", "code_minlev", "code_affix", "code_subst1")


COLLECTIVE = ("cd_ndev", "cd_share", "cd_share_strong", "cd_num_diff", "cd_num_share")


def collective(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """``q_id, s1_id, cd_ndev, cd_share, cd_share_strong, cd_num_diff, cd_num_share`` for pairs with a score ``p1``.

    How many other candidates of the primary record deviate from it by the same token, or by the same house number. Tokens and numbers
    are rows of one table, so one window counts both.
    """
    p = sides(pairs.withColumn("strong", (F.col("p1") >= 0.5).cast("int")), records, ["nm_tok", "ad_first_num"], ("strong",))
    differs = F.coalesce(F.col("q_ad_first_num") != F.col("s_ad_first_num"), F.lit(False))
    item = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("t"))
    tokens = F.transform(F.array_except("q_nm_tok", "s_nm_tok"), lambda t: item("t", t))
    number = F.when(differs, F.array(item("n", F.col("q_ad_first_num")))).otherwise(F.array().cast("array<struct<kind: string, t: string>>"))
    dev = p.select("q_id", "s1_id", "strong", F.explode_outer(F.concat(tokens, number)).alias("x")).select("q_id", "s1_id", "strong", "x.kind", "x.t")
    # Pairs without a deviation all have the same null; they are counted apart by their own ids.
    same = Window.partitionBy("s1_id", "kind", "t", F.when(F.col("kind").isNull(), F.col("q_id")))
    dev = dev.withColumns({"n": F.count("*").over(same) - 1, "ns": F.sum("strong").over(same) - F.col("strong")})
    word, num = F.col("kind") == "t", F.col("kind") == "n"
    most = lambda test, c: F.coalesce(F.max(F.when(test, F.col(c))), F.lit(0))
    return dev.groupBy("q_id", "s1_id").agg(
        F.count_if(word).alias("cd_ndev"), most(word, "n").alias("cd_share"), most(word, "ns").alias("cd_share_strong"),
        F.count_if(num).cast("int").alias("cd_num_diff"), most(num, "n").alias("cd_num_share"),
    )
