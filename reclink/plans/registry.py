"""All queries over the record view, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reclink.functions import constants as K
from reclink.functions.strings import similarity
from reclink.functions.text import bucket
from reclink.operators import blocking, decide, enrich, features, model, pairs, translit
from reclink.operators.normalize import normalize
from reclink.plans import linkage
from reclink.plans import oracles as O
from reclink.sources import records as R
from reclink.sources.stages import check_lists, materialize, shared_dir

FLAGSHIP = "topk_blocking"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def view(spark: SparkSession, sf: str) -> DataFrame:
    return R.record_view(spark.read.parquet(f"{sf.rstrip('/')}/documents.parquet"))


def norm(spark: SparkSession, sf: str) -> DataFrame:
    # The test tables are one file of one row group, which one task reads; the narrow records are dealt to all.
    return normalize(view(spark, sf).repartition("entity_id"))


class Linked(NamedTuple):
    """Stored tables of one query: each is read several times, by statistics, norms, both sides of joins."""

    recs: DataFrame
    feats: DataFrame
    stats: DataFrame
    weighted: DataFrame


def linked(spark: SparkSession, sf: str) -> Linked:
    recs = materialize(normalize(features.dealt(view(spark, sf))).drop("ck"))
    feats = features.features(recs)
    stats = materialize(features.statistics(feats, recs))
    return Linked(recs, feats, stats, materialize(features.part_weights(recs, stats)))


def listed(found: Linked) -> DataFrame:
    """Pruned candidate lists, stored."""
    return materialize(blocking.pruned(found.weighted))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return listed(linked(spark, sf))


def with_scores(pruned: DataFrame) -> DataFrame:
    """Pruned pairs with the blocking score as ``p`` and a hashed ``p1``, so that decision queries need no model."""
    p1 = F.conv(F.substring(F.md5(F.concat("q_id", F.lit("|"), "s1_id")), 1, 8), 16, 10).cast("long") % 1000
    return pruned.select("q_id", "s1_id", F.round("bscore", 6).alias("p"), F.round(p1 / 1000.0, 3).alias("p1"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_scores(kept(spark, sf))


def scored_records(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(scored pairs, normalised records), both stored."""
    found = linked(spark, sf)
    return with_scores(listed(found)), found.recs


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """``s1_id, match_id``: records whose texts start alike, in one country."""
    recs = view(spark, sf)
    entity = recs.where("src = 1").groupBy("country", "ck").agg(F.min(F.col("entity_id").cast("long")).cast("string").alias("s1_id"))
    return recs.where("src > 1").join(entity, ["country", "ck"]).select("s1_id", F.col("entity_id").alias("match_id"))


def primary(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf).where("src = 1").select(F.col("entity_id").alias("s1_id"))


def joined(c: str, by: str = " ") -> Column:
    return F.array_join(c, by).alias(c)


def r6(c: str) -> Column:
    return F.round(c, 6).alias(c)


@query(f"WITH {O.REC} SELECT * FROM rec")
def rec_view(spark, sf):
    return view(spark, sf)


@query(f"WITH {O.NORM} SELECT entity_id, nm, array_to_string(nm_parts, '|') AS nm_parts, array_to_string(nm_tok, ' ') AS nm_tok, nm_core, nm_concat FROM norm")
def normalize_names(spark, sf):
    return norm(spark, sf).select("entity_id", "nm", joined("nm_parts", "|"), joined("nm_tok"), "nm_core", "nm_concat")


@query(f"WITH {O.NORM} SELECT entity_id, ad, array_to_string(ad_comp, '|') AS ad_comp, array_to_string(ad_tok, ' ') AS ad_tok, array_to_string(ad_code, ' ') AS ad_code, ad_first_num FROM norm")
def normalize_addresses(spark, sf):
    return norm(spark, sf).select("entity_id", "ad", joined("ad_comp", "|"), joined("ad_tok"), joined("ad_code"), "ad_first_num")


@query(f"WITH {O.FEATS} SELECT rec_id, ns, key FROM feats WHERE ns IN ('nw', 'ng', 'aw', 'an', 'ac')")
def features_simple(spark, sf):
    return features.features(norm(spark, sf)).where(F.col("ns").isin("nw", "ng", "aw", "an", "ac")).select("rec_id", "ns", "key")


@query(f"WITH {O.FEATS} SELECT rec_id, ns, key FROM feats WHERE ns IN ('ap', 'np', 'xn', 'ab')")
def features_compound(spark, sf):
    return features.features(norm(spark, sf)).where(F.col("ns").isin("ap", "np", "xn", "ab")).select("rec_id", "ns", "key")


@query(f"WITH {O.STATS} SELECT country, ns, key, df, cdf, round(idf, 6) AS idf, in_product FROM stats")
def doc_freq_idf(spark, sf):
    return linked(spark, sf).stats.select("country", "ns", "key", "df", "cdf", r6("idf"), "in_product")


@query(f"WITH {O.WEIGHTED} SELECT rec_id, ns, count(*) AS n, round(sum(w * w), 6) AS norm FROM wt GROUP BY 1, 2")
def weights_norm(spark, sf):
    return linked(spark, sf).weighted.groupBy("rec_id", "ns").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("norm"))


@query(f"WITH {O.STATS} SELECT rec_id, ns, round(1 - count(df) / count(*), 6) AS unseen FROM feats LEFT JOIN stats USING (country, ns, key) GROUP BY 1, 2")
def unseen_fraction(spark, sf):
    found = linked(spark, sf)
    return features.unseen_left(found.feats, found.weighted).select("rec_id", "ns", r6("unseen"))


@query(f"WITH {O.TOP} SELECT q_id, s1_id, country, round(bscore, 6) AS bscore, brank FROM top")
def topk_blocking(spark, sf):
    return blocking.topk(linked(spark, sf).weighted).select("q_id", "s1_id", "country", r6("bscore"), "brank")


@query(f"WITH {O.TOP} SELECT q_id, s1_id, brank, round(top1, 6) AS top1, round(top2, 6) AS top2, n_ret, round(gap_top1, 6) AS gap_top1, round(top_margin, 6) AS top_margin, round(ratio_top1, 6) AS ratio_top1 FROM kept")
def prune_candidates(spark, sf):
    return kept(spark, sf).select("q_id", "s1_id", "brank", r6("top1"), r6("top2"), "n_ret", r6("gap_top1"), r6("top_margin"), r6("ratio_top1"))


@query(f"""WITH {O.TOP} SELECT q_id, s1_id, count(*) OVER v AS s1_nq, CAST(sum(CASE WHEN brank = 0 THEN 1 ELSE 0 END) OVER v AS BIGINT) AS s1_ntop1,
  row_number() OVER (PARTITION BY s1_id ORDER BY bscore DESC, q_id) AS s1_rank, round(bscore - max(bscore) OVER v, 6) AS s1_gap FROM kept WINDOW v AS (PARTITION BY s1_id)""")
def s1_context(spark, sf):
    return blocking.s1_context(kept(spark, sf)).select("q_id", "s1_id", "s1_nq", "s1_ntop1", "s1_rank", r6("s1_gap"))


@query(f"WITH {O.NORM} SELECT a.entity_id, count(b.entity_id) AS name_freq FROM norm a LEFT JOIN (SELECT * FROM norm WHERE src = 1) b ON a.country = b.country AND a.nm_core = b.nm_core GROUP BY 1")
def name_freq(spark, sf):
    return blocking.name_frequency(materialize(norm(spark, sf).select("entity_id", "src", "country", "nm_core")))


@query(f"""WITH {O.TOP}, sz AS (SELECT rec_id, ns, count(*) AS nnz FROM wt GROUP BY 1, 2)
SELECT k.q_id, k.s1_id, q.ns, round(sum(q.w * s.w), 6) AS cos, count(*) AS ovl, any_value(a.nnz) AS q_nnz, any_value(b.nnz) AS s_nnz, round(count(*) / (any_value(a.nnz) + any_value(b.nnz) - count(*)), 6) AS jac
FROM kept k JOIN wt q ON k.q_id = q.rec_id JOIN wt s ON k.s1_id = s.rec_id AND q.ns = s.ns AND q.key = s.key JOIN sz a ON a.rec_id = k.q_id AND a.ns = q.ns JOIN sz b ON b.rec_id = k.s1_id AND b.ns = q.ns GROUP BY 1, 2, 3""")
def pair_cosine(spark, sf):
    found = linked(spark, sf)
    wide = pairs.cosines(listed(found), features.vectors(found.weighted))
    return pairs.long_cosines(wide).select("q_id", "s1_id", "ns", r6("cos"), F.col("ovl").cast("long").alias("ovl"), F.col("q_nnz").cast("long").alias("q_nnz"), F.col("s_nnz").cast("long").alias("s_nnz"), r6("jac"))


@query(f"""WITH {O.TOP}, un AS (SELECT rec_id, ns, round(1 - count(st.df) / count(*), 6) AS unseen FROM feats LEFT JOIN stats st USING (country, ns, key) GROUP BY 1, 2)
SELECT q_id, s1_id, ns, unseen FROM kept JOIN un ON q_id = rec_id""")
def pair_unseen(spark, sf):
    found = linked(spark, sf)
    return listed(found).select("q_id", "s1_id").join(features.unseen_left(found.feats, found.weighted).withColumnRenamed("rec_id", "q_id"), "q_id").select("q_id", "s1_id", "ns", r6("unseen"))


_LEGAL = lambda c: f"list_filter(string_split({c}, ' '), lambda x: list_contains({O.listed(K.LEGAL)}, x))"


@query(f"""WITH {O.side('nm, nm_concat')},
z AS (SELECT *, {_LEGAL('q_nm')} AS lq, {_LEGAL('s_nm')} AS ls FROM both_)
SELECT q_id, s1_id, CAST(q_nm_concat = s_nm_concat AS INTEGER) AS nm_concat_eq, CAST(len(lq) > 0 AND len(ls) > 0 AS INTEGER) AS legal_both, CASE WHEN len(lq) > 0 AND len(ls) > 0 THEN CAST(list_has_any(lq, ls) AS INTEGER) END AS legal_same FROM z""")
def pair_native(spark, sf):
    return pairs.native(*scored_records(spark, sf)).select("q_id", "s1_id", "nm_concat_eq", "legal_both", "legal_same")


@query(f"""WITH {O.side('ad_first_num')}, z AS (SELECT *, q_ad_first_num AS a, s_ad_first_num AS b, q_ad_first_num IS NOT NULL AND s_ad_first_num IS NOT NULL AS ok FROM both_)
SELECT q_id, s1_id, CASE WHEN ok THEN CAST(a = b AS INTEGER) END AS fnum_eq, CASE WHEN ok THEN round({O.winkler('a', 'b')}, 6) END AS fnum_jw, CASE WHEN ok THEN CAST(levenshtein(a, b) AS INTEGER) END AS hn_lev,
  CASE WHEN ok THEN round(ln(1 + abs(TRY_CAST(substr(a, 1, 9) AS DOUBLE) - TRY_CAST(substr(b, 1, 9) AS DOUBLE))), 6) END AS hn_logdiff,
  CASE WHEN ok THEN CAST(starts_with(a, b) OR starts_with(b, a) OR suffix(a, b) OR suffix(b, a) AS INTEGER) END AS hn_affix, CASE WHEN ok THEN CAST(length(a) - length(b) AS INTEGER) END AS hn_lendiff FROM z""")
def house_number(spark, sf):
    p, recs = scored_records(spark, sf)
    both = pairs.sides(p, recs, list(dict.fromkeys((*pairs.NATIVE_SIDES, *pairs.STRING_SIDES))))
    number = {n: c for n, c in pairs.native_columns().items() if n.startswith(("fnum", "hn_"))}
    out = both.withColumns(number | {"fnum_jw": similarity("jaro_winkler", F.col("q_ad_first_num"), F.col("s_ad_first_num"))})
    return out.select("q_id", "s1_id", "fnum_eq", r6("fnum_jw"), "hn_lev", r6("hn_logdiff"), "hn_affix", "hn_lendiff")


_NF = "(SELECT a.entity_id AS id, count(b.entity_id) AS f FROM norm a LEFT JOIN (SELECT * FROM norm WHERE src = 1) b ON a.country = b.country AND a.nm_core = b.nm_core GROUP BY 1)"


@query(rf"""WITH {O.side('src, business_name, nm_core, nm_tok, ad, ad_comp')}
SELECT q_id, s1_id, q_src AS src, CAST(length(q_nm_core) AS INTEGER) AS q_nmlen, CAST(length(s_nm_core) AS INTEGER) AS s_nmlen, CAST(length(q_ad) AS INTEGER) AS q_adlen, CAST(length(s_ad) AS INTEGER) AS s_adlen,
  CAST(len(q_ad_comp) AS INTEGER) AS q_ncomp, CAST(len(s_ad_comp) AS INTEGER) AS s_ncomp, CAST(len(q_nm_tok) AS INTEGER) AS q_nmtok, CAST(len(s_nm_tok) AS INTEGER) AS s_nmtok,
  CAST(regexp_matches(q_business_name, '[\x{{0900}}-\x{{0dff}}]') AS INTEGER) AS q_native, x.f AS q_name_freq, y.f AS s_name_freq
FROM both_ JOIN {_NF} x ON x.id = q_id JOIN {_NF} y ON y.id = s1_id""")
def record_meta(spark, sf):
    p, recs = scored_records(spark, sf)
    # Only the numbers of a record travel to its pairs.
    sizes = pairs.record_sizes()
    own = recs.select("entity_id", "src", F.col("nm_native").cast("int").alias("native"), *[c.alias(n) for n, c in sizes.items()])
    both = pairs.sides(p, own.join(blocking.name_frequency(recs), "entity_id"), ["src", "native", *sizes, "name_freq"])
    return both.select("q_id", "s1_id", F.col("q_src").alias("src"), *[f"{s}_{c}" for c in sizes for s in "qs"], "q_native", "q_name_freq", "s_name_freq")


@query(f"WITH {O.side('nm_concat')} SELECT q_id, s1_id, round({O.winkler('q_nm_concat', 's_nm_concat')}, 4) AS jw FROM both_")
def jaro_winkler(spark, sf):
    both = pairs.sides(*scored_records(spark, sf), ["nm_concat"])
    return both.select("q_id", "s1_id", F.round(similarity("jaro_winkler", F.col("q_nm_concat"), F.col("s_nm_concat")), 4).alias("jw"))


_STRINGS = ("nm_ratio", "nm_tsort", "nm_tset", "nm_partial", "ad_ratio", "ad_tsort", "ad_tset", "ad_partial")


@query(f"""WITH {O.side('nm, nm_core, nm_concat, ad')}, {O.fuzzy('nm', 'q_nm_core', 's_nm_core')}, {O.fuzzy('ad', 'q_ad', 's_ad')}
SELECT q_id, s1_id, {', '.join(f'round({c}, 6) AS {c}' for c in _STRINGS)}, round({O.winkler('q_nm_concat', 's_nm_concat')}, 6) AS nm_jw_concat, round({O.ratio('q_nm', 's_nm')}, 6) AS nm_full_ratio
FROM both_ JOIN nm_z USING (q_id, s1_id) JOIN ad_z USING (q_id, s1_id)""")
def string_similarity(spark, sf):
    return pairs.names(*scored_records(spark, sf)).select("q_id", "s1_id", *map(r6, (*_STRINGS, "nm_jw_concat", "nm_full_ratio")))


@query(f"""WITH {O.side('nm_parts, nm_core')}, e AS (SELECT q_id AS q, s1_id AS s, len(q_nm_parts) AS n, s_nm_core, unnest(CASE WHEN len(q_nm_parts) = 0 THEN [''] ELSE q_nm_parts END) AS part FROM both_),
each_ AS (SELECT q || '|' || s || '|' || row_number() OVER (PARTITION BY q, s) AS q_id, q || '|' || s AS s1_id, part, s_nm_core FROM e), {O.fuzzy('pt', 'part', 's_nm_core').replace('FROM both_)', 'FROM each_)')},
best_ AS (SELECT s1_id AS pair, max(pt_ratio) AS r, max(pt_tset) AS t FROM pt_z GROUP BY 1)
SELECT q_id, s1_id, CAST(len(q_nm_parts) AS INTEGER) AS q_nparts, round(r, 6) AS nm_part_ratio, round(t, 6) AS nm_part_tset FROM both_ JOIN best_ ON pair = q_id || '|' || s1_id""")
def alias_parts(spark, sf):
    return pairs.names(*scored_records(spark, sf)).select("q_id", "s1_id", "q_nparts", r6("nm_part_ratio"), r6("nm_part_tset"))


VOCAB = f"""{O.PAIRS},
sz AS (SELECT country, count(*) FILTER (src = 1) AS n1, count(*) FILTER (src > 1) AS nq FROM norm GROUP BY 1 HAVING n1 > 0 AND nq > 0),
tk AS (SELECT country, t, count(*) FILTER (src = 1) AS df, count(*) FILTER (src > 1) AS nt FROM (SELECT country, src, unnest(nm_tok) AS t FROM norm) GROUP BY 1, 2),
vocab AS (SELECT country, t, df, ln(((nt + 1) / nq) / ((df + 1) / n1)) AS lratio, sum(df) OVER (PARTITION BY country ORDER BY df RANGE UNBOUNDED PRECEDING) / sum(df) OVER (PARTITION BY country) AS dfpct FROM tk JOIN sz USING (country))"""


@query(f"WITH {VOCAB} SELECT country, t, df, round(lratio, 6) AS lratio, round(dfpct, 6) AS dfpct FROM vocab")
def token_stats(spark, sf):
    return enrich.token_stats(materialize(norm(spark, sf).select("src", "country", "nm_tok"))).select("country", "t", "df", r6("lratio"), r6("dfpct"))


STRUCT = f"""{O.NORM},
st AS (SELECT *, coalesce(ad_first_num, '') || '|' || array_to_string(ad_tok[1:2], ' ') AS a, nm_core || '|' || coalesce(ad_first_num, '') || '|' || coalesce(ad_tok[1], '') AS k, coalesce(nm_tok[1], '') AS w1 FROM norm),
su AS (SELECT *, length(a) > 3 AS ok FROM st),
sa AS (SELECT country, a, count(*) AS n FROM su WHERE ok AND src = 1 GROUP BY 1, 2), sw AS (SELECT country, a, w1, count(*) AS n_w1 FROM su WHERE ok AND src = 1 GROUP BY 1, 2, 3), qk AS (SELECT country, k, count(*) AS nk FROM su WHERE ok AND src > 1 GROUP BY 1, 2)"""


@query(f"WITH {STRUCT} SELECT entity_id AS q_id, CASE WHEN ok THEN coalesce(n, 0) END AS q_addr_s1n, CASE WHEN ok THEN nk - 1 END AS q_support FROM su LEFT JOIN sa USING (country, a) LEFT JOIN qk USING (country, k) WHERE src > 1")
def structure_q(spark, sf):
    return enrich.structure(materialize(norm(spark, sf)))[0]


@query(f"WITH {STRUCT} SELECT entity_id AS s1_id, CASE WHEN ok THEN n END AS s_addr_n, CASE WHEN ok THEN n_w1 END AS s_addr_w1_n, CASE WHEN ok THEN coalesce(nk, 0) END AS s_support FROM su LEFT JOIN sa USING (country, a) LEFT JOIN sw USING (country, a, w1) LEFT JOIN qk USING (country, k) WHERE src = 1")
def structure_s(spark, sf):
    return enrich.structure(materialize(norm(spark, sf)))[1]


@query(f"""{VOCAB.replace(O.PAIRS, 'WITH ' + O.side('country, nm_tok'))},
x AS (SELECT q_id, s1_id, q_country AS country, list_filter(q_nm_tok, lambda x: NOT list_contains(s_nm_tok, x)) AS qx, list_filter(s_nm_tok, lambda x: NOT list_contains(q_nm_tok, x)) AS sx FROM both_),
c AS (SELECT *, unnest(sx) AS b FROM (SELECT *, unnest(qx) AS a FROM x)), j AS (SELECT q_id, s1_id, country, a, b, {O.winkler('a', 'b')} AS jw FROM c),
t AS (SELECT q_id, s1_id, country, 'q' AS side, a AS t, max(jw) AS jw FROM j GROUP BY ALL UNION ALL SELECT q_id, s1_id, country, 's', b, max(jw) FROM j GROUP BY ALL),
k AS (SELECT t.*, coalesce(df, 0) AS df, coalesce(lratio, 0) AS lratio, coalesce(dfpct, 0) AS dfpct FROM t LEFT JOIN vocab v ON v.country = t.country AND v.t = t.t)
SELECT q_id, s1_id, side, count(*) AS n, count(*) FILTER (jw >= {K.TYPO}) AS typo, round(min(jw), 6) AS minjw, count(*) FILTER (jw < {K.TYPO} AND lratio >= {K.NOISE_LOG_RATIO}) AS noise,
  count(*) FILTER (jw < {K.TYPO} AND lratio < {K.NOISE_LOG_RATIO} AND df >= {K.VOCABULARY_DF}) AS vocab, round(max(lratio) FILTER (jw < {K.TYPO}), 6) AS maxlratio,
  round(max(dfpct) FILTER (jw < {K.TYPO}), 6) AS maxpct, round(min(dfpct) FILTER (jw < {K.TYPO}), 6) AS minpct FROM k GROUP BY 1, 2, 3""")
def diff_tokens(spark, sf):
    p, recs = scored_records(spark, sf)
    whole = [F.col(c).cast("long").alias(c) for c in ("n", "typo", "noise", "vocab")]
    return enrich.long_tokens(p, recs, enrich.token_stats(recs)).select("q_id", "s1_id", "side", *whole, *map(r6, ("minjw", "maxlratio", "maxpct", "minpct")))


_DIFF = lambda a, b: f"list_sort(list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x))))"


_FORMS = ", ".join(f"CAST(list_contains({c}o, '{f}') AS INTEGER) AS legal_{c}_only_{f}" for f in K.LEGAL_FLAGS for c in "qs")


@query(f"""WITH {O.side('nm')}, z AS (SELECT *, {_LEGAL('q_nm')} AS lq, {_LEGAL('s_nm')} AS ls FROM both_), y AS (SELECT *, {_DIFF('lq', 'ls')} AS qo, {_DIFF('ls', 'lq')} AS so FROM z)
SELECT q_id, s1_id, CAST(len(qo) AS INTEGER) AS legal_q_only_n, CAST(len(so) AS INTEGER) AS legal_s_only_n, CAST(len(lq) > 0 AND len(qo) = 0 AND len(so) = 0 AS INTEGER) AS legal_equal, {_FORMS} FROM y""")
def legal_diff(spark, sf):
    return enrich.legal_difference(*scored_records(spark, sf))


@query(f"""WITH {O.side('ad_code')}, x AS (SELECT q_id, s1_id, a, unnest(s_ad_code) AS b FROM (SELECT q_id, s1_id, s_ad_code, unnest(q_ad_code) AS a FROM both_)),
y AS (SELECT *, levenshtein(a, b) AS lev FROM x),
z AS (SELECT q_id, s1_id, min(lev) AS m, bool_or(lev > 0 AND (starts_with(a, b) OR starts_with(b, a) OR suffix(a, b) OR suffix(b, a))) AS f, bool_or(lev = 1 AND length(a) = length(b)) AS g FROM y GROUP BY 1, 2)
SELECT q_id, s1_id, CAST(m AS INTEGER) AS code_minlev, CAST(f AS INTEGER) AS code_affix, CAST(g AS INTEGER) AS code_subst1 FROM both_ LEFT JOIN z USING (q_id, s1_id)""")
def code_diff(spark, sf):
    return enrich.code_difference(*scored_records(spark, sf))


@query(f"""WITH {O.side('nm_tok, ad_first_num')}, d0 AS (SELECT q_id, s1_id, CAST(p1 >= 0.5 AS INTEGER) AS st, unnest(list_distinct(list_filter(q_nm_tok, lambda x: NOT list_contains(s_nm_tok, x)))) AS t FROM both_),
d1 AS (SELECT *, count(*) OVER (PARTITION BY s1_id, t) AS n, sum(st) OVER (PARTITION BY s1_id, t) AS ns FROM d0),
d2 AS (SELECT q_id, s1_id, count(*) AS nd, max(n - 1) AS sh, CAST(max(ns - st) AS BIGINT) AS ss FROM d1 GROUP BY 1, 2),
m AS (SELECT q_id, s1_id, q_ad_first_num AS qn, coalesce(q_ad_first_num <> s_ad_first_num, false) AS x FROM both_),
m2 AS (SELECT *, sum(CAST(x AS INTEGER)) OVER (PARTITION BY s1_id, qn) AS nn FROM m)
SELECT q_id, s1_id, coalesce(nd, 0) AS cd_ndev, coalesce(sh, 0) AS cd_share, coalesce(ss, 0) AS cd_share_strong, CAST(x AS INTEGER) AS cd_num_diff, CAST(CASE WHEN x THEN nn - 1 ELSE 0 END AS BIGINT) AS cd_num_share FROM m2 LEFT JOIN d2 USING (q_id, s1_id)""")
def collective(spark, sf):
    return enrich.collective(*scored_records(spark, sf))


@query(f"WITH {O.PAIRS} SELECT s1_id, q_id AS rid FROM best WHERE p >= 0.35")
def assign_threshold(spark, sf):
    return decide.assign(scored(spark, sf), 0.35)


@query(f"WITH {O.PAIRS}, g AS (SELECT 0.05::DOUBLE AS floor, 0.3::DOUBLE AS lam), {O.EXPECTED} SELECT s1_id, rid FROM pred")
def assign_expected_f(spark, sf):
    return decide.assign_expected_f(decide.best(scored(spark, sf)), F.lit(0.3), F.lit(0.05))


_T = ", ".join(f"({t}::DOUBLE)" for t in K.THRESHOLDS)
_FL = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a in K.FLOORS for b in K.LAMBDAS)


@query(f"WITH {O.PAIRS}, g(t) AS (VALUES {_T}), pred AS (SELECT t, s1_id, q_id AS rid FROM best, g WHERE p >= t), {O.metric('t')}")
def tune_threshold(spark, sf):
    return decide.tune_thresholds(decide.best(scored(spark, sf)), truth(spark, sf), primary(spark, sf))


@query(f"WITH {O.PAIRS}, g(floor, lam) AS (VALUES {_FL}), {O.EXPECTED}, {O.metric('floor, lam')}")
def tune_expected_f(spark, sf):
    return decide.tune_expected_f(decide.best(scored(spark, sf)), truth(spark, sf), primary(spark, sf))


@query(f"WITH {O.PAIRS}, g AS (SELECT 1 AS one), pred AS (SELECT 1 AS one, s1_id, q_id AS rid FROM best WHERE p >= 0.35), {O.metric('one').replace('SELECT one, round(avg(x)', 'SELECT round(avg(x)')}")
def macro_f05(spark, sf):
    pred = decide.assign(scored(spark, sf), 0.35)
    return decide.macro_f(decide.f_parts(pred, truth(spark, sf), primary(spark, sf)))


_SUM = lambda x, w: f"CAST(sum(CAST({x} AS DECIMAL(18, 9))) OVER {w} AS DOUBLE)"


@query(f"""WITH {O.PAIRS}, c0 AS (SELECT q_id, s1_id, p1, row_number() OVER (PARTITION BY q_id ORDER BY p1 DESC, s1_id) AS qr, row_number() OVER (PARTITION BY s1_id ORDER BY p1 DESC, q_id) AS sr FROM pairs),
c1 AS (SELECT *, max(p1) OVER q AS qm, {_SUM('p1', 'q')} AS qs, coalesce(max(CASE WHEN qr = 2 THEN p1 END) OVER q, 0) AS q2, {_SUM('p1', 's')} AS ss, max(p1) OVER s AS sm, sum(CAST(p1 > 0.5 AS INTEGER)) OVER s AS s50,
  {_SUM('CASE WHEN qr = 1 THEN p1 ELSE 0 END', 's')} AS bs, sum(CAST(qr = 1 AND p1 > 0.5 AS INTEGER)) OVER s AS b50 FROM c0 WINDOW q AS (PARTITION BY q_id), s AS (PARTITION BY s1_id))
SELECT q_id, s1_id, qr AS q_p1_rank, qm AS q_p1_max, qs AS q_p1_sum, q2 AS q_p1_2nd, CASE WHEN qr = 1 THEN q2 ELSE qm END AS q_p1_other, p1 / greatest(qs, 1e-6) AS q_p1_share,
  p1 - CASE WHEN qr = 1 THEN q2 ELSE qm END AS q_p1_margin, ss AS s_p1_sum, sm AS s_p1_max, CAST(s50 AS BIGINT) AS s_p1_n50, sr AS s_p1_rank, ss - p1 AS s_p1_others,
  CAST(s50 - CAST(p1 > 0.5 AS INTEGER) AS BIGINT) AS s_p1_n50_others, bs AS s_best_sum, CAST(b50 AS BIGINT) AS s_best_n50 FROM c1""")
def competition(spark, sf):
    whole = {c: F.col(c).cast("long") for c in ("q_p1_rank", "s_p1_rank", "s_p1_n50", "s_p1_n50_others", "s_best_n50")}
    return decide.competition(scored(spark, sf)).drop("p1").withColumns(whole)


_GONE = "CAST('0x' || substr(md5('41:' || s1_id), 1, 8) AS BIGINT) % 1000 < 200"


_VIEW = f"""{O.TOP}, v0 AS (SELECT q_id, s1_id, bscore, top1 AS o1, top2 AS o2, row_number() OVER (PARTITION BY q_id ORDER BY bscore DESC, s1_id) AS rk, max(bscore) OVER (PARTITION BY q_id) AS t1 FROM kept WHERE NOT ({_GONE})),
v1 AS (SELECT *, max(CASE WHEN rk = 2 THEN bscore END) OVER (PARTITION BY q_id) AS t2x FROM v0), v2 AS (SELECT *, CASE WHEN t2x IS NOT NULL THEN t2x WHEN t1 = o1 THEN o2 ELSE least(t1, {K.KEEP_RATIO} * o1) END AS t2 FROM v1)"""


def orphan_view(spark: SparkSession, sf: str) -> DataFrame:
    return decide.phantom_view(kept(spark, sf), bucket(K.GONE, F.col("s1_id"), 1000) < 200)


@query(f"""WITH {_VIEW} SELECT q_id, s1_id, round(bscore, 6) AS bscore, CAST(rk - 1 AS INTEGER) AS brank, round(t1, 6) AS top1, round(t2, 6) AS top2, round(bscore - t1, 6) AS gap_top1, round(t1 - t2, 6) AS top_margin,
  round(bscore / t1, 6) AS ratio_top1 FROM v2""")
def phantom_view(spark, sf):
    return orphan_view(spark, sf).select("q_id", "s1_id", r6("bscore"), "brank", *map(r6, ("top1", "top2", "gap_top1", "top_margin", "ratio_top1")))


@query(f"""WITH {_VIEW} SELECT q_id, s1_id, count(*) OVER v AS s1_nq, CAST(sum(CASE WHEN rk = 1 THEN 1 ELSE 0 END) OVER v AS BIGINT) AS s1_ntop1,
  row_number() OVER (PARTITION BY s1_id ORDER BY bscore DESC, q_id) AS s1_rank, round(bscore - max(bscore) OVER v, 6) AS s1_gap FROM v2 WINDOW v AS (PARTITION BY s1_id)""")
def phantom_context(spark, sf):
    return blocking.s1_context(orphan_view(spark, sf)).select("q_id", "s1_id", "s1_nq", "s1_ntop1", "s1_rank", r6("s1_gap"))


@query(f"WITH {O.PAIRS} SELECT s1_id AS source1_entity_id, coalesce(string_agg(rid, ',' ORDER BY rid), '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT DISTINCT s1_id, q_id AS rid FROM best WHERE p >= 0.35) USING (s1_id) GROUP BY 1")
def id_lists(spark, sf):
    return R.id_lists(primary(spark, sf), decide.assign(scored(spark, sf), 0.35))


@query(f"WITH {O.PAIRS} SELECT s1_id, rid AS match_id FROM truth")
def ground_truth_long(spark, sf):
    wide = R.id_lists(primary(spark, sf), truth(spark, sf).withColumnRenamed("match_id", "rid"))
    return R.truth_long(wide)


@query(f"""WITH {O.PAIRS}, ev AS (SELECT s1_id FROM s1 WHERE CAST('0x' || substr(md5('11:' || s1_id), 1, 8) AS BIGINT) % 1000 < 50), touch AS (SELECT DISTINCT q_id FROM pairs JOIN ev USING (s1_id))
SELECT q_id, s1_id, CAST(CASE WHEN q_id IN (SELECT q_id FROM touch) THEN 1 ELSE 0 END AS INTEGER) AS held, CAST(rid IS NOT NULL AS INTEGER) AS y FROM pairs LEFT JOIN (SELECT s1_id, rid, rid AS q_id FROM truth) USING (s1_id, q_id)""")
def holdout_split(spark, sf):
    p, ev = scored(spark, sf), primary(spark, sf).where(bucket(11, F.col("s1_id"), 1000) < 50)
    touch = p.join(ev, "s1_id", "left_semi").select("q_id").distinct().withColumn("held", F.lit(1))
    y = truth(spark, sf).select("s1_id", F.col("match_id").alias("q_id"), F.lit(1).alias("y"))
    return p.join(touch, "q_id", "left").join(y, ["s1_id", "q_id"], "left").select("q_id", "s1_id", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("y", F.lit(0)).alias("y"))


@query(f"""WITH {O.PAIRS}, pred AS (SELECT s1_id, q_id AS rid FROM best WHERE p >= 0.35)
SELECT 'fp' AS kind, s1_id, rid FROM pred ANTI JOIN truth USING (s1_id, rid) UNION ALL SELECT 'fn', s1_id, rid FROM truth ANTI JOIN pred USING (s1_id, rid)
UNION ALL SELECT 'fn_blocking', s1_id, rid FROM (SELECT * FROM truth ANTI JOIN pred USING (s1_id, rid)) ANTI JOIN (SELECT s1_id, q_id AS rid FROM pairs) USING (s1_id, rid)""")
def error_sets(spark, sf):
    both, p = ["s1_id", "rid"], scored(spark, sf)
    pred, real = decide.assign(p, 0.35), truth(spark, sf).withColumnRenamed("match_id", "rid")
    fn = real.join(pred, both, "left_anti")
    lost = fn.join(p.select("s1_id", F.col("q_id").alias("rid")), both, "left_anti")
    return pred.join(real, both, "left_anti").select(F.lit("fp").alias("kind"), *both).unionByName(fn.select(F.lit("fn").alias("kind"), *both)).unionByName(lost.select(F.lit("fn_blocking").alias("kind"), *both))


@query(f"WITH {O.PAIRS} SELECT count(DISTINCT s1_id) AS matched_s1, count(*) AS matches FROM best WHERE p >= 0.35")
def matched_count(spark, sf):
    return decide.assign(scored(spark, sf), 0.35).agg(F.countDistinct("s1_id").alias("matched_s1"), F.count("*").alias("matches"))


@query(f"""WITH {O.PAIRS}, pred AS (SELECT s1_id, q_id AS rid FROM best WHERE p >= 0.35), fp AS (SELECT * FROM pred ANTI JOIN truth USING (s1_id, rid))
SELECT s1_id, rid FROM fp ORDER BY md5('0:' || s1_id || '|' || rid) LIMIT 15""")
def sampled_errors(spark, sf):
    wrong = decide.assign(scored(spark, sf), 0.35).join(truth(spark, sf).withColumnRenamed("match_id", "rid"), ["s1_id", "rid"], "left_anti")
    return wrong.orderBy(F.md5(F.concat(F.lit("0:"), "s1_id", F.lit("|"), "rid"))).limit(15)


@query(f"""WITH {O.PAIRS}, lists AS (SELECT s1_id, rid FROM s1 LEFT JOIN (SELECT DISTINCT s1_id, q_id AS rid FROM best WHERE p >= 0.35) USING (s1_id)),
k AS (SELECT count(*) - count(DISTINCT s1_id) AS rows_ FROM (SELECT DISTINCT s1_id FROM lists)),
r AS (SELECT rid, count(*) AS n FROM lists WHERE rid IS NOT NULL GROUP BY 1)
SELECT 'repeated_rows' AS kind, (SELECT rows_ FROM k) AS n UNION ALL SELECT 'missing_rows', (SELECT count(*) FROM s1 ANTI JOIN lists USING (s1_id)) UNION ALL SELECT 'unknown_rows', (SELECT count(*) FROM lists ANTI JOIN s1 USING (s1_id))
UNION ALL SELECT 'unknown_ids', (SELECT count(*) FROM r ANTI JOIN (SELECT entity_id AS rid FROM rec WHERE src > 1) USING (rid)) UNION ALL SELECT 'shared_ids', (SELECT count(*) FROM r WHERE n > 1)""")
def output_checks(spark, sf):
    s1 = primary(spark, sf)
    faults = check_lists(materialize(R.id_lists(s1, decide.assign(scored(spark, sf), 0.35))), s1, view(spark, sf).where("src > 1"))
    return spark.createDataFrame(list(faults.items()), "kind string, n long")


@query(f"""WITH {O.TOP}, one AS (SELECT q_id, s1_id FROM top),
more AS (SELECT q_id, s1_id FROM (SELECT q.rec_id AS q_id, s.rec_id AS s1_id, round(sum(MAP {{'nw': 0.55, 'ng': 0.45}}[ns] * q.w * s.w), 9) AS b
  FROM (SELECT * FROM wt WHERE in_product AND src > 1 AND ns IN ('nw', 'ng')) q JOIN (SELECT rec_id, country, ns, key, w FROM wt WHERE in_product AND src = 1) s USING (country, ns, key) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY b DESC, s1_id) <= 5)
SELECT * FROM one UNION SELECT * FROM more""")
def union_blocking(spark, sf):
    return blocking.union_topk(linked(spark, sf).weighted, [(K.WEIGHTS, K.TOP_K), ({"nw": 0.55, "ng": 0.45}, 5)]).select("q_id", "s1_id")


_SIX = O.listed(K.OLD_WEIGHTS)


@query(f"""WITH {O.FEATS}, ones AS (SELECT country, count(*) AS n FROM rec WHERE src = 1 GROUP BY 1), own AS (SELECT country, ns, key, count(*) AS df FROM feats WHERE src = 1 GROUP BY ALL),
vals AS (SELECT f.rec_id, f.ns, CASE WHEN df IS NULL THEN ln(n + 1) + 1 ELSE ln((n + 1) / (df + 1)) + 1 END AS idf, coalesce(df <= {K.OLD_MAX_DF}, false) AND f.ns <> 'an' AS used
  FROM feats f JOIN ones USING (country) LEFT JOIN own USING (country, ns, key) WHERE list_contains({_SIX}, f.ns)),
unit AS (SELECT *, idf / sqrt(sum(idf * idf) OVER (PARTITION BY rec_id, ns)) AS w FROM vals)
SELECT rec_id, ns, count(*) AS n, count(*) FILTER (used) AS n_used, round(sum(w), 6) AS total FROM unit GROUP BY 1, 2""")
def six_spaces(spark, sf):
    found = features.six_spaces(materialize(norm(spark, sf)))
    return found.groupBy("rec_id", "ns").agg(F.count("*").alias("n"), F.count_if("in_product").alias("n_used"), F.round(F.sum("w"), 6).alias("total"))


@query(f"""WITH {O.NORM}, tk AS (SELECT t, count(*) FILTER (src = 1) AS df, count(*) FILTER (src > 1) AS nt FROM (SELECT src, unnest(nm_tok) AS t FROM norm) GROUP BY 1),
sz AS (SELECT count(*) FILTER (src = 1) AS n1, count(*) FILTER (src > 1) AS nq FROM norm),
v AS (SELECT t, df, ln(((nt + 1) / nq) / ((df + 1) / n1)) AS lratio, sum(df) OVER (ORDER BY df RANGE UNBOUNDED PRECEDING) / sum(df) OVER () AS dfpct FROM tk, sz)
SELECT country, t, df, round(lratio, 6) AS lratio, round(dfpct, 6) AS dfpct FROM v JOIN (SELECT DISTINCT country, unnest(nm_tok) AS t FROM norm) USING (t)""")
def pooled_token_stats(spark, sf):
    return enrich.token_stats(materialize(norm(spark, sf).select("src", "country", "nm_tok")), by_country=False).select("country", "t", "df", r6("lratio"), r6("dfpct"))


_TRANSLIT = [("हाईटेक लॉजिस्टिक्स", "Hitech Logistics"), ("हाईटेक सेवा", "Hitech Seva"), ("नया लॉजिस्टिक्स", "Naya Logistics"), ("नया सेवा", "Nava Seva"), ("सेवा नया दो", "Seva"), ("Plain सेवा", "Plain Sewa")]
_MATCHED = ", ".join(f"({O.quote(a)}, {O.quote(b)})" for a, b in _TRANSLIT)
_LEARN = rf"""m(q, s) AS (VALUES {_MATCHED}), z AS (SELECT regexp_split_to_array(trim(q), '\s+') AS q, regexp_split_to_array(trim(s), '\s+') AS s FROM m WHERE regexp_matches(q, '[\x{{0900}}-\x{{0dff}}]')),
y AS (SELECT q[i] AS k0, s[i] AS v0 FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM z WHERE len(q) = len(s))),
x AS (SELECT replace(replace(k0, chr(8204), ''), chr(8205), '') AS k, regexp_replace(lower(v0), '[^\p{{L}}\p{{N}}]', '', 'g') AS v FROM y WHERE regexp_matches(k0, '[\x{{0900}}-\x{{0dff}}]')),
c AS (SELECT k, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY k) AS total FROM x WHERE k <> '' AND v <> '' GROUP BY 1, 2),
learned AS (SELECT k, v FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1 AND n >= 2 AND n / total >= 0.5)"""


def learned_names(spark: SparkSession) -> DataFrame:
    return translit.learn_names(spark.createDataFrame(_TRANSLIT, "q_name string, s_name string"))


@query(f"WITH {_LEARN} SELECT k, v FROM learned")
def translit_learn(spark, sf):
    return learned_names(spark)


@query(rf"""WITH {_LEARN}, t AS (SELECT q AS name, regexp_split_to_array(trim(q), '\s+') AS w FROM m),
e AS (SELECT name, i, w[i] AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t))
SELECT name, string_agg(coalesce(v, x), ' ' ORDER BY i) AS replaced FROM e LEFT JOIN learned ON k = x GROUP BY 1""")
def translit_apply(spark, sf):
    names = spark.createDataFrame([(q, q) for q, _ in _TRANSLIT], "name string, replaced string")
    return translit.apply_names(names, learned_names(spark), "replaced")


_PLACES = [("12 Main Rd, महाराष्ट्र", "12 Main Road, Maharashtra"), ("Oak St, महाराष्ट्र", "Oak Street, MAHARASHTRA"), ("5 Hill, गुजरात", "5 Hill, Gujarat, India"), ("6 Hill, गुजरात", "6 Hill, Gujarat"), ("7 Hill, गुजरात", "7 Hill, Goa"), ("8 Hill, केरल", "8 Hill, Kerala")]
_PLACED = ", ".join(f"({O.quote(a)}, {O.quote(b)})" for a, b in _PLACES)
_PARTS = lambda c: f"list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""WITH m(q, s) AS (VALUES {_PLACED}), z AS (SELECT unnest({_PARTS('q')}) AS k, list_distinct(list_transform({_PARTS('s')}, lambda x: lower(x))) AS s FROM m),
y AS (SELECT k, s FROM z WHERE regexp_matches(k, '[\x{{0900}}-\x{{0dff}}]')), t AS (SELECT k, count(*) AS total FROM y GROUP BY 1), c AS (SELECT k, v, count(*) AS n FROM (SELECT k, unnest(s) AS v FROM y) GROUP BY 1, 2)
SELECT k, v FROM c JOIN t USING (k) QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, v) = 1 AND n >= 2 AND n / total >= 0.8""")
def translit_addresses(spark, sf):
    return translit.learn_addresses(spark.createDataFrame(_PLACES, "q_address string, s_address string"))


# Queries with models, which SQL has not: few rounds and shallow trees, so that they end soon on small tables.

_SMALL = {"depth": 4, "step": 0.2, "bins": 32}


def all_features(spark: SparkSession, sf: str) -> DataFrame:
    """Stored pairs with every first-stage feature and the label ``y``."""
    found = linked(spark, sf)
    k = listed(found)
    profile = materialize(linkage.profiles(found.recs, features.vectors(found.weighted), features.unseen_left(found.feats, found.weighted)))
    y = truth(spark, sf).select("s1_id", F.col("match_id").alias("q_id"), F.lit(1).alias("y"))
    return materialize(linkage.pair_features(k, profile).join(blocking.s1_context(k), ["q_id", "s1_id"]).join(y, ["q_id", "s1_id"], "left").na.fill(0, ["y"]))


@query()
def pair_table(spark, sf):
    """Every feature of every pair; each group of its columns is a query of its own with SQL, and a test holds both together."""
    return all_features(spark, sf)


@query()
def gbt_train_score(spark, sf):
    data = all_features(spark, sf)
    return model.out_of_fold(data, linkage.feature_names(data.columns), rounds=8, **_SMALL).select("q_id", "s1_id", F.round("p1", 6).alias("p1"), "y")


@query()
def self_training(spark, sf):
    data = all_features(spark, sf)
    first = model.out_of_fold(data, linkage.feature_names(data.columns), rounds=8, **_SMALL).withColumnRenamed("p1", "p")
    return model.pseudo_labels(first, high=0.9, low=0.1)


def small_run(spark: SparkSession, sf: str) -> linkage.Linkage:
    """A whole run over the record view, in a folder of its own under the shared one."""
    settings = linkage.Settings(rounds=(4, 6), model=_SMALL, fit_share=1000, collective=True)
    raw = lambda: view(spark, sf).select(*R.SCHEMA.names, "src")
    return linkage.Linkage(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", {"train": raw, "test": raw}, truth(spark, sf), settings)


@query()
def linkage_run(spark, sf):
    """Matches of every primary record, from raw records through both stages to checked id lists."""
    run = small_run(spark, sf)
    run.outputs("test", f"{run.work}/out")
    return R.id_lists(run.s1("test"), decide.decide(run.predict("test"), run.report()))


@query()
def orphan_study(spark, sf):
    """The metric of three variants, with and without orphans."""
    out = small_run(spark, sf).orphans()
    rows = [(world, variant, m["f"], m["precision"], m["recall"], m["n"]) for world in ("normal", "orphans") for variant, m in out[world].items()]
    return spark.createDataFrame(rows, "world string, variant string, f double, precision double, recall double, n long")


@query()
def transfer_study(spark, sf):
    """One row for each two countries: the metric at home and abroad, before and after training on sure predictions."""
    rows = linkage.transfer(small_run(spark, sf), lambda names: {"full": names}, rounds=2, self_train=True, **_SMALL)
    kinds = {"train": "string", "eval": "string", "features": "string", "rule": "string", "n_features": "long", "pseudo_pos": "long", "pseudo_neg": "long"}
    names = ("train", "eval", "features", "n_features", "rule", "same", "cross", "precision", "recall", "after", "precision_after", "recall_after", "pseudo_pos", "pseudo_neg", "pseudo_pos_precision", "pseudo_neg_error")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))
