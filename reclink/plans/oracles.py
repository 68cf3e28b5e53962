"""SQL of the registered queries, built from common table expressions over ``documents``."""

from __future__ import annotations

from reclink.functions import constants as K
from reclink.functions.text import SPELLED, accent_table


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mapping(values: dict) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v) if isinstance(v, str) else v}" for k, v in values.items()) + "}"


def listed(values) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def folded(column: str) -> str:
    source, target = accent_table()
    out = f"translate({column}, {quote(source)}, {quote(target)})"
    for a, b in SPELLED.items():
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return out


def replaced(column: str, *steps: tuple[str, str]) -> str:
    for pattern, put in steps:
        column = f"regexp_replace({column}, {quote(pattern)}, {quote(put)}, 'g')"
    return column


def canon(values: dict, x: str) -> str:
    return f"coalesce({mapping(values)}[{x}], {x})"


def deleet(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '[a-z]') AND regexp_matches({x}, '\d') AND NOT regexp_matches({x}, '^\d+(?:st|nd|rd|th)$') THEN translate({x}, '013457', 'oleast') ELSE {x} END"


def words(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda x: x <> '')"


def ordered_distinct(a: str) -> str:
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


REC = r"""
w AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[ \n\t\r]+'), lambda x: x <> '') AS w FROM documents),
rec AS (SELECT CAST(doc_id AS VARCHAR) AS entity_id, CAST(doc_id % 3 + 1 AS INTEGER) AS src, lang AS country, array_to_string(w[1:4], ' ') AS business_name,
  CAST(n_chars AS VARCHAR) || ' ' || array_to_string(w[5:7], ' ') || ', ' || source || ', ' || lang AS business_address, md5(substr(text, 1, 60)) AS ck FROM w)"""

_CLEAN = f"trim({replaced(f'lower({folded("business_name")})', (K.PHONE, ' '), (r'\bwww\.', ' '), (K.TOP_LEVEL_DOMAIN, ' '), ('&', ' and '), ("['`’]", ''), (r'\.', ''), (K.ALIAS_MARKERS, ' | '), ('[^a-z0-9|]+', ' '), (r'\s+', ' '))})"
_STOP, _ASTOP = listed(K.NAME_STOP), listed(K.ADDRESS_STOP)


def _name(tokens: str) -> str:
    return f"list_transform(list_transform({tokens}, lambda x: {canon(K.NAME_CANON, 'x')}), lambda x: {deleet('x')})"


_LEAD = lambda x: f"regexp_replace({x}, '^0+', '')"
_CODES = f"list_transform(list_filter(regexp_extract_all(replace(a0, '#', ''), {quote(K.CODE)}), lambda x: regexp_matches(x, '\\d')), lambda x: {_LEAD("regexp_replace(x, '[\\-/.]', '', 'g')")})"

NORM = f"""{REC},
n0 AS (SELECT *, {_CLEAN} AS c, regexp_replace(lower({folded('business_address')}), '\\bnull\\b', ' ', 'g') AS a0 FROM rec),
n1 AS (SELECT *, {_name(words("replace(c, '|', ' ')"))} AS ftok,
  list_filter(list_transform(string_split(c, '|'), lambda p: array_to_string(list_filter({_name("list_filter(string_split(p, ' '), lambda z: z <> '')")}, lambda y: NOT list_contains({_STOP}, y)), ' ')), lambda p: p <> '') AS nm_parts,
  {replaced('a0', (r'(\d)([a-z])', r'\1 \2'), (r'([a-z])(\d)', r'\1 \2'))} AS a1, {_CODES} AS codes FROM n0),
n2 AS (SELECT *, list_filter(ftok, lambda x: NOT list_contains({_STOP}, x)) AS core, {words("regexp_replace(a1, '[^a-z0-9]+', ' ', 'g')")} AS toks,
  list_filter(list_concat(codes, list_transform(codes, lambda x: {_LEAD("regexp_replace(x, '[a-z]', '', 'g')")})), lambda x: length(x) > 1) AS codes2 FROM n1),
n3 AS (SELECT *, {ordered_distinct('core')} AS nm_tok, list_transform(toks, lambda x: regexp_replace(x, '^0+(\\d)', '\\1')) AS nums,
  list_filter(list_transform(list_filter(toks, lambda x: NOT regexp_matches(x, '\\d')), lambda x: {canon(K.ADDRESS_CANON, 'x')}), lambda x: NOT list_contains({_ASTOP}, x) AND length(x) > 1) AS atoks FROM n2),
norm AS (SELECT entity_id, src, country, business_name, business_address, ck, array_to_string(ftok, ' ') AS nm, nm_parts, nm_tok, array_to_string(nm_tok, ' ') AS nm_core, array_to_string(nm_tok, '') AS nm_concat,
  array_to_string(list_transform(nums, lambda x: {canon(K.ADDRESS_CANON, 'x')}), ' ') AS ad,
  list_filter(list_transform(string_split(a1, ','), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS ad_comp,
  {ordered_distinct('atoks')} AS ad_tok, {ordered_distinct('codes2')} AS ad_code,
  list_filter(nums, lambda x: regexp_matches(x, '^\\d+$')) AS ad_nums,
  list_filter(nums, lambda x: regexp_matches(x, '^\\d+$'))[1] AS ad_first_num FROM n3)"""

FEATS = f"""{NORM},
k0 AS (SELECT *, list_filter(string_split(array_to_string(nm_parts, ' '), ' '), lambda x: x <> '') AS nw, nm_tok[1:6] AS six, ad_tok[1:8] AS eight FROM norm),
k1 AS (
  SELECT entity_id, src, country, 'nw' AS ns, unnest(nw) AS key FROM k0
  UNION ALL SELECT entity_id, src, country, 'ng', substr(nm_concat, p, 3) FROM (SELECT *, unnest(range(1, least(length(nm_concat), 40) - 1)) AS p FROM k0)
  UNION ALL SELECT entity_id, src, country, 'aw', unnest(ad_tok) FROM k0
  UNION ALL SELECT entity_id, src, country, 'an', unnest(ad_nums) FROM k0
  UNION ALL SELECT entity_id, src, country, 'ac', unnest(ad_code) FROM k0
  UNION ALL SELECT entity_id, src, country, 'ap', ad_first_num || '|' || t FROM (SELECT *, unnest(ad_tok[1:2]) AS t FROM k0 WHERE ad_first_num IS NOT NULL)
  UNION ALL SELECT entity_id, src, country, 'np', least(six[i], six[j]) || '|' || greatest(six[i], six[j]) FROM (SELECT *, unnest(range(i + 1, len(six) + 1)) AS j FROM (SELECT *, unnest(range(1, len(six) + 1)) AS i FROM k0))
  UNION ALL SELECT entity_id, src, country, 'xn', a || '|' || b FROM (SELECT *, unnest(ad_tok[1:6]) AS b FROM (SELECT *, unnest(nm_tok[1:4]) AS a FROM k0))
  UNION ALL SELECT entity_id, src, country, 'ab', eight[i] || '|' || eight[i + 1] FROM (SELECT *, unnest(range(1, len(eight))) AS i FROM k0)),
feats AS (SELECT DISTINCT entity_id AS rec_id, src, country, ns, key FROM k1)"""

STATS = f"""{FEATS},
cnt AS (SELECT country, ns, key, count(*) FILTER (src = 1) AS df, count(*) AS cdf FROM feats GROUP BY ALL),
stats AS (SELECT country, ns, key, df, cdf, ln((n + 1) / (cdf + 1)) + 1 AS idf, (df <= {K.MAX_DF} AND {mapping(K.WEIGHTS)}[ns] > 0) AS in_product
  FROM cnt JOIN (SELECT country, count(*) AS n FROM rec GROUP BY 1) USING (country) WHERE df > 0)"""

WEIGHTED = f"""{STATS},
wt AS (SELECT rec_id, src, country, ns, key, idf / sqrt(sum(idf * idf) OVER (PARTITION BY rec_id, ns)) AS w, in_product FROM feats JOIN (SELECT country, ns, key, idf, in_product FROM stats) USING (country, ns, key))"""

TOP = f"""{WEIGHTED},
scored AS (SELECT q.rec_id AS q_id, s.rec_id AS s1_id, country, round(sum({mapping(K.WEIGHTS)}[ns] * q.w * s.w), 9) AS bscore
  FROM (SELECT * FROM wt WHERE in_product AND src > 1) q JOIN (SELECT rec_id, country, ns, key, w FROM wt WHERE in_product AND src = 1) s USING (country, ns, key) GROUP BY 1, 2, 3),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY bscore DESC, s1_id) - 1 AS INTEGER) AS brank FROM scored QUALIFY brank < {K.TOP_K}),
ctx AS (SELECT *, max(bscore) OVER w AS top1, coalesce(max(CASE WHEN brank = 1 THEN bscore END) OVER w, 0.0) AS top2, count(*) OVER w AS n_ret FROM top WINDOW w AS (PARTITION BY q_id)),
kept AS (SELECT *, bscore - top1 AS gap_top1, top1 - top2 AS top_margin, bscore / top1 AS ratio_top1 FROM ctx WHERE brank < {K.KEEP} AND bscore >= {K.KEEP_RATIO} * top1)"""

#: A score for the decision queries, so that they need no model: the blocking score, and a hashed one.
PAIRS = f"""{TOP},
pairs AS (SELECT q_id, s1_id, round(bscore, 6) AS p, round((CAST('0x' || substr(md5(q_id || '|' || s1_id), 1, 8) AS BIGINT) % 1000) / 1000.0, 3) AS p1 FROM kept),
truth AS (SELECT s.id AS s1_id, r.entity_id AS rid FROM rec r JOIN (SELECT country, ck, CAST(min(CAST(entity_id AS BIGINT)) AS VARCHAR) AS id FROM rec WHERE src = 1 GROUP BY 1, 2) s ON r.country = s.country AND r.ck = s.ck WHERE r.src > 1),
s1 AS (SELECT entity_id AS s1_id FROM rec WHERE src = 1),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY p DESC, s1_id) = 1)"""


def side(columns: str) -> str:
    """Kept pairs with columns of both records."""
    names = columns.split(", ")
    picked = ", ".join(f"{a}.{c} AS {p}_{c}" for a, p in (("q", "q"), ("s", "s")) for c in names)
    return f"{PAIRS},\nboth_ AS (SELECT p.q_id, p.s1_id, p.p1, {picked} FROM pairs p JOIN norm q ON p.q_id = q.entity_id JOIN norm s ON p.s1_id = s.entity_id)"


def metric(grid: str) -> str:
    """The metric of predictions ``pred`` by the columns ``grid``, over the grid table ``g``."""
    return f"""
parts AS (SELECT {grid}, s1_id, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM (SELECT * FROM g, s1)
  LEFT JOIN (SELECT {grid}, s1_id, count(*) AS tp FROM pred JOIN truth USING (s1_id, rid) GROUP BY ALL) USING ({grid}, s1_id)
  LEFT JOIN (SELECT {grid}, s1_id, count(*) AS np FROM pred GROUP BY ALL) USING ({grid}, s1_id) LEFT JOIN (SELECT s1_id, count(*) AS nt FROM truth GROUP BY 1) USING (s1_id)),
ff AS (SELECT *, CASE WHEN np = 0 AND nt = 0 THEN 1.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (nt - tp) + np - tp) END AS x FROM parts)
SELECT {grid}, round(avg(x), 6) AS f, round(avg(x) FILTER (nt = 0), 6) AS f_single, round(avg(x) FILTER (nt > 0), 6) AS f_matched,
  round(sum(tp) / nullif(sum(np), 0), 6) AS precision, round(sum(tp) / nullif(sum(nt), 0), 6) AS recall, count(*) AS n FROM ff GROUP BY {grid}"""


EXPECTED = """
e0 AS (SELECT *, row_number() OVER o AS m, sum(p) OVER (PARTITION BY floor, lam, s1_id ORDER BY p DESC, q_id ROWS UNBOUNDED PRECEDING) AS cum, sum(p) OVER v AS tot, exp(sum(ln(greatest(1 - p, 1e-6))) OVER v - lam) AS none_
  FROM (SELECT * FROM best, g WHERE p >= floor) WINDOW v AS (PARTITION BY floor, lam, s1_id), o AS (PARTITION BY floor, lam, s1_id ORDER BY p DESC, q_id)),
e1 AS (SELECT *, round(1.25 * cum / (m + 0.25 * (tot + lam)), 12) AS score FROM e0),
e2 AS (SELECT *, max(score) OVER (PARTITION BY floor, lam, s1_id) AS top FROM e1),
e3 AS (SELECT *, min(CASE WHEN score = top THEN m END) OVER (PARTITION BY floor, lam, s1_id) AS best_m FROM e2),
pred AS (SELECT floor, lam, s1_id, q_id AS rid FROM e3 WHERE top > none_ AND m <= best_m)"""


def subsequence(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings of up to 126 characters: the rows of the table as bits of one number."""
    full = f"((1::HUGEINT << length({a})) - 1)"
    at = f"list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, CAST(i + 1 AS INTEGER), 1) = c THEN 1::HUGEINT << CAST(i AS INTEGER) ELSE 0::HUGEINT END)"
    masks = f"list_transform(string_split({b}, ''), lambda c: CAST(list_sum({at}) AS HUGEINT))"
    row = f"list_reduce(list_prepend({full}, {masks}), lambda row, m: ((row + (row & m)) | (row - (row & m))) & {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({row}) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0 ELSE 200.0::DOUBLE * ({subsequence(a, b)}) / (length({a}) + length({b})) END"


def _sorted_words(x: str) -> str:
    return f"array_to_string(list_sort({words(x)}), ' ')"


def fuzzy(prefix: str, q: str, s: str) -> str:
    """CTEs from ``both_``: ``<prefix>_z`` with ``q_id, s1_id`` and the four fuzzy ratios of two columns."""
    p = prefix
    joined = lambda rest: f"trim(shared || ' ' || {rest})"
    return f"""
{p}_a AS (SELECT q_id, s1_id, {q} AS a, {s} AS b, {_sorted_words(q)} AS sa, {_sorted_words(s)} AS sb, list_distinct({words(q)}) AS wa, list_distinct({words(s)}) AS wb FROM both_),
{p}_b AS (SELECT *, array_to_string(list_sort(list_filter(wa, lambda x: list_contains(wb, x))), ' ') AS shared, array_to_string(list_sort(list_filter(wa, lambda x: NOT list_contains(wb, x))), ' ') AS l,
  array_to_string(list_sort(list_filter(wb, lambda x: NOT list_contains(wa, x))), ' ') AS r FROM {p}_a),
{p}_c AS (SELECT *, {joined('l')} AS one, {joined('r')} AS two FROM {p}_b),
{p}_w AS (SELECT DISTINCT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS x, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS y FROM {p}_a WHERE a <> '' AND b <> ''
  UNION SELECT a, b, b, a FROM {p}_a WHERE length(a) = length(b) AND a <> ''),
{p}_v AS (SELECT DISTINCT a, b, x, substr(y, greatest(k, 0) + 1, k + length(x) - greatest(k, 0)) AS y FROM (SELECT *, unnest(range(1 - length(x), length(y))) AS k FROM {p}_w)),
{p}_p AS (SELECT a, b, max({ratio('x', 'y')}) AS best FROM {p}_v GROUP BY 1, 2),
{p}_z AS (SELECT q_id, s1_id, {ratio('a', 'b')} AS {p}_ratio, {ratio('sa', 'sb')} AS {p}_tsort,
  CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 WHEN shared <> '' AND (l = '' OR r = '') THEN 100.0
    ELSE greatest({ratio('one', 'two')}, CASE WHEN shared = '' THEN 0.0 ELSE greatest({ratio('shared', 'one')}, {ratio('shared', 'two')}) END) END AS {p}_tset,
  coalesce(best, CASE WHEN a = b THEN 100.0 ELSE 0.0 END) AS {p}_partial FROM {p}_c LEFT JOIN {p}_p USING (a, b))"""


def winkler(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_winkler_similarity({a}, {b}) END"
